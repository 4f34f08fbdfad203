"""Steps whose cost must not grow faster than their input."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.operators import balance, evaluate, retrieve
from rewardloom.plans import scale


def test_cut_points_stand_in_the_expression_once(spark):
    df = spark.range(10).withColumn("__pos", scale._position([], ["id"]))
    column = scale._range_id(df, [], ["id"], 2, '[{"p0":123456},{"p0":223456}]')
    assert str(column).count("223456") == 1
    rows = [(0,), (123456,), (200000,), (223456,), (300000,)]
    marked = spark.createDataFrame(rows, "id long").withColumn("__pos", scale._position([], ["id"]))
    assert [r.r for r in marked.orderBy("id").select(column.alias("r")).collect()] == [0, 1, 1, 2, 2]


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(1995, 3, 1)
    orders = [(k, f"p{k % 2}") for k in range(6)]
    lines = [(k, 10 - n, n, n + 1, float(n + 1), 100.0, 0.05, 0.02, "R", "O", day) for k in range(6) for n in range(k + 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
             "l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_staged_rollouts_hold_no_tokens_and_every_row_its_place(spark, folder):
    from checks import base

    assert not [c for c, t in base.staged(spark, folder).dtypes if t.startswith("array")]
    rows = base.tokens(spark, folder, "values", "mask", indexed=True).orderBy("uid", "rollout_n").collect()
    assert [r.row_idx for r in rows] == list(range(21))
    assert [r.l_partkey for r in rows if r.uid == 2] == [8, 9, 10]
    for r in rows:
        assert r["values"] == [(r.l_partkey + t) % 11 / 10.0 for t in range(1, r.response_len + 1)]
        assert len(r["mask"]) == r.response_len
    assert "logp" not in base.tokens(spark, folder, "values").columns


def test_staging_writes_where_rows_lie_in_bounded_files(spark, folder, monkeypatch):
    from pyspark.sql import DataFrame

    from checks import base

    monkeypatch.setattr(DataFrame, "repartition", lambda *a: pytest.fail("rows are shuffled once more"))
    monkeypatch.setattr(base, "ROWS_PER_FILE", 2)
    monkeypatch.setattr(base, "_STAGED", {})
    staged = base.staged(spark, folder)
    assert staged.count() == 21 and len(staged.inputFiles()) >= 11


def test_equal_patterns_of_answers_share_their_resamples():
    evaluate._known_wins.cache_clear()
    values = np.array([1.0, 2.0, 5.0])
    first = evaluate._majority_of_resamples(np.array(["a", None, "a"], object), values, 3, 200, 42)
    other = evaluate._majority_of_resamples(np.array(["x", "y", "x"], object), values, 3, 200, 42)
    assert first == other and evaluate._known_wins.cache_info().misses == 1
    picked = evaluate._resamples(3, 3, 200, 42)
    codes = np.array([0, 1, 0])
    won = []
    for row in picked:
        counts = [int((codes[row] == codes[i]).sum()) for i in row]
        won.append(values[row[int(np.argmax(counts))]])
    assert first == pytest.approx((np.mean(won), np.std(won)))
    gap = evaluate._majority_of_resamples(np.array(["a", "b"], object), np.array([np.nan, 1.0]), 2, 50, 42)
    assert np.isnan(gap[0])


def test_small_batches_are_split_in_runs_not_one_call_each(spark):
    rows = [(b if b else None, r, (r * 37 + (b or 0) * 11) % 101) for b in range(40) for r in range(7)]
    df = spark.createDataFrame(rows, "batch long, row long, work long")
    parts = balance.balance_partitions(df, "batch", "row", "work", 3, equal_size=False)
    assert "InPandas" not in parts._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.batch, r.row): r.part for r in parts.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for b in range(40):
        own = [w for x, _, w in rows if x == (b or None)]
        assert [got[(b or None, r)] for r in range(7)] == balance.largest_differencing(np.array(own, float), 3, False).tolist()


def test_dense_search_copies_neither_side_once_per_block(spark, monkeypatch):
    seen = {}
    real = retrieve._met

    def met(spark_, held, rows, k, groups, stripes, *rest):
        seen.update(groups=groups, stripes=stripes)
        return real(spark_, held, rows, k, groups, stripes, *rest)

    monkeypatch.setattr(retrieve, "_met", met)
    vectors = np.random.default_rng(3).normal(size=(200, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    out = retrieve.dense_topk(df.selectExpr("id query_id", "embedding"), df.selectExpr("id doc_id", "embedding"), 3, block=2).collect()
    assert seen["groups"] * seen["stripes"] <= 64 and seen["groups"] <= 8
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :3]
    assert {(r.query_id, r.rank): r.doc_id for r in out} == {(q, j + 1): int(best[q, j]) for q in range(200) for j in range(3)}


def test_resamples_of_all_short_sizes_are_kept():
    evaluate._short_draws.cache_clear()
    for _ in range(2):
        for n in range(2, 20):
            evaluate._resamples(n, 2, 10, 42)
    assert evaluate._short_draws.cache_info().misses == 18


def test_a_long_prefix_is_found_without_numbering_rows(spark, monkeypatch):
    numbered = []
    real = scale.rank_within
    monkeypatch.setattr(scale, "rank_within", lambda *a, **k: numbered.append(1) or real(*a, **k))
    monkeypatch.setattr(scale, "DIRECT_LIMIT", 10)
    monkeypatch.setattr(scale, "SELECT_SAMPLE", 400)
    monkeypatch.setattr(scale, "SELECT_ROWS", 300)
    value = "case when id % 11 = 0 then null when id % 13 = 0 then double('nan') else (id * 7919) % 1009 / 3.0D end"
    df = spark.range(6000).selectExpr("id", f"{value} as v")
    for order, sort in ((["v desc", "id"], [F.col("v").desc(), "id"]), (["v", "id desc"], ["v", F.col("id").desc()])):
        want = [r.id for r in df.orderBy(*sort).collect()]
        for n, rows in ((11, None), (600, 6000), (3000, 5000), (5999, 9000), (7000, None)):
            assert scale.nth_row(df, order, n, rows).first().id == want[min(n, 6000) - 1]
    assert not numbered
    same = df.selectExpr("1 as v", "2 as id")
    assert scale.nth_row(same, ["v", "id"], 3000).first().id == 2
    assert scale.nth_row(df.limit(0), ["v", "id"], 3000).first() is None


def test_ranges_of_positions_are_found_by_the_batch(spark):
    kinds = "a double, b string, c date, d boolean, e binary, id long"
    df = spark.range(3000).selectExpr(
        "case when id % 11 = 0 then null when id % 13 = 0 then double('nan') when id % 17 = 0 then -0.0D else (id * 7919) % 7 / 3.0D end as a",
        "case when id % 5 = 0 then null else concat('\u00e9', cast(id % 3 as string)) end as b",
        "date_add(date'1995-01-01', cast(id % 4 as int)) as c", "id % 2 = 0 as d", "cast(cast(id % 3 as string) as binary) as e", "id")
    assert [t for _, t in df.dtypes] == [k.split()[1].replace("long", "bigint") for k in kinds.split(", ")]
    for order in (["a", "b desc", "c", "d desc", "e", "id"], ["b", "a desc", "id desc"], ["e desc", "d", "a", "id"]):
        count, cuts = scale._cut_points(df, ["c"], order, 30, 3000)
        marked = df.withColumn("__pos", scale._position(["c"], order))
        number = scale._range_number(df, ["c"], order, count, cuts)
        rows = marked.select(number.alias("x"), scale._range_id(df, ["c"], order, count, cuts).alias("y")).collect()
        assert count > 20 and [r.x for r in rows] == [r.y for r in rows]
    plan = scale.rank_within(df, [], ["a", "id"], "r", rows_per_range=200)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    nested = spark.sql("select array(id) as a from range(50)")
    assert [r.r for r in scale.rank_within(nested, [], ["a"], "r", rows_per_range=9).orderBy("a").collect()] == list(range(50))


def test_staging_measures_orders_once(spark, folder, monkeypatch):
    from checks import base

    made = []
    real = base.rank_within
    monkeypatch.setattr(base, "rank_within", lambda *a, **k: made.append(k) or real(*a, **k))
    df, rows = base.derive_rollouts(spark, folder, True)
    assert rows == 21 and made == [{"rows": 21, "largest": 6}]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    got = df.orderBy("row_idx").select("row_idx", "uid", "rollout_n").collect()
    assert [tuple(r) for r in got] == [(i, k, n) for i, (k, n) in enumerate((k, n) for k in range(6) for n in range(k + 1))]


def test_a_known_largest_group_saves_measuring(spark, monkeypatch):
    df = spark.range(400).selectExpr("id % 3 as k", "id")
    want = [(i % 3, i, i // 3) for i in range(400)]
    for largest in (None, 134):
        out = scale.rank_within(df, ["k"], ["id"], "r", rows=400, rows_per_range=50, largest=largest)
        assert sorted((r.k, r.id, r.r) for r in out.collect()) == sorted(want)
    plan = scale.rank_within(df, ["k"], ["id"], "r", rows=400, rows_per_range=200, largest=134)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate" not in plan


def test_rollouts_are_derived_where_they_are_read(spark, folder, monkeypatch):
    from checks import base

    monkeypatch.setattr(base, "_STAGED", {})
    monkeypatch.setattr(base, "staged", lambda *a: pytest.fail("rows are written and read again"))
    df = base.rollouts(spark, folder)
    plan = df.select("uid", "pred")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and not base._STAGED
    monkeypatch.undo()
    staged = base.rollouts(spark, folder, indexed=True)
    assert df.dtypes == staged.drop("row_idx").dtypes
    assert sorted(df.collect()) == sorted(staged.drop("row_idx").collect())


def test_lines_that_tie_are_numbered_alike_whenever_derived(spark, tmp_path):
    from checks import base

    day = datetime.date(1995, 3, 1)
    lines = [(k, 1, 1, 1, 2.0, 100.0, 0.01 * (n % 5), 0.01 * (n % 9), "AR"[n % 2], "O", day) for k in (1, None) for n in range(90)]
    kinds = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
             "l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")
    spark.createDataFrame([(1, "p"), (None, "p")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = []
    for step in (1, -1):
        spark.createDataFrame(lines[::step], kinds).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        spark.catalog.clearCache()
        found.append(sorted(tuple(r) for r in base.rollouts(spark, str(tmp_path)).select("uid", "rollout_n", "score", "pred", "view_type").collect()))
    assert found[0] == found[1] and [r[1] for r in found[0]] == list(range(90))


def test_a_bound_on_groups_counts_them_only_where_a_bucket_is_large(spark, monkeypatch):
    df = spark.range(1000).selectExpr("nullif(id % 100, 7) as k")
    assert scale.largest_at_most(df, ["k"], 20, 100_000) == (10, 1000)
    largest, rows = scale.largest_at_most(df, ["k"], 1000, 1)
    assert (largest, rows) == (1000, 1000)
    # too many in the bucket, so the groups are counted
    assert scale.largest_at_most(df, ["k"], 20, 1) == (10, 1000)
    assert scale.largest_at_most(df.where("k < 0"), ["k"]) == (0, 0)


@pytest.mark.parametrize("ratio", [0.0002, 0.2, 5.0])
def test_dropped_tokens_are_found_from_sums_by_digits(spark, monkeypatch, ratio):
    import hashlib

    from rewardloom.operators import objective

    monkeypatch.setattr(objective, "nth_row", lambda *a: pytest.fail("all candidates are read once more to find one of them"))
    monkeypatch.setattr(objective, "ROWS_PER_RANGE", 16)
    rng = np.random.default_rng(5)
    rows = [("u", i % 40, *rng.normal(size=(3, 20)).tolist(), [1, 1, 0, 1] * 5) for i in range(50)]
    df = spark.createDataFrame(rows, "uid string, rollout_n int, logp array<double>, old_logp array<double>, advantages array<double>, mask array<int>")
    logp, old, adv, mask = (np.array([r[c] for r in rows]) for c in (2, 3, 4, 5))
    keys = np.array([[hashlib.md5(f"3|u|{r[1]}|{t}".encode()).hexdigest() for t in range(20)] for r in rows])
    gap, mean = logp - old, lambda x: (x * mask).sum() / mask.sum()
    plain, clipped = -adv * np.exp(gap), -adv * np.clip(np.exp(gap), 0.8, 1.2)
    spread = (adv - mean(adv)) * (logp - mean(logp))
    open_ = (mask > 0) & (clipped <= plain) & (spread < 5) & (spread > 0)
    edge = sorted(keys[open_])[:max(int(ratio * mask.sum()), 1)][-1]
    off = open_ & (keys <= edge)
    loss = np.where(off, 0.0, np.maximum(plain, clipped)) * mask
    by_row = {"token-mean": loss.sum() / mask.sum()}
    named = np.array([r[1] for r in rows])
    per = [(loss[named == n].sum(), mask[named == n].sum()) for n in range(40)]
    by_row["seq-mean-token-mean"] = np.mean([s / n for s, n in per])
    for mode, want in by_row.items():
        got = objective.loss_clip_cov(df, ratio=ratio, lower=0.0, seed=3, mode=mode).first()
        assert tuple(got) == pytest.approx((want, mean(off), mean(-gap)))


def test_small_groups_share_a_transfer(spark):
    from rewardloom.plans import registry

    rng = np.random.default_rng(2)
    rows = [(int(k) if k % 7 else None, "ab"[k % 2], None if k == 9 or x > 1 else float(x), int(9 * x)) for k, x in zip(rng.integers(0, 30, 400), rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "k long, s string, v double, i int")
    spread = lambda v: v.max() - v.min() + len(v) + float(v.index[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for value, at in (("v", 2), ("i", 3)):
            out = registry.group_reduce(df, ["s", "k"], spread, value, "spread")
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "MapInArrow" in plan and "Aggregate" not in plan
            want = {}
            for r in rows:
                want.setdefault((r[1], r[0]), []).append(r[at])
            got = {(r.s, r.k): r.spread for r in out.collect()}
            assert got.keys() == want.keys()
            for key, values in want.items():
                known = [v for v in values if v is not None]
                expected = max(known) - min(known) + 2 * len(values) - 1 if known else None
                assert got[key] == (expected if expected is None else pytest.approx(expected))
        # a group of texts goes to pandas whole
        assert {r.k: r.n for r in registry.group_reduce(df, ["k"], len, "s", "n").collect()} == {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_small_ranges_of_shards_share_tasks(spark, tmp_path):
    import io
    import tarfile

    from rewardloom.sources import tar

    for s in range(3):
        with tarfile.open(f"{tmp_path}/s{s}.tar", "w") as out:
            for i in range(40):
                for ext, payload in (("json", b'{"i": 1}'), ("txt", bytes(600))):
                    info = tarfile.TarInfo(f"{s}-{i}.{ext}")
                    info.size = len(payload)
                    out.addfile(info, io.BytesIO(payload))
    df = tar.scan_tar_samples(spark, str(tmp_path), split_bytes=2000)
    assert df.rdd.getNumPartitions() <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.collect()
    assert sorted(r.key for r in rows) == sorted(f"{s}-{i}" for s in range(3) for i in range(40))
    assert all(r.json == '{"i": 1}' and [len(f.payload) for f in r.files] == [600] for r in rows)


def test_packs_number_rows_before_they_have_tokens(spark, folder, monkeypatch):
    from checks import base, sequence
    from rewardloom.operators import batch

    seen = []
    real = batch.with_row_idx
    monkeypatch.setattr(batch, "with_row_idx", lambda df, *a: seen.append(df.dtypes) or real(df, *a))
    rows = sequence.fixed_packs(spark, folder).orderBy("row_idx").collect()
    assert len(seen) == 1 and not [t for _, t in seen[0] if t.startswith("array")]
    want = base.tokens(spark, folder, "mask", "entropy").orderBy("uid", "rollout_n").collect()
    assert [(r.row_idx, r.uid, r["mask"], r.entropy, r.pack_id) for r in rows] == [(i, w.uid, w["mask"], w.entropy, str(i // 8)) for i, w in enumerate(want)]
