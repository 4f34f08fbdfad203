"""Ranks and running totals must not depend on how the table is cut, hot keys included."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rewardloom.plans.scale import carry_forward, gather_lists, nth_row, rank_within, running_total, top_k, unit_draw, with_scalars


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of the rows belong to one key; values repeat.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100).alias("k"),
        (F.col("id") * 7919 % 50).cast("double").alias("v"), F.col("id"))
    return df


@pytest.mark.parametrize("limit", [10_000, 200, 37])
def test_rank_within_any_range_size(skewed, limit):
    out = rank_within(skewed, ["k"], ["v desc", "id"], "r", rows_per_range=limit).toPandas()
    expected = out.sort_values(["k", "v", "id"], ascending=[True, False, True]).groupby("k").cumcount()
    assert (out["r"].sort_index() == expected.sort_index()).all()
    assert len(out) == 3000


@pytest.mark.parametrize("limit", [10_000, 150])
def test_running_total_and_global_rank(skewed, limit):
    out = running_total(skewed, [], ["v", "id"], F.col("v"), "s", rows_per_range=limit).toPandas().sort_values(["v", "id"])
    assert (out["s"].to_numpy() == out["v"].cumsum().to_numpy()).all()


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), (None, 0)], "k string, i int")
    out = rank_within(df, ["k"], ["i"], "r", rows_per_range=1)
    assert sorted((r.i, r.r) for r in out.collect() if r.k is None) == [(0, 0), (1, 1), (2, 2)]


def test_gather_lists_segments_keep_every_item(skewed):
    out = gather_lists(skewed, ["k"], ["id"], F.col("id"), "items", limit=100).toPandas()
    assert out["items"].map(len).max() <= 100
    assert sorted(i for items in out["items"] for i in items) == list(range(3000))
    hot = out[out.k == 0].sort_values("segment")
    assert [i for items in hot["items"] for i in items] == sorted(i for items in hot["items"] for i in items)


def test_top_k_nth_row_and_scalars(skewed):
    best = top_k(skewed, ["k"], ["v desc", "id"], 2).toPandas()
    assert best.groupby("k").size().max() == 2
    ordered = skewed.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert nth_row(skewed, ["v desc", "id"], 17).first().id == ordered.iloc[16].id
    stats = skewed.agg(F.avg("v").alias("m"))
    row = with_scalars(skewed, stats).select(F.max(F.col("m")).alias("m"), F.min("m").alias("n")).first()
    assert row.m == row.n == stats.first().m


def test_unit_draw_is_uniform_and_repeatable(spark):
    u = spark.range(2000).select(unit_draw(3, "id").alias("u")).toPandas()["u"]
    again = spark.range(2000).select(unit_draw(3, "id").alias("u")).toPandas()["u"]
    assert (u == again).all() and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03
    assert pd.Series(u).nunique() == 2000


@pytest.mark.parametrize("kind", ["double", "string", "date", "boolean", "long", "timestamp"])
@pytest.mark.parametrize("direction", ["", " desc"])
def test_ranks_do_not_depend_on_the_range_size(spark, kind, direction):
    """Nulls, NaN and every sortable type, both ways, with one range and with many."""
    value = {
        "double": "case when id % 11 = 0 then null when id % 13 = 0 then double('NaN') else (id * 37) % 101 - 50.5D end",
        "string": "case when id % 11 = 0 then null else concat('k', (id * 37) % 101) end",
        "date": "case when id % 11 = 0 then null else date_add(date'2020-01-01', int((id * 37) % 101)) end",
        "boolean": "case when id % 11 = 0 then null else id % 3 = 0 end",
        "long": "case when id % 11 = 0 then null else (id * 37) % 101 - 50 end",
        "timestamp": "case when id % 11 = 0 then null else timestamp_micros(id * 37 % 101) end",
    }[kind]
    df = spark.range(400).selectExpr("id", f"{value} as v", "case when id % 5 = 0 then null else id % 3 end as g")
    for keys in ([], ["g"]):
        one, many = (
            {r.id: r.i for r in rank_within(df, keys, [f"v{direction}", "id"], "i", rows_per_range=n).collect()} for n in (10**9, 40)
        )
        assert one == many and len(one) == 400


def test_null_keys_are_a_group(spark):
    from rewardloom.operators import advantage, joins, reduce

    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 3.0), ("a", 2, 2.0), ("b", 3, 5.0), ("b", 4, 5.0)], "uid string, row_idx long, score double")
    sizes = {r.row_idx: (r.group_mean, r.group_size) for r in reduce.group_mean_std(df, "uid", "score").collect()}
    assert sizes == {0: (2.0, 2), 1: (2.0, 2), 2: (0.0, 1), 3: (5.0, 2), 4: (5.0, 2)}
    assert reduce.factorize(df, "uid").count() == 5
    assert {r.row_idx for r in advantage.group_filter(df).collect()} == {0, 1, 2}
    assert {r.row_idx for r in advantage.take_prompt_batch(df, 2).collect()} == {0, 1, 2}
    assert {r.row_idx for r in joins.keep_groups(df, df.where("row_idx = 0").select("uid")).collect()} == {0, 1}


def test_variance_far_from_zero(spark):
    from rewardloom.operators import reduce

    rows = [(i, [1e8 + 0.25 * ((i + k) % 3) for k in range(50)], [1] * 50) for i in range(200)]
    df = spark.createDataFrame(rows, "rollout_n long, v array<double>, mask array<int>")
    got = reduce.masked_var(df, "v").first()
    assert abs(got["var"] - 0.0625 * 2 / 3 * 10_000 / 9_999) < 1e-4


def test_first_rows_of_any_number(spark, monkeypatch):
    from rewardloom.plans import scale

    df = spark.range(500).selectExpr("id", "case when id % 9 = 0 then null else cast(id % 17 as string) end as v")
    want = [r.id for r in df.orderBy(F.col("v").desc(), "id").collect()]
    for limit in (100_000, 10):
        monkeypatch.setattr(scale, "DIRECT_LIMIT", limit)
        for n in (0, 1, 60, 500, 900):
            assert sorted(r.id for r in scale.first_rows(df, ["v desc", "id"], n).collect()) == sorted(want[:n])


def test_formats_are_found_and_arrow_is_read(spark, tmp_path):
    import pyarrow as pa

    from rewardloom.sources import files

    (tmp_path / "in" / "deep").mkdir(parents=True)
    rows = pa.table({"a": [1, None, 3], "b": ["x", "y", None]})
    with pa.ipc.new_file(str(tmp_path / "in" / "deep" / "p.arrow"), rows.schema) as out:
        out.write_table(rows)
    with pa.ipc.new_stream(str(tmp_path / "in" / "q.arrow"), rows.schema) as out:
        out.write_table(rows)
    assert files.detect_format(f"file://{tmp_path}/in") == "arrow"
    got = files.scan(spark, f"file://{tmp_path}/in", "b string, a long").collect()
    assert sorted((r.a is None, r.a or 0, r.b or "") for r in got) == sorted([(False, 1, "x"), (True, 0, "y"), (False, 3, "")] * 2)


def test_majority_with_null_answers(spark):
    from rewardloom.operators import evaluate

    rows = [("u", i, None if i % 3 else "a", float(i % 3 != 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "uid string, i long, pred string, score double")
    both = [evaluate.majority_bootstrap(df, ["uid"], "pred", "score", "i", draws=20, group_limit=n).orderBy("k").collect() for n in (4096, 8)]
    assert [(r.k, round(r.maj_mean, 9)) for r in both[0]] == [(r.k, round(r.maj_mean, 9)) for r in both[1]]


@pytest.mark.parametrize("rows_per_range", [5, 10_000])
def test_last_known_value_crosses_ranges(spark, rows_per_range):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(60), i, rng.choice([None, None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    for keys in ([], ["k"]):
        got = {r.i: r.last for r in carry_forward(df, keys, ["t", "i"], F.col("v"), "last", rows_per_range=rows_per_range).collect()}
        known = {}
        for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
            key = k if keys else 0
            known[key] = v if v is not None else known.get(key)
            assert got[i] == known[key]


@pytest.mark.parametrize("rows_per_range", [20, 100_000])
def test_exact_quantiles_of_hot_and_null_groups(spark, rows_per_range):
    from rewardloom.operators.reduce import exact_quantiles

    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, float(rng.randrange(9)), rng.random()])) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q0, r.q1) for r in exact_quantiles(df, "v", [0.5, 0.99], ["k"], rows_per_range).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    for key, group in values.items():
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[key], pd.Series(group).quantile([0.5, 0.99]), strict=True))
    assert len(got) == len(values)
    assert abs(exact_quantiles(df, "v", [0.9], rows_per_range=rows_per_range).first().q0 - pd.Series([v for _, v in rows]).quantile(0.9)) < 1e-12


def test_a_row_with_most_of_the_weight_is_drawn_by_blocks(spark, monkeypatch):
    from rewardloom.operators import advantage

    df = spark.range(3000).select(F.col("id").alias("row_idx"), F.when(F.col("id") == 700, 60.0).when(F.col("id") % 50 == 0, 5.0).otherwise(0.5).alias("score"), F.lit("x").alias("k"))
    want = {(r.draw, r.row_idx) for r in advantage.pf_ppo_resample(df, seed=3).collect()}
    for block in (7, 64, 10**6):
        monkeypatch.setattr(advantage, "CELLS_PER_BLOCK", block)
        assert {(r.draw, r.row_idx) for r in advantage.pf_ppo_resample(df, seed=3).collect()} == want
    assert len(want) == 3000 and sum(i == 700 for _, i in want) > 1200
