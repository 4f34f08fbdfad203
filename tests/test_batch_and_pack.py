"""Batch algebra literals, balancing and packing invariants against brute force."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rewardloom.operators import balance as K
from rewardloom.operators import batch as B
from rewardloom.operators import pack as P
from rewardloom.operators import sequence as Q


@pytest.fixture(scope="module")
def small(spark):
    return B.from_columns(spark, {"obs": [1, 2, 3, 4, 5, 6], "labels": list("abcdef")}, "obs int, labels string")


def ordered(df, column):
    return [r[column] for r in df.orderBy("row_idx").collect()]


def test_chunk_and_concat(small):
    with pytest.raises(ValueError):
        B.chunk(small, 5)
    parts = B.split_dataset(small, 2)
    assert ordered(parts[0], "obs") == [1, 2, 3] and ordered(parts[1], "obs") == [4, 5, 6]
    assert ordered(B.concat(parts), "labels") == list("abcdef")


@pytest.mark.parametrize("divisor,expected", [(2, "abca"), (3, "abc"), (7, "abcabca")])
def test_padding_repeats_the_head(spark, divisor, expected):
    df = B.from_columns(spark, {"obs": [[1, 2], [3, 4], [5, 6]], "labels": list("abc")}, "obs array<int>, labels string")
    padded = B.pad_to_divisor(df, divisor)
    assert "".join(ordered(padded, "labels")) == expected
    assert "".join(ordered(B.unpad(padded), "labels")) == "abc"


@pytest.mark.parametrize("times,expected", [([3, 1, 2], "aaabcc"), ([1, 2, 3], "abbccc"), ([0, 0, 1], "c")])
def test_sample_level_repeat(spark, times, expected):
    df = B.from_columns(spark, {"labels": list("abc"), "times": times}, "labels string, times int")
    assert "".join(ordered(B.sample_level_repeat(df, "times"), "labels")) == expected


def test_slice_like_python(small):
    values = [1, 2, 3, 4, 5, 6]
    for bounds in [(1, 4, 1), (None, None, 2), (-3, None, 1), (None, -2, 1), (None, None, -1), (5, 1, -2), (4, 2, 1)]:
        assert ordered(B.slice_rows(small, *bounds), "obs") == values[slice(*bounds)]


def test_union_detects_conflicts(small):
    same = small.select("row_idx", "obs", (F.col("obs") * 2).alias("twice"))
    assert ordered(B.union(small, same), "twice") == [2, 4, 6, 8, 10, 12]
    with pytest.raises(Exception, match="differ"):
        B.union(small, small.select("row_idx", (F.col("obs") + 1).alias("obs"))).collect()
    with pytest.raises(ValueError):
        B.union_meta({"a": 1}, {"a": 2})


def test_concat_fills_missing_columns(small):
    short = small.select("row_idx", "labels")
    assert ordered(B.concat([small, short]), "obs") == [1, 2, 3, 4, 5, 6] + [0] * 6


def test_unfold_column_chunks(spark):
    df = B.from_columns(spark, {"a": [[1, 2, 3, 4], [5, 6, 7, 8]], "b": [[1, 2], [3, 4]]}, "a array<int>, b array<int>")
    out = B.unfold_column_chunks(df, 2, ["a"])
    assert ordered(out, "a") == [[1, 2], [3, 4], [5, 6], [7, 8]] and ordered(out, "b") == [[1, 2], [1, 2], [3, 4], [3, 4]]


def test_largest_differencing_covers_and_balances():
    rng = np.random.default_rng(0)
    for n, k in ((64, 4), (128, 8), (30, 5)):
        work = rng.integers(10, 1000, n).astype(float)
        equal = K.largest_differencing(work, k, True)
        assert (np.bincount(equal, minlength=k) == n // k).all()
        free = np.bincount(K.largest_differencing(work, k, False), weights=work, minlength=k)
        assert free.max() - free.min() <= work.max() and abs(free.sum() - work.sum()) < 1e-9
    with pytest.raises(ValueError):
        K.largest_differencing(np.ones(5), 2, True)


def differencing_by_hand(work, k, equal):
    """Sets ordered by (sum, size, items), states by spread and then by their largest set; plain lists throughout."""
    rows = sorted((w, i) for i, w in enumerate(work))
    step = k if equal else 1
    key = lambda s: (s[0], len(s[1]), s[1])
    states = []
    for at in range(0, len(rows), step):
        sets = [(w, [i]) for w, i in rows[at: at + step]]
        states.append(sorted(sets + [(0, [])] * (k - len(sets)), key=key, reverse=True))
    while len(states) > 1:
        states.sort(key=lambda s: (s[0][0] - s[-1][0], key(s[0])), reverse=True)
        a, b, *states = states
        states.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)), key=key, reverse=True))
    out = [0] * len(work)
    for part, (_, items) in enumerate(states[0] if states else []):
        for i in items:
            out[i] = part
    return out


@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 9), st.booleans())
def test_largest_differencing_equals_plain_lists(work, k, equal):
    work = work[: len(work) // k * k] if equal else work
    assert K.largest_differencing(np.array(work), k, equal).tolist() == differencing_by_hand(work, k, equal)


@pytest.mark.parametrize("fan", [256, 2])
def test_a_batch_of_many_blocks_is_balanced(spark, fan, monkeypatch):
    monkeypatch.setattr(K, "FAN", fan)
    df = spark.range(1000).select(F.when(F.col("id") >= 0, F.lit(None)).cast("int").alias("batch"), F.col("id").alias("row"), (F.col("id") * 7919 % 1013 + 1).alias("w"))
    for equal in (True, False):
        out = K.balance_partitions(df, "batch", "row", "w", 8, equal, block=100).join(df.drop("batch"), "row")
        sizes = out.groupBy("part").agg(F.count("*").alias("n"), F.sum("w").alias("w")).toPandas()
        assert sizes["n"].sum() == 1000 and len(sizes) == 8 and sizes["w"].max() - sizes["w"].min() <= 60
        assert not equal or sizes["n"].tolist() == [125] * 8


def test_null_groups_and_batches_are_kept(spark):
    rows = [(b, u, 10 + i) for i, (b, u) in enumerate([(0, 1), (0, 1), (0, None), (0, None), (None, 5), (None, 5), (None, None), (None, None)])]
    df = spark.createDataFrame(rows, "batch int, uid int, len int")
    out = K.balance_groups(df, "batch", "uid", "len", 2).toPandas()
    assert len(out) == 8 and sorted(out["part"]) == [0, 0, 0, 0, 1, 1, 1, 1]


def test_micro_batch_rules(spark):
    df = spark.createDataFrame([(g, b, i, n) for g, b, lens in ((1, 0, [30] * 9), (1, 1, [10] * 9), (2, 2, [10] * 9)) for i, n in enumerate(lens)], "step int, batch int, row int, len int")
    count = lambda d, **k: {r.batch: r.n for r in K.micro_batches(d, "batch", "row", "len", 60, **k).groupBy("batch").agg(F.countDistinct("part").alias("n")).collect()}
    assert count(df) == {0: 5, 1: 2, 2: 2}
    assert count(df, together="step", divisor=3) == {0: 6, 1: 6, 2: 3}
    assert count(df, min_count=4) == {0: 5, 1: 4, 2: 4}
    for bad, message in ((df.withColumn("len", F.lit(61)), "exceeds"), (df.where("row < 3"), "cannot fill")):
        with pytest.raises(Exception, match=message):
            K.micro_batches(bad, "batch", "row", "len", 60, min_count=1 if message == "exceeds" else 5).collect()


def test_groups_stay_whole(spark):
    lens = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4
    df = spark.createDataFrame([(0, i // 4, n) for i, n in enumerate(lens)], "batch int, uid int, len int")
    out = K.balance_groups(df, "batch", "uid", "len", 2).toPandas()
    assert len(out) == 16 and (out.groupby("uid")["part"].nunique() == 1).all() and (out.groupby("part")["uid"].nunique() == 2).all()


def test_micro_batches_respect_the_count(spark):
    df = spark.createDataFrame([(0, i, 50 + i) for i in range(20)], "batch int, row int, len int")
    out = K.micro_batches(df, "batch", "row", "len", 300).toPandas()
    assert sorted(out["row"]) == list(range(20)) and out["part"].nunique() == -(-sum(50 + i for i in range(20)) // 300)


def test_next_fit_and_first_fit_brute_force():
    rng = np.random.default_rng(4)
    lens = rng.integers(1, 60, 300)
    packs = P.first_fit(lens, 100, 10)
    sums = np.bincount(packs, weights=lens)
    assert sums.max() <= 100 and sums.sum() == lens.sum()
    # Brute force with explicit packs per batch.
    expected, batch, base = [], [], 0
    for n in lens:
        for i, total in enumerate(batch):
            if total + n <= 100:
                batch[i] += n
                expected.append(base + i)
                break
        else:
            if len(batch) >= 10:
                base, batch = base + len(batch), []
            batch.append(n)
            expected.append(base + len(batch) - 1)
    assert packs.tolist() == expected
    nf = P.next_fit(np.sort(lens), rng.integers(0, 2, 300).astype(bool), np.zeros(300), 100, 3, 10)
    assert np.bincount(nf, weights=np.sort(lens)).max() <= 100 and (np.diff(nf) >= 0).all()


def next_fit_by_hand(rows, max_len, max_images, max_tokens):
    packs, pack, used, images, tokens = [], 0, 0, 0, 0
    for i, (n, flag, tok) in enumerate(rows):
        if i and (used + n > max_len or (flag and images >= max_images) or tokens + tok > max_tokens):
            pack, used, images, tokens = pack + 1, 0, 0, 0
        packs.append(pack)
        used, images, tokens = used + n, images + flag, tokens + tok
    return packs


ITEMS = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 1), st.integers(0, 9)), max_size=40)


@given(ITEMS, st.integers(1, 45), st.integers(0, 3), st.integers(0, 20))
def test_next_fit_equals_one_pass(rows, max_len, max_images, max_tokens):
    n, f, t = ([r[c] for r in rows] for c in range(3))
    assert P.next_fit(n, f, t, max_len, max_images, max_tokens).tolist() == next_fit_by_hand(rows, max_len, max_images, max_tokens)


@pytest.mark.parametrize("segment_rows", [7, 50, 10**6])
@pytest.mark.parametrize("limits", [(60, 2, 25), (1000, 100, 10**6), (5, 0, 3)])
def test_packs_do_not_depend_on_segments(spark, segment_rows, limits):
    rng = np.random.default_rng(9)
    rows = [(s, i, int(n), int(f), int(t)) for s in ("a", "b", None) for i, (n, f, t) in enumerate(zip(rng.integers(0, 30, 160), rng.integers(0, 2, 160), rng.integers(0, 9, 160), strict=True))]
    df = spark.createDataFrame(rows, "shard string, row int, len int, img int, tok int")
    out = P.pack_sorted(df, "shard", "row", "len", limits[0], F.col("img") == 1, F.col("tok"), limits[1], limits[2], segment_rows=segment_rows)
    got = {(r.shard, r.row): int(r.pack_id.rsplit("-", 1)[-1]) for r in out.collect()}
    assert len(got) == 480
    for s in ("a", "b", None):
        own = sorted((r[2], r[1], r[3], r[4]) for r in rows if r[0] == s)
        want = next_fit_by_hand([(n, f, t) for n, _, f, t in own], *limits)
        assert [got[s, r] for _, r, _, _ in own] == want


def test_first_fit_streams_over_batches(spark):
    rng = np.random.default_rng(10)
    rows = [(s, i, int(n)) for s in ("a", None) for i, n in enumerate(rng.integers(0, 60, 700))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = P.pack_first_fit(spark.createDataFrame(rows, "shard string, row int, len int"), "shard", "row", "len", 100, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in ("a", None):
        want = P.first_fit([r[2] for r in rows if r[0] == s], 100, 10).tolist()
        assert [int(r.pack_id.rsplit("-", 1)[-1]) for r in sorted((r for r in out if r.shard == s), key=lambda r: r.place)] == want


def test_packing_in_segments_keeps_every_row(spark):
    df = spark.range(500).select(F.lit("s").alias("shard"), F.col("id").alias("row"), (F.col("id") % 40 + 1).alias("len"))
    out = P.pack_sorted(df, "shard", "row", "len", 100, segment_rows=64).join(df, ["shard", "row"])
    packs = out.groupBy("pack_id").agg(F.sum("len").alias("t")).toPandas()
    assert out.count() == 500 and packs["t"].max() <= 100


def test_packs_restart_positions(spark):
    rows = [("p", 0, 7, [1, 2, 3], [0, 1, 1]), ("p", 1, 9, [4, 5], [1, 1])]
    df = spark.createDataFrame(rows, "pack_id string, place int, row_idx int, ids array<int>, mask array<int>")
    r = P.build_packs(df, "ids", "mask", "row_idx", 6).first()
    assert (r.cu_seqlens, r.input_ids, r.position_ids) == ([0, 3, 5], [1, 2, 3, 4, 5, 0], [0, 1, 2, 0, 1, 0])


def test_marker_mask_needs_an_end(spark):
    rows = [(0, [1, 9, 8, 5, 6, 7, 9, 8, 5]), (1, [9, 8, 7]), (2, [9, 8, 3, 7, 2, 9, 8, 4, 4, 7])]
    df = spark.createDataFrame(rows, "id int, ids array<int>")
    got = {r.id: r.m for r in df.select("id", Q.marker_loss_mask("ids", 9, 8, 7).alias("m")).collect()}
    assert got == {0: [0, 0, 0, 1, 1, 1, 0, 0, 0], 1: [0, 0, 0], 2: [0, 0, 1, 1, 0, 0, 0, 1, 1, 1]}
