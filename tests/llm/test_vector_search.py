"""Nearest neighbours and hard negatives against all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rewardloom.llm import hard_negatives, nearest

KIND = "vec_id long, label int, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("rid", "q", "cluster", "score", "vector", "block", "a.b")})


def odd_rows():
    inf, nan = float("inf"), float("nan")
    return [(None, 1, [1.0] * 8), (100, 1, None), (200, 2, []), (300, 3, [0.0] * 8), (400, 4, [1.0] * 7 + [None]), (500, 5, [nan] * 8), (600, 6, [inf] + [1.0] * 7),
            (700, 1, [1.0, 2.0]), (701, 2, [2.0, 4.0]), (702, None, [1.0] * 8), (800, 1, [-0.0] * 7 + [1.0]), (801, 1, [0.0] * 7 + [1.0]), (900, 3, [5.0, 5.0, 5.0])]


def vectors(n, size=8, seed=4):
    """Clusters, one group of copies with a third of all rows, near copies and noise."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, size)) * 2
    copy = rng.standard_normal(size).tolist()
    rows = []
    for i in range(1000, 1000 + n):
        kind = i % 6
        if kind < 2:
            rows.append((i, int(rng.integers(4)), copy))
        elif kind == 2:
            rows.append((i, int(rng.integers(4)), (np.array(copy) + rng.standard_normal(size) * 1e-7).tolist()))
        else:
            rows.append((i, int(rng.integers(4)), (centre[kind] + rng.standard_normal(size) * 0.4).tolist()))
    rows += [rows[0], rows[0], (1003, 2, rows[5][2])]  # repeated rows, and an id with another vector
    return rows


def usable(v, zero=False):
    return v is not None and (len(v) > 0 or zero) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def distance(x, y):
    total = 0.0
    for p, q in zip(x, y, strict=True):  # not sum(), which corrects its rounding
        total += (p - q) * (p - q)
    return math.sqrt(total)


def nearest_by_hand(rows, k):
    rows = [(i, v) for i, _, v in rows if i is not None and usable(v)]
    out = []
    for a, (i, x) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((distance(x, y), j) for b, (j, y) in enumerate(rows) if b != a and len(y) == len(x))
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_equal_all_pairs(spark):
    rows = vectors(900) + odd_rows()
    got = sorted(map(tuple, nearest.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, block=64, chunk=3).collect()))
    want = nearest_by_hand(rows, 10)
    assert got == want


def test_nearest_of_wide_vectors_copies_only_and_few(spark):
    rng = np.random.default_rng(5)
    wide = [(i, 0, rng.standard_normal(67).tolist()) for i in range(400)]
    ask = lambda rows, **k: sorted(map(tuple, nearest.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, **k).collect()))
    assert ask(wide) == nearest_by_hand(wide, 10)
    same = [(i, 0, [1.0, 2.0, 3.0]) for i in range(300)]
    assert ask(same) == nearest_by_hand(same, 10)
    assert ask([]) == [] and ask([(100, 0, [1.0])]) == []
    large = [(i, 0, [1e200 * (i + 1), 1.0]) for i in range(105)]
    assert [(q, r, v) for q, r, v, _ in ask(large)] == [(q, r, v) for q, r, v, _ in nearest_by_hand(large, 10)]


def test_codes_leave_few_vectors_and_bounds_hold(spark):
    """The bounds lie below the true distances but for a share that the spread explains."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    batch = pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), pa.array([[i] for i in range(len(x))])], names=["vector", "ids"])
    coded = pa.Table.from_batches(list(nearest._encode({})([batch])))
    for spread, most in ((4.0, 0.001), (2.0, 0.04)):
        held = nearest._search(10, spread)(coded)
        query = rng.standard_normal(64)
        low = held.least(query, float(np.linalg.norm(query)))
        assert (low > nearest.exact(x, query) ** 2).mean() <= most


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(0, 70), st.integers(1, 70), st.integers(0, 9))
def test_strassen_is_exact(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
    assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_heaps_merge_like_a_sort():
    rng = np.random.default_rng(7)
    scores, ids = rng.integers(0, 6, (5, 90)), np.sort(rng.integers(0, 40, 90))
    heaps = hard_negatives.Heaps(5, 4)
    for part in np.array_split(rng.permutation(90), 7):
        part = np.sort(part)
        heaps.offer(scores[:, part].copy(), ids[part])
    for r in range(5):
        want = sorted(zip(-scores[r], ids, strict=True))[:4]
        assert list(zip(-heaps.score[r], heaps.id[r], strict=True)) == want


def negatives_by_hand(rows):
    rows = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows if i is not None and k is not None and usable(v, True)]
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, v) for i, k, v in rows]
    out = []
    for a, (i, label, x) in enumerate(rows):
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, k) for b, (j, k, y) in enumerate(rows) if b != a and len(y) == len(x)]
        for ps, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted(s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)
            out += [(i, j, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside[:3])]
    return sorted(out)


@pytest.mark.parametrize("layout", [{}, {"block": 4, "stripe": 16}])
def test_hard_negatives_equal_all_pairs(spark, layout, monkeypatch):
    if layout:
        monkeypatch.setattr(hard_negatives, "STRIPES", 1000)
    rows = vectors(700, 37) + odd_rows()
    frame = table(spark, rows).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, **layout)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    assert hard_negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0


def test_large_components_are_an_error(spark):
    rows = [(0, 1, [1e12, 1.0]), (1, 1, [1e12, 1.0])]
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") == 0).collect()
