"""Hard negatives by exact integer scores: Strassen products of tiles, mergeable heaps of positives and of windows.

Components become integers, so scores are exact. Anchors are dealt into blocks and rows into stripes; a task holds one
block and lets one stripe pass by in batches, multiplies each batch by Strassen's recursion and keeps the best few
entries per anchor. Such heaps merge: what tasks return is merged by a window over a few rows per anchor and stripe.
The first pass meets anchors with rows of their label only and gives the positives; they set each anchor's windows,
and the second pass meets anchors with all rows and fills the windows from other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import small_batches, stored
from rewardloom.plans.blocks import matrix, meet, tasks

LEAF = 16
NONE = -(1 << 62)
LARGEST = 1 << 56
STRIPES = 64
LEAST_STRIPE = 8192
ANCHORS = 1024


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Exact product of two int64 matrices: seven half-size products per level instead of eight.

    Both are padded with zeros to a multiple of the number of cuts; sums wrap modulo 2**64, which cancels out.
    """
    (m, k), n = a.shape, b.shape[1]
    levels = 0
    while min(m, k, n) >> (levels + 1) >= leaf:
        levels += 1
    if not levels:
        return a @ b
    up = lambda x: -(-x >> levels) << levels
    wide = np.zeros((up(m), up(k)), np.int64)
    wide[:m, :k] = a
    tall = np.zeros((up(k), up(n)), np.int64)
    tall[:k, :n] = b
    return _recurse(wide, tall, levels)[:m, :n]


def _recurse(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p = lambda x, y: _recurse(x, y, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    diagonal, across = p(a11 + a22, b11 + b22), p(a21 + a22, b11)
    left, right = p(a11, b12 - b22), p(a22, b21 - b11)
    over = p(a11 + a12, b22)
    out[:m, :n] = diagonal + right - over + p(a12 - a22, b21 + b22)
    out[:m, n:] = left + over
    out[m:, :n] = across + right
    out[m:, n:] = diagonal - across + left + p(a21 - a11, b11 + b12)
    return out


class Heaps:
    """The ``k`` best entries of each row: higher scores first, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.score = np.full((rows, k), NONE, np.int64)
        self.id = np.full((rows, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge a matrix of scores (NONE: not offered; overwritten) whose columns have rising ids."""
        rows, k = self.score.shape
        at = np.arange(rows)
        found = []
        for _ in range(k):
            best = scores.argmax(1)  # the first of equal ones: the smallest id
            value = scores[at, best]
            if not (value >= self.score[:, -1]).any() or (value == NONE).all():
                break
            found.append((value, ids[best]))
            scores[at, best] = NONE
        if found:
            score = np.hstack([self.score, *[v[:, None] for v, _ in found]])
            name = np.hstack([self.id, *[i[:, None] for _, i in found]])
            order = np.lexsort((name, -score), axis=1)[:, :k]
            self.score, self.id = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)


class _Anchors:
    """A block of anchors and the batches that pass by it."""

    def __init__(self, held: pa.Table):
        self.rid = held.column("rid").to_numpy()
        self.label = held.column("label").to_numpy()
        self.ints = matrix(held.column("ints"))
        self.peak = int(np.abs(self.ints).max(initial=0))

    def scores(self, rows: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
        """Scores of anchors (rows) and the batch (columns), whose ids rise."""
        rows = rows.take(pa.array(np.argsort(rows.column("vec_id").to_numpy(), kind="stable")))
        ints = matrix(rows.column("ints"))
        if self.peak * int(np.abs(ints).max(initial=0)) * ints.shape[1] >= LARGEST:
            raise ValueError(f"components are too large: scores may reach {LARGEST}")
        return strassen(self.ints, np.ascontiguousarray(ints.T)), rows

    @staticmethod
    def rows(heaps: list[Heaps], rid: np.ndarray) -> pa.RecordBatch:
        score = np.stack([h.score for h in heaps])
        slot, row, _ = found = np.nonzero(score != NONE)
        columns = [rid[row], slot.astype(np.int32), score[found], np.stack([h.id for h in heaps])[found]]
        return pa.record_batch([pa.array(c) for c in columns], names=["rid", "slot", "score", "vec_id"])


def _positive_heaps(k: int):
    class Positives(_Anchors):
        def __init__(self, held: pa.Table):
            super().__init__(held)
            self.best = Heaps(len(self.rid), k)

        def take(self, rows):
            scores, rows = self.scores(rows)
            scores[self.rid[:, None] == rows.column("rid").to_numpy()[None, :]] = NONE  # an anchor is not its own positive
            self.best.offer(scores, rows.column("vec_id").to_numpy())
            return iter(())

        def done(self):
            yield self.rows([self.best], self.rid)

    return Positives


def _window_heaps(slots: int, k: int, low: int, high: int):
    class Windows(_Anchors):
        def __init__(self, held: pa.Table):
            super().__init__(held)
            given = held.column("positive_scores").to_pylist()
            positive = np.array([[x[s] if s < len(x) else -1 for s in range(slots)] for x in given], np.int64).reshape(len(given), slots)
            # low * positive <= 100 * score <= high * positive; of a negative positive score no score is both, so -1 closes a slot
            self.least, self.most = -(-low * positive // 100), high * positive // 100
            self.best = [Heaps(len(self.rid), k) for _ in range(slots)]

        def take(self, rows):
            scores, rows = self.scores(rows)
            scores[self.label[:, None] == rows.column("label").to_numpy()[None, :]] = NONE
            ids = rows.column("vec_id").to_numpy()
            for heaps, least, most in zip(self.best, self.least.T, self.most.T, strict=True):
                inside = (scores >= least[:, None]) & (scores <= most[:, None])
                some = np.flatnonzero(inside.any(1))
                if len(some):
                    part = Heaps(0, k)
                    part.score, part.id = heaps.score[some], heaps.id[some]
                    part.offer(np.where(inside[some], scores[some], NONE), ids)
                    heaps.score[some], heaps.id[some] = part.score, part.id
            return iter(())

        def done(self):
            yield self.rows(self.best, self.rid)

    return Windows


def _scan(scale: int):
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            at = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                ints = np.clip(np.floor(scale * values), NONE, -NONE)
            ints = pa.ListArray.from_arrays(column.offsets, pa.array(np.where(np.isnan(ints), 0, ints).astype(np.int64)))
            keep = pa.array(keep)
            out = [batch.column(c).filter(keep) for c in ("rid", "vec_id", "label", "anchor")]
            yield pa.record_batch([*out, pa.array(np.diff(at)[keep.to_numpy(zero_copy_only=False)].astype(np.int32)), ints.filter(keep)],
                                  names=["rid", "vec_id", "label", "anchor", "dim", "ints"])

    return run


def _dealt(anchors: DataFrame, rows: DataFrame, keys: list[str], block: int, stripe: int | None) -> tuple[DataFrame, DataFrame]:
    """Anchors by block, once per stripe, and rows by stripe, once per block, inside each group of ``keys``."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("m")).where("m > 0")
    wide = F.greatest(F.lit(stripe or LEAST_STRIPE), F.ceil(F.col("n") / STRIPES))
    sizes = sizes.select(*keys, F.ceil(F.col("m") / block).cast("long").alias("blocks"), F.ceil(F.col("n") / wide).cast("long").alias("stripes"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    held = anchors.join(sizes, keys).withColumn("block", own("blocks")).withColumn("stripe", every("stripes"))
    passing = rows.select("rid", "vec_id", "label", "dim", "ints").join(sizes, keys)
    passing = passing.withColumn("stripe", own("stripes")).withColumn("block", every("blocks"))
    return held.drop("blocks", "stripes"), passing.drop("blocks", "stripes")


def hard_negatives(
    vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block: int = ANCHORS, stripe: int | None = None,
) -> DataFrame:
    """For each row (vec_id, label, embedding) where ``anchor`` holds and each of its best positives, the best rows of other labels in a window.

    A component x counts as floor(scale * x), a score is the inner product of two rows; higher scores come first, ties by
    smaller vec_id. Positives are the first ``positives`` other rows of the anchor's label, negatives the first ``negatives``
    rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score; nothing for a positive with an empty window.

    Rows without vec_id, label or vector, and those with null or non-finite components take no part. Only rows of equal
    length meet; an empty vector scores 0. Repeated rows are rows of their own, an anchor is left out of its own positives only. Scores
    that may reach 2**56 are an error. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    given = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("embedding"),
    ).where("vec_id is not null and label is not null and embedding is not null")
    schema = "rid long, vec_id long, label long, anchor boolean, dim int, ints array<long>"
    rows = stored(given.mapInArrow(_scan(scale), schema), "integers")
    anchors = rows.where("anchor").select("rid", "label", "dim", "ints")
    parts = tasks(spark, 1 << 30)
    heap = "rid long, slot int, score long, vec_id long"

    held, passing = _dealt(anchors, rows, ["dim", "label"], block, stripe)
    same_label = meet(held, passing.drop("anchor"), ["dim", "label", "block", "stripe"], parts, _positive_heaps(positives), heap)
    best_first = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    chosen = same_label.withColumn("place", F.row_number().over(best_first("rid"))).where(F.col("place") <= positives)
    chosen = stored(chosen.select("rid", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    scores = chosen.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("l"))
    windows = anchors.join(scores.select("rid", F.col("l.positive_score").alias("positive_scores")), "rid")
    held, passing = _dealt(windows, rows, ["dim"], block, stripe)
    met = meet(held, passing, ["dim", "block", "stripe"], parts, _window_heaps(positives, negatives, low, high), heap)
    found = met.withColumn("rank", F.row_number().over(best_first("rid", "slot"))).where(F.col("rank") <= negatives)
    names = rows.where("anchor").select("rid", F.col("vec_id").alias("anchor_id"))
    out = found.select("rid", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["rid", "slot"])
    return out.join(names, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
