"""Length-balanced partitions and micro-batches.

Largest differencing joins, again and again, the two splits with the largest spread. A batch is balanced by it in blocks: a
batch of one block (``BLOCK`` rows) is balanced as a whole; a larger one is dealt to blocks by falling work, each block reduces to one
split into k parts, and splits of blocks are joined by the same rule in rounds of ``FAN``, where a part is only a sum and the
number that its block gave it. So a task holds one block, or the sums of ``FAN`` splits, at every size, and equal sizes stay equal.

Least-loaded assignment follows the order of rows and cannot be cut: it streams over the sorted rows of a batch with k sums.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.operators.reduce import workload
from rewardloom.plans.scale import keyed_join, rank_within, run_edges, scan_in_order, with_group_stats
from rewardloom.session import ensure_checkpoint_dir

BLOCK = 65_536
FAN = 256
MAX_PARTS = 65_536

# A part of a split: its sum, how many items it holds, its first item (these three order parts), and its node in the tree of joins.
Part = tuple[float, int, int, int]


class _Joins:
    """Splits of items into k parts, heaviest part first; parts without items are left out."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.children: list[tuple[int, int]] = []
        self.leaves = items

    def _both(self, a: Part, b: Part) -> Part:
        self.children.append((a[3], b[3]))
        return a[0] + b[0], a[1] + b[1], a[2], self.leaves + len(self.children) - 1

    def join(self, a: list[Part], b: list[Part]) -> list[Part]:
        """Heaviest parts of one meet lightest parts of the other."""
        alone = max(self.k - len(b), 0)  # so many of a's heaviest meet nothing
        shared = max(len(a) - alone, 0)
        light = b[len(b) - shared:][::-1]
        met = [self._both(x, y) for x, y in zip(a[alone:], light, strict=True)]
        return sorted(a[:alone] + met + b[: len(b) - shared], key=lambda p: p[:3], reverse=True)

    def _rank(self, split: list[Part]) -> tuple:
        top = split[0]
        low = split[-1][0] if len(split) == self.k else 0.0
        return low - top[0], -top[0], -top[1], -top[2]

    def reduce(self, splits: list[list[Part]]) -> list[Part]:
        """Join the two splits with the largest spread (ties: the heaviest part) until one is left."""
        heap = [(*self._rank(s), n, s) for n, s in enumerate(splits) if s]
        heapq.heapify(heap)
        n = len(splits)
        while len(heap) > 1:
            first, second = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
            joined = self.join(first, second)
            n += 1
            heapq.heappush(heap, (*self._rank(joined), n, joined))
        return heap[0][-1] if heap else []

    def numbered(self, split: list[Part]) -> np.ndarray:
        """Number of the part that each leaf ended in."""
        out = np.zeros(self.leaves, np.int64)
        for number, part in enumerate(split):
            stack = [part[3]]
            while stack:
                node = stack.pop()
                if node < self.leaves:
                    out[node] = number
                else:
                    stack += self.children[node - self.leaves]
        return out


def largest_differencing(work: np.ndarray, k: int, equal_size: bool) -> np.ndarray:
    """Part of each item, heaviest part first; with ``equal_size`` each part gets as many items."""
    order = np.argsort(work, kind="stable").tolist()
    step = k if equal_size else 1
    if equal_size and len(work) % k:
        raise ValueError(f"{len(work)} items do not divide into {k} parts")
    joins = _Joins(len(work), k)
    value = np.asarray(work, np.float64).tolist()
    key = lambda p: p[:3]
    splits = [sorted(((value[i], 1, i, i) for i in order[at: at + step]), key=key, reverse=True) for at in range(0, len(order), step)]
    return joins.numbered(joins.reduce(splits))


def least_loaded(work: np.ndarray, k: int) -> np.ndarray:
    """Each item in order to the part with the least work so far."""
    return _LeastLoaded(k)(work)


class _LeastLoaded:
    def __init__(self, k: int):
        self.loads = [(0.0, p) for p in range(k)]

    def __call__(self, work: np.ndarray) -> np.ndarray:
        parts = np.zeros(len(work), np.int64)
        for i, w in enumerate(np.asarray(work, np.float64).tolist()):
            load, parts[i] = self.loads[0]
            heapq.heapreplace(self.loads, (load + w, int(parts[i])))
        return parts


def snake(df: DataFrame, k: Column | int, work: str, row: str, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Deal rows by falling work to k parts, turning at each end: sizes differ by at most one."""
    ranked = rank_within(df, list(by), [f"{work} desc", row], "__r", rows=rows)
    k = F.lit(k) if isinstance(k, int) else k
    place = F.col("__r") % k
    part = F.when(F.floor(F.col("__r") / k) % 2 == 0, place).otherwise(k - 1 - place)
    return ranked.withColumn("part", part.cast("long")).drop("__r")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, which lie together; a value's rows may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = sorted({e for c in range(keys) for e in run_edges(batch.column(c))})
        if held and not all(_same(held[-1].column(c)[-1].as_py(), batch.column(c)[0].as_py()) for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(at, end - at))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _differenced(items: DataFrame, batch: str, row: str, equal_size: bool, block: int) -> DataFrame:
    """(batch, row, part) of items (batch, row, __w, __k), where __k is one number per batch."""
    kinds = dict(items.dtypes)
    sizes = items.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max("__k").alias("k")).agg(F.max("n").alias("n"), F.max("k").alias("k")).first()
    if (sizes.k or 0) > MAX_PARTS:
        raise ValueError(f"{sizes.k} parts of one batch; at most {MAX_PARTS} are supported")
    blocks = 1
    if (sizes.n or 0) > block:
        ranked = with_group_stats(rank_within(items, [batch], ["__w desc", row], "__r"), [batch], F.count(F.lit(1)).alias("__n"))
        wide = F.greatest(F.lit(block), F.col("__k"))
        # whole runs of k neighbours stay together, so a block holds equally many rows per part
        items = ranked.withColumn("__block", F.floor(F.col("__r") / F.col("__k")) % F.ceil(F.col("__n") / wide)).drop("__r", "__n")
        blocks = math.ceil(sizes.n / block)
    else:
        items = items.withColumn("__block", F.lit(0).cast("long"))
    schema = f"`{batch}` {kinds[batch]}, __block long, `{row}` {kinds[row]}, __w double, __k long"

    def split(batches):
        for block in _runs(batches, 2):
            part = largest_differencing(block.column(3).to_numpy(), block.column(4)[0].as_py(), equal_size)
            yield from block.append_column("part", pa.array(part)).to_batches()

    items = items.select(batch, "__block", row, "__w", "__k").repartition(F.col(f"`{batch}`"), F.col("__block"))
    parts = items.sortWithinPartitions(F.col(f"`{batch}`"), "__block", F.col(f"`{row}`")).mapInArrow(split, f"{schema}, part long")
    if blocks > 1:
        ensure_checkpoint_dir(items.sparkSession)
        parts = parts.checkpoint()
    while blocks > 1:
        parts, blocks = _joined_blocks(parts, batch, kinds[batch]), math.ceil(blocks / FAN)
    return parts.select(batch, row, "part")


def _joined_blocks(parts: DataFrame, batch: str, kind: str) -> DataFrame:
    """Join the splits of up to FAN blocks; items follow their part by its new number."""
    sums = parts.groupBy(batch, "__block", "part").agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("__k").alias("__k"))
    sums = sums.withColumn("__next", F.floor(F.col("__block") / FAN))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__block", "part"], kind="stable").reset_index(drop=True)
        joins = _Joins(len(pdf), int(pdf["__k"].iloc[0]))
        part = list(zip(pdf["w"].tolist(), pdf["n"].tolist(), range(len(pdf)), range(len(pdf)), strict=True))
        splits = [sorted((part[i] for i in rows), key=lambda p: p[:3], reverse=True) for rows in pdf.groupby("__block").indices.values()]
        return pdf.assign(to=joins.numbered(joins.reduce(splits)))[[batch, "__block", "part", "__next", "to"]]

    moved = sums.groupBy(batch, "__next").applyInPandas(join, f"`{batch}` {kind}, __block long, part long, __next long, to long")
    out = keyed_join(parts, moved, [batch, "__block", "part"]).drop("__block", "part")
    return out.withColumnsRenamed({"__next": "__block", "to": "part"}).checkpoint()


def balance_partitions(df: DataFrame, batch: str, row: str, work: str, k: int, equal_size: bool = True, block: int = BLOCK) -> DataFrame:
    """(batch, row, part): every row of every batch in one of k parts of nearly equal work, by largest differencing.

    ``row`` is unique in its batch; a null batch is a batch. With ``equal_size`` each part gets as many rows, and a batch that does not
    divide is an error.
    """
    items = df.select(batch, row, F.col(work).cast("double").alias("__w"), F.lit(k).cast("long").alias("__k"))
    return _differenced(items, batch, row, equal_size, block)


def balance_greedy(df: DataFrame, batch: str, row: str, work: str, k: int) -> DataFrame:
    """Least-loaded assignment in row order: one pass over a batch's rows, with k sums as all that is held."""
    items = df.select(batch, row, F.col(work).cast("double").alias("__w"))

    def start():
        assign = _LeastLoaded(k)
        return lambda rows: assign(rows.column("__w").to_numpy(zero_copy_only=False))

    return scan_in_order(items, batch, [row], start, "part long").select(batch, row, "part")


def balance_groups(df: DataFrame, batch: str, uid: str, length: str, k: int, equal_size: bool = True, block: int = BLOCK) -> DataFrame:
    """Rows with ``part``; a group is never split and, when asked, each part gets the same number of groups.

    Rows without batch or uid form a batch or a group like any other.
    """
    groups = df.groupBy(batch, uid).agg(F.sum(workload(F.col(length))).alias("__work"))
    parts = balance_partitions(groups, batch, uid, "__work", k, equal_size, block)
    return keyed_join(df, parts, [batch, uid])


def order_inside_part(df: DataFrame, by: Sequence[str], length: str, row: str, out: str = "place") -> DataFrame:
    """Rising lengths at even ranks, then the odd ranks backwards: short rows at both ends."""
    ranked = rank_within(df, list(by), [length, row], "__r")
    sized = with_group_stats(ranked, list(by), F.count(F.lit(1)).alias("__n"))
    half = F.floor(F.col("__r") / 2)
    place = F.when(F.col("__r") % 2 == 0, half).otherwise(F.col("__n") - 1 - half)
    return sized.withColumn(out, place.cast("long")).drop("__r", "__n")


def micro_batches(
    df: DataFrame, batch: str, row: str, length: str, max_tokens: int, divisor: int = 1, min_count: int = 1,
    together: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """(batch, row, part): as many micro-batches as the token budget asks for, balanced by work, small ones at both ends.

    Batches with the same ``together`` (such as those of one step on parallel workers) get the same number, the largest asked
    for among them. A row longer than the budget, and a batch with fewer rows than micro-batches, are errors.
    """
    groups = [batch] if together is None else [together, batch]
    per_batch = df.groupBy(*groups).agg(F.sum(length).alias("__tokens"), F.count(F.lit(1)).alias("__rows"), F.max(length).alias("__longest"))
    count = F.greatest(F.lit(min_count), F.least(F.col("__rows"), F.ceil(F.col("__tokens") / max_tokens)))
    if together is not None:
        count = F.max(count).over(Window.partitionBy(together))
    per_batch = per_batch.withColumn("__k", (F.ceil(count / divisor) * divisor).cast("long"))
    number = lambda c: F.col(c).cast("string")
    too_long = F.raise_error(F.concat(F.lit("a row of "), number("__longest"), F.lit(f" tokens exceeds the budget of {max_tokens}")))
    too_few = F.raise_error(F.concat(number("__rows"), F.lit(" rows cannot fill "), number("__k"), F.lit(" micro-batches")))
    checked = F.when(F.col("__longest") > max_tokens, too_long.cast("long")).when(F.col("__k") > F.col("__rows"), too_few.cast("long")).otherwise(F.col("__k"))
    counts = per_batch.select(batch, checked.alias("__k"))
    items = df.select(batch, row, workload(F.col(length)).cast("double").alias("__w"))
    items = keyed_join(items, counts, [batch])
    parts = _differenced(items, batch, row, False, block)
    sums = keyed_join(parts, items, [batch, row]).groupBy(batch, "part").agg(F.sum("__w").alias("w"), F.min(row).alias("first"), F.max("__k").alias("k"))
    falling = F.row_number().over(Window.partitionBy(batch).orderBy(F.col("w").desc(), F.col("first").desc())) - 1
    half, even = F.floor(F.col("r") / 2), F.ceil(F.col("k") / 2)
    place = F.when(F.col("r") % 2 == 0, even - 1 - half).otherwise(even + half)
    placed = sums.withColumn("r", falling).select(batch, "part", place.cast("long").alias("__place"))
    return keyed_join(parts, placed, [batch, "part"]).select(batch, row, F.col("__place").alias("part"))
