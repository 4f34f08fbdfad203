"""All pairs inside groups, in tiles of bounded size, without writing pairs.

A group of m rows is dealt into ceil(m / side) blocks and each pair of blocks is a tile: a row is copied
once per block of its own group, a tile holds at most about two blocks, and whatever looks at pairs
does so inside a tile. One large group thus becomes many tiles on many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(df: DataFrame, size: Column, order: Column, side: int) -> DataFrame:
    """Add ``tile`` (long) and ``block`` (int): ``size`` is the row count of the row's group, ``order`` a hash of the row."""
    blocks = F.ceil(size / F.lit(side)).cast("long")
    own = F.pmod(order, blocks)
    df = df.withColumns({"_n": blocks, "_own": own})
    tile = F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_n") - 1),
        lambda x: F.least(x, F.col("_own")) * F.col("_n") + F.greatest(x, F.col("_own")),
    ))
    return df.withColumn("tile", tile).withColumn("block", F.col("_own")).drop("_n", "_own")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``keys`` (integer) columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        edges = [0, *cuts.tolist(), n]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            k = tuple(key[:, lo].tolist())
            if k != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = k
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def by_tile(df: DataFrame, group: str, look: Callable[[pa.Table], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """Run ``look`` on every tile of ``df`` (columns group, tile, then any); it returns columns or None."""
    names = [part.split()[0] for part in schema.split(", ")]
    rest = [c for c in df.columns if c not in (group, "tile")]

    def walk(batches):
        held, rows = [], 0
        for table in runs(batches, 2):
            found = look(table)
            if found is not None and len(found[names[0]]):
                held.append(pa.record_batch([pa.array(found[n]) for n in names], names=names))
                rows += held[-1].num_rows
                if rows >= 10_000:
                    yield from held
                    held, rows = [], 0
        yield from held

    spread = df.select(group, "tile", *rest).repartition(F.col(group), F.col("tile"))
    return spread.sortWithinPartitions(group, "tile").mapInArrow(walk, schema)
