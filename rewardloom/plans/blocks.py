"""Stored blocks meet streamed rows: the rows of one side are held per key, those of the other pass by in batches.

Both sides are dealt by the same keys; a task keeps one block of the held side and never more than one batch of
the other, so a search of some rows against all rows needs neither pairs nor a side on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS_PER_PARTITION = 4


class Meeting(Protocol):
    """What happens to one key: batches of the streamed side come in, rows go out then or at the end."""

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def done(self) -> Iterator[pa.RecordBatch]: ...


def tasks(spark: SparkSession, wanted: int) -> int:
    """Partitions for heavy work on little data, which adaptive execution would merge by bytes."""
    return max(1, min(wanted, TASKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def alike(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of batches whose rows agree in the first ``keys`` (integer) columns."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), n]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(key[:, lo].tolist()), batch.slice(lo, hi - lo)


def meet(held: DataFrame, streamed: DataFrame, keys: list[str], parts: int, begin: Callable[[pa.Table], Meeting], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """Run a Meeting per value of ``keys`` (integers, never null) that both sides have; ``begin`` gets the held rows.

    ``order`` names columns in whose order rows come within a key and side.
    """
    both = held.withColumn("kind", F.lit(0)).unionByName(streamed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "kind")]

    def walk(batches):
        last, rows, meeting = None, [], None
        for (*key, kind), part in alike(batches, len(keys) + 1):
            if key != last:
                if meeting is not None:
                    yield from meeting.done()
                last, rows, meeting = key, [], None
            if kind == 0:
                rows.append(part)
                continue
            if meeting is None:
                if not rows:
                    continue
                meeting, rows = begin(pa.Table.from_batches(rows)), []
            yield from meeting.take(part)
        if meeting is not None:
            yield from meeting.done()

    return both.select(*keys, "kind", *rest).repartition(parts, *keys).sortWithinPartitions(*keys, "kind", *order).mapInArrow(walk, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length from a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) and len(values) else np.zeros((len(column), 0), values.dtype)
