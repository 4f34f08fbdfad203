"""What the operators share: tables in the shared folder, bounded slices of text, word hashes.

Text is handled as the bytes of an Arrow string column. A slice holds whole documents, about
``SLICE_BYTES`` of them at a time; one longer document makes a slice of its own, so memory follows
the longest document and not the partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rewardloom.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20
U64 = np.uint64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The tables hold much text, and stretches of it that overlap: the denser codec is worth its time.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def rows_and_text(docs: DataFrame) -> DataFrame:
    """(row, text): the whole row as one struct, so that no column of the user meets one of ours, and its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))


def beside_row(docs: DataFrame, added: str) -> StructType:
    """The schema of ``row`` and the ``added`` columns (``name type, ...``)."""
    return StructType([StructField("row", docs.schema), *StructType.fromDDL(added).fields])


def columns_of_row(docs: DataFrame, *but: str) -> list[Column]:
    """The columns of ``docs`` out of ``row``, without those named."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c not in but]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size: rows of text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` of a string column with their bytes and offsets into them; null is empty."""
    column = pc.fill_null(column, "")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, rows + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one entry more than documents)."""
    inside = ~_SPACE[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.zeros(len(data) + 1, bool)  # a document begins here
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd multipliers that follow from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTES = constants(11, 256)
_BASE = int(constants(12, 1)[0])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n - 1).bit_length() if n > 1 else 0)
    if size not in _POWERS:
        _POWERS.clear()
        steps = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, U64)
            x[0] = 1
            steps.append(np.multiply.accumulate(x))
        _POWERS[size] = (steps[0], steps[1])
    return _POWERS[size]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, read off from running sums."""
    if not len(starts):
        return np.empty(0, U64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def run_hashes(words: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside documents, and each document's first run (one entry more)."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    heads = np.concatenate([[0], np.cumsum(counts)])
    n = max(len(words) - width + 1, 0)
    x = np.zeros(n, U64)
    for k, c in enumerate(constants(seed, width)):
        x += words[k: k + n] * c
    if n:
        keep = np.ones(n, bool)  # runs that would cross into the next document go
        for k in range(1, width):
            cut = first[1:-1] - k
            keep[cut[(cut >= 0) & (cut < n)]] = False
        # a short document's cuts may lie before its own first word: those runs cross an edge as well
        x = x[keep]
    return mix(x), heads
