"""Packing documents into sequences by fitting length patterns to the histogram of lengths.

Only the histogram (one count per possible length) reaches the driver. There, patterns of a few lengths that
fill a sequence exactly are enumerated, their repeat counts are fitted by non-negative least squares, rounded
down, and what is left is packed largest first, again as repeated patterns. A pattern's repeats claim runs
of ranks within each length, so every piece finds its place from its rank alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import small_batches, stored
from rewardloom.llm.tokens import encoder

CAPACITY = 4096
RANKED_ROWS = 10_000  # rows of one length that are ranked together


def enumerate_patterns(present: np.ndarray, capacity: int, documents: int = 7, choices: int = 6) -> list[dict[int, int]]:
    """Patterns of at most ``documents`` present lengths that fill ``capacity`` exactly."""
    held = np.zeros(capacity + 1, bool)
    held[present] = True
    found: dict[tuple[int, ...], None] = {}
    for a in present[::-1].tolist():
        for m in range(1, documents + 1):
            rest = capacity - a
            if m == 1 or rest == 0:
                if m == 1 and rest == 0:
                    found[(a,)] = None
                continue
            near = int(np.searchsorted(present, rest / (m - 1)))
            for shift in range(choices if m > 2 else 1):
                parts, left = [a], rest
                for k in range(m - 2):
                    b = int(present[min(max(near + (shift + k) * (-1) ** (shift + k), 0), len(present) - 1)])
                    parts.append(b)
                    left -= b
                if 0 < left <= capacity and held[left]:
                    found[tuple(sorted([*parts, left], reverse=True))] = None
    return [dict(zip(*(x.tolist() for x in np.unique(p, return_counts=True)), strict=True)) for p in found]


def fit_repeats(patterns: list[dict[int, int]], counts: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares of patterns times repeats against the histogram, by coordinate descent."""
    left = counts.astype(float)
    x = np.zeros(len(patterns))
    terms = [(list(p), list(p.values()), sum(v * v for v in p.values())) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for i, (rows, times, norm) in enumerate(terms):
            step = sum(t * left[r] for r, t in zip(rows, times, strict=True)) / norm
            step = max(step, -x[i])
            if step:
                x[i] += step
                for r, t in zip(rows, times, strict=True):
                    left[r] -= t * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to times) and their repeats that use up ``counts`` (by length, from 0 to capacity)."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], repeats: int) -> None:
        repeats = min([repeats, *(int(left[n]) // t for n, t in pattern.items())])
        if repeats > 0:
            out.append((pattern, repeats))
            for n, t in pattern.items():
                left[n] -= t * repeats

    present = np.flatnonzero(left)
    if len(present):
        patterns = enumerate_patterns(present, capacity)
        repeats = fit_repeats(patterns, left)
        for i in np.argsort(-repeats, kind="stable").tolist():
            use(patterns[i], int(repeats[i]))
    while len(present := np.flatnonzero(left)):
        first = int(present[-1])
        pattern, room = {first: 1}, capacity - first
        while room:
            free = present[: np.searchsorted(present, room, "right")][::-1]
            best = next((int(n) for n in free[:64] if left[n] > pattern.get(int(n), 0)), None)
            if best is None:
                best = next((int(n) for n in free[64:] if left[n] > pattern.get(int(n), 0)), None)
            if best is None:
                break
            times = min(room // best, int(left[best]) - pattern.get(best, 0))
            pattern[best] = pattern.get(best, 0) + times
            room -= best * times
        use(pattern, 1 << 62)
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Per run of ranks: length, first rank, documents of that length per sequence, first sequence, first offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            times = pattern[n]
            rows.append((n, ranks.get(n, 0), times, sequence, offset))
            ranks[n] = ranks.get(n, 0) + times * repeats
            offset += n * times
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode each text (null: empty), append the end id, cut what is longer than ``capacity``."""

    def scan(batches):
        encode = encoder(path, spaced=False).ids
        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or "").astype("<u4"), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at: at + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    a piece of one end id; repeated rows and rows without doc_id are packed like any other; further columns
    are not looked at; an empty table gives no piece.
    """
    small_batches(docs.sparkSession)
    pieces = stored(token_pieces(docs, path, end_id, capacity), "pieces")
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row per length, capacity at most
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    length, lo, times, sequence, offset = slots(plan(counts, capacity))
    place = length * (int(counts.sum()) + 1) + lo  # sorted: runs by length, then rank

    # Rank within the length: rank within a salted part plus the sizes of the parts before it.
    parts = max(1, int(counts.sum()) // RANKED_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("length", "salt", before.alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", rank).join(ahead, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ahead") - 1).alias("rank"))
    total = int(counts.sum()) + 1

    def assign(batches):
        for batch in batches:
            n, r = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(place, n * total + r, "right") - 1
            step = r - lo[k]
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence[k] + step // times[k]), pa.array(offset[k] + step % times[k] * n)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
