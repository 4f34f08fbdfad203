"""Near-duplicate documents: b-bit minwise signatures and a multi-index Hamming join.

A signature is a row of minima of 8 or 16 bits, its symbols. It is cut into chunks; two signatures that differ
in fewer than twice as many symbols as there are chunks have a chunk with at most one differing symbol, so each
chunk is indexed once per allowed error: once for every symbol left out. All pairs within ``reach`` symbols share
an index key. Chunks follow from the threshold (``scheme``), so that a pair at exactly the threshold is farther apart
with a probability of ``MISS`` at most; at 0.85 it is 8e-5 (a pair at 0.9: 6e-8), at 0.80 5e-5.

Every link is confirmed on the full shingle sets. Documents of equal word sequence are one node from the
start, so a group of copies of any size costs one signature.
"""

from __future__ import annotations

from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import U64, constants, lowered, mix, run_hashes, small_batches, stored, text_slices, word_bounds, word_hashes
from rewardloom.llm.graph import Forest, components, star
from rewardloom.llm.tiles import by_tile, tiled

WIDTH = 5
MISS = 8.5e-5
CHUNKS, MOST_SYMBOLS = 12, 150
_SEQUENCE = constants(22, 2)


class Scheme(NamedTuple):
    """``chunks`` chunks of ``chunk`` symbols of ``bits`` bits."""

    chunks: int
    chunk: int
    bits: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk

    @property
    def reach(self) -> int:
        return 2 * self.chunks - 1

    @property
    def kind(self) -> type:
        return np.uint8 if self.bits == 8 else np.uint16

    def miss(self, similarity: float) -> float:
        """Probability that a pair of this similarity is beyond reach."""
        p, n = (1 - similarity) * (1 - 2.0**-self.bits), self.symbols
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(self.reach + 1, n + 1))


@cache
def scheme(percent: int) -> Scheme:
    """The scheme of a threshold: the longest chunks, so the rarest shared keys, that need no more than 100 symbols, else
    ``MOST_SYMBOLS``. A threshold that none of them serves is an error."""
    for most in (100, MOST_SYMBOLS):
        for chunk, bits in ((6, 8), (5, 8), (4, 16), (3, 16)):
            for chunks in range(CHUNKS, most // chunk + 1):
                if (found := Scheme(chunks, chunk, bits)).miss(percent / 100) <= MISS:
                    return found
    raise ValueError(f"no signature of {MOST_SYMBOLS} symbols finds pairs at {percent} percent")


def shingle_sets(column: pa.Array, width: int = WIDTH):
    """Per slice: first row, one digest pair per document of its words, and its sorted distinct shingle hashes.

    Fewer words than ``width`` make one shingle, no word none.
    """
    for lo, hi, data, at in text_slices(column):
        data = lowered(data)
        starts, ends, first = word_bounds(data, at)
        words = word_hashes(data, starts, ends)
        shingles, heads = run_hashes(words, first, width, 23)
        place = np.arange(len(words), dtype=U64) - np.repeat(first[:-1], np.diff(first)).astype(U64)
        digests = []
        for c in _SEQUENCE:
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words ^ mix(place * c + c)))])
            digests.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64)))
        sets = []
        for i in range(hi - lo):
            if heads[i + 1] > heads[i]:
                sets.append(np.unique(shingles[heads[i]: heads[i + 1]]))
            elif first[i + 1] > first[i]:
                sets.append(digests[0][i: i + 1])
            else:
                sets.append(np.empty(0, U64))
        yield lo, hi, digests, sets


def signatures(sets: list[np.ndarray], plan: Scheme) -> np.ndarray:
    """One row of symbols per non-empty set."""
    flat = np.concatenate(sets)
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), plan.symbols), plan.kind)
    for k, c in enumerate(constants(21, plan.symbols)):
        x = flat * c
        x ^= x >> U64(32)
        x *= U64(0xBF58476D1CE4E5B9)
        out[:, k] = (np.minimum.reduceat(x, heads) >> U64(20)).astype(plan.kind)
    return out


def _scan(plan: Scheme):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, digests, sets in shingle_sets(batch.column(1)):
                full = [i for i, s in enumerate(sets) if len(s)]
                marks: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], plan), strict=True):
                        marks[i] = row.tobytes()
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[0].view(np.int64)),
                     pa.array(digests[1].view(np.int64)), pa.array(marks, pa.binary())],
                    names=["doc_id", "n_shingles", "d0", "d1", "signature"],
                )

    return run


def index_keys(marks: np.ndarray, plan: Scheme) -> np.ndarray:
    """The keys of each signature: one per chunk and left-out symbol."""
    keys = np.empty((len(marks), plan.symbols), U64)
    wide = marks.astype(U64)
    for c in range(plan.chunks):
        for left_out in range(plan.chunk):
            x = np.full(len(marks), c * plan.chunk + left_out + 1, U64)
            for k in range(plan.chunk):
                if k != left_out:
                    x = (x << U64(plan.bits)) | wide[:, c * plan.chunk + k]
            keys[:, c * plan.chunk + left_out] = mix(x)
    return keys


def _marks(column: pa.Array, plan: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), plan.kind).reshape(-1, plan.symbols)


def _spread_keys(plan: Scheme):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = index_keys(_marks(part.column(1), plan), plan)
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), plan.symbols))], names=["key", "node"])

    return run


def _distance(marks: np.ndarray, i: int) -> np.ndarray:
    return np.count_nonzero(marks[i + 1:] != marks[i], axis=1)


def _near_marks(plan: Scheme):
    """Groups of signatures within reach of one another; columns key, tile, node, block, signature."""

    def look(table: pa.Table) -> dict[str, np.ndarray] | None:
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
        nodes = table.column("node").to_numpy()
        marks = _marks(table.column("signature"), plan)
        forest = Forest(len(nodes))
        for i in range(len(nodes) - 1):
            for j in (np.flatnonzero(_distance(marks, i) <= plan.reach) + i + 1).tolist():
                forest.join(i, j)
        return star(nodes, forest)

    return look


def _confirm(percent: int):
    """Check pairs within reach on their sets; columns family, tile, node, block, signature, set, known."""
    plan = scheme(percent)

    def look(table: pa.Table) -> dict[str, np.ndarray] | None:
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
        nodes, blocks, known = (table.column(c).to_numpy() for c in ("node", "block", "known"))
        marks = _marks(table.column("signature"), plan)
        sets = [np.frombuffer(x, U64) for x in table.column("set").to_pylist()]
        two = len(np.unique(blocks)) > 1  # a tile of two blocks has only the pairs across them left to do
        forest = Forest(len(nodes))
        firsts: dict[int, int] = {}
        for i, k in enumerate(known.tolist()):
            forest.join(i, firsts.setdefault(k, i))
        near = []
        for i in range(len(nodes) - 1):
            d = _distance(marks, i)
            fit = d <= plan.reach
            if two:
                fit &= blocks[i + 1:] != blocks[i]
            j = np.flatnonzero(fit)
            near.append(np.stack([d[j], np.full(len(j), i), j + i + 1]))
        near = np.concatenate(near, axis=1) if near else np.empty((3, 0), np.int64)
        for _, i, j in near[:, np.argsort(near[0], kind="stable")].T.tolist():  # likely links first: they spare checks
            if forest.root(i) == forest.root(j):
                continue
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                forest.join(i, j)
        return star(nodes, forest)

    return look


def _sets(plan: Scheme):
    """node, text to node, set, signature."""

    def run(batches):
        for batch in batches:
            for lo, _, _, sets in shingle_sets(batch.column(1)):
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                sets = [sets[i] for i in full]
                rows = batch.take(pa.array([lo + i for i in full]))
                yield pa.record_batch(
                    [rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([x.tobytes() for x in signatures(sets, plan)], pa.binary()), rows.column(2), rows.column(3)],
                    names=["node", "set", "signature", "family", "size"],
                )

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, side: int = 256) -> DataFrame:
    """Group documents (doc_id, text) whose shingle sets overlap by ``percent`` or more, directly or over others.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id). Null or wordless text links with nothing. A row without doc_id links with
    nothing, has a null component and is kept. Repeated rows of one doc_id share its component; other
    columns are not looked at. An empty table gives an empty one. Rows of one doc_id with different texts are linked over
    it. A threshold too low for any ``scheme`` is an error.
    """
    spark, plan = docs.sparkSession, scheme(percent)
    small_batches(spark)
    scanned = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_scan(plan), "doc_id long, n_shingles long, d0 long, d1 long, signature binary"), "signatures",
    )
    linked = scanned.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")

    # The two joins that grow with the documents are shuffle joins at every size, never a broadcast.
    # Index keys that at least two nodes share, then the pairs within reach among their members.
    keys = classes.select("node", "signature").mapInArrow(_spread_keys(plan), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keys.join(shared.hint("merge"), "key").join(classes.select("node", "signature"), "node")
    members = tiled(members, F.col("size"), F.xxhash64("node"), 4 * side).select("key", "tile", "node", "block", "signature")
    family = components(by_tile(members, "key", _near_marks(plan), "u long, v long"))
    family = stored(family.select("node", F.col("component").alias("family")), "families")

    # Full sets of the family members, then confirmation in tiles: first inside blocks, then across blocks.
    sizes = family.groupBy("family").agg(F.count("*").alias("size"))
    wanted = family.join(sizes, "family").select(F.col("node").alias("doc_id"), "family", "size")
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = first.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "family", "size")
    sets = stored(sets.mapInArrow(_sets(plan), "node long, set binary, signature binary, family long, size long"), "sets")
    columns = ["family", "tile", "node", "block", "signature", "set", "known"]
    inner = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / side).cast("long")))
    inner = inner.withColumns({"tile": F.col("block"), "known": F.col("node")}).select(*columns)
    links = stored(by_tile(inner, "family", _confirm(percent), "u long, v long"), "links")

    large = sets.where(F.col("size") > side)
    part = components(links)
    known = large.join(part, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
    # A component that fills blocks gets blocks of its own: between two of them nothing is left to do.
    whole = known.groupBy("family", "known").agg(F.count("*").alias("n")).where(F.col("n") > side)
    own = F.xxhash64("known", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / side).cast("long")))
    mixed = F.pmod(F.xxhash64("known"), F.ceil(F.col("size") / side).cast("long"))
    known = known.join(whole, ["family", "known"], "left").withColumn("block", F.when(F.col("n").isNotNull(), own).otherwise(mixed)).drop("n")
    known = stored(known, "known")
    spans = known.groupBy("family", "block").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    other = spans.select("family", F.col("block").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    todo = spans.join(other, "family").where("block <= b2 and not (low = high and low2 = high2 and low = low2)")
    todo = todo.select("family", "block", "b2", (F.xxhash64("block", "b2")).alias("tile"))
    places = todo.select("family", "block", "tile").union(todo.where("block != b2").select("family", "b2", "tile"))
    across = known.join(places, ["family", "block"]).select(*columns)
    more = by_tile(across, "family", _confirm(percent), "u long, v long")
    groups = components(links.union(more))

    labels = classes.select("d0", "d1", "node").join(groups, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    out = scanned.join(labels, ["d0", "d1"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id; all columns as they are.

    Of rows that agree in doc_id and text one stays. Different texts under one doc_id are documents of their own: one
    is compared under that id, the others come last in the order. Rows without doc_id all stay.
    """
    mark = F.xxhash64(F.col("text").cast("string"))
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), mark.alias("mark"), F.struct(*every).alias("row"))
    seen = stored(rows.where("id is not null").groupBy("id", "mark").agg(F.count("*").alias("n")), "marks")
    clash = stored(seen.groupBy("id").agg(F.min("mark").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "clashes")
    again = stored(seen.where("n > 1").select("id", "mark"), "repeats")
    own = F.xxhash64("id", "mark").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = rows.join(clash, "id", "left").withColumn("node", F.when(F.col("mark") != F.col("least"), own).otherwise(F.col("id").cast("long"))).drop("least")
    near = near_duplicates(rows.select(F.col("node").alias("doc_id"), "text"), percent)
    gone = near.where(~F.col("kept")).select(F.col("doc_id").alias("node")).distinct()
    left = rows.join(gone, "node", "left_anti").select("id", "mark", "row")
    once = left.join(again, ["id", "mark"], "left_anti").select("row.*")
    twice = left.join(again, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.union(twice.select("row.*"))
