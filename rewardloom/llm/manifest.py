"""A Merkle manifest of a dataset and a proof per row, by pointer jumping.

Leaves are hashed where the rows lie and sorted by (lang, doc_id) in ranges; a row's index is its place in its range plus the
counts of earlier ranges. Trees are built in blocks of 1024 neighbours, ten levels per pass. Each node then points to
its parent and holds the sibling it needs on the way (its segment). One self-join doubles the distance of all
pointers and concatenates the segments; after ceil(log2(depth)) of them every leaf points to the root and its segment is its
proof. Nodes whose pointer nobody will follow any more are left out as levels double, so all rounds but the first move little
more than one row per leaf.

Trees of languages end at different heights: a root of a lower one is passed on, without hashing, to the level at which the tree
over the roots begins.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import small_batches, stored
from rewardloom.llm.tiles import runs
from rewardloom.plans.blocks import tasks
from rewardloom.plans.scale import keyed_join, rank_within

SPAN = 10
TOP = -1
STEP_BYTES = 33
SMALL_BYTES = 8 << 20
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"  # what a node is in its run; a sibling follows unless it is alone


def row_digest(*values: Column) -> Column:
    """sha256 over the fields in turn: ``-`` for null, else the length in bytes, a colon and the value."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(v.cast("string")) for v in values]), 256))


def _joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _climb(base: int):
    """Up to SPAN levels above a block of neighbours: a step per node, then the node that is left."""

    def run(batches):
        held: dict[str, list] = {c: [] for c in ("tree", "level", "idx", "n", "step", "digest")}

        def add(*values):
            for column, value in zip(held.values(), values, strict=True):
                column.append(value)

        def out():
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(held.values(), kinds, strict=True)], names=list(held))
            for column in held.values():
                column.clear()
            return batch

        for table in runs(batches, 2):
            tree, first, n = table.column("tree")[0].as_py(), table.column("idx")[0].as_py(), table.column("n")[0].as_py()
            nodes = table.column("digest").to_pylist()
            level = 0
            while level < SPAN and n > 1:
                for i, _ in enumerate(nodes):
                    other = i ^ 1
                    step = ALONE if other >= len(nodes) else (LEFT if other > i else RIGHT) + nodes[other]
                    add(tree, base + level, first + i, n, step, None)
                nodes = [_joined(nodes[i: i + 2]) for i in range(0, len(nodes), 2)]
                first, n, level = first >> 1, (n + 1) >> 1, level + 1
            add(tree, base + level, first, n, None, nodes[0])
            if len(held["tree"]) >= 8192:
                yield out()
        yield out()

    return run


def _height(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _build(nodes: DataFrame, base: int, height: int, rows: int, trees: int, name: str) -> tuple[DataFrame, DataFrame]:
    """All trees over nodes (tree, idx, n, digest) that lie at level ``base``: steps (tree, level, idx, step) and roots (tree, digest)."""
    schema = "tree long, level int, idx long, n long, step binary, digest binary"
    steps, roots = [], []
    for up in range(base, base + max(height, 1), SPAN):
        blocks = nodes.select("tree", F.shiftright("idx", SPAN).alias("block"), "idx", "n", "digest")
        rows = (rows >> SPAN) + trees
        parts = tasks(nodes.sparkSession, rows)  # a task per block of neighbours at the most
        done = blocks.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(_climb(up), schema)
        done = stored(done, f"{name}-{up}")
        steps.append(done.where("step is not null").select("tree", "level", "idx", "step"))
        left = done.where("digest is not null")
        roots.append(left.where("n = 1").select("tree", "digest"))
        nodes = left.where("n > 1").select("tree", "idx", "n", "digest")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(steps), union(roots)


def _jump(pointers: DataFrame, depth: int) -> DataFrame:
    """Pointers of leaves to the root with all segments: each round doubles the distance."""
    distance = 1
    while distance < depth:
        target = pointers.where(F.col("level") % (2 * distance) == distance)
        target = target.select(*[F.col(c).alias(f"t_{c}") for c in pointers.columns])
        if target.count() * (STEP_BYTES * distance + 48) <= SMALL_BYTES:  # else a shuffle join, whose keys have few nodes each
            target = F.broadcast(target)
        here = pointers.where(F.col("level") % (2 * distance) == 0)
        met = here.join(target, [F.col("up_tree") == F.col("t_tree"), F.col("up_level") == F.col("t_level"), F.col("up_idx") == F.col("t_idx")], "left")
        further = lambda c: F.coalesce(f"t_{c}", c).alias(c)
        segment = F.concat("segment", F.coalesce("t_segment", F.lit(b""))).alias("segment")
        pointers = stored(met.select("tree", "level", "idx", further("up_tree"), further("up_level"), further("up_idx"), segment), f"jump-{distance}")
        distance *= 2
    return pointers.where("level = 0").select("tree", "idx", "segment")


def _fold(root: bytes):
    def run(batches):
        for batch in batches:
            proofs, ends = [], []
            for digest, changed, segment in zip(*(batch.column(c).to_pylist() for c in ("leaf", "altered", "segment")), strict=True):
                now, at, siblings = changed if changed is not None else digest, 0, []
                while at < len(segment):
                    side = segment[at: at + 1]
                    if side == ALONE:
                        now, at = _joined([now]), at + 1
                        continue
                    other = segment[at + 1: at + STEP_BYTES]
                    siblings.append(other)
                    now, at = _joined([now, other] if side == LEFT else [other, now]), at + STEP_BYTES
                proofs.append(_joined(siblings).hex())
                ends.append(now.hex())
            text = lambda c, b=batch: pa.array([x.hex() for x in b.column(c).to_pylist()])
            count = batch.num_rows
            yield pa.record_batch(
                [batch.column("doc_id"), text("leaf"), text("subroot"), pa.array([root.hex()] * count, pa.string()), pa.array(proofs, pa.string()),
                 pa.array(ends, pa.string()), pa.array([e == root.hex() for e in ends], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return run


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, roots and proof of every row (doc_id, source, lang, n_chars, text), checked against the row as it is now.

    Rows of one lang form a tree in the order of doc_id (null first, then rows of one doc_id by digest), null being a lang of its own;
    the trees' roots, by lang (null first), form the tree above. Returns doc_id, leaf, subroot, root, proof_sha256 (the digest
    over the siblings from the leaf up), folded_root (the root that the row's own digest and its proof give) and verified (whether
    it is the root). ``tampered`` marks rows whose n_chars is one more when they are checked. Nulls in any column are hashed as
    nulls; repeated rows are leaves of their own; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tampered = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    digest = lambda n_chars: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    hashed = docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), F.when(tampered, digest(F.col("n_chars") + 1)).alias("altered"))
    order = ["lang", "doc_id", "leaf", "salt"]  # the salt spreads repeated rows, which are alike
    ranged = stored(hashed, "leaves").withColumn("salt", F.rand(11)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = ranged.sortWithinPartitions(*order).drop("salt")
    leaves = stored(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "sorted")

    counts = leaves.groupBy("part", "lang").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and lang
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    trees = rank_within(leaves.groupBy("lang").agg(F.count("*").alias("n")), [], ["lang"], "tree")
    trees = stored(trees, "trees")
    spans = stored(keyed_join(counts, trees, ["lang"]), "spans")
    placed = keyed_join(leaves, spans, ["part", "lang"]).withColumn("idx", F.col("base") + F.col("place") - F.col("first"))

    size = trees.agg(F.max(_height(F.col("n"))).alias("height"), F.count("*").alias("trees"), F.sum("n").alias("rows")).first()
    if not size.trees:
        return docs.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified")).limit(0)
    begin = max(size.height, 1)  # the level of the subroots
    height = (size.trees - 1).bit_length()
    steps, subroots = _build(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")), 0, size.height, size.rows, size.trees, "tree")
    subroots = stored(subroots, "subroots")
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size.trees).cast("long").alias("n"), "digest")
    top_steps, roots = _build(top, begin, height, size.trees, 1, "top")
    root = bytes(roots.first().digest)

    passed = trees.withColumn("height", _height(F.col("n"))).where(F.col("height") < begin)
    passed = passed.select("tree", F.explode(F.sequence(F.col("height"), F.lit(begin - 1))).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(b"").alias("step"))
    above = F.col("level") + 1
    pointers = steps.unionByName(passed).unionByName(top_steps).select(
        "tree", "level", "idx", F.when(above >= begin, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"), above.alias("up_level"),
        F.when((above == begin) & (F.col("tree") != TOP), F.col("tree")).otherwise(F.shiftright("idx", 1)).alias("up_idx"), F.col("step").alias("segment"))
    proofs = _jump(stored(pointers, "jump-0"), begin + height)

    known = stored(spans.join(subroots.withColumnRenamed("digest", "subroot"), "tree"), "known")
    rows = keyed_join(leaves, known, ["part", "lang"]).withColumn("idx", F.col("base") + F.col("place") - F.col("first"))
    rows = rows.join(proofs, ["tree", "idx"]).select("doc_id", "leaf", "altered", "subroot", "segment")
    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(_fold(root), f"doc_id {dict(docs.dtypes)['doc_id']}, {names}")
