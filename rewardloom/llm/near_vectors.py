"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

A table's key are the sides of ``bits`` hyperplanes; ``bits`` grows with the logarithm of the number of vectors,
and the number of tables is what a pair exactly at the threshold needs to meet in one of them with a probability of
``recall``. Members of a key are compared in tiles of bounded size. The links found give the components;
inside a component all pairs are then compared once more, again in tiles, which counts every link and writes
no pair. Equal vectors are one node with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import U64, constants, mix, small_batches, stored
from rewardloom.llm.graph import Forest, components, star
from rewardloom.llm.tiles import by_tile, tiled

SEED = 20
_FOLD = constants(41, 2)


def plan(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hyperplanes per table and tables."""
    bits = max(4, math.ceil(math.log2(max(vectors, 2))))
    same = 1 - math.acos(threshold) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same ** bits))
    return bits, tables


def _scan(batches):
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        n = len(column)
        at = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        d0, vectors = [None] * n, [None] * n
        for i in range(n):
            x = values[at[i]: at[i + 1]]
            if not valid[i] or not len(x) or not np.isfinite(x).all():
                continue
            scale = np.abs(x).max()
            if scale == 0:
                continue
            unit = x / scale
            unit /= np.linalg.norm(unit)
            words = (x + 0.0).view(U64)  # + 0.0: no negative zero
            place = mix(np.arange(1, len(x) + 1, dtype=U64) * _FOLD[1])
            d0[i] = int(mix(mix(words ^ place).sum(keepdims=True) + _FOLD[0] * U64(len(x))).view(np.int64)[0])
            vectors[i] = unit.tobytes()
        yield pa.record_batch([ids, pa.array(d0, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "node", "vector"])


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _by_dimension(nodes: pa.Array, vectors: pa.Array):
    sizes = np.array([len(v) for v in vectors.to_pylist()])
    for size in np.unique(sizes).tolist():
        rows = pa.array(np.flatnonzero(sizes == size))
        yield nodes.take(rows).to_numpy(), _stack(vectors.take(rows))


def _spread(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                for nodes, x in _by_dimension(part.column(0), part.column(1)):
                    size = x.shape[1]
                    if size not in planes:
                        planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))
                    side = (x @ planes[size] > 0).reshape(len(x), tables, bits)
                    keys = np.zeros((len(x), tables), U64)
                    for b in range(bits):  # more than 64 planes fold into the hash
                        keys = (mix(keys) if b % 64 == 0 else keys) * U64(2) + side[:, :, b]
                    keys = mix(keys ^ mix(np.arange(1, tables + 1, dtype=U64) * _FOLD[0] + U64(size)))
                    yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes, tables))], names=["key", "node"])

    return run


def _pairs(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in ascending order, their rows in ``table``, and the matrix of links; across blocks only, where there are two."""
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    nodes, blocks = table.column("node").to_numpy(), table.column("block").to_numpy()
    vectors = table.column("vector").combine_chunks()
    sizes = np.array([len(v) for v in vectors.to_pylist()])
    near = np.zeros((len(nodes), len(nodes)), bool)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        x = _stack(vectors.take(pa.array(rows)))
        near[np.ix_(rows, rows)] = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if len(np.unique(blocks)) > 1:
        near &= blocks[:, None] != blocks[None, :]
    return nodes, order, near


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9999, side: int = 512) -> DataFrame:
    """Link vectors (vec_id, embedding) whose cosine is ``threshold`` or more.

    Returns one row per row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable), kept (vec_id = component_id). Null, empty or zero vectors and those with null or non-finite
    components link with nothing; vectors of different length neither. A row without vec_id has no links, a null
    component and is kept. Repeated rows count as vectors of their own; other columns are not looked at.
    """
    small_batches(vectors.sparkSession)
    arrays = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    scanned = stored(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(arrays, F.array().cast("array<double>")).alias("embedding"))
        .mapInArrow(_scan, "vec_id long, node long, vector binary"), "vectors",
    )
    linked = scanned.where("node is not null and vec_id is not null")
    classes = stored(linked.groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight")), "classes")
    bits, tables = plan(classes.count(), threshold, recall)

    keys = classes.select("node", "vector").mapInArrow(_spread(bits, tables), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keys.join(shared, "key").join(classes.select("node", "vector"), "node")
    members = tiled(members, F.col("size"), F.xxhash64("node"), side).select("key", "tile", "node", "block", "vector")

    def link(table: pa.Table):
        nodes, _, near = _pairs(table, threshold)
        forest = Forest(len(nodes))
        for i, j in np.argwhere(np.triu(near)).tolist():
            forest.join(i, j)
        return star(nodes, forest)

    groups = stored(components(by_tile(members, "key", link, "u long, v long")), "groups")

    def count(table: pa.Table):
        nodes, order, near = _pairs(table, threshold)
        weight = table.column("weight").to_numpy()[order]
        return {"node": nodes, "n": (near * weight[None, :]).sum(1)}

    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    inside = groups.join(sizes, "component").join(classes, "node")
    inside = tiled(inside, F.col("size"), F.xxhash64("node"), side).select("component", "tile", "node", "block", "vector", "weight")
    links = by_tile(inside, "component", count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))

    rows = linked.select("vec_id", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_node = classes.select("node", "weight").join(links, "node", "left").join(groups, "node", "left")
    per_node = per_node.withColumn("component", F.coalesce("component", "node")).join(least, "component")
    per_node = per_node.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = scanned.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node")).join(per_node, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
