"""Connected components of a table of links, without a node's links ever meeting in one task.

Each round first shrinks every partition to a spanning forest of its own links, then runs a large-star
and a small-star step: minima per node are partial aggregates, and the joins that bring them back are
plain shuffle joins that adaptive execution splits where a node is hot. A round is written to the
shared folder; rounds end when every node points straight to a root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import stored


class Forest:
    """Union-find over the rows 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def star(nodes: np.ndarray, forest: Forest) -> dict[str, np.ndarray] | None:
    """Links from the members of each tree to its smallest node, for ``nodes`` in ascending order.

    Tiles that find the same group then report the same links, which fold into one.
    """
    roots = np.fromiter((forest.root(x) for x in range(len(nodes))), np.int64, len(nodes))
    moved = nodes[roots] != nodes
    return {"u": nodes[moved], "v": nodes[roots[moved]]} if moved.any() else None


_FOLD_ROWS = 400_000


def _shrink(batches):
    """Links of one partition to (node, smallest node of its tree), in blocks of bounded size."""

    def fold(blocks):
        u = np.concatenate([b[0] for b in blocks])
        v = np.concatenate([b[1] for b in blocks])
        nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(index[: len(u)].tolist(), index[len(u):].tolist(), strict=True):
            forest.join(x, y)
        roots = np.fromiter((forest.root(x) for x in range(len(nodes))), np.int64, len(nodes))
        moved = roots != np.arange(len(nodes))
        return nodes[moved], nodes[roots[moved]]

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= _FOLD_ROWS:
            u, v = fold(held)
            if len(u) > _FOLD_ROWS // 2:  # little to shrink: pass it on
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                held, rows = [], 0
            else:
                held, rows = [(u, v)], len(u)
    if held:
        u, v = fold(held)
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _is_star(now: DataFrame) -> bool:
    """Every node points to one smaller node that points nowhere."""
    roles = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(now.select("v", F.lit(0)))
    roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return roles.where("up > 1 or (up = 1 and low = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links`` has two long columns, any order, repeats and self-links allowed, nulls left out.

    Returns (node, component) for every node that has a link to another one; the component is the
    smallest node reachable.
    """
    a, b = links.columns[:2]
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    now = stored(pairs.distinct().mapInArrow(_shrink, "u long, v long"), "links")
    while not _is_star(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(low.select("u", "m")).mapInArrow(_shrink, "u long, v long").distinct(), "links")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select("component", "component").distinct())
