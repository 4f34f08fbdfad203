"""Nearest neighbours by Euclidean distance from randomly rotated one-bit codes with error bounds.

Every vector belongs to the nearest of some centroids (fitted on a bounded sample) and is kept as the signs of its
rotated difference from that centroid, packed into bits, with three correction scalars. Inner products with a query are
estimated from the bits: each byte of a code looks up the sum of its eight signed query components. The estimate
of an inner product has a known spread; its bound turns into a lower bound of the distance, and only vectors whose lower
bound lies within the k-th best distance so far are compared exactly.

A query first visits the clusters around it, which bounds its k-th distance, and then every other cluster whose centroid
and radius allow a nearer vector. So no cluster is left out by a cap: only the bounds of the codes may miss, each true
neighbour with the chance that a normal deviate exceeds ``spread`` (3e-5 for 4). Clusters are dealt in blocks, and queries in
chunks, so a cluster with a third of all rows is work for many tasks. Equal vectors are one entry with its smallest ids.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import small_batches, stored
from rewardloom.plans.blocks import meet, tasks

SEED = 12
MAX_CENTROIDS = 4096
MAX_CENTROID_NUMBERS = 1 << 20
SAMPLE_PER_CENTROID = 16
ROUNDS = 6
SLACK = 1e-6
ROUNDING = 1e-12
FEWEST = 256

Centroids = dict[int, np.ndarray]


@functools.lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


@functools.lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """Row b: the signs that the bits of byte b stand for."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0


def fit_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """k-means in a few rounds on a bounded sample."""
    rng = np.random.default_rng([SEED, 1])
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = to_centroids(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centres))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def to_centroids(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centroids."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
        return np.sqrt(np.maximum(np.nan_to_num(squares, nan=np.inf, posinf=np.inf), 0))


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _same_length(batch: pa.RecordBatch, column: str = "vector"):
    """Parts of a batch whose vectors are equally long, with that length."""
    sizes = np.array([len(v) // 8 for v in batch.column(column).to_pylist()])
    for size in np.unique(sizes).tolist():
        yield size, batch.take(pa.array(np.flatnonzero(sizes == size)))


def _scan(batches):
    for batch in batches:
        ids, query, column = batch.column("vec_id"), batch.column("query"), batch.column("embedding")
        at = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero: equal vectors have equal bytes
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        rows = [values[at[i]: at[i + 1]] for i in range(len(column))]
        keep = [bool(v and np.isfinite(x).all() and x.any()) for v, x in zip(valid, rows, strict=True)]
        mask = pa.array(keep, pa.bool_())
        vectors = pa.array([x.tobytes() for x, k in zip(rows, keep, strict=True) if k], pa.binary())
        yield pa.record_batch([ids.filter(mask), query.filter(mask), vectors], names=["vec_id", "query", "vector"])


def _encode(centroids: Centroids):
    def run(batches):
        for batch in batches:
            for size, part in _same_length(batch):
                x = _vectors(part.column("vector"))
                centres = centroids.get(size, np.zeros((1, size)))
                gaps = to_centroids(x, centres)
                own = gaps.argmin(1)
                turn = rotation(size)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    rest = x - centres[own]
                    norm = np.sqrt((rest * rest).sum(1))
                    turned = rest @ turn.T
                    bits = turned > 0
                    signs = (bits * 2.0 - 1.0) / math.sqrt(size)
                    cosine = np.where(norm > 0, (signs * turned).sum(1) / norm, 1.0)  # of the vector and its code
                    centre = (signs * (centres[own] @ turn.T)).sum(1)
                far = ~np.isfinite(norm)
                codes = np.packbits(bits, axis=1)
                yield pa.record_batch(
                    [pa.array(np.full(len(x), size, np.int32)), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(np.where(far, np.inf, norm)), pa.array(np.where(far, 0.0, cosine)), pa.array(np.where(far, 0.0, centre)), part.column("vector"), part.column("ids")],
                    names=["dim", "cluster", "code", "norm", "cosine", "centre", "vector", "ids"],
                )

    return run


def _route(centroids: Centroids, stats: dict[tuple[int, int], tuple[int, float]], probe: int, k: int, later: bool):
    """Queries with the clusters they visit: the nearest ones that hold k + 1 vectors, or all others within reach."""
    size_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {d for d, _ in stats}:
        count = len(centroids[dim]) if dim in centroids else 1
        size_of[dim] = (np.array([stats.get((dim, c), (0, 0.0))[0] for c in range(count)]), np.array([stats.get((dim, c), (0, 0.0))[1] for c in range(count)]))

    def run(batches):
        for batch in batches:
            for size, part in _same_length(batch):
                x = _vectors(part.column("vector"))
                gaps = to_centroids(x, centroids.get(size, np.zeros((1, size))))
                held, radius = size_of[size]
                order = np.argsort(gaps, axis=1, kind="stable")
                near = np.empty(gaps.shape, bool)
                filled = np.cumsum(held[order], axis=1)
                rank = np.arange(gaps.shape[1])[None, :]
                np.put_along_axis(near, order, (rank < probe) | (filled - held[order] < k + 1), axis=1)
                go = near
                if later:
                    bound = part.column("tau").to_numpy()[:, None]
                    with np.errstate(invalid="ignore", over="ignore"):
                        least = gaps - radius[None, :] - SLACK * (gaps + radius[None, :] + np.sqrt((x * x).sum(1))[:, None])
                        go = ~near & ~(least > bound)  # what cannot be compared is visited
                row, cluster = np.nonzero(go & (held > 0)[None, :])
                with np.errstate(over="ignore"):
                    gap = np.sqrt(((x[row] - centroids.get(size, np.zeros((1, size)))[cluster]) ** 2).sum(1))
                out = part.take(pa.array(row))
                yield pa.record_batch([out.column("q"), out.column("own"), pa.array(np.full(len(row), size, np.int32)), pa.array(cluster.astype(np.int32)), out.column("vector"), out.column("tau"),
                                       pa.array(gap)], names=["q", "own", "dim", "cluster", "vector", "tau", "gap"])

    return run


def exact(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances, summed component by component from the first on, so that equal vectors get equal ones."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for j in range(x.shape[1]):
            step = x[:, j] - query[j]
            total += step * step
    return np.sqrt(total)


def _search(k: int, spread: float):
    class Search:
        def __init__(self, held: pa.Table):
            self.x = _vectors(held.column("vector"))
            self.size = self.x.shape[1]
            self.code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(self.x), -1).T.copy()
            self.norm, self.cosine, self.centre = (held.column(c).to_numpy() for c in ("norm", "cosine", "centre"))
            self.vectors, self.ids = held.column("vector").combine_chunks(), held.column("ids").to_pylist()
            with np.errstate(divide="ignore", invalid="ignore"):  # of what the bits leave open, in units of the inner product
                noise = np.sqrt(np.maximum(1 - self.cosine ** 2, 0)) / self.cosine
                self.noise = spread * noise / math.sqrt(self.size - 1) if self.size > 1 else np.full(len(self.x), np.inf)

        def least(self, query: np.ndarray, gap: float) -> np.ndarray:
            """Lower bounds of the squared distances, from codes and scalars alone; ``gap`` is the query's distance from the centroid."""
            turned = rotation(self.size) @ query
            padded = np.zeros(len(self.code) * 8)
            padded[: self.size] = turned / math.sqrt(self.size)
            table = padded.reshape(-1, 8) @ _signs().T
            product = np.zeros(len(self.x))
            for place, codes in enumerate(self.code):
                product += table[place][codes]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                # The estimate e and the true cosine c satisfy |e - c| <= s * sqrt(1 - c * c): c is at most the larger root.
                e, s = (product - self.centre) / (self.cosine * gap), self.noise
                most = (e + s * np.sqrt(np.maximum(1 + s * s - e * e, 0))) / (1 + s * s)
                most += ROUNDING * np.linalg.norm(turned) / (self.cosine * gap)
                most = np.where(np.isfinite(most), np.minimum(most, 1.0), 1.0)
                low = self.norm ** 2 + gap ** 2 - 2 * self.norm * gap * most
                return np.where(np.isfinite(low), low - SLACK * (self.norm ** 2 + gap ** 2), -np.inf)

        def take(self, rows):
            out = []
            vectors = _vectors(rows.column("vector"))
            for q, own, raw, gap, tau, query in zip(*(rows.column(c).to_pylist() for c in ("q", "own", "vector", "gap", "tau")), vectors, strict=True):
                low = self.least(query, gap)
                best: list[tuple[float, int]] = []
                maybe = np.flatnonzero(~(low > tau * tau * (1 + SLACK)))
                maybe = maybe[np.argsort(low[maybe], kind="stable")]
                at, step = 0, 4 * k
                while at < len(maybe) and not low[maybe[at]] > tau * tau * (1 + SLACK):
                    part = maybe[at: at + step]
                    for i, d in zip(part.tolist(), exact(self.x[part], query).tolist(), strict=True):
                        if d <= tau:
                            names = self.ids[i]
                            if d == 0 and self.vectors[i].as_py() == raw:
                                names = names.copy()
                                if own in names:
                                    names.remove(own)  # the query's own row; what repeats it stays
                            best += [(d, n) for n in names]
                    best = sorted(best)[:k]
                    if len(best) == k:
                        tau = min(tau, best[-1][0])
                    at, step = at + step, 2 * step
                out += [(q, n, d) for d, n in best]
            if out:
                q, names, scores = zip(*out, strict=True)
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(names, pa.int64()), pa.array(scores, pa.float64())], names=["q", "vec_id", "score"])

        def done(self):
            return iter(())

    return Search


def nearest(
    vectors: DataFrame, query: Column, k: int = 10, spread: float = 4.0, probe: int = 2, block: int = 16_384, chunk: int = 20_000,
    centroids: int | None = None,
) -> DataFrame:
    """The ``k`` nearest other rows of each row (vec_id, embedding) where ``query`` holds.

    Returns query_id, rank (from 1), vec_id, score: Euclidean distance on the original vectors in double precision, ties by
    smaller vec_id; fewer rows where there are fewer candidates. Rows without vec_id and vectors that are null, empty, zero
    or hold null or non-finite components take no part. Only vectors of equal length meet. Repeated rows are rows of
    their own: a repeated query gives its result once per row and finds its twins. Distances beyond the range of doubles
    are infinite. Other columns are not looked at.

    ``centroids`` defaults to the square root of the number of different vectors, at most 4096 and 2**20 numbers in all; they are
    fitted on about 16 vectors each. ``spread`` is the number of standard deviations of an estimate that its bound covers.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    arrays = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("query"), arrays.alias("embedding"))
    rows = stored(given.where("vec_id is not null and embedding is not null").mapInArrow(_scan, "vec_id long, query boolean, vector binary"), "rows")

    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = rows.select("vec_id", "vector").withColumn("place", place).where(F.col("place") <= k + 1)  # k + 1 ids are enough, one of them may be the query's own
    classes = stored(first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    lengths = {r.size: r.n for r in classes.groupBy((F.octet_length("vector") / 8).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}
    fitted: Centroids = {}
    for size, n in lengths.items():
        if n < FEWEST:
            continue  # one cluster around zero
        count = centroids or max(1, min(MAX_CENTROIDS, MAX_CENTROID_NUMBERS // size, round(math.sqrt(n))))
        share = min(1.0, count * SAMPLE_PER_CENTROID / n)
        drawn = F.pmod(F.xxhash64(F.lit(SEED), "vector"), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = classes.where((F.octet_length("vector") == 8 * size) & drawn).select("vector").limit(2 * count * SAMPLE_PER_CENTROID).toArrow()
        if sample.num_rows:
            order = np.array(sorted(sample.column("vector").to_pylist()), object)
            points = np.frombuffer(b"".join(order.tolist()), np.float64).reshape(-1, size)
            points = points[np.abs(points).max(1) < 1e100]
            if len(points):
                fitted[size] = fit_centroids(points, count)

    kinds = "dim int, cluster int, code binary, norm double, cosine double, centre double, vector binary, ids array<long>"
    index = stored(classes.mapInArrow(_encode(fitted), kinds), "codes")
    held = index.groupBy("dim", "cluster").agg(F.count("*").alias("n"), F.max("norm").alias("radius"))
    stats = {(r.dim, r.cluster): (r.n, r.radius) for r in held.collect()}  # a row per centroid

    queries = rows.where("query").groupBy("vec_id", "vector").agg(F.count("*").alias("times"))
    queries = stored(queries.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("own"), "vector", "times"), "queries")
    blocks = spark.createDataFrame([(d, c, -(-n // block)) for (d, c), (n, _) in stats.items()], "dim int, cluster int, blocks long")

    def visit(routed: DataFrame) -> DataFrame:
        visits = routed.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
        layout = F.broadcast(blocks.join(visits, ["dim", "cluster"]))  # at most a row per centroid
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        codes = index.join(layout, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("vector"), "blocks")).withColumn("chunk", every("chunks"))
        asked = routed.join(layout, ["dim", "cluster"]).withColumn("chunk", F.pmod(F.xxhash64("q"), "chunks")).withColumn("block", every("blocks"))
        keys = ["dim", "cluster", "block", "chunk"]
        found = meet(codes.drop("blocks", "chunks"), asked.drop("blocks", "chunks"), keys, tasks(spark, 1 << 30), _search(k, spread), "q long, vec_id long, score double")
        best = Window.partitionBy("q").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    schema = "q long, own long, dim int, cluster int, vector binary, tau double, gap double"
    begun = queries.withColumn("tau", F.lit(float("inf")))
    near = stored(visit(begun.mapInArrow(_route(fitted, stats, probe, k, False), schema)), "near")
    bounds = near.where(F.col("rank") == k).select("q", F.col("score").alias("bound"))
    bounded = begun.join(bounds, "q", "left").withColumn("tau", F.coalesce("bound", "tau")).drop("bound")
    later = visit(bounded.mapInArrow(_route(fitted, stats, probe, k, True), schema))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    both = near.drop("rank").unionByName(later.drop("rank")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = both.join(queries.select("q", "own", "times"), "q").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(F.col("own").alias("query_id"), "rank", "vec_id", "score")
