"""Batch retrieval: dense inner-product and lexical top-k of a corpus for a set of queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from rewardloom.operators.prep import passages_to_text
from rewardloom.plans.blocks import matrix, meet, tasks
from rewardloom.plans.scale import gather_lists, top_k

QUERY_BLOCK = 4096
STRIPE_ROWS = 1024
STRIPES = 1024
HELD_VALUES = 8_000_000
DENSE_DIGITS, LEXICAL_DIGITS = 9, 6


def _matrix(vectors: pa.Array) -> np.ndarray:
    m = matrix(vectors).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


class _Best:
    """The k best documents of each query: higher scores (to so many digits) first, ties to the document that came first."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), -np.inf)
        self.exact = np.full((rows, k), -np.inf)
        self.doc = np.full((rows, k), None, object)

    def found(self, query: pa.Array, doc_type: pa.DataType) -> pa.RecordBatch:
        row, slot = np.nonzero(self.score > -np.inf)
        docs = pa.array(self.doc[row, slot].tolist(), doc_type)
        return pa.record_batch([query.take(pa.array(row)), docs, pa.array(self.exact[row, slot])], names=["query_id", "doc_id", "score"])

    def offer(self, exact: np.ndarray, digits: int, docs: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Scores of ``rows`` (all queries by default) and documents in their order; -inf is no hit."""
        rows = np.arange(len(self.score)) if rows is None else rows
        near = (exact > self.score[rows, -1:] - 10.0**-digits).any(1)  # rounding moves a score by half of that
        rows, exact = rows[near], exact[near]
        scores = np.round(exact, digits)
        better = (scores > self.score[rows, -1:]).any(1)
        some = rows[better]
        if not len(some):
            return
        part = scores[better]
        if part.shape[1] > self.k:  # what is below the k-th of the batch cannot enter
            edge = np.partition(part, part.shape[1] - self.k, axis=1)[:, -self.k][:, None]
            part = np.where(part >= edge, part, -np.inf)
        both = np.hstack([self.score[some], part])
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.k]
        self.score[some] = np.take_along_axis(both, order, 1)
        self.exact[some] = np.take_along_axis(np.hstack([self.exact[some], exact[better]]), order, 1)
        names = self.doc[some]
        old = order < self.k
        self.doc[some] = np.where(old, np.take_along_axis(names, np.where(old, order, 0), 1), docs[np.where(old, 0, order - self.k)])


def _searching(k: int, block: int, doc_type: pa.DataType, query_type: pa.DataType):
    class Search:
        def __init__(self, held: pa.Table):
            self.query = held.column("query_id").combine_chunks()
            self.vectors = _matrix(held.column("embedding"))
            self.best = _Best(len(self.query), k)

        def take(self, rows):
            docs = np.empty(rows.num_rows, object)
            docs[:] = rows.column("doc_id").to_pylist()
            passing = _matrix(rows.column("embedding")).T
            for at in range(0, len(self.vectors), block):
                some = np.arange(at, min(at + block, len(self.vectors)))
                self.best.offer(self.vectors[some[0]: some[-1] + 1] @ passing, DENSE_DIGITS, docs, some)
            return iter(())

        def done(self):
            yield self.best.found(self.query.cast(query_type), doc_type)

    return Search


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, rank, score) of the k corpus vectors closest in cosine, ties (to nine digits) by smaller doc_id.

    ``queries`` is (query_id, embedding), ``corpus`` (doc_id, embedding); rows without id or vector take no part, all vectors are
    equally long. Queries are dealt into groups and the corpus into stripes, about as many of each, so that both sides are shuffled
    a fixed number of times until the queries of a group would hold more than ``HELD_VALUES`` numbers. A group is held while a stripe
    passes by in the order of doc_id, multiplied ``block`` queries at a time, and k hits per query and stripe are shuffled. Nothing of
    either side passes the driver.
    """
    spark = queries.sparkSession
    held = queries.select("query_id", _numbers(queries)).where("query_id is not null and embedding is not null")
    rows = corpus.select("doc_id", _numbers(corpus)).where("doc_id is not null and embedding is not null")
    arrow = {c: to_arrow_type(df.schema[c].dataType) for df, c in ((held, "query_id"), (rows, "doc_id"))}
    found = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    docs = rows.count()
    meetings = tasks(spark, math.ceil(found.n / block) * math.ceil(docs / STRIPE_ROWS))
    fit = max(block, HELD_VALUES // max(found.width or 1, 1))
    groups = max(1, math.ceil(found.n / fit), min(math.ceil(found.n / block), math.ceil(math.sqrt(meetings))))
    stripes = max(1, min(math.ceil(docs / STRIPE_ROWS), math.ceil(meetings / groups)))
    return _met(spark, held, rows, k, groups, stripes, DENSE_DIGITS, _searching(k, block, arrow["doc_id"], arrow["query_id"]))


def _numbers(df: DataFrame) -> Column:
    """Vectors as doubles; floats stay as they are until they are multiplied, at half the bytes."""
    kind = dict(df.dtypes)["embedding"]
    return F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding")


def _met(spark, held: DataFrame, rows: DataFrame, k: int, blocks: int, stripes: int, digits: int, search) -> DataFrame:
    """Blocks of queries meet stripes of documents; the best of all stripes."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = held.withColumn("block", own("query_id", blocks)).withColumn("stripe", every(stripes))
    rows = rows.withColumn("stripe", own("doc_id", stripes)).withColumn("block", every(blocks))
    schema = f"query_id {dict(held.dtypes)['query_id']}, doc_id {dict(rows.dtypes)['doc_id']}, score double"
    hits = meet(held, rows, ["block", "stripe"], tasks(spark, blocks * stripes), search, schema, ["doc_id"])
    hits = hits.withColumn("__s", F.round("score", digits))
    return top_k(hits, ["query_id"], ["__s desc", "doc_id"], k).select("query_id", "doc_id", "rank", "score")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def _scoring(k: int, k1: float, b: float, average: float, doc_type: pa.DataType, query_type: pa.DataType):
    class Search:
        def __init__(self, held: pa.Table):
            self.query = held.column("query_id").combine_chunks()
            entries = [(t, w, q) for q, pairs in enumerate(held.column("weights").to_pylist()) for t, w in ((p["term"], p["idf"]) for p in pairs)]
            entries.sort()
            term, self.idf, self.asking = (np.array([e[i] for e in entries], kind) for i, kind in enumerate((np.int64, np.float64, np.int64)))
            self.terms, self.first = np.unique(term, return_index=True)
            self.last = np.append(self.first[1:], len(term))
            self.best = _Best(len(self.query), k)

        def take(self, rows):
            flat = rows.column("terms").flatten().to_numpy(zero_copy_only=False)
            sizes = rows.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
            hit = self.terms[at] == flat
            code, tf = np.unique(at[hit] * len(sizes) + doc[hit], return_counts=True)
            if not len(code):
                return iter(())
            term, doc = code // len(sizes), code % len(sizes)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / average))
            begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            ends = np.append(begin[1:], len(term))
            # No document of this batch can give a query more than its terms' greatest weights here.
            bound = np.zeros(len(self.query))
            for t, most in zip(term[begin].tolist(), np.maximum.reduceat(weight, begin).tolist(), strict=True):
                bound[self.asking[self.first[t]: self.last[t]]] += self.idf[self.first[t]: self.last[t]] * most
            live = bound + 1e-6 > self.best.score[:, -1]
            live &= bound > 0
            place = np.cumsum(live) - 1
            scores = np.zeros((int(live.sum()), len(sizes)))
            for t, lo, hi in zip(term[begin].tolist(), begin.tolist(), ends.tolist(), strict=True):
                asking = self.asking[self.first[t]: self.last[t]]
                asked = live[asking]
                if asked.any():
                    scores[place[asking[asked]][:, None], doc[lo:hi][None, :]] += self.idf[self.first[t]: self.last[t]][asked][:, None] * weight[lo:hi][None, :]
            docs = np.empty(len(sizes), object)
            docs[:] = rows.column("doc_id").to_pylist()
            self.best.offer(np.where(scores > 0, scores, -np.inf), LEXICAL_DIGITS, docs, np.flatnonzero(live))
            return iter(())

        def done(self):
            yield self.best.found(self.query.cast(query_type), doc_type)

    return Search


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, rank, score) by lexical weight, over the whole texts; ties (to six digits) by smaller doc_id.

    Terms are 64-bit hashes. Document frequencies are counts with partial sums, so a frequent term costs no more than others. Documents
    are scored where a block of queries is held, batch by batch; a query is left out of a batch whose greatest term weights cannot lift any
    document over its k-th score. Rows without id take no part.
    """
    spark = queries.sparkSession
    hashed = lambda text: F.transform(terms(text), lambda t: F.xxhash64(t))
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(hashed(F.col("text")))).alias("term"))
    docs = corpus.where("doc_id is not null").select("doc_id", F.coalesce(hashed(F.col("text")), F.array().cast("array<bigint>")).alias("terms"))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms").cast("double")).alias("average")).first()
    seen = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    seen = seen.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.log(1 + (F.lit(float(total.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    held = asked.join(seen, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf)).alias("weights"))
    arrow = {c: to_arrow_type(df.schema[c].dataType) for df, c in ((held, "query_id"), (docs, "doc_id"))}
    blocks = max(1, math.ceil(queries.count() / block))
    stripes = max(1, min(STRIPES, math.ceil(total.n / STRIPE_ROWS)))
    found = _met(spark, held, docs, k, blocks, stripes, LEXICAL_DIGITS, _scoring(k, k1, b, total.average or 1.0, arrow["doc_id"], arrow["query_id"]))
    return found.withColumn("score", F.round("score", LEXICAL_DIGITS))


def split_title_text(contents: Column) -> Column:
    """First line as title, the rest as text."""
    title = F.substring_index(contents, "\n", 1)
    return F.struct(title.alias("title"), F.substr(contents, F.length(title) + 2).alias("text"))


def attach_passages(queries: DataFrame, hits: DataFrame, corpus: DataFrame, out: str = "passages") -> DataFrame:
    """Each query with the reference block of its ranked hits; more hits than one list holds give further rows."""
    found = hits.join(corpus, "doc_id").withColumn("__p", split_title_text(F.col("text")))
    lists = gather_lists(found, ["query_id"], ["rank"], F.col("__p"), "__hits")
    return queries.join(lists.select("query_id", passages_to_text(F.col("__hits")).alias(out)), "query_id", "left")
