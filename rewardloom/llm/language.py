"""Language identification: nearest of several centroids per language.

A text is a vector of hashed letter n-grams (2 and 3 bytes of the lower-cased text, every other character a
blank), weighted by (1 + log tf) * idf and normalised. Document frequencies are counted over all labelled
training rows. Centroids are clustered by spherical k-means on a bounded sample of them: at most about
``sample`` rows per language, chosen by a hash of doc_id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import U64, beside_row, columns_of_row, rows_and_text, small_batches

BINS = 8192
SAMPLE = 400
LEVELS = 1000  # of the similarities that are counted to set the limit of a language
FARTHEST = 0.01  # share of the training rows that may lie beyond the similarity from which the limit follows
MARGIN = 0.5
CENTROIDS = 4
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x BINS, unit length
    idf: np.ndarray
    floor: dict[str, float]  # similarities below, in proportion to a text's reach, are a rejection


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter; numerals and number forms are none."""
    return text is not None and any(map(str.isalpha, text))


def counts(texts: list[str | None]) -> np.ndarray:
    """Rows of n-gram counts; null counts as empty."""
    clean = [(" " + _OTHER.sub(" ", t.lower()).strip() + " ").encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(clean), np.uint8).astype(U64)
    row = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    out = np.zeros(len(clean) * BINS, np.float32)
    for width in (2, 3):
        n = len(data) - width + 1
        if n <= 0:
            continue
        x = np.full(n, width, U64)
        for k in range(width):
            x = (x << U64(8)) | data[k: k + n]
        inside = row[:n] == row[width - 1:]
        slot = ((x * U64(0x9E3779B97F4A7C15)) >> U64(64 - 13)).astype(np.int64)
        out += np.bincount((row[:n] * BINS + slot)[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(len(clean), BINS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(count > 0, (1 + np.log(np.maximum(count, 1))) * idf, 0).astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def _reach(x: np.ndarray) -> np.ndarray:
    """How near a text with so few n-grams can come to a centroid at all, 1 for longer ones."""
    return np.sqrt(np.clip(np.count_nonzero(x, axis=1), 1, 256) / 256)


_ROWS = 128


def _slices(batches, columns: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield [part.column(k) for k in range(columns)]


def _document_frequencies(batches):
    total, rows = np.zeros(BINS, np.int64), 0
    for (texts,) in _slices(batches, 1):
        total += (counts(texts.to_pylist()) > 0).sum(0)
        rows += len(texts)
    yield pa.record_batch([pa.array(np.arange(-1, BINS)), pa.array(np.concatenate([[rows], total]))], names=["bin", "n"])


def _sparse(batches):
    for lang, texts in _slices(batches, 2):
        c = counts(texts.to_pylist())
        for name, row in zip(lang.to_pylist(), c, strict=True):
            at = np.flatnonzero(row)
            yield pa.record_batch([pa.array([name]), pa.array([at.astype(np.int16).tobytes()]), pa.array([row[at].tobytes()])], names=["lang", "bins", "counts"])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spread starting rows."""
    k = min(k, len(x))
    means = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ means.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                means[j] = x[near == j].mean(0)
                means[j] /= max(np.linalg.norm(means[j]), 1e-12)
    return means


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from rows (doc_id, text, lang); rows without lang or without a letter teach nothing."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    small_batches(labelled.sparkSession)
    found = rows.select("text").mapInArrow(_document_frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BINS + 1)
    for r in found:  # one row per bin
        df[r["bin"]] = r["n"]
    idf = (np.log((df[-1] + 1) / (df[:BINS] + 1)) + 1).astype(np.float32)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    picked = rows.where((F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)) < share)
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in picked.select("lang", "text").mapInArrow(_sparse, "lang string, bins binary, counts binary").orderBy("lang", F.sha2("counts", 256)).collect():
        x = np.zeros(BINS, np.float32)
        x[np.frombuffer(r["bins"], np.int16)] = np.frombuffer(r["counts"], np.float32)
        by_lang.setdefault(r["lang"], []).append(x)
    names, means = [], []
    for name in sorted(by_lang):
        x = vectors(np.stack(by_lang[name]), idf)
        own = _cluster(x, centroids)
        names += [name] * len(own)
        means.append(own)
    model = Model(names, np.concatenate(means) if means else np.zeros((0, BINS), np.float32), idf, {})
    return replace(model, floor=_limits(rows, model)) if names else model


def _limits(rows: DataFrame, model: Model) -> dict[str, float]:
    """Per language: MARGIN of the similarity that all but FARTHEST of its training rows have, so a few wrong labels do not move it."""
    of = {name: np.array([n == name for n in model.languages]) for name in set(model.languages)}

    def levels(batches):
        for lang, texts in _slices(batches, 2):
            names = np.array(lang.to_pylist(), object)
            x = vectors(counts(texts.to_pylist()), model.idf)
            near = x @ model.centroids.T / _reach(x)[:, None]
            for name in set(names.tolist()) & set(of):
                level = np.clip(near[names == name][:, of[name]].max(1) * LEVELS, 0, LEVELS).astype(np.int64)
                at, n = np.unique(level, return_counts=True)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n)], names=["lang", "level", "n"])

    found = rows.select("lang", "text").mapInArrow(levels, "lang string, level long, n long").groupBy("lang", "level").agg(F.sum("n").alias("n")).collect()
    seen = {name: np.zeros(LEVELS + 1, np.int64) for name in of}
    for r in found:  # at most LEVELS + 1 rows per language
        seen[r["lang"]][r["level"]] = r["n"]
    return {name: MARGIN * float(np.searchsorted(np.cumsum(n), FARTHEST * n.sum(), "right")) / LEVELS for name, n in seen.items()}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score and rejected to every row of (doc_id, text, rest...).

    ``und`` where the text is null, has no letter, or nothing was learned, with score 0 and rejected; otherwise the
    language of the nearest centroid and its cosine. ``rejected`` also marks texts whose similarity, in proportion
    to what so short a text can reach, is under half of that which all but a hundredth of the language's training rows
    have. Other columns pass through.
    """
    small_batches(docs.sparkSession)
    names = np.array([*model.languages, "und"], object)
    floors = np.array([*(model.floor[n] for n in model.languages), 2.0], np.float32)
    schema = beside_row(docs, "lang_pred string, score double, rejected boolean")

    def label(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                texts = part.column(1).to_pylist()
                lettered = np.array([has_letter(t) for t in texts], bool)
                best = np.full(len(texts), len(names) - 1)
                score, reach = np.zeros(len(texts)), np.ones(len(texts))
                if lettered.any() and len(model.centroids):
                    x = vectors(counts(texts), model.idf)
                    cosine, reach = x @ model.centroids.T, _reach(x)
                    best = np.where(lettered, cosine.argmax(1), best)
                    score = np.where(lettered, np.clip(cosine.max(1), 0, 1), 0.0)
                yield pa.record_batch(
                    [part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(score < floors[best] * reach)],
                    names=schema.names,
                )

    added = ("lang_pred", "score", "rejected")
    return rows_and_text(docs).mapInArrow(label, schema).select(*columns_of_row(docs, *added), *added)


def held_out(doc_id: Column) -> Column:
    """The rows that the classifier never learns from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that are not held out, predict all: adds held_out and predict()'s columns."""
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), fit(learn, sample))


def without_unknown(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, as they are."""
    rows = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return identify(rows, sample).where(~F.col("rejected")).select("row.*")
