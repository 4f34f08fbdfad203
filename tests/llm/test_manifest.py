"""Merkle manifest against a plain version: trees, proofs, ties, nulls, tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rewardloom.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return h(field(doc_id), field(source), field(lang), field(None if n_chars is None else n_chars + more), field(text))


def climb(nodes):
    """Levels of (digest) from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i: i + 2]) for i in range(0, len(last), 2)])
    return levels


def walk(levels, at, digest):
    siblings = []
    for level in levels[:-1]:
        run = level[at - at % 2: at - at % 2 + 2]
        siblings += [x for k, x in enumerate(run) if k != at % 2]
        run[at % 2] = digest
        digest, at = h(*run), at // 2
    return siblings, digest


def by_hand(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, climb([leaf_of(r) for r in own]))
    top = climb([trees[x][1][-1][0] for x in langs])
    out = []
    for t, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, row in enumerate(own):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            low, now = walk(levels, i, leaf_of(row, 1) if hit else leaf_of(row))
            high, now = walk(top, t, now)
            out.append((row[0], leaf_of(row), levels[-1][0], top[-1][0], h(*low, *high), now, now == top[-1][0]))
    return out


def table(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return frame.withColumns({"tree": F.lit("x"), "idx": F.lit(1), "leaf": F.lit(2), "a.b": F.lit(3)})


def made(spark, rows):
    got = manifest.manifest(table(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 1, None: 1}, {"en": 2}, {"en": 5, "de": 1, "fr": 3, None: 2, "é": 4, "": 1}, {"en": 1100, "de": 33, "zz": 1}])
def test_equals_plain_trees(spark, sizes):
    rng = random.Random(3)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(5000), rng.choice(["web", "bücher", None]), lang, rng.randrange(99), rng.choice(["", "a:1", "häß", "x" * 500])))
    rows = list({r[0]: r for r in rows}.values())
    assert made(spark, rows) == sorted(by_hand(rows), key=repr)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, "s", "en", 1, "a"), (1, "s", "en", 1, "a"), (1, "s", "en", 2, "b"), (None, None, None, None, None), (None, "s", "en", 3, None), (7, "s", "en", None, ""),
            (-5, "s", "en", 0, "t"), (43, "s", None, 5, "long " * 40_000)]
    assert made(spark, rows) == sorted(by_hand(rows), key=repr)
    assert made(spark, rows * 40) == sorted(by_hand(rows * 40), key=repr)


def test_empty_and_untampered(spark):
    assert made(spark, []) == []
    rows = [(i, "s", "en" if i % 3 else "de", i, "t") for i in range(50)]
    assert all(r.verified for r in manifest.manifest(table(spark, rows)).collect())


def test_many_languages_and_small_spans(spark, monkeypatch):
    """More trees than a block holds, and several passes."""
    monkeypatch.setattr(manifest, "SPAN", 2)
    monkeypatch.setattr(manifest, "SMALL_BYTES", 0)
    rows = [(i, "s", f"l{i * i % 23}", i, "t") for i in range(150)]
    assert made(spark, rows) == sorted(by_hand(rows), key=repr)
