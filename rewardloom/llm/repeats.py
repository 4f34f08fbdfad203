"""Passages that recur across documents: found by anchors, confirmed and located by automata.

Every window of ``WINDOW`` words has an anchor: its run of ``RUN`` words with the smallest hash. Equal windows have equal
anchors, so only windows with an anchor that occurs in two different texts can recur. Those windows are sent
to shards by anchor, as stretches of words that share it; equal stretches are one, whatever the number of
documents they come from, and an anchor of very many windows is sent window by window. A shard confirms
on the words themselves which windows recur, compiles them into an Aho-Corasick automaton over runs of words
(three characters per distinct run of the shard, three runs to a window) and streams its stretches through it.

Documents of equal words are collapsed before that: all but the first are repeats as a whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import U64, constants, mix, run_hashes, small_batches, stored, text_slices, word_bounds, word_hashes

WINDOW, RUN = 13, 5
SPAN = WINDOW - RUN + 1  # runs in a window
BUSY = 5000  # windows of an anchor, in all texts, from which on they are sent one by one
SHARD_WORDS = 300_000
_SEQUENCE = constants(52, 2)


def _anchors(words: np.ndarray, first: np.ndarray):
    """Windows of all documents of a slice: first window per document (one more), anchor place and anchor hash of each.

    A window's number within its document is its first word.
    """
    runs, heads = run_hashes(words, first, RUN, 51)
    counts = np.maximum(np.diff(first) - WINDOW + 1, 0)
    window_heads = np.concatenate([[0], np.cumsum(counts)])
    if not window_heads[-1]:
        return window_heads, np.empty(0, np.int64), np.empty(0, U64)
    starts = np.arange(window_heads[-1]) + np.repeat(heads[:-1] - window_heads[:-1], counts)
    best = np.lib.stride_tricks.sliding_window_view(runs, SPAN)[starts].argmin(1)
    places = starts + best
    return window_heads, places, runs[places]


def _slices(column: pa.Array):
    for lo, hi, data, at in text_slices(column):
        starts, ends, first = word_bounds(data, at)
        yield lo, hi, data, at, first, word_hashes(data, starts, ends)


def _scan(batches):
    for batch in batches:
        for lo, hi, data, at, first, words in _slices(batch.column(1)):
            d0, d1 = _digests(words, first)
            shas = [hashlib.sha256(b" ".join(data[at[i]: at[i + 1]].tobytes().split())).hexdigest() for i in range(hi - lo)]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(d0), pa.array(d1), pa.array(shas)],
                                  names=["doc_id", "n_words", "d0", "d1", "sha"])


def _digests(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of each document's word sequence."""
    place = np.arange(len(words), dtype=U64) - np.repeat(first[:-1], np.diff(first)).astype(U64)
    out = []
    for c in _SEQUENCE:
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words ^ mix(place * c + c)))])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64)).view(np.int64))
    return out


def _anchor_rows(batches):
    """A row per document and distinct anchor of it, with the number of its windows."""
    for batch in batches:
        for lo, hi, _, _, first, words in _slices(batch.column(1)):
            heads, _, keys = _anchors(words, first)
            d0 = _digests(words, first)[0]
            found = [np.unique(keys[heads[i]: heads[i + 1]], return_counts=True) for i in range(hi - lo)]
            sizes = [len(a) for a, _ in found]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(np.repeat(np.arange(lo, hi), sizes))), pa.array(np.repeat(d0, sizes)),
                 pa.array(np.concatenate([a for a, _ in found]).view(np.int64)), pa.array(np.concatenate([n for _, n in found]).astype(np.int64))],
                names=["doc_id", "d0", "anchor", "n"],
            )


def _recurring(batches):
    """(anchor, d0, doc_id, n) in this order to (doc_id, anchor): the first document of each text, where an anchor has two texts or more.

    An anchor of more than BUSY windows also gives a row without doc_id. Of an anchor that goes on in the next batch only its
    number of texts and windows and, while it has one text, that text's document are kept.
    """
    anchor = text = alone = None
    texts = windows = 0

    def rows(docs, anchors):
        return pa.record_batch([pa.array(docs, pa.int64()), pa.array(anchors, pa.int64())], names=["doc_id", "anchor"])

    def busy(anchors, sizes, sums):
        crowded = anchors[(sizes > 1) & (sums > BUSY)]
        return rows([None] * len(crowded), crowded)

    for batch in batches:
        a, d0, doc, n = (c.to_numpy() for c in batch.columns)
        if not len(a):
            continue
        fresh = np.concatenate([[a[0] != anchor or d0[0] != text], (a[1:] != a[:-1]) | (d0[1:] != d0[:-1])])
        text = d0[-1]
        a, doc, n = a[fresh], doc[fresh], n[fresh]
        if not len(a):
            continue
        edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        own = np.diff(np.append(edge, len(a)))
        sizes, sums = own.copy(), np.add.reduceat(n, edge)
        if a[0] == anchor:
            sizes[0] += texts
            sums[0] += windows
            if alone is not None:
                yield rows([alone], [anchor])
        elif anchor is not None:
            yield busy(np.array([anchor]), np.array([texts]), np.array([windows]))
        many = np.repeat(sizes > 1, own)
        yield rows(doc[many], a[many])
        yield busy(a[edge[:-1]], sizes[:-1], sums[:-1])
        anchor, texts, windows = a[-1], int(sizes[-1]), int(sums[-1])
        alone = int(doc[-1]) if texts == 1 else None
    if anchor is not None:
        yield busy(np.array([anchor]), np.array([texts]), np.array([windows]))


def _stretches(batches):
    """doc_id, text, anchors, busy to (doc_id, start, route, words): stretches of windows that share a recurring anchor."""
    for batch in batches:
        rows = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        for lo, hi, data, at, first, words in _slices(batch.column(1)):
            heads, places, keys = _anchors(words, first)
            whole, _ = run_hashes(words, first, WINDOW, 53)
            docs, starts, routes, texts = [], [], [], []
            for i in range(hi - lo):
                anchors, busy = rows[lo + i]
                a, b = heads[i], heads[i + 1]
                own = keys[a:b]
                wanted = np.isin(own, np.array(anchors, np.int64).view(U64))
                single = np.isin(own, np.array(busy or [], np.int64).view(U64)) & wanted
                # a stretch ends where the anchor changes; windows of busy anchors stand alone
                cut = np.ones(b - a, bool)
                cut[1:] = (places[a + 1: b] != places[a: b - 1]) | single[1:] | single[:-1]
                begin = np.flatnonzero(cut)
                end = np.append(begin[1:], b - a)
                take = wanted[begin]
                text = data[at[i]: at[i + 1]].tobytes().split()
                for s, e in zip(begin[take].tolist(), end[take].tolist(), strict=True):
                    docs.append(lo + i)
                    starts.append(s)
                    routes.append(int((whole[a + s] if single[s] else own[s]).view(np.int64)))
                    texts.append(b" ".join(text[s: e + WINDOW - 1]))
            if docs:
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(docs)), pa.array(starts, pa.int64()), pa.array(routes, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "start", "route", "words"],
                )


# A window is spelled by three runs of RUN words, LEAP apart: together they cover its words and no others. A run is spelled by three
# characters, each of its own range, because a node of the automaton looks through its children one by one.
LEAP = (WINDOW - RUN) // 2
SPELT = 3
_GAP = 0  # a character of no run


def _numbers(*parts: np.ndarray) -> np.ndarray:
    """A number per distinct row of ``parts``, themselves numbers below 2**31; equal rows, and no others, share it."""
    both = parts[0].astype(np.int64)
    for p in parts[1:]:
        both = pa.array((both << 32) | p).dictionary_encode().indices.to_numpy().astype(np.int64)
    return both


def _spelled(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All stretches as one string of runs, where each window begins in it, and the number of windows of each stretch.

    A stretch is read in LEAP phases: phase f holds the runs at words f, f + LEAP, and so on, and ends in a gap.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    n = len(words)
    pairs = _numbers(words[: n - 1], words[1:])
    runs = _numbers(_numbers(pairs[: n - 4], pairs[2: n - 2]), words[4:])
    base = math.ceil((int(runs.max()) + 1) ** (1 / SPELT)) + 1
    letters = np.stack([0x100 + i * base + runs // base**i % base for i in range(SPELT)], axis=1)

    def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stretch = np.repeat(np.arange(len(counts)), counts)
        return stretch, np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts)

    own = sizes - RUN + 1
    heads, lengths = np.cumsum(sizes) - sizes, own + LEAP
    bases = np.cumsum(lengths) - lengths
    phases = np.arange(LEAP)
    begins = np.cumsum((own[:, None] - phases + LEAP - 1) // LEAP + 1, axis=1)
    begins = np.concatenate([np.zeros((len(own), 1), np.int64), begins[:, :-1]], axis=1) + bases[:, None]
    stretch, k = places(own)
    spelled = np.full((int(lengths.sum()), SPELT), _GAP, np.uint32)
    spelled[begins[stretch, k % LEAP] + k // LEAP] = letters[heads[stretch] + k]
    windows = sizes - WINDOW + 1
    stretch, k = places(windows)
    return spelled.tobytes().decode("utf-32-le"), SPELT * (begins[stretch, k % LEAP] + k // LEAP), windows


def _locate(stretches: list[tuple[int, str, int, int]]) -> list[tuple[int, str, list[int]]]:
    """One shard: (route, words, least doc_id, greatest doc_id) to (route, words, least doc_id per window, None where it doesn't recur)."""
    import ahocorasick

    text, at, windows = _spelled([words for _, words, _, _ in stretches])
    bounds: dict[str, tuple[int, int]] = {}
    ends = np.cumsum(windows).tolist()
    places = at.tolist()
    lo = 0
    for hi, (_, _, least, greatest) in zip(ends, stretches, strict=True):
        own = (least, greatest)
        for k in places[lo:hi]:
            w = text[k: k + 3 * SPELT]
            known = bounds.setdefault(w, own)
            if known is not own and (least < known[0] or greatest > known[1]):
                bounds[w] = (min(least, known[0]), max(greatest, known[1]))
        lo = hi
    automaton = ahocorasick.Automaton()
    for w, (least, greatest) in bounds.items():
        if least < greatest:
            automaton.add_word(w, least)
    if not len(automaton):
        return []
    automaton.make_automaton()
    found = [None] * len(text)
    for last, least in automaton.iter(text):
        found[last - 3 * SPELT + 1] = least
    out = []
    lo = 0
    for hi, (route, words, _, _) in zip(ends, stretches, strict=True):
        firsts = [found[k] for k in places[lo:hi]]
        if any(x is not None for x in firsts):
            out.append((route, words, firsts))
        lo = hi
    return out


def _shards(batches):
    held: list[tuple[int, str, int, int]] = []
    size, route = 0, None

    def batch_of(found):
        return pa.record_batch(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.int64()))],
            names=["route", "words", "firsts"],
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD_WORDS and row[0] != route:
                yield batch_of(_locate(held))
                held, size = [], 0
            route = row[0]
            held.append(row)
            size += row[1].count(" ") + 1
    if held:
        yield batch_of(_locate(held))


def _cut(batches):
    """doc_id, d0, d1, text, starts of removed windows to what is left."""
    for batch in batches:
        n_removed, shas, ranges = [], [], []
        for text, starts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            words = text.encode().split()
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, starts, 1)
            np.add.at(marks, np.array(starts) + WINDOW, -1)
            gone = np.cumsum(marks)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            n_removed.append(int(gone.sum()))
            ranges.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
            shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([*batch.columns[:3], pa.array(n_removed, pa.int64()), pa.array(shas), pa.array(ranges, kind)],
                              names=["doc_id", "d0", "d1", "gone", "left_sha", "ranges"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Words of each document (doc_id, text) that lie in a window which also starts in a document of smaller doc_id.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space),
    removed (array of word ranges, end exclusive). Words are separated by ASCII white space and compared as they
    are. Null and empty texts have no word. Rows without doc_id lose nothing and take nothing from others;
    rows of one doc_id are one document; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    scanned = stored(_texts(docs).mapInArrow(_scan, "doc_id long, n_words long, d0 long, d1 long, sha string"), "words")
    known = scanned.where(f"doc_id is not null and n_words >= {WINDOW}")
    least = stored(known.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep")), "texts")

    # Anchors of two different texts or more, met in one shuffle of (anchor, text, document).
    rows = _texts(docs).where("doc_id is not null and text is not null").mapInArrow(_anchor_rows, "doc_id long, d0 long, anchor long, n long")
    met = rows.select("anchor", "d0", "doc_id", "n").repartition("anchor").sortWithinPartitions("anchor", "d0", "doc_id")
    recurring = stored(met.mapInArrow(_recurring, "doc_id long, anchor long"), "anchors")
    many = recurring.where("doc_id is null").select("anchor", F.lit(True).alias("busy"))
    reps = least.select("d0", "d1", "rep")
    wanted = recurring.where("doc_id is not null").select("doc_id", "anchor").join(many, "anchor", "left")
    busy = F.collect_set(F.when(F.col("busy"), F.col("anchor")))
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), busy.alias("busy"))
    held = stored(_texts(docs).where("text is not null").join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "anchors", "busy"), "held")

    stretches = stored(held.mapInArrow(_stretches, "doc_id long, start long, route long, words string"), "stretches")
    distinct = stretches.groupBy("route", "words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    located = distinct.repartition(F.col("route")).sortWithinPartitions("route").mapInArrow(_shards, "route long, words string, firsts array<long>")
    located = stored(located.select("route", F.xxhash64("words").alias("key"), "firsts"), "located")
    found = stretches.select("doc_id", "start", "route", F.xxhash64("words").alias("key")).join(located.hint("merge"), ["route", "key"])
    hits = F.filter(F.transform("firsts", lambda m, k: F.when(m < F.col("doc_id"), F.col("start") + k)), lambda x: x.isNotNull())
    hits = found.select("doc_id", hits.alias("starts")).where(F.size("starts") > 0)
    starts = hits.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    digests = known.select("doc_id", "d0", "d1").join(reps, ["d0", "d1"]).where("doc_id = rep").select("doc_id", "d0", "d1").distinct()
    cut = held.select("doc_id", "text").join(starts, "doc_id").join(digests, "doc_id").select("doc_id", "d0", "d1", "text", "starts")
    cut = cut.mapInArrow(_cut, "doc_id long, d0 long, d1 long, gone long, left_sha string, ranges array<struct<start:bigint,end:bigint>>")
    cut = cut.groupBy("doc_id", "d0", "d1").agg(*(F.first(c).alias(c) for c in ("gone", "left_sha", "ranges")))

    out = scanned.join(reps, ["d0", "d1"], "left").join(cut, ["doc_id", "d0", "d1"], "left")
    copy = (F.col("n_words") >= WINDOW) & (F.col("rep") < F.col("doc_id"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))

    def pick(whole: Column, part: str, other: Column) -> Column:
        return F.when(copy, whole).otherwise(F.coalesce(F.col(part), other))

    return out.select(
        "doc_id", "n_words", pick(F.col("n_words"), "gone", F.lit(0).cast("long")).alias("n_removed"),
        pick(F.sha2(F.lit(""), 256), "left_sha", F.col("sha")).alias("kept_sha256"), pick(all_of, "ranges", none).alias("removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``; texts that lose words become their words left, joined by one space."""
    cuts = repeated_passages(docs).where("doc_id is not null and n_removed > 0").groupBy("doc_id").agg(F.first("removed").alias("_removed"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    left = F.filter(words, lambda w, i: ~F.exists("_removed", lambda r: (r["start"] <= i) & (i < r["end"])))
    text = F.when(F.col("_removed").isNotNull(), F.array_join(left, " ")).otherwise(F.col("text"))
    return docs.join(cuts, "doc_id", "left").select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
