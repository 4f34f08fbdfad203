"""Secrets in texts: all rules in one automaton, one pass over the bytes.

A text is cut into lanes at bytes that send the automaton back to its start whatever came before; no match
crosses them. All lanes of a slice advance together, one table look-up per byte. Lanes in which a rule ended
are then read by that rule's exact expression, which gives the spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.automaton import Automaton, compile_rules, scan
from rewardloom.llm.common import beside_row, columns_of_row, rows_and_text, small_batches, text_slices


@dataclass(frozen=True)
class Rule:
    kind: str
    find: str  # what the automaton finds
    exact: str  # what delimits a match inside a lane
    least: int = 0  # shortest match (or group 2 where there is one) that counts
    counted: int | None = None  # largest repeat count inside the automaton


# The three base rules, then key formats of public services.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]{8,}""",
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]+", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("google", r"AIza[A-Za-z0-9_\-]{35,}", r"AIza[A-Za-z0-9_-]{35,}", 0, 1),
    Rule("private_key", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"),
)
BASE = 3


def _spans(rules: tuple[Rule, ...], patterns: list[re.Pattern], automaton: Automaton, column: pa.Array):
    """Per slice: its rows and a dict from row to sorted (start, rule, end) in code points."""
    reset = np.zeros(256, bool)
    reset[automaton.resets] = True
    for lo, hi, data, at in text_slices(column):
        found: dict[int, list[tuple[int, int, int]]] = {}
        if len(data):
            cut = np.zeros(len(data) + 1, bool)
            cut[at] = True
            cut[0] = cut[-1] = True
            inside = ~reset[data]
            inside_before = np.concatenate([[False], inside[:-1]])
            starts = np.flatnonzero(inside & (cut[:-1] | ~inside_before))
            ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
            hits = scan(automaton, data, starts, ends)
            for lane in np.flatnonzero(hits).tolist():
                s, e = int(starts[lane]), int(ends[lane])
                row = int(np.searchsorted(at, s, "right")) - 1
                text = data[s:e].tobytes()
                base = None
                for k, (rule, pattern) in enumerate(zip(rules, patterns, strict=True)):
                    if hits[lane] >> k & 1:
                        for m in pattern.finditer(text):
                            size = len(m[2]) if pattern.groups >= 2 else m.end() - m.start()
                            if size >= rule.least:
                                if base is None:  # code points before the lane, whose own bytes are single ones
                                    before = data[at[row]: s]
                                    base = int(np.count_nonzero((before & 0xC0) != 0x80))
                                found.setdefault(row, []).append((base + m.start(), k, base + m.end()))
        yield lo, hi, {row: sorted(x) for row, x in found.items()}


def _compiled(rules: tuple[Rule, ...]) -> tuple[list[re.Pattern], Automaton]:
    automaton = compile_rules([(r.find, r.counted) for r in rules])
    if (automaton.resets < 128).sum() == 0 or not set(range(128, 256)) <= set(automaton.resets.tolist()):
        raise ValueError("rules must be over ASCII, with some byte that no rule contains")
    return [re.compile(r.exact.encode()) for r in rules], automaton


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...], fields: str, build) -> DataFrame:
    """Every row as ``row``, with columns built from its text and its spans."""
    small_batches(docs.sparkSession)
    patterns, automaton = _compiled(rules)
    schema = beside_row(docs, fields)

    def run(batches):
        for batch in batches:
            for lo, hi, found in _spans(rules, patterns, automaton, batch.column(1)):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column(0), *build(part.column(1), found)], names=schema.names)

    return rows_and_text(docs).mapInArrow(run, schema)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets``: array of (kind, start, end, text) by start, then rule order; offsets are code points, end exclusive.

    Matches are leftmost and do not overlap within a rule. Null text has null secrets, a text without matches an
    empty array. Every row and every other column stays.
    """
    kinds = [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def build(texts, found):
        rows = []
        for i, text in enumerate(texts):
            spans = found.get(i, [])
            plain = text.as_py() if spans else None
            rows.append(None if not text.is_valid else [
                {"kind": kinds[k], "start": s, "end": e, "text": plain[s:e]} for s, k, e in spans
            ])
        return [pa.array(rows, pa.list_(item))]

    out = _with_spans(docs, rules, "secrets array<struct<kind:string,start:bigint,end:bigint,text:string>>", build)
    return out.select(*columns_of_row(docs, "secrets"), "secrets")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace every secret in ``text`` by ``[kind]``; overlapping spans are one, named after the first.

    Same rows and columns; n_chars, where there is such a column, follows the new text. Null stays null.
    """
    kinds = [r.kind for r in rules]

    def build(texts, found):
        rows = texts.to_pylist()
        for i, spans in found.items():
            out, at, last = [], 0, 0
            for s, k, e in spans:
                if s >= last:
                    out += [rows[i][at:s], f"[{kinds[k]}]"]
                last = at = max(last, e)
            rows[i] = "".join([*out, rows[i][at:]])
        return [pa.array(rows, pa.string())]

    out = _with_spans(docs, rules, "text string", build)
    columns = []
    for c in docs.columns:
        was = F.col("row").getField(c)
        if c == "text":
            was = F.col("text")
        elif c == "n_chars":
            changed = ~F.col("row").getField("text").eqNullSafe(F.col("text"))
            was = F.when(changed, F.length("text")).otherwise(was).cast(docs.schema[c].dataType)
        columns.append(was.alias(c))
    return out.select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of base spans, and all spans as text, one row per row of (doc_id, text)."""
    found = find_secrets(docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    base = [r.kind for r in RULES[:BASE]]

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )
