"""Benchmark passages in documents: pigeonhole pieces, then bit-parallel edit distance.

Texts are compared in lower case with every run of other characters than letters and digits as one blank.
An item of m characters may be altered by k = m // 10 edits; cut into k + 1 pieces, at least one of them is
unharmed in any such copy. One automaton finds all pieces in one pass over a document. A hit is checked
with Myers' bit-parallel distance on growing groups of neighbouring pieces (a group of s pieces may have s - 1
edits), so that chance hits end after a few characters, and at last on the whole item.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import small_batches

EDIT_SHARE = 10  # one edit in so many characters
SHORT_ITEM = 24  # shorter items count only as they are, between blanks
BLOCK_CHARS = 4 << 20  # item characters per automaton: a block of the benchmark at a time
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def normalised_with_places(text: str) -> tuple[str, list[int]]:
    """The normalised text, and for each of its characters the place in ``text``; the last entry is the end."""
    out, places = [], []
    for at, c in enumerate(text):
        for low in c.lower():
            if low.isalnum():
                out.append(low)
            elif out and out[-1] != " ":
                out.append(" ")
            else:
                continue
            places.append(at)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), [*places, places[-1] + 1 if places else 0]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def best_end(mask: dict[str, int], size: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edits between the pattern and any stretch of ``text``, and the first end where it occurs; None above ``most``."""
    ones = (1 << size) - 1
    top = 1 << (size - 1)
    up, down, score, best, end = ones, 0, size, size, 0
    get = mask.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        h = down | (ones & ~(d | up))
        v = up & d
        if h & top:
            score += 1
        elif v & top:
            score -= 1
        h = h << 1 & ones
        v = v << 1 & ones
        up = v | (ones & ~(x | h))
        down = h & x
        if score < best:
            best, end = score, i + 1
    return (best, end) if best <= most else None


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    edits: int
    cuts: list[int]  # piece borders
    _masks: dict[tuple[int, int], dict[str, int]] = field(default_factory=dict, compare=False)

    def mask(self, lo: int, hi: int) -> dict[str, int]:
        if (lo, hi) not in self._masks:
            self._masks[lo, hi] = masks(self.text[lo:hi])
        return self._masks[lo, hi]

    def found_at(self, text: str, place: int, piece: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best copy around the piece that begins at ``place`` of ``text``, if one is near enough."""
        cuts, pieces = self.cuts, self.edits + 1
        width = 2
        while width < pieces:
            a = piece // width * width
            b = min(a + width, pieces)
            lo, hi, most = cuts[a], cuts[b], b - a - 1
            origin = place - (cuts[piece] - lo)
            if best_end(self.mask(lo, hi), hi - lo, text[max(origin - most, 0): origin + (hi - lo) + most], most) is None:
                return None
            width *= 2
        size, most = len(self.text), self.edits
        origin = place - cuts[piece]
        left = max(origin - most, 0)
        found = best_end(self.mask(0, size), size, text[left: max(origin, 0) + size + most], most)
        if found is None:
            return None
        end = left + found[1]
        back = best_end(masks(self.text[::-1]), size, text[max(end - size - most, 0): end][::-1], most)
        return found[0], end - (back[1] if back else size), end


def prepared(item_id: int, text: str | None) -> Item | None:
    """None for an item without a letter or digit: it is in no document."""
    plain = normalised(text or "")
    if not plain:
        return None
    edits = len(plain) // EDIT_SHARE if len(plain) >= SHORT_ITEM else 0
    return Item(item_id, plain, edits, [len(plain) * k // (edits + 1) for k in range(edits + 2)])


class Finder:
    """All items of a block over one text."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        import ahocorasick

        self.items = [i for i in (prepared(*r) for r in rows) if i is not None]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for p in range(item.edits + 1):
                owners.setdefault(item.text[item.cuts[p]: item.cuts[p + 1]], []).append((n, p))
        self.automaton = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.automaton.add_word(piece, (len(piece), of))
        if owners:
            self.automaton.make_automaton()

    def search(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number to its best copy in the normalised ``text``: (edits, start, end), the first of equals."""
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        if not self.items or not text:
            return best
        for last, (size, of) in self.automaton.iter(text):
            place = last - size + 1
            for n, p in of:
                item = self.items[n]
                if not item.edits:
                    at = place, place + size
                    whole = (at[0] == 0 or text[at[0] - 1] == " ") and (at[1] == len(text) or text[at[1]] == " ")
                    if whole and n not in best:
                        best[n] = (0, *at)
                    continue
                origin = place - item.cuts[p]
                if n in best and best[n][1] - item.edits <= origin <= best[n][1] + item.edits and best[n][0] == 0:
                    continue  # inside an exact copy
                if (n, origin, p) in seen:
                    continue
                seen.add((n, origin, p))
                found = item.found_at(text, place, p)
                if found is not None and (n not in best or found[:2] < best[n][:2]):
                    best[n] = found
        return best


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items (item_id, text) found in documents (doc_id, text).

    One row per row of ``docs`` and item in it: doc_id, item_id, edits (least number), start and end_ (code points of
    the whole text, of the first best copy). Null or empty texts hold nothing and are held by nothing; repeated
    rows give repeated hits; rows without an id are reported with a null one; other columns are not looked at.
    The benchmark is read in blocks of bounded size, each compiled into one automaton; an empty one gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, start long, end_ long"
    out = None
    for block in _blocks(items):
        found = texts.mapInArrow(_search(block), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(items: DataFrame):
    """Rows of the benchmark in lists of at most about ``BLOCK_CHARS`` characters."""
    block, chars = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"] or "") + 16
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _search(block: list[tuple[int, str | None]]):
    def run(batches):
        finder = Finder(block)
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = finder.search(normalised(text))
                if found:
                    plain, places = normalised_with_places(text)
                    for n, (edits, start, end) in sorted(found.items()):
                        last = places[max(end - 1, 0)] + 1
                        rows.append((d, finder.items[n].item_id, edits, places[min(start, len(plain))], last))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end_"])

    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, as they are; null and empty texts stay."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for block in _blocks(items):
        docs = docs.mapInArrow(_clean(block, docs.columns.index("text")), docs.schema)
    return docs


def _clean(block: list[tuple[int, str | None]], at: int):
    def run(batches):
        finder = Finder(block)
        for batch in batches:
            keep = [not text or not finder.search(normalised(text)) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
