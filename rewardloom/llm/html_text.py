"""Main text of pages: differencing against the page with the nearest URL, with markup as guard and for the rest.

A page becomes lines (blocks of visible text, menus and footers included). The page that follows on the same host in URL order,
or comes before for the last one, is its pair: lines of both are aligned by longest common subsequence, and shared ones
are the host's template and go. Lines inside an article element are the author's, whoever else prints them, and stay. Of what
is left, lines go that markup itself names as something else (menus, sidebars, notices, adverts, forms, comments, hidden
parts), which need not be the same on two pages. A page with an article element but without a pair, or copied by it, keeps what
the element holds.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import small_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "head", "math", "canvas", "object"}
_APART = {"nav", "footer", "aside", "form", "button", "dialog", "menu"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp",
           "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NAMES = {"ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
          "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related",
          "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"}


# A class such as ad-slot or site-nav says the same as its name; has-sidebar and share-price say something else.
_HOLDERS = {"area", "bar", "block", "box", "buttons", "container", "content", "inner", "item", "items", "link", "links", "list", "section", "slot", "widget", "wrap", "wrapper"}
_ABOUT = {"has", "is", "no", "not", "with", "without"}
_CLOSED_BY_NEXT = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _names_other(token: str, names: set[str]) -> bool:
    """Whether a whole class or id names a part that is no main text."""
    parts = [p for p in re.split(r"[-_]+", token) if p]
    if not parts or parts[0] in _ABOUT:
        return False
    return parts[-1] in names or (parts[0] in names and all(p in _HOLDERS for p in parts[1:]))


def _left_out(name: str, attributes: str, inside: bool) -> bool:
    if name in _APART or (name == "header" and not inside):
        return True
    if not attributes.strip() or name in ("html", "body", "main", "article"):
        return False
    names = _NAMES if inside else _NAMES | {"header"}
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if any(_names_other(t, names) for t in value.split()):
                return True
        elif key == "role" and value in _ROLES or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def page_lines(page: str) -> tuple[list[str], list[bool], list[bool]]:
    """Lines of a page, which of them lie in its article (or main) element, and which markup names as no main text.

    An element that holds the article is never left out; where articles lie both inside and outside of such elements, those
    outside are meant.
    """
    wanted = "article" if re.search(r"<article[\s>]", page, re.I) else "main" if re.search(r"<main[\s>]", page, re.I) else ""
    found = _read(page, wanted, False)
    if wanted and not any(found[1]):
        found = _read(page, wanted, True)
    return found


def _read(page: str, wanted: str, opened: bool) -> tuple[list[str], list[bool], list[bool]]:
    """``opened``: an article ends the leaving out of what is around it."""
    lines: list[str] = []
    marks: list[bool] = []
    others: list[bool] = []
    held: list[str] = []
    kept: list[str] = []  # of the sentence around an inline element that is left out
    stack: list[str] = []  # open elements that are neither inline nor left out
    inside = 0
    skipped, depth, within = "", 0, []  # the element being left out, how often it is open, what is open inside it
    at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append(text)
            marks.append(inside > 0 and not skipped)
            others.append(bool(skipped))

    def leave() -> None:
        nonlocal skipped
        close()
        skipped = ""
        held.extend(kept)
        kept.clear()

    for tag in _TAG.finditer(page):
        if tag.start() < at:
            continue
        held.append(page[at: tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        name, ends = tag[2].lower(), bool(tag[1])
        alone = name in _VOID or tag[3].endswith("/")
        if name in _RAW and not ends and not alone:
            after = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = after.end() if after else len(page)
            continue
        flows = name in _INLINE or name == "button"
        if skipped and not ends and not flows and depth == 1 and skipped in _CLOSED_BY_NEXT and name in (_CLOSED_BY_NEXT[skipped] or {name}):
            leave()  # its end tag is implied
        if skipped and opened and name == wanted and not ends:
            leave()
        if skipped:
            if not flows:
                close()
            if alone:
                continue
            if name == skipped:
                depth += -1 if ends else 1
                if not depth:
                    leave()
                continue
            if not ends:
                if not flows:
                    within.append(name)
                continue
            if flows or name in within:
                if name in within:
                    del within[len(within) - 1 - within[::-1].index(name):]
                continue
            if name not in stack:
                continue
            leave()  # an element around it ends, so it has ended too
        if not flows:
            close()
        if not ends and not alone and _left_out(name, tag[3], inside > 0):
            if flows:
                kept.extend(held)
                held.clear()
            skipped, depth, within = name, 1, []
            continue
        if name == wanted:
            inside = max(0, inside + (-1 if ends else 1))
        if not flows and not alone:
            if not ends:
                stack.append(name)
            elif name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name):]
    held.append(page[at:])
    if skipped:
        leave()
    close()
    return lines, marks, others


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``, bit-parallel."""
    match: dict[int, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & match.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((full ^ v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``; linear memory, by halving ``a``."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, p, q = todo.pop()
        while lo < hi and p < q and a[lo] == b[p]:
            out.append(lo)
            lo, p = lo + 1, p + 1
        while lo < hi and p < q and a[hi - 1] == b[q - 1]:
            hi, q = hi - 1, q - 1
            out.append(hi)
        if lo == hi or p == q:
            continue
        if hi - lo == 1:
            if a[lo] in b[p:q]:
                out.append(lo)
            continue
        mid = (lo + hi) // 2
        front = _lengths(a[lo:mid], b[p:q])
        back = _lengths(a[mid:hi][::-1], b[p:q][::-1])[::-1]
        cut = p + int((front + back).argmax())
        todo += [(lo, mid, p, cut), (mid, hi, cut, q)]
    return sorted(out)


def _line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line) - (1 << 63)


def _kept(lines: list[str], marks: list[bool], others: list[bool], hashes: list[int], other: list[int] | None) -> str:
    """Text of a page, given the line hashes of its pair."""
    shared = set(common_lines(hashes, other)) if other else set()
    main = [i for i, o in enumerate(others) if not o]
    if other and any(i not in shared for i in main):  # else it is a copy
        main = [i for i in main if marks[i] or i not in shared]
    elif any(marks):
        main = [i for i in main if marks[i]]
    return "\n".join(lines[i] for i in main)


_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = _HOST + r"(?::[0-9]*)?([^?#]*)"
_KEY = ("host", "path", "url", "pid", "mark")  # the order of pages; only equal rows are equal in all


def _edges(batches):
    """First and last key of a range."""
    from pyspark import TaskContext

    part, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    for place, row in enumerate((first, last)):
        if row is not None:
            yield pa.record_batch([pa.array([part]), pa.array([place]), *row.columns], names=["part", "place", *_KEY])


def _dealt(firsts: list[tuple], guests: dict[tuple, list[int]]):
    """Pages to their range, and those at a border to the neighbouring range as guests."""

    def run(batches):
        for batch in batches:
            rows, buckets, guest = [], [], []
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(_KEY))), strict=True)):
                own = bisect_right(firsts, key) - 1
                for bucket in (own, *guests.get(key, ())):
                    rows.append(i)
                    buckets.append(bucket)
                    guest.append(bucket != own)
            yield pa.record_batch([pa.array(buckets, pa.int64()), pa.array(guest, pa.bool_()), *batch.take(pa.array(rows, pa.int64())).columns],
                                  names=["bucket", "guest", *batch.schema.names])

    return run


def _compared(batches):
    """Pages of whole ranges in order: bucket, guest, the key, page_id, html to page_id, url, text."""

    def pages():
        for batch in batches:
            names = batch.schema.names
            host, bucket, guest, html_at = (names.index(n) for n in ("host", "bucket", "guest", "html"))
            columns = [batch.column(k).to_pylist() for k in (bucket, guest, host, html_at)]
            for i, (b, g, h, page) in enumerate(zip(*columns, strict=True)):
                found = page_lines(page)
                yield (b, h), g, batch.slice(i, 1), found, [_line_hash(x) for x in found[0]]

    def told(page, pair):
        _, _, row, found, hashes = page
        text = _kept(*found, hashes, pair[4] if pair else None)
        return row.column(row.schema.names.index("page_id")), row.column(row.schema.names.index("url0")), text

    def one(page, before, after):
        same = [x for x in (after, before) if x is not None and x[0] == page[0]]
        return told(page, same[0] if same else None)

    held, before, now = [], None, None
    for after in pages():
        if now is not None and not now[1]:
            held.append(one(now, before, after))
        before, now = now, after
        if len(held) >= 500:
            yield _batch(held)
            held = []
    if now is not None and not now[1]:
        held.append(one(now, before, None))
    if held:
        yield _batch(held)


def _batch(rows):
    return pa.record_batch([pa.concat_arrays([r[0] for r in rows]), pa.concat_arrays([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string())],
                           names=["page_id", "url", "text"])


def _alone(batches):
    for batch in batches:
        texts = []
        for page in batch.column(2).to_pylist():
            texts.append(_kept(*page_lines(page or ""), [], None))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, range_pages: int = 1000) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    Returns page_id, url, text, n_chars. Null or empty html gives an empty text and is nobody's pair. A page without
    a usable url, or alone on its host, has no pair; a page all of whose lines are shared is a copy. Both lose the lines
    outside their article element, or none without such an element. Repeated rows are pages of their own; other columns are not looked at.

    The keys are put in order first, in ranges of about ``range_pages`` pages; a host of any size is many ranges. Then
    pages move to their range once, with the one page on either side of each border, and are compared there.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    result = f"page_id {kind}, url string, text string"
    rows = pages.select(
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1)).alias("host"),
        F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _PATH, 2).alias("path"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("pid"),
        F.xxhash64(F.col("html").cast("string")).alias("mark"), "page_id", F.col("url").cast("string").alias("url0"), F.col("html").cast("string").alias("html"),
    )
    paired = rows.where("host != '' and trim(html) != ''")
    lone = rows.where("host = '' or html is null or trim(html) = ''").select("page_id", "url0", "html").mapInArrow(_alone, result)
    keys = paired.select(*_KEY)
    ranges = max(1, -(-paired.count() // range_pages))
    edges = keys.repartitionByRange(ranges, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(
        _edges, "part long, place long, host string, path string, url string, pid string, mark long")
    found: dict[int, dict[int, tuple]] = {}
    for r in edges.collect():  # two keys per range
        found.setdefault(r["part"], {})[r["place"]] = tuple(r[c] for c in _KEY)
    order = sorted(found)
    firsts = [found[p][0] for p in order]
    guests: dict[tuple, list[int]] = {}
    for i in range(1, len(order)):
        before, after = found[order[i - 1]][1], firsts[i]
        if before[0] == after[0]:
            guests.setdefault(after, []).append(i - 1)
            guests.setdefault(before, []).append(i)
    types = "host string, path string, url string, pid string, mark long"
    dealt = paired.mapInArrow(_dealt(firsts, guests), f"bucket long, guest boolean, {types}, page_id {kind}, url0 string, html string")
    compared = dealt.repartition("bucket").sortWithinPartitions("bucket", *_KEY).mapInArrow(_compared, result)
    return compared.union(lone).withColumn("n_chars", F.length("text").cast("long"))
