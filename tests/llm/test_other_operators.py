"""Vectors, conversations, pages and the pipeline against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rewardloom.llm import chat, html_text, near_vectors

SF = "/root/testdata/sf0.001"


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 16))
    rows = [(i, (centre[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25])).tolist(), 1) for i in range(150)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [1.0] * 15 + [None], 0), (204, [float("nan")] * 16, 0), (205, [float("inf")] + [1.0] * 15, 0),
             (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (None, rows[0][1], 0), (208, [1e300] * 16, 0), (209, [1e-300] * 16, 0), (3, rows[3][1], 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component long").withColumn("node", F.lit(1))

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [(i, unit(v)) for i, v, _ in rows]
    near = [[j for j, (b, y) in enumerate(units) if j != k and None not in (a, b) and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= 0.95]
            for k, (a, x) in enumerate(units)]
    up = {i: i for i, _, _ in rows if i is not None}
    for _ in range(len(rows)):
        for k, js in enumerate(near):
            for j in js:
                up[rows[k][0]] = up[rows[j][0]] = min(up[rows[k][0]], up[rows[j][0]])
    want = sorted((i is None, i or 0, len(near[k]), None if i is None else up[i]) for k, (i, _, _) in enumerate(rows))
    got = near_vectors.near_vectors(frame, side=16).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_reply_tree_paths_scores_and_mask(spark):
    rows = [  # conv, node, parent, role, text, score
        (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 5.0), (1, 5, 3, "user", None, None),
        (2, 7, 99, None, "<|im_start|>x\\<|im_end|>", 0.0), (2, 8, 7, "a\nb<|", "\\<\\|", 0.0), (None, 1, None, "user", "n", 1.0), (None, 2, 1, "assistant", "<\\n", 1.0),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit("x"))
    out = {(r.conv_id, r.branch): r for r in chat.format_conversations(messages).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert {k: [tuple(t) for t in r.back] for k, r in out.items()} == {
        (1, 1): [("user", "hi"), ("assistant", "a"), ("user", "c")], (1, 2): [("user", "hi"), ("assistant", "b"), ("user", "")],
        (2, 1): [("", "<|im_start|>x\\<|im_end|>"), ("a\nb<|", "\\<\\|")], (None, 1): [("user", "n"), ("assistant", "<\\n")],
    }
    assert out[1, 1].score == 6.0 and out[1, 2].score == 2.0
    assert [out[1, 1].formatted[s.start: s.end] for s in out[1, 1].loss_spans] == ["a"] and out[2, 1].loss_spans == []
    best = chat.format_conversations(messages, branches=1)
    assert best.count() == 3
    digests = chat.digest(best.where("conv_id is null")).first()
    assert digests.loss_sha256 == hashlib.sha256(b"<\\n").hexdigest() and digests.n_turns == 2
    assert chat.format_conversations(messages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="circle"):
        chat.reply_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "conv_id long, node_id long, parent_id long, score double"))


def test_chains_order_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "z"), (1, 1, "assistant", "z"), (2, None, None, None)]
    got = {r.conv_id: r.formatted for r in chat.format_conversations(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].count("<|im_start|>") == 4 and got[1].index("\na<") < got[1].index("\nb<") and got[2] == "<|im_start|>\n<|im_end|>\n"


@given(st.text("\\<|>n\n", max_size=12))
def test_escape_is_reversible(text):
    safe = text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in safe and safe.replace("<\\|", "<|").replace("\\\\", "\\") == text


@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_lines_are_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = html_text.common_lines(a, b)
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(any(y == a[i] for y in rest) for i in found)


def test_pages_lose_template_lines_and_nothing_else(spark):
    def page(body):
        return f"<html><head><title>t</title></head><body><div>Site name</div><div>About us</div>{body}<div>All rights reserved</div></body></html>"

    rows = [
        (1, "http://h.com/a/1", page("<p>One &amp; only.</p><p>Second<br>third</p>")), (2, "http://h.com/a/2?x=1", page("<p>Other  \n text</p>")),
        (3, "http://h.com/a/3", page("<nav>menu</nav><p>More<script>var x='</p>'</script> text</p><div class='site-comments'><p>first!</p></div>")),
        (4, "https://g.com/x", page("<p>Alone</p>")), (5, None, page("<p>No url</p>")), (6, "http://h.com/a/9", None), (7, "http://k.com/1", "<p>same</p>"),
        (8, "http://k.com/2", "<p>same</p>"), (9, "http://m.com/1", "<div>top</div><article><header><h1>T</h1></header><p>shared line</p></article><footer>f</footer>"),
        (10, "http://m.com/2", "<div>top</div><article><p>shared line</p><aside>x</aside><p>own"), (None, "http://n.com/", "just text &copy; &nbsp; here"), (1, "http://h.com/a/1", ""),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1))
    got = html_text.main_text(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got if r.text}
    whole = "Site name\nAbout us\n{}\nAll rights reserved"
    assert text[2] == "Other text" and text[3] == "More text" and text[4] == whole.format("Alone") and text[5] == whole.format("No url")
    assert text[7] == text[8] == "same" and text[9] == "T\nshared line" and text[10] == "shared line\nown" and text[None] == "just text © here"
    assert 6 not in text
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_differencing_decides_outside_the_article(spark):
    """Lines outside an article element are compared, not dropped; those inside stay, shared or not."""
    def page(lead, body):
        return f"<div>Site name</div><p>{lead}</p><article><p>Notice</p><p>{body}</p></article><div>All rights reserved</div>"

    rows = [(1, "http://h.com/1", page("Lead one", "a")), (2, "http://h.com/2", page("Lead two", "b")), (3, "http://k.com/1", page("Lead", "c")),
            (4, "http://m.com/1", page("Lead", "d")), (5, "http://m.com/2", page("Lead", "d"))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Lead one\nNotice\na", 2: "Lead two\nNotice\nb", 3: "Notice\nc", 4: "Notice\nd", 5: "Notice\nd"}


@pytest.mark.parametrize(("page", "text"), [
    ('<div class="page has-sidebar"><article><p>a</p></article></div>', "a"), ("<form><article><p>a</p></article></form>", "a"),
    ("<nav><a>menu</a><article><p>a</p></article>", "a"), ('<article><p class="share-price">42</p><section id="comment-on-the-law"><p>b</p></section></article>', "42\nb"),
    ('<article><p class="ad">buy<p>a</p><p>b</p></article><p>after', "a\nb"), ("<article><p>one <button>go</button> sentence</p></article>", "one sentence"),
    ('<article><p>one <span class="ad">buy</span>sentence</p><ul><li class="ad">x<li>y</ul></article>', "one sentence\ny"),
    ("<article><p>a</p></article><aside><article><p>teaser</p></article></aside>", "a"), ('<div class="ad-slot"><p>x</p></div><article><nav>m<p>n</article><p>z', "z"),
    ('<article><div class="site-nav">m</div><p>a</p><div class="cookie-banner"><div>c</div>d</div></article>', "a"), ("<article><form><p>x</article>", ""), ("<p>a</nav></div>b", "a\nb"),
])
def test_broken_and_unusual_markup(page, text):
    lines, marks, others = html_text.page_lines(page)
    assert html_text._kept(lines, marks, others, [], None) == text


def test_differencing_removes_menus_and_footers():
    """What markup would drop anyway is compared first: here every menu line goes by the pair."""
    def page(i):
        return f"<nav><a>Home</a><p>News</p></nav><article><p>text {i}</p></article><footer>imprint</footer>"

    one, two = html_text.page_lines(page(1)), html_text.page_lines(page(2))
    gone = html_text.common_lines([hash(x) for x in one[0]], [hash(x) for x in two[0]])
    assert [one[0][i] for i in gone] == ["Home", "News", "imprint"]


@pytest.mark.parametrize("range_pages", [7, 1000])
def test_pairs_do_not_depend_on_ranges(spark, range_pages):
    """The next page of the host, or the one before for the last, wherever ranges begin; one host has most pages."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        host, path = rng.choice(["h0", "h0", "h0", "h1", "h2"]), f"/p{rng.randint(0, 99):02d}"
        lines = [f"line {rng.randint(0, 5)}" for _ in range(rng.randint(1, 6))] + [f"own {i}"]
        rows.append((i, f"http://{host}{path}", "".join(f"<p>{x}</p>" for x in lines)))
    keys = sorted((u, str(i), i) for i, u, _ in rows)
    lines = {i: re.findall("<p>(.*?)</p>", h) for i, _, h in rows}
    want = {}
    for k, (u, _, i) in enumerate(keys):
        pair = next((keys[j][2] for j in (k + 1, k - 1) if 0 <= j < len(keys) and keys[j][0].split("/")[2] == u.split("/")[2]), None)
        gone = set(html_text.common_lines(lines[i], lines[pair])) if pair is not None else set()
        want[i] = "\n".join(x for n, x in enumerate(lines[i]) if n not in gone)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = html_text.main_text(frame, range_pages).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_main_text_of_given_pages(spark):
    import html as entities

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"<(/?(p|h1|br)\b)[^>]*>", "\0", body))
        assert got[r.page_id] == "\n".join(x for x in (" ".join(entities.unescape(z).split()) for z in body.split("\0")) if x)


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op2_repeated_passages", "op3_chat_format", "op8_minhash_near_dedup", "op11_merkle_manifest", "op12_rotated_codes", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    from checks.compare import check, connect
    from rewardloom.llm.queries import ORACLES, QUERIES

    status, _, _, _, note = check(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert status == "ok", note


def test_pipeline_equals_plain_version(spark):
    import corpus_pipeline
    from rewardloom.llm import decontaminate, language
    from rewardloom.llm.tokens import Encoder, vocabulary_path
    from tests.llm.test_text_operators import crc, near_by_hand, secrets_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = [(r.doc_id, r.text) for r in language.identify(docs).where("not rejected").select("doc_id", "text").collect()]
    groups = near_by_hand(known, 80)
    known = [(i, t) for i, t in known if groups[i] == i]
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = [(i, t) for i, t in known if not any(x in decontaminate.normalised(t) for x in items)]
    tokenizer = Encoder(vocabulary_path("word_bpe_49k.json"), False)
    want = []
    for i, t in known:
        out, at = [], 0
        for kind, s, e in secrets_by_hand(t):
            if s >= at:
                out += [t[at:s], f"[{kind}]"]
            at = max(at, e)
        ids = [*tokenizer.whole("".join(out) + t[at:]), 1]
        want += [(i, k, len(ids[a: a + 4096]), crc(ids[a: a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    got = [(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
