import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tracewell.llm import html_text, sentence_pieces, token_counts

SF = "/root/testdata/sf0.001"
PARTS = ["the ", "  ", "        ", "a", "b", "\n", "é", "日本", "😀", "<s>", "<0x41>", "▁", "\t", "1", "99", "!!", "ing", "tion", "   x", " "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(sentence_pieces.model_path())


def samples(n=150, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)] + [" " * k for k in range(40)]


def chunked(p, text, size):
    s = p.normal(text)
    parts, matrices = [], []
    for k, lo in enumerate(range(0, len(s), size)):
        hi, left = min(len(s), lo + size), max(0, lo - p.longest)
        parts.append((s[left : hi + p.longest], lo - left, hi - left))
        matrices.append(sentence_pieces.transfer(p, *parts[-1], k == 0, hi == len(s)))
    path = sentence_pieces.cuts(matrices)
    return [i for a, u, v in zip(parts, path, path[1:], strict=False) for i in sentence_pieces.traced(p, *a, u, v)], matrices


def test_encode_is_the_librarys(library, pieces):
    for t in samples():
        assert np.frombuffer(pieces.encode(t), "<u4").tolist() == library.encode(t)


@pytest.mark.parametrize("size", [5, 33])
def test_chunks_are_the_librarys(library, pieces, size):
    for t in samples(80):
        assert chunked(pieces, t, size)[0] == library.encode(t)


def test_unigram_weights(library):
    """The same pieces as a unigram model: the scan's weight is the best over all segmentations."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(sentence_pieces.model_path(), "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    p = sentence_pieces.Pieces.of(model)
    for t in ["nothing in the tin", "in tin n"]:
        s = p.normal(t)
        best = [0.0] + [float("-inf")] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max(best[b] + p.weight(0, i) for b in range(e) if (i := p.piece(s[b:e])) is not None)
        ids, matrices = chunked(p, t, 4)
        assert sum(p.scores[i] for i in ids) == pytest.approx(best[-1])
        total = matrices[0]
        for m in matrices[1:]:
            total = sentence_pieces.combine(total, m)
        right = matrices[-1]
        for m in matrices[-2::-1]:
            right = sentence_pieces.combine(m, right)
        flat = lambda m: {(s, e): w for s, row in m.items() for e, w in row.items()}
        assert flat(total) == pytest.approx(flat(right))


def test_round_trip(spark, library):
    rows = [(1, "The cat  sat.\n", "x"), (2, None, "y"), (3, "", "z"), (4, "word and more of it " * 200, "w"), (4, "word and more of it " * 200, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sentence_pieces.decode(sentence_pieces.encode(docs, chunk=1000)).collect()
    assert len(got) == 5
    for r in got:
        assert r.decoded == (r.text or "") and list(r.ids) == library.encode(r.text or "")
    assert sentence_pieces.encode(docs.limit(0)).count() == 0
    assert sentence_pieces.op1_sentencepiece(spark, SF).where("NOT round_trip").count() == 0


def test_token_counts(spark, library):
    trie = token_counts.Trie(sentence_pieces.pieces_of(sentence_pieces.model_path()), nodes=500)
    for t in samples():
        assert trie.tokens(t)[0] == len(library.encode(t))
    docs = spark.createDataFrame([(1, "The cat", 5), (2, None, 6), (2, "", 7)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in token_counts.count(docs).collect()) == [0, 0, len(library.encode("The cat"))]
    assert token_counts.count(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header class="site"><h1>My Site</h1><a href=/>Home</a></header>
<div class=cookie-notice>We use cookies on this site to make it work.</div><main><article><header><h1>Title here</h1><p class=byline>By Someone</p></header>
<p>First para with <a href=x>a link</a> &amp; more&nbsp;text.</p><p>Short.</p><div class="advert">Buy now this thing please</div><form><input><label>Mail</label></form>
<p>Second para<br>line two</p><ul><li>Item one is here</li><li>Item two</li></ul><aside>Related: foo</aside>
<section id="comments"><h2>Comments</h2><p>Great article, I liked it so much!</p></section></article></main><footer>(c) me</footer><script>if(a<b){}</script></body></html>"""


def test_page():
    assert html_text.main_text(PAGE).split("\n") == ["Title here", "First para with a link & more text.", "Short.", "Second para line two", "Item one is here", "Item two"]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- x", "<script>x", "<div " + 'a="' * 200, "</p></div>", "<p>" * 3000])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_given_pages(spark):
    """In the given pages the text is that of the article element, one block an h1 or p."""
    import html
    import re

    rows = html_text.op4_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "<article><p>Hello there all of you</p></article>", "v"), (2, "", "w")], "page_id long, html string, text string")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "", "Hello there all of you"]
    assert html_text.extract(pages.limit(0)).where(F.col("text") != "").count() == 0


@pytest.mark.parametrize("n", [10, 8_000, 9_000, 300_000])
@pytest.mark.parametrize("q", "\"'")
def test_long_attributes(n, q):
    long = f"data-props={q}{'b > a hidden ' * (n // 13 + 1)}{q}"
    text = "This is the text of the page, and it is long enough to be kept as text."
    aside = "Something quite different that stands beside the text, of some length as well."
    page = f"<article><p {long}>{text}</p><div {long} class=sidebar><p>{aside}</p></div><div {long} hidden><p>{aside}</p></div></article>"
    assert html_text.main_text(page) == text


def test_quotes_that_never_close():
    assert [b.text for b in html_text.blocks("<p title=\"a>one two</p><p b='c>three</p>")] == ["one two", "three"]
    start = time.process_time()
    for part in ("<p a=\"'>x ", "<p a='\">\"' ", "<i \"'> "):
        html_text.blocks(part * 100_000 + "'")
        html_text.blocks(part * 100_000 + "\"'")
    assert time.process_time() - start < 60


TEXT = "This is the text of the page, and it is long enough to be kept as text."
MORE = "Something quite different that stands in the same place, of some length as well."


@pytest.mark.parametrize("page", [
    f"<head><title>x</title><body><article><p>{TEXT}</p></article>",
    f"<html><head><meta charset=utf-8><title>x</title><article><p>{TEXT}</article>",
    f"<head><style>p {{}}</style></head><article><p>{TEXT}",
    f"<!doctype html><title>x</title><article><p>{TEXT}</article><footer><p>{MORE}",
])
def test_end_tags_may_be_left_out(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["share-price", "widget-review", "sharePrice", "no-comments", "has-sidebar", "notice-period"])
def test_names_are_judged_whole(name):
    for attribute in (f'class="{name}"', f"id={name}", f'class="wide {name}"'):
        assert html_text.main_text(f"<article><p>{TEXT}</p><div {attribute}><p>{MORE}</p></div></article>") == f"{TEXT}\n{MORE}"


@pytest.mark.parametrize("name", ["share-buttons", "sidebar-widget", "cookie-banner", "comment-list", "comment-17", "related-posts", "newsletterSignup", "ad", "site-footer"])
def test_names_of_what_stands_beside(name):
    assert html_text.main_text(f"<article><p>{TEXT}</p><div class='{name}'><p>{MORE}</p></div></article>") == TEXT


def test_inline_adverts_leave_their_paragraph_whole():
    assert html_text.main_text(f"<article><p>{TEXT} <b class=ad>Buy now</b> {MORE}</p></article>") == f"{TEXT} {MORE}"


def test_very_long_page():
    page = "<nav><a href=/>Home</a></nav><article>" + f"<p>{TEXT}</p><div class=share-price>{MORE}</div>" * 20_000 + "</article><footer>end</footer>"
    assert html_text.main_text(page) == "\n".join([TEXT, MORE] * 20_000)


def test_long_pretokens_go_through_the_trie(spark, library):
    r = random.Random(8)
    texts = ["x" * 70, "ab" * 4000 + " tail", "".join(r.choice("abcdeé日1") for _ in range(6000)), " ".join("".join(r.choice("thein") for _ in range(r.randint(60, 90))) for _ in range(40))]
    for nodes in (50, token_counts.NODES):
        trie = token_counts.Trie(sentence_pieces.pieces_of(sentence_pieces.model_path()), nodes=nodes)
        assert [n for n, _ in trie.count(texts)] == [len(library.encode(t)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.count(docs).orderBy("doc_id").collect()] == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("chunk", [300, sentence_pieces.CHUNK])
def test_digest_of_giant_texts(spark, library, chunk):
    """More chunks than one block combines; texts at the real chunk size; null ids and repeated rows."""
    r = random.Random(6)
    long = " ".join("".join(r.choice("theinoa,.é") for _ in range(r.randint(1, 12))) for _ in range(12_000))
    rows = [(1, long), (None, long), (2, "x" * 40_000), (3, "short"), (3, "short"), (4, None), (5, " " * 33_000 + "end")]
    want = sorted(((i, len(t or ""), len(ids := library.encode(t or "")), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in rows), key=repr)
    assert len(long) > 64 * 300
    got = sentence_pieces.digest(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == want
