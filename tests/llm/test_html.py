"""HTML extraction: the cut against all labellings, the blocks, and whole pages."""

import random
import re
import time
from html import unescape
from itertools import product

import numpy as np
import pytest

from tabsift.llm import html_blocks, html_text
from tabsift.llm.html_blocks import blocks_of, tree_distance
from tabsift.llm.html_table import labelled_pages


def energy(labels, costs, edges):
    return sum(b if x else a for x, (a, b) in zip(labels, costs)) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])


def test_cut_against_all_labellings():
    r = np.random.default_rng(2)
    for _ in range(150):
        n = int(r.integers(1, 9))
        costs = [tuple(x) for x in r.gamma(1, 1, (n, 2))]
        edges = {(i, j): float(r.gamma(1, 1)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        found = html_text.minimum_cut(costs, edges)
        best = min(energy(x, costs, edges) for x in product((False, True), repeat=n))
        assert energy(found, costs, edges) == pytest.approx(best, abs=1e-6)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No &amp; no</title><script>var t="</p><p>x";</script></head><body>
    <p>One <b>bold</b>&nbsp;text<br>more</p><p>un<i>closed<p>next &lt;p&gt; &#233; <a href="/a>b">li nk</a></p><!-- <p>gone</p> --><div
    class='x'>div <span>in</span>line</div><style>p{}</style>tail<ul><li>a<li>b</ul><p>   </p></body></html>"""
    found = blocks_of(page)
    assert [b.text for b in found] == ["One bold text more", "unclosed", "next <p> é li nk", "div inline", "tail", "a", "b"]
    assert found[2].linked == 5 and found[0].linked == 0
    assert tree_distance(found[5].element, found[6].element) == 2
    assert blocks_of(None) == [] and blocks_of("") == [] and [b.text for b in blocks_of("a < b")] == ["a < b"]
    assert [b.text for b in blocks_of("<p>x<script>never closed <p>y")] == ["x"]


def test_unseen_labelled_pages():
    wrong = total = 0
    weights = html_text.trained()
    for page, labels in labelled_pages(40, seed=5):
        blocks = blocks_of(page)
        side = html_text.minimum_cut([html_text.capacities(b, weights) for b in blocks], html_text.smoothness(blocks))
        wrong += sum(int(a) != b for a, b in zip(side, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total


def article_text(page):
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S).group(1))
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_text.extracted(pages).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert r["text"] == article_text(given[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_handmade_page():
    page = ("<body><header><h2>Site</h2></header><div id='cookie-banner'><p>We use cookies.</p></div><main><h1>Title</h1><p>First words of the story, long enough.</p>"
            "<div class='ad'>Buy now</div><p>Second part of the story follows here.</p><form><label>Name</label><button>Go</button></form></main>"
            "<section class='comments'><p>Nice story, I liked it very much!</p></section><aside>See also</aside><footer>Copyright 2020</footer></body>")
    assert html_text.main_text(page) == "Title\nFirst words of the story, long enough.\nSecond part of the story follows here."


def test_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (2, "u", "<article><p>A story with some words.</p></article>", "x"), (2, "u", "<article><p>A story with some words.</p></article>", "x"),
                                   (3, "u", "<article>" + "<p>A story with some words.</p>" * 3000 + "</article>", "x")], "page_id long, url string, html string, text string")
    rows = html_text.extracted(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 24, 24, 25 * 3000 - 1]
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("run", ["<a ", "<head>", "<script>", "<a<", '<a"', '<a "x', "</x>", "<!", "<a'\"", "<div>", "<p <", "<style></style", "<!--", "&amp;"])
def test_broken_pages_take_linear_time(run):
    started = time.perf_counter()
    blocks = html_blocks.blocks_of("<p>first</p>" + run * (500_000 // len(run)))
    assert time.perf_counter() - started < 8 and blocks[0].text == "first"


def test_tags_as_the_pattern_reads_them():
    """Every tag is where one pattern, tried at each "<", finds it."""
    pattern = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
    r, parts = random.Random(5), ["<a ", "<div>", "</div>", '"', "'", ">", "<", "/", "text ", "<!--", "-->", "<x", " ", "<!d>", "</ >", "<?q", '<td a="b>c">', "\n", '<A"b c">', "é"]
    for _ in range(8000):
        page = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        tags, at, want = html_blocks.Tags(page), 0, pattern.search(page)
        while found := tags.after(at):
            assert want and (found[0], found[1], found[2], found[3]) == (want.start(), want.end(), want[2], bool(want[1])), page
            assert found[2] is None or found[4] == want[3], page
            at, want = found[1], pattern.search(page, found[1])
        assert want is None, page
