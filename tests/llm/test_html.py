from __future__ import annotations

import html as entities
import re

import pytest

from sparkscour.llm.html_extraction import CONTENT, Model, _labels, built_in, extract, main_text
from sparkscour.llm.html_pages import labelled_pages
from sparkscour.llm.html_tree import Tree
from sparkscour.llm.queries import QUERIES


def article(page: str) -> str:
    """Of the tables' pages, which have an article element: its text, by patterns."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inside = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside)
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", "", inside)).split())


def test_op3_against_patterns(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op3_html_extraction"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def test_unseen_labelled_pages():
    right = 0
    pages = list(labelled_pages(150, 99))
    for page in pages:
        tree = Tree(page)
        state = _labels(tree)
        want = "".join(" " if t is None else t for n, t, _ in tree.pieces if t is None or state[n] == CONTENT).split()
        right += main_text(page, built_in()).split() == want
    assert right >= 0.9 * len(pages)


def test_marginals_are_exact():
    """Message passing against the sum over all assignments, on small trees."""
    from itertools import product
    from math import exp

    model: Model = built_in()
    for page in ("<div class=content><p>One two three.</p><p class=ad>Buy</p></div>", "<nav><ul><li><a href=x>a</a></ul></nav><main><h1>T</h1></main>"):
        tree = Tree(page)
        (local, ties), n = model.local(tree), len(tree.tag)
        total, content = 0.0, [0.0] * n
        for states in product(range(3), repeat=n):
            score = sum(local[i][s] for i, s in enumerate(states))
            score += sum(ties[i][states[tree.parent[i]]][states[i]] for i in range(1, n))
            total += exp(score)
            for i, s in enumerate(states):
                content[i] += exp(score) * (s == CONTENT)
        assert model.marginals(tree) == pytest.approx([c / total for c in content], rel=1e-6)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<!-- only a comment -->", ""),
        ("Just a plain sentence page. Two sentences.", "Just a plain sentence page. Two sentences."),
        ("Plain  &amp; short,\nwith <b>bold</b> words", "Plain & short, with bold words"),
        ("<script>var a = '<p>no</p>';</script>", ""),
        (
            '<body><header class="site-header"><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-banner">We use cookies. OK?</div><main><article>'
            '<h1>Title &amp; more</h1><p>First <a href=x>link</a>ed&nbsp;text&#8217;s end.<p>Second<br>line <b>bold<p>Third.</article>'
            '<section id="comments"><div class="comment"><p>I liked this very much. Thanks.</p></div></section></main><footer><p>Copyright 2020. All rights.</p></footer>',
            "Title & more First linked text’s end. Second line bold Third.",
        ),
    ],
)
def test_pages(page, text):
    assert main_text(page, built_in()) == text


def test_deep_and_broken_pages():
    deep = "<article>" + "<div>" * 20_000 + "words here" + "</p></b></i></article>"
    assert main_text(deep, built_in()) in ("", "words here")
    long = "<article>" + "<p>A sentence of some words.</p>" * 20_000 + "</article>"
    assert main_text(long, built_in()).count("sentence") == 20_000


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<body><article><p>Some text stands here. And more of it.</p></article></body>", "x"), (1, None, None, None), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", "Some text stands here. And more of it.", 38), (1, None, "", 0), (None, "v", "", 0)]
    assert extract(pages.where("false")).collect() == []
    clashing = pages.selectExpr("*", "'z' AS n_chars", "'z' AS node", "'z' AS kept").drop("text")
    assert [(r.page_id, r.text, r.n_chars) for r in extract(clashing).collect()] == [(r.page_id, r.text, r.n_chars) for r in got]
