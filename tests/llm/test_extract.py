import itertools
import math
import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import extract as E
from sieveline.llm.common import table
from sieveline.llm.html_tree import parse


@pytest.fixture(scope="module")
def model():
    return E.train(E.labelled_pages())


def test_messages_give_the_marginals_of_all_labellings():
    nodes = parse("<div>a<ul><li>b<li>c</ul><p>d</div><p>e")
    unary = [0.3 * ((7 * i) % 5) - 0.7 for i in range(len(nodes))]
    model = E.PageModel(pair=[[0.9, -1.2], [0.2, 0.7]])
    odds, _, _ = model.marginals(nodes, unary)
    mass = [[0.0, 0.0] for _ in nodes]
    for y in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(u for u, v in zip(unary, y) if v) + sum(model.pair[y[n.parent]][y[i]] for i, n in enumerate(nodes) if i)
        for i, v in enumerate(y):
            mass[i][v] += math.exp(score)
    assert odds == pytest.approx([math.log(b / a) for a, b in mass])


@pytest.mark.parametrize(
    "html, runs",
    [
        (None, []),
        ("", []),
        ("plain", ["plain"]),
        ("<p>a &amp;&lt;\n b<br>c<p>d", ["a &< b c", "d"]),
        ("x<script>var t='</p>';</script>y<!-- no -->z", ["xyz"]),
        ("<p>cut &am", ["cut &am"]),
        ("<p>cut <b cla", ["cut"]),
        ("<ul><li>1<li>2</ul></div></b>3", ["1", "2", "3"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ('<a href="x>y">q</a> 1 < 2', ["q 1 < 2"]),
        ("<p>a<style>p{}</style", ["a"]),
    ],
)
def test_parse(html, runs):
    assert [n.text for n in parse(html) if n.tag == "#text"] == runs


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ap=\"' &;divscript", max_size=60))
def test_any_markup_gives_a_tree(html):
    nodes = parse(html)
    assert all(n.parent < i for i, n in enumerate(nodes))


def test_held_out_pages(model):
    right = total = 0
    for html in E.labelled_pages(150, seed=99):
        nodes = parse(html)
        marks = []
        for n in nodes:
            marks.append(n.label or (marks[n.parent] if n.parent >= 0 else ""))
        for (t, p), y in zip(model.blocks(html), [m == "1" for n, m in zip(nodes, marks) if n.tag == "#text"]):
            weight = len(t)
            total += weight
            right += weight * ((p > 0.5) == y)
    assert right / total > 0.97


def test_the_tables_pages(spark, model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in E.extract(pages, model).collect()}
    for r in pages.collect():
        inner = re.sub(r"<!--.*?-->", "", r.html).partition("<article>")[2].partition("</article>")[0]
        inner = re.sub(r"<(?!/?[a-z])[^>]*$|<[^>]*$", "", inner)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = """<html><body><header><a href=/>Site</a></header><div class="cookie-consent"><p>We use cookies to make this site work for you.</p></div>
<nav><ul><li><a href=a>A</a></li></ul></nav><article><h1>Title here</h1><p>First   paragraph of the text.</p><div class="ad">Buy the best pills now.</div>
<p>Short.</p><form><input><p>Write your name here.</p></form></article><aside><p>Related story you may like to read.</p></aside>
<section class="comments"><div class="comment"><p>I do not agree with this article at all, it is long and wrong.</p></div></section>
<footer>&copy; 2024 All rights reserved.</footer></body></html>"""


def test_what_stands_around_an_article_goes(model):
    assert model.text(PAGE) == "Title here\n\nFirst paragraph of the text.\n\nShort."


def test_nulls_repeats_and_clashing_columns(spark, model):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, "u", PAGE, "x"), (3, "u", "<script>a", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars) for r in E.extract(df, model).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (2, len(model.text(PAGE))), (3, 0)], key=str)
    assert E.extract(df.limit(0), model).collect() == []
