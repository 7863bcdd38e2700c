"""Operator 9: hand-made layouts, hostile markup, and the given pages."""

import re
import time
from html import unescape

import pytest
from conftest import SMALL

from mentionlake.llm import html_layout as H
from mentionlake.llm.common import table

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>a<p>b<br>c<br><br>d": "a\n\nb\nc\n\nd",
    "<title>t</title><body>x<script>if(a<b)</script>y<style>p{}</style><!-- c -->z": "xyz",
    "<div>a<div>b</div>c</div><span>d</span>e": "a\nb\nc\nde",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "- one\n- two\n  - in\n- three",
    "<ol start=9><li>x</li><li>y<p>more</ol>": "9. x\n10. y\n\n    more",
    "<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>whole row here, wide</table>": "name       n\nlong name  1\nwhole row here, wide",
    # Cells are boxes: a table in a cell stands below the cell's text, not on its line.
    "a<table><td>b<table><td>c</table><td>d</table>e": "a\n\nb  d\n\nc\n\ne",
    "<table><tr><td><p>First para.<p>Second.<ul><li>a<li>b</ul><td>x<br>y<tr><td>z<td>w</table>": "First para.  x\n             y\nSecond.\n\n- a\n- b\nz            w",
    "<table><tr><td><h1>Head</h1><p>text<tr><td>foot</table>": "Head\n\ntext\n\nfoot",
    "<table><tr><td>menu<td><p>" + "long " * 20 + "<p>more<tr><td>l<td>r</table>": "menu\n" + ("long " * 20).strip() + "\n\nmore\n\nl\nr",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "a  b   c\nd      e\nf      g",
    "<table><td><pre>x  y\n z</pre><td>q</table>": "x  y  q\n z",
    "<p hidden>no<p style='display: none'>no<p>yes<div style='visibility:hidden'>no<p>no</div>": "yes",
    "<details><summary>head</summary>no</details><details open><summary>h</summary>yes</details>": "head\nh\nyes",
    "<pre>a  b\n  c\n\nd</pre>x  y": "a  b\n  c\n\nd\n\nx y",
    "<a href='>'>k</a> &lt;i&gt; &amp;nbsp; 1 < 2": "k <i> &nbsp; 1 < 2",
    "<blockquote>q<p>r</blockquote>s": "> q\n\n> r\n\ns",
    "<b>bo</b>ld <i>it</i>": "bold it",
    "x</p>y</div>z": "x\n\nyz",
    "<!doctype html><html><head><meta charset=x><body>late<head>x": "latex",
    "<td>loose<li>item": "loose\n- item",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert H.render(html) == CASES[html]


LONG = "a > b <style> " * 5_000


@pytest.mark.parametrize(
    "tag", [f'<img alt="{LONG}">', f"<p title='{LONG}'>", f"<p a = \"{LONG}\" b='{LONG}'>", """<p class="x" title='a > b'>""", """<p title='"' alt="'>">""", "<p title='it>", "<p it's>", '</p x=">">']
)
def test_a_tag_ends_after_its_quoted_values(tag):
    assert H.render(tag + "seen<b>too</b>") == "seentoo"


@pytest.mark.parametrize("piece", ["<a x='>\" ", '<a x=">" ', "<a ' \" =", "<a x=' y=\" >"])
def test_broken_quotes_are_read_in_about_linear_time(piece):
    start = time.process_time()
    H.render(piece * 20_000)
    assert time.process_time() - start < 8


FOREIGN = {
    "Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math> be.": "Let x=1 be.",
    "<math><semantics><mi>x</mi><annotation-xml><p>no</p></annotation-xml></semantics></math>y": "xy",
    "a<svg><title>no</title><desc/><title/><style/><defs><text>no</text></defs><path d='M0'/><text x=1>Jan</text><text>Fe<tspan>b</tspan></text><metadata>no</metadata></svg>b": "a\nJan\nFeb\nb",
    "<svg><foreignObject><div/>x<p>y</foreignObject></svg>z<desc>d</desc>": "x\n\ny\n\nzd",
    "<p>Pick <select><option>one<option selected>two</select> now": "Pick\none\ntwo\nnow",
    "<select><optgroup label=x><option>a<optgroup label=y><option>b</select>c": "a\nb\nc",
}


@pytest.mark.parametrize("html", FOREIGN)
def test_formulas_labels_and_options_are_visible(html):
    assert H.render(html) == FOREIGN[html]


@pytest.mark.parametrize("name", ["SCRIPT", "Style", "TITLE", "script"])
def test_raw_elements_end_in_any_case_on_turkish_pages(name):
    assert H.render(f"<p>İstanbul<{name}>x < y</{name.swapcase()}>da<{name}>z</{name}> İzmir") == "İstanbulda İzmir"


@pytest.mark.parametrize("piece", ["<div>", "<!--", "<ul><li>", "<", "<a b='", "<p>", "<table><td>", "<script>", "<b><i></b>", "&", "<td colspan=99999>x"])
def test_hostile_markup_is_read_in_about_linear_time(piece):
    start = time.process_time()
    H.render(piece * 20_000)
    assert time.process_time() - start < 8


@pytest.mark.parametrize("piece", ["<table><td>x", "<table><td>x<br>y<td>z", "<tr><td>x<p>y<td rowspan=65000 colspan=1000>z", "<tr><td rowspan=65000>x<td>y", "<td>x<br>y<td>"])
def test_hostile_tables_are_read_in_about_linear_time(piece):
    start = time.process_time()
    text = H.render("<table>" + piece * 20_000)
    assert time.process_time() - start < 8 and len(text) < 100_000_000
    assert text.count("x") == 20_000


def test_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (1, "<p>a", "x"), (None, "<p>a", None), (1, "<p>a", "x")]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((repr(r.page_id), r.text) for r in got) == sorted([("1", ""), ("1", ""), ("1", "a"), ("1", "a"), ("None", "a")])
    assert H.extract_text(spark.createDataFrame([], "html string")).count() == 0


def test_given_pages_keep_every_visible_word(spark):
    html = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    rows = H.op9_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(html)
    for r in rows:
        plain = re.sub(r"(?s)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", html[r.page_id])
        want = unescape(re.sub(r"</?(?:b|i|a|em|strong|span)(?:\s[^>]*)?>", "", plain))
        words = re.sub(r"</?[a-zA-Z!][^>]*>", " ", want).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in words if w != "-"]
        assert r.n_chars == len(r.text) and r.n_lines == sum(bool(x) for x in r.text.split("\n"))
