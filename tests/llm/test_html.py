from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pithy.llm.html_text import extract, render
from pithy.llm.queries import QUERIES
from tests.llm.helpers import SF

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>so <b>bold</b>, <i>it</i> is </p>", "so bold, it is"),
    ("<ul><li>x<li>y<ol start=3><li>deep<li>er</ol></ul>after", "- x\n- y\n  3. deep\n  4. er\n\nafter"),
    ("<ol><li><p>a<p>b</ol>", "1. a\n\n   b"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\nd1\nd2"),
    ("<table><tr><th>name<th>n<tr><td>ab<td>1<tr><td>abcdef<td>22</table>", "name    n\nab      1\nabcdef  22"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td rowspan=2>r<td>x</tr><tr><td>y</table>", "r  x\n   y"),
    ("<table><tr><td colspan=2>head</tr><tr><td>a<td>b</table>", "head\na  b"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("x<script>var a='</p>';</script>y<style>p{}</style>", "xy"),
    ("<title>t</title>seen", "seen"),
    ("<head><title>t</title><p>seen", "seen"),
    ("a<span hidden>no</span><i style='color:red; display : NONE'>no</i>b<i style='display:nonesuch'>c</i>", "abc"),
    ("<div style=visibility:hidden>no<b>no</b></div>yes", "yes"),
    ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("a<!-- <p>no -->b<!doctype x><?php no ?>c", "abc"),
    ("a < b <3 </ 5>c", "a < b <3 c"),
    ("a</nope></p>b", "a\n\nb"),
    ("kept <a href='unclosed>lost", "kept"),
    ("kept <b", "kept"),
    ("x <script>never ends", "x"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<blockquote>q1<p>q2</blockquote>z", "  q1\n\n  q2\n\nz"),
    ("é&nbsp;ü&#8212;&bogus; &#xd800;", "é ü—&bogus; �"),
    ("<h1>h<h2>g</h2>t", "h\n\ng\n\nt"),
    ("<textarea>a &lt; b</textarea>", "a < b"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_render(source, want):
    assert render(source) == want


def test_deep_and_hostile_pages():
    assert render("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert render("<p>" * 30_000 + "x").strip() == "x"
    assert render("<ul><li>" * 2_000 + "x").strip().endswith("- x")
    assert len(render("<table>" + "<tr><td>" + "w" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 2_000 + "</table>")) < 200_000
    assert render('<a b="' * 20_000) == ""


class Words(HTMLParser):
    """Visible words by the standard library's tokenizer; enough for pages without hidden elements."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip.append(tag)
        else:
            self.out.append(" " if tag not in ("b", "a") else "")

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        else:
            self.out.append(" " if tag not in ("b", "a") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_whole_table_has_all_visible_words(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op3_html_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        p = Words()
        p.feed(pages[r.page_id])
        assert [w for w in r.text.split() if w != "-"] == [w for w in "".join(p.out).split() if w != "-"]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<p>x" * 2, "c"), (3, "<p>x" * 2, "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, TEXT string")
    out = extract(pages)
    assert [c for c in out.columns if c.lower() == "text"] == ["text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "x\n\nx", "x\n\nx"]
    assert extract(pages.where("false")).count() == 0
    assert QUERIES["op3_html_text"](spark, SF).where(F.col("text").isNull()).count() == 0


def test_quotes_outside_values():
    assert render("<p title=don't>one</p><p>two's</p>three") == "one\n\ntwo's\n\nthree"
    assert render('<a class="x"">one</a> two') == "one two"
    assert render("<p title = 'a > b' hidden>no</p><p alt=a\"hidden\">yes</p>") == "yes"
    assert render('one <p title="two>three') == "one"
