import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.html_text import extract, render

CASES = {
    "paragraphs": ("<p>One<p>Two <b>bold</b>, <i>it</i>.</p>after", "One\n\nTwo bold, it.\n\nafter"),
    "blocks": ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    "space": ("  a \n\t b<span> c </span> d", "a b c d"),
    "br": ("a<br>b<br/><br>c</br>d", "a\nb\n\nc\nd"),
    "head": ("<html><head><title>T</title><style>x</style><script>var a='</p>';</script></head><body>b", "b"),
    "no head tags": ("<title>T</title><meta charset=x><p>b", "b"),
    "unclosed head": ("<head><title>T</title><p>b", "b"),
    "hidden": ("a<p hidden>x</p><div style='color:red; DISPLAY : none'>y<p>z</div><span style=\"visibility:hidden\">w<span>v</span>u</span>b", "ab"),  # what isn't displayed breaks no line
    "more hidden": ("<noscript>n</noscript><template>t</template><dialog>d</dialog><dialog open>o</dialog><iframe>i</iframe>", "o"),
    "comments": ("a<!-- <p>no</p> -->b<!doctype html><?php x ?>c<!-- open", "abc"),
    "entities": ("&lt;p&gt; &amp; &eacute; &#233; &nbsp;x &bogus;", "<p> & é é  x &bogus;"),
    "list": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    "numbers": ("<ol start=9><li>a<li>b<p>c</ol>", "9. a\n10. b\n\n    c"),
    "definitions": ("<dl><dt>t<dd>d<dt>u<dd>v</dl>", "t\n    d\nu\n    v"),
    "pre": ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    "table": ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>a<td>22</table>", "Name  N\nab    1\na     22"),
    "table parts": ("<table><caption>C</caption><thead><tr><td>h</td></tr></thead><tbody><td>b</td></tbody></table>", "C\nh\nb"),
    "spans": ("<table><tr><td colspan=2>wide cell</td><td>x</td></tr><tr><td>a</td><td>b</td><td>y</td></tr></table>", "wide cell  x\na  b       y"),
    "rowspan": ("<table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table>", "r  1\n   2"),
    "lines in cells": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "nested table": ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    "text in table": ("<table>loose<tr><td>c</table>", "loose\nc"),
    "heading": ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"),
    "quote": ("<blockquote>q<br>r</blockquote>", "    q\n    r"),
    "stray ends": ("a</div></p></table></b>b", "ab"),
    "odd tags": ("a < b <3 <x-y>c</x-y> <p class='a>b'>d", "a < b <3\nc\n\nd"),
    "unclosed": ("a<p class=\"x", "a"),
    "textarea": ("<textarea>a\n b</textarea>", "a\n b"),
    "misnested": ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    "empty item": ("<ul><li></li><li>b</ul>", "-\n- b"),
    "empty": ("", ""),
    "hidden body": ("<body hidden>a", ""),
    "raw script": ("<script>if (a < b) '</div>'</script>x", "x"),
}


@pytest.mark.parametrize("name", CASES)
def test_rendering(name):
    html, want = CASES[name]
    assert render(html) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <li> <ul> </ul> <ol> <table> <tr> <td> </td> </table> <br> <b> </b> <pre> </pre> <div> </div> <span hidden> </span> <!-- --> <td colspan=3> <td rowspan=2> < > & x y \n <script> </script> <select> <option> <dd>".split(" ")), max_size=60))
def test_any_soup_renders(parts):
    assert isinstance(render(" ".join(parts)), str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "<li>", "<ul>", "</ul>", "<table><tr><td>", "</table>", "<b>", "</b>", "<td>", "<br>"]), max_size=30))
def test_no_visible_word_is_lost(tags):
    html = "".join(f"w{i} {t}" for i, t in enumerate(tags)) + "end"
    got = render(html).split()
    assert sorted(w for w in got if w != "-") == sorted([f"w{i}" for i in range(len(tags))] + ["end"])


def test_deep_and_long_pages():
    began = time.time()
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<table><tr><td>" * 2_000 + "x").split() == ["x"]
    assert render("<span hidden>" * 20_000 + "x") == ""
    assert len(render("<p>word " * 100_000).split()) == 100_000
    assert render('<a b="' * 5_000) == ""
    assert "x" in render("<!--" * 1000 + "-->x")
    assert time.time() - began < 30


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "old"), (None, None, None, "old"), (3, "u", "", None), (1, "u", "<p>a", "old")], "page_id long, url string, html string, text string")
    out = extract(spark, df)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(map(str, out.collect())) == sorted(map(str, [out.collect()[0]] * 2 + [r for r in out.collect() if r["text"] != "a"]))
    assert [r["text"] for r in out.collect()] == ["a", None, "", "a"]
    assert extract(spark, df.limit(0)).count() == 0
