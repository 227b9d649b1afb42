"""Text in inline SVG and MathML, and inherited visibility."""

import pytest

from leafmill.llm.html_text import render

CASES = {
    "labels": ("<p>a<svg><g><text x=1>North <tspan>Sea</tspan></text><text>South</text></g></svg>b", "a\nNorth Sea\nSouth\nb"),
    "icon": ("<p>a <svg><title>t</title><path d='M0 0'/></svg> b", "a b"),
    "not displayed": ("<svg><defs><text>d</text></defs><metadata>m</metadata><desc>e</desc><symbol><text>s</text></symbol><style>.x{}</style><text>y</text><text display='none'>z</text></svg>", "y"),
    "empty tags": ("<svg><title/><style/><script/><g/><text>y</text></svg>z", "y\nz"),
    "blanks between shapes": ("<svg> x <g> y <rect/> </g> <text>z</text></svg>", "z"),
    "lines of a label": ("<svg><text><tspan x=0 dy=0>one</tspan><tspan x=0 dy=1em>two</tspan></text></svg>", "one\ntwo"),
    "page in a drawing": ("<p>a<svg><foreignObject><div>b<p>c</div></foreignObject><text>d</text></svg>e", "a\nb\n\nc\n\nd\ne"),
    "switch": ("<svg><switch><foreignObject><div>b</div></foreignObject><text>fallback</text></switch></svg>", "b"),
    "link in a label": ("<svg><a href=x><text>l</text></a><text><a href=y>m</a></text></svg>", "l\nm"),
    "cdata": ("<svg><text><![CDATA[a <b> &amp;]]></text></svg>", "a <b> &amp;"),
    "unclosed drawing": ("<svg><path d=x><p>a</p>b", "a\n\nb"),
    "drawing left open in a link": ("<a><svg><path></a>b", "b"),
    "drawing in a hidden block": ("<div style='display:none'><svg><text>x</text></svg></div>y", "y"),
    "formula": ("so <math><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></math>.", "so x=1 2."),
    "annotation": ("<math><semantics><mrow><mi>x</mi></mrow><annotation encoding='application/x-tex'>\\x</annotation><annotation-xml><ci>x</ci></annotation-xml></semantics></math>", "x"),
    "words in a formula": ("<math><mtext>if <b>so</b></mtext><mphantom><mi>y</mi></mphantom></math>", "if so"),
    "matrix": ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable></math>", "1 2\n3 4"),
    "set back": ("<div style='visibility:hidden'>x<p style='visibility:visible'>y</p>z</div>w", "y\n\nw"),
    "set back inline": ("a <span style='visibility:hidden'>x<b style='visibility: visible'>y<i>z</i></b>w</span> b", "a yz b"),
    "hidden again": ("<div style='visibility:hidden'><p style='visibility:visible'>y<i style='visibility:hidden'>n</i></div>", "y"),
    "inherit": ("<div style='visibility:hidden'><p style='visibility:inherit'>x</p></div>y", "y"),
    "the last one counts": ("<p style='visibility:hidden;visibility:visible'>a<p style='visibility:hidden!important;visibility:visible'>b", "a"),
    "another property": ("<p style='backface-visibility:hidden'>a", "a"),
    "not displayed is final": ("<div style='display:none'><p style='visibility:visible'>x</p></div>y", "y"),
    "hidden body set back": ("<body style='visibility:hidden'>x<p style='visibility:visible'>y", "y"),
    "hidden cell": ("<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>d<td>e<td>f</table>", "a     c\nd  e  f"),
    "collapsed row": ("<table><tr style='visibility:collapse'><td style='visibility:visible'>a<tr><td>b</table>", "b"),
    "hidden item": ("<ol><li style='visibility:hidden'>a<li>b<li style='visibility:hidden'>c<p style='visibility:visible'>d</ol>", "2. b\n\nd"),
    "hidden label": ("<svg visibility='hidden'><text>x</text><text visibility='visible'>y</text></svg>", "y"),
}


@pytest.mark.parametrize("name", CASES)
def test_rendering(name):
    html, want = CASES[name]
    assert render(html) == want


def test_deep_and_broken():
    assert render("<svg><g>" * 20_000 + "<text>x") == "x"
    assert render("<div style='visibility:hidden'>" * 20_000 + "<b style='visibility:visible'>x") == "x"
