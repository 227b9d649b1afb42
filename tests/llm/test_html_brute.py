"""An independent renderer, on the standard library's parser, against the operator."""

import random
from html.parser import HTMLParser

import pytest

from leafmill.llm.html_text import render
from leafmill.llm.queries import QUERIES

APART = {"p": 1, "h1": 1, "ul": 1, "ol": 1, "table": 1, "div": 0, "nav": 0, "article": 0, "footer": 0, "li": 0}


class Naive(HTMLParser):
    """Blocks, lists and plain tables. A line is [text]; gap is how many blank lines are due before the next."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out, self.cur, self.gap, self.lists, self.mark, self.p, self.frames = 0, [], "", 0, [], "", 0, []

    def flush(self, gap=0):
        if self.cur.strip():
            self.emit(self.cur)
        self.cur = ""
        self.gap = max(self.gap, gap)

    def emit(self, line):
        depth = sum(len(m) for m in self.lists_marks())
        lead = " " * (depth - len(self.mark)) + self.mark if self.mark else " " * depth
        self.mark = ""
        if self.out:
            self.out += [""] * self.gap
        self.gap = 0
        self.out.append(lead + line.strip())

    def lists_marks(self):
        return [x["mark"] for x in self.lists if x["mark"]]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style", "title"):
            self.skip += 1
        elif tag == "br":
            self.flush() if self.cur.strip() else self.emit("")
        elif tag in APART:
            if self.p and tag != "li":
                self.handle_endtag("p")
            self.flush(0 if tag in ("ul", "ol") and self.lists else APART[tag])
            if tag == "p":
                self.p = 1
            elif tag in ("ul", "ol"):
                self.lists.append({"tag": tag, "n": int(attrs.get("start", 1)) - 1, "mark": ""})
            elif tag == "li":
                top = self.lists[-1]
                top["n"] = int(attrs["value"]) if "value" in attrs else top["n"] + 1
                self.mark = top["mark"] = "- " if top["tag"] == "ul" else f"{top['n']}. "
            elif tag == "table":
                self.frames.append({"rows": [], "saved": (self.out, self.gap, self.lists, self.mark)})
        elif tag == "tr":
            self.frames[-1]["rows"].append([])
        elif tag == "td":
            self.out, self.gap, self.lists, self.mark, self.cur = [], 0, [], "", ""

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        elif tag == "td":
            self.flush()
            self.frames[-1]["rows"][-1].append(self.out)
        elif tag == "table":
            f = self.frames.pop()
            self.out, self.gap, self.lists, self.mark = f["saved"]
            n = max(map(len, f["rows"]), default=0)
            width = [max((len(x) for r in f["rows"] if k < len(r) for x in r[k]), default=0) for k in range(n)]
            for r in f["rows"]:
                for i in range(max(map(len, r), default=0)):
                    line = ""
                    for k, c in enumerate(r):
                        if i < len(c) and c[i]:
                            line = line.ljust(sum(w + 2 for w in width[:k] if w)) + c[i]
                    if self.out:
                        self.out += [""] * self.gap
                    self.gap = 0
                    self.out.append(line.rstrip())
            self.gap = max(self.gap, 1)
        elif tag in APART:
            if tag == "p" and not self.p:
                return
            self.flush(0 if tag in ("ul", "ol") and len(self.lists) > 1 else APART[tag])
            if tag == "p":
                self.p = 0
            elif tag in ("ul", "ol"):
                self.lists.pop()
                self.mark = ""
            elif tag == "li":
                self.lists[-1]["mark"] = self.mark = ""

    def handle_data(self, data):
        if not self.skip:
            text = " ".join(data.replace("\xa0", "\0").split(" ")).replace("\n", " ")
            while "  " in text:
                text = text.replace("  ", " ")
            self.cur += text[1:] if self.cur.endswith(" ") and text.startswith(" ") else text


def naive(html):
    x = Naive()
    x.feed(html)
    x.close()
    x.flush()
    return "\n".join(x.out).replace("\0", " ").strip("\n")


def page(rng, depth=0):
    """A random page of closed elements, each with some text."""
    words = lambda: " ".join(rng.choice(["alpha", "be", "<b>c</b>", "d&amp;e", "é"]) for _ in range(rng.randint(1, 4)))
    kind = rng.choice(["p", "div", "ul", "ol", "table", "h1", "br"] if depth < 4 else ["p", "div"])
    some = lambda: "".join(page(rng, depth + 1) for _ in range(rng.randint(1, 2)))
    if kind in ("p", "h1"):
        return f"<{kind}>{words()}</{kind}>"
    if kind == "br":
        return f"<div>{words()}<br>{words()}</div>"
    if kind == "div":
        return f"<div>{words()}{some() if depth < 4 else ''}</div>"
    if kind == "table":
        rows = "".join("<tr>" + "".join(f"<td>{rng.choice([words, some])()}</td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3)))
        return f"<table>{rows}</table>"
    start = rng.choice(["", " start=0", " start=-2", " start=17"]) if kind == "ol" else ""
    items = "".join(f"<li{rng.choice(['', ' value=5']) if kind == 'ol' else ''}>{words()}{rng.choice(['', '<ul><li>x</li><li>y z</li></ul>'])}</li>" for _ in range(rng.randint(1, 3)))
    return f"<{kind}{start}>{items}</{kind}>"


def test_generated_pages_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        html = "".join(page(rng) for _ in range(rng.randint(1, 4)))
        assert render(html) == naive(html), html


def test_registered_query_equals_brute_force(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op9_html_extraction"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        assert got[i] == naive(html), html


@pytest.mark.parametrize("depth", [1, 3, 12, 13, 14, 40, 2000])
def test_tables_align_at_any_depth(depth):
    html = "<table><tr><td>" * depth + "aa<td>b<tr><td>c<td>dd" + "</table>" * depth
    assert render(html) == "aa  b\nc   dd"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<ol start=0><li>a<li>b</ol>", "0. a\n1. b"),
        ("<ol start=-2><li>a<li>b</ol>", "-2. a\n-1. b"),
        ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
        ("<ol reversed><li>a<li>b<ol><li>x</ol><li>c</ol>", "3. a\n2. b\n   1. x\n1. c"),
        ("<ol reversed start=2><li>a<li>b<li>c</ol>", "2. a\n1. b\n0. c"),
        ("<ol start=x><li value=''>a<li value=' 7px'>b</ol>", "1. a\n7. b"),
        ("<ul><li value=5>a</ul>", "- a"),
    ],
)
def test_numbers_of_items(html, want):
    assert render(html) == want
