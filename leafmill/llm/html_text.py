"""Layout-aware text of web pages.

A tokenizer and a tree builder with implied tags (a block closes an open paragraph, an item the item
before it, a cell the cell before it; rows and the end of the head are implied) feed a renderer that
leaves out what a browser doesn't show and emits all the rest: blocks on lines of their own, blank lines
about paragraphs and headings, marked and indented list items, preformatted text as it is, and table cells
padded to columns. Inline SVG and MathML show their text: a label is a line of its own, a formula goes on in
its line. Visibility is inherited and may be set back, what isn't displayed is left out with all it holds.
Pages are independent, so the operator is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._spark import arrow_batches

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,18})")
HIDING = re.compile(r"display\s*:\s*none", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse|inherit|unset|revert|revert-layer)\s*(!\s*important\s*)?(?=;|\Z)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
NEVER = frozenset("script style title template iframe noembed noframes noscript object audio video canvas datalist head".split())
#: Foreign elements are named by their language, a slash and their name; no tag of a page holds a slash.
NEVER_FOREIGN = frozenset(
    "svg/defs svg/metadata svg/desc svg/title svg/script svg/style svg/symbol svg/clippath svg/mask svg/marker svg/pattern"
    " svg/lineargradient svg/radialgradient svg/filter math/annotation math/annotation-xml math/script math/style".split()
)
#: Foreign elements that hold page elements.
ENTRIES = frozenset("svg/foreignobject svg/desc svg/title math/mi math/mo math/mn math/ms math/mtext math/annotation-xml".split())
#: Page elements that end foreign content.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements that go on with SVG text, and those that show the first of their children only.
RUNS = frozenset("svg/tspan svg/textpath svg/a svg/tref svg/switch".split())
FIRST_ONLY = frozenset("svg/switch math/semantics math/maction".split())
FOREIGN_BLOCKS = frozenset("svg/text svg/foreignobject math/mtr math/mlabeledtr".split())
#: The parts of these stand apart, with a blank between their texts.
APART = frozenset("math/mfrac math/mroot math/munder math/mover math/munderover math/mtr math/mlabeledtr".split())
ROWS = frozenset("tr thead tbody tfoot".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var del button output".split())
#: Blank lines about a block; blocks that aren't listed have line breaks only.
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir fieldset".split(), 1)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd xmp listing".split())
#: An element's start closes these, if open, up to the nearest of the bounds.
LISTS = frozenset("ul ol menu dir".split())
CELL_BOUNDS = frozenset("table".split())
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | {"td", "th", "table"}),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "td", "th", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "td", "th", "table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), CELL_BOUNDS),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), CELL_BOUNDS),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), CELL_BOUNDS),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), CELL_BOUNDS),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
SCOPE = frozenset("td th caption table".split()) | ENTRIES


class Node:
    """hidden: not displayed; shown: its own text is visible; used: holds visible text; quiet: displays no text of its own."""

    __slots__ = ("tag", "attrs", "kids", "hidden", "shown", "used", "quiet")

    def __init__(self, tag: str, attrs: dict[str, str], hidden: bool, shown: bool = True):
        self.tag, self.attrs, self.kids, self.hidden = tag, attrs, [], hidden
        self.shown, self.used, self.quiet = shown, False, False


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTR.findall(raw):
        if v[:1] in "\"'" and len(v) > 1:
            v = v[1:-1]
        out.setdefault(k.lower(), unescape(v))
    return out


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NEVER or tag in NEVER_FOREIGN or "hidden" in attrs and "/" not in tag or tag == "dialog" and "open" not in attrs:
        return True
    if tag in ROWS and _visibility(tag, attrs) == "collapse" or "/" in tag and attrs.get("display", "").strip().lower() == "none":
        return True
    return "style" in attrs and HIDING.search(attrs["style"]) is not None


def _visibility(tag: str, attrs: dict[str, str]) -> str | None:
    """The visibility that an element sets; None if it has its parent's."""
    value = attrs.get("visibility", "").strip().lower() if "/" in tag else ""
    important = False
    for v, strong in VISIBILITY.findall(COMMENT.sub("", attrs["style"])) if "style" in attrs else ():
        if strong or not important:
            value, important = v.lower(), bool(strong)
    if tag == "math/mphantom" and not value:
        value = "hidden"
    return "visible" if value == "initial" else value if value in ("visible", "hidden", "collapse") else None


def parse(html: str) -> Node:
    """The tree of a page. Inline elements that hide nothing leave no node: their text is their parent's."""
    root = Node("body", {}, False)
    stack = [root]
    hidden_inline = 0
    p_open = 0
    n_foreign = n_veiled = 0
    pos, n = 0, len(html)
    match = TOKEN.match

    def pop() -> None:
        nonlocal p_open, hidden_inline, n_foreign, n_veiled
        x = stack.pop()
        n_veiled -= not x.shown
        n_foreign -= "/" in x.tag
        if x.tag == "p":
            p_open -= 1
        elif x.tag in INLINE:
            hidden_inline -= 1

    def close(tags: frozenset, bounds: frozenset) -> None:
        """Pop up to the outermost open element of tags within the bounds."""
        top = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in bounds or stack[i].tag in ENTRIES:
                break
            if stack[i].tag in tags:
                top = i
        if top:
            while len(stack) > top:
                pop()

    def shown(tag: str, attrs: dict[str, str]) -> bool:
        own = _visibility(tag, attrs) if attrs or tag == "math/mphantom" else None
        return stack[-1].shown if own is None else own == "visible"

    def use() -> None:
        """Mark the open elements as holders of visible text."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].used:
                break
            stack[i].used = True

    def leave() -> None:
        """Pop foreign elements up to a page's element or one that holds page elements."""
        while "/" in stack[-1].tag and stack[-1].tag not in ENTRIES:
            pop()

    def push_foreign(tag: str, attrs: dict[str, str], empty: bool) -> None:
        above = stack[-1]
        hidden = _hidden(tag, attrs) or above.tag in FIRST_ONLY and any(not isinstance(k, str) for k in above.kids)
        push(tag, attrs, hidden)
        x = stack[-1]
        if tag.startswith("svg/") and tag not in ENTRIES:
            x.quiet = tag != "svg/text" and (above.quiet or tag not in RUNS or not above.tag.startswith("svg/") or above.tag in ENTRIES)
        if empty:
            pop()

    def put(t: str) -> None:
        """Text of the innermost open element."""
        top = stack[-1]
        if top.quiet or not top.shown:
            return
        if n_foreign and top.tag.startswith("math/") and top.tag not in ("math/mtext", "math/ms"):
            t = t.strip(" \t\n\r\f")  # blanks between the parts of a formula aren't shown
        if not t:
            return
        top.kids.append(t)
        if not top.used and t.strip():
            use()

    def push(tag: str, attrs: dict[str, str], hidden: bool) -> None:
        nonlocal p_open, hidden_inline, n_foreign, n_veiled
        x = Node(tag, attrs, hidden, shown(tag, attrs))
        stack[-1].kids.append(x)
        stack.append(x)
        n_veiled += not x.shown
        n_foreign += "/" in tag
        if tag == "p":
            p_open += 1
        elif tag in INLINE:
            hidden_inline += 1

    while pos < n:
        m = match(html, pos)
        s = m.group()
        pos = m.end()
        if s[0] != "<" or len(s) == 1:
            if stack[-1].tag == "head" and s.strip():
                pop()
            put(unescape(s) if "&" in s else s)
            continue
        if n_foreign and s.startswith("<![CDATA[") and "/" in stack[-1].tag:
            at = html.find("]]>", m.start())
            put(html[m.start() + 9 : at if at >= 0 else n])
            pos = at + 3 if at >= 0 else n
            continue
        end, tag, raw = m.group(1), m.group(2), m.group(3)
        if tag is None:
            end, tag, raw = m.group(4), m.group(5), m.group(6)
            if tag is None:
                continue
        tag = tag.lower()
        if end:
            if n_foreign and "/" in stack[-1].tag:
                i = len(stack) - 1
                while "/" in stack[i].tag and stack[i].tag.partition("/")[2] != tag:
                    i -= 1
                if "/" in stack[i].tag:
                    while len(stack) > i:
                        pop()
                    continue
                if tag in INLINE or tag in ("p", "br"):  # inline elements may be open without a node
                    leave()
            if tag == "br":
                if stack[-1].shown:
                    stack[-1].kids.append(Node("br", {}, False))
            elif tag in INLINE and not hidden_inline:
                pass
            elif tag not in ("html", "body"):
                bound = CELL_BOUNDS if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else SCOPE if tag != "table" else frozenset()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in bound:
                        break
            continue
        attrs = _attributes(raw) if raw and raw != "/" else {}
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                pop()
            if tag == "body" and _hidden(tag, attrs):
                root.hidden = True
            if tag == "body" and root.shown and len(stack) == 1 and _visibility(tag, attrs) in ("hidden", "collapse"):
                root.shown = False
                n_veiled += 1
            continue
        if n_foreign and "/" in stack[-1].tag:
            if tag in BREAKOUT or tag == "font" and attrs.keys() & {"color", "face", "size"}:
                leave()
            elif stack[-1].tag not in ENTRIES:
                name = f"{stack[-1].tag.partition('/')[0]}/{tag}"
                empty = raw.endswith("/")
                if tag in ("script", "style") and not empty:
                    stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(html, pos)
                    pos = stop.end() if stop else n
                    empty = True
                push_foreign(name, attrs, empty)
                continue
        if tag in ("svg", "math"):
            if stack[-1].tag == "head":
                pop()
            push_foreign(f"{tag}/{tag}", attrs, raw.endswith("/"))
            continue
        hidden = _hidden(tag, attrs) if attrs or tag in NEVER or tag == "dialog" else False
        if tag in INLINE:
            if stack[-1].tag == "head":
                pop()
            if hidden or hidden_inline or attrs and _visibility(tag, attrs):
                push(tag, attrs, hidden)
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            pop()
        if p_open and tag in CLOSES_P:
            close(frozenset(["p"]), SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag != "tr":
                push("tr", {}, False)
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and shown(tag, attrs):
                stack[-1].kids.append(Node(tag, attrs, hidden))
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(html, pos)
            body = html[pos : stop.start() if stop else n]
            pos = stop.end() if stop else n
            if tag in ("textarea", "xmp") and not hidden and shown(tag, attrs):
                x = Node("pre", attrs, False)
                x.kids.append(unescape(body) if tag == "textarea" else body)
                stack[-1].kids.append(x)
                if body.strip():
                    use()
            continue
        if raw.endswith("/") and tag == "object":
            continue
        push(tag, attrs, hidden)
    return root


class Page:
    """Lines of text under construction."""

    __slots__ = ("lines", "line", "blank", "want", "indent", "mark")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a space is due before the next word
        self.want = 0  # blank lines due before the next line
        self.indent, self.mark = "", ""

    def end_line(self, margin: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False
        if margin > self.want:
            self.want = margin

    def start_line(self) -> None:
        if self.lines and self.want:
            self.lines.extend([""] * self.want)
        self.want = 0
        if self.mark:
            self.line.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark)
            self.mark = ""
        elif self.indent:
            self.line.append(self.indent)

    def text(self, s: str) -> None:
        words = BLANKS.sub(" ", s)
        if words[0] == " ":
            self.blank = True
            words = words[1:]
        if not words:
            return
        if not self.line:
            self.start_line()
        elif self.blank:
            self.line.append(" ")
        self.blank = words[-1] == " "
        self.line.append(words[:-1] if self.blank else words)

    def verbatim(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, x in enumerate(parts):
            if k:
                if not self.line:
                    self.start_line()
                    self.line.append("")
                self.end_line()
            if x:
                if not self.line:
                    self.start_line()
                self.line.append(x)


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    try:
        return min(max(int(attrs.get(name, "1")), 1), most)
    except ValueError:
        return 1


def _integer(attrs: dict[str, str], name: str) -> int | None:
    """The whole number that an attribute begins with."""
    m = INTEGER.match(attrs.get(name, ""))
    return int(m[1]) if m else None


def _first_number(ol: Node) -> int:
    """The number of a list's first item: its start, or in a reversed list the number of its items."""
    start = _integer(ol.attrs, "start")
    if start is not None or "reversed" not in ol.attrs:
        return 1 if start is None else start
    n, todo = 0, [ol]
    while todo:
        for x in todo.pop().kids:
            if not isinstance(x, str) and not x.hidden:
                n += x.tag == "li"
                if x.tag not in LISTS:
                    todo.append(x)
    return n


def _table(table: Node, done: dict[int, list[str]]) -> list[str]:
    """Lines of a table: cells in columns as wide as their widest line, two blanks apart."""
    rows: list[list[Node]] = []
    captions: list[Node] = []
    loose: list = []
    todo = [iter(table.kids)]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
        elif isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif x.hidden:
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo.append(iter(x.kids))
        elif x.tag == "tr":
            rows.append([c for c in x.kids if not isinstance(c, str) and c.tag in ("td", "th") and not c.hidden])
            loose.extend(c for c in x.kids if (isinstance(c, str) and c.strip()) or (not isinstance(c, str) and c.tag not in ("td", "th") and not c.hidden))
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag not in ("colgroup", "col"):
            loose.append(x)
    out: list[str] = []
    if loose:  # what isn't in a cell goes before the table, as in a browser
        x = Node("div", {}, False)
        x.kids = loose
        out += _lines(x, done)
    for c in captions:
        out += _lines(c, done)
    taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
    grid: list[list[tuple[int, int, list[str]]]] = []
    width: dict[int, int] = {}
    for cells in rows:
        line, col = [], 0
        for c in cells:
            while taken.get(col, 0):
                col += 1
            span, down = _span(c.attrs, "colspan", 1000), _span(c.attrs, "rowspan", 65534)
            line.append((col, span, _lines(c, done)))
            if span == 1:
                width[col] = max(width.get(col, 0), max(map(len, line[-1][2]), default=0))
            for k in range(col, col + span):
                taken[k] = down
            col += span
        for k in list(taken):
            taken[k] -= 1
            if taken[k] <= 0:
                del taken[k]
        grid.append(line)
    for line in grid:  # cells over several columns widen the last of them
        for col, span, text in line:
            if span > 1:
                have = sum(width.get(k, 0) for k in range(col, col + span)) + 2 * (span - 1)
                more = max(map(len, text), default=0) - have
                if more > 0:
                    width[col + span - 1] = width.get(col + span - 1, 0) + more
    last = max((col + span for line in grid for col, span, _ in line), default=0)
    start, at = {}, 0
    for k in range(last):
        start[k] = at
        at += width.get(k, 0) + (2 if width.get(k, 0) else 0)
    for line in grid:
        for k in range(max((len(t) for _, _, t in line), default=0)):
            s = ""
            for col, _, text in line:
                if k < len(text) and text[k]:
                    s = s.ljust(start[col]) + text[k]
            out.append(s.rstrip())
    return out


def _count(li: Node, last: tuple[int, int]) -> tuple[int, int]:
    """The number of an item: its value, or the next one."""
    value = _integer(li.attrs, "value")
    return (last[0] + last[1] if value is None else value), last[1]


def _ordered(todo: list) -> bool:
    """Whether the innermost list is numbered."""
    return next((t[0].tag for t in reversed(todo) if t[0].tag in LISTS), "") == "ol"


def _tables(root: Node) -> dict[int, list[str]]:
    """Lines of every table below root by its identity, the inner ones first: no call goes deeper than one table."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "table" and x is not root:
            found.append(x)
        todo.extend(k for k in x.kids if not isinstance(k, str) and not k.hidden)
    done: dict[int, list[str]] = {}
    for x in reversed(found):
        done[id(x)] = _table(x, done)
    return done


def _lines(root: Node, done: dict[int, list[str]]) -> list[str]:
    """Lines of what root holds; done: those of the tables within it, each of which is used once."""
    page = Page()
    todo: list[tuple[Node, Iterator, str, int]] = [(root, iter(root.kids), "", 0)]  # node, kids left, indent before, items so far
    pre = 1 if root.tag == "pre" else 0
    counts = [(0, 1)]  # of the open lists: the last item's number, and the step to the next
    while todo:
        node, kids, indent, margin = todo[-1]
        x = next(kids, None)
        if x is None:
            todo.pop()
            if todo and node.tag not in INLINE and ("/" not in node.tag or node.tag in FOREIGN_BLOCKS):
                page.end_line(margin)
                if node.tag == "li" and page.mark:  # an empty item
                    page.start_line()
                    page.end_line()
                page.indent = indent
                page.mark = ""
                if node.tag in ("pre", "listing"):
                    pre -= 1
                if node.tag in LISTS:
                    counts.pop()
            continue
        if isinstance(x, str):
            if pre:
                page.verbatim(x)
            elif x:
                page.text(x)
            continue
        if x.hidden:
            continue
        tag = x.tag
        if not (x.shown or x.used):  # takes its place in a list, but breaks no line
            if tag == "li" and _ordered(todo):
                counts[-1] = _count(x, counts[-1])
            continue
        if "/" in tag and tag not in FOREIGN_BLOCKS:
            if node.tag in APART and x is not node.kids[0]:
                page.blank = True
            if tag == "svg/tspan" and "x" in x.attrs and ("y" in x.attrs or "dy" in x.attrs) or tag == "math/math" and x.attrs.get("display") == "block":
                page.end_line()
            todo.append((x, iter(x.kids), page.indent, 0))
            continue
        if tag == "br":
            if not page.line:
                page.start_line()
                page.line.append("")
            page.end_line()
            continue
        if tag == "wbr":
            continue
        if tag in INLINE:
            todo.append((x, iter(x.kids), page.indent, 0))
            continue
        inner = tag in LISTS and any(t[0].tag == "li" for t in todo)
        gap = 0 if inner else MARGIN.get(tag, 0)
        page.end_line(gap)
        if tag == "hr":
            continue
        if tag == "table":
            for line in done.pop(id(x)):
                page.start_line()
                page.line.append(line)
                page.end_line()
            page.end_line(1)
            continue
        todo.append((x, iter(x.kids), page.indent, gap))
        if tag in LISTS:
            step = -1 if "reversed" in x.attrs else 1
            counts.append((_first_number(x) - step, step) if tag == "ol" else (0, 1))
        elif tag == "li":
            if page.mark:  # an item that holds nothing but this one's list
                page.start_line()
                page.end_line()
            ordered = _ordered(todo)
            if ordered:
                counts[-1] = _count(x, counts[-1])
            page.mark = "" if not x.shown else f"{counts[-1][0]}. " if ordered else "- "
            page.indent += " " * len(page.mark)
        elif tag in ("dd", "blockquote"):
            page.indent += "    "
        elif tag in ("pre", "listing"):
            pre += 1
    page.end_line()
    return page.lines


def render(html: str) -> str:
    """All visible text of a page."""
    root = parse(html)
    if root.hidden:
        return ""
    lines = _lines(root, _tables(root))
    return "\n".join(lines).replace("\xa0", " ").strip("\n")


def _render(col: pa.Array) -> pa.Array:
    return pa.array([None if x is None else render(x) for x in col.to_pylist()], pa.string())


def text_of(html: Column | str) -> Column:
    """Visible text of a column of pages; null for null, empty for a page that shows nothing."""
    return F.arrow_udf(_render, "string")(html)


def extract(spark: SparkSession, pages: DataFrame, html: str = "html") -> DataFrame:
    """pages and a column text in place of html.

    Null html gives null, empty html the empty text; broken, unclosed and very long pages are rendered
    whole, to any depth of nesting. Repeated rows give equal rows. Other columns stay; one that is named text is
    replaced. No rows: no rows.
    """
    arrow_batches(spark, 500)
    return pages.withColumn("text", text_of(F.col(html).cast("string"))).drop(*([html] if html != "text" else []))
