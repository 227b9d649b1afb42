"""Content streams: exact lexer, parser and writer as plain functions, and streams made from tables.

The lexer follows the page-description syntax: comments are dropped, literal strings may nest to any
depth, an inline image's data is one token. The parser gives flat commands: text blocks are marked by
the block they belong to instead of nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES: dict[str, tuple[str, ...]] = {
    "marked_content": ("MP", "DP", "BMC", "BDC", "EMC"),
    "compatibility": ("BX", "EX"),
    "xobject": ("Do",),
    "type3": ("d0", "d1"),
    "shading": ("sh",),
    "general_state": ("w", "J", "j", "M", "d", "ri", "i", "gs"),
    "special_state": ("q", "Q", "cm"),
    "color": ("CS", "cs", "SCN", "SC", "scn", "sc", "G", "g", "RG", "rg", "K", "k"),
    "path": ("m", "l", "c", "v", "y", "h", "re"),
    "paint": ("S", "s", "F", "f*", "f", "B*", "B", "b*", "b", "n"),
    "clip": ("W*", "W"),
    "text_state": ("Tc", "Tw", "Tz", "TL", "Tf", "Tr", "Ts"),
    "text_position": ("Td", "TD", "Tm", "T*"),
    "text_show": ("Tj", "TJ", "'", '"'),
}
FAMILY_OF = {op: f for f, ops in FAMILIES.items() for op in ops}
OPERATORS = sorted(FAMILY_OF, key=len, reverse=True)

_OPS = "|".join(re.escape(o) for o in OPERATORS)
_NAME = r"/[^\s()<>\[\]{}/%\x00]+"
#: One token. Strings are matched without nesting here; lex() follows nested ones itself.
NATIVE_TOKEN = (
    r"(?:\([^()\\]*+(?:\\[\s\S][^()\\]*+)*+\)|<[0-9a-fA-F\s]*>|<<|>>|\[|\]|" + _NAME + r"|[+-]?(?:\d+\.\d*|\.\d+)|[+-]?\d+|true|false|null|BT|ET|BI|" + _OPS + ")"
)
#: Blanks and one token. A literal string that nests no other is one match, others are followed from where they open.
_TOKEN = re.compile(
    r"[\s\x00]*(?:(?P<comment>%[^\r\n]*)|(?P<string>\([^()\\]*+(?:\\[\s\S][^()\\]*+)*+\))|(?P<open>\()|(?P<dict><<|>>)|(?P<hex><[0-9a-fA-F\s]*>)|(?P<bracket>[\[\]])"
    rf"|(?P<name>{_NAME})|(?P<float>[+-]?(?:\d+\.\d*|\.\d+))|(?P<int>[+-]?\d+)|(?P<bool>(?:true|false)\b)|(?P<null>null\b)"
    rf"|(?P<data>\bID[\s](?:[\s\S]*?)EI(?=[\s]|\Z))|(?P<block>BT|ET)|(?P<image>BI)|(?P<op>{_OPS}))"
)
_BLANKS = re.compile(r"[\s\x00]*")
_ESCAPE = re.compile(r"\\([0-7]{1,3}|[\s\S]?)")
_STRING_PART = re.compile(r"[^()\\]+|\\[\s\S]|[()]")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def lex(stream: str) -> Iterator[tuple[str, str]]:
    """(type, text) of each token; an illegal character is a token of type error."""
    at, n = 0, len(stream)
    match = _TOKEN.match
    while at < n:
        m = match(stream, at)
        if m is None:
            at = _BLANKS.match(stream, at).end()
            if at < n:
                yield "error", stream[at]
            at += 1
            continue
        kind, at = m.lastgroup, m.end()
        text = m[kind]
        if kind == "comment":
            continue
        if kind == "open":
            start, depth = at - 1, 1
            while depth and at < n:
                part = _STRING_PART.match(stream, at)
                if part is None:  # a lone backslash at the end
                    at = n
                    break
                at = part.end()
                depth += (part.group() == "(") - (part.group() == ")")
            yield ("string" if not depth else "error"), stream[start:at]
            continue
        if kind == "dict":
            kind = "dict_open" if text == "<<" else "dict_close"
        elif kind == "bracket":
            kind = "array_open" if text == "[" else "array_close"
        elif kind == "block":
            kind = text
        yield kind, text


def parse(stream: str) -> list[dict]:
    """Commands in order: op, args (operands as text, arrays and dictionaries whole), block (number of
    the text block, 0 outside), and for an inline image its props and data. Operands without an operator
    at the end are dropped; a close without an open is an error token and dropped."""
    out: list[dict] = []
    args: list[str] = []
    nest: list[list[str]] = []
    block = blocks = 0
    image: list[str] | None = None
    for kind, text in lex(stream):
        if image is not None and kind not in ("data",):
            image.append(text)
            continue
        if kind in ("array_open", "dict_open"):
            nest.append([text])
        elif kind in ("array_close", "dict_close"):
            if not nest:
                continue
            parts = nest.pop()
            whole = parts[0] + " ".join(parts[1:]) + text
            (nest[-1] if nest else args).append(whole)
        elif kind == "error":
            continue
        elif nest and kind not in ("op", "BT", "ET", "image", "data"):
            nest[-1].append(text)
        elif kind == "BT":
            blocks += 1
            block = blocks
            out.append({"op": "BT", "args": args, "block": block})
            args = []
        elif kind == "ET":
            out.append({"op": "ET", "args": args, "block": block})
            block, args = 0, []
        elif kind == "image":
            image = []
        elif kind == "data":
            if image is not None:
                out.append({"op": "BI", "args": [], "block": block, "props": dict(zip(image[::2], image[1::2])), "data": text})
            image, args = None, []
        elif kind == "op":
            nest.clear()
            out.append({"op": text, "args": args, "block": block})
            args = []
        else:
            args.append(text)
    return out


def serialize(commands: list[dict]) -> str:
    """Commands as a content stream, one a line."""
    lines = []
    for c in commands:
        if c["op"] == "BI":
            props = " ".join(f"{k} {v}" for k, v in c["props"].items())
            lines.append(f"BI {props}\n{c['data']}")
        else:
            lines.append(" ".join([*c["args"], c["op"]]))
    return "".join(x + "\n" for x in lines)


def unescape(literal: str) -> str:
    """Characters of a literal string with its parentheses; octal codes give one character each."""
    if "\\" not in literal:
        return literal[1:-1]
    return _ESCAPE.sub(_unescaped, literal[1:-1])


def _unescaped(m: re.Match) -> str:
    x = m[1]
    return chr(int(x, 8) & 255) if "0" <= x[:1] <= "7" else "" if x == "\n" else ESCAPES.get(x, x)


# Streams as columns.


def escaped(text: Column) -> Column:
    """A text within a literal string."""
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def text_stream(text: Column, size: int = 12, left: int = 72, top: float = 700.5, leading: float = 14.5) -> Column:
    """A content stream that shows each line of a text in a text block of its own."""
    lines = F.split(text, "\n")
    y = lambda i: F.format_string("%.1f", F.lit(top) - i.cast("double") * leading)
    block = lambda s, i: F.concat(F.lit(f"BT /F1 {size} Tf {left} "), y(i), F.lit(" Td ("), escaped(s), F.lit(") Tj ET"))
    return F.array_join(F.transform(lines, block), "\n")


def with_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, stream) of documents."""
    return docs.select("doc_id", "lang", text_stream(F.col("text")).alias("stream"))
