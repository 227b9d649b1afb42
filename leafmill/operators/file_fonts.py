"""From files to text: pages with their streams and the fonts that these name, each file in one task.

A font's characters come, the strongest first, from its ToUnicode stream, from the glyph names of its encoding, and
from its program: code to glyph, glyph to name or character. Widths come from its dictionary, else from the program.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.functions.batches import bounded
from leafmill.operators.state import FONT
from leafmill.sources import sfnt
from leafmill.sources.codecs import FilterError
from leafmill.sources.pdf import File, PdfError, Ref

CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman", "StandardEncoding": "latin-1"}
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}
SIGNS = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
SIGNS |= dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")) | {"fi": "fi", "fl": "fl", "germandbls": "ß", "endash": "–", "emdash": "—", "bullet": "•"}
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>|([\[\]])")
#: Fonts that a worker keeps, by a digest of all that they are made of: files of one source embed the same ones.
KEPT = 256
_kept: dict[bytes, dict] = {}
TYPE = pa.struct([("widths", pa.map_(pa.int32(), pa.float64())), ("unicode", pa.map_(pa.int32(), pa.string())), ("missing", pa.float64()), ("space", pa.float64()), ("y0", pa.float64()), ("y1", pa.float64()), ("cid", pa.bool_())])


def glyph_text(name: str) -> str | None:
    """The characters of a glyph by its name: of standard signs, letters and accents, or by its number."""
    base = name.partition(".")[0]
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base)
    if m:
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4)) if m[1] else chr(int(m[2], 16))
    if len(base) == 1:
        return base
    if base[1:] in ACCENTS:
        return unicodedata.normalize("NFC", base[0] + ACCENTS[base[1:]])
    return SIGNS.get(base)


def to_unicode(body: bytes) -> dict[int, str]:
    """Codes of a ToUnicode stream; what comes later wins."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h if len(h) % 2 == 0 else h + "0").decode("utf-16-be", "replace")
    for kind, part in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", body, re.S):
        todo = [(b"".join(h.split()).decode(), mark) for h, mark in _HEX.findall(part)][::-1]
        while len(todo) >= (2 if kind == b"bfchar" else 3):
            first = int(todo.pop()[0] or "0", 16)
            last = first if kind == b"bfchar" else int(todo.pop()[0] or "0", 16)
            value, mark = todo.pop()
            if mark == b"[":
                for c in range(first, last + 2):
                    value, mark = todo.pop() if todo else ("", b"]")
                    if mark:
                        break
                    out[c] = text(value)
                continue
            u = text(value)
            for c in range(first, min(last, first + 0xFFFF) + 1):
                out[c] = u[:-1] + chr(ord(u[-1]) + c - first) if u else ""
    return out


class Fonts:
    """The fonts of a file, each built once."""

    def __init__(self, file: File):
        self.file, self.built = file, {}

    def value(self, v: object) -> object:
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.file.get(v)[0]
        return None

    def field(self, d: object, key: str) -> object:
        d = self.value(d)
        return self.value(d.get(key)) if isinstance(d, dict) else None

    def body(self, v: object) -> bytes | None:
        """The decoded stream that a reference names."""
        if not isinstance(v, Ref):
            return None
        d, raw = self.file.get(v)
        if not isinstance(d, dict) or raw is None:
            return None
        data, left = self.file.decoded(d, raw)
        return None if left else data

    def font(self, ref: object) -> dict | None:
        """The font of a reference (or dictionary) as the text state wants it."""
        if isinstance(ref, Ref) and ref in self.built:
            return self.built[ref]
        d = self.value(ref)
        out = None
        if isinstance(d, dict):
            parts: list[bytes] = []
            mark = blake2b(b"\0".join(parts)).digest() if self.whole(d, parts, 0) else None
            out = _kept.get(mark)
            if out is None:
                out = self.make(d)
                if mark is not None:
                    if len(_kept) >= KEPT:
                        del _kept[next(iter(_kept))]
                    _kept[mark] = out
        if isinstance(ref, Ref):
            self.built[ref] = out
        return out

    def whole(self, v: object, parts: list[bytes], depth: int) -> bool:
        """Append all that a value consists of, with what it refers to; False if that nests or repeats too much to be told."""
        if depth > 12 or len(parts) > 10_000:
            return False
        raw = None
        if isinstance(v, Ref):
            v, raw = self.file.get(v)
        if isinstance(v, dict):
            parts.append(b"<%d" % len(v))
            inside = (x for kv in v.items() for x in kv)
        elif isinstance(v, list):
            parts.append(b"[%d" % len(v))
            inside = iter(v)
        else:
            parts.append(f"{type(v).__name__} {v!r}".encode())
            inside = iter(())
        if raw is not None:
            parts.append(b"%d " % len(raw) + raw)
        return all(self.whole(x, parts, depth + 1) for x in inside)

    def make(self, d: dict) -> dict:
        cid = d.get("Subtype") == "Type0"
        inner = self.value((self.field(d, "DescendantFonts") or [None])[0]) if cid else d
        inner = inner if isinstance(inner, dict) else {}
        described = self.field(inner, "FontDescriptor") or {}
        stream = next((b for k in ("FontFile2", "FontFile3", "FontFile") if (b := self.body(described.get(k))) is not None), None)
        program = sfnt.info(stream) if stream else None
        number = lambda v, default: float(v) if isinstance(v, (int, float)) else default
        scale = 0.001
        if d.get("Subtype") == "Type3":
            scale = abs(number((self.field(d, "FontMatrix") or [0.001])[0], 0.001)) or 0.001
        codes = {} if cid else self.codes(d, described, program)
        widths = self.cid_widths(inner) if cid else self.widths(d)
        if not widths and program:
            widths = {c: program["widths"].get(g, 0.0) / scale for c, g in codes.items()}
        missing = number(self.value(inner.get("DW")), 1000.0) if cid else number(self.value(described.get("MissingWidth")), 600.0 if str(d.get("BaseFont", "")).startswith("Courier") else 0.0)
        some = [w for w in widths.values() if w > 0]
        told = self.body(d.get("ToUnicode"))
        unicode = None if cid else self.characters(d, program, codes)
        if told is not None:
            unicode = (unicode or {}) | to_unicode(told)
        height = [number(self.value(described.get(k)), 0.0) for k in ("Descent", "Ascent")]
        if height[1] <= height[0]:
            box = self.field(described, "FontBBox") or self.field(d, "FontBBox") or []
            height = [number(box[1], 0.0), number(box[3], 0.0)] if len(box) == 4 and number(box[3], 0.0) > number(box[1], 0.0) else [program["y0"] / scale, program["y1"] / scale] if program and program["y1"] else [-0.2 / scale, 0.8 / scale]
        return {"widths": [(c, w * scale) for c, w in widths.items()], "unicode": None if unicode is None else list(unicode.items()), "missing": missing * scale, "space": (sum(some) / len(some) if some else missing) * scale, "y0": height[0] * scale, "y1": height[1] * scale, "cid": cid}

    def widths(self, d: dict) -> dict[int, float]:
        first, ws = self.field(d, "FirstChar"), self.field(d, "Widths") or []
        return {int(first or 0) + i: float(w) for i, w in enumerate(map(self.value, ws)) if isinstance(w, (int, float))}

    def cid_widths(self, d: dict) -> dict[int, float]:
        out, todo = {}, [self.value(x) for x in self.field(d, "W") or []][::-1]
        while len(todo) > 1:
            first, then = int(todo.pop()), todo.pop()
            if isinstance(then, list):
                out |= {first + i: float(self.value(w)) for i, w in enumerate(then)}
            elif todo:
                w = float(todo.pop())
                out |= {c: w for c in range(first, min(int(then), 0xFFFF) + 1)}
        return out

    def codes(self, d: dict, described: dict, program: dict | None) -> dict[int, int]:
        """Code to glyph number by the program's maps: (3, 0) less its block, (1, 0), or (3, 1) by character."""
        maps = program["maps"] if program else {}
        if "30" in maps:
            start = min(maps["30"], default=0) & 0xFF00
            return {c - start: g for c, g in maps["30"].items() if c - start < 256}
        symbolic = bool(int(self.value(described.get("Flags")) or 0) & 4)
        if "31" in maps and not (symbolic and "10" in maps):
            return {c: maps["31"][ord(u)] for c, u in self.encoded(d).items() if len(u) == 1 and ord(u) in maps["31"]}
        return dict(maps.get("10", {}))

    def encoded(self, d: dict) -> dict[int, str]:
        """Characters by the encoding of a dictionary alone."""
        e = self.field(d, "Encoding")
        base = self.field(e, "BaseEncoding") if isinstance(e, dict) else e
        out: dict[int, str] = {}
        codec = CODECS.get(str(base)) or (None if isinstance(e, dict) and base is None and d.get("Subtype") == "Type3" else "latin-1")
        if codec:
            out = {c: u for c in range(32, 256) if (u := bytes((c,)).decode(codec, "ignore"))}
        at = 0
        for x in (self.field(e, "Differences") or []) if isinstance(e, dict) else []:
            if isinstance(x, (int, float)):
                at = int(x)
                continue
            u = glyph_text(str(x))
            out.pop(at, None)
            if u is not None:
                out[at] = u
            at += 1
        return out

    def characters(self, d: dict, program: dict | None, codes: dict[int, int]) -> dict[int, str] | None:
        if self.field(d, "Encoding") is not None or program is None:
            return self.encoded(d)
        if program["encoding"]:
            return {c: u for c, n in program["encoding"].items() if (u := glyph_text(n))}
        back: dict[int, str] = {}
        for c, g in sorted(program["maps"].get("31", {}).items(), reverse=True):
            back[g] = chr(c)
        back |= {g: u for g, n in program["names"].items() if (u := glyph_text(n))}
        return {c: back[g] for c, g in codes.items() if g in back} or self.encoded(d)


def pages(data: bytes) -> Iterator[tuple[int, str, list]]:
    """(number from 1, stream, fonts) of each page; resources are inherited, a tree that bites its tail is cut."""
    fonts = Fonts(File(data))
    root = fonts.field(fonts.file.trailer.get("Root"), "Pages")
    todo: list[tuple[object, object]] = [(root, None)]
    seen: set[int] = set()
    n = 0
    while todo:
        node, inherited = todo.pop()
        if isinstance(node, Ref):
            if node in seen:
                continue
            seen.add(node)
        d = fonts.value(node)
        if not isinstance(d, dict):
            continue
        resources = fonts.value(d.get("Resources")) or inherited
        kids = fonts.value(d.get("Kids"))
        if isinstance(kids, list):
            todo.extend((k, resources) for k in reversed(kids))
            continue
        n += 1
        contents = d.get("Contents")
        inside = fonts.value(contents)
        parts = [fonts.body(c) for c in inside] if isinstance(inside, list) else [fonts.body(contents)]
        named = fonts.field(resources, "Font") or {}
        found = [(str(k), f) for k, v in named.items() if (f := fonts.font(v)) is not None]
        yield n, b"\n".join(p for p in parts if p is not None).decode("latin-1"), found


def page_streams(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, page, stream, fonts) of each page of each file, as state.chunks() takes them with (key, page) as the key.
    A file that can't be read has no pages."""
    kind = files.schema[key].dataType.simpleString()
    bounded(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, numbers, streams, fonts = [], [], [], []
            each: dict[tuple, int] = {}  # the distinct sets of fonts, which many pages share
            sets: list[list] = []
            for i, data in enumerate(b.column(1).to_pylist()):
                try:
                    got = list(pages(data or b""))
                except (PdfError, FilterError, ValueError, KeyError, TypeError, IndexError):
                    continue
                for n, s, f in got:
                    rows.append(i)
                    numbers.append(n)
                    streams.append(s)
                    mark = tuple((k, id(x)) for k, x in f)  # sets holds the fonts, so that no two have one id
                    if mark not in each:
                        each[mark] = len(sets)
                        sets.append(f)
                    fonts.append(each[mark])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(streams, pa.string()), pa.array(sets, pa.map_(pa.string(), TYPE)).take(pa.array(fonts, pa.int64()))], ["key", "page", "stream", "fonts"])

    return files.select(key, content).mapInArrow(run, f"key {kind}, page int, stream string, fonts map<string,{FONT}>").withColumnRenamed("key", key)
