"""Graphics and text state: a fold over each stream, window forms of its parts, and reading order.

A stream's state is sequential, so chunks() folds a whole stream where its row is, without a shuffle. The
window forms give single parameters of command tables that are split over rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.batches import BYTES, bounded
from leafmill.operators.fonts import PRIVATE
from leafmill.sources.content import parse, lex, unescape

#: A gap is a space if it is wider than this share of the font's space.
SPACE_SHARE = 0.4
#: Share of a box's height that is a space's width, the least gap that counts, and an indent's unit.
SPACE_UNIT, SPACE_LEAST, INDENT = 0.5, 0.125, 0.67
FONT = "struct<widths:map<int,double>,unicode:map<int,string>,missing:double,space:double,y0:double,y1:double,cid:boolean>"
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Sequence[float], n: Sequence[float]) -> Matrix:
    """The matrix that applies n first."""
    a, b, c, d, e, f = m
    return (a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f)


def at(m: Sequence[float], x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def codes(literal: str, wide: bool) -> list[int]:
    """Codes of a literal or hexadecimal string, of one or two bytes."""
    if literal.startswith("<"):
        digits = "".join(literal[1:-1].split())
        raw = list(bytes.fromhex(digits + "0" * (len(digits) % 2)))
    else:
        raw = [ord(c) for c in unescape(literal)]
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)] if wide else raw


class Font:
    """A font as the fold needs it: widths and texts of one-byte codes in tables, all others by their maps."""

    def __init__(self, widths: dict[int, float], unicode: dict[int, str] | None, missing: float, space: float, y0: float, y1: float, cid: bool):
        self.widths, self.unicode, self.missing, self.space, self.y0, self.y1, self.cid = widths, unicode, missing, space, y0, y1, cid
        self.row = [self.width(c) for c in range(256)]
        self.array = np.array(self.row)
        self.table = None if unicode is None else {c: self.text(c) for c in range(256)}
        self.blanks = [c for c in range(256) if self.text(c) == " "]

    def width(self, c: int) -> float:
        return self.widths.get(c, self.missing)

    def text(self, c: int) -> str:
        return chr(c) if self.unicode is None else self.unicode.get(c) or chr(PRIVATE + (c & 0xFFFF))


class State:
    """Text and graphics state; update() gives (text, matrix) for commands that show text, else None."""

    NAMES = ("ctm", "tm", "line", "tc", "tw", "th", "tl", "rise", "mode", "size", "font")
    SETS = {"Tc": "tc", "Tw": "tw", "TL": "tl", "Ts": "rise", "Tz": "th"}

    def __init__(self, fonts: dict[str, Font]):
        self.fonts, self.saved = fonts, []
        self.ctm = self.tm = self.line = UNIT
        self.tc = self.tw = self.tl = self.rise = self.size = 0.0
        self.th, self.mode, self.font = 100.0, 0, None

    def update(self, op: str, args: list[str]) -> tuple[str, Matrix] | None:
        if op in ("Tj", "TJ", "'", '"'):
            if op == '"':
                self.tw, self.tc = float(args[-3]), float(args[-2])
            if op in "'\"":
                self.move(0.0, -self.tl)
            return self.show(args[-1] if args else "")
        if op in ("Td", "TD"):
            if op == "TD":
                self.tl = -float(args[-1])
            self.move(float(args[-2]), float(args[-1]))
        elif op == "BT":
            self.line = self.tm = UNIT
        elif op == "Tf":
            self.font, self.size = self.fonts.get(args[-2].lstrip("/").replace("#20", " ")), float(args[-1])
        elif op == "Tm":
            self.line = self.tm = tuple(float(x) for x in args[-6:])
        elif op == "T*":
            self.move(0.0, -self.tl)
        elif op in self.SETS:
            setattr(self, self.SETS[op], float(args[-1]))
        elif op == "Tr":
            self.mode = int(float(args[-1]))
        elif op == "q":
            self.saved.append([getattr(self, n) for n in self.NAMES])
        elif op == "Q":
            for n, v in zip(self.NAMES, self.saved.pop() if self.saved else ()):
                setattr(self, n, v)
        elif op == "cm":
            self.ctm = times(self.ctm, [float(x) for x in args[-6:]])
        return None

    def move(self, x: float, y: float) -> None:
        a, b, c, d, e, f = self.line
        self.line = self.tm = (a, b, c, d, a * x + c * y + e, b * x + d * y + f)

    def show(self, operand: str) -> tuple[str, Matrix] | None:
        f = self.font
        if f is None:
            return None
        text, before, inner, whole = self.plain(operand) or self.spaced(operand)
        m = self.tm if self.ctm == UNIT else times(self.ctm, self.tm)
        m = times(m, (inner or 0.001, 0.0, 0.0, (f.y1 - f.y0) * self.size, before, f.y0 * self.size + self.rise))
        a, b, c, d, x, y = self.tm
        self.tm = (a, b, c, d, a * whole + x, b * whole + y)
        return text, tuple(round(v * 1000) / 1000 + 0.0 for v in m)

    def plain(self, operand: str) -> tuple[str, float, float, float] | None:
        """(text, width before it, its width, width of all) of one string of one-byte codes, all at once; None where the
        spacing makes or hides a space, which takes a look at every gap."""
        f, least = self.font, self.font.space * self.size * SPACE_SHARE
        if f.cid or operand[:1] != "(" or self.tc > least:
            return None
        s = unescape(operand)
        if not s or any(self.tc + (self.tw if c == 32 else 0.0) + f.row[c] * self.size <= least for c in f.blanks):
            return None
        try:
            raw = s.encode("latin-1")
        except UnicodeEncodeError:
            return None
        glyphs = sum(map(f.row.__getitem__, raw)) if len(raw) < 40 else float(f.array[np.frombuffer(raw, np.uint8)].sum())
        whole = glyphs * self.size + len(raw) * self.tc + (raw.count(32) * self.tw if self.tw else 0.0)
        last = self.tc + (self.tw if raw[-1] == 32 else 0.0)
        shown = s[:-1] if raw[-1] in f.blanks else s
        return (shown if f.table is None else shown.translate(f.table)), 0.0, (whole - last) * self.th / 100, whole * self.th / 100

    def spaced(self, operand: str) -> tuple[str, float, float, float]:
        """The same of any operand, gap by gap."""
        f = self.font
        items: list[int | float] = []  # codes are int, displacements float
        for kind, token in lex(operand):
            if kind in ("string", "hex"):
                for c in codes(token, bool(f.cid)):
                    items += [c, self.tc + (self.tw if c == 32 and not f.cid else 0.0)]
            elif kind in ("int", "float"):
                if not items:
                    items.append(0.0)
                items[-1] -= float(token) * self.size / 1000
        a, b = 0, len(items)
        while b > a and isinstance(items[b - 1], float):
            b -= 1
        while a < b and isinstance(items[a], float):
            a += 1
        widths = [f.width(x) * self.size if isinstance(x, int) else x for x in items]
        text, own = [], 0.0
        for x, w in zip(items[a:b], widths[a:b]):
            if isinstance(x, float):
                text.append(" " if x + own > f.space * self.size * SPACE_SHARE else "")
                own = 0.0
                continue
            u = f.text(x)
            if u == " ":
                own = w
            else:
                text.append(u)
        before, inner, after = (sum(w) * self.th / 100 for w in (widths[:a], widths[a:b], widths[b:]))
        return "".join(text), before, inner, before + inner + after


def _fonts(row: str | None) -> dict[str, Font]:
    """Fonts from their JSON; absent fields are null."""
    out = {}
    for name, f in json.loads(row or "{}").items():
        widths = {int(k): v for k, v in (f.get("widths") or {}).items()}
        unicode = None if f.get("unicode") is None else {int(k): v for k, v in f["unicode"].items()}
        out[name] = Font(widths, unicode, *(f.get(k) or 0.0 for k in ("missing", "space", "y0", "y1")), bool(f.get("cid")))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, seqs, texts, ms, names = [], [], [], [], []
        kinds = b.column(2).dictionary_encode()
        fonts = [_fonts(x) for x in kinds.dictionary.to_pylist()]
        for i, (stream, kind) in enumerate(zip(b.column(1).to_pylist(), kinds.indices.to_pylist())):
            state = State({} if kind is None else fonts[kind])
            for k, c in enumerate(parse(stream or "")):
                op, args = c["op"], c["args"]
                try:
                    shown = state.update(op, args)
                except (ValueError, IndexError, TypeError):  # operands that don't fit their operator
                    continue
                if op == "Do" and args:
                    shown = None, state.ctm
                if shown is not None:
                    names.append(args[-1].lstrip("/") if op == "Do" else None)
                    rows.append(i)
                    seqs.append(k)
                    texts.append(shown[0])
                    ms.extend(shown[1])
        places = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 6, pa.int32()), pa.array(ms, pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(seqs, pa.int32()), pa.array(texts, pa.string()), places, pa.array(names, pa.string())], ["key", "seq", "text", "m", "name"])


def chunks(streams: DataFrame, key: str = "doc_id", stream: str = "stream", fonts: str = "fonts") -> DataFrame:
    """(key, seq, text, m): what each command of a stream shows, and the matrix that takes the unit square to
    its box. fonts: a map from resource name to FONT. Commands before a font is set, or whose operands
    don't fit, show nothing; a restore without a save is ignored."""
    return placed(streams, key, stream, fonts).where("name is null").drop("name")


def placed(streams: DataFrame, key: str = "doc_id", stream: str = "stream", fonts: str = "fonts") -> DataFrame:
    """chunks(), and rows with a name and no text for the objects that a stream draws, m being the matrix there."""
    kind = streams.schema[key].dataType.simpleString()
    bounded(streams.sparkSession)
    x = streams.select(key, stream, F.to_json(fonts))  # as text, so that a font that many rows share is read once a batch
    return x.mapInArrow(_chunks, f"key {kind}, seq int, text string, m array<double>, name string").withColumnRenamed("key", key)


# Reading order.


def _under(m: Sequence[float], n: Sequence[float]) -> bool:
    """Whether n's box is to be read after m's: it lies below, or on the line and to the right."""
    o, up, right = at(m, 0, 0), at(m, 0, 1), at(m, 1, 0)
    mid, half = at(n, 0, 0.5), at(m, 0.5, 0)
    dot = lambda p, q, r, s: (p[0] - q[0]) * (r[0] - s[0]) + (p[1] - q[1]) * (r[1] - s[1])
    return dot(up, o, mid, o) < 0 or dot(up, o, mid, up) < 0 < dot(right, o, mid, half)


def before(m: Sequence[float], n: Sequence[float]) -> bool:
    """A partial order of boxes: both see it the same way."""
    return _under(m, n) and not _under(n, m)


def reading_order(ms: list[Sequence[float]]) -> list[int]:
    """Indices in reading order by a stable sort. The relation isn't transitive, so the result depends on the
    order that comes in: callers pin it."""
    sides = [_sides(m) for m in ms]
    return sorted(range(len(ms)), key=cmp_to_key(lambda i, j: _after(sides[j], sides[i]) - _after(sides[i], sides[j])))


def _sides(m: Sequence[float]) -> tuple[float, ...]:
    """What _under() needs of a box, computed once: corners, the ways up and right, half the base, half the left side."""
    (ox, oy), (px, py), (rx, ry) = at(m, 0, 0), at(m, 0, 1), at(m, 1, 0)
    return ox, oy, px, py, px - ox, py - oy, rx - ox, ry - oy, *at(m, 0.5, 0), *at(m, 0, 0.5)


def _after(p: tuple[float, ...], q: tuple[float, ...]) -> bool:
    """_under() of the sides of two boxes."""
    ox, oy, px, py, ux, uy, rx, ry, hx, hy, _, _ = p
    x, y = q[10], q[11]
    return ux * (x - ox) + uy * (y - oy) < 0 or ux * (x - px) + uy * (y - py) < 0 < rx * (x - hx) + ry * (y - hy)


def gap(m: Sequence[float], prev: Sequence[float], widest: int | None = None) -> str:
    """Line ends or spaces between two boxes; at most so many spaces as widest, if that is given."""
    p = (prev[0] or 1e-6, *prev[1:])
    w, h = math.hypot(p[0], p[1]), math.hypot(p[2], p[3])
    unit = SPACE_UNIT * h / w if w else SPACE_UNIT
    x0, y0 = at(m, 0, 0.5)
    det = p[0] * p[3] - p[1] * p[2]
    if not det:
        return ""
    dx, dy = x0 - p[4], y0 - p[5]
    x, y = (p[3] * dx - p[2] * dy) / det, (p[0] * dy - p[1] * dx) / det
    if not 0 < y < 1:
        return "\n" * int(round(abs(y - 0.5)))
    return _blank(max(0, math.ceil((x - 1 - SPACE_LEAST * unit) / unit)), widest)


def _blank(n: int, widest: int | None) -> str:
    return " " * (n if widest is None else min(n, widest))


def _box(m: Sequence[float]) -> tuple[float, float, float]:
    """(left edge, lowest, highest) of a matrix' unit square."""
    ps = [at(m, x, y) for x in (0, 1) for y in (0, 1)]
    return min(p[0] for p in ps), min(p[1] for p in ps), max(p[1] for p in ps)


def page_text(texts: list[str], ms: list[Sequence[float]], widest: int | None = None) -> str:
    """The text of a page's chunks; blank ones only count for the margin and the mean height."""
    if not ms:
        return ""
    boxes = [_box(m) for m in ms]
    left, height = min(b[0] for b in boxes), sum(b[2] - b[1] for b in boxes) / len(boxes)
    keep = [i for i, t in enumerate(texts) if t.strip(" ")]
    order = [keep[i] for i in reading_order([ms[i] for i in keep])]
    out = []
    for k, i in enumerate(order):
        space = gap(ms[i], ms[order[k - 1]], widest) if k else ""
        if space.startswith("\n"):
            space += _blank(int((boxes[i][0] - left) / (INDENT * height) if height else 0), widest)
        out.append(space + texts[i])
    return "".join(out)


def page_texts(found: DataFrame, key: str = "doc_id", widest: int | None = None) -> DataFrame:
    """(key, text) of chunks (key, seq, text, m). A page is one group: its chunks must fit in a task, others beside it
    needn't. A gap counts as many spaces as are as wide, which can be far more than the text itself; callers to which
    any gap is a space say widest=1."""
    bounded(found.sparkSession)
    grouped = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text", "m"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size, done = [], 0, 0
            for i, cs in enumerate(b.column(1)):  # page by page, as plain columns: objects of all fields take ten times the memory
                c = cs.values
                out.append(page_text(c.field("text").to_pylist(), c.field("m").to_pylist(), widest))
                size += len(out[-1])
                if size >= BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(out)), pa.array(out, pa.string())], ["key", "text"])
                    out, size, done = [], 0, i + 1

    kind = found.schema[key].dataType.simpleString()
    return grouped.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def gap_text(m: Column, prev: Column) -> Column:
    """gap() of upright boxes as an expression."""
    w, h = F.when(prev[0] == 0, F.lit(1e-6)).otherwise(prev[0]), prev[3]
    unit = F.lit(SPACE_UNIT) * h / w
    x, y = (m[4] - prev[4]) / w, (m[5] + m[3] * 0.5 - prev[5]) / h
    n = F.greatest(F.ceil((x - 1 - unit * SPACE_LEAST) / unit), F.lit(0)).cast("int")
    return F.when((y > 0) & (y < 1), F.repeat(F.lit(" "), n)).otherwise(F.repeat(F.lit("\n"), F.rint(F.abs(y - 0.5)).cast("int")))


# Window forms over command tables.


def product(ms: Column) -> Column:
    """Product of an array of matrices, first to last."""
    start = F.array(*[F.lit(v) for v in UNIT])
    flat = lambda m, n: F.array(*[m[r] * n[2 * k] + m[r + 2] * n[2 * k + 1] + (m[4 + r] if k == 2 else F.lit(0.0)) for k in range(3) for r in (0, 1)])
    return F.aggregate(ms, start, flat)


def parameter(cmds: DataFrame, op: str, key: str, default: float, arg: int = 0) -> Column:
    """The value that op last set, along (key, seq); right where no save or restore lies between."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(F.when(F.col("op") == op, F.get("args", F.lit(arg))), ignorenulls=True).over(w), F.lit(default))


def line_position(cmds: DataFrame, key: str) -> DataFrame:
    """cmds (key, seq, op, x, y) with tx, ty: where the line starts. BT and Tm set it, Td moves it."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = cmds.withColumn("_s", F.sum(F.col("op").isin("BT", "Tm").cast("int")).over(w))
    v = Window.partitionBy(key, "_s").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = lambda c: F.when(F.col("op").isin("Tm", "Td", "TD"), F.col(c)).otherwise(F.lit(0).cast("decimal(18,2)"))
    return x.withColumn("tx", F.sum(step("x")).over(v)).withColumn("ty", F.sum(step("y")).over(v)).drop("_s")


def displacement(n: Column, size: Column) -> Column:
    """How far a number within a text operand moves."""
    return -n * size / 1000


def is_space(gap_: Column, own: Column, space: Column, size: Column) -> Column:
    """Whether a gap, with the width of a space code before it, is read as a space."""
    return gap_ + own > space * size * SPACE_SHARE


def chunk_matrix(ctm: Column, tm: Column, width: Column, height: Column, shift: Column, base: Column) -> Column:
    """The matrix of a chunk's box, to three decimals; no width counts as 0.001."""
    from leafmill.functions.geometry import mat, mat_mul

    w = F.when(width == 0, F.lit(0.001)).otherwise(width)
    m = mat_mul(mat_mul(ctm, tm), mat(w, 0, 0, height, shift, base))
    return F.transform(m, lambda v: F.round(v, 3))


def ocr_commands(zones: DataFrame, page: str = "page") -> DataFrame:
    """Recognised words (page, ord, x0, y0, x1, y1, text) as commands (page, ord, stream) of invisible text."""
    from leafmill.functions.geometry import ocr_baseline
    from leafmill.functions.strings import literal

    size = F.col("y1") - F.col("y0")
    n = F.greatest(F.length("text"), F.lit(1))
    stretch = (F.col("x1") - F.col("x0")) / n / (size * 0.5) * 100
    base = ocr_baseline(F.col("y1"), F.col("y0"))
    line = F.format_string("BT 3 Tr /F1 %.2f Tf %.2f Tz 1 0 0 1 %.2f %.2f Tm %s Tj ET", size, stretch, F.col("x0"), base, literal(F.col("text")))
    return zones.where("text <> '' and y1 > y0 and x1 > x0").select(page, "ord", line.alias("stream"))
