"""Font programs as plain functions: TrueType and OpenType tables, read and written, and the clear text of Type 1."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.batches import bounded

PATTERNS = "*.{ttf,otf,pfb,pfa,cff}"
_DUP = re.compile(rb"dup\s+(\d+)\s*/([^\s/\[\](){}<>%]+)\s+put")
_PAIRS = "array<struct<key:int,value:{}>>"
INFO = f"struct<kind:string,name:string,units:double,y0:double,y1:double,glyphs:int,widths:{_PAIRS.format('double')},names:{_PAIRS.format('string')},maps:array<struct<key:string,value:{_PAIRS.format('int')}>>,encoding:{_PAIRS.format('string')}>"


class FontError(ValueError):
    """A font program that can't be read."""


def tables(data: bytes) -> dict[str, bytes]:
    """The tables of a TrueType or OpenType program by their tags."""
    if data[:4] not in (b"\0\1\0\0", b"true", b"OTTO"):
        raise FontError("no TrueType or OpenType program")
    (n,) = struct.unpack_from(">H", data, 4)
    out = {}
    for k in range(n):
        tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * k)
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def _checksum(body: bytes) -> int:
    body += b"\0" * (-len(body) % 4)
    return sum(struct.unpack(f">{len(body) // 4}I", body)) & 0xFFFFFFFF


def build(parts: dict[str, bytes]) -> bytes:
    """A TrueType program of these tables."""
    n = len(parts)
    power = 1 << (n.bit_length() - 1)
    head = b"\0\1\0\0" + struct.pack(">HHHH", n, 16 * power, power.bit_length() - 1, 16 * (n - power))
    at, rows, body = 12 + 16 * n, b"", b""
    for tag in sorted(parts):
        x = parts[tag]
        rows += struct.pack(">4sIII", tag.encode("latin-1"), _checksum(x), at + len(body), len(x))
        body += x + b"\0" * (-len(x) % 4)
    return head + rows + body


def _segments(t: bytes) -> dict[int, int]:
    """Codes of a map of segments (format 4)."""
    (twice,) = struct.unpack_from(">H", t, 6)
    n, out = twice // 2, {}
    last, first = struct.unpack_from(f">{n}H", t, 14), struct.unpack_from(f">{n}H", t, 16 + twice)
    delta, at = struct.unpack_from(f">{n}H", t, 16 + 2 * twice), struct.unpack_from(f">{n}H", t, 16 + 3 * twice)
    for k in range(n):
        for c in range(first[k], last[k] + 1):
            g = c
            if at[k]:
                p = 16 + 3 * twice + 2 * k + at[k] + 2 * (c - first[k])
                g = struct.unpack_from(">H", t, p)[0] if p + 2 <= len(t) else 0
                if not g:
                    continue
            g = (g + delta[k]) & 0xFFFF
            if g and c != 0xFFFF:
                out[c] = g
    return out


def _codes(t: bytes) -> dict[int, int]:
    kind = struct.unpack_from(">H", t)[0]
    if kind == 0:
        return {c: g for c, g in enumerate(t[6:262]) if g}
    if kind == 4:
        return _segments(t)
    if kind == 6:
        first, n = struct.unpack_from(">HH", t, 6)
        return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", t, 10)) if g}
    if kind == 12:
        out = {}
        for k in range(struct.unpack_from(">I", t, 12)[0]):
            a, b, g = struct.unpack_from(">III", t, 16 + 12 * k)
            out |= {c: g + c - a for c in range(a, min(b, 0x10FFFF) + 1) if g + c - a}
        return out
    return {}


def character_maps(table: bytes) -> dict[str, dict[int, int]]:
    """Code to glyph number of each map, by platform and encoding: '31' is (3, 1)."""
    out: dict[str, dict[int, int]] = {}
    for k in range(struct.unpack_from(">H", table, 2)[0]):
        platform, encoding, at = struct.unpack_from(">HHI", table, 4 + 8 * k)
        out.setdefault(f"{platform}{encoding}", _codes(table[at:]))
    return out


def map_table(maps: dict[str, dict[int, int]]) -> bytes:
    """The table of such maps; codes beyond 16 bits are left out."""
    head, body, at = struct.pack(">HH", 0, len(maps)), b"", 4 + 8 * len(maps)
    for name in sorted(maps):
        cs = sorted(c for c in maps[name] if c < 0xFFFF)
        n = len(cs) + 1
        power = 1 << (n.bit_length() - 1)
        ends = [*cs, 0xFFFF]
        deltas = [(maps[name][c] - c) & 0xFFFF for c in cs] + [1]
        one = struct.pack(">HHHH", 2 * n, 2 * power, power.bit_length() - 1, 2 * (n - power)) + struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{n}H", *ends) + struct.pack(f">{n}H", *deltas) + bytes(2 * n)
        one = struct.pack(">HHH", 4, 6 + len(one), 0) + one
        head += struct.pack(">HHI", int(name[0]), int(name[1:]), at + len(body))
        body += one
    return head + body


def with_map(data: bytes, name: str, codes: dict[int, int]) -> bytes:
    """The program with one more character map, or another one of this name."""
    t = tables(data)
    maps = character_maps(t["cmap"]) if "cmap" in t else {}
    return build(t | {"cmap": map_table(maps | {name: codes})})


def program(widths: list[int], maps: dict[str, dict[int, int]], names: list[str], units: int = 1000) -> bytes:
    """A program without outlines: widths, maps and names of its glyphs."""
    n = len(widths)
    head = struct.pack(">IIIIHHQQhhhhHHhhh", 0x10000, 0, 0, 0x5F0F3CF5, 0, units, 0, 0, 0, -units // 5, units, units * 4 // 5, 0, 8, 2, 0, 0)
    hhea = struct.pack(">IhhhHhhhhhhhhhhhH", 0x10000, units * 4 // 5, -units // 5, 0, max(widths), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, n)
    own = b"".join(bytes((len(x),)) + x.encode("latin-1") for x in names)
    post = struct.pack(">IIhhIIIII", 0x20000, 0, 0, 0, 0, 0, 0, 0, 0) + struct.pack(">H", n) + struct.pack(f">{n}H", *(258 + i for i in range(n))) + own
    return build({"head": head, "hhea": hhea, "maxp": struct.pack(">IH", 0x5000, n), "hmtx": b"".join(struct.pack(">Hh", w, 0) for w in widths), "cmap": map_table(maps), "post": post})


def _names(post: bytes) -> dict[int, str]:
    """Names of glyphs that the program itself spells out."""
    if len(post) < 34 or post[:4] != b"\0\2\0\0":
        return {}
    n = struct.unpack_from(">H", post, 32)[0]
    at, own = 34 + 2 * n, []
    while at < len(post):
        own.append(post[at + 1 : at + 1 + post[at]].decode("latin-1"))
        at += 1 + post[at]
    index = struct.unpack_from(f">{n}H", post, 34)
    return {g: own[i - 258] for g, i in enumerate(index) if 258 <= i < 258 + len(own)}


def _true_type(data: bytes) -> dict:
    t = tables(data)
    units = struct.unpack_from(">H", t["head"], 18)[0] or 1000
    n = struct.unpack_from(">H", t["maxp"], 4)[0]
    up, down = struct.unpack_from(">hh", t["hhea"], 4)
    long = max(struct.unpack_from(">H", t["hhea"], 34)[0], 1)
    wide = [struct.unpack_from(">H", t["hmtx"], 4 * min(g, long - 1))[0] / units for g in range(n)]
    kind = "OpenType" if data[:4] == b"OTTO" else "TrueType"
    return {"kind": kind, "name": None, "units": float(units), "y0": down / units, "y1": up / units, "glyphs": n, "widths": dict(enumerate(wide)), "names": _names(t.get("post", b"")), "maps": character_maps(t["cmap"]) if "cmap" in t else {}, "encoding": {}}


def _type1(data: bytes) -> dict:
    if data[:1] == b"\x80":  # segments, of which the first is text
        data = data[6 : 6 + int.from_bytes(data[2:6], "little")]
    text = data.partition(b"eexec")[0]
    if not text.startswith(b"%!"):
        raise FontError("no Type 1 program")
    find = lambda rule: (re.search(rule, text) or [b"", b""])[1]
    matrix, box = [[float(x) for x in find(rb"/" + k + rb"\s*[\[{]([^\]}]*)").split()] for k in (b"FontMatrix", b"FontBBox")]
    scale = matrix[0] if matrix else 0.001
    encoding = {int(c): n.decode("latin-1") for c, n in _DUP.findall(text)}
    return {"kind": "Type1", "name": find(rb"/FontName\s*/(\S+)").decode("latin-1") or None, "units": 1 / scale, "y0": box[1] * scale if len(box) == 4 else None, "y1": box[3] * scale if len(box) == 4 else None, "glyphs": None, "widths": {}, "names": {}, "maps": {}, "encoding": encoding}


@lru_cache(maxsize=32)
def info(data: bytes) -> dict | None:
    """What a program says of itself: kind, units, height, widths by glyph number, names, character maps and, for
    Type 1, its encoding. None for what can't be read, as bare CFF. Don't change what it gives: it is kept."""
    try:
        return _type1(data) if data[:1] in (b"%", b"\x80") else _true_type(data)
    except (FontError, struct.error, KeyError, ValueError, IndexError):
        return None


def programs(data: Column) -> Column:
    """info() of a column: a struct, of which widths, names, encoding and maps (and what these hold) are maps."""
    pairs = lambda key, value: pa.list_(pa.struct([("key", key), ("value", value)]))
    kinds = {"widths": pa.float64(), "names": pa.string(), "maps": pairs(pa.int32(), pa.int32()), "encoding": pa.string()}
    kind = pa.struct([("kind", pa.string()), ("name", pa.string()), ("units", pa.float64()), ("y0", pa.float64()), ("y1", pa.float64()), ("glyphs", pa.int32()), *((k, pairs(pa.string() if k == "maps" else pa.int32(), v)) for k, v in kinds.items())])
    entries = lambda m: [{"key": k, "value": entries(v) if isinstance(v, dict) else v} for k, v in m.items()]
    bounded()

    def run(col: pa.Array) -> pa.Array:
        each: dict[bytes | None, int] = {}  # the distinct programs of the batch, each read and laid out once
        places = pa.array([each.setdefault(x, len(each)) for x in col.to_pylist()], pa.int64())
        found = [None if x is None else info(x) for x in each]
        return pa.array([i and i | {k: entries(i[k]) for k in kinds} for i in found], kind).take(places)

    def shaped(x: Column) -> Column:
        plain = [x[k].alias(k) for k in ("kind", "name", "units", "y0", "y1", "glyphs")]
        maps = F.map_from_entries(F.transform(x["maps"], lambda m: F.struct(m["key"], F.map_from_entries(m["value"]))))
        return F.when(x.isNotNull(), F.struct(*plain, *(F.map_from_entries(x[k]).alias(k) for k in ("widths", "names", "encoding")), maps.alias("maps")))

    return F.element_at(F.transform(F.array(F.arrow_udf(run, INFO)(data)), shaped), 1)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, program, info) of the font files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATTERNS).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content").alias("program"), programs(F.col("content")).alias("info"))
