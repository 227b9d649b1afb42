"""Stream filters as plain functions on bytes, and as Arrow columns."""

from __future__ import annotations

import binascii
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.batches import BYTES, bounded

SHORT = {"ASCIIHexDecode": "AHx", "ASCII85Decode": "A85", "LZWDecode": "LZW", "FlateDecode": "Fl", "RunLengthDecode": "RL", "CCITTFaxDecode": "CCF", "DCTDecode": "DCT", "JPXDecode": "JPX", "JBIG2Decode": "JB2"}
#: Filters whose result is an image; a chain stops before them.
IMAGE_FILTERS = frozenset(("CCF", "DCT", "JPX", "JB2"))
BLANK = re.compile(rb"[\s\x00]+")
DIGITS_85 = bytes(range(33, 118))
REPEAT = re.compile(rb"(.)\1\1\1{0,125}", re.DOTALL)  # two by name: that fails faster than {2,127}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


class FilterError(ValueError):
    """Data that a filter can't decode."""


def ascii_hex(data: bytes) -> bytes:
    """Digits up to the end mark, which is required."""
    body, mark, _ = data.partition(b">")
    if not mark:
        raise FilterError("no end of hexadecimal data")
    digits = BLANK.sub(b"", body)
    return binascii.unhexlify(digits + b"0" * (len(digits) % 2))


def ascii85(data: bytes) -> bytes:
    """Groups of five digits up to the end mark, which is required; z is a group of zeros. Some 64 thousand groups at once,
    so little is held beyond the data and its result."""
    body, mark, _ = data.partition(b"~>")
    if not mark:
        raise FilterError("no end of base 85 data")
    body = body.translate(None, b" \t\n\r\f\v\0")
    if b"z" in body:
        zeros = np.flatnonzero(np.frombuffer(body, np.uint8) == ord("z"))
        if ((zeros - np.arange(len(zeros))) % 5).any():
            raise FilterError("z inside a group of base 85 digits")
        body = body.replace(b"z", b"!!!!!")
    if other := body.translate(None, DIGITS_85):
        raise FilterError(f"no base 85 digit: {other[:1]!r}")
    rest = -len(body) % 5
    body += b"u" * rest
    out = bytearray()
    for at in range(0, len(body), 5 << 16):
        digits = np.frombuffer(body[at : at + (5 << 16)], np.uint8).reshape(-1, 5)
        value = np.zeros(len(digits), np.int64)
        for k in range(5):
            value = value * 85 + digits[:, k] - 33
        if (value >> 32).any():
            raise FilterError("a group of base 85 digits beyond 32 bits")
        out += value.astype(">u4").tobytes()
    return bytes(out[: len(out) - rest])


def to_ascii85(data: bytes, line: int = 72) -> bytes:
    """Base 85 digits in lines of so many, z for four zeros, and the end mark."""
    rest = -len(data) % 4
    out = bytearray()
    for at in range(0, len(data), 4 << 16):
        part = data[at : at + (4 << 16)]
        value = np.frombuffer(part + bytes(-len(part) % 4), ">u4").astype(np.int64)
        digits = np.empty((len(value), 5), np.uint8)
        short = value == 0
        if rest and at + len(part) == len(data):
            short[-1] = False
        for k in range(4, -1, -1):
            digits[:, k] = value % 85 + 33
            value //= 85
        keep = np.ones(digits.shape, bool)
        keep[short, 1:] = False
        digits[short, 0] = ord("z")
        out += digits[keep].tobytes()
    body = bytes(out[: len(out) - rest])
    return b"\n".join(body[k : k + line] for k in range(0, len(body), line)) + b"~>"


def flate(data: bytes) -> bytes:
    """Inflated data; if the checksum or the header is broken, what the raw stream after it gives."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        try:
            return zlib.decompressobj(-15).decompress(data[2:])
        except zlib.error as e:
            raise FilterError(str(e)) from e


@lru_cache(maxsize=2)
def lzw_places(early: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, widths) in bits of the codes after a clear, as far as they grow; all codes beyond have 12 bits. The first
    code adds no string and the table holds 258, so code j is read while 257 + j strings are known."""
    known = np.arange(257, 257 + 4096)
    known[0] = 258
    widths = sum((known >= (1 << w) - early).astype(np.int64) for w in (9, 10, 11)) + 9
    return np.cumsum(widths) - widths, widths


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable-width codes, 256 clears the table and 257 ends; early is 1 if widths grow one code early."""
    places, widths = lzw_places(early)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at, grown = 8 * len(data), 0, False
    out: list[bytes] = []
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, before = fresh.copy(), b""
    while True:
        start, size = (at + np.arange(len(places)) * 12, 12) if grown else (at + places, widths)
        n = int(np.searchsorted(start + size, bits, "right"))
        start, size = start[:n], (size if grown else size[:n])
        byte = start >> 3
        found = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (start & 7) - size)) & ((1 << size) - 1)
        marks = np.flatnonzero((found == 256) | (found == 257))
        here = int(marks[0]) if len(marks) else n
        for code in found[:here].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise FilterError(f"code {code} of {len(table)}")
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            out.append(entry)
            before = entry
        if here < n and found[here] == 256:
            at = int(start[here] + (12 if grown else size[here]))
            table, before, grown = fresh.copy(), b"", False
        elif here < n or n < len(places):
            return b"".join(out)
        else:
            at, grown = int(start[-1]) + 12, True


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def to_run_length(data: bytes) -> bytes:
    """Runs of three and more as repeats, all between as literals of up to 128; no end mark. Repeats are found one
    after another, so little is held beyond the data and its result."""
    out, done = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(done, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for repeat in REPEAT.finditer(data):
        at, end = repeat.span()
        literal(at)
        out += bytes((257 - (end - at), data[at]))
        done = end
    literal(len(data))
    return bytes(out)


def png_unfilter(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Rows of a filter byte and differences, undone."""
    bpp, width = max(1, colors * bits // 8), -(-columns * colors * bits // 8)
    prev = np.zeros(width, np.uint8)
    rows = []
    for at in range(0, len(data), width + 1):
        kind = data[at]
        cur = np.frombuffer(data[at + 1 : at + 1 + width].ljust(width, b"\0"), np.uint8).copy()
        if kind == 1:
            for k in range(bpp):
                cur[k::bpp] = np.cumsum(cur[k::bpp], dtype=np.uint8)
        elif kind == 2:
            cur += prev
        elif kind in (3, 4):
            left, up = [0] * bpp, [0] * bpp + prev.tolist()
            line = cur.tolist()
            for i, v in enumerate(line):
                a, b, c = left[i], up[i + bpp], up[i]
                if kind == 3:
                    v += (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    v += a if p <= q and p <= r else b if q <= r else c
                left.append(v & 255)
            cur = np.array(left[bpp:], np.uint8)
        elif kind:
            raise FilterError(f"row filter {kind}")
        rows.append(cur.tobytes())
        prev = cur
    return b"".join(rows)


def tiff_unfilter(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Differences along rows, undone; components of 8 or fewer bits."""
    x = unpack_pixels(data, columns, colors, bits)
    return pack_pixels(np.cumsum(x, axis=1, dtype=np.int64) % (1 << bits), bits)


def unpack_pixels(data: bytes, width: int, colors: int, bits: int) -> np.ndarray:
    """(height, width, colors) of samples, most significant bit first, rows on whole bytes. What is
    beyond the last whole row is dropped."""
    line = -(-width * colors * bits // 8)
    height = len(data) // line
    raw = np.frombuffer(data, np.uint8, height * line).reshape(height, line)
    if bits in (8, 16, 32):
        return raw.view(f">u{bits // 8}").reshape(height, width, colors).astype(np.uint32)
    if bits in (1, 2, 4):
        parts = np.arange(256, dtype=np.uint32)[:, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint32) & (1 << bits) - 1
        return parts[raw].reshape(height, line * 8 // bits)[:, : width * colors].reshape(height, width, colors)
    flat = np.unpackbits(raw, axis=1)[:, : width * colors * bits].reshape(height, width, colors, bits)
    return (flat.astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(axis=3, dtype=np.uint32)


def pack_pixels(x: np.ndarray, bits: int) -> bytes:
    """The inverse of unpack_pixels."""
    x = np.asarray(x, np.uint32)
    if bits in (8, 16, 32):
        return x.astype(f">u{bits // 8}").tobytes()
    if not x.size:
        return b""
    flat = (x[..., None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(flat.reshape(len(x), -1).astype(np.uint8), axis=1).tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_file(width: int, height: int, bits: int, color: int, idat: bytes, palette: bytes = b"") -> bytes:
    """A PNG file about a deflated body whose rows have filter bytes."""
    head = struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + (_chunk(b"PLTE", palette) if palette else b"") + _chunk(b"IDAT", idat) + _chunk(b"IEND", b"")


def png_parts(data: bytes) -> dict:
    """Size, depth, color kind, palette and joined body of a PNG file; checksums are verified."""
    if not data.startswith(PNG_MAGIC):
        raise FilterError("no PNG file")
    at, out = 8, {"idat": b"", "palette": b""}
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise FilterError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            out |= dict(zip(("width", "height", "bits", "color"), struct.unpack_from(">IIBB", body)))
        elif kind == b"IDAT":
            out["idat"] += body
        elif kind == b"PLTE":
            out["palette"] = body
        at += 12 + n
    return out


def unpredict(data: bytes, parms: Mapping[str, str]) -> bytes:
    """data with the predictor of the decoding parameters undone."""
    kind = int(parms.get("Predictor", 1))
    args = int(parms.get("Columns", 1)), int(parms.get("Colors", 1)), int(parms.get("BitsPerComponent", 8))
    if kind == 2:
        return tiff_unfilter(data, *args)
    return png_unfilter(data, *args) if kind >= 10 else data


def apply_filters(data: bytes, filters: Sequence[str], parms: Sequence[Mapping[str, str]] = ()) -> tuple[bytes, list[str]]:
    """(decoded data, filters that are left: none, or one for images)."""
    for i, name in enumerate(filters):
        short, p = SHORT.get(name, name), parms[i] if i < len(parms) and parms[i] else {}
        if short in IMAGE_FILTERS:
            if i + 1 < len(filters):
                raise FilterError("an image filter that isn't the last")
            return data, list(filters[i:])
        if short == "LZW":
            data = unpredict(lzw(data, int(p.get("EarlyChange", 1))), p)
        elif short == "Fl":
            data = unpredict(flate(data), p)
        elif short in PLAIN:
            data = PLAIN[short](data)
        else:
            raise FilterError(f"filter {name}")
    return data, []


PLAIN: dict[str, Callable[[bytes], bytes]] = {"AHx": ascii_hex, "A85": ascii85, "RL": run_length, "Fl": flate, "LZW": lzw}


def column(f: Callable[[bytes], bytes], data: Column) -> Column:
    """f over a binary column, in Arrow batches; null for null and for data that f rejects. Equal data within a batch
    meets f once."""
    bounded()

    def run(col: pa.Array) -> pa.Array:
        each: dict[bytes | None, bytes | None] = {}
        return pa.array([each[x] if x in each else each.setdefault(x, _one(f, x)) for x in (v.as_py() for v in col)], pa.binary())

    return F.arrow_udf(run, "binary")(data)


def _one(f: Callable[[bytes], bytes], x: bytes | None) -> bytes | None:
    try:
        return None if x is None else f(x)
    except (FilterError, binascii.Error, ValueError, zlib.error):
        return None


def grown(f: Callable[[bytes], bytes], *data: Column) -> Column:
    """column() of several columns at once, as an array, for an f whose results may be far larger than its data: they leave
    the worker in pieces, so it holds one row's results beyond a bound. Equal data within a piece meets f once."""
    bounded()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            out, each, size = [], {}, 0
            for xs in (v.as_py() for v in col):
                out.append([each[x] if x in each else each.setdefault(x, _one(f, x)) for x in xs])
                size += sum(len(y or b"") for y in out[-1])
                if size >= BYTES:
                    yield pa.array(out, pa.list_(pa.binary()))
                    out, each, size = [], {}, 0
            if out:
                yield pa.array(out, pa.list_(pa.binary()))

    return F.arrow_udf(run, "array<binary>")(F.array(*data))


def decoded(data: Column, filters: Column) -> Column:
    """struct(data, left, error) of each stream under its own chain of filters; they leave the worker in pieces, so it holds
    one stream's data beyond a bound."""

    bounded()
    kind = pa.struct([("data", pa.binary()), ("left", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, chain in batches:
            out, size = [], 0
            for x, fs in ((x.as_py(), fs.as_py()) for x, fs in zip(col, chain)):
                try:
                    body, left = apply_filters(x or b"", fs or [])
                    out.append({"data": body, "left": left, "error": None})
                    size += len(body)
                except (FilterError, binascii.Error, ValueError, zlib.error) as e:
                    out.append({"data": None, "left": None, "error": str(e)[:200]})
                if size >= BYTES:
                    yield pa.array(out, kind)
                    out, size = [], 0
            if out:
                yield pa.array(out, kind)

    return F.arrow_udf(run, "struct<data:binary,left:array<string>,error:string>")(data, filters)


def short_names(filters: Column) -> Column:
    """Full filter names as short ones; others stay."""
    names = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    return F.transform(filters, lambda f: F.coalesce(F.try_element_at(names, f), f))


def normal_predictor(p: Column) -> Column:
    """All row predictors of PNG are one: the rows say which."""
    return F.when(p.between(10, 14), 15).otherwise(p)


def wins(kind: Column, old: Column, new: Column) -> Column:
    """Whether a recompressed stream replaces the old one: always if lossless and asked for, for PNG if it is
    smaller at all, else if it saves a tenth."""
    return kind.isin("ZIP", "RLE") | ((kind == "PNG") & (new < old)) | (new * 10 < old * 9)


def batch_of(page: Column, size: int = 20) -> Column:
    """The batch of pages, numbered from 1, that share a dictionary."""
    return F.floor((page - 1) / size).cast("long")
