"""TIFF containers as plain functions: strips joined, one-strip files written, facsimile data wrapped and unwrapped."""

from __future__ import annotations

import struct
import zlib

from leafmill.sources import fax
from leafmill.sources.codecs import FilterError, lzw

SIZES = {1: "B", 2: "s", 3: "H", 4: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, OPTIONS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 292, 317
PLAIN, G3, G4, LZW, DEFLATE = 1, 3, 4, 5, 8


def parts(data: bytes) -> dict:
    """Size, depth, kind and joined strips of the first image of a file, still compressed if in one strip."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise FilterError("no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in SIZES or kind == 2:
            continue
        code = f"{order}{n}{SIZES[kind]}"
        place = at + 10 + 12 * k
        if struct.calcsize(code) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = list(struct.unpack_from(code, data, place))
    one = lambda tag, default: tags.get(tag, [default])[0]
    if STRIPS not in tags or len(tags[STRIPS]) != len(tags.get(COUNTS, [])):
        raise FilterError("no strips")
    strips = [data[a : a + n] for a, n in zip(tags[STRIPS], tags[COUNTS])]
    kind = one(COMPRESSION, PLAIN)
    if kind in (LZW, DEFLATE, 32946) and len(strips) > 1:  # strips are compressed each by itself
        strips, kind = [lzw(s) if kind == LZW else zlib.decompress(s) for s in strips], PLAIN
    elif len(strips) > 1 and kind != PLAIN:
        raise FilterError("several strips of facsimile data")
    return {"width": one(WIDTH, 0), "height": one(HEIGHT, 0), "bits": one(BITS, 1), "samples": one(SAMPLES, 1), "compression": kind, "white_is_0": one(PHOTOMETRIC, 0) == 0, "predictor": one(PREDICTOR, 1), "options": one(OPTIONS, 0), "body": b"".join(strips)}


def file(body: bytes, width: int, height: int, bits: int = 8, samples: int = 1, compression: int = PLAIN, photometric: int = 1, options: int = 0) -> bytes:
    """A file of one image in one strip."""
    rows = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, bits), (COMPRESSION, 3, compression), (PHOTOMETRIC, 3, photometric), (STRIPS, 4, 0), (SAMPLES, 3, samples), (ROWS, 4, height), (COUNTS, 4, len(body)), (OPTIONS, 4, options)]
    at = 8 + 2 + 12 * len(rows) + 4
    out = struct.pack("<2sHIH", b"II", 42, 8, len(rows))
    for tag, kind, value in rows:
        value = at if tag == STRIPS else value
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return out + struct.pack("<I", 0) + body


def samples(data: bytes) -> bytes:
    """Packed samples of the first image: plain, deflated, LZW or two-dimensional facsimile strips."""
    p = parts(data)
    kind = p["compression"]
    if kind == G4:
        got = fax.decode(p["body"], p["width"], rows=p["height"])
        return got if p["white_is_0"] else bytes(v ^ 255 for v in got)
    if p["predictor"] not in (0, 1):
        raise FilterError(f"predictor {p['predictor']}")
    if kind == PLAIN:
        return p["body"]
    if kind in (DEFLATE, 32946):
        return zlib.decompress(p["body"])
    if kind == LZW:
        return lzw(p["body"])
    raise FilterError(f"compression {kind}")
