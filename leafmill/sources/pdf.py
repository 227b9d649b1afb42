"""Page-description files: a reader to tables of objects and references, and a writer of simple files.

A file is one row and one task's work, as its objects are found through offsets; files are spread over
tasks. The reader follows cross-reference tables and streams from the last one back, hybrid files included,
loads object streams, and scans the whole file for objects where the references are broken.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.batches import bounded
from leafmill.sources.codecs import FilterError, apply_filters

_SPACE = re.compile(rb"(?:[\s\x00]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\s\x00()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_REFERENCE = re.compile(rb"(\d+)[\s\x00]+(\d+)[\s\x00]+R(?![^\s\x00()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\s\x00]+(\d+)[\s\x00]+obj(?![a-zA-Z])")
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """A file, or a part of one, that isn't well formed."""


class Name(str):
    """A name, without its slash."""


class Ref(int):
    """A reference to an object's number."""


class Reader:
    """Objects from one position on in a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def value(self):
        """The next object: None, bool, number, Name, Ref, bytes, list or dict; a bare word is a str."""
        self.skip()
        d, c = self.data, self.data[self.at : self.at + 1]
        if c == b"/":
            m = _WORD.match(d, self.at + 1)
            raw = m.group() if m else b""
            self.at += 1 + len(raw)
            return Name(_HASH.sub(lambda h: bytes((int(h.group(1), 16),)), raw).decode("latin-1"))
        if c == b"(":
            return self.literal()
        if d.startswith(b"<<", self.at):
            self.at += 2
            items = self.until(b">>")
            return {str(k): v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        if c == b"<":
            end = d.find(b">", self.at)
            if end < 0:
                raise PdfError("a hexadecimal string without an end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self.until(b"]")
        m = _REFERENCE.match(d, self.at)
        if m:
            self.at = m.end()
            return Ref(int(m.group(1)))
        m = _WORD.match(d, self.at)
        if not m:
            raise PdfError(f"nothing to read at {self.at}")
        self.at = m.end()
        w = m.group()
        if _NUMBER.match(w):
            return float(w) if b"." in w else int(w)
        return {b"true": True, b"false": False, b"null": None}.get(w, w.decode("latin-1"))

    def until(self, close: bytes) -> list:
        out = []
        while True:
            self.skip()
            if self.data.startswith(close, self.at):
                self.at += len(close)
                return out
            if self.at >= len(self.data):
                raise PdfError(f"no {close.decode()}")
            out.append(self.value())

    def literal(self) -> bytes:
        out, depth, d, i = bytearray(), 1, self.data, self.at + 1
        while True:
            c = d[i : i + 1]
            if not c:
                raise PdfError("a string without an end")
            i += 1
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(d, i)
                if m:
                    out.append(int(m.group(), 8) & 255)
                    i = m.end()
                else:
                    x = d[i : i + 1]
                    i += 2 if d.startswith(b"\r\n", i) else 1
                    out += b"" if x in (b"\n", b"\r") else ESCAPED.get(x, x)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                self.at = i
                return bytes(out)
            out += c


class File:
    """A file's objects by number; get() reads one."""

    def __init__(self, data: bytes):
        self.data = data
        self.where: dict[int, tuple[int, int]] = {}  # number -> (0, offset) or (stream's number, index)
        self.trailer: dict = {}
        self.packed: dict[int, list[tuple[int, object]]] = {}
        try:
            self.chain()
        except (PdfError, FilterError, ValueError, KeyError, TypeError, IndexError):
            self.where = {}
        if not self.where:
            self.scan()

    def chain(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        todo, done = [int(Reader(self.data, at + 9).value())], set()
        while todo:
            at = todo.pop(0)
            if at in done:
                continue
            done.add(at)
            r = Reader(self.data, at)
            r.skip()
            if self.data.startswith(b"xref", r.at):
                r.at += 4
                t = self.table(r)
                if "XRefStm" in t:
                    todo.append(t["XRefStm"])
            else:
                t = self.stream_table(at)
            self.trailer = t | self.trailer
            if "Prev" in t:
                todo.append(int(t["Prev"]))

    def table(self, r: Reader) -> dict:
        while True:
            first = r.value()
            if first == "trailer":
                return r.value()
            for k in range(r.value()):
                offset, _, kind = r.value(), r.value(), r.value()
                if kind == "n":
                    self.where.setdefault(first + k, (0, offset))

    def stream_table(self, at: int) -> dict:
        _, d, raw = self.at_offset(at)
        body, _ = self.decoded(d, raw)
        w = d["W"]
        index = d.get("Index") or [0, d["Size"]]
        pos = 0
        for first, n in zip(index[::2], index[1::2]):
            for k in range(n):
                f = []
                for size in w:
                    f.append(int.from_bytes(body[pos : pos + size], "big"))
                    pos += size
                kind = f[0] if w[0] else 1
                if kind == 1:
                    self.where.setdefault(first + k, (0, f[1]))
                elif kind == 2:
                    self.where.setdefault(first + k, (f[1], f[2]))
        return d

    def scan(self) -> None:
        for m in _OBJECT.finditer(self.data):
            self.where[int(m.group(1))] = (0, m.start())
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= Reader(self.data, m.end()).value()
            except (PdfError, TypeError):
                continue
        for n in list(self.where):
            try:
                v, _ = self.get(n)
            except (PdfError, ValueError, KeyError):
                continue
            if isinstance(v, dict) and v.get("Type") == "ObjStm":
                for i, (k, _) in enumerate(self.unpacked(n)):
                    self.where.setdefault(k, (n, i))
            if isinstance(v, dict) and v.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n))

    def at_offset(self, at: int) -> tuple[int, object, bytes | None]:
        m = _OBJECT.match(self.data, _SPACE.match(self.data, at).end())
        if not m:
            raise PdfError(f"no object at {at}")
        r = Reader(self.data, m.end())
        v = r.value()
        r.skip()
        if not isinstance(v, dict) or not self.data.startswith(b"stream", r.at):
            return int(m.group(1)), v, None
        start = r.at + 6
        start += 2 if self.data.startswith(b"\r\n", start) else 1
        n = v.get("Length")
        if isinstance(n, Ref):
            n = self.get(n)[0] if n in self.where and self.where[n][1] != at else None
        if not isinstance(n, int) or not self.data.startswith(b"endstream", _SPACE.match(self.data, start + n).end()):
            end = self.data.find(b"endstream", start)
            n = (end if end >= 0 else len(self.data)) - start
            n -= self.data[start : start + n].endswith(b"\n")
        return int(m.group(1)), v, self.data[start : start + n]

    def get(self, number: int) -> tuple[object, bytes | None]:
        """(value, raw stream or None); null for a number that isn't there."""
        home, at = self.where.get(number, (0, -1))
        if home:
            found = self.unpacked(home)
            return (found[at][1] if at < len(found) else None), None
        if at < 0:
            return None, None
        _, v, raw = self.at_offset(at)
        return v, raw

    def decoded(self, d: dict, raw: bytes) -> tuple[bytes, list[str]]:
        one = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        parms = [{k: str(v) for k, v in (p or {}).items()} for p in one(d.get("DecodeParms"))]
        return apply_filters(raw, [str(f) for f in one(d.get("Filter"))], parms)

    def unpacked(self, number: int) -> list[tuple[int, object]]:
        """(number, value) of the objects within an object stream."""
        if number not in self.packed:
            d, raw = self.get(number)
            if not isinstance(d, dict) or raw is None:
                raise PdfError(f"object {number} is no object stream")
            body, _ = self.decoded(d, raw)
            head = Reader(body)
            pairs = [(head.value(), head.value()) for _ in range(d["N"])]
            self.packed[number] = [(k, Reader(body, d["First"] + at).value()) for k, at in pairs]
        return self.packed[number]


def plain(v):
    """A value for JSON: names begin with a slash, strings are text in Latin-1, references are {"ref": n}."""
    if isinstance(v, Ref):
        return {"ref": int(v)}
    if isinstance(v, Name):
        return "/" + v
    if isinstance(v, bytes):
        return v.decode("latin-1")
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


def references(v, key: str = "", index: int | None = None) -> Iterator[tuple[str, int | None, int]]:
    """(key, position in an array or None, number) of all references within a value."""
    if isinstance(v, Ref):
        yield key, index, int(v)
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from references(x, f"{key}/{k}" if key else k, None)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from references(x, key, i)


OBJECTS = "obj_id int, kind string, type string, subtype string, value string, data binary, left array<string>, refs array<struct<key:string,ord:int,dst:int>>, error string"
_REFS = pa.list_(pa.struct([("key", pa.string()), ("ord", pa.int32()), ("dst", pa.int32())]))
_TYPES = [pa.int32(), *[pa.string()] * 4, pa.binary(), pa.list_(pa.string()), _REFS, pa.string()]


def read_file(data: bytes) -> Iterator[dict]:
    """One row an object, decoded; the trailer is object 0."""
    f = File(data)
    for n in [0, *sorted(k for k in f.where if k)]:
        row = dict.fromkeys(("kind", "type", "subtype", "value", "data", "left", "error")) | {"obj_id": n, "refs": []}
        try:
            v, raw = (f.trailer, None) if not n else f.get(n)
            if raw is not None:
                row["data"], row["left"] = f.decoded(v, raw)
            row["kind"] = "trailer" if not n else "stream" if raw is not None else type(plain(v)).__name__
            if isinstance(v, dict):
                row["type"], row["subtype"] = (None if v.get(k) is None else str(v[k]) for k in ("Type", "Subtype"))
            row["value"] = json.dumps(plain(v))
            row["refs"] = [{"key": k, "ord": i, "dst": t} for k, i, t in references(v)]
        except (PdfError, FilterError, ValueError, KeyError, TypeError, RecursionError) as e:
            row["error"] = str(e)[:200]
        yield row


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["obj_id", "kind", "type", "subtype", "value", "data", "left", "refs", "error"]
    for b in batches:
        for i, data in enumerate(b.column(1).to_pylist()):
            rows = list(read_file(data)) if data else []
            cols = [pa.array([r[k] for r in rows], t) for k, t in zip(names, _TYPES)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows), pa.int64())), *cols], ["key", *names])


def objects(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, OBJECTS) of files: one row an object, with its stream decoded and the references it holds."""
    kind = files.schema[key].dataType.simpleString()
    bounded(files.sparkSession)
    return files.select(key, F.col(content).alias("content")).mapInArrow(_read, f"key {kind}, {OBJECTS}").withColumnRenamed("key", key)


def edges(objs: DataFrame, key: str = "path") -> DataFrame:
    """(doc, src, key, ord, dst) of all references, as walks take them."""
    x = objs.select(F.col(key).alias("doc"), F.col("obj_id").alias("src"), F.explode("refs").alias("r"))
    return x.select("doc", "src", "r.key", "r.ord", "r.dst")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Objects of all files under a path."""
    return objects(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content"))


@lru_cache(maxsize=8)
def _deflated(font: bytes) -> bytes:
    return zlib.compress(font)


def write_file(contents: list[bytes], width: float = 612, height: float = 792, packed: bool = False, font: bytes | None = None) -> bytes:
    """A file of one page for each content stream. packed: page objects in an object stream, and the
    cross-references as a stream. font: a TrueType program to embed in place of Helvetica."""
    n = len(contents)
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(n))
    body = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {n} /Kids [{kids}] /MediaBox [0 0 {width:g} {height:g}] >>".encode(), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    streams: dict[int, bytes] = {}
    for i, c in enumerate(contents):
        body[4 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode()
        z = zlib.compress(c)
        streams[5 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream"
    size = 4 + 2 * n
    if font is not None:
        body[3] = f"<< /Type /Font /Subtype /TrueType /BaseFont /Own /FontDescriptor {size} 0 R >>".encode()
        body[size] = f"<< /Type /FontDescriptor /FontName /Own /Flags 4 /FontFile2 {size + 1} 0 R >>".encode()
        z = _deflated(font)
        streams[size + 1] = b"<< /Length %d /Length1 %d /Filter /FlateDecode >>\nstream\n" % (len(z), len(font)) + z + b"\nendstream"
        size += 2
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(k: int, text: bytes) -> None:
        at[k] = len(out)
        out.extend(b"%d 0 obj\n" % k + text + b"\nendobj\n")

    if packed:
        head, parts, pos = [], [], 0
        for k, text in body.items():
            head.append(f"{k} {pos}")
            parts.append(text)
            pos += len(text) + 1
        first = " ".join(head).encode() + b"\n"
        z = zlib.compress(first + b"\n".join(parts))
        put(size, b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(body), len(first), len(z)) + z + b"\nendstream")
    else:
        streams |= body
    for k in sorted(streams):
        put(k, streams[k])
    start = len(out)
    if packed:
        inside = {k: i for i, k in enumerate(body)}
        rows = bytearray()
        for k in range(size + 1):
            kind, a, b = (2, size, inside[k]) if k in inside else (1, at[k], 0) if k in at else (0, 0, 0)
            rows += bytes((kind,)) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
        z = zlib.compress(bytes(rows))
        put(size + 1, b"<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Length %d /Filter /FlateDecode >>\nstream\n" % (size + 1, len(z)) + z + b"\nendstream")
        out += b"startxref\n%d\n%%%%EOF\n" % start
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        for k in range(1, size):
            out += b"%010d 00000 n \n" % at[k]
        out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, start)
    return bytes(out)


def pages_file(contents: Column, packed: bool = False, font: bytes | None = None) -> Column:
    """A file from an array of content streams (text), as a column."""
    bounded()

    def run(col: pa.Array) -> pa.Array:
        return pa.array([write_file([(c or "").encode() for c in cs or []], packed=packed, font=font) for cs in col.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(contents)
