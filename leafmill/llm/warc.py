"""WARC files: a sequential reader, and the writer that makes its input here.

One gzip member holds one record. The reader inflates a stream bit by bit, frames each record by its
Content-Length and verifies its digests, so a task holds one record and a read buffer, whatever the size
of the file. A file is one task's work; files are spread over tasks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._spark import arrow_batches, new_path, written

READ = 1 << 16
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "file string, no long, offset long, type string, record_id string, uri string, date string, content_length long, http_status int, payload binary, digest_ok boolean, error string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.string()]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _same_digest(said: str, data: bytes) -> bool | None:
    """Whether a digest header is right; None for an algorithm that isn't known."""
    algorithm, _, value = said.partition(":")
    try:
        h = hashlib.new(algorithm.strip().lower(), data)
    except ValueError:
        return None
    value = value.strip()
    return value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=") or value.lower() == h.hexdigest()


def members(f: BinaryIO) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, inflated bytes, error) of each gzip member; after a broken one the next magic number is sought."""
    buf, base, ended = b"", 0, False  # base: offset of buf in the file
    while True:
        if not buf and not ended:
            buf = f.read(READ)
            ended = not buf
        if not buf:
            return
        start, inflate, out, error = base, zlib.decompressobj(31), [], None
        while not inflate.eof:
            try:
                out.append(inflate.decompress(buf))
            except zlib.error as e:
                error = f"gzip: {e}"
                break
            if inflate.eof:
                rest = inflate.unused_data
                base += len(buf) - len(rest)
                buf = rest
                break
            base += len(buf)
            buf = f.read(READ)
            if not buf:
                ended = True
                error = "gzip: the member is cut short"
                break
        yield start, b"".join(out), error
        if error and not ended:  # on to the next member
            buf, base = buf[1:], base + 1
            while (i := buf.find(MAGIC)) < 0:
                more = f.read(READ)
                if not more:
                    return
                base += max(len(buf) - 2, 0)
                buf = buf[-2:] + more if len(buf) >= 2 else buf + more
            buf, base = buf[i:], base + i


def _plain(f: BinaryIO, head: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, bytes, error) of each record of a file that isn't compressed."""
    buf, base = head, 0
    while True:
        while (i := buf.find(b"\r\n\r\n")) < 0:
            more = f.read(READ)
            if not more:
                if buf.strip():
                    yield base, buf, None
                return
            buf += more
        try:
            size = int(next(x.split(b":")[1] for x in buf[:i].split(b"\r\n") if x.lower().startswith(b"content-length:")))
        except (StopIteration, ValueError):
            yield base, buf[:i], None
            return
        end = i + 4 + size + 4
        parts, have = [buf], len(buf)
        while have < end and (more := f.read(max(READ, end - have))):
            parts.append(more)
            have += len(more)
        buf = b"".join(parts)
        yield base, buf[:end], None
        buf, base = buf[end:], base + min(end, have)


def record(data: bytes) -> dict:
    """Fields of one record: its header, then a block of Content-Length bytes, then two line ends."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return {"error": "no WARC header"}
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:  # a folded line
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    out: dict = {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date")}
    try:
        size = int(fields["content-length"])
        if size < 0:
            raise ValueError
    except (KeyError, ValueError):
        return out | {"error": "no Content-Length"}
    out["content_length"] = size
    block = rest[:size]
    if len(block) < size:
        return out | {"error": "the block is shorter than Content-Length"}
    if rest[size:] not in (b"\r\n\r\n", b""):
        out["error"] = "the block is longer than Content-Length"
    body, ok = block, []
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, sep, body = block.partition(b"\r\n\r\n")
        word = http.split(b"\r\n", 1)[0].split(b" ")
        if len(word) > 1 and word[1].isdigit():
            out["http_status"] = int(word[1][:9])
    out["payload"] = body
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", body)):
        if name in fields:
            ok.append(_same_digest(fields[name], part))
    known = [x for x in ok if x is not None]
    out["digest_ok"] = all(known) if known else None
    return out


def records(f: BinaryIO) -> Iterator[dict]:
    """Records of an open file, compressed or not, in order."""
    head = f.read(READ)
    source = members(_Joined(head, f)) if head[:2] == MAGIC[:2] else _plain(f, head)
    for no, (offset, data, error) in enumerate(source):
        r = record(data) if data or not error else {}
        yield r | {"no": no, "offset": offset} | ({"error": error} if error else {})


class _Joined:
    """A stream with bytes put back before it."""

    def __init__(self, head: bytes, f: BinaryIO):
        self.head, self.f = head, f

    def read(self, n: int) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.f.read(n)


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in held], t) for k, t in zip(NAMES, TYPES)], NAMES)
        held.clear()
        return b

    for b in batches:
        for path in b.column(0).to_pylist():
            with _open(path) as f:
                for r in records(f):
                    held.append(r | {"file": path})
                    size += len(r.get("payload") or b"")
                    if size > 4 << 20 or len(held) >= 1000:
                        yield flush()
                        size = 0
    if held:
        yield flush()


def read_files(files: DataFrame) -> DataFrame:
    """Records of the files that the first column of files names; one row each.

    A record with a broken member, header or frame has error set and what could be read; reading goes on
    with the next member. digest_ok is null where no digest is given. payload is the block, of an HTTP
    record its body. Empty files and tables give no rows.
    """
    return files.mapInArrow(_read, SCHEMA)


def read(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """Records of all files below path; only their names are listed, not their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return read_files(found.select("path"))


def member(record_id: str, kind: str, uri: str | None, block: bytes, payload: bytes | None, http: bool, level: int = 1) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if http:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"WARC-Block-Digest: {digest(block)}")
    if payload is not None:
        head.append(f"WARC-Payload-Digest: {digest(payload)}")
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(root)
        system.create_dir(path, recursive=True)
        # an attempt has its own file, and only files of attempts that succeeded are named in the result
        name = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        n = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as f:
            for b in batches:
                for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3))):
                    rid = f"urn:page:{'' if page is None else page}"
                    if html is None:
                        f.write(member(rid, "metadata", url, b"", None, False))
                    else:
                        body = html.encode()
                        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                        f.write(member(rid, "response", url, block, body, True))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write (page_id, url, html) as WARC files in the shared folder, one a partition: (path, records).

    Null html becomes a metadata record without a block, a null url no target, a null page_id an empty id.
    """
    arrow_batches(spark, 500)
    root = new_path(spark, "warc")
    root = root if "://" in root else "file://" + root.removeprefix("file:")
    rows = pages.select("page_id", "url", "html").mapInArrow(_write(root), "path string, records long")
    return written(rows, "archive")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, html, n_bytes, digest_ok) of pages, read from WARC files that hold them.

    Nulls come back as nulls (digest_ok is then that of the empty block); line ends in a url come back percent-encoded. Repeated
    rows are records of their own. Very long pages are whole. No rows: no rows. Other columns aren't written.
    """
    files = archive(spark, pages)
    got = read_files(files.select("path").repartition(max(1, files.count())))
    html = F.when(F.col("type") == "response", F.col("payload").cast("string"))
    return got.select(F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"), F.col("uri").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), "digest_ok")
