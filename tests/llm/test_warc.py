import gzip
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import warc as W


def http(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body


def one(i: int, body: bytes) -> bytes:
    return W.member(f"urn:page:{i}", "response", f"http://x/{i}", http(body), body, True)


class Slow(io.RawIOBase):
    """Gives a few bytes at a time."""

    def __init__(self, data, step):
        self.f, self.step = io.BytesIO(data), step

    def read(self, n=-1):
        return self.f.read(min(n, self.step) if n > 0 else self.step)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=6), st.integers(1, 50))
def test_round_trip_whatever_the_reads(bodies, step):
    data = b"".join(one(i, b) for i, b in enumerate(bodies))
    got = list(W.records(Slow(data, max(step, 2))))
    assert [r["payload"] for r in got] == bodies
    assert all(r["digest_ok"] and "error" not in r and r["http_status"] == 200 for r in got)
    at = 0
    for r, b in zip(got, bodies):
        assert r["offset"] == at
        at += len(one(r["no"], b))


def test_uncompressed_files():
    data = b"".join(gzip.decompress(one(i, b"body %d" % i)) for i in range(3))
    got = list(W.records(Slow(data, 11)))
    assert [r["payload"] for r in got] == [b"body 0", b"body 1", b"body 2"]


def test_broken_files_give_errors_and_go_on():
    a, b, c = one(1, b"first"), one(2, b"second" * 50), one(3, b"third")
    bad = bytearray(b)
    bad[len(b) // 2] ^= 0xFF
    got = list(W.records(io.BytesIO(a + bytes(bad) + c)))
    assert got[0]["payload"] == b"first" and got[-1]["payload"] == b"third" and any(r.get("error") for r in got)
    got = list(W.records(io.BytesIO(a + b[:-20])))
    assert "cut short" in got[1]["error"]
    assert list(W.records(io.BytesIO(b""))) == []
    assert W.record(b"junk")["error"] == "no WARC header"
    assert W.record(b"WARC/1.0\r\nWARC-Type: x\r\n\r\nabc")["error"] == "no Content-Length"
    assert "shorter" in W.record(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")["error"]
    assert "longer" in W.record(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")["error"]


def test_digests():
    raw = gzip.decompress(one(1, b"body"))
    assert W.record(raw)["digest_ok"] is True
    assert W.record(raw.replace(b"body", b"bodi"))["digest_ok"] is False
    assert W.record(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")["digest_ok"] is None
    assert W._same_digest("md5:900150983cd24fb0d6963f7d28e17f72", b"abc") and W._same_digest("odd:xx", b"abc") is None


def test_folded_headers():
    assert W.record(b"WARC/1.0\r\nWARC-Target-URI: a\r\n b\r\nContent-Length: 0\r\n\r\n\r\n\r\n")["uri"] == "a b"


def test_pages_round_trip(spark):
    rows = [(1, "http://a/", "<p>x"), (2, None, "y"), (None, "http://b/", "z"), (3, "u", None), (4, "v", ""), (5, "w", "ü\r\n\r\n" * 100_000), (6, "r", "same"), (6, "r", "same"), (7, "a\nb", "n")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload string, no int")
    got = sorted((tuple(r) for r in W.round_trip(spark, df).collect()), key=str)
    want = sorted(((i, u and u.replace("\n", "%0A"), h, None if h is None else len(h.encode()), True) for i, u, h in rows), key=str)
    assert got == want
    assert W.round_trip(spark, df.limit(0)).count() == 0


def test_reads_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.warc.gz").write_bytes(b"".join(one(10 * k + i, b"x" * i) for i in range(4)))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = W.read(spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r["digest_ok"] for r in got)


def test_members_hold_one_record_each():
    z = zlib.decompressobj(31)
    z.decompress(one(1, b"a") + one(2, b"b"))
    assert z.unused_data == one(2, b"b")
    with pytest.raises(KeyError):
        W.record(gzip.decompress(one(1, b"a")))["error"]
