"""What Python workers hold is bounded in whatever thread and session a query is built, and however its data grows."""

import re
import threading
from pathlib import Path

import psutil
import pytest

from leafmill.queries import load

QUERIES, SQL = load()


def _built(spark, sf, name) -> tuple[int, int]:
    """Rows and bytes of Arrow batches once the query is built in a thread of its own."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for k in keys:
        spark.conf.unset(k)
    t = threading.Thread(target=QUERIES[name], args=(spark, sf))
    t.start()
    t.join()
    return tuple(int(spark.conf.get(k).rstrip("bB")) for k in keys)


@pytest.mark.parametrize("name", ["f5_flate", "f8_run_length", "f4_ascii85", "f2_filter_chain"])
def test_batches_are_bounded_in_any_thread_and_session(spark, sf, name):
    for s in (spark, spark.newSession()):
        rows, size = _built(s, sf, name)
        assert rows <= 1000 and size <= 4 << 20


def test_a_column_in_a_thread_bounds_the_default_session(spark):
    from pyspark.sql import functions as F

    from leafmill.sources import codecs

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = threading.Thread(target=lambda: codecs.column(codecs.flate, F.lit(b"")))
    t.start()
    t.join()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def _peak() -> int:
    """MB of the largest Python worker so far."""
    most = 0
    for p in psutil.Process().children(recursive=True):
        if "pyspark.daemon" in " ".join(p.cmdline()):
            most = max(most, int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) // 1024)
    return most


def _long(spark, tmp_path, name) -> list:
    """The query over 40 documents of 4 MB that pack to a thousandth."""
    from pyspark.sql import functions as F

    x = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.chr(F.col("id") + 65), F.lit(4 << 20)).alias("text"))
    x.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return QUERIES[name](spark, str(tmp_path)).collect()


def test_inflated_streams_leave_a_worker_in_pieces(spark, tmp_path):
    from hashlib import md5

    got = {r["doc_id"]: (r["digest"], r["repaired"], r["broken"]) for r in _long(spark, tmp_path, "f5_flate")}
    whole = {k: md5(bytes((k + 65,)) * (4 << 20)).hexdigest() for k in range(40)}
    assert got == {k: (d, d, k % 2 == 1) for k, d in whole.items()}
    assert 0 < _peak() < 400


def test_decoded_streams_leave_a_worker_in_pieces(spark):
    from pyspark.sql import functions as F

    from leafmill.sources import codecs

    def peak(run):
        """Most bytes that Python has allocated while the step ran over 30 streams of 1 MB that pack to a thousandth."""
        import tracemalloc
        import zlib

        import pyarrow as pa

        cols = pa.array([zlib.compress(bytes((k,)) * (1 << 20)) for k in range(30)], pa.binary()), pa.array([["Fl"]] * 30, pa.list_(pa.string()))
        tracemalloc.start()
        for _ in run(iter([cols])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    steps = []
    real = F.arrow_udf
    try:
        F.arrow_udf = lambda f, kind: steps.append(f) or real(f, kind)
        codecs.decoded(F.lit(b""), F.array(F.lit("Fl")))
    finally:
        F.arrow_udf = real
    assert peak(steps[0]) < 8 << 20


def _held(f, data: bytes) -> int:
    """Most bytes that Python has allocated while f ran."""
    import tracemalloc

    tracemalloc.start()
    f(data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_base_85_holds_a_small_multiple_of_its_row():
    import base64
    import random

    from leafmill.sources import codecs

    raw = random.Random(1).randbytes(1 << 20)
    packed = base64.a85encode(raw, wrapcol=72) + b"~>"
    assert codecs.ascii85(packed) == raw
    assert _held(codecs.ascii85, packed) < 10 << 20
    assert _held(codecs.to_ascii85, raw) < 20 << 20


def test_run_length_holds_a_small_multiple_of_its_row():
    import random

    from leafmill.sources import codecs

    for raw in (bytes(random.Random(1).choices(b"abcdefgh", k=1 << 20)), b"aaabbb" * 170_000, b"a" * (1 << 20)):
        packed = codecs.to_run_length(raw)
        assert codecs.run_length(packed) == raw
        assert _held(codecs.to_run_length, raw) < 5 << 20
        assert _held(codecs.run_length, packed) < 5 << 20
