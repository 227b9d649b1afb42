"""Stream filters over the supplied texts and numbers."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.functions.batches import bounded
from leafmill.queries import query, table
from leafmill.sources import codecs as C


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))


SAME = "SELECT doc_id, md5(text) AS digest FROM documents"


@query("f1_filter_names", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Fl' WHEN 1 THEN 'AHx' ELSE 'Own' END || ' RL' AS names FROM nation")
def f1_filter_names(spark: SparkSession, d: str) -> DataFrame:
    first = F.element_at(F.array(*map(F.lit, ("FlateDecode", "AHx", "Own"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(C.short_names(F.array(first, F.lit("RunLengthDecode"))), " ").alias("names"))


@query("f2_filter_chain", "SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 4 = 3 THEN 'DCT' ELSE '' END AS left_ FROM documents")
def f2_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    """Streams under four chains of filters, one of which ends in an image filter."""
    k = F.col("doc_id") % 4
    hexed = lambda x: F.encode(F.concat(F.hex(x), F.lit(">")), "UTF-8")
    x = _docs(spark, d)
    flate, run_length = C.column(zlib.compress, F.when(k < 2, F.col("raw"))), C.column(C.to_run_length, F.when(k == 2, F.col("raw")))  # a column's function meets every row
    raw = F.when(k == 0, flate).when(k == 1, hexed(flate)).when(k == 2, run_length).otherwise(hexed(F.col("raw")))
    names = F.when(k == 0, F.array(F.lit("FlateDecode"))).when(k == 1, F.array(F.lit("AHx"), F.lit("Fl"))).when(k == 2, F.array(F.lit("RL"))).otherwise(F.array(F.lit("ASCIIHexDecode"), F.lit("DCT")))
    return x.select("doc_id", C.decoded(raw, names).alias("y")).select("doc_id", F.md5("y.data").alias("digest"), F.array_join("y.left", " ").alias("left_"))


@query("f3_ascii_hex", SAME)
def f3_ascii_hex(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(S.hex_bytes(F.hex("raw"))).alias("digest"))


@query("f4_ascii85", SAME)
def f4_ascii85(spark: SparkSession, d: str) -> DataFrame:
    packed = C.column(C.to_ascii85, F.col("raw"))
    return _docs(spark, d).select("doc_id", packed.alias("p")).select("doc_id", F.md5(C.column(C.ascii85, F.col("p"))).alias("digest"))


@query("f5_flate", "SELECT doc_id, md5(text) AS digest, md5(text) AS repaired, doc_id % 2 = 1 AS broken FROM documents")
def f5_flate(spark: SparkSession, d: str) -> DataFrame:
    """Whole streams, streams without their checksum, and bytes of which every other one is no stream at all."""
    x = _docs(spark, d).withColumn("p", C.column(zlib.compress, F.col("raw")))
    cut = F.col("p").substr(F.lit(1), F.octet_length("p") - 4)
    none = F.when(F.col("doc_id") % 2 == 1, F.lit(b"\x00\x00\xff\xff")).otherwise(F.col("p"))
    y = x.select("doc_id", C.grown(C.flate, F.col("p"), cut, none).alias("y")).select("doc_id", *(F.get("y", F.lit(k)).alias(f"y{k}") for k in range(3)))
    return y.select("doc_id", F.md5("y0").alias("digest"), F.md5("y1").alias("repaired"), F.col("y2").isNull().alias("broken"))


@query("f7_lzw", SAME)
def f7_lzw(spark: SparkSession, d: str) -> DataFrame:
    """Streams of table codes of 9 to 12 bits, whose widths grow a code early in every other one."""
    x = _docs(spark, d)
    even = F.col("doc_id") % 2 == 0  # a column's function meets every row, so each gets null for the rows of the other
    early, late = (C.column(lambda b, e=e: C.lzw(_lzw_codes(b, e), e), F.when(even if e else ~even, F.col("raw"))) for e in (1, 0))
    return x.select("doc_id", F.md5(F.coalesce(early, late)).alias("digest"))


def _lzw_codes(data: bytes, early: int) -> bytes:
    """The longest known strings as codes; a full table is cleared."""
    places, widths = C.lzw_places(early)
    parts: list[np.ndarray] = []
    table: dict[int, int] = {}
    codes: list[int] = []
    n, at = 258, -1

    def put(mark: int) -> None:
        codes.append(mark)
        x, w = np.array(codes, np.uint32), widths[: len(codes)]
        bits = (x[:, None] >> np.arange(11, -1, -1, dtype=np.uint32) & 1).astype(np.uint8)
        parts.append(bits[np.arange(11, -1, -1) < w[:, None]])

    for b in data:
        known = b if at < 0 else table.get(at << 8 | b)
        if known is not None:
            at = known
            continue
        codes.append(at)
        table[at << 8 | b] = n
        n += 1
        if n > 4094:
            put(256)
            table, codes, n = {}, [], 258
        at = b
    if at >= 0:
        codes.append(at)
    put(257)
    return np.packbits(np.concatenate([np.unpackbits(np.array([128, 0], np.uint8))[:9], *parts])).tobytes()


@query("f8_run_length", SAME)
def f8_run_length(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).withColumn("p", C.column(C.to_run_length, F.col("raw")))
    return x.select("doc_id", F.md5(C.column(C.run_length, F.col("p"))).alias("digest"))


@query(
    "f9_runs",
    """WITH x AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
    SELECT user_id, event_type, min(event_id) AS start, count(*) AS n FROM x GROUP BY user_id, event_type, g""",
)
def f9_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal values as rows, what run-length coding rests on."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    e = e.withColumn("run", F.sum((F.coalesce(F.lag("event_type").over(w), F.lit("")) != F.col("event_type")).cast("int")).over(w))
    return e.groupBy("user_id", "event_type", "run").agg(F.min("event_id").alias("start"), F.count("*").alias("n")).drop("run")


@query("f10_png_rows", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda v: CAST(floor(abs(v) * 100) AS BIGINT) % 256)) AS BIGINT) AS total FROM embeddings")
def f10_png_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows filtered by each of the five filters and restored."""
    x = table(spark, d, "embeddings").select("vec_id", _bytes("embedding").alias("raw"))
    back = C.column(lambda b: C.png_unfilter(_png_filter(b, 16), 16), F.col("raw"))
    return x.select("vec_id", F.aggregate(S.hex_codes(back, 1), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


def _bytes(column: str):
    return F.unhex(F.array_join(F.transform(column, lambda v: F.format_string("%02X", (F.floor(F.abs(v) * F.lit(100).cast("float")) % 256).cast("int"))), ""))


def _png_filter(data: bytes, columns: int) -> bytes:
    """Row i under filter i modulo 5."""
    out, prev = bytearray(), bytes(columns)
    for i in range(0, len(data), columns):
        cur, kind = data[i : i + columns], i // columns % 5
        out.append(kind)
        for j, v in enumerate(cur):
            a, b, c = (cur[j - 1] if j else 0), prev[j], (prev[j - 1] if j else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) >> 1, near)[kind]) & 255)
        prev = cur
    return bytes(out)


@query("f11_tiff_predictor", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS v FROM lineitem")
def f11_tiff_predictor(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.sum(F.col("l_quantity").cast("long")).over(w) % 256).alias("v"))


@query("f12_png_files", "SELECT vec_id, 16::BIGINT AS width, 4::BIGINT AS height, CAST(list_sum(list_transform(embedding, lambda v: CAST(floor(abs(v) * 100) AS BIGINT) % 256)) AS BIGINT) AS total FROM embeddings")
def f12_png_files(spark: SparkSession, d: str) -> DataFrame:
    """PNG files about rows of sixteen pixels, taken apart again with their checksums verified."""
    x = table(spark, d, "embeddings").select("vec_id", _bytes("embedding").alias("raw"))
    file = C.column(lambda b: C.png_file(16, len(b) // 16, 8, 0, zlib.compress(_png_filter(b, 16))), F.col("raw"))
    x = x.select("vec_id", file.alias("f"))
    body = C.column(lambda f: C.png_unfilter(zlib.decompress(C.png_parts(f)["idat"]), 16), F.col("f"))
    number = lambda at: F.conv(F.hex(F.col("f").substr(at, 4)), 16, 10).cast("long")
    return x.select("vec_id", number(17).alias("width"), number(21).alias("height"), F.aggregate(S.hex_codes(body, 1), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("f13_pixel_unpack", "SELECT doc_id, CAST(list_sum(list_transform(string_split(hex(encode(text)), ''), lambda c: CAST('0x' || c AS INT))) AS BIGINT) AS total FROM documents")
def f13_pixel_unpack(spark: SparkSession, d: str) -> DataFrame:
    """Samples of four bits: every byte holds two."""
    bounded()
    total = F.arrow_udf(lambda col: pa.array([None if x is None else int(C.unpack_pixels(x, len(x), 2, 4).sum(dtype=np.int64)) if x else 0 for x in col.to_pylist()], pa.int64()), "long")
    return _docs(spark, d).select("doc_id", total("raw").alias("total"))


@query("f14_pixel_pack", SAME)
def f14_pixel_pack(spark: SparkSession, d: str) -> DataFrame:
    """Bytes unpacked to samples of two bits and packed again."""
    back = C.column(lambda b: C.pack_pixels(C.unpack_pixels(b, 4, 1, 2), 2), F.col("raw"))
    return _docs(spark, d).select("doc_id", F.md5(back).alias("digest"))


@query("f15_predictors", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 14 THEN 15 ELSE p_size END AS predictor FROM part")
def f15_predictors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.normal_predictor(F.col("p_size")).alias("predictor"))


@query("f19_dictionary_batches", "SELECT p_partkey // 20 AS batch, count(*) AS pages FROM part GROUP BY 1")
def f19_dictionary_batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(C.batch_of(F.col("p_partkey") + 1).alias("batch")).agg(F.count("*").alias("pages"))


@query("f23_recompression_rule", "SELECT p_partkey, p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size < 30) OR p_size * 10 < 30 * 9 AS wins FROM part")
def f23_recompression_rule(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("RLE", "PNG", "JPEG"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.wins(kind, F.lit(30), F.col("p_size")).alias("wins"))


@query("f16_fax_images", "SELECT vec_id, CAST(96 * list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS black FROM embeddings")
def f16_fax_images(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of 3,072 pixels, in runs of 96 and more, under two-dimensional facsimile coding and back."""
    from leafmill.sources import fax

    bits = F.array_join(F.transform("embedding", lambda v: F.repeat(F.when(v > 0, "1").otherwise("0"), F.lit(96))), "")
    octets = F.transform(F.regexp_extract_all(bits, F.lit(".{8}"), 0), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0"))
    x = table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(octets, "")).alias("raw"))
    back = C.column(lambda b: fax.decode(fax.encode(b, 3072), 3072), F.col("raw"))
    return x.select("vec_id", F.aggregate(S.hex_codes(back, 1), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b)).alias("black"))
