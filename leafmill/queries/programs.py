"""Font programs, files with embedded fonts, containers and character map files over the parts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.batches import spread
from leafmill.operators import file_fonts, state
from leafmill.operators.images import transparency
from leafmill.queries import query, table
from leafmill.sources import codecs as C
from leafmill.sources import fax, ocr, pdf, sfnt, tiff

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def scrambled_font() -> bytes:
    """A program that shows each letter by the code of the one that lies as far from the other end."""
    shown = [chr(c) for c in range(32, 127)]
    swap = str.maketrans(LETTERS, LETTERS[::-1])
    codes = {0xF000 + ord(u.translate(swap)): g for g, u in enumerate(shown, 1)}
    return sfnt.program([500] + [600] * len(shown), {"30": codes}, [".notdef"] + [f"uni{ord(u):04X}" for u in shown])


@query("k7_font_constructor", "SELECT p_partkey, p_name || ' ' || p_type AS text, round(6.0 * length(p_name || ' ' || p_type), 3)::DOUBLE AS width, -2.0::DOUBLE AS y FROM part")
def k7_font_constructor(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text is only read right through the character map and the glyph names of their embedded font."""
    coded = F.translate(F.concat("p_name", F.lit(" "), "p_type"), LETTERS, LETTERS[::-1])
    stream = F.concat(F.lit("BT /F1 10 Tf ("), coded, F.lit(") Tj ET"))
    files = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", pdf.pages_file(F.array(stream), font=scrambled_font()).alias("content"))
    found = state.chunks(file_fonts.page_streams(files, "p_partkey"), "p_partkey")
    return found.select("p_partkey", "text", F.col("m")[0].alias("width"), F.col("m")[5].alias("y"))


@query("n1_font_programs", "SELECT p_partkey, 'TrueType' AS kind, p_size + 1 AS glyphs, round(p_size * 0.5 + 0.25, 6)::DOUBLE AS width, p_size::BIGINT AS mapped, 'uni' || upper(hex(64 + p_size)) AS last_name FROM part")
def n1_font_programs(spark: SparkSession, d: str) -> DataFrame:
    """A program for each size of part: one glyph more than its size, each mapped and named."""
    make = lambda n: sfnt.program([250] + [500] * n, {"31": {0x2000 + i: i for i in range(1, n + 1)}}, [".notdef"] + [f"uni{64 + i:X}" for i in range(1, n + 1)])
    data = C.column(lambda x: make(int(x)), F.encode(F.col("p_size").cast("string"), "UTF-8"))
    x = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", sfnt.programs(data).alias("i"))
    return x.select("p_partkey", "i.kind", "i.glyphs", F.round(F.aggregate(F.map_values("i.widths"), F.lit(0.0), lambda a, b: a + b), 6).alias("width"), F.size(F.col("i.maps")["31"]).cast("long").alias("mapped"), F.col("i.names")[F.col("i.glyphs") - 1].alias("last_name"))


@query("n5_added_map", "SELECT p_partkey, 65 + p_size AS code, 1 AS glyph, 95 AS kept FROM part")
def n5_added_map(spark: SparkSession, d: str) -> DataFrame:
    """A program given one more character map keeps the one it had."""
    font = scrambled_font()
    data = C.column(lambda x: sfnt.with_map(font, "31", {0x41 + int(x): 1}), F.encode(F.col("p_size").cast("string"), "UTF-8"))
    x = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", sfnt.programs(data).alias("i"))
    return x.select("p_partkey", F.map_keys(F.col("i.maps")["31"])[0].alias("code"), F.map_values(F.col("i.maps")["31"])[0].alias("glyph"), F.size(F.col("i.maps")["30"]).alias("kept"))


@query("k20_tiff_files", "SELECT doc_id, md5(text) AS digest, md5(text) AS deflated, 1::BIGINT AS height FROM documents")
def k20_tiff_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents' bytes as images of one row in files of one strip, plain and deflated, read again."""
    x = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    plain = C.column(lambda b: tiff.samples(tiff.file(b, len(b), 1)), F.col("raw"))
    packed = C.column(lambda b: tiff.samples(tiff.file(zlib.compress(b), len(b), 1, compression=tiff.DEFLATE)), F.col("raw"))
    height = C.column(lambda b: str(tiff.parts(tiff.file(b, len(b), 1))["height"]).encode(), F.col("raw"))
    return x.select("doc_id", F.md5(plain).alias("digest"), F.md5(packed).alias("deflated"), height.cast("string").cast("long").alias("height"))


@query("f17_facsimile_files", "SELECT vec_id, CAST(8 * list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS black FROM embeddings")
def f17_facsimile_files(spark: SparkSession, d: str) -> DataFrame:
    """Facsimile data under the header of a file, decoded through it."""
    octets = F.array_join(F.transform("embedding", lambda v: F.when(v > 0, "FF").otherwise("00")), "")
    back = C.column(lambda b: tiff.samples(tiff.file(fax.encode(b, 256), 256, 2, 1, compression=tiff.G4, photometric=0)), F.unhex(octets))
    ones = F.length(F.regexp_replace(F.hex(back), "[^F]", "")) * 4
    return table(spark, d, "embeddings").select("vec_id", ones.cast("long").alias("black"))


@query("s15_hyphenated_maps", "SELECT p_partkey, unnest([65, 66]) AS cc, unnest([substr(p_brand, 7, 1), chr(4096 + p_size)]) AS unicode FROM part")
def s15_hyphenated_maps(spark: SparkSession, d: str) -> DataFrame:
    body = F.format_string("own 65 66\n'%s' first\n'&#x%04X;' second\nown 65 66\n", F.substring("p_brand", 7, 1), F.col("p_size") + 4096)
    return ocr.character_maps(table(spark, d, "part").select("p_partkey", body.alias("content")), "p_partkey", "content", blocks=False)


@query("s16_block_maps", "SELECT p_partkey, unnest([16 * p_size, 16 * p_size + 2, 4096, 4097]) AS cc, unnest(['a', 'b', substr(p_brand, 7, 1), chr(ascii(substr(p_brand, 7, 1)) + 1)]) AS unicode FROM part")
def s16_block_maps(spark: SparkSession, d: str) -> DataFrame:
    """Rows of characters and a range, read, written and read again."""
    letter = F.ascii(F.substring("p_brand", 7, 1))
    body = F.format_string("<%X>\na.b.............\n<1000> <1001> <%04X>\n", F.col("p_size") * 16, letter)
    maps = lambda x: ocr.character_maps(x, "p_partkey", "content", blocks=True)
    once = table(spark, d, "part").select("p_partkey", body.alias("content"))
    return maps(ocr.block_map_texts(maps(once), "p_partkey"))


@query("c19_transparency_groups", "SELECT p_partkey, 'DeviceRGB' AS space, p_size % 2 = 0 AS isolated, p_size % 3 = 0 AS knockout FROM part WHERE p_size % 5 <> 0")
def c19_transparency_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of forms; every fifth form has one of another kind."""
    value = F.format_string('{"Type": "/XObject", "Group": {"S": "/%s", "CS": "/DeviceRGB"%s%s}}', F.when(F.col("p_size") % 5 == 0, "Other").otherwise("Transparency"), F.when(F.col("p_size") % 2 == 0, ', "I": true').otherwise(""), F.when(F.col("p_size") % 3 == 0, ', "K": true').otherwise(""))
    return transparency(table(spark, d, "part").select("p_partkey", F.lit(1).alias("obj_id"), value.alias("value")), "p_partkey").drop("obj_id")
