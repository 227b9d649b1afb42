"""Recognition layers and glyph lists made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.functions.batches import spread
from leafmill.queries import query, table
from leafmill.sources import ocr


@query("p11_annotation_scripts", "SELECT p_partkey, p_size AS page, 'word' AS kind, p_size * 10.0::DOUBLE AS x1, p_name AS text FROM part UNION ALL SELECT p_partkey, p_size, 'line', 1000.0, NULL FROM part")
def p11_annotation_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a page with one line of one word."""
    x1 = F.col("p_size") * 10
    script = F.format_string('# page\nselect %d; set-txt (line 0 0 1000 20 (word 0 0 %d 20 "%s"))\n.', "p_size", x1, S.octal_escapes(F.col("p_name")))
    z = ocr.zones(table(spark, d, "part").select("p_partkey", script.alias("script")), "p_partkey", "script", script=True)
    return z.select("p_partkey", "page", "kind", "x1", "text")


@query("p12_octal_round_trip", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def p12_octal_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts escaped by an expression, read back by the parser."""
    t = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.concat(F.lit('set-txt (page 0 0 1 1 "'), S.octal_escapes(F.col("text")), F.lit('")')).alias("s"))
    z = ocr.zones(t.select(F.concat_ws(" ", "k.conv_id", "k.turn").alias("k"), "s"), "k", "s", script=True)
    part = lambda i: F.split("k", " ")[i].cast("long")
    return z.select(part(0).alias("conv_id"), part(1).alias("turn"), F.md5("text").alias("digest"))


@query("n8_marked_up_layers", "SELECT p_partkey, p_size * 1.0::DOUBLE AS x1, p_name AS text FROM part")
def n8_marked_up_layers(spark: SparkSession, d: str) -> DataFrame:
    page = F.format_string('<div class="ocr_page" title="image x; bbox 0 0 99 99"><span class="ocr_line" title="bbox 0 0 50 9; baseline 0.01 -2"><b title="bbox 0 0 %d 9" class="ocrx_word">%s</b></span></div>', "p_size", "p_name")
    z = ocr.zones(spread(table(spark, d, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", page.alias("page")), "p_partkey", "page", script=False)
    return z.where("kind = 'ocrx_word' and page = 1 and path = '/ocr_page/ocr_line/ocrx_word'").select("p_partkey", "x1", "text")


@query("s14_glyph_list_lines", "SELECT n_name AS glyph, chr(65 + n_nationkey) || chr(97) AS unicode FROM nation")
def s14_glyph_list_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.format_string("%s;%04X 0061", "n_name", F.col("n_nationkey") + 65)
    return ocr.glyph_lines(table(spark, d, "nation"), line).select("glyph", "unicode")
