"""Images in files made of embeddings, and their places on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import strings as S
from leafmill.operators import images as O
from leafmill.queries import query, table
from leafmill.queries.codecs import _bytes
from leafmill.sources import codecs as C


@query("s10_image_export", "SELECT vec_id, 16 AS width, 4 AS height, 'DeviceGray' AS space, CAST(list_sum(list_transform(embedding, lambda v: CAST(floor(abs(v) * 100) AS BIGINT) % 256)) AS BIGINT) AS total, printf('v%d.page0001.image%04d.png', vec_id, vec_id % 10000) AS name FROM embeddings")
def s10_image_export(spark: SparkSession, d: str) -> DataFrame:
    """Image objects to PNG files, taken apart again."""
    objs = table(spark, d, "embeddings").select(
        "vec_id", F.lit(1).alias("obj_id"), F.lit("stream").alias("kind"), F.lit("Image").alias("subtype"),
        F.lit('{"Width": 16, "Height": 4, "BitsPerComponent": 8, "ColorSpace": "/G"}').alias("value"), _bytes("embedding").alias("data"), F.array().cast("array<string>").alias("left"),
    )
    x = O.images(objs, "vec_id").withColumn("png", O.png(F.col("samples"), F.col("width"), F.col("height"), F.col("bits"), F.col("space")))
    back = C.column(_png_rows, F.col("png"))
    name = O.file_name(F.concat(F.lit("v"), "vec_id"), F.lit(1), F.col("vec_id") % 10000)
    return x.select("vec_id", "width", "height", "space", F.aggregate(S.hex_codes(back, 1), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), name.alias("name"))


def _png_rows(data: bytes) -> bytes:
    import zlib

    return C.png_unfilter(zlib.decompress(C.png_parts(data)["idat"]), 16)


@query("t14_canvas_matrices", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 2 / 10 + 1e-9, 6) + 0.0 AS a, round(-2 * l_discount * -1 / 20 * 1 + 1e-9, 6) + 0.0 AS d, round((l_tax - 10) * 2 + 1e-9, 6) + 0.0 AS e, round(2 * 792 - (3 + l_discount) * 2 + 1e-9, 6) + 0.0 AS f FROM lineitem")
def t14_canvas_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Where images of ten by twenty pixels lie on a canvas of 144 dots an inch."""
    ctm = G.mat(F.col("l_quantity"), 0, 0, F.col("l_discount"), F.col("l_tax"), 3)
    m = O.on_canvas(ctm, G.box(10, 0, 622, 792), F.lit(10.0), F.lit(20.0), dpi=144)
    r = lambda x: F.round(x + F.lit(1e-9), 6) + F.lit(0.0)
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r(F.col("m")[i]).alias(k) for i, k in ((0, "a"), (3, "d"), (4, "e"), (5, "f"))])


@query("a11_type3_boxes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE WHEN p_size % 3 = 0 THEN p_size + 5.0 ELSE 1.0 END::DOUBLE AS x1 FROM part")
def a11_type3_boxes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    own = F.when(s % 2 == 0, G.box(0, 0, s, 1)).otherwise(G.box(0, 0, 0, 0))
    glyphs = F.when(s % 3 == 0, F.array(G.box(0, 0, s, 1), G.box(1, -1, s + 5, 1))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    return table(spark, d, "part").select("p_partkey", O.type3_box(own, glyphs).alias("b")).select("p_partkey", F.col("b.x1").alias("x1"))
