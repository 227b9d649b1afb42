"""Colors, pixels and functions over parts, line items and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import color as C
from leafmill.functions import pdf_functions as P
from leafmill.queries import query, table

SPACES = ("DeviceGray", "RGB", "CMYK", "Indexed", "Lab")


def _part(spark: SparkSession, d: str) -> DataFrame:
    space = F.element_at(F.array(*map(F.lit, SPACES)), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", space.alias("space"))


def r6(x: Column) -> Column:
    return F.round(x + F.lit(1e-9), 6) + F.lit(0.0)


@query("c1_color_spaces", "SELECT p_partkey, ['DeviceGray', 'DeviceRGB', 'DeviceCMYK', 'Indexed', 'Lab'][p_size % 5 + 1] AS name, [1, 3, 4, 1, 3][p_size % 5 + 1] AS n, ['L', 'RGB', 'CMYK', 'P', 'LAB'][p_size % 5 + 1] AS mode FROM part")
def c1_color_spaces(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("space")
    return _part(spark, d).select("p_partkey", C.space_name(s).alias("name"), C.components(s).alias("n"), C.mode(s).alias("mode"))


@query("c2_default_decode", "SELECT p_partkey, ['0.0,1.0', '0.0,1.0,0.0,1.0,0.0,1.0', '0.0,1.0,0.0,1.0,0.0,1.0,0.0,1.0', '0.0,255.0', '0.0,100.0,-100.0,100.0,-100.0,100.0'][p_size % 5 + 1] AS decode FROM part")
def c2_default_decode(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", F.array_join(C.default_decode(F.col("space"), F.lit(8)).cast("array<string>"), ",").alias("decode"))


@query("c3_decode_samples", "SELECT p_partkey, round(-1 + least(p_size * 9, 255) * 3.0 / 255 + 1e-9, 6) + 0.0 AS v FROM part")
def c3_decode_samples(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", r6(C.decode(F.col("p_size") * 9, 8, -1, 2)).alias("v"))


@query("c4_encode_samples", "SELECT p_partkey, CAST(least(greatest(round_even((p_size / 40.0 - 0.25) * 255 / 1.5, 0), 0), 255) AS INT) AS v FROM part")
def c4_encode_samples(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", C.encode(F.col("p_size") / 40.0, 0.25, 1.75).alias("v"))


@query("c5_reduced_spaces", "SELECT p_partkey, CAST(round_even((1 - p_size / 50.0 * 0.8) * 255, 0) AS INT) AS r, CAST(round_even((1 - p_size / 50.0 * 0.3) * 255, 0) AS INT) AS g FROM part")
def c5_reduced_spaces(spark: SparkSession, d: str) -> DataFrame:
    """A tint through its function, as the base space's samples."""
    r, g = P.exponential(F.col("p_size") / 50.0, [1, 1], [0.2, 0.7], 1)
    return _part(spark, d).select("p_partkey", C.encode(r, 0, 1).alias("r"), C.encode(g, 0, 1).alias("g"))


@query("c6_unmatte", "SELECT p_partkey, round(0.5 + (p_size / 50.0 - 0.5) / greatest(p_size % 4 / 4.0, 1e-6) / 1000000 + 1e-9, 6) + 0.0 AS v FROM part")
def c6_unmatte(spark: SparkSession, d: str) -> DataFrame:
    v = C.unmatte(F.col("p_size") / 50.0, F.lit(0.5), F.col("p_size") % 4 / 4.0)
    return _part(spark, d).select("p_partkey", r6(F.lit(0.5) + (v - 0.5) / 1000000).alias("v"))


@query("c7_palette_render", "SELECT p_partkey, n_name AS color FROM part LEFT JOIN nation ON p_size = n_nationkey")
def c7_palette_render(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "part").select("p_partkey", F.lit(1).alias("image"), F.col("p_size").alias("v"))
    colors = table(spark, d, "nation").select(F.lit(1).alias("image"), F.col("n_nationkey").alias("index"), F.col("n_name").alias("color"))
    return C.palette(pixels, colors, ["image"]).select("p_partkey", "color")


@query("j18_palette_lookup", "SELECT l_linenumber, count(*) AS pixels, count(n_name) AS colored FROM lineitem LEFT JOIN nation ON CAST(l_quantity AS INT) = n_nationkey GROUP BY 1")
def j18_palette_lookup(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "lineitem").select("l_linenumber", F.lit(1).alias("image"), F.col("l_quantity").cast("int").alias("v"))
    colors = table(spark, d, "nation").select(F.lit(1).alias("image"), F.col("n_nationkey").alias("index"), F.col("n_name").alias("color"))
    return C.palette(pixels, colors, ["image"]).groupBy("l_linenumber").agg(F.count("*").alias("pixels"), F.count("color").alias("colored"))


@query("c10_inverted", "SELECT p_partkey, 255 - p_size AS v FROM part")
def c10_inverted(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", C.inverted(F.col("p_size")).alias("v"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an image of 8 by 8: the sign and a coarse size of each element."""
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("k", "e"))
    v = F.when(F.col("e") > 0.05, 2).when(F.col("e") < -0.05, 0).otherwise(1)
    return x.select("image", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), v.alias("v"))


PIXELS = """k AS (SELECT vec_id AS image, unnest(range(0, 64)) AS k, unnest(embedding) AS e FROM embeddings),
    px AS (SELECT image, CAST(k // 8 AS INT) AS y, CAST(k % 8 AS INT) AS x, CASE WHEN e > 0.05 THEN 2 WHEN e < -0.05 THEN 0 ELSE 1 END AS v FROM k)"""
_AT = lambda dy, dx, n: f"LEFT JOIN px {n} ON {n}.image = p.image AND {n}.y = greatest(0, least(7, p.y + {dy})) AND {n}.x = greatest(0, least(7, p.x + {dx}))"


@query("c11_subsample", f"WITH {PIXELS} SELECT image, y // 2 AS y, x // 2 AS x, v FROM px WHERE x % 2 = 0 AND y % 2 = 0")
def c11_subsample(spark: SparkSession, d: str) -> DataFrame:
    return C.subsample(_pixels(spark, d), 2)


@query(
    "c12_scale2x",
    f"""WITH {PIXELS}, q AS (SELECT p.image, p.y, p.x, p.v AS e, b.v AS b, d.v AS d, f.v AS f, h.v AS h FROM px p {_AT(-1, 0, 'b')} {_AT(0, -1, 'd')} {_AT(0, 1, 'f')} {_AT(1, 0, 'h')})
    SELECT image, CAST(y * 2 + c // 2 AS INT) AS y, CAST(x * 2 + c % 2 AS INT) AS x, CASE WHEN b <> h AND d <> f THEN CASE c WHEN 0 THEN CASE WHEN d = b THEN d ELSE e END WHEN 1 THEN CASE WHEN b = f THEN f ELSE e END WHEN 2 THEN CASE WHEN d = h THEN d ELSE e END ELSE CASE WHEN h = f THEN f ELSE e END END ELSE e END AS v FROM q, range(0, 4) t(c)""",
)
def c12_scale2x(spark: SparkSession, d: str) -> DataFrame:
    return C.scale2x(_pixels(spark, d))


@query(
    "c13_scale3x",
    f"""WITH {PIXELS}, q AS (SELECT p.image, p.y, p.x, p.v AS e, a.v AS a, b.v AS b, c.v AS c, d.v AS d, f.v AS f, g.v AS g, h.v AS h, i.v AS i FROM px p {_AT(-1, -1, 'a')} {_AT(-1, 0, 'b')} {_AT(-1, 1, 'c')} {_AT(0, -1, 'd')} {_AT(0, 1, 'f')} {_AT(1, -1, 'g')} {_AT(1, 0, 'h')} {_AT(1, 1, 'i')})
    SELECT image, CAST(y * 3 + k // 3 AS INT) AS y, CAST(x * 3 + k % 3 AS INT) AS x, CASE WHEN b <> h AND d <> f THEN CASE k WHEN 0 THEN CASE WHEN d = b THEN d ELSE e END
        WHEN 1 THEN CASE WHEN (d = b AND e <> c) OR (b = f AND e <> a) THEN b ELSE e END WHEN 2 THEN CASE WHEN b = f THEN f ELSE e END
        WHEN 3 THEN CASE WHEN (d = b AND e <> g) OR (d = h AND e <> a) THEN d ELSE e END WHEN 5 THEN CASE WHEN (b = f AND e <> i) OR (h = f AND e <> c) THEN f ELSE e END
        WHEN 6 THEN CASE WHEN d = h THEN d ELSE e END WHEN 7 THEN CASE WHEN (d = h AND e <> i) OR (h = f AND e <> g) THEN h ELSE e END WHEN 8 THEN CASE WHEN h = f THEN f ELSE e END ELSE e END ELSE e END AS v FROM q, range(0, 9) t(k)""",
)
def c13_scale3x(spark: SparkSession, d: str) -> DataFrame:
    return C.scale3x(_pixels(spark, d))


@query(
    "c14_smooth",
    f"""WITH {PIXELS} SELECT p.image, p.y, p.x, p.v, 2 * (b.v + d.v + f.v + h.v) + a.v + c.v + g.v + i.v AS weight FROM px p {_AT(-1, -1, 'a')} {_AT(-1, 0, 'b')} {_AT(-1, 1, 'c')} {_AT(0, -1, 'd')} {_AT(0, 1, 'f')} {_AT(1, -1, 'g')} {_AT(1, 0, 'h')} {_AT(1, 1, 'i')}""",
)
def c14_smooth(spark: SparkSession, d: str) -> DataFrame:
    return C.smoothed(_pixels(spark, d))


@query("c17_image_text", "SELECT p_partkey, p_size || 'x' || (p_size + 1) || ' ' || ['DeviceGray', 'DeviceRGB', 'DeviceCMYK', 'Indexed', 'Lab'][p_size % 5 + 1] || ' 8bpc' || CASE WHEN p_size % 2 = 0 THEN ' Fl' ELSE '' END AS text FROM part")
def c17_image_text(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", C.image_text(F.col("p_size"), F.col("p_size") + 1, F.col("space"), F.lit(8), F.when(F.col("p_size") % 2 == 0, "Fl")).alias("text"))


@query("k18_actual_decode", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 1.0 ELSE 0.0 END AS low FROM part")
def k18_actual_decode(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("p_size") % 10 == 0, F.array(F.lit(1.0), F.lit(0.0)))
    return _part(spark, d).select("p_partkey", F.coalesce(own, C.default_decode(F.col("space"), F.lit(8)))[0].alias("low"))


@query("a12_bitonal", "SELECT l_orderkey, bool_and(CAST(l_quantity AS INT) * 5 IN (0, 255)) AS bitonal FROM lineitem GROUP BY 1")
def a12_bitonal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(C.bitonal(F.col("l_quantity").cast("int") * 5).alias("bitonal"))


@query("a13_mostly_black", "SELECT l_orderkey, avg(CAST(l_quantity AS BIGINT) % 2) < 0.5 AS black FROM lineitem GROUP BY 1")
def a13_mostly_black(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(C.mostly_black(F.col("l_quantity").cast("long") % 2).alias("black"))


@query(
    "m14_sampled_function",
    """WITH x AS (SELECT vec_id, embedding AS t, least(greatest(abs(embedding[5]) * 4, 0), 1)::DOUBLE * 63 AS p FROM embeddings), y AS (SELECT *, CAST(least(floor(p), 62) AS INT) AS k FROM x)
    SELECT vec_id, round((t[k + 1]::DOUBLE + (t[k + 2]::DOUBLE - t[k + 1]::DOUBLE) * (p - k)) / 255 * 2 - 1 + 1e-9, 6) + 0.0 AS v FROM y""",
)
def m14_sampled_function(spark: SparkSession, d: str) -> DataFrame:
    samples = F.col("embedding").cast("array<double>")
    x = (F.abs(F.col("embedding")[4]) * F.lit(4).cast("float")).cast("double")
    return table(spark, d, "embeddings").select("vec_id", r6(P.sampled(x, samples, 8, decode=(-1, 1), count=64)).alias("v"))


@query("m15_exponential", "SELECT p_partkey, round(0.1 + pow(least(p_size / 40.0, 1), 1.7) * 0.7 + 1e-9, 6) + 0.0 AS v FROM part")
def m15_exponential(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", r6(P.exponential(F.col("p_size") / 40.0, [0.1], [0.8], 1.7)[0]).alias("v"))


@query("m16_stitching", "SELECT p_partkey, round(CASE WHEN x < 0.3 THEN x / 0.3 ELSE pow(1 - (x - 0.3) / 0.7, 2) END + 1e-9, 6) + 0.0 AS v FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)")
def m16_stitching(spark: SparkSession, d: str) -> DataFrame:
    parts = [lambda v: P.exponential(v, [0], [1], 1)[0], lambda v: P.exponential(v, [0], [1], 2)[0]]
    return _part(spark, d).select("p_partkey", r6(P.stitched(F.col("p_size") / 50.0, parts, [0.3], [(0, 1), (1, 0)])).alias("v"))


PROGRAMS = {
    "a": ("{ dup mul exch 3 div floor add neg abs }", "abs(-(floor(x / 3) + y * y))"),
    "b": ("{ 2 copy gt { exch } if pop sqrt 1 add ln }", "ln(1 + sqrt(least(x, y)))"),
    "c": ("{ 1 index pop idiv 360 mul 90 add sin }", "sin(radians(CAST(x AS BIGINT) // CAST(y AS BIGINT) * 360 + 90))"),
    "d": ("{ 2 1 roll exch 2 exp add }", "x + y * y"),
    "e": ("{ cvi exch cvi mod 6 and 1 bitshift }", "2 * ((CAST(y AS BIGINT) % CAST(x AS BIGINT)) & 6)"),
    "f": ("{ atan round }", "floor(degrees(atan2(x, y)) + 0.5)"),
    "g": ("{ ge { 1 } { 0 } ifelse 0.25 add truncate }", "CASE WHEN x >= y THEN 1 ELSE 0 END"),
}


@query("m17_calculator", "WITH v AS (SELECT p_partkey, p_size + 1.0::DOUBLE AS x, p_partkey % 17 + 1.0::DOUBLE AS y FROM part) SELECT p_partkey, " + ", ".join(f"round(CAST({sql} AS DOUBLE) + 1e-9, 6) + 0.0 AS {k}" for k, (_, sql) in PROGRAMS.items()) + " FROM v")
def m17_calculator(spark: SparkSession, d: str) -> DataFrame:
    """Calculator programs as expressions."""
    x, y = F.col("p_size") + F.lit(1.0), F.col("p_partkey") % 17 + F.lit(1.0)
    return _part(spark, d).select("p_partkey", *[r6(P.calculator(p, [x, y])[-1]).alias(k) for k, (p, sql) in PROGRAMS.items()])


FAMILIES = {
    "m17a_rounding": {"abs_": ("{ pop 25 sub 4 div abs }", "abs((x - 25) / 4)"), "neg_": ("{ pop neg }", "-x"), "up": ("{ pop 25 sub 4 div ceiling }", "ceil((x - 25) / 4)"), "down": ("{ pop 25 sub 4 div floor }", "floor((x - 25) / 4)"), "near": ("{ pop 25 sub 4 div round }", "floor((x - 25) / 4 + 0.5)"), "cut": ("{ pop 25 sub 4 div truncate }", "trunc((x - 25) / 4)"), "whole": ("{ pop 3 div cvi cvr }", "trunc(x / 3)")},
    "m17b_roots_and_angles": {"root": ("{ pop sqrt }", "sqrt(x)"), "sine": ("{ pop sin }", "sin(radians(x))"), "cosine": ("{ pop cos }", "cos(radians(x))"), "natural": ("{ pop ln }", "ln(x)"), "common": ("{ pop log }", "log10(x)")},
    "m17c_arithmetic": {"added": ("{ add }", "x + y"), "taken": ("{ sub }", "x - y"), "times_": ("{ mul }", "x * y"), "over_": ("{ div }", "x / y"), "raised": ("{ 0.25 mul exp 1000 div }", "pow(x, y * 0.25) / 1000"), "angle": ("{ atan }", "degrees(atan2(x, y))"), "quotient": ("{ idiv }", "trunc(x / y)"), "rest": ("{ mod }", "CAST(x AS BIGINT) % CAST(y AS BIGINT)")},
    "m17d_bits": {"both": ("{ and }", "CAST(x AS BIGINT) & CAST(y AS BIGINT)"), "either": ("{ or }", "CAST(x AS BIGINT) | CAST(y AS BIGINT)"), "one_": ("{ xor }", "xor(CAST(x AS BIGINT), CAST(y AS BIGINT))"), "none": ("{ pop not }", "-1 - x"), "yes": ("{ pop pop true }", "-1"), "no_": ("{ pop pop false }", "0")},
    "m17e_comparisons": {"eq": ("{ eq }", "CASE WHEN x = y THEN -1 ELSE 0 END"), "ne": ("{ ne }", "CASE WHEN x <> y THEN -1 ELSE 0 END"), "gt": ("{ gt }", "CASE WHEN x > y THEN -1 ELSE 0 END"), "lt": ("{ lt }", "CASE WHEN x < y THEN -1 ELSE 0 END"), "ge": ("{ ge }", "CASE WHEN x >= y THEN -1 ELSE 0 END"), "le": ("{ le }", "CASE WHEN x <= y THEN -1 ELSE 0 END"), "close_": ("{ pop dup 1.000001 mul eq }", "-1")},
    "m17f_stack": {"swapped": ("{ exch sub }", "y - x"), "doubled": ("{ pop dup add }", "2 * x"), "deep": ("{ 1 index sub sub }", "x - (y - x)"), "rolled": ("{ 7 3 1 roll sub mul }", "7 * (x - y)"), "back": ("{ 7 3 -1 roll sub mul }", "y * (7 - x)")},
    "m17g_branches": {"smaller": ("{ 2 copy lt { pop } { exch pop } ifelse }", "least(x, y)"), "capped": ("{ pop dup 20 gt { pop 20 } if }", "least(x, 20)"), "shifted": ("{ pop 3 bitshift }", "x * 8"), "right_": ("{ pop -2 bitshift }", "floor(x / 4)")},
}


def _family(programs: dict[str, tuple[str, str]]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        x, y = F.col("p_size") + F.lit(1.0), F.col("p_partkey") % 17 + F.lit(1.0)
        return _part(spark, d).select("p_partkey", *[r6(P.calculator(p, [x, y])[-1]).alias(k) for k, (p, _) in programs.items()])

    return run


for _name, _programs in FAMILIES.items():
    _sql = ", ".join(f"round(CAST({s} AS DOUBLE) + 1e-9, 6) + 0.0 AS {k}" for k, (_, s) in _programs.items())
    query(_name, f"WITH v AS (SELECT p_partkey, p_size + 1.0::DOUBLE AS x, p_partkey % 17 + 1.0::DOUBLE AS y FROM part) SELECT p_partkey, {_sql} FROM v")(_family(_programs))


@query("c18_image_facts", "SELECT p_partkey, [1, 3, 4, 1, 3][p_size % 5 + 1] * 8 AS pixel_bits, p_size % 5 < 3 AS device FROM part")
def c18_image_facts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("space")
    return _part(spark, d).select("p_partkey", (C.components(s) * 8).alias("pixel_bits"), C.space_name(s).startswith("Device").alias("device"))
