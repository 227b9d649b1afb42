"""Geometry over line items, orders and customers: prices and quantities serve as coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.queries import query, table


def r6(x: Column) -> Column:
    """Rounded for comparison, off exact halves, on which engines differ; the sum makes -0.0 a 0.0."""
    return F.round(x + F.lit(1e-9), 6) + F.lit(0.0)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _keyed(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r6(c).alias(k) for k, c in cols.items()])


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "m1_vectors",
    f"""SELECT {KEYS}, round(l_quantity + l_discount + 1e-9, 6) + 0.0 AS add_x, round(l_extendedprice + l_tax + 1e-9, 6) + 0.0 AS add_y,
        round(l_quantity - l_discount + 1e-9, 6) + 0.0 AS sub_x, round(-l_extendedprice + 1e-9, 6) + 0.0 AS neg_y, round(l_quantity * 2.5 + 1e-9, 6) + 0.0 AS scaled_x,
        round(l_quantity * l_discount + l_extendedprice * l_tax + 1e-9, 6) + 0.0 AS dot FROM lineitem""",
)
def m1_vectors(spark: SparkSession, d: str) -> DataFrame:
    p, q = G.vec(F.col("l_quantity"), F.col("l_extendedprice")), G.vec(F.col("l_discount"), F.col("l_tax"))
    return _keyed(_lines(spark, d), add_x=G.vec_add(p, q)["x"], add_y=G.vec_add(p, q)["y"], sub_x=G.vec_sub(p, q)["x"], neg_y=G.vec_neg(p)["y"], scaled_x=G.vec_scale(p, 2.5)["x"], dot=G.dot(p, q))


def _matrix() -> Column:
    return G.mat(F.col("l_discount") + 1, F.col("l_tax"), -F.col("l_tax"), F.col("l_discount") + 2, F.col("l_quantity"), 7)


@query(
    "m2_matrix_products",
    f"""WITH m AS (SELECT *, l_discount + 1 AS a, l_tax AS b, -l_tax AS c, l_discount + 2 AS d, l_quantity AS e, 7.0::DOUBLE AS f FROM lineitem)
        SELECT {KEYS}, round(a * l_quantity + c * 3 + e + 1e-9, 6) + 0.0 AS vx, round(b * l_quantity + d * 3 + f + 1e-9, 6) + 0.0 AS vy,
        round(a * a + c * b + 1e-9, 6) + 0.0 AS ma, round(b * c + d * d + 1e-9, 6) + 0.0 AS md, round(a * e + c * f + e + 1e-9, 6) + 0.0 AS me, round(b * e + d * f + f + 1e-9, 6) + 0.0 AS mf,
        round(least(e, a + e, c + e, a + c + e) + 1e-9, 6) + 0.0 AS bx0, round(greatest(f, b + f, d + f, b + d + f) + 1e-9, 6) + 0.0 AS by1 FROM m""",
)
def m2_matrix_products(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix()
    v, mm, b = G.mat_vec(m, G.vec(F.col("l_quantity"), 3)), G.mat_mul(m, m), G.mat_box(m, G.box(0, 0, 1, 1))
    return _keyed(_lines(spark, d), vx=v["x"], vy=v["y"], ma=mm[0], md=mm[3], me=mm[4], mf=mm[5], bx0=b["x0"], by1=b["y1"])


@query(
    "m3_inverse",
    f"""WITH m AS (SELECT *, l_discount + 1 AS a, l_tax AS b, -l_tax AS c, l_discount + 2 AS d, l_quantity AS e, 7.0::DOUBLE AS f FROM lineitem),
        n AS (SELECT *, a * d - b * c AS det FROM m)
        SELECT {KEYS}, round(det + 1e-9, 6) + 0.0 AS det, round(d / det + 1e-9, 6) + 0.0 AS ia, round(-b / det + 1e-9, 6) + 0.0 AS ib, round((c * f - d * e) / det + 1e-9, 6) + 0.0 AS ie,
        1.0::DOUBLE AS unit, NULL::DOUBLE AS singular FROM n""",
)
def m3_inverse(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix()
    i = G.inverse(m)
    return _keyed(_lines(spark, d), det=G.det(m), ia=i[0], ib=i[1], ie=i[4], unit=G.mat_mul(m, i)[0], singular=G.inverse(G.mat(F.col("l_tax"), 0, 0, 0, 0, 0))[0])


@query(
    "m4_box_parts",
    f"""SELECT {KEYS}, round(abs(l_extendedprice - l_quantity) + 1e-9, 6) + 0.0 AS w, round(abs(l_tax - l_discount) + 1e-9, 6) + 0.0 AS h,
        round(least(l_quantity, l_extendedprice) + 1e-9, 6) + 0.0 AS llx, round(greatest(l_discount, l_tax) + 1e-9, 6) + 0.0 AS ury FROM lineitem""",
)
def m4_box_parts(spark: SparkSession, d: str) -> DataFrame:
    b = G.box(F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax"))
    return _keyed(_lines(spark, d), w=G.box_w(b), h=G.box_h(b), llx=G.box_ll(b)["x"], ury=G.box_ur(b)["y"])


@query(
    "m5_box_to_box",
    f"""SELECT {KEYS}, round((l_extendedprice - l_quantity) / l_quantity + 1e-9, 6) + 0.0 AS sx, round(2.0 / (1 + l_tax) + 1e-9, 6) + 0.0 AS sy,
        round(l_quantity + 1e-9, 6) + 0.0 AS tx, round(1 - 2.0 / (1 + l_tax) * l_discount + 1e-9, 6) + 0.0 AS ty FROM lineitem WHERE l_extendedprice > l_quantity""",
)
def m5_box_to_box(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    target = G.box(q, 1, F.col("l_extendedprice"), 3)
    source = G.box(0, F.col("l_discount"), q, F.col("l_discount") + 1 + F.col("l_tax"))
    m = G.box_to_box(target, source)
    return _keyed(_lines(spark, d).where("l_extendedprice > l_quantity"), sx=m[0], sy=m[3], tx=m[4], ty=m[5])


@query(
    "m6_default_box",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 8 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END
            WHEN p_size % 4 = 1 THEN 5.0 WHEN p_size % 4 = 2 THEN 1.0 END::DOUBLE AS x1 FROM part""",
)
def m6_default_box(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    kind = F.element_at(F.array(F.lit("Page"), F.lit("Form"), F.lit("Image"), F.lit("Font")), (s % 4 + 1).cast("int"))
    crop = F.when(s % 8 == 0, G.box(0, 0, F.col("p_retailprice"), 9))
    b = G.default_box(kind, crop, G.box(0, 0, s, 9), G.box(0, 0, 5, 5))
    return table(spark, d, "part").select("p_partkey", b["x1"].alias("x1"))


def _bezier() -> list[Column]:
    q, t = F.col("l_quantity"), F.col("l_tax")
    return [G.vec(0, 0), G.vec(q, F.col("l_discount") * 10), G.vec(q * 2, t * 100), G.vec(q * 3, 1)]


BEZIER = """WITH p AS (SELECT *, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, l_quantity AS x1, l_discount * 10 AS y1, l_quantity * 2 AS x2, l_tax * 100 AS y2, l_quantity * 3 AS x3, 1.0::DOUBLE AS y3 FROM lineitem),
    z AS (SELECT *, (x0 + x3) / 2 AS qx, (y0 + y3) / 2 AS qy, (x3 - x0) / 2 AS rx, (y3 - y0) / 2 AS ry, (x1 - x0 + x2 - x3) / 2 AS bx, (y1 - y0 + y2 - y3) / 2 AS by_, (x0 - x1 + x2 - x3) / 2 AS fx, (y0 - y1 + y2 - y3) / 2 AS fy FROM p),
    c AS (SELECT *, qx * ry - qy * rx AS qr, bx * ry - by_ * rx AS br, bx * fy - by_ * fx AS bf FROM z)"""


@query("m7_bezier_forms", f"{BEZIER} SELECT {KEYS}, round(qx + 1e-9, 6) + 0.0 AS qx, round(by_ + 1e-9, 6) + 0.0 AS mid_y, round(fx + 1e-9, 6) + 0.0 AS fx, round(x1 + 1e-9, 6) + 0.0 AS back_x1, round(y2 + 1e-9, 6) + 0.0 AS back_y2, round(x3 + 1e-9, 6) + 0.0 AS list_x3 FROM c")
def m7_bezier_forms(spark: SparkSession, d: str) -> DataFrame:
    ps = _bezier()
    z = G.bezier_symmetric(*ps)
    back = G.bezier_points(z)
    listed = G.points_of(G.numbers_of(F.array(*ps)))
    return _keyed(_lines(spark, d), qx=z["q"]["x"], mid_y=z["b"]["y"], fx=z["f"]["x"], back_x1=back[1]["x"], back_y2=back[2]["y"], list_x3=listed[3]["x"])


@query("m8_bezier_area", f"{BEZIER} SELECT {KEYS}, round(qr + 1.2 * br + 0.3 * bf + 1e-9, 6) + 0.0 AS area FROM c")
def m8_bezier_area(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(_lines(spark, d), area=G.bezier_area(G.bezier_symmetric(*_bezier())))


@query(
    "m9_bezier_scale",
    f"""{BEZIER}, s AS (SELECT *, (1.2 * br) * (1.2 * br) - 4 * (0.3 * bf) * (qr - 5) AS disc FROM c),
    k AS (SELECT *, CASE WHEN bf = 0 OR disc < 0 THEN NULL ELSE (sqrt(greatest(disc, 0)) - 1.2 * br) / (0.6 * bf) END AS k1, CASE WHEN bf = 0 OR disc < 0 THEN NULL ELSE (-sqrt(greatest(disc, 0)) - 1.2 * br) / (0.6 * bf) END AS k2 FROM s)
    SELECT {KEYS}, round(CASE WHEN bf = 0 AND br <> 0 THEN (5 - qr) / (1.2 * br) WHEN bf <> 0 AND disc >= 0 THEN CASE WHEN abs(k1 - 1) <= abs(k2 - 1) THEN k1 ELSE k2 END END, 4) + 0.0 AS k FROM k""",
)
def m9_bezier_scale(spark: SparkSession, d: str) -> DataFrame:
    k = G.bezier_scale_for_area(G.bezier_symmetric(*_bezier()), F.lit(5.0))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(k, 4) + 0.0).alias("k"))


@query(
    "m10_box_growth",
    f"""SELECT {KEYS}, round(greatest(20, l_quantity) - least(10, l_quantity) + 1e-9, 6) + 0.0 AS w, round(greatest(0.05, l_discount) - least(0.02, l_discount) + 1e-9, 6) + 0.0 AS h FROM lineitem""",
)
def m10_box_growth(spark: SparkSession, d: str) -> DataFrame:
    b = G.box_grown(G.box(10, 0.02, 20, 0.05), G.vec(F.col("l_quantity"), F.col("l_discount")))
    return _keyed(_lines(spark, d), w=G.box_w(b), h=G.box_h(b))


@query("m11_polynomial", "SELECT event_id, round((((2.0 * value - 1) * value + 0.5) * value + 3) / 1000 + 1e-9, 3) + 0.0 AS y FROM events")
def m11_polynomial(spark: SparkSession, d: str) -> DataFrame:
    coefficients = F.array(*[F.lit(float(k)) for k in (2, -1, 0.5, 3)])
    return table(spark, d, "events").select("event_id", (F.round(G.horner(coefficients, F.col("value")) / 1000 + 1e-9, 3) + 0.0).alias("y"))


@query("m12_ocr_baseline", f"SELECT {KEYS}, round((4 * l_quantity + l_extendedprice) / 5 + 1e-9, 6) + 0.0 AS baseline FROM lineitem")
def m12_ocr_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(_lines(spark, d), baseline=G.ocr_baseline(F.col("l_extendedprice"), F.col("l_quantity")))


@query(
    "m13_ocr_rotation",
    f"""WITH z AS (SELECT *, l_linenumber % 4 * 90 AS rot, l_quantity + 1 AS w, l_discount * 100 + 1 AS h FROM lineitem),
    s AS (SELECT *, 612.0 / CASE WHEN rot IN (90, 270) THEN h ELSE w END AS sx, 792.0 / CASE WHEN rot IN (90, 270) THEN w ELSE h END AS sy FROM z)
    SELECT {KEYS},
        round(sx * CASE rot WHEN 0 THEN 1 - 1 WHEN 90 THEN -(1 - 1) + h WHEN 180 THEN -(1 - 1) + w ELSE 1 - 1 END + 1e-9, 6) + 0.0 AS x,
        round(sy * CASE rot WHEN 0 THEN 1 - 1 WHEN 90 THEN 0 WHEN 180 THEN h ELSE w END + 1e-9, 6) + 0.0 AS y FROM s""",
)
def m13_ocr_rotation(spark: SparkSession, d: str) -> DataFrame:
    zone = G.box(1, 1, F.col("l_quantity") + 2, F.col("l_discount") * 100 + 2)
    m = G.ocr_to_page(F.col("l_linenumber") % 4 * 90, zone, G.box(0, 0, 612, 792))
    p = G.mat_vec(m, G.vec(1, 1))
    return _keyed(_lines(spark, d), x=p["x"], y=p["y"])


@query(
    "a1_box_union",
    """SELECT l_orderkey, round(min(l_quantity) + 1e-9, 6) + 0.0 AS x0, round(min(l_discount) + 1e-9, 6) + 0.0 AS y0, round(max(l_extendedprice) + 1e-9, 6) + 0.0 AS x1, round(max(l_tax + 1) + 1e-9, 6) + 0.0 AS y1
       FROM lineitem GROUP BY l_orderkey""",
)
def a1_box_union(spark: SparkSession, d: str) -> DataFrame:
    b = G.box(F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax") + 1)
    boxes = _lines(spark, d).withColumn("b", b).groupBy("l_orderkey")
    return boxes.agg(r6(F.min("b.x0")).alias("x0"), r6(F.min("b.y0")).alias("y0"), r6(F.max("b.x1")).alias("x1"), r6(F.max("b.y1")).alias("y1"))


@query(
    "j19_containment",
    """SELECT n_nationkey, count(*) AS inside, count(*) FILTER (WHERE c_acctbal + 100 <= n_nationkey * 400 + 500) AS boxes
       FROM nation JOIN customer ON c_acctbal BETWEEN n_nationkey * 100 AND n_nationkey * 400 + 500 AND c_nationkey BETWEEN n_nationkey - 3 AND n_nationkey + 3 GROUP BY n_nationkey""",
)
def j19_containment(spark: SparkSession, d: str) -> DataFrame:
    """Points and boxes of customers within nations' boxes: the fixed side (nations) is broadcast."""
    k = F.col("n_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", G.box(k * 100, k - 3, k * 400 + 500, k + 3).alias("b"))
    bal, y = F.col("c_acctbal"), F.col("c_nationkey")
    people = table(spark, d, "customer").select(G.vec(bal, y).alias("p"), G.box(bal, y, bal + 100, y).alias("a"))
    hit = people.join(F.broadcast(nations), G.vec_in_box(F.col("p"), F.col("b")))
    return hit.groupBy("n_nationkey").agg(F.count("*").alias("inside"), F.count(F.when(G.box_in_box(F.col("a"), F.col("b")), 1)).alias("boxes"))


@query(
    "j20_intersection",
    f"""WITH b AS (SELECT *, greatest(l_quantity, 10) AS x0, least(l_quantity + 5, 30) AS x1, greatest(l_discount, 0.02) AS y0, least(l_discount + l_tax, 0.1) AS y1 FROM lineitem)
        SELECT {KEYS}, CASE WHEN x0 <= x1 AND y0 <= y1 THEN round(x0 + 1e-9, 6) + 0.0 END AS x0, CASE WHEN x0 <= x1 AND y0 <= y1 THEN round(y1 + 1e-9, 6) + 0.0 END AS y1 FROM b""",
)
def j20_intersection(spark: SparkSession, d: str) -> DataFrame:
    q, disc = F.col("l_quantity"), F.col("l_discount")
    m = G.box_meet(G.box(q, disc, q + 5, disc + F.col("l_tax")), G.box(10, 0.02, 30, 0.1))
    return _keyed(_lines(spark, d), x0=m["x0"], y1=m["y1"])


@query(
    "k24_validated_constructors",
    """SELECT vec_id, len(embedding) = 6 AS is_matrix, CAST(len(embedding) % 2 = 0 AS BOOLEAN) AS is_points, round(list_min(list_transform(range(0, 32), lambda i: embedding[2 * i + 1])), 4) + 0.0 AS x0 FROM embeddings""",
)
def k24_validated_constructors(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    x0 = F.round(F.array_min(F.transform(G.points_of(e), lambda p: p["x"])).cast("float"), 4) + F.lit(0.0)
    return table(spark, d, "embeddings").select("vec_id", G.valid_mat(e).isNotNull().alias("is_matrix"), (F.size(e) % 2 == 0).alias("is_points"), x0.alias("x0"))
