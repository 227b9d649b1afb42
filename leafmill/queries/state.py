"""Text state and reading order over the documents' streams, events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import curves, rewrite
from leafmill.operators import state as O
from leafmill.queries import query, table
from leafmill.queries.content import DEPTH, _events
from leafmill.sources import content as C

FONT = f"cast(map('F1', named_struct('widths', map(1, 0.5D), 'unicode', cast(null as map<int,string>), 'missing', 0.5D, 'space', 0.5D, 'y0', -0.2D, 'y1', 0.8D, 'cid', false)) as map<string,{O.FONT}>)"


def _streams(spark: SparkSession, d: str) -> DataFrame:
    return C.with_streams(table(spark, d, "documents").select("doc_id", "lang", "text")).withColumn("fonts", F.expr(FONT))


LINES = "ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), ln AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM ls)"


@query(
    "w1_state_fold",
    f"""WITH {LINES} SELECT doc_id, (i - 1) * 5 + 3 AS seq, md5(regexp_replace(line, ' $', '')) AS text, CASE WHEN line = '' THEN 0.001 ELSE round(greatest(length(line) * 6.0, 0.001), 3) END AS width, 72.0::DOUBLE AS x, round(700.5 - (i - 1) * 14.5 - 2.4, 3) AS y FROM ln""",
)
def w1_state_fold(spark: SparkSession, d: str) -> DataFrame:
    """All text of the documents' streams with its places."""
    c = O.chunks(_streams(spark, d))
    return c.select("doc_id", (F.floor(F.col("seq") / 5) * 5 + 3).alias("seq"), F.md5("text").alias("text"), F.col("m")[0].alias("width"), F.col("m")[4].alias("x"), F.col("m")[5].alias("y"))


@query("w2_save_depth", f"WITH {DEPTH} SELECT user_id, seq, CAST(depth AS BIGINT) AS depth, CAST(after AS BIGINT) AS after FROM d3")
def w2_save_depth(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.depth(_events(spark, d), "user_id").select("user_id", "seq", F.col("depth").cast("long").alias("depth"), F.col("after").cast("long").alias("after"))


@query("w3_matrix_product", "SELECT l_orderkey, round(sum(l_quantity * 0.5) + 1e-9, 4) + 0.0 AS e, 1.0::DOUBLE AS a FROM lineitem GROUP BY 1")
def w3_matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """Translations and their products along an order's lines."""
    m = G.mat(1, 0, 0, 1, F.col("l_quantity") * 0.5, 1)
    x = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", m.alias("m")).alias("s"))
    p = O.product(F.transform(F.array_sort("s"), lambda s: s["m"]))
    x = x.groupBy("l_orderkey").agg(F.collect_list("s").alias("s")).select("l_orderkey", p.alias("m"))
    return x.select("l_orderkey", (F.round(F.col("m")[4] + 1e-9, 4) + 0.0).alias("e"), F.col("m")[0].alias("a"))


SEQ = "o AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@query("w4_text_parameters", f"WITH {SEQ} SELECT user_id, seq, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN printf('%.2f', value) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '0.0') AS tc FROM o")
def w4_text_parameters(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select("user_id", "seq", O.parameter(e, "Tc", "user_id", "0.0").alias("tc"))


@query(
    "w5_line_positions",
    f"""WITH {SEQ}, s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS g FROM o)
    SELECT user_id, seq, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(value AS DECIMAL(18, 2)) ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY seq) AS DOUBLE) AS tx FROM s""",
)
def w5_line_positions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    op = F.when(kind == "signup", "BT").when(kind.isin("click", "view"), "Td").otherwise("Tj")
    v = F.col("value").cast("decimal(18,2)")
    x = table(spark, d, "events").select("user_id", F.row_number().over(w).cast("long").alias("seq"), op.alias("op"), v.alias("x"), v.alias("y"))
    return O.line_position(x, "user_id").select("user_id", "seq", F.col("tx").cast("double").alias("tx"))


@query("w6_font_binding", f"WITH {SEQ}, b AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id % 25 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS f FROM o) SELECT user_id, seq, n_name AS font FROM b LEFT JOIN nation ON f = n_nationkey")
def w6_font_binding(spark: SparkSession, d: str) -> DataFrame:
    """The font that was last set, resolved among the resources."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("seq"), "event_type")
    f = F.last(F.when(F.col("event_type") == "signup", F.col("event_id") % 25), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("font"))
    return e.withColumn("f", f).join(n, F.col("f") == F.col("n_nationkey"), "left").select("user_id", "seq", "font")


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


@query("w7_displacements", f"SELECT {KEYS}, round(-l_extendedprice * l_quantity / 1000 + 1e-9, 6) + 0.0 AS v FROM lineitem")
def w7_displacements(spark: SparkSession, d: str) -> DataFrame:
    v = O.displacement(F.col("l_extendedprice"), F.col("l_quantity"))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(v + 1e-9, 6) + 0.0).alias("v"))


@query("w8_spaces", f"SELECT {KEYS}, l_discount * 100 + l_tax > 0.5 * l_quantity * 0.4 AS space FROM lineitem")
def w8_spaces(spark: SparkSession, d: str) -> DataFrame:
    s = O.is_space(F.col("l_discount") * 100, F.col("l_tax"), F.lit(0.5), F.col("l_quantity"))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("space"))


@query("w9_advance", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT) * 6) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM lineitem")
def w9_advance(spark: SparkSession, d: str) -> DataFrame:
    """Where each text of a line starts: after the widths of those before it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.sum(F.col("l_quantity").cast("long") * 6).over(w), F.lit(0)).alias("x"))


@query("w10_chunk_matrices", f"SELECT {KEYS}, round(2 * CASE WHEN l_tax = 0 THEN 0.001 ELSE l_tax * 100 END + 1e-9, 3) AS a, round(2 * (l_quantity + 1) + 10 + 1e-9, 3) AS e FROM lineitem")
def w10_chunk_matrices(spark: SparkSession, d: str) -> DataFrame:
    m = O.chunk_matrix(G.mat(2, 0, 0, 2, 10, 0), G.mat(1, 0, 0, 1, F.col("l_quantity"), 0), F.col("l_tax") * 100, F.lit(9.0), F.lit(1.0), F.lit(0.0))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("m")[0], 3).alias("a"), F.round(F.col("m")[4], 3).alias("e"))


@query("w12_spacers", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN repeat(' ', greatest(CAST(ceil((p_size / 10.0 - 0.0625) / 0.5) AS INT), 0)) ELSE repeat(chr(10), p_size % 3) END AS gap FROM part")
def w12_spacers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    prev = G.mat(10, 0, 0, 10, 0, 0)
    m = G.mat(10, 0, 0, 10, F.lit(10.0) + s, s % 3 * -10)
    return table(spark, d, "part").select("p_partkey", O.gap_text(m, prev).alias("gap"))


@query("o2_page_text", f"WITH {LINES}, t AS (SELECT doc_id, i, regexp_replace(line, ' $', '') AS line FROM ln), f AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM t WHERE trim(line, ' ') <> '') SELECT doc_id, md5(string_agg(CASE WHEN p IS NULL THEN '' ELSE repeat(chr(10), CAST(round_even((i - p) * 14.5 / 12.0, 0) AS INT)) END || line, '' ORDER BY i)) AS digest FROM f GROUP BY 1")
def o2_page_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages in reading order with line ends inferred: streams to chunks to text."""
    return O.page_texts(O.chunks(_streams(spark, d))).where("text <> ''").select("doc_id", F.md5("text").alias("digest"))


@query("o1_reading_order", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey % 7 DESC, o_orderkey) AS found FROM orders GROUP BY 1")
def o1_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on rows that don't overlap: rows from the top, each from the left."""
    k = F.col("o_orderkey")
    m = F.array(*[x.cast("double") for x in (F.lit(0.5), F.lit(0), F.lit(0), F.lit(8), k, k % 7 * 10)])
    x = table(spark, d, "orders").select("o_custkey", k.alias("seq"), F.concat(F.lit("|"), k.cast("string")).alias("text"), m.alias("m"))
    t = O.page_texts(x, "o_custkey", widest=1)
    return t.select("o_custkey", F.trim(F.regexp_replace("text", r"[|\s]+", " ")).alias("found"))


@query("a5_chunk_metrics", "SELECT l_orderkey, min(l_quantity) AS xmin, round(avg(l_tax * 100) + 1e-9, 6) + 0.0 AS height FROM lineitem GROUP BY 1")
def a5_chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = G.mat_box(G.mat(5, 0, 0, F.col("l_tax") * 100, F.col("l_quantity"), 0), G.box(0, 0, 1, 1))
    x = _lines(spark, d).select("l_orderkey", b.alias("b"))
    return x.groupBy("l_orderkey").agg(F.min("b.x0").alias("xmin"), (F.round(F.avg(F.col("b.y1") - F.col("b.y0")) + 1e-9, 6) + 0.0).alias("height"))


@query("n7_ocr_layer", "SELECT p_partkey, 'BT 3 Tr /F1 10.00 Tf ' || printf('%.2f', p_size * 1.0 / length(p_name) / 5.0 * 100) || ' Tz 1 0 0 1 0.00 2.00 Tm (' || p_name || ') Tj ET' AS stream FROM part WHERE p_size > 0")
def n7_ocr_layer(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "part").select("p_partkey", F.lit(0).alias("ord"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), F.lit(10.0).alias("y1"), F.col("p_name").alias("text"))
    return O.ocr_commands(z, "p_partkey").select("p_partkey", "stream")


@query("t13_curve_decimation", "SELECT vec_id, CASE WHEN embedding[3] > 0 THEN 1 WHEN embedding[4] > 0 THEN 2 ELSE 3 END AS segments FROM embeddings")
def t13_curve_decimation(spark: SparkSession, d: str) -> DataFrame:
    """Halves of one curve merge to it again; with a gap between them, or a corner that bulges the other way after them, they don't."""
    e = lambda i: F.col("embedding")[i].cast("double")
    p = [[e(0), e(1)], [e(0) + 1, e(1) + 2], [e(0) + 3, e(1) + 2], [e(0) + 4, e(1)]]
    mid = lambda a, b: [(a[k] + b[k]) / 2 for k in (0, 1)]
    a, b, c = mid(p[0], p[1]), mid(p[1], p[2]), mid(p[2], p[3])
    ab, bc = mid(a, b), mid(b, c)
    m = mid(ab, bc)
    halves = F.array(*[v for q in (p[0], a, ab, m, m, bc, c, p[3]) for v in q])
    apart = F.array(*[v for q in (p[0], a, ab, m) for v in q], *[v + 7 for q in (m, bc, c, p[3]) for v in q])
    more = F.concat(apart, F.array(*[v - 9 for q in (p[0], a, ab, m) for v in q]))
    points = F.when(e(2) > 0, halves).when(e(3) > 0, apart).otherwise(more)
    return curves.decimated(table(spark, d, "embeddings").select("vec_id", points.alias("points")), "vec_id").select("vec_id", "segments")


@query("k21_text_driver", f"WITH {LINES} SELECT count(*) AS removed, (SELECT CAST(sum(length(line)) AS BIGINT) FROM ln WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(text, 'the'))) AS chars FROM documents WHERE contains(text, 'the')")
def k21_text_driver(spark: SparkSession, d: str) -> DataFrame:
    """Blocks merged, and those taken out whose text matches."""
    from leafmill.plans import stream as P
    from leafmill.plans import text as T

    c = P.commands(P.tokens(C.with_streams(table(spark, d, "documents").select("doc_id", "lang", "text"))))
    _, removed = T.edited(c, regex="the")
    return removed.agg(F.count("*").alias("removed"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("g4_nested_forms", "SELECT c_custkey AS doc, round(sum(2.0 * (10 + 5 * o_orderkey % 7)), 3) AS x, count(*) AS shown FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def g4_nested_forms(spark: SparkSession, d: str) -> DataFrame:
    """Customers' pages draw a form at twice its size, which draws one form an order."""
    from leafmill.plans import text as T

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey")
    c = o.select("doc").distinct()
    font = F.expr(FONT)
    none = F.lit(None).cast("array<double>")
    page = c.select("doc", F.lit(0).cast("long").alias("node"), F.lit("q 2 0 0 2 0 0 cm /A Do Q").alias("stream"), font.alias("fonts"), none.alias("matrix"))
    calls = o.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("/F"), "o_orderkey", F.lit(" Do")))), " ").alias("stream"))
    form = calls.select("doc", F.lit(-1).cast("long").alias("node"), "stream", font.alias("fonts"), G.mat(1, 0, 0, 1, 10, 0).alias("matrix"))
    leaf = o.select("doc", (F.col("o_orderkey") + 1).alias("node"), F.format_string("BT /F1 10 Tf %d 0 Td (x) Tj ET", F.col("o_orderkey") * 5 % 7).alias("stream"), font.alias("fonts"), none.alias("matrix"))
    uses = c.select("doc", F.lit(0).cast("long").alias("src"), F.lit("A").alias("name"), F.lit(-1).cast("long").alias("dst")).union(o.select("doc", F.lit(-1).cast("long"), F.concat(F.lit("F"), "o_orderkey"), F.col("o_orderkey") + 1))
    got = T.with_forms(page.union(form).union(leaf), uses).where("node = 0")
    return got.groupBy("doc").agg(F.round(F.sum(F.col("m")[4]), 3).alias("x"), F.count("*").alias("shown"))
