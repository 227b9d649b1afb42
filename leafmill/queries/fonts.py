"""Fonts made from the supplied tables: parts' names are shown text, their numbers codes and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.operators import fonts as O
from leafmill.queries import query, table


def _part(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *cols)


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, pos, cc): the codes of each part's name."""
    return _part(spark, d, "p_name").select("p_partkey", F.posexplode(O.codes_of(F.col("p_name"))).alias("pos", "cc"))


def _cmap(spark: SparkSession) -> DataFrame:
    """Codes 32..126 to capitals, without every seventh."""
    x = spark.range(32, 127).where("id % 7 <> 0").select(F.col("id").cast("int").alias("cc"))
    return x.select("cc", F.upper(O.char_of(F.col("cc"))).alias("unicode"))


SHOWN = "c AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS pos, p_name FROM part), sh AS (SELECT p_partkey, pos, unicode(substr(p_name, pos, 1)) AS cc FROM c)"
CMAP = "cmap AS (SELECT CAST(i AS INT) AS cc, upper(chr(CAST(i AS INT))) AS unicode FROM range(32, 127) t(i) WHERE i % 7 <> 0)"


@query("j1_decode", f"WITH {SHOWN}, {CMAP} SELECT p_partkey, string_agg(coalesce(unicode, chr(983040 + cc)), '' ORDER BY pos) AS text FROM sh LEFT JOIN cmap USING (cc) GROUP BY 1")
def j1_decode(spark: SparkSession, d: str) -> DataFrame:
    return O.decode(_shown(spark, d), _cmap(spark), "p_partkey")


@query("j2_encode", f"WITH {SHOWN} SELECT p_partkey, CASE WHEN bool_or(cc % 11 = 0) THEN NULL ELSE string_agg(CAST(cc + 1 AS VARCHAR), ' ' ORDER BY pos) END AS codes FROM sh GROUP BY 1")
def j2_encode(spark: SparkSession, d: str) -> DataFrame:
    inverse = {chr(c): c + 1 for c in range(32, 127) if c % 11}
    return _part(spark, d, "p_name").select("p_partkey", F.array_join(O.encode(F.col("p_name"), inverse), " ").alias("codes"))


@query("j3_inverse", "SELECT p_type AS unicode, min(p_partkey) AS cc FROM part GROUP BY 1")
def j3_inverse(spark: SparkSession, d: str) -> DataFrame:
    return O.inverse(_part(spark, d, "p_type"), "p_type", "p_partkey", "p_partkey").select(F.col("p_type").alias("unicode"), F.col("p_partkey").alias("cc"))


@query(
    "j4_compose",
    f"""WITH {CMAP}, k AS (SELECT CAST(i AS INT) AS cc, chr(CAST(i AS INT) + 128) AS unicode FROM range(60, 140) t(i)),
    a AS (SELECT m.cc, coalesce(k.unicode, m.unicode) AS unicode FROM cmap m LEFT JOIN k ON unicode(m.unicode) = k.cc)
    SELECT * FROM a UNION ALL SELECT cc, unicode FROM k WHERE cc NOT IN (SELECT cc FROM cmap)""",
)
def j4_compose(spark: SparkSession, d: str) -> DataFrame:
    k = spark.range(60, 140).select(F.col("id").cast("int").alias("cc"), O.char_of(F.col("id") + 128).alias("unicode"))
    return O.compose(_cmap(spark), k, impose=True)


@query("j5_precedence", "SELECT p_size AS cc, arg_max(p_name, p_partkey) AS unicode FROM part GROUP BY 1")
def j5_precedence(spark: SparkSession, d: str) -> DataFrame:
    x = _part(spark, d, "p_size", "p_name").select(F.col("p_size").alias("cc"), F.col("p_name").alias("unicode"), F.col("p_partkey").alias("prio"))
    return O.strongest(x, ["cc"])


@query(
    "j6_differences",
    """WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN event_id % 200 END AS n, CASE WHEN event_type <> 'signup' THEN event_type END AS name FROM events),
    r AS (SELECT *, count(n) OVER w AS run, last_value(n IGNORE NULLS) OVER w AS start FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, coalesce(start, 0) + count(name) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS cc FROM r)
    SELECT user_id, CAST(cc AS BIGINT) AS cc, arg_max(name, event_id) AS glyph FROM c WHERE name IS NOT NULL GROUP BY 1, 2""",
)
def j6_differences(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    number = F.when(F.col("event_type") == "signup", F.col("event_id") % 200)
    t = e.select("user_id", "event_id", number.alias("n"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("name"))
    return O.differences(t, "user_id", "event_id", "n", "name")


@query(
    "j7_differences_text",
    """WITH x AS (SELECT DISTINCT o_custkey, o_orderkey % 256 AS cc FROM orders),
    r AS (SELECT *, coalesce(lag(cc) OVER (PARTITION BY o_custkey ORDER BY cc) <> cc - 1, true) AS start FROM x)
    SELECT o_custkey, string_agg(CASE WHEN start THEN cc || ' ' ELSE '' END || '/g#' || cc, ' ' ORDER BY cc) AS differences FROM r GROUP BY 1""",
)
def j7_differences_text(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 256).alias("cc")).distinct()
    out = O.differences_text(x.withColumn("glyph", F.concat(F.lit("g#"), F.col("cc").cast("string"))), "o_custkey")
    return out.select("o_custkey", F.regexp_replace("differences", "##", "#").alias("differences"))


@query(
    "j8_glyph_names",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN chr(CAST(p_partkey % 500 + 256 AS INT)) WHEN 1 THEN chr(CAST(65536 + p_partkey % 4096 AS INT)) WHEN 2 THEN CASE WHEN p_size <= 26 THEN chr(64 + p_size) END END AS unicode FROM part""",
)
def j8_glyph_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.format_string("uni%04X.sc", k % 500 + 256)).when(k % 4 == 1, F.format_string("u%05X", k % 4096 + 65536)).when(k % 4 == 2, F.format_string("g%d.alt1", "p_size")).otherwise("none")
    lists = spark.range(1, 27).select(F.format_string("g%d", "id").alias("glyph"), O.char_of(F.col("id") + 64).alias("unicode"))
    return O.glyph_unicode(_part(spark, d, "p_size").select("p_partkey", name.alias("glyph")), lists).select("p_partkey", "unicode")


@query(
    "j9_composite_names",
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'glyph' ELSE 'cid' END AS p, CASE WHEN p_partkey % 3 = 0 THEN printf('%02X', p_partkey % 256) ELSE CAST(p_partkey AS VARCHAR) END AS s FROM part),
    k AS (SELECT p, bool_or(NOT regexp_matches(s, '^[0-9]+$')) AS h FROM x GROUP BY 1)
    SELECT p_partkey, CASE WHEN h THEN CAST('0x' || s AS BIGINT) ELSE CAST(s AS BIGINT) END AS cc FROM x JOIN k USING (p)""",
)
def j9_composite_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.format_string("c%02X", k % 256)).when(k % 3 == 1, F.format_string("glyph%d", k)).otherwise(F.format_string("cid%d", k))
    return O.composite_codes(_part(spark, d).withColumn("glyph", name)).select("p_partkey", "cc")


@query("j10_type3_codes", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 256 WHEN 1 THEN p_partkey % 288 ELSE CASE WHEN p_size % 2 = 0 THEN 59 END END AS cc FROM part")
def j10_type3_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pair = F.concat(F.substring(F.lit("ABCDEFGH"), F.floor(k % 288 / 36).cast("int") + 1, F.lit(1)), F.substring(F.lit(O.BASE36), (k % 36).cast("int") + 1, F.lit(1)))
    name = F.when(k % 3 == 0, F.format_string("#%02X", k % 256)).when(k % 3 == 1, pair).otherwise(F.when(F.col("p_size") % 2 == 0, ";;").otherwise("long name"))
    return _part(spark, d, "p_size").select("p_partkey", O.type3_code(name).cast("long").alias("cc"))


@query("j11_stripped_names", "SELECT p_partkey, p_brand AS a, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '.other' END AS b FROM part")
def j11_stripped_names(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    ending = F.when(F.col("p_partkey") % 2 == 0, ".sc.alt12").otherwise(".other")
    return _part(spark, d, "p_brand").select("p_partkey", O.strip_prefix(F.concat(F.lit("\\rm"), b)).alias("a"), O.strip_variant(F.concat(b, ending)).alias("b"))


@query(
    "j13_cid_maps",
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(v) * 1000) AS BIGINT) % 256) AS b FROM embeddings)
    SELECT vec_id, (SELECT count(*) FROM (SELECT unnest(range(0, 32)) AS i) WHERE b[2 * i + 1] * 256 + b[2 * i + 2] <> 0 OR i = 0) AS mapped,
        CAST(b[1] * 256 + b[2] AS BIGINT) AS gid0, CAST(list_sum(list_transform(b, lambda v: bit_count(CAST(v AS INT)))) AS BIGINT) AS cids FROM x""",
)
def j13_cid_maps(spark: SparkSession, d: str) -> DataFrame:
    b = F.transform("embedding", lambda v: F.format_string("%02X", (F.floor(F.abs(v) * F.lit(1000).cast("float")) % 256).cast("int")))
    x = table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(b, "")).alias("b"))
    m = O.cid_to_gid(F.col("b"))
    return x.select("vec_id", F.size(m).cast("long").alias("mapped"), m[0]["gid"].cast("long").alias("gid0"), F.size(O.cid_set(F.col("b"))).cast("long").alias("cids"))


@query(
    "j14_simple_widths",
    "SELECT p_partkey, CAST(p_size + i AS BIGINT) AS cc, round((p_size * 10 + i) * 0.001, 6) AS width FROM part, range(0, 3) t(i) WHERE p_partkey % 5 <> 0",
)
def j14_simple_widths(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    fonts = _part(spark, d, "p_size").select("p_partkey", s.alias("first"), (s + F.when(F.col("p_partkey") % 5 == 0, 7).otherwise(2)).alias("last"), F.array(s * 10, s * 10 + 1, s * 10 + 2).alias("widths"))
    return O.simple_widths(fonts, "p_partkey").select("p_partkey", F.col("cc").cast("long").alias("cc"), F.round("width", 6).alias("width"))


@query(
    "j14_cid_widths",
    """WITH r AS (SELECT p_size, p_partkey, p_partkey % 50 AS first FROM part),
    x AS (SELECT p_size, p_partkey AS ord, first + i AS cc, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + i ELSE p_partkey END AS w FROM r, range(0, 3) t(i))
    SELECT p_size, CAST(cc AS BIGINT) AS cc, round(arg_max(w, ord) * 0.001, 6) AS width FROM x GROUP BY 1, 2""",
)
def j14_cid_widths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    runs = _part(spark, d, "p_size").select("p_size", k.alias("ord"), (k % 50).alias("first"), (k % 50 + 2).alias("last"), F.when(k % 2 == 0, F.array(k, k + 1, k + 2)).alias("widths"), F.when(k % 2 == 1, k).alias("width"))
    return O.cid_widths(runs, "p_size").select("p_size", "cc", F.round("width", 6).alias("width"))


@query("j15_core14", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Times-BoldItalic' WHEN 2 THEN 'Symbol' END AS name, CASE p_partkey % 4 WHEN 2 THEN 'SymbolEncoding' WHEN 3 THEN NULL ELSE 'StandardEncoding' END AS encoding, NULL::INT AS fixed FROM part")
def j15_core14(spark: SparkSession, d: str) -> DataFrame:
    font = F.element_at(F.array(*map(F.lit, ("Arial-v2", "Times New Roman,BoldItalic", "Symbol", "Own"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _part(spark, d).select("p_partkey", O.core14_name(font).alias("name"), O.core14_encoding(font).alias("encoding"), O.core14_width(font).alias("fixed"))


@query("j21_font_merge", "SELECT CAST(count(*) AS BIGINT) AS glyphs, count(*) FILTER (WHERE a.c IS NOT NULL AND b.c IS NOT NULL) AS shared, coalesce(bool_and(a.c = b.c), false) AS compatible FROM (SELECT p_name AS g, max(p_size) AS c FROM part WHERE p_partkey % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT p_name AS g, max(p_size) AS c FROM part WHERE p_partkey % 3 < 2 GROUP BY 1) b USING (g)")
def j21_font_merge(spark: SparkSession, d: str) -> DataFrame:
    one = lambda where: _part(spark, d, "p_name", "p_size").where(where).groupBy(F.col("p_name").alias("glyph")).agg(F.max("p_size").alias("code"))
    return O.merge_fonts(one("p_partkey % 3 > 0"), one("p_partkey % 3 < 2"))


@query("k1_encoding_vectors", "SELECT CAST(i AS INT) AS cc, chr(CAST(i AS INT)) AS unicode FROM range(161, 256) t(i)")
def k1_encoding_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The upper half of the Windows encoding, where it is Latin-1."""
    return O.encoding_vector(spark, "cp1252").where("cc > 160")


@query("k2_encoding_overlay", "SELECT CAST(i AS INT) AS cc, CASE WHEN m.name IS NOT NULL THEN m.name ELSE chr(CAST(i AS INT)) END AS unicode FROM range(161, 256) t(i) LEFT JOIN (SELECT n_nationkey + 200 AS cc, n_name AS name FROM nation) m ON m.cc = i")
def k2_encoding_overlay(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "nation").select((F.col("n_nationkey") + 200).alias("cc"), F.col("n_name").alias("unicode"))
    return O.overlay(O.encoding_vector(spark, "cp1252").where("cc > 160"), top)


@query("k3_standard_sets", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'latin' WHEN 1 THEN 'symbol' WHEN 2 THEN 'expert' END AS set_ FROM nation")
def k3_standard_sets(spark: SparkSession, d: str) -> DataFrame:
    enc = F.element_at(F.array(*map(F.lit, ("WinAnsiEncoding", "SymbolEncoding", "MacExpertEncoding", "Other"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", O.standard_set(enc).alias("set_"))


@query("k6_identity_map", "SELECT CAST(i AS INT) AS cc, chr(CAST(i AS INT)) AS unicode FROM range(1, 65536) t(i) WHERE i NOT BETWEEN 55296 AND 57343")
def k6_identity_map(spark: SparkSession, d: str) -> DataFrame:
    return O.identity_map(spark).where("cc > 0")


@query("a3_space_width", "SELECT p_size, round(coalesce(avg(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 0.001 END), 1.0), 6) AS width FROM part GROUP BY 1")
def a3_space_width(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") * 0.001).otherwise(0.0)
    return _part(spark, d, "p_size").groupBy("p_size").agg(F.round(O.space_width(w), 6).alias("width"))


@query("a4_text_width", f"WITH {SHOWN}, w AS (SELECT i AS cc, i * 0.01 AS width FROM range(32, 127) t(i) WHERE i % 5 <> 0) SELECT p_partkey, round(sum(coalesce(width, 0.5)), 6) AS width FROM sh LEFT JOIN w USING (cc) GROUP BY 1")
def a4_text_width(spark: SparkSession, d: str) -> DataFrame:
    w = spark.range(32, 127).where("id % 5 <> 0").select(F.col("id").cast("int").alias("cc"), (F.col("id") * 0.01).alias("width"))
    return O.text_width(_shown(spark, d), w, "p_partkey", 0.5).select("p_partkey", F.round("width", 6).alias("width"))


@query(
    "a8_bfranges",
    """WITH x AS (SELECT DISTINCT o_custkey, o_orderkey % 600 AS cc FROM orders), u AS (SELECT *, cc + 1000 - cc % 7 // 6 AS u FROM x),
    s AS (SELECT *, CASE WHEN lag(cc) OVER w = cc - 1 AND lag(u) OVER w = u - 1 AND lag(cc) OVER w // 256 = cc // 256 AND lag(u) OVER w // 256 = u // 256 THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY o_custkey ORDER BY cc)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY cc) AS run FROM s)
    SELECT o_custkey, CAST(min(cc) AS BIGINT) AS start, CAST(max(cc) AS BIGINT) AS stop, chr(CAST(min(u) AS INT)) AS value FROM r GROUP BY o_custkey, run""",
)
def a8_bfranges(spark: SparkSession, d: str) -> DataFrame:
    return O.ranges(_customer_map(spark, d), "o_custkey")


def _customer_map(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 600).alias("cc")).distinct()
    return x.withColumn("unicode", O.char_of(F.col("cc") + 1000 - F.floor(F.col("cc") % 7 / 6)))


@query("a9_segments", "SELECT o_custkey, string_agg(DISTINCT CAST((o_orderkey % 900) // 256 * 256 AS VARCHAR), ',' ORDER BY CAST((o_orderkey % 900) // 256 * 256 AS VARCHAR)) AS offsets FROM orders GROUP BY 1")
def a9_segments(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(O.segment_offset((F.col("o_orderkey") % 900).cast("int")).cast("string")).alias("xs"))
    return x.select("o_custkey", F.array_join(F.array_sort("xs"), ",").alias("offsets"))


@query("s18_tounicode_round_trip", "SELECT DISTINCT o_custkey, CAST(o_orderkey % 600 AS INT) AS cc, chr(CAST(o_orderkey % 600 + 1000 - o_orderkey % 600 % 7 // 6 AS INT)) AS unicode FROM orders")
def s18_tounicode_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Maps written as streams of ranges and read back."""
    streams = O.stream_text(O.ranges(_customer_map(spark, d), "o_custkey"), "o_custkey", F.lit("Adobe-Identity-UCS"), wide=True)
    return O.read_ranges(streams, "o_custkey")


@query(
    "r10_cmap_stream",
    "SELECT n_nationkey, '<' || printf('%02X', n_nationkey + 32) || '><' || printf('%02X', n_nationkey + 40) || '><' || printf('%04X', n_nationkey + 400) || '>' AS line, 1::BIGINT AS ranges FROM nation",
)
def r10_cmap_stream(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select("n_nationkey", (k + 32).alias("start"), (k + 40).alias("stop"), O.char_of(k + 400).alias("value"))
    s = O.stream_text(rows, "n_nationkey", F.lit("X"))
    return s.select("n_nationkey", F.regexp_extract("stream", r"beginbfrange\n(.*)\nendbfrange", 1).alias("line"), F.regexp_extract("stream", r"(\d+) beginbfrange", 1).cast("long").alias("ranges"))


@query("s14_glyph_lists", "SELECT p_name AS glyph, arg_max(p_type, p_partkey) AS unicode FROM part GROUP BY 1")
def s14_glyph_lists(spark: SparkSession, d: str) -> DataFrame:
    """Of several lists' entries for a name the last list's."""
    x = _part(spark, d, "p_name", "p_type").select(F.col("p_name").alias("glyph"), F.col("p_type").alias("unicode"), F.col("p_partkey").alias("prio"))
    return O.strongest(x, ["glyph"])


@query(
    "s17_diff_blocks",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS pad, o_orderkey % 100 AS first, o_orderkey % 100 + o_orderkey % 4 AS last FROM orders),
    e AS (SELECT *, sum(pad + last - first + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stop FROM b)
    SELECT o_custkey, CAST(stop - (last - first + 1) + i AS BIGINT) AS cc, first + i AS value FROM e, range(0, 4) t(i) WHERE first + i <= last""",
)
def s17_diff_blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").select("o_custkey", k, (k % 3).alias("pad"), (k % 100).alias("first"), (k % 100 + k % 4).alias("last"))
    return O.diff_blocks(b, "o_custkey", "o_orderkey")


@query("s22_chart_grid", "SELECT o_orderkey, CAST(o_orderkey % 16 AS BIGINT) AS x, CAST(o_orderkey // 16 % 16 AS BIGINT) AS y, CAST(o_orderkey // 256 AS BIGINT) AS sheet FROM orders")
def s22_chart_grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", O.chart_place(F.col("o_orderkey")).alias("p")).select("o_orderkey", "p.*")


def _flags() -> Column:
    return F.col("p_size").bitwiseAND(36)


@query(
    "r7_font_predicates",
    """SELECT p_partkey, p_size % 3 <> 0 AS simple, p_size % 3 = 0 AS cid, p_partkey % 2 = 0 AS embedded, p_size % 3 = 1 AND p_partkey % 2 = 1 AS core14,
    CASE WHEN p_size & 4 <> 0 AND p_size & 32 = 0 THEN true WHEN p_size & 32 <> 0 AND p_size & 4 = 0 THEN false END AS symbolic FROM part""",
)
def r7_font_predicates(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    subtype = F.when(s % 3 == 0, "Type0").when(s % 3 == 1, "Type1").otherwise("TrueType")
    return _part(spark, d, "p_size").select("p_partkey", O.predicates(subtype, F.lit("Courier"), _flags(), F.col("p_partkey") % 2 == 0).alias("p")).select("p_partkey", "p.*")


@query("r8_font_subtypes", "SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN ':CFF' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE '*' END AS kind FROM part")
def r8_font_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, "p_brand", "p_size").select("p_partkey", O.subtype_text(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "CFF"), F.col("p_size") % 3 == 0).alias("kind"))


@query(
    "r9_unique_fonts",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS n FROM x)
    SELECT p_partkey, CASE WHEN name IS NULL THEN 'T3Font' || n WHEN n = 1 THEN name ELSE name || '-v' || (n - 1) END AS name FROM n""",
)
def r9_unique_fonts(spark: SparkSession, d: str) -> DataFrame:
    x = _part(spark, d, "p_brand", "p_size").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("name"))
    return O.unique_fonts(x, "name", "p_partkey").select("p_partkey", F.col("unique").alias("name"))


@query(
    "n4_unresolved_names",
    "SELECT p_partkey, 'xx' || p_partkey || '.q' AS glyph FROM part WHERE p_size % 2 = 1",
)
def n4_unresolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Glyph names that neither lists nor patterns resolve."""
    k = F.col("p_partkey")
    name = F.when(F.col("p_size") % 2 == 0, F.format_string("uni%04X", k % 2000 + 32)).otherwise(F.format_string("xx%d.q", k))
    lists = spark.createDataFrame([("space", " ")], "glyph string, unicode string")
    x = O.composite_codes(O.glyph_unicode(_part(spark, d, "p_size").select("p_partkey", name.alias("glyph")), lists))
    return x.where("unicode is null and cc is null").select("p_partkey", "glyph")


@query("n6_install_font", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS font FROM customer")
def n6_install_font(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    have = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("font"))
    return O.install(have, c.select("c_custkey", F.lit("new").alias("font")), ["c_custkey"])


@query("o5_map_overlay", "SELECT coalesce(a.k, b.k) AS cc, coalesce(b.v, a.v) AS unicode FROM (SELECT p_size AS k, min(p_name) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT p_size AS k, max(p_type) AS v FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 3 = 0 GROUP BY 1) b ON a.k = b.k")
def o5_map_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d, "p_size", "p_name", "p_type")
    a = p.where("p_partkey % 2 = 0").groupBy(F.col("p_size").alias("cc")).agg(F.min("p_name").alias("unicode"))
    b = p.where("p_partkey % 2 = 1 or p_partkey % 3 = 0").groupBy(F.col("p_size").alias("cc")).agg(F.max("p_type").alias("unicode"))
    return O.overlay(a, b)


@query("o6_map_distill", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def o6_map_distill(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("p13_strings", "SELECT p_partkey, upper(hex(p_name)) AS digits, p_name AS back, length(p_name)::BIGINT AS codes, '(' || p_name || ')' AS literal FROM part")
def p13_strings(spark: SparkSession, d: str) -> DataFrame:
    digits = F.hex(F.encode("p_name", "ISO-8859-1"))
    data = S.hex_bytes(F.concat(F.lit(" "), digits, F.lit("\n")))
    return _part(spark, d, "p_name").select("p_partkey", digits.alias("digits"), F.decode(data, "ISO-8859-1").alias("back"), F.size(S.hex_codes(data, 1)).cast("long").alias("codes"), S.literal(F.col("p_name")).alias("literal"))


@query("p14_utf16", "SELECT p_partkey, p_name AS back, 4 * length(p_name)::BIGINT AS digits, chr(65 + p_size) AS padded FROM part")
def p14_utf16(spark: SparkSession, d: str) -> DataFrame:
    h = S.utf16_hex(F.col("p_name"))
    return _part(spark, d, "p_name", "p_size").select("p_partkey", S.utf16_text(h).alias("back"), F.length(h).cast("long").alias("digits"), S.utf16_text(F.hex(F.col("p_size") + 65)).alias("padded"))


@query("p12_octal_escapes", "SELECT doc_id, CAST(length(text) + 3 * len(regexp_extract_all(text, '[\\x00-\\x1f\"\\\\\\x7f]')) + sum_extra AS BIGINT) AS n FROM (SELECT doc_id, text, (SELECT coalesce(sum(4 * strlen(c) - 1), 0) FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7f]')) AS c)) AS sum_extra FROM documents)")
def p12_octal_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of escaped texts: four characters for every byte that doesn't print."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(S.octal_escapes(F.col("text"))).cast("long").alias("n"))


@query(
    "j12_simple_codes",
    """SELECT p_partkey AS font, CAST(p_size AS BIGINT) AS cc, CASE WHEN p_partkey % 4 = 3 THEN 'own' ELSE 'g' || p_size END AS glyph FROM part WHERE p_partkey % 4 <> 1
    UNION ALL SELECT p_partkey, CAST(65 AS BIGINT), 'A' FROM part WHERE p_partkey % 4 = 1""",
)
def j12_simple_codes(spark: SparkSession, d: str) -> DataFrame:
    """Each part a font: symbolic with map (3,0), encoded with (3,1), symbolic with (1,0), and one of numbers."""
    from leafmill.operators import codes as K

    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    p = _part(spark, d, "p_size")
    fonts = p.select(k.alias("font"), F.when(k % 4 == 3, "Type1").otherwise("TrueType").alias("subtype"), (k % 2 == 0).alias("symbolic"), (k % 4 == 1).alias("encoded"))
    g = F.concat(F.lit("g"), "p_size")
    cc = F.when(k % 4 == 0, size + 0xF000).when(k % 4 == 1, 65).otherwise(size)
    kind = F.element_at(F.array(*map(F.lit, ("30", "31", "10", "gid"))), (k % 4 + 1).cast("int"))
    program = p.select(k.alias("font"), kind.alias("kind"), cc.alias("cc"), g.alias("glyph"))
    encoding = p.where("p_partkey % 2 = 1").select(k.alias("font"), F.when(k % 4 == 3, size).otherwise(65).alias("cc"), F.when(k % 4 == 3, "own").otherwise("A").alias("glyph"))
    glyphs = program.select("font", "glyph").union(encoding.select("font", "glyph"))
    names = spark.createDataFrame([("A", 65)], "glyph string, cc long")
    return K.simple_codes(fonts, encoding, program, glyphs, names, names)


@query("k10_font_names", "SELECT p_partkey, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN p_size * 0.5 ELSE 0.001 END AS scale FROM part")
def k10_font_names(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators import codes as K

    s = F.col("p_size")
    subtype = F.when(s % 2 == 0, "Type3").otherwise("Type1")
    name = K.font_name(F.when(s % 3 == 0, F.concat(F.lit("ABCDEF+"), "p_brand")), F.col("p_brand"), F.lit("F1"))
    return _part(spark, d, "p_brand", "p_size").select("p_partkey", name.alias("name"), K.scale(subtype, F.array(s * -0.5)).alias("scale"))


@query("j13_composite_codes", "SELECT s_suppkey AS font, s_suppkey % 3 + 1 AS cc, 'g' || (s_suppkey % 3 + 2) AS glyph FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, i, 'g' || i FROM supplier, range(0, 6) t(i) WHERE s_suppkey % 2 = 1")
def j13_composite_codes(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators import codes as K

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("font"))
    gids = s.select("font", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("gid")).withColumn("glyph", F.concat(F.lit("g"), "gid"))
    pair = s.where("font % 2 = 0").select("font", (F.col("font") % 3 + 1).alias("cid"), (F.col("font") % 3 + 2).alias("gid"))
    none = s.where("false").select("font", F.lit(0).cast("long").alias("cid"))
    return K.composite_codes(pair, none, pair.select("font", "cid"), gids)


@query("k5_core14_fonts", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Times-Italic' WHEN 1 THEN 'Symbol' WHEN 2 THEN 'Courier-Bold' END AS name, CASE p_size % 4 WHEN 1 THEN 'SymbolEncoding' WHEN 3 THEN NULL ELSE 'StandardEncoding' END AS encoding, CASE WHEN p_size % 4 = 2 THEN 600 END AS width FROM part")
def k5_core14_fonts(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, ("Times New Roman,Italic", "Symbol", "Courier-Bold", "Garamond"))), (F.col("p_size") % 4 + 1).cast("int"))
    font = F.concat(given, F.lit("-v"), "p_size")
    return _part(spark, d, "p_size").select("p_partkey", O.core14_name(font).alias("name"), O.core14_encoding(font).alias("encoding"), O.core14_width(font).alias("width"))


@query("k8_known_prefixes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST('0x' || CAST(p_partkey % 90 + 10 AS VARCHAR) AS BIGINT) ELSE p_partkey % 90 + 10 END AS cc FROM part")
def k8_known_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Names of training fonts settle how a prefix counts: one that needs letters makes all hexadecimal."""
    k = F.col("p_partkey")
    names = _part(spark, d).select("p_partkey", F.concat(F.when(k % 2 == 0, "MT").otherwise("cid"), (k % 90 + 10).cast("string")).alias("glyph"))
    training = spark.createDataFrame([(None, "MTAF")], names.schema)
    return O.composite_codes(names.union(training)).where("p_partkey is not null").select("p_partkey", "cc")


@query("k9_encode_decode", "SELECT p_partkey, p_name AS text, true AS rejected FROM part")
def k9_encode_decode(spark: SparkSession, d: str) -> DataFrame:
    """Names encoded and decoded by one map; a text with a character beyond it has no code."""
    table_ = {chr(c): c for c in range(32, 127)}
    names = _part(spark, d, "p_name").withColumn("codes", O.encode(F.col("p_name"), table_)).withColumn("rejected", O.encode(F.concat("p_name", F.lit("你")), table_).isNull())
    shown = names.select("p_partkey", F.posexplode("codes").alias("pos", "cc"))
    cmap = spark.range(32, 127).select(F.col("id").cast("int").alias("cc"), O.char_of(F.col("id")).alias("unicode"))
    return O.decode(shown, cmap, "p_partkey").join(names.select("p_partkey", "rejected"), "p_partkey")
