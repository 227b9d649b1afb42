"""Streams of documents, their tokens and commands, and rewrites of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import rewrite as R
from leafmill.plans import stream as P
from leafmill.queries import query, table
from leafmill.sources import content as C

# The same streams, tokens and commands in DuckDB. Its regular expressions know no possessive quantifiers.
STREAM_SQL = r"""s AS (
    SELECT doc_id, lang, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: 'BT /F1 12 Tf 72 ' || printf('%.1f', 700.5 - (i - 1) * 14.5) || ' Td (' || regexp_replace(ls[i], '([\\()])', '\\\1', 'g') || ') Tj ET'), chr(10)) AS stream
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))"""
_OPS = "|".join(o.replace("*", r"\*").replace("'", "''") for o in C.OPERATORS)
TOKEN_SQL = rf"""\([^()\\]*(?:\\[\s\S][^()\\]*)*\)|<[0-9a-fA-F\s]*>|<<|>>|\[|\]|/[^\s()<>\[\]{{}}/%]+|[+-]?(?:\d+\.\d*|\.\d+)|[+-]?\d+|true|false|null|BT|ET|BI|{_OPS}"""
TYPE_SQL = r"""CASE WHEN token LIKE '(%' THEN 'string' WHEN token LIKE '/%' THEN 'name' WHEN token IN ('BT', 'ET') THEN 'block'
    WHEN regexp_matches(token, '^[+-]?(\d+\.\d*|\.\d+)$') THEN 'float' WHEN regexp_matches(token, '^[+-]?\d+$') THEN 'int'
    WHEN regexp_matches(token, '^<[0-9a-fA-F\s]*>$') THEN 'hex' WHEN token IN ('[', ']', '<<', '>>') THEN 'bracket'
    WHEN token IN ('true', 'false') THEN 'bool' WHEN token = 'null' THEN 'null' ELSE 'op' END"""
TOKENS = rf"""{STREAM_SQL},
    a AS (SELECT doc_id, lang, regexp_extract_all(stream, '{TOKEN_SQL}') AS ts FROM s),
    t AS (SELECT doc_id, lang, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM a),
    tok AS (SELECT *, {TYPE_SQL} AS type FROM t)"""
COMMANDS = f"""{TOKENS},
    n AS (SELECT *, coalesce(sum(CASE WHEN type IN ('op', 'block') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq FROM tok),
    c AS (SELECT doc_id, seq, max(CASE WHEN type IN ('op', 'block') THEN token END) AS op, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE type NOT IN ('op', 'block')), '') AS args FROM n GROUP BY doc_id, seq),
    cmd AS (SELECT * FROM (SELECT *, sum(CASE WHEN op = 'BT' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS block FROM c WHERE op IS NOT NULL))"""


def _streams(spark: SparkSession, d: str) -> DataFrame:
    return C.with_streams(table(spark, d, "documents").select("doc_id", "lang", "text"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return P.tokens(_streams(spark, d))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    return P.commands(_tokens(spark, d))


@query("p1_token_histogram", f"WITH {TOKENS} SELECT lang, type, count(*) AS n FROM tok GROUP BY lang, type")
def p1_token_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the documents' streams by language and type."""
    return _tokens(spark, d).groupBy("lang", "type").agg(F.count("*").alias("n"))


_FAMILY_SQL = "CASE " + " ".join("WHEN token IN (" + ", ".join("'" + o.replace("'", "''") + "'" for o in ops) + f") THEN '{f}'" for f, ops in C.FAMILIES.items()) + " END"


@query("p2_operator_families", f"WITH {TOKENS} SELECT {_FAMILY_SQL} AS family, token AS op, count(*) AS n FROM tok WHERE type = 'op' GROUP BY 1, 2")
def p2_operator_families(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).where("type = 'op'")
    return t.groupBy(P.family(F.col("token")).alias("family"), F.col("token").alias("op")).agg(F.count("*").alias("n"))


@query("p4_commands", f"WITH {COMMANDS} SELECT doc_id, seq, op, md5(args) AS args FROM cmd")
def p4_commands(spark: SparkSession, d: str) -> DataFrame:
    return P.stream_commands(_streams(spark, d)).select("doc_id", F.col("seq").cast("long").alias("seq"), "op", F.md5(F.array_join("args", " ")).alias("args"))


@query("p5_text_blocks", f"WITH {COMMANDS} SELECT doc_id, block, count(*) AS commands FROM cmd GROUP BY 1, 2")
def p5_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _commands(spark, d).groupBy("doc_id", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("commands"))


@query("p8_parse_summary", f"WITH {COMMANDS} SELECT doc_id, count(*) AS commands, count(DISTINCT op) AS ops, max(block) AS blocks, sum(length(args))::BIGINT AS operand_chars FROM cmd WHERE op NOT IN ('Td', 'Tf') GROUP BY 1")
def p8_parse_summary(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, a filter on their class, commands: the whole driver."""
    c = _commands(spark, d).where(~F.col("op").isin("Td", "Tf"))
    return c.groupBy("doc_id").agg(F.count("*").alias("commands"), F.countDistinct("op").alias("ops"), F.max("block").cast("long").alias("blocks"), F.sum(F.length(F.array_join("args", " "))).cast("long").alias("operand_chars"))


@query("p9_serialize", f"WITH {COMMANDS} SELECT doc_id, md5(string_agg(CASE WHEN args = '' THEN op ELSE args || ' ' || op END, chr(10) ORDER BY seq)) AS digest FROM cmd GROUP BY 1")
def p9_serialize(spark: SparkSession, d: str) -> DataFrame:
    return _streams(spark, d).select("doc_id", F.md5(P.serialized(F.col("stream"))).alias("digest"))


@query("p3_exact_lexer", f"WITH {STREAM_SQL}, x AS (SELECT doc_id, len(regexp_extract_all(stream, '{TOKEN_SQL}')) AS tokens FROM s) SELECT doc_id, tokens FROM x WHERE tokens > 0")
def p3_exact_lexer(spark: SparkSession, d: str) -> DataFrame:
    """The lexer that follows nested strings; on streams without nesting it agrees with the expression."""
    return P.lex_tokens(_streams(spark, d)).groupBy("doc_id").agg(F.count("*").alias("tokens"))


@query("p3_nested_strings", "SELECT p_partkey, '(' || p_name || ' (' || p_type || '(' || p_brand || ')) \\(' || ')' AS token, 2::BIGINT AS tokens FROM part")
def p3_nested_strings(spark: SparkSession, d: str) -> DataFrame:
    """Strings that nest twice and escape a parenthesis, before a comment that would close them."""
    s = F.concat(F.lit("% (\n("), "p_name", F.lit(" ("), "p_type", F.lit("("), "p_brand", F.lit(")) \\() Tj % )"))
    toks = P.lex_tokens(table(spark, d, "part").select("p_partkey", s.alias("stream")), "p_partkey")
    return toks.groupBy("p_partkey").agg(F.max(F.when(F.col("type") == "string", F.col("token"))).alias("token"), F.count("*").alias("tokens"))


@query("p6_inline_images", "SELECT p_partkey, 'BI Q' AS ops, CAST(p_size AS VARCHAR) AS width, 'ID ' || p_name || ') Q (\n' || p_brand || ' EI' AS data FROM part")
def p6_inline_images(spark: SparkSession, d: str) -> DataFrame:
    """Inline images whose data looks like commands."""
    s = F.concat(F.lit("BI /W "), "p_size", F.lit(" /H 1\nID "), "p_name", F.lit(") Q (\n"), "p_brand", F.lit(" EI\nQ"))
    c = P.parse_commands(table(spark, d, "part").select("p_partkey", s.alias("stream")), "p_partkey")
    ops = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "op"))), lambda x: x["op"]), " ")
    return c.groupBy("p_partkey").agg(ops.alias("ops"), F.max(F.element_at("props", "/W")).alias("width"), F.max("data").alias("data"))


@query("p6_exact_parser", f"WITH {COMMANDS} SELECT doc_id, count(*) AS commands FROM cmd GROUP BY 1")
def p6_exact_parser(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_commands(_streams(spark, d)).groupBy("doc_id").agg(F.count("*").alias("commands"))


@query("t1_class_filter", f"WITH {COMMANDS} SELECT op, count(*) AS n FROM cmd WHERE op NOT IN ('BT', 'ET', 'Tc', 'Tw', 'Tz', 'TL', 'Tf', 'Tr', 'Ts', 'Td', 'TD', 'Tm', 'T*', 'Tj', 'TJ') GROUP BY op UNION ALL SELECT 'kept Tj' AS op, count(*) AS n FROM cmd WHERE op = 'Tj'")
def t1_class_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _commands(spark, d)
    no_text = R.drop_classes(c, text=True).groupBy("op").agg(F.count("*").alias("n"))
    kept = R.drop_classes(c, vector=True, images=True).where("op = 'Tj'").agg(F.count("*").alias("n")).select(F.lit("kept Tj").alias("op"), "n")
    return no_text.union(kept)


# Streams of graphics state: each event of a user sets, saves, restores or paints.
EVENT_OPS = {"view": "w", "signup": "q", "purchase": "Tc", "error": "Q", "click": "S"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    op = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_OPS.items() for x in kv]), F.col("event_type"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select("user_id", "event_id", seq.alias("seq"), op.alias("op"), F.array(F.format_string("%.2f", "value")).alias("args"), F.lit(0).alias("block"))


EVENTS = "e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_OPS.items()) + " END AS op, printf('%.2f', value) AS arg FROM events)"
DEPTH = f"""{EVENTS},
    d1 AS (SELECT *, sum(CASE op WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM e),
    d2 AS (SELECT *, s - least(min(s) OVER (PARTITION BY user_id ORDER BY seq), 0) AS after FROM d1),
    d3 AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY user_id ORDER BY seq), 0) AS depth FROM d2)"""


@query(
    "t2_compact_unpainted",
    f"""WITH {DEPTH},
    closes AS (SELECT x.user_id, x.seq, coalesce(min(y.seq), 1000000000) AS ends FROM d3 x LEFT JOIN d3 y ON x.user_id = y.user_id AND y.seq > x.seq AND y.op = 'Q' AND y.depth = x.after AND y.depth > 0 GROUP BY 1, 2),
    paints AS (SELECT x.user_id, x.seq, coalesce(min(y.seq), 2000000000) AS paint FROM d3 x LEFT JOIN d3 y ON x.user_id = y.user_id AND y.seq >= x.seq AND y.op = 'S' GROUP BY 1, 2),
    opens AS (SELECT x.user_id, x.seq, max(y.seq) AS starts FROM d3 x LEFT JOIN d3 y ON x.user_id = y.user_id AND y.seq < x.seq AND y.op = 'q' AND y.depth = x.depth - 1 WHERE x.op = 'Q' GROUP BY 1, 2),
    keeps AS (SELECT d3.user_id, d3.seq, d3.event_id, d3.op, paint < ends AS needed FROM d3 JOIN closes USING (user_id, seq) JOIN paints USING (user_id, seq))
    SELECT k.user_id, k.seq, k.op FROM keeps k LEFT JOIN opens o USING (user_id, seq) LEFT JOIN keeps q ON q.user_id = k.user_id AND q.seq = o.starts
    WHERE CASE WHEN k.op = 'Q' THEN o.starts IS NULL OR q.needed ELSE k.needed END""",
)
def t2_compact_unpainted(spark: SparkSession, d: str) -> DataFrame:
    return R.compact_unpainted(_events(spark, d), "user_id").select("user_id", "seq", "op")


@query(
    "t3_compact_repeats",
    f"""WITH {EVENTS}, l AS (SELECT *, lead(op) OVER (PARTITION BY user_id ORDER BY seq) AS nxt FROM e)
    SELECT user_id, seq, op, arg FROM l WHERE NOT (op IN ('w', 'Tc') AND nxt IS NOT DISTINCT FROM op)""",
)
def t3_compact_repeats(spark: SparkSession, d: str) -> DataFrame:
    return R.compact_repeats(_events(spark, d), "user_id").select("user_id", "seq", "op", F.col("args")[0].alias("arg"))


# Turns of conversations as text commands: each role has its own operator.


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("string").alias("n"))
    op = F.when(F.col("role") == "user", '"').when(F.col("role") == "assistant", "TD").otherwise("'")
    args = F.when(op == '"', F.array(F.lit("1"), F.lit("2"), F.concat(F.lit("("), "n", F.lit(")")))).when(op == "TD", F.array(F.lit("0"), F.col("n"))).otherwise(F.array(F.concat(F.lit("("), "n", F.lit(")"))))
    return t.select("conv_id", F.col("turn").alias("seq"), F.lit(0).alias("block"), op.alias("op"), args.alias("args"))


@query(
    "t4_normalize_text",
    """WITH t AS (SELECT conv_id, turn, role, CAST(length(text) AS VARCHAR) AS n FROM conversations),
    x AS (SELECT conv_id, turn, 0 AS k, 'Tc' AS op, '2' AS args FROM t WHERE role = 'user' UNION ALL SELECT conv_id, turn, 1, 'T*', '' FROM t WHERE role = 'user' UNION ALL SELECT conv_id, turn, 2, 'Tj', '(' || n || ')' FROM t WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 0, 'TL', '-' || n FROM t WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1, 'Td', '0 ' || n FROM t WHERE role = 'assistant'
        UNION ALL SELECT conv_id, turn, 0, 'T*', '' FROM t WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, turn, 1, 'Tj', '(' || n || ')' FROM t WHERE role NOT IN ('user', 'assistant'))
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS seq, op, args FROM x""",
)
def t4_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return R.normalize_text(_turns(spark, d), "conv_id").select("conv_id", F.col("seq").cast("long").alias("seq"), "op", F.array_join("args", " ").alias("args"))


@query(
    "t5_word_spacing",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws, printf('%.6f', -(p_size / 10.0) * 1000 / 12.0) AS shift FROM part)
    SELECT p_partkey, CASE WHEN len(ws) > 1 THEN '[' || array_to_string(list_transform(range(1, len(ws) + 1), lambda i: '(' || ws[i] || CASE WHEN i < len(ws) THEN ' ) ' || shift || ' ' ELSE ')' END), '') || ']' ELSE '(' || ws[1] || ')' END AS operand FROM w""",
)
def t5_word_spacing(spark: SparkSession, d: str) -> DataFrame:
    tw = F.col("p_size").cast("double") / 10.0
    return table(spark, d, "part").select("p_partkey", R.with_word_spacing(F.col("p_name"), tw, F.lit(12.0)).alias("operand"))


@query(
    "t6_regex_removal",
    f"""WITH {COMMANDS},
    hit AS (SELECT doc_id, block FROM cmd WHERE op = 'Tj' GROUP BY 1, 2 HAVING regexp_matches(string_agg(args, '' ORDER BY seq), 'the|die'))
    SELECT doc_id, count(*) AS commands, count(*) FILTER (WHERE op = 'Tj') AS shown FROM cmd WHERE NOT (op IN ('Tj', 'Td') AND (doc_id, block) IN (SELECT doc_id, block FROM hit)) GROUP BY 1""",
)
def t6_regex_removal(spark: SparkSession, d: str) -> DataFrame:
    c = _commands(spark, d)
    left = R.drop_blocks(c, R.matching_blocks(c, "the|die"))
    return left.groupBy("doc_id").agg(F.count("*").alias("commands"), F.count(F.when(F.col("op") == "Tj", 1)).alias("shown"))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a text block; those of the system are invisible, as in a recognition layer."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    s = lambda op, *xs: F.struct(F.lit(op).alias("op"), F.array(*xs).cast("array<string>").alias("args"))
    hidden = F.when(F.col("role") == "system", "3").otherwise("0")
    cmds = F.array(s("BT"), s("Tr", hidden), s("Td", F.lit("0"), F.col("n").cast("string")), s("Tj", F.concat(F.lit("("), F.col("role"), F.lit(")"))), s("ET"))
    x = t.select("conv_id", "turn", F.posexplode(cmds).alias("k", "c"))
    order = Window.partitionBy("conv_id").orderBy("turn", "k")
    return x.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("block"), F.col("c.op").alias("op"), F.col("c.args").alias("args"))


@query("t7_ocr_removal", "SELECT conv_id, sum(CASE WHEN role = 'system' THEN 3 ELSE 5 END)::BIGINT AS commands, count(*) FILTER (WHERE role <> 'system') AS shown FROM conversations GROUP BY 1")
def t7_ocr_removal(spark: SparkSession, d: str) -> DataFrame:
    c = _layers(spark, d)
    left = R.drop_blocks(c, R.ocr_blocks(c, "conv_id"), "conv_id")
    return left.groupBy("conv_id").agg(F.count("*").alias("commands"), F.count(F.when(F.col("op") == "Tj", 1)).alias("shown"))


@query("t8_alternate_text", "SELECT event_id, 1 + CAST(event_type NOT IN ('view', 'click', 'error') AS BIGINT) AS keys FROM events")
def t8_alternate_text(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "/E", "click", "/Alt", "error", "/ActualText", "signup", "/Lang", "purchase", "/X")]), F.col("event_type"))
    props = F.create_map(F.lit("/MCID"), F.col("event_id").cast("string"), kind, F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.size(R.drop_alternate_text(props)).cast("long").alias("keys"))


@query("t9_merge_blocks", "SELECT conv_id, 5 * count(*) - (count(*) - 1) AS commands, count(*) - 1 AS joins, 1::BIGINT AS blocks FROM conversations GROUP BY 1")
def t9_merge_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = R.merge_blocks(_layers(spark, d), "conv_id")
    return c.groupBy("conv_id").agg(F.count("*").alias("commands"), F.count(F.when(F.col("op") == "Tm", 1)).alias("joins"), F.max("block").cast("long").alias("blocks"))


# Each line item draws a path: a start, a line, maybe a clip, and painting.


def _drawing(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, cmds): an order's drawing as a row."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    s = lambda op, *xs: F.struct(F.lit(op).alias("op"), F.array(*[F.format_string("%.2f", v) for v in xs]).cast("array<string>").alias("args"))

    def drawn(r: Column, i: Column) -> Column:
        p, q, disc = r["l_extendedprice"], r["l_quantity"], r["l_discount"]
        cmds = F.array(s("m", p, q), s("l", p + q, q + 1), s("re", p, q, q, disc))
        cmds = F.concat(cmds, F.when(r["l_suppkey"] % 5 == 0, F.array(s("W"))).otherwise(F.array().cast("array<struct<op:string,args:array<string>>>")), F.array(s("S"), s("g", disc)))
        return F.transform(cmds, lambda c, k: F.struct(((i + 1) * 10 + k).alias("seq"), c["op"].alias("op"), c["args"].alias("args")))

    return x.select("l_orderkey", F.flatten(F.transform("lines", drawn)).alias("cmds"))


@query(
    "t10_relative_paths",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS no FROM lineitem),
    r AS (SELECT *, round(l_extendedprice, 2) AS p, l_suppkey % 5 = 0 AS clip FROM n)
    SELECT l_orderkey, no * 10 AS seq, 'm' AS op, CASE WHEN clip THEN '' ELSE '0.00 0.00' END AS relative FROM r
    UNION ALL SELECT l_orderkey, no * 10 + 1, 'l', CASE WHEN clip THEN '' ELSE printf('%.2f', l_quantity) || ' 1.00' END FROM r
    UNION ALL SELECT l_orderkey, no * 10 + 2, 're', CASE WHEN clip THEN '' ELSE '0.00 0.00 ' || printf('%.2f', l_quantity) || ' ' || printf('%.2f', l_discount) END FROM r
    UNION ALL SELECT l_orderkey, no * 10 + 3, 'W', '' FROM r WHERE clip
    UNION ALL SELECT l_orderkey, no * 10 + 3 + CAST(clip AS BIGINT), 'S', '' FROM r
    UNION ALL SELECT l_orderkey, no * 10 + 4 + CAST(clip AS BIGINT), 'g', '' FROM r""",
)
def t10_relative_paths(spark: SparkSession, d: str) -> DataFrame:
    x = _drawing(spark, d).select("l_orderkey", F.explode(R.row_relative(F.col("cmds"))).alias("y")).select("l_orderkey", "y.c.seq", "y.c.op", "y.relative")
    text = F.coalesce(F.array_join(F.transform("relative", lambda v: F.format_string("%.2f", v + 0.0)), " "), F.lit(""))
    return x.select("l_orderkey", F.col("seq").cast("long").alias("seq"), "op", text.alias("relative"))


@query(
    "t11_shared_drawings",
    """WITH g AS (SELECT md5(text) AS digest, count(*) AS copies FROM documents GROUP BY 1)
    SELECT doc_id, digest, copies, (copies - 1) * 0.4 * length(text) >= 256 AS shared FROM documents JOIN g ON md5(text) = digest""",
)
def t11_shared_drawings(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_drawings(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "digest", "copies", "shared")


@query("t12_resource_names", "SELECT p_partkey, p_brand || repeat('z', row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) - 1) AS name FROM part")
def t12_resource_names(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_names(table(spark, d, "part"), "p_size", "p_brand", "p_partkey").select("p_partkey", F.col("unique").alias("name"))


@query("t15_remove_text_blocks", f"WITH {COMMANDS} SELECT count(*) AS commands, count(*) FILTER (WHERE op IN ('BT', 'ET') OR block > 0) AS text_commands FROM cmd")
def t15_remove_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The smallest edit: no text block, and so nothing of these streams, remains."""
    c = _commands(spark, d)
    return c.agg(F.count("*").alias("commands"), F.count(F.when((F.col("block") > 0) | F.col("op").isin("BT", "ET"), 1)).alias("text_commands"))


@query("t16_joined_contents", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS parts FROM conversations GROUP BY 1")
def t16_joined_contents(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a page's content as one stream, a line end between them so that no tokens fuse."""
    from leafmill.operators.pages import join_contents

    return join_contents(table(spark, d, "conversations"), "conv_id", "turn", "text")
