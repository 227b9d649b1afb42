"""From streams to tokens and commands, with built-in expressions only.

tokens() is a regular expression and an explode: it stays in the JVM, and filters on other columns are
pushed below it. It is right for strings without unescaped nested parentheses; lex_tokens() follows
those too, in Arrow batches. commands() numbers operators along a stream with one window, so a stream's
tokens meet in one task, as a page's state is sequential anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.batches import bounded
from leafmill.functions.strings import once
from leafmill.sources.content import FAMILIES, NATIVE_TOKEN, lex, parse

TYPE_RULES = (
    ("string", r"^\("),
    ("name", r"^/"),
    ("block", r"^(BT|ET)$"),
    ("float", r"^[+-]?(\d+\.\d*|\.\d+)$"),
    ("int", r"^[+-]?\d+$"),
    ("hex", r"^<[0-9a-fA-F\s]*>$"),
    ("bracket", r"^(\[|\]|<<|>>)$"),
    ("bool", r"^(true|false)$"),
    ("null", r"^null$"),
)


def token_type(token: Column) -> Column:
    out = F.lit("op")
    for kind, rule in reversed(TYPE_RULES):
        out = F.when(token.rlike(rule), kind).otherwise(out)
    return out


def family(op: Column) -> Column:
    """The family of an operator, null for other tokens."""
    pairs = [F.lit(x) for f, ops in FAMILIES.items() for op_ in ops for x in (op_, f)]
    return F.element_at(F.create_map(*pairs), op)


def tokens(streams: DataFrame, key: str = "doc_id", stream: str = "stream") -> DataFrame:
    """streams without the stream, and pos, token, type: one row a token."""
    found = F.regexp_extract_all(F.col(stream), F.lit(NATIVE_TOKEN), 0)
    rest = [c for c in streams.columns if c != stream]
    out = streams.select(*rest, F.posexplode(found).alias("pos", "token"))
    return out.withColumn("type", token_type(F.col("token")))


def commands(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, block, op, args): one row a command; block is the number of its text block, else 0."""
    w = Window.partitionBy(key).orderBy("pos")
    closing = F.col("type").isin("op", "block")
    before = F.coalesce(F.sum(closing.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = toks.withColumn("seq", before)
    one = numbered.groupBy(key, "seq").agg(
        F.max(F.when(closing, F.col("token"))).alias("op"),
        F.transform(F.array_sort(F.collect_list(F.when(~closing, F.struct("pos", "token")))), lambda x: x["token"]).alias("args"),
    )
    one = one.where("op is not null")
    v = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened, closed = F.sum((F.col("op") == "BT").cast("int")).over(v), F.sum((F.col("op") == "ET").cast("int")).over(v.rowsBetween(Window.unboundedPreceding, -1))
    block = F.when(opened > F.coalesce(closed, F.lit(0)), opened).otherwise(0)
    return one.withColumn("block", block).select(key, "seq", "block", "op", "args")


def stream_commands(streams: DataFrame, key: str = "doc_id", stream: str = "stream") -> DataFrame:
    """(key, seq, op, args): commands() without the blocks' numbers, each stream cut where it lies: no shuffle."""
    return streams.select(key, F.explode(row_commands(F.col(stream))).alias("c")).select(key, "c.seq", "c.op", "c.args")


def row_commands(stream: Column) -> Column:
    """The commands (seq, op, args) of a stream as an array."""
    closing = lambda t: ~(t.rlike(r"^[(/<>\[\]+\-.\d]") | t.isin("true", "false", "null"))

    def ends(ts: Column) -> Column:
        """0, and the place of each operator, from 1."""
        some = F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: closing(F.get(ts, i - 1)))
        return F.concat(F.array(F.lit(0)), F.when(F.size(ts) > 0, some).otherwise(F.array().cast("array<int>")))

    def cut(ts: Column, at: Column) -> Column:
        cmd = lambda e, k: F.struct(k.alias("seq"), F.get(ts, e - 1).alias("op"), F.slice(ts, F.get(at, k) + 1, e - F.get(at, k) - 1).alias("args"))
        return F.transform(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), cmd)

    return once(F.regexp_extract_all(stream, F.lit(NATIVE_TOKEN), 0), lambda ts: once(ends(ts), lambda at: cut(ts, at)))


def serialized(stream: Column) -> Column:
    """A stream's commands in order, one a line; null for a stream without any."""
    lines = F.transform(row_commands(stream), lambda c: F.concat(F.when(F.size(c["args"]) > 0, F.concat(F.array_join(c["args"], " "), F.lit(" "))).otherwise(""), c["op"]))
    return once(F.array_join(lines, "\n"), lambda x: F.when(x != "", x))


def command_text(op: str = "op", args: str = "args") -> Column:
    """A command as text: its operands and its operator."""
    return F.concat(F.when(F.size(args) > 0, F.concat(F.array_join(args, " "), F.lit(" "))).otherwise(""), F.col(op))


def serialize(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stream): commands in order, one a line."""
    line = F.struct("seq", command_text().alias("t"))
    return cmds.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("stream"))


#: Streams that a worker takes apart before it hands on what it found: tokens take many times the room of their text.
STREAMS = 64


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, STREAMS) for at in range(0, b.num_rows, STREAMS))


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches):
        rows, pos, kinds, texts = [], [], [], []
        for i, s in enumerate(b.column(1).to_pylist()):
            for k, (kind, text) in enumerate(lex(s or "")):
                rows.append(i)
                pos.append(k)
                kinds.append(kind)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["key", "pos", "type", "token"])


def lex_tokens(streams: DataFrame, key: str = "doc_id", stream: str = "stream") -> DataFrame:
    """(key, pos, type, token) by the exact lexer; comments are dropped and strings nest."""
    kind = streams.schema[key].dataType.simpleString()
    bounded(streams.sparkSession)
    return streams.select(key, stream).mapInArrow(_lexed, f"key {kind}, pos int, type string, token string").withColumnRenamed("key", key)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "seq", "block", "op", "args", "props", "data"]
    for b in _pieces(batches):
        rows, found = [], []
        for i, s in enumerate(b.column(1).to_pylist()):
            cmds = parse(s or "")
            rows += [i] * len(cmds)
            found += [(k, c) for k, c in enumerate(cmds)]
        cols = [
            b.column(0).take(pa.array(rows, pa.int64())),
            pa.array([k for k, _ in found], pa.int32()),
            pa.array([c["block"] for _, c in found], pa.int32()),
            pa.array([c["op"] for _, c in found], pa.string()),
            pa.array([c["args"] for _, c in found], pa.list_(pa.string())),
            pa.array([list(c.get("props", {}).items()) for _, c in found], pa.map_(pa.string(), pa.string())),
            pa.array([c.get("data") for _, c in found], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names)


def parse_commands(streams: DataFrame, key: str = "doc_id", stream: str = "stream") -> DataFrame:
    """(key, seq, block, op, args, props, data) by the exact parser."""
    kind = streams.schema[key].dataType.simpleString()
    bounded(streams.sparkSession)
    schema = f"key {kind}, seq int, block int, op string, args array<string>, props map<string,string>, data string"
    return streams.select(key, stream).mapInArrow(_parsed, schema).withColumnRenamed("key", key)
