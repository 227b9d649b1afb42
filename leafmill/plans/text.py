"""Text of pages whose streams draw forms, and edits of text blocks by what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.geometry import mat_mul
from leafmill.operators import graph, rewrite
from leafmill.operators.state import page_texts, placed


def with_forms(streams: DataFrame, uses: DataFrame) -> DataFrame:
    """(doc, node, seq, text, m): what each stream shows, forms included, in drawing order (seq is a path).

    streams (doc, node, stream, fonts, matrix): matrix is a form's own, null for the identity. uses (doc, src,
    name, dst): what a name is in a stream. Innermost forms first: a round joins one level with the level
    below. Streams on a cycle, and those that draw one, show nothing but are not lost: their own text stays.
    """
    own = placed(streams.select(F.struct("doc", "node", "matrix").alias("k"), "stream", "fonts"), "k")  # the matrix goes along, so that no join fetches it
    placed_by = F.when(F.col("k.matrix").isNull(), F.col("m")).otherwise(mat_mul(F.col("k.matrix"), F.col("m")))
    own = graph.kept(own.select("k.doc", "k.node", F.array("seq").alias("seq"), "text", placed_by.alias("m"), "name"))
    texts = own.where("name is null").drop("name")
    draws = own.where("name is not null").join(uses.withColumnRenamed("src", "node"), ["doc", "node", "name"]).select("doc", "node", "seq", "m", "dst")
    levels = graph.depths(uses)
    top = levels.agg(F.max("level")).first()[0] or 0
    done = texts
    for level in range(1, top + 1):
        here = draws.join(levels.where(F.col("level") == level).select("doc", "node"), ["doc", "node"])
        inner = done.select("doc", F.col("node").alias("dst"), F.col("seq").alias("_s"), "text", F.col("m").alias("_m"))
        got = here.join(inner, ["doc", "dst"]).select("doc", "node", F.concat("seq", "_s").alias("seq"), "text", mat_mul(F.col("m"), F.col("_m")).alias("m"))
        done = done.union(graph.kept(got))
    return done


def texts(streams: DataFrame, uses: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, node, text) of pages (doc, node) in reading order."""
    found = with_forms(streams, uses).join(pages.select("doc", "node"), ["doc", "node"], "left_semi")
    return page_texts(found.select(F.struct("doc", "node").alias("k"), "seq", "text", "m"), "k").select("k.*", "text")


def edited(cmds: DataFrame, regex: str = "", remove_ocr: bool = False, remove_alternate: bool = False, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(commands, removed): adjacent blocks merged, then blocks without their text whose text matches or,
    with remove_ocr, is invisible; with remove_alternate, marked content without alternate texts (column
    props). removed (key, block, text) is what went."""
    x = rewrite.merge_blocks(cmds, key)
    hit = [rewrite.matching_blocks(x, regex, key)] if regex else []
    hit += [rewrite.ocr_blocks(x, key)] if remove_ocr else []
    out = x
    removed = rewrite.block_text(x, key).where(F.lit(False))
    if hit:
        blocks = (hit[0].union(hit[1]) if len(hit) > 1 else hit[0]).distinct()
        out = rewrite.drop_blocks(x, blocks, key)
        removed = rewrite.block_text(x, key).join(blocks, [key, "block"], "left_semi")
    if remove_alternate and "props" in x.columns:
        out = out.withColumn("props", rewrite.drop_alternate_text("props"))
    return out, removed
