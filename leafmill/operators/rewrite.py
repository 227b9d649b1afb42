"""Rewrites of command tables (key, seq, block, op, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.strings import once
from leafmill.sources.content import FAMILIES

TEXT = [op for f in ("text_state", "text_position", "text_show") for op in FAMILIES[f]] + ["BT", "ET"]
VECTOR = [op for f in ("path", "paint", "clip", "shading") for op in FAMILIES[f]]
PAINTING = [op for f in ("compatibility", "xobject", "shading", "paint", "clip", "text_show") for op in FAMILIES[f]] + ["BI", "BT", "ET"]
STATE = [op for f in ("color", "text_state") for op in FAMILIES[f]] + ["w", "J", "j", "M", "d", "ri", "i"]
MOVES = [*FAMILIES["text_show"], "T*", "Td", "TD"]
#: Cost of a shared drawing in bytes, and how far compression shrinks a repeated one.
SHARE_OVERHEAD, SHARE_FACTOR = 256, 0.4


def _along(key: str, *more: str) -> Window:
    return Window.partitionBy(key, *more).orderBy("seq")


def drop_classes(cmds: DataFrame, text: bool = False, images: bool = False, vector: bool = False, image_names: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Commands without text, images or vector drawing. image_names (key, name): XObjects that are images."""
    gone = (TEXT if text else []) + (VECTOR if vector else []) + (["BI"] if images else [])
    out = cmds.where(~F.col("op").isin(gone)) if gone else cmds
    if images and image_names is not None:
        hit = image_names.select(F.col(key).alias("_k"), F.col("name").alias("_n"))
        out = out.join(hit, (F.col("op") == "Do") & (F.col(key) == F.col("_k")) & (F.element_at("args", -1) == F.col("_n")), "left_anti")
    return out


def compact_repeats(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of consecutive settings of the same state, within one block, only the last stays."""
    nxt = F.lead("op").over(_along(key, "block"))
    adjacent = F.lead("seq").over(_along(key, "block")) == F.col("seq") + 1
    keep = ~(F.col("op").isin(STATE) & F.coalesce((nxt == F.col("op")) & adjacent, F.lit(False)))
    return cmds.withColumn("_keep", keep).where("_keep").drop("_keep")


def depth(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """cmds with depth and after: how many saves are open before and after the command. A restore
    without a save is ignored: the depth is the running sum less the lowest it reached below zero."""
    step = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)
    w = _along(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = cmds.withColumn("_sum", F.sum(step).over(w))
    x = x.withColumn("after", F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0)))
    return x.withColumn("depth", F.coalesce(F.lag("after").over(_along(key)), F.lit(0))).drop("_sum")


def compact_unpainted(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Commands without state changes that no later painting in their save block needs, and without saves
    that hold no painting. Painting within a nested block keeps what precedes the nested block.

    Commands are grouped by the next painting. One is needed if its block is still open at that painting;
    a restore, if the save that it ends lies before the group.
    """
    paint = F.col("op").isin(PAINTING)
    x = depth(cmds, key)
    x = x.withColumn("_g", F.coalesce(F.sum(paint.cast("int")).over(_along(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = _along(key, "_g")
    painted = F.max(paint).over(Window.partitionBy(key, "_g"))
    lowest = F.min("after").over(g.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    opened_here = F.min("depth").over(g.rowsBetween(Window.unboundedPreceding, Window.currentRow)) < F.col("depth")
    keep = F.when(F.col("op") == "Q", ~opened_here).otherwise(painted & (lowest >= F.col("after")))
    return x.withColumn("_keep", keep).where("_keep").select(*cmds.columns)


def normalize_text(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """The quote operators and TD in terms of Tc, T*, Tj, TL and Td; Tw, which spacing absorbs, is dropped.
    seq becomes consecutive again."""
    op, args = F.col("op"), F.col("args")
    cmd = lambda name, xs: F.struct(F.lit(name).alias("op"), xs.alias("args"))
    none = F.array().cast("array<string>")
    neg = lambda x: F.when(x.startswith("-"), F.substring(x, 2, 1 << 20)).otherwise(F.concat(F.lit("-"), x))
    steps = (
        F.when(op == '"', F.array(cmd("Tc", F.slice(args, 2, 1)), cmd("T*", none), cmd("Tj", F.slice(args, 3, 1))))
        .when(op == "'", F.array(cmd("T*", none), cmd("Tj", args)))
        .when(op == "TD", F.array(cmd("TL", F.array(neg(F.element_at(args, 2)))), cmd("Td", args)))
        .when(op == "Tw", F.array().cast("array<struct<op:string,args:array<string>>>"))
        .otherwise(F.array(F.struct(op.alias("op"), args.alias("args"))))
    )
    x = cmds.select(key, "seq", "block", F.posexplode(steps).alias("_k", "_c"))
    return x.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("seq", "_k")) - 1).alias("seq"), "block", F.col("_c.op").alias("op"), F.col("_c.args").alias("args"))


def with_word_spacing(text: Column, tw: Column, size: Column) -> Column:
    """The operand of TJ that shows a text with word spacing tw at a font size: after every space a
    displacement of -tw * 1000 / size."""
    shift = F.format_string("%.6f", -tw * 1000 / size)
    words = F.split(text, " ")
    last = F.size(words) - 1
    gap = F.concat(F.lit(" ) "), shift, F.lit(" "))
    parts = F.transform(words, lambda w, i: F.concat(F.lit("("), w, F.when(i < last, gap).otherwise(F.lit(")"))))
    return F.when((F.size(words) > 1) & (tw != 0), F.concat(F.lit("["), F.array_join(parts, ""), F.lit("]"))).otherwise(F.concat(F.lit("("), text, F.lit(")")))


def drop_blocks(cmds: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """cmds without showing and moving text in the given (key, block)."""
    hit = blocks.select(F.col(key).alias("_k"), F.col("block").alias("_b")).distinct()
    moves = F.col("op").isin(MOVES)
    return cmds.join(hit, moves & (F.col(key) == F.col("_k")) & (F.col("block") == F.col("_b")), "left_anti")


def block_text(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, text): the strings that a block shows, in order."""
    shown = cmds.where(F.col("op").isin(list(FAMILIES["text_show"])) & (F.col("block") > 0))
    arg = F.element_at("args", -1)
    text = F.regexp_replace(F.substring(arg, F.lit(2), F.length(arg) - 2), r"\\([\\()])", "$1")
    return shown.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), text.alias("t")))), lambda x: x["t"]), "").alias("text"))


def matching_blocks(cmds: DataFrame, regex: str, key: str = "doc_id") -> DataFrame:
    return block_text(cmds, key).where(F.col("text").rlike(regex)).select(key, "block")


def ocr_blocks(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks whose text is invisible, as recognition layers make it."""
    return cmds.where((F.col("op") == "Tr") & (F.element_at("args", 1) == "3") & (F.col("block") > 0)).select(key, "block").distinct()


def drop_alternate_text(props: Column) -> Column:
    """Properties of marked content without alternate texts."""
    return F.map_filter(props, lambda k, v: ~k.isin("/E", "/Alt", "/ActualText"))


def merge_blocks(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adjacent text blocks as one; a Tm of the identity stands where two were joined."""
    w = _along(key)
    between = (F.col("op") == "ET") & (F.coalesce(F.lead("op").over(w), F.lit("")) == "BT")
    second = (F.col("op") == "BT") & (F.coalesce(F.lag("op").over(w), F.lit("")) == "ET")
    x = cmds.withColumn("_gone", between).withColumn("_join", second).where("not _gone")
    identity = F.array(*[F.lit(v) for v in "100100"])
    x = x.withColumn("op", F.when(F.col("_join"), "Tm").otherwise(F.col("op"))).withColumn("args", F.when(F.col("_join"), identity).otherwise(F.col("args")))
    starts = F.sum((F.col("op") == "BT").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("block", F.when(F.col("block") > 0, starts).otherwise(0))
    return x.drop("_gone", "_join")


def row_relative(cmds: Column) -> Column:
    """The commands (seq, op, args, ..) of a stream, an array in order, each with path: the number of the path that it belongs
    to, null outside; x, y: the first point of that path; and relative: its args from there. A path begins with m or re
    where none is open and ends with the next painting. Clipping paths stay as they are. No shuffle and no sort."""
    painting = list(FAMILIES["paint"])
    drawing = painting + list(FAMILIES["path"] + FAMILIES["clip"])
    number = lambda a: a.try_cast("double")

    def ends(cs: Column) -> Column:
        """0, the place of each painting, from 1, and the last place."""
        some = F.filter(F.sequence(F.lit(1), F.size(cs)), lambda i: F.get(cs, i - 1)["op"].isin(painting))
        return F.concat(F.array(F.lit(0)), F.when(F.size(cs) > 0, some).otherwise(F.array().cast("array<int>")), F.array(F.size(cs)))

    def segment(part: Column, path: Column) -> Column:
        begin = F.array_position(F.transform(part, lambda c: c["op"].isin("m", "re")), True)
        return once(begin, lambda start: within(part, path, lambda c, i: (start > 0) & (i + 1 >= start) & c["op"].isin(drawing)))

    def within(part: Column, path: Column, inside) -> Column:
        return once(F.filter(part, inside), lambda own: once(place(own), lambda o: F.transform(part, lambda c, i: command(c, inside(c, i), path, o))))

    def place(own: Column) -> Column:
        at = lambda k: F.get(F.filter(F.transform(own, lambda c: number(F.get(c["args"], F.lit(k)))), lambda v: v.isNotNull()), F.lit(0))
        kept = ~F.exists(own, lambda c: c["op"].isin("W", "W*"))
        return F.struct(F.when(kept, at(0)).alias("x"), F.when(kept, at(1)).alias("y"))

    def command(c: Column, inside: Column, path: Column, o: Column) -> Column:
        count = F.when(c["op"] == "re", 2).otherwise(F.size(c["args"]))
        moved = F.transform(c["args"], lambda a, i: F.when(i >= count, number(a)).otherwise(number(a) - F.when(i % 2 == 0, o["x"]).otherwise(o["y"])))
        return F.struct(c.alias("c"), F.when(inside, path).alias("path"), F.when(inside, o["x"]).alias("x"), F.when(inside, o["y"]).alias("y"), F.when(inside & o["x"].isNotNull(), moved).alias("relative"))

    def cut(cs: Column, at: Column) -> Column:
        part = lambda e, k: segment(F.slice(cs, F.get(at, k) + 1, e - F.get(at, k)), k + 1)
        return F.flatten(F.transform(F.slice(at, F.lit(2), F.size(at) - 1), part))

    return once(cmds, lambda cs: once(ends(cs), lambda at: cut(cs, at)))


def relative_paths(cmds: DataFrame, key: str = "doc_id") -> DataFrame:
    """cmds with path, x, y, relative of row_relative(). A stream's commands meet in one row."""
    rest = [c for c in cmds.columns if c != key]
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    each = cmds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest)), by_seq).alias("_c"))
    return each.select(key, F.explode(row_relative(F.col("_c"))).alias("_c")).select(key, "_c.c.*", "_c.path", "_c.x", "_c.y", "_c.relative")


def shared_drawings(drawings: DataFrame, body: str = "body") -> DataFrame:
    """drawings with digest, copies and shared: whether to draw it once and refer to it. That pays when
    what compression leaves of the further copies is more than a shared object costs."""
    x = drawings.withColumn("digest", F.md5(body))
    each = x.groupBy("digest").agg(F.count("*").alias("copies"))
    gain = (F.col("copies") - 1) * SHARE_FACTOR * F.length(body)
    return x.join(each, "digest").withColumn("shared", gain >= SHARE_OVERHEAD)


def unique_names(resources: DataFrame, key: str, name: str = "name", order: str = "ord") -> DataFrame:
    """resources with unique: the name, followed by one z for each earlier resource of that name."""
    n = F.row_number().over(Window.partitionBy(key, name).orderBy(order))
    return resources.withColumn("unique", F.concat(F.col(name), F.repeat(F.lit("z"), n - 1)))
