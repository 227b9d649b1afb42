"""Which glyph a code shows: the rules for simple and composite fonts, over tables of encodings and font programs.

encoding (font, cc, glyph): the font's own encoding. program (font, kind, cc, glyph): what the font program maps,
kind being the character map (3,0), (3,1) or (1,0) as '30', '31', '10', or 'gid' for glyph numbers. glyphs
(font, glyph): the glyphs that the program has widths for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.fonts import overlay_by, segment_offset


def _offset_free(cmap: DataFrame) -> DataFrame:
    """Codes of a symbolic map, less the block of 256 that it begins in."""
    low = cmap.groupBy("font").agg(F.min(segment_offset(F.col("cc"))).alias("_o"))
    return cmap.join(low, "font").select("font", (F.col("cc") - F.col("_o")).alias("cc"), "glyph")


def simple_codes(fonts: DataFrame, encoding: DataFrame, program: DataFrame, glyphs: DataFrame, unicode: DataFrame, roman: DataFrame) -> DataFrame:
    """(font, cc, glyph) of simple fonts (font, subtype, symbolic, encoded).

    TrueType fonts that are symbolic or have no encoding: map (3,0), codes from the start of its block, or
    else (1,0). Other TrueType fonts: each encoded glyph through (3,1) by its character (unicode: glyph, cc) or
    else (1,0) by its Roman code (roman: glyph, cc). Other fonts: glyph numbers, overlaid by the encoding.
    What the program has no width for is dropped; then the encoding's own names win on codes that remain.
    A font without any program keeps its encoding.
    """
    one = lambda kind: program.where(F.col("kind") == kind).select("font", "cc", "glyph")
    true_type = fonts.where("subtype = 'TrueType'").select("font", (F.coalesce("symbolic", F.lit(False)) | ~F.col("encoded")).alias("plain"))
    plain, named = true_type.where("plain").select("font"), true_type.where("not plain").select("font")
    has = lambda kind: one(kind).select("font").distinct()
    m30 = _offset_free(one("30").join(plain, "font", "left_semi"))
    m10 = one("10").join(plain, "font", "left_semi").join(has("30"), "font", "left_anti")
    e = encoding.join(named, "font", "left_semi").select("font", "cc", F.col("glyph").alias("name"))
    by = lambda names, kind: e.join(names.select(F.col("glyph").alias("name"), F.col("cc").alias("at")), "name").join(one(kind).withColumnRenamed("cc", "at"), ["font", "at"]).select("font", "cc", "glyph")
    m31 = by(unicode, "31")
    roman10 = by(roman, "10").join(has("31"), "font", "left_anti")
    others = fonts.where("subtype <> 'TrueType'").select("font")
    gids = overlay_by(one("gid").join(others, "font", "left_semi"), encoding.join(has("gid"), "font", "left_semi").join(others, "font", "left_semi"), ["font", "cc"], "glyph")
    inner = m30.union(m10).union(m31).union(roman10).union(gids).join(glyphs.select("font", "glyph").distinct(), ["font", "glyph"], "left_semi").select("font", "cc", "glyph")
    own = encoding.select("font", "cc", F.col("glyph").alias("_own"))
    known = inner.join(own, ["font", "cc"], "left").select("font", "cc", F.coalesce("_own", "glyph").alias("glyph"))
    bare = encoding.join(fonts.select("font"), "font", "left_semi").join(inner.select("font").distinct(), "font", "left_anti").select("font", "cc", "glyph")
    return known.union(bare)


def composite_codes(cid_gid: DataFrame, cid_set: DataFrame, widths: DataFrame, gid_names: DataFrame) -> DataFrame:
    """(font, cc, glyph) of composite fonts: the map of codes to glyph numbers (font, cid, gid), then the
    codes of the set and of the widths (font, cid) as themselves; a font that has at most code 0 of these
    has all of its glyphs (font, gid, glyph) by number."""
    more = cid_set.select("font", "cid").union(widths.select("font", "cid")).distinct()
    added = more.join(cid_gid, ["font", "cid"], "left_anti").select("font", "cid", F.col("cid").alias("gid"))
    all_ = cid_gid.select("font", "cid", "gid").union(added)
    real = all_.where("cid > 0").select("font").distinct()
    mapped = all_.join(real, "font", "left_semi").join(gid_names, ["font", "gid"]).select("font", F.col("cid").alias("cc"), "glyph")
    rest = gid_names.join(mapped.select("font").distinct(), "font", "left_anti").select("font", F.col("gid").alias("cc"), "glyph")
    return mapped.union(rest)


def font_name(descriptor: Column, base: Column, name: Column) -> Column:
    """A font's name, of its descriptor first; without the prefix of a subset."""
    return F.regexp_replace(F.coalesce(descriptor, base, name), r"^[A-Z]{6}\+", "")


def scale(subtype: Column, matrix: Column) -> Column:
    """From a font's units to text units: Type3 fonts have a matrix, all others a thousand units."""
    return F.when(subtype == "Type3", F.coalesce(F.abs(matrix[0]), F.lit(0.001))).otherwise(F.lit(0.001))
