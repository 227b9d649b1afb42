"""Formats of sizes, numbers and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("", "K", "M", "G", "T")


def trimmed(x: Column, decimals: int = 10) -> Column:
    """Fixed point without trailing zeros; a negative zero loses its sign only if the input has none."""
    s = F.format_string(f"%.{decimals}f", x.cast("double"))
    return F.when(x.isNotNull(), F.rtrim(F.regexp_replace(s, "0+$", "")) if decimals == 0 else F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", ""))


def size_text(size: Column, unit: str = "", kilo: int = 1024) -> Column:
    """1024 with unit K is 1M; below ten one decimal is kept, else none, rounded half to even."""
    first = UNITS.index(unit) if unit in UNITS else len(UNITS) - 1
    names = UNITS[first:] if unit in UNITS else (unit,)
    out = None
    for k in range(len(names) - 1, -1, -1):
        x = size.cast("double") / float(kilo**k)
        short = F.when(x < 10, trimmed(F.rint(x * 10) / 10, 2)).otherwise(trimmed(F.rint(x), 2))
        text = F.concat(short, F.lit(names[k]))
        out = text if out is None else F.when(x < kilo, text).otherwise(out)
    return out


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def ranges_of(numbers: Column) -> Column:
    """An array of whole numbers as ranges, 1-3,6-7,9: sorted and without repeats; null for null, empty for empty."""
    xs = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    tagged = F.transform(xs, lambda x, i: F.struct((x - i).alias("g"), x.alias("x")))
    start = F.filter(tagged, lambda t, i: (i == 0) | (t["g"] != F.element_at(tagged, F.greatest(i, F.lit(1)))["g"]))
    last = lambda g: F.array_max(F.transform(F.filter(tagged, lambda u: u["g"] == g), lambda u: u["x"]))
    text = lambda t: F.when(last(t["g"]) > t["x"], F.concat(t["x"].cast("string"), F.lit("-"), last(t["g"]).cast("string"))).otherwise(t["x"].cast("string"))
    return F.array_join(F.transform(start, text), ",")


def numbers_of(ranges: Column) -> Column:
    """Ranges as a sorted array of whole numbers without repeats; null if the text isn't ranges."""
    parts = F.split(ranges, ",")
    bounds = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int")))
    good = ranges.rlike(r"^ *\d+ *(- *\d+ *)*(, *\d+ *(- *\d+ *)*)*$")
    spans = F.transform(bounds, lambda b: F.when(b[0] <= F.element_at(b, -1), F.sequence(b[0], F.element_at(b, -1))).otherwise(F.array().cast("array<int>")))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(spans))))
