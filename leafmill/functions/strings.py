"""Strings of page descriptions: literals, hexadecimal, UTF-16, properties, escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_list(x: Column) -> Column:
    """A scalar as a list of one; null gives an empty list."""
    return F.filter(F.array(x), lambda v: v.isNotNull())


def as_scalar(xs: Column) -> Column:
    """The element of a list of one; null for any other length."""
    return F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))


def soft_hyphen(text: Column) -> Column:
    """A hyphen at the end as a soft one."""
    return F.regexp_replace(text, "-$", "­")


def title_properties(title: Column) -> Column:
    """name -> value of "name value; name value"; quotes about a value are dropped."""
    parts = F.filter(F.transform(F.split(title, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(F.substring_index(x, " ", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\S+\s*", "")), '^"|"$', "").alias("v"))
    last = F.transform(parts, pair)
    keys = F.array_distinct(F.transform(last, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(last, lambda p: p["k"] == k), -1)["v"]))


def hex_bytes(text: Column) -> Column:
    """Bytes of hexadecimal digits; white space is skipped, an odd last digit is padded with 0, null if
    there is any other character."""
    digits = F.regexp_replace(text, r"[\s\x00]", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(digits.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def hex_codes(data: Column, width: int) -> Column:
    """Codes of width bytes each, from bytes; a rest that is too short is dropped."""
    digits = F.regexp_extract_all(F.hex(data), F.lit(f".{{{2 * width}}}"), 0)
    return F.transform(digits, lambda x: F.conv(x, 16, 10).cast("int"))


def utf16_text(digits: Column) -> Column:
    """Text of UTF-16BE in hexadecimal; fewer than four digits are padded on the left."""
    whole = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.decode(F.unhex(whole), "UTF-16BE")


def utf16_hex(text: Column) -> Column:
    """A text as hexadecimal UTF-16BE."""
    return F.hex(F.encode(text, "UTF-16BE"))


def literal(text: Column) -> Column:
    """A text as a literal string."""
    return F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(")"))


def octal_escapes(text: Column) -> Column:
    """Bytes of a text's UTF-8 beyond printing ASCII, quotes and backslashes as octal escapes."""
    octets = hex_codes(F.encode(text, "UTF-8"), 1)
    oct3 = lambda b: F.concat(F.lit("\\"), F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0"))
    return F.array_join(F.transform(octets, lambda b: F.when(b.between(32, 126) & ~b.isin(34, 92), F.char(b.cast("long"))).otherwise(oct3(b))), "")
