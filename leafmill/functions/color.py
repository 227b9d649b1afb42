"""Color spaces and pixels as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1, "Separation": 1}
MODES = {1: "L", 3: "RGB", 4: "CMYK"}
LONG = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def space_name(space: Column) -> Column:
    """Abbreviated names of inline images in full."""
    return F.coalesce(F.try_element_at(_map(LONG), space), space)


def components(space: Column, n: Column | None = None) -> Column:
    """Components of a color space; of profiles and device lists as many as n says."""
    known = F.try_element_at(_map(COMPONENTS), space)
    return known if n is None else F.coalesce(known, n)


def mode(space: Column) -> Column:
    return F.when(space.isin("Indexed", "I"), "P").when(space == "Lab", "LAB").otherwise(F.try_element_at(_map(MODES), components(space)))


def default_decode(space: Column, bits: Column) -> Column:
    """Default Decode array: an index's range, Lab's ranges, else 0 and 1 for each component."""
    top = F.pow(F.lit(2.0), bits) - 1
    unit = F.flatten(F.array_repeat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce(components(space), F.lit(1))))
    lab = F.array(*map(F.lit, (0.0, 100.0, -100.0, 100.0, -100.0, 100.0)))
    return F.when(space.isin("Indexed", "I"), F.array(F.lit(0.0), top)).when(space == "Lab", lab).otherwise(unit)


def decode(sample: Column, bits: Column | int, low: Column | float, high: Column | float) -> Column:
    """A sample in its Decode range."""
    b = bits if isinstance(bits, Column) else F.lit(bits)
    top = F.pow(F.lit(2.0), b) - 1
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return lo + F.least(F.greatest(sample.cast("double"), F.lit(0.0)), top) * (hi - lo) / top


def encode(value: Column, low: Column | float, high: Column | float) -> Column:
    """A value of a Decode range as 0..255, halves to even."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(F.rint((value - lo) * 255.0 / (hi - lo)), F.lit(0.0)), F.lit(255.0)).cast("int")


def unmatte(c: Column, matte: Column, alpha: Column) -> Column:
    """A color from which its background was mixed in."""
    return matte + (c - matte) / F.greatest(alpha, F.lit(1e-6))


def inverted(v: Column, bits: int = 8) -> Column:
    return F.lit((1 << bits) - 1) - v


def image_text(width: Column, height: Column, space: Column, bits: Column, filter_: Column) -> Column:
    """A short description of an image."""
    return F.concat_ws(" ", F.format_string("%dx%d", width, height), space_name(space), F.concat(bits.cast("string"), F.lit("bpc")), filter_)


# Pixels as rows (image, y, x, v).


def palette(pixels: DataFrame, colors: DataFrame, keys: list[str]) -> DataFrame:
    """pixels with the colors (keys, index ..) of their palette; an index that it lacks gives nulls."""
    return pixels.join(colors.withColumnRenamed("index", "v"), [*keys, "v"], "left")


def subsample(pixels: DataFrame, n: int) -> DataFrame:
    return pixels.where((F.col("x") % n == 0) & (F.col("y") % n == 0)).withColumn("x", F.floor(F.col("x") / n).cast("int")).withColumn("y", F.floor(F.col("y") / n).cast("int"))


def _near(pixels: DataFrame, image: str, diagonal: bool = False) -> DataFrame:
    """pixels with the values at their sides (and corners); beyond the edge the pixel's own line goes on."""
    row, col = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    side = lambda f, w, v: F.coalesce(f(v).over(w), F.col(v))
    x = pixels.withColumn("left", side(F.lag, row, "v")).withColumn("right", side(F.lead, row, "v"))
    x = x.withColumn("up", side(F.lag, col, "v")).withColumn("down", side(F.lead, col, "v"))
    if diagonal:
        for s in ("left", "right"):
            x = x.withColumn(f"up_{s}", side(F.lag, col, s)).withColumn(f"down_{s}", side(F.lead, col, s))
    return x


def scale2x(pixels: DataFrame, image: str = "image") -> DataFrame:
    """Twice the size: a corner takes its two sides' value where just these agree."""
    x = _near(pixels, image)
    b, d, f, h, e = (F.col(c) for c in ("up", "left", "right", "down", "v"))
    ok = (b != h) & (d != f)
    quad = [(0, 0, F.when(ok & (d == b), d)), (0, 1, F.when(ok & (b == f), f)), (1, 0, F.when(ok & (d == h), d)), (1, 1, F.when(ok & (h == f), f))]
    cells = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.coalesce(c, e).alias("v")) for dy, dx, c in quad])
    y = x.select(image, "y", "x", F.explode(cells).alias("c"))
    return y.select(image, (F.col("y") * 2 + F.col("c.dy")).alias("y"), (F.col("x") * 2 + F.col("c.dx")).alias("x"), F.col("c.v").alias("v"))


def scale3x(pixels: DataFrame, image: str = "image") -> DataFrame:
    """Three times the size by the same idea, edges included."""
    z = _near(pixels, image, diagonal=True)
    a, b, c, d, e, f, g, h, i = (F.col(k) for k in ("up_left", "up", "up_right", "left", "v", "right", "down_left", "down", "down_right"))
    ok = (b != h) & (d != f)
    grid = [
        F.when(d == b, d), F.when(((d == b) & (e != c)) | ((b == f) & (e != a)), b), F.when(b == f, f),
        F.when(((d == b) & (e != g)) | ((d == h) & (e != a)), d), e, F.when(((b == f) & (e != i)) | ((h == f) & (e != c)), f),
        F.when(d == h, d), F.when(((d == h) & (e != i)) | ((h == f) & (e != g)), h), F.when(h == f, f),
    ]
    cells = F.array(*[F.struct(F.lit(k // 3).alias("dy"), F.lit(k % 3).alias("dx"), F.coalesce(F.when(ok, v), e).alias("v")) for k, v in enumerate(grid)])
    y = z.select(image, "y", "x", F.explode(cells).alias("c"))
    return y.select(image, (F.col("y") * 3 + F.col("c.dy")).alias("y"), (F.col("x") * 3 + F.col("c.dx")).alias("x"), F.col("c.v").alias("v"))


def smoothed(pixels: DataFrame, image: str = "image") -> DataFrame:
    """pixels with weight: twice the sum of the side neighbours and once that of the corners."""
    z = _near(pixels, image, diagonal=True)
    sides = F.col("left") + F.col("right") + F.col("up") + F.col("down")
    corners = F.col("up_left") + F.col("up_right") + F.col("down_left") + F.col("down_right")
    return z.select(image, "y", "x", "v", (sides * 2 + corners).alias("weight"))


def bitonal(v: Column) -> Column:
    """Aggregate: whether all samples are black or white."""
    return F.bool_and(v.isin(0, 255))


def mostly_black(v: Column) -> Column:
    """Aggregate: whether the mean of samples in 0..1 is below a half."""
    return F.avg(v) < 0.5
