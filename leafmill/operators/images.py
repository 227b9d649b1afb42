"""Images of files: from objects to samples, to PNG files, and onto a canvas."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions.color import COMPONENTS, space_name
from leafmill.sources import codecs, fax

FACTS = "Width int, Height int, BitsPerComponent int, ColorSpace string, Decode array<double>, ImageMask boolean, DecodeParms struct<K:int,Columns:int,Rows:int,EncodedByteAlign:boolean,BlackIs1:boolean>"


def fax_samples(data: Column, columns: Column, rows: Column, align: Column, black_is_one: Column) -> Column:
    """Bits of a facsimile image, white as 1 unless black is; null where it can't be decoded."""

    def run(*cols: pa.Array) -> pa.Array:
        out = []
        for x, n, m, a, b in zip(*(c.to_pylist() for c in cols)):
            try:
                got = fax.decode(x, n or 1728, bool(a), m or 0)
                out.append(got if b else bytes(v ^ 255 for v in got))
            except (codecs.FilterError, TypeError, ValueError):
                out.append(None)
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(data, columns, rows, align, black_is_one)


def images(objs: DataFrame, key: str = "path") -> DataFrame:
    """(key, obj_id, width, height, bits, space, decode, samples, left) of the images among objects. Samples
    are packed as in the file; they are null under a filter that isn't decoded here, which is in left."""
    x = objs.where("kind = 'stream' and subtype = 'Image'").withColumn("f", F.from_json("value", FACTS))
    space = F.when(F.coalesce("f.ImageMask", F.lit(False)), "DeviceGray").otherwise(space_name(F.regexp_replace("f.ColorSpace", r'^\[?"?/?([A-Za-z]+).*$', "$1")))
    bits = F.when(F.coalesce("f.ImageMask", F.lit(False)), 1).otherwise(F.coalesce("f.BitsPerComponent", F.lit(1)))
    p = F.col("f.DecodeParms")
    is_fax = (F.size("left") == 1) & F.col("left")[0].isin("CCITTFaxDecode", "CCF") & (p["K"] < 0)
    body = F.when(F.size("left") == 0, F.col("data")).when(is_fax, fax_samples(F.when(is_fax, F.col("data")), p["Columns"], F.coalesce(p["Rows"], "f.Height"), p["EncodedByteAlign"], p["BlackIs1"]))
    return x.select(key, "obj_id", F.col("f.Width").alias("width"), F.col("f.Height").alias("height"), bits.alias("bits"), space.alias("space"), F.col("f.Decode").alias("decode"), body.alias("samples"), F.when(is_fax, F.array().cast("array<string>")).otherwise(F.col("left")).alias("left"))


def png(samples: Column, width: Column, height: Column, bits: Column, space: Column) -> Column:
    """A PNG file of gray or RGB samples; null for other spaces and for too few samples."""

    def run(*cols: pa.Array) -> pa.Array:
        out = []
        for data, w, h, b, s in zip(*(c.to_pylist() for c in cols)):
            n = COMPONENTS.get(s or "", 0)
            line = -(-(w or 0) * n * (b or 0) // 8)
            if data is None or n not in (1, 3) or s == "Indexed" or s == "Lab" or not h or len(data) < line * h or not line:
                out.append(None)
                continue
            rows = b"".join(b"\0" + data[i * line : (i + 1) * line] for i in range(h))
            out.append(codecs.png_file(w, h, b, 0 if n == 1 else 2, zlib.compress(rows)))
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(samples, width, height, bits, space)


def export(found: DataFrame, folder: str, name: str, content: str) -> None:
    """Write each row's content as a file of its name in a folder that all executors see. A task that runs
    again replaces what it wrote; a file appears only when it is whole."""

    def write(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r[0]}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r[1])
            os.replace(part, os.path.join(folder, os.path.basename(r[0])))

    found.select(name, content).where(F.col(content).isNotNull()).foreachPartition(write)


def file_name(stem: Column, page: Column, number: Column, suffix: str = "png") -> Column:
    return F.format_string(f"%s.page%04d.image%04d.{suffix}", stem, page, number)


def on_canvas(ctm: Column, crop: Column, width: Column, height: Column, dpi: float = 300) -> Column:
    """Matrix from an image's pixels (row 0 on top) to those of a canvas of the crop box at dpi."""
    w, h = G.box_w(crop) * (dpi / 72), G.box_h(crop) * (dpi / 72)
    pixels = G.mat(F.lit(1.0) / width, 0, 0, F.lit(-1.0) / height, 0, 1)
    page = G.box_to_box(G.box(0, 0, w, h), crop)
    return G.mat_mul(G.mat_mul(G.mat_mul(G.mat(1, 0, 0, -1, 0, h), page), ctm), pixels)


def type3_box(own: Column, glyphs: Column) -> Column:
    """A font's own box if it has an area, else the union of its glyphs' boxes, else the unit square."""
    area = lambda b: (b["x0"] != b["x1"]) & (b["y0"] != b["y1"])
    side = lambda k, least: (F.array_min if least else F.array_max)(F.transform(glyphs, lambda b: b[k])).alias(k)
    union = F.struct(side("x0", True), side("y0", True), side("x1", False), side("y1", False))
    return F.coalesce(F.when(area(own), own), F.when(F.size(glyphs) > 0, F.when(area(union), union)), G.box(0, 0, 1, 1))


def transparency(objs: DataFrame, key: str = "path") -> DataFrame:
    """(key, obj_id, space, isolated, knockout) of the transparency groups among forms and pages; without a color space
    of its own a group has the one it is drawn in, so space is null."""
    g = F.from_json("value", "Group struct<S:string,CS:string,I:boolean,K:boolean>")["Group"]
    x = objs.select(key, "obj_id", g.alias("g")).where(F.col("g.S").isin("/Transparency", "Transparency"))
    flag = lambda c: F.coalesce(F.col(f"g.{c}"), F.lit(False))
    space = F.regexp_replace("g.CS", r'^\[?"?/?([A-Za-z]+).*$', "$1")
    return x.select(key, "obj_id", space.alias("space"), flag("I").alias("isolated"), flag("K").alias("knockout"))
