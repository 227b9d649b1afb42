"""Font programs, embedded fonts, containers and walks that meet cycles."""

import struct

import pytest
from pyspark.sql import functions as F

from leafmill.operators import file_fonts, graph, images, state
from leafmill.sources import fax, ocr, pdf, sfnt, tiff
from leafmill.sources.codecs import FilterError


def font(**maps):
    return sfnt.program([250, 500, 600, 700], maps, [".notdef", "A", "eacute", "uni0046.alt"], units=1000)


def test_tables_of_a_program_come_back():
    x = sfnt.info(font(**{"31": {65: 1, 66: 2, 0xE9: 2}, "10": {1: 3}}))
    assert (x["kind"], x["units"], x["glyphs"], x["y0"], x["y1"]) == ("TrueType", 1000.0, 4, -0.2, 0.8)
    assert x["widths"] == {0: 0.25, 1: 0.5, 2: 0.6, 3: 0.7} and x["names"] == {0: ".notdef", 1: "A", 2: "eacute", 3: "uni0046.alt"}
    assert x["maps"] == {"31": {65: 1, 66: 2, 0xE9: 2}, "10": {1: 3}}
    assert sfnt.info(sfnt.with_map(font(**{"10": {1: 3}}), "31", {9: 2}))["maps"] == {"10": {1: 3}, "31": {9: 2}}


def test_other_formats_of_maps():
    table = lambda body: struct.pack(">HHHHI", 0, 1, 3, 10, 12) + body
    assert sfnt.character_maps(table(struct.pack(">HHH", 0, 262, 0) + bytes([0, 5]) + bytes(254)))["310"] == {1: 5}
    assert sfnt.character_maps(table(struct.pack(">HHHHHHHH", 6, 16, 0, 30, 3, 7, 0, 9)))["310"] == {30: 7, 32: 9}
    assert sfnt.character_maps(table(struct.pack(">HHIIIIII", 12, 0, 28, 0, 1, 0x1F600, 0x1F601, 4)))["310"] == {0x1F600: 4, 0x1F601: 5}


def test_type1_and_what_is_none():
    text = b"%!PS-AdobeFont-1.0: Own\n/FontName /Own def /FontMatrix [0.002 0 0 0.002 0 0] readonly def /FontBBox{0 -100 500 400}def /Encoding 256 array dup 65 /B put dup 66 /eacute put readonly def currentfile eexec \x00\x01"
    x = sfnt.info(text)
    assert (x["kind"], x["name"], x["units"], x["y0"], x["y1"], x["encoding"]) == ("Type1", "Own", 500.0, -0.2, 0.8, {65: "B", 66: "eacute"})
    assert sfnt.info(b"\x80\x01" + struct.pack("<I", len(text)) + text) == x
    assert [sfnt.info(b) for b in (b"", b"\1\0\4\1", b"%PDF", b"\0\1\0\0\0\x09", font(**{"31": {}})[:60])] == [None] * 5


def test_fonts_of_a_folder(spark, tmp_path):
    for name in ("a.ttf", "b.pfa", "c.txt"):
        (tmp_path / name).write_bytes(font(**{"31": {65: 1}}))
    got = {r["path"].rpartition("/")[2]: r["info"] for r in sfnt.load(spark, str(tmp_path)).collect()}
    assert got.keys() == {"a.ttf", "b.pfa"} and got["a.ttf"]["maps"] == {"31": {65: 1}}


def body(d: str, stream: bytes = b"") -> bytes:
    return d.encode() if not stream else b"<< %s /Length %d >>\nstream\n" % (d.encode(), len(stream)) + stream + b"\nendstream"


def file_of(objects: dict[int, bytes]) -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in objects.items()) + b"trailer << /Root 1 0 R >>\n"


def test_pages_and_fonts_of_a_file(spark):
    show = b"BT /S 10 Tf (AB) Tj /C 10 Tf <00410042> Tj /P 10 Tf (x) Tj /M 1 Tf (no) Tj ET"
    cmap = b"1 beginbfrange <0041> <0042> [<0066006C> <0079>] endbfrange 1 beginbfchar <0043> <0044> endbfchar"
    objs = {
        1: body("<< /Type /Catalog /Pages 2 0 R >>"),
        2: body("<< /Type /Pages /Kids [3 0 R 4 0 R 2 0 R] /Resources << /Font << /S 5 0 R /C 6 0 R /P 9 0 R >> >> >>"),
        3: body("<< /Type /Page /Parent 2 0 R /Contents [10 0 R 11 0 R] >>"),
        4: body("<< /Type /Page /Parent 2 0 R >>"),
        5: body("<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [400 600] /Encoding << /Differences [66 /eacute] >> >>"),
        6: body("<< /Type /Font /Subtype /Type0 /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>"),
        7: body("<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [65 [300] 66 70 900] >>"),
        8: body("", cmap),
        9: body("<< /Type /Font /Subtype /TrueType /FontDescriptor 12 0 R >>"),
        10: body("", show[:30]),
        11: body("", show[30:]),
        12: body("<< /Type /FontDescriptor /Flags 4 /FontFile2 13 0 R >>"),
        13: body("", font(**{"30": {0xF000 + ord("x"): 3}})),
    }
    df = spark.createDataFrame([("f", file_of(objs)), ("g", b"junk"), ("h", None)], "path string, content binary")
    pages = file_fonts.page_streams(df)
    assert sorted((r["path"], r["page"]) for r in pages.collect()) == [("f", 1), ("f", 2)]
    got = state.chunks(pages.where("page = 1"), "path").orderBy("seq").collect()
    assert [(r["text"], round(r["m"][0], 3)) for r in got] == [("Aé", 10.0), ("fly", 12.0), ("F", 7.0)]


def test_containers():
    raw = bytes(range(200))
    assert tiff.samples(tiff.file(raw, 20, 10)) == raw
    strips = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", 4) + struct.pack(">HHIHH", 256, 3, 1, 2, 0) + struct.pack(">HHIHH", 257, 3, 1, 2, 0) + struct.pack(">HHII", 273, 4, 2, 62) + struct.pack(">HHIHH", 279, 3, 2, 2, 2) + struct.pack(">I", 0) + struct.pack(">II", 70, 72) + b"abcd"
    assert tiff.parts(strips)["body"] == b"abcd" and tiff.parts(strips)["width"] == 2
    bits = bytes([0b11110000, 0b00001111])
    assert tiff.samples(tiff.file(fax.encode(bits, 16), 16, 1, 1, compression=tiff.G4, photometric=0)) == bits
    assert tiff.samples(tiff.file(fax.encode(bits, 16), 16, 1, 1, compression=tiff.G4)) == bytes(v ^ 255 for v in bits)
    for bad in (b"", b"II*\0", tiff.file(raw, 20, 10, compression=7)):
        with pytest.raises((FilterError, struct.error)):
            tiff.samples(bad)


def test_map_files_that_are_not_well_formed_have_no_rows(spark):
    df = spark.createDataFrame([(1, "<10>\nab"), (2, "broken <"), (3, None)], "k int, content string")
    assert {(r["k"], r["cc"]) for r in ocr.character_maps(df, "k", "content", blocks=True).where("unicode <> ' '").collect()} == {(1, 16), (1, 17)}


def test_counts_end_on_a_cycle(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")], "node string, parent string")
    counts = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100), ("d", 1000)], "node string, count long")
    got = {r["node"]: r["count"] for r in graph.up(parents, counts).collect()}
    assert got == {"a": 1111, "b": 1111, "c": 1111, "d": 1000}


def test_unreached_nodes_and_groups(spark):
    e = spark.createDataFrame([(1, "r", "k", None, "a"), (1, "x", "k", None, "y")], "doc int, src string, key string, ord int, dst string")
    assert {r["node"] for r in graph.reach(e, e.where("src = 'r'").select("doc", F.col("src").alias("node"))).collect()} == {"r", "a"}
    objs = spark.createDataFrame([("p", 1, '{"Group": {"S": "/Transparency", "CS": ["/ICCBased", {"ref": 3}], "K": true}}'), ("p", 2, '{"Type": "/Page"}'), ("p", 3, None)], "path string, obj_id int, value string")
    assert [tuple(r) for r in images.transparency(objs).collect()] == [("p", 1, "ICCBased", False, True)]
