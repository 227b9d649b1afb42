"""What a step holds or repeats doesn't grow with the table."""

import pytest

from leafmill.queries import load

QUERIES, SQL = load()


def test_files_that_embed_one_font_build_it_once():
    from leafmill.operators.file_fonts import pages
    from leafmill.queries.programs import scrambled_font
    from leafmill.sources import pdf, sfnt

    own, other = scrambled_font(), sfnt.program([500, 600], {"30": {0xF041: 1}}, [".notdef", "uni0042"])
    files = [pdf.write_file([text], font=font) for text, font in ((b"BT ET", own), (b"BT (a) Tj ET", own), (b"BT ET", other))]
    a, b, c = (list(pages(f))[0][2][0][1] for f in files)
    assert a is b and a is not c
    assert dict(c["unicode"])[0x41] == "B" and dict(a["unicode"])[0x41] == "z"


@pytest.mark.parametrize("name", ["k7_font_constructor", "n5_added_map", "n1_font_programs", "n8_marked_up_layers"])
def test_work_on_narrow_tables_is_dealt_over_the_cores(spark, sf, name):
    cores = spark.sparkContext.defaultParallelism
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= cores


def test_reading_order_is_that_of_the_relation():
    import random
    from functools import cmp_to_key

    from leafmill.operators.state import before, reading_order

    r = random.Random(3)
    for _ in range(60):
        ms = [tuple(r.choice((0, 0.5, 1, -1, 8, 0.1)) * (r.random() if r.random() < 0.5 else 1) for _ in range(4)) + (r.randrange(9), r.randrange(9)) for _ in range(25)]
        want = sorted(range(25), key=cmp_to_key(lambda i, j: -before(ms[i], ms[j]) or before(ms[j], ms[i])))
        assert reading_order(ms) == want


def _batches(df) -> tuple[int, int]:
    """Rows and bytes to which the session bounds Arrow batches once a query is built."""
    get = df.sparkSession.conf.get
    return int(get("spark.sql.execution.arrow.maxRecordsPerBatch")), int(get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB"))


def _unbound(spark):
    for k in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")


def test_pages_come_in_small_batches(spark, sf):
    _unbound(spark)
    rows, size = _batches(QUERIES["o1_reading_order"](spark, sf))
    assert rows <= 1000 and size <= 4 << 20


def test_wide_gaps_are_spaces_or_one_space():
    from leafmill.operators.state import page_text

    ms = [(1.0, 0.0, 0.0, 1.0, x, y) for x, y in ((0.0, 0.0), (50.0, 0.0), (900.0, -3.0))]
    assert page_text(["a", "b", "c"], ms, widest=1) == "a b\n\n\n c"
    whole = page_text(["a", "b", "c"], ms)
    assert whole.split() == ["a", "b", "c"] and whole.count(" ") > 1000


def test_pages_of_wide_gaps_leave_a_worker_one_by_one(spark):
    """A batch of pages whose gaps are millions of spaces isn't held as a whole."""
    from pyspark.sql import functions as F

    from leafmill.operators.state import page_texts

    m = F.array(*[F.lit(v).cast("double") for v in (1, 0, 0, 1)], F.col("x"), F.lit(0.0))
    x = spark.range(40).select("id", F.explode(F.array(F.lit(0.0), F.lit(500_000.0))).alias("x"))
    t = page_texts(x.select("id", F.col("x").alias("seq"), F.lit("a").alias("text"), m.alias("m")).coalesce(1), "id")
    assert t.agg(F.min(F.length("text"))).first()[0] > 900_000 and t.count() == 40


def test_equal_data_meets_a_function_once_a_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafmill.sources import codecs

    def f(x):
        with open(tmp_path / "calls", "a") as out:
            out.write(".")
        return x[::-1]

    x = spark.range(300).coalesce(1).select(F.encode((F.col("id") % 3).cast("string"), "UTF-8").alias("b"))
    x = x.withColumn("b", F.when(F.col("b") != F.lit(b"1"), F.concat("b", F.lit(b"x"))))
    got = x.select(codecs.column(f, F.col("b")).alias("y")).groupBy("y").count().collect()
    assert {None if r["y"] is None else bytes(r["y"]): r["count"] for r in got} == {None: 100, b"x0": 100, b"x2": 100}
    assert len((tmp_path / "calls").read_text()) == 2


def test_relative_paths_in_rows_and_in_tables(spark):
    """Against a walk along each stream; the plan holds one sort of commands at most."""
    import random

    from leafmill.operators.rewrite import relative_paths
    from leafmill.sources.content import FAMILIES

    r = random.Random(5)
    rows, want = [], {}
    for doc in range(40):
        cmds = [(doc, 3 * k + 1, op := r.choice(("m", "l", "re", "h", "W", "S", "f", "g", "q", "Tj")), [r.choice(("1.5", "7", "-2", "x")) for _ in range({"m": 2, "l": 2, "re": 4, "g": 1}.get(op, 0))], {"k": str(k)}) for k in range(r.randrange(25))]
        rows += cmds
        parts, inside = [[]], []
        for c in cmds:
            parts[-1].append(c)
            if c[2] in FAMILIES["paint"]:
                parts.append([])
        for n, part in enumerate(parts, 1):
            begin = next((i for i, c in enumerate(part) if c[2] in ("m", "re")), len(part))
            own = [c for c in part[begin:] if c[2] in FAMILIES["path"] + FAMILIES["paint"] + FAMILIES["clip"]]
            number = lambda v: None if v == "x" else float(v)
            first = [next((v for c in own if len(c[3]) > k and (v := number(c[3][k])) is not None), None) if not any(c[2] == "W" for c in own) else None for k in (0, 1)]
            for c in part:
                x, y = first if c in own else (None, None)
                args = [number(v) for v in c[3]]
                moved = None if x is None else [v if i >= (2 if c[2] == "re" else len(args)) else None if v is None or (x, y)[i % 2] is None else v - (x, y)[i % 2] for i, v in enumerate(args)]
                want[c[0], c[1]] = n if c in own else None, x, y, moved
    r.shuffle(rows)
    got = relative_paths(spark.createDataFrame(rows, "doc_id int, seq int, op string, args array<string>, props map<string,string>"))
    assert got.columns == ["doc_id", "seq", "op", "args", "props", "path", "x", "y", "relative"]
    assert {(c["doc_id"], c["seq"]): (c["path"], c["x"], c["y"], c["relative"]) for c in got.collect()} == want


def test_drawings_are_moved_without_a_window(spark, sf):
    plan = QUERIES["t10_relative_paths"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_table_codes_without_a_clear_and_cut_short():
    """A full table stays, codes have 12 bits from then on; widths grow a code early or not."""
    import random

    from leafmill.queries.codecs import _lzw_codes
    from leafmill.sources.codecs import lzw

    r = random.Random(2)
    for early in (0, 1):
        data, bits, known, width = bytes(r.randrange(256) for _ in range(9000)), "", 258, 9
        for j, b in enumerate(data):
            bits += f"{b:0{width}b}"
            if j and known < 4096:
                known += 1
                width += width < 12 and known >= (1 << width) - early
        bits += f"{256:0{width}b}{65:09b}{257:09b}"
        bits += "0" * (-len(bits) % 8)
        packed = int(bits, 2).to_bytes(len(bits) // 8, "big")
        assert lzw(packed, early) == data + b"A"
        assert data.startswith(lzw(packed[:5000], early)) and len(lzw(packed[:5000], early)) > 3000
        for n in (0, 1, 2, 300, 30_000):
            raw = bytes(r.choice(b"abcd") for _ in range(n))
            assert lzw(_lzw_codes(raw, early), early) == raw


def test_each_row_meets_one_kind_of_table_codes(spark, sf, monkeypatch):
    plan = QUERIES["f7_lzw"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 2 and "coalesce(" in plan


def test_samples_are_unpacked_by_their_codec(spark, sf):
    plan = QUERIES["f13_pixel_unpack"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("name", ["f5_flate", "s2_file_graph", "o2_page_text", "f8_run_length", "p6_exact_parser", "f4_ascii85", "s1_file_round_trip", "p3_exact_lexer", "f2_filter_chain"])
def test_rows_come_in_small_batches(spark, sf, name):
    _unbound(spark)
    rows, size = _batches(QUERIES[name](spark, sf))
    assert rows <= 1000 and size <= 4 << 20


def test_matrices_of_forms_come_without_a_join(spark, sf, monkeypatch):
    from leafmill.operators import graph

    plans, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    QUERIES["g4_nested_forms"](spark, sf)
    own = next(p for p in plans if "MapInArrow" in p)
    assert "Join" not in own
