"""Substring dedup with a count-min prefilter.

A passage is WINDOW words. Two texts that share WINDOW consecutive words share at least one anchor: the
ANCHOR-word windows that winnowing selects (Schleimer, Wilkerson and Aiken 2003), a fixed share of all
positions. First pass: every partition counts its anchors in a sparse count-min sketch; the sketches are
merged shard by shard, and only one bit a counter is kept, whether it reached two. Counts are only ever
overestimated, so no repeated anchor is lost. Second pass: anchors that are estimated repeated are
grouped exactly; the WINDOW-word windows about those that do repeat are grouped exactly by 128-bit
hashes, and windows that occur in two or more documents are merged to spans.

The sketch grows with the input up to SKETCH_BYTES, which bounds what is broadcast; beyond that its
counters are more crowded and let more anchors through to the exact grouping, but still lose none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _kernels as K
from leafmill.llm._spark import arrow_batches, small, written

U64 = K.U64
WINDOW, ANCHOR = 50, 26
#: Rows of the sketch, counters for each expected anchor in a row, most bytes of all bits together.
DEPTH, SPREAD, SKETCH_BYTES = 2, 4, 64 << 20
SHARD_BITS = 20
BASES = (U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5))


def anchors(w: K.Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) of the selected anchors of a batch."""
    n = len(w.h)
    h = K.windows(w.h, anchor, BASES[0])
    last = np.repeat(w.at[1:], np.diff(w.at))[: len(h)]
    good = np.arange(len(h)) + anchor <= last
    x = np.where(good, h, K.MAX64)
    reach = window - anchor + 1
    if n < window:
        return np.flatnonzero(good), x[good]
    low = K.slide(x, reach, np.minimum)
    pad = np.zeros(reach - 1, U64)
    top = K.slide(np.concatenate([pad, low, pad]), reach, np.maximum)
    at = np.flatnonzero(good & (top == x))
    return at, x[at]


def counters(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each anchor in one row of the sketch."""
    return (K.mix(h + U64(row) * K.BASE) >> U64(64 - bits)).astype(np.int64)


def _word_batches(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, K.Words]]:
    data, offs = K.text_bytes(col)
    for i, j in K.doc_runs(offs, 4 * K.SEGMENT):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        yield i, d, o, K.words(d, o, fold=False)


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held) if held else np.zeros(0, U64)
            held.clear()
            rows, shards, parts = [], [], []
            for r in range(DEPTH):
                c, n = np.unique(counters(h, r, bits), return_counts=True)
                c = c << 1 | (n > 1)  # the last bit: reached two already
                shard = c >> (SHARD_BITS + 1)
                cut = np.flatnonzero(np.diff(shard, prepend=-1))
                for s, part in zip(shard[cut], np.split(c, cut[1:]) if len(cut) else []):
                    rows.append(r)
                    shards.append(int(s))
                    parts.append((part & ((1 << SHARD_BITS + 1) - 1)).astype(np.uint32).tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(shards, pa.int32()), pa.array(parts, pa.binary())], ["row", "shard", "part"])

        for b in batches:
            for _, _, _, w in _word_batches(b.column(0)):
                held.append(anchors(w)[1])
            if sum(map(len, held)) > 2_000_000:
                yield from flush()
        yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partitions' counters of each shard, up to two."""
    have: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for r, s, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            c = np.frombuffer(part.as_buffer(), np.uint32)
            t = have.setdefault((r, s), np.zeros(1 << SHARD_BITS, np.uint8))
            i = (c >> 1).astype(np.int64)
            t[i] = np.minimum(t[i] + 1 + (c & 1).astype(np.uint8), 2)
    keys = list(have)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([np.packbits(have[k] > 1).tobytes() for k in keys], pa.binary())], ["row", "shard", "bits"])


def repeated_bits(docs: DataFrame, text: str, bits: int) -> list[np.ndarray]:
    """Merged sketch: for each row a bitmap of the counters that reached two."""
    spark = docs.sparkSession
    parts = docs.select(text).mapInArrow(_sketch(bits), "row int, shard int, part binary")
    merged = parts.repartition("row", "shard").mapInArrow(_merge, "row int, shard int, bits binary")
    out = [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(DEPTH)]
    size = (1 << SHARD_BITS) >> 3
    for r in merged.toLocalIterator():
        got = np.frombuffer(r["bits"], np.uint8)
        out[r["row"]][r["shard"] * size : (r["shard"] + 1) * size] = got[: len(out[0])]
    return out


def sketch_bits(text_bytes: int, window: int = WINDOW, anchor: int = ANCHOR) -> int:
    """log2 of the counters of a row: SPREAD for each anchor that so many bytes may have, within the bound."""
    expected = text_bytes / 6 * 2 / (window - anchor + 2)
    bits = max(SHARD_BITS, int(np.ceil(np.log2(max(SPREAD * expected, 1)))))
    return min(bits, int(np.log2(SKETCH_BYTES * 8 / DEPTH)))


#: Rows of the second scan: an anchor (pos >= 0, its hash in h) or a text of at least WINDOW words
#: (pos = -1, its word sequence's hashes in h and g, the characters from its first to its last word).
FOUND = "h bigint, g bigint, pos int, s int, e int"


def _sequence(w: K.Words, base: U64) -> np.ndarray:
    """Hash of each row's whole sequence of words."""
    n = len(w.h) + 1
    c = np.zeros(n, U64)
    np.cumsum(w.h * K.powers(base, n)[:-1], out=c[1:])
    return K.mix((c[w.at[1:]] - c[w.at[:-1]]) * K.powers(K.inverse(base), n)[w.at[:-1]] + np.diff(w.at).astype(U64))


def _survivors(sketch, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        for b in batches:
            for i, d, o, w in _word_batches(b.column(1)):
                at, h = anchors(w)
                for r in range(DEPTH):
                    c = counters(h, r, bits)
                    ok = (table[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
                    at, h = at[ok], h[ok]
                row = np.searchsorted(w.at, at, "right") - 1
                full = np.flatnonzero(np.diff(w.at) >= WINDOW)
                chars = K.char_index(d)
                base = chars[o[full]]
                zero = np.zeros(len(at), np.int64)
                columns = (
                    np.concatenate([h.view(np.int64), _sequence(w, BASES[1])[full].view(np.int64)]),
                    np.concatenate([zero, _sequence(w, BASES[2])[full].view(np.int64)]),
                    np.concatenate([at - w.at[row], np.full(len(full), -1)]).astype(np.int32),
                    np.concatenate([zero, chars[w.start[w.at[full]]] - base]).astype(np.int32),
                    np.concatenate([zero, chars[w.end[w.at[full + 1] - 1]] - base]).astype(np.int32),
                )
                ids = b.column(0).take(pa.array(np.concatenate([row, full]) + i))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["id", "h", "g", "pos", "s", "e"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, anchors' positions, copied) -> the WINDOW-word windows that hold an anchor, or all of a
    text that has copies, with their characters."""
    for b in batches:
        found, whole = b.column(2), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
        flat, bounds = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        for i, d, o, w in _word_batches(b.column(1)):
            n = len(w.h)
            rows = len(w.at) - 1
            pos = flat[bounds[i] : bounds[i + rows]]
            row = np.repeat(np.arange(rows), np.diff(bounds[i : i + rows + 1]))
            ok = pos < np.diff(w.at)[row]  # rows that share an id may differ
            pos, row = pos[ok], row[ok]
            if n < WINDOW or not (len(pos) or whole[i : i + rows].any()):
                continue
            # windows that hold an anchor start within WINDOW - ANCHOR words before it
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.maximum(w.at[row] + pos - (WINDOW - ANCHOR), w.at[row]), 1)
            np.add.at(edge, w.at[row] + pos + 1, -1)
            inside = (np.cumsum(edge[:n]) > 0) | np.repeat(whole[i : i + rows], np.diff(w.at))
            start = np.flatnonzero(inside)
            r = np.searchsorted(w.at, start, "right") - 1
            keep = start + WINDOW <= w.at[r + 1]
            start, r = start[keep], r[keep]
            chars = K.char_index(d)
            base = chars[o[r]]
            h1, h2 = (K.windows(w.h, WINDOW, x)[start].view(np.int64) for x in BASES[1:])
            s, e = chars[w.start[start]] - base, chars[w.end[start + WINDOW - 1]] - base
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r + i)), pa.array(h1), pa.array(h2), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(whole[r + i])], ["id", "h1", "h2", "s", "e", "copied"])


def _spans(s: pa.Array) -> pa.Array:
    """Merge each row's overlapping (s, e) intervals."""
    flat = s.flatten()
    a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    row = np.repeat(np.arange(len(s)), [len(x) for x in s])
    o = np.lexsort((a, row))
    a, b, row = a[o], b[o], row[o]
    far = np.int64(1) << 40
    top = np.maximum.accumulate(b + row * far) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + row[1:] * far >= top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1 if len(first) else first
    spans = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(top[last] - row[last] * far if len(first) else a[first])], ["start", "end"])
    at = np.searchsorted(row[first], np.arange(len(s) + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)


def repeats(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end, first): spans of characters, end exclusive, that are covered by windows of
    WINDOW words which occur in two or more documents. first: this document has the least doc_id of all that
    hold the windows, so a cleaner keeps this copy and cuts the spans with first = false.

    Words are what white space separates, so passages match whatever the white space between their
    words. Texts of under WINDOW words, null and empty texts have no spans. A window that repeats only
    within one document is no repeat; rows that share a doc_id are one document. Rows with a null doc_id
    can't be named and take no part. Very long texts are read whole. No rows: no rows. Other columns
    aren't read.
    """
    arrow_batches(spark)
    x = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").alias("id"), F.col(text).cast("string").alias("text"))
    kind = x.schema["id"].dataType.simpleString()
    size = x.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = sketch_bits(size)
    sketch = spark.sparkContext.broadcast(repeated_bits(x, "text", bits))
    maybe = written(x.mapInArrow(_survivors(sketch, bits), f"id {kind}, {FOUND}"), "anchors")
    # texts that are equal word by word: only the least document of them goes on, the others repeat as a whole
    whole = maybe.where("pos < 0")
    equal = written(whole.groupBy("h", "g").agg(F.min("id").alias("lead"), F.max("id").alias("top")).where("lead < top").select("h", "g", "lead"), "equal")
    member = whole.join(small(equal), ["h", "g"]).select("id", "lead", "s", "e")
    several = whole.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("id")
    copies = written(member.where("id <> lead").select("id", "s", "e").distinct().join(several, "id", "left_anti"), "copies")
    leads = equal.select(F.col("lead").alias("id"), F.lit(True).alias("copied")).distinct()
    only = maybe.where("pos >= 0").join(small(copies.select("id")), "id", "left_anti").select("id", "h", "pos")
    twice = only.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    held = only.join(twice, "h", "left_semi").groupBy("id").agg(F.collect_set("pos").alias("pos"))
    held = held.join(leads, "id", "full").select("id", F.coalesce("pos", F.array().cast("array<int>")).alias("pos"), F.coalesce("copied", F.lit(False)).alias("copied"))
    held = written(held, "held")
    near = x.join(small(held.select("id")), "id", "left_semi").join(held, "id").select("id", "text", "pos", "copied")
    found = written(near.mapInArrow(_windows, f"id {kind}, h1 bigint, h2 bigint, s int, e int, copied boolean"), "windows")
    both = found.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.bool_or("copied").alias("c")).where("a < b or c").select("h1", "h2", "a")
    hit = found.join(both, ["h1", "h2"]).select("id", (F.col("id") == F.col("a")).alias("first"), "s", "e")
    spans = hit.groupBy("id", "first").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    out = spans.select("id", "first", F.explode(F.arrow_udf(_spans, "array<struct<start:long,end:long>>")("x")).alias("y")).select("id", "y.start", "y.end", "first")
    return out.union(copies.select("id", F.col("s").cast("long"), F.col("e").cast("long"), F.lit(False))).withColumnRenamed("id", "doc_id")
