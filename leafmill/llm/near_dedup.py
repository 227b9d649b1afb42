"""MinHash near-dedup with fast similarity sketches.

Shingles are SHINGLE words, letters folded and punctuation dropped. A sketch has SIZE coordinates that
are filled in rounds (Dahlgaard, Knudsen and Thorup, FOCS 2017): in round i < SIZE every shingle falls
into one hashed bin with value (i, hash); in round SIZE + j all fall into bin j, so after at most
2 * SIZE rounds each coordinate is filled, and agreement of two sketches concentrates about their
Jaccard similarity as for independent minima. Most documents need two or three rounds, not SIZE.

Sketches are cut into bands. Documents that share a band are candidates. Each is first paired with the least
of its bucket; where a bucket then still holds several components, its documents are joined with one another by
their rarest shingles (a prefix filter: two sets of similarity THRESHOLD share one of them for certain), so many
unlike documents that meet in a bucket over common passages aren't paired. All candidates are verified exactly on
the shingle sets of whole texts. Groups are the connected components of verified pairs: skipping pairs within
one component changes no group, so groups of thousands cost no squares.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import _kernels as K
from leafmill.llm._spark import arrow_batches, components, small, written

U64 = K.U64
SIZE, BANDS, ROWS = 256, 64, 4
SHINGLE = 3
THRESHOLD = 0.5


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """(hashes, bounds by row, words). A row of 1 to k-1 words is one shingle; one without words has none."""
    w = K.words(data, offs, fold=True)
    n = np.diff(w.at)
    count = np.where(n >= k, n - k + 1, n > 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    first = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(w.at[:-1], count)
    end = np.repeat(w.at[1:], count)
    h = np.full(at[-1], 0x1234567, U64)
    for j in range(k):
        i = first + j
        here = i < end
        h = K.mix(h * K.BASE + np.where(here, w.h[np.minimum(i, max(len(w.h) - 1, 0))], U64(0)))
    return h, at, w


def sketches(h: np.ndarray, at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """(rows, size) uint64. Rows without shingles keep the greatest value everywhere."""
    n = len(at) - 1
    out = np.full(n * size, K.MAX64, U64)
    row = K.row_of(at)
    for i in range(2 * size):
        if not len(h):
            break
        x = K.mix(h + U64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where = (x & U64(size - 1)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, row * size + where, (x >> U64(10)) | U64(i << 54))
        open_ = (out.reshape(n, size) == K.MAX64).any(axis=1)
        live = open_[row]
        h, row = h[live], row[live]
    return out.reshape(n, size)


def _sequence_hash(w: K.Words, base: U64) -> np.ndarray:
    """Hash of each row's whole sequence of folded words."""
    p = K.powers(base, len(w.h) + 1)
    c = np.zeros(len(w.h) + 1, U64)
    np.cumsum(w.h * p[:-1], out=c[1:])
    return K.mix((c[w.at[1:]] - c[w.at[:-1]]) * K.powers(K.inverse(base), len(w.h) + 1)[w.at[:-1]] + np.diff(w.at).astype(U64))


def _sketch(col: pa.Array) -> pa.Array:
    """n: words; f1, f2: hashes of the folded words in order; bands: keys of the sketch's bands."""
    data, offs = K.text_bytes(col)
    n = len(offs) - 1
    words, f1, f2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
    bands = np.zeros((n, BANDS), U64)
    for i, j in K.doc_runs(offs, 2 * K.SEGMENT):
        h, at, w = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        words[i:j] = np.diff(w.at)
        f1[i:j], f2[i:j] = _sequence_hash(w, K.BASE), _sequence_hash(w, U64(0xD6E8FEB86659FD93))
        s = sketches(h, at)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[None, :], j - i, axis=0)
        for r in range(ROWS):
            key = K.mix(key * K.BASE + s[:, r::ROWS])
        bands[i:j] = key
    return pa.StructArray.from_arrays(
        [
            pa.array(words),
            pa.array(f1.view(np.int64)),
            pa.array(f2.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
        ],
        ["n", "f1", "f2", "bands"],
    )


def sketch(*cols: Column | str) -> Column:
    """Sketch of each row, as an Arrow function."""
    return F.arrow_udf(_sketch, "struct<n:long,f1:long,f2:long,bands:array<long>>")(*cols)


def _sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order: (hashes, rows)."""
    hs, rs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in K.doc_runs(offs, K.SEGMENT):
        h, at, _ = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        r = K.row_of(at) + i
        o = np.lexsort((h, r))
        h, r = h[o], r[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        hs.append(h[new])
        rs.append(r[new])
    return np.concatenate(hs), np.concatenate(rs)


def jaccard_rows(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarity of the shingle sets of whole texts, row by row; 0 without shingles.

    A text of a that repeats the one of the row before it, as a hub's does, is cut into shingles once.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    new = np.ones(n, bool)
    new[1:] = ~pc.fill_null(pc.equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False)
    which = np.cumsum(new) - 1
    (ha, ra), (hb, rb) = _sets(*K.text_bytes(a.filter(pa.array(new)))), _sets(*K.text_bytes(b))
    at_a, at_b = np.searchsorted(ra, np.arange(which[-1] + 2)), np.searchsorted(rb, np.arange(n + 1))
    out = np.zeros(n)
    for i in range(n):
        x, y = ha[at_a[which[i]] : at_a[which[i] + 1]], hb[at_b[i] : at_b[i + 1]]
        if len(x) and len(y):
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out[i] = both / (len(x) + len(y) - both)
    return out


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(jaccard_rows(a, b))


def jaccard(*cols: Column | str) -> Column:
    """Jaccard of each row, as an Arrow function."""
    return F.arrow_udf(_jaccard, "double")(*cols)


def _shingle_lists(col: pa.Array) -> pa.Array:
    h, r = _sets(*K.text_bytes(col))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(col) + 1)), pa.int32()), pa.array(h.view(np.int64)))


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v), those whose whole texts have at least the threshold's similarity, with it."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    texts = docs.join(small(ids), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))  # repeated rows once
    full = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
    full = full.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u")
    return written(full.select("u", "v", jaccard("tu", "tv").alias("similarity")).where(F.col("similarity") >= threshold), "verified")


def _rare_pairs(placed: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: pairs of placed (id, root) of different roots that share a shingle among the rarer ones of both,
    the ordering by frequency leaving out the ceil(threshold * m) - 1 most common of a document's m shingles. Pairs
    of at least the threshold's similarity share more than that many with each other, so none is lost."""
    cut = threshold - 1e-9
    sets = docs.join(small(placed.select("id")), "id", "left_semi").select("id", F.arrow_udf(_shingle_lists, "array<long>")("text").alias("hs"))
    each = written(sets.select("id", F.size("hs").alias("m"), F.explode("hs").alias("h")).distinct(), "shingles")
    often = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    common_first = Window.partitionBy("id").orderBy(F.desc("c"), F.desc("h"))
    rare = each.join(often, "h").withColumn("r", F.row_number().over(common_first)).where(F.col("r") >= F.ceil(F.lit(cut) * F.col("m")))
    rare = written(rare.select("id", "m", "h").join(placed, "id"), "rare")
    a, b = (rare.select("h", F.col("id").alias(i), F.col("root").alias(r), F.col("m").alias(m)) for i, r, m in (("u", "ru", "mu"), ("v", "rv", "mv")))
    alike = F.least("mu", "mv") >= F.lit(cut) * F.greatest("mu", "mv")
    return a.join(b, "h").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & alike).select("u", "v").distinct()


def groups(spark: SparkSession, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(ids, members): ids has (doc_id, f1, f2, n, lead) for every row with a doc_id; members has
    (lead, group_id) for the leads that fell into a group with others.

    lead is the least doc_id with the same folded words; similarity among those is 1.
    """
    arrow_batches(spark)
    x = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(text).cast("string").alias("text"))
    s = x.withColumn("s", sketch("text")).select("id", "s.*").where("n > 0")
    s = written(s, "sketches")
    lead = written(s.groupBy("f1", "f2", "n").agg(F.min("id").alias("lead"), F.min_by("bands", "id").alias("bands")), "leads")
    bands = lead.select(F.col("lead").alias("id"), F.explode("bands").alias("key"))
    hot = bands.groupBy("key").agg(F.min("id").alias("m"), F.max("id").alias("top")).where("m < top").select("key", "m")
    shared = written(bands.join(hot, "key"), "buckets")
    star = written(shared.where("id <> m").select(F.col("m").alias("u"), F.col("id").alias("v")).distinct(), "stars")
    edges = _verified(star, x, threshold)
    comp = components(edges.select("u", "v"))
    # documents of buckets that still hold several components: paired with one another, but for pairs that were tried
    placed = shared.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    multi = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = written(placed.join(multi, "key", "left_semi").select("id", "root").distinct(), "open")
    tried = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = _rare_pairs(open_, x, threshold).join(tried, ["u", "v"], "left_anti")
    more = _verified(written(rest, "rest"), x, threshold)
    members = components(edges.select("u", "v").union(more.select("u", "v")))
    ids = s.select("id", "f1", "f2", "n").join(lead.select("f1", "f2", "n", "lead"), ["f1", "f2", "n"])
    return ids.withColumnRenamed("id", "doc_id"), written(members.select(F.col("node").alias("lead"), F.col("root").alias("group_id")), "members")


def _names(docs: DataFrame, text: str) -> tuple[bool, Column, Callable[[str], Column]]:
    """(shared, name, doc_id of a column of names). A row's name is its doc_id, where rows share one its doc_id and
    a hash of its text, so that different texts of a doc_id are grouped each by itself."""
    shared = not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()
    if not shared:
        return False, F.col("doc_id"), F.col
    name = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    return True, F.when(F.col("doc_id").isNotNull(), name), lambda c: F.col(c).getField("doc_id")


def assign(spark: SparkSession, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, size, keep) for every row: group_id is the least doc_id of the group of near
    duplicates, size the group's rows, keep whether doc_id is that least one.

    A null doc_id gives (null, null, 1, true): it can't be named in a group. Null, empty and wordless
    texts are alone: group_id is their doc_id. Pairs that share no band of their sketches aren't found (one in 60 of
    those whose similarity is the threshold of 0.5, none in practice from 0.7 on); every pair that shares one is verified. Rows that share a doc_id are each in their own text's group,
    and have its keep. Very long texts are sketched and compared whole. No rows: no rows. Columns other than
    doc_id and text aren't read.
    """
    _, name, doc_id = _names(docs, text)
    ids, members = groups(spark, docs.select(name.alias("doc_id"), text), text, threshold)
    root = ids.join(members, "lead", "left").groupBy("doc_id").agg(F.min(F.coalesce("group_id", "lead")).alias("group_id"))
    root = written(root, "roots")
    rows = docs.select(name.alias("doc_id")).join(root, "doc_id", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    rows = rows.select(doc_id("doc_id").alias("doc_id"), doc_id("group_id").alias("group_id"))
    size = rows.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("size"))
    out = rows.join(size, "group_id", "left")
    return out.select("doc_id", "group_id", F.coalesce("size", F.lit(1)).cast("long").alias("size"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("group_id"))).alias("keep"))


def dedup(spark: SparkSession, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those near duplicates whose group has a lesser doc_id; all columns stay.

    Of rows that share a doc_id, those go whose own text is such a near duplicate, and the others stay.
    Of rows that share the doc_id that stays, one stays for each sequence of folded words; null and wordless texts
    all stay. Any names of columns are fine. No rows: no rows. Texts that stay aren't shuffled while the dropped ids are at most BROADCAST_ROWS.
    """
    shared, name, doc_id = _names(docs, text)
    ids, members = groups(spark, docs.select(name.alias("doc_id"), text), text, threshold)
    root = ids.join(members, "lead", "left").groupBy("doc_id").agg(F.min(F.coalesce("group_id", "lead")).alias("root"), F.count("*").alias("rows"))
    root = written(root, "roots")
    gone = root.where(doc_id("doc_id") != doc_id("root")).select(F.col("doc_id").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), name.alias("name"), F.col("doc_id").alias("id"))  # no column of docs clashes with ours
    kept = rows.join(small(gone), F.col("name") == F.col("gone"), "left_anti")
    if not shared:
        return kept.select("row.*")
    twice = root.where(doc_id("doc_id") == doc_id("root")).groupBy(doc_id("doc_id").alias("twice")).agg(F.sum("rows").alias("n")).where("n > 1").select("twice")
    if twice.isEmpty():
        return kept.select("row.*")
    keys = small(twice)
    again = kept.join(keys, F.col("id") == F.col("twice"), "left_semi").withColumn("s", sketch(F.col("row").getField(text).cast("string")))
    alone = again.where("s.n = 0").select("row.*")
    once = again.where("s.n > 0").groupBy("id", "s.n", "s.f1", "s.f2").agg(F.first("row").alias("row")).select("row.*")
    return kept.join(keys, F.col("id") == F.col("twice"), "left_anti").select("row.*").union(alone).union(once)
