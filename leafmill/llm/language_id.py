"""Language ID by hierarchical discrimination.

A document's folded bytes (letters in lower case, all else blank) give hashed byte n-grams. A first
set of linear support vector machines tells language families apart, a second, one for each pair of
languages within a family, the closely related ones; both vote one-versus-one, and the summed margin
breaks ties. The machines are fitted by dual coordinate descent (Hsieh et al. 2008) on a bounded
sample of labelled rows; prediction reads every document whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _kernels as K
from leafmill.llm._spark import arrow_batches

#: Families of the languages that may be told apart; others form a family of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}
BITS = 15
NONE = 1 << BITS  # in place of an n-gram without letters
SCALE = 20.0  # of mean margins; the sign alone decides
#: Bound of the sample that the machines are fitted on, in documents a language.
TRAIN_PER_LANG = 400
#: An n-gram counts as known once SEEN training documents of one language have it, so that a mislabelled foreign
#: text doesn't vouch for itself.
SEEN = 2
#: A document is rejected when less than this share of its n-grams was seen in training.
MIN_KNOWN = 0.5


def ngram_ids(x: np.ndarray) -> np.ndarray:
    """For each position, the hashed 3-gram that begins there, or NONE if it has no letter in it.

    x: folded bytes. Bytes of a character beyond ASCII count as letters.
    """
    if len(x) < 3:
        x = np.concatenate([x, np.full(3 - len(x), 32, np.uint8)])
    a = x.astype(np.uint32)
    g = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
    letter = x >= 97
    has = letter[:-2] | letter[1:-1] | letter[2:]
    ids = ((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    ids[~has] = NONE
    return ids


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and L2-normed counts of one document."""
    raw = np.frombuffer((" " + text + " ").encode(), np.uint8)
    ids = ngram_ids(K.fold_case(raw))
    ids, n = np.unique(ids[ids < NONE], return_counts=True)
    v = n.astype(np.float64)
    return ids, v / max(np.sqrt((v * v).sum()), 1e-12)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine with hinge loss; y is +1 or -1. Classes are weighted to balance."""
    w = np.zeros(NONE + 1)
    alpha = np.zeros(len(rows))
    bound = np.where(y > 0, c * len(y) / max(2 * (y > 0).sum(), 1), c * len(y) / max(2 * (y < 0).sum(), 1))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            if not len(ids):
                continue
            g = y[i] * (w[ids] @ v) - 1.0
            new = min(max(alpha[i] - g, 0.0), bound[i])
            if new != alpha[i]:
                w[ids] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


@dataclass
class Model:
    """families: family -> its languages; machines: column of weights for each pair that is told apart."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # level ("" or a family), yes, no
    weights: np.ndarray = field(default_factory=lambda: np.zeros((NONE + 1, 1), np.float32))  # last column: seen in training

    def vote(self, level: str, names: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner's index in names and its least margin, one-versus-one."""
        n = len(m)
        if len(names) == 1:
            return np.zeros(n, int), np.full(n, np.inf)
        votes, margin = np.zeros((n, len(names))), np.zeros((n, len(names)))
        least = np.full((n, len(names)), np.inf)
        for k, (at, yes, no) in enumerate(self.pairs):
            if at != level:
                continue
            i, j, s = names.index(yes), names.index(no), m[:, k]
            votes[:, i] += s >= 0
            votes[:, j] += s < 0
            margin[:, i] += s
            margin[:, j] -= s
            least[:, i] = np.minimum(least[:, i], s)
            least[:, j] = np.minimum(least[:, j], -s)
        best = np.argmax(votes * 1e6 + margin, axis=1)
        return best, least[np.arange(n), best]


def fit(rows: list[tuple[str, str]], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model from (text, language) rows. Languages without a family form one of their own."""
    home = {x: f for f, xs in families.items() for x in xs}
    feats = [_features(t) for t, _ in rows]
    langs = [x for _, x in rows]
    groups: dict[str, list[str]] = {}
    for x in sorted(set(langs)):
        groups.setdefault(home.get(x, x), []).append(x)
    model = Model({f: groups[f] for f in sorted(groups)})
    columns = []

    def machine(level: str, yes: str, no: str, side: list[int]) -> None:
        keep = [i for i, s in enumerate(side) if s]
        model.pairs.append((level, yes, no))
        columns.append(fit_svm([feats[i] for i in keep], np.array([side[i] for i in keep], float)))

    for a, b in combinations(model.families, 2):
        machine("", a, b, [(home.get(x, x) == a) - (home.get(x, x) == b) for x in langs])
    for f, names in model.families.items():
        for a, b in combinations(names, 2):
            machine(f, a, b, [(x == a) - (x == b) for x in langs])
    seen = np.zeros(NONE + 1)
    for x in set(langs):
        own = [ids for (ids, _), y in zip(feats, langs) if y == x]
        often = np.bincount(np.concatenate(own).astype(np.int64), minlength=NONE + 1)
        seen[often >= SEEN] = 1
    model.weights = np.stack([*columns, seen], axis=1).astype(np.float32)
    return model


def _sums(model: Model, x: np.ndarray, starts: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights under each machine, and n-gram counts, of the stretches of x from each start. between:
    positions of n-grams that reach into the next stretch and don't count."""
    ids = ngram_ids(K.fold_case(x))
    if between is not None:
        ids[between] = NONE
    s = np.stack([np.add.reduceat(model.weights[:, k][ids], starts, dtype=np.float64) for k in range(model.weights.shape[1])], axis=1)
    return s, np.add.reduceat(ids < NONE, starts, dtype=np.int64)


def margins(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean margin of each document's n-grams under each machine, share of known ones, their number)."""
    n = len(offs) - 1
    out, count = np.zeros((n, model.weights.shape[1])), np.zeros(n, np.int64)
    blank = np.array([32], np.uint8)
    for i, j in K.doc_runs(offs, K.SEGMENT):
        if j == i + 1:  # one row, maybe a very long one: summed piece by piece
            lo, hi = int(offs[i]), int(offs[j])
            for s in range(lo, max(hi, lo + 1), K.SEGMENT):
                e = min(s + K.SEGMENT, hi)
                x = np.concatenate([blank if s == lo else data[s - 2 : s], data[s:e], blank if e == hi else blank[:0]])
                part, k = _sums(model, x, np.zeros(1, np.int64))
                out[i] += part[0]
                count[i] += k[0]
            continue
        lens = np.diff(offs[i : j + 1])  # blanks go between rows, so that no n-gram spans two
        at = np.zeros(j - i + 1, np.int64)
        np.cumsum(lens + 2, out=at[1:])
        x = np.full(at[-1] + 2, 32, np.uint8)
        x[np.arange(offs[i], offs[j]) + np.repeat(at[:-1] + 1 - offs[i:j], lens)] = data[offs[i] : offs[j]]
        end = at[:-1] + lens
        out[i:j], count[i:j] = _sums(model, x, at[:-1], np.concatenate([end, end + 1]))
    out /= np.maximum(count, 1)[:, None]
    return out[:, :-1] * SCALE, out[:, -1], count


def predict(model: Model, data: np.ndarray, offs: np.ndarray, min_known: float = MIN_KNOWN) -> tuple[list, list, np.ndarray, np.ndarray]:
    """(family, language, margin, known share); family and language are None for a rejected row."""
    n = len(offs) - 1
    m, known, count = margins(model, data, offs)
    names = list(model.families)
    if not names:
        return [None] * n, [None] * n, np.zeros(n), known
    fam, sure = model.vote("", names, m)
    lang = np.zeros(n, object)
    for k, f in enumerate(names):
        best, s = model.vote(f, model.families[f], m)
        here = fam == k
        lang[here] = np.array(model.families[f], object)[best[here]]
        sure[here] = np.minimum(sure[here], s[here])
    ok = (count > 0) & (known >= min_known)
    sure = np.where(np.isfinite(sure), sure, 1.0)
    return [names[f] if k else None for f, k in zip(fam, ok)], [x if k else None for x, k in zip(lang, ok)], np.where(ok, sure, 0.0), known


def train_sample(docs: DataFrame, lang: str = "lang", text: str = "text", per_lang: int = TRAIN_PER_LANG) -> list[tuple[str, str]]:
    """At most per_lang labelled (text, language) rows of each language, whole texts: those least by hash of
    doc_id and, among rows that share one, by hash of the text; rows with equal texts count once.

    The hashes are chosen from two narrow columns; only the chosen rows' texts are read to the driver. A chosen
    row without a text takes no other's place.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    known = docs.where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull())
    narrow = known.select(F.col(lang).alias("l"), h.alias("h"))
    counts = {r["l"]: r["n"] for r in narrow.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    by_lang = lambda values: F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))])[F.col("l")]
    share = by_lang({k: min(1.0, (3.0 * per_lang + 50) / n) for k, n in counts.items()})
    least = F.expr(f"array_max(slice(array_sort(collect_set(h)), 1, {per_lang}))").alias("top")
    top = {r["l"]: r["top"] for r in narrow.where(F.col("h") < share * (1 << 52)).groupBy("l").agg(least).collect()}
    if not top:
        return []
    got = known.where(F.col(text).isNotNull()).select(F.col(lang).alias("l"), h.alias("h"), F.col(text).cast("string").alias("t"))
    got = got.where((F.col("h") < share * (1 << 52)) & (F.col("h") <= by_lang(top))).select("l", "h", F.xxhash64("t").alias("th"), "t")
    out: dict[str, list[tuple[str, str]]] = {}
    for r in sorted({tuple(r) for r in got.toLocalIterator()}):
        out.setdefault(r[0], []).append((r[3], r[0]))
    return [r for k in sorted(out) for r in list(dict.fromkeys(out[k]))[:per_lang]]


def _columns(model: Model, min_known: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            fam, lang, sure, known = predict(model, *K.text_bytes(col), min_known)
            yield pa.StructArray.from_arrays([pa.array(fam, pa.string()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(known, pa.float64())], ["family", "predicted", "margin", "known"])

    return run


def identify(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = TRAIN_PER_LANG, min_known: float = MIN_KNOWN) -> DataFrame:
    """docs and a column langid: struct(family, predicted, margin, known).

    Nulls: a null or empty text, or one without letters, is rejected (family and predicted are null,
    margin 0); a row with a null label or doc_id isn't trained on but is predicted. Rejected too: texts
    of which less than min_known of the n-grams are known from training (an unknown language or script). Known are
    n-grams that SEEN training rows of one language have, however few rows a language has; so the texts of a language
    with a single labelled row are only accepted on n-grams that other languages' rows know.
    No labelled rows: all are rejected; one label: every known text gets it. Very long texts are read
    whole, piece by piece. Repeated rows get equal answers; a column that is named langid is replaced.
    """
    arrow_batches(spark)
    model = spark.sparkContext.broadcast(fit(train_sample(docs, lang, text, per_lang)))

    @F.arrow_udf("struct<family:string,predicted:string,margin:double,known:double>")
    def langid(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _columns(model.value, min_known)(it)

    return docs.withColumn("langid", langid(F.col(text).cast("string")))
