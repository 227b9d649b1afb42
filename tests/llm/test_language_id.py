import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import _kernels as K
from leafmill.llm import language_id as L
from leafmill.llm.queries import QUERIES

PARTS = {
    "en": "the of and ing tion er th sh ou ea wh ed ly".split(),
    "de": "der die und sch ung ein ver ich keit ß ü tz au".split(),
    "fr": "le la des que eau oi ai é è ç ment eux ou".split(),
    "es": "el los que ción ado ñ ll rr mente ar es os ía".split(),
}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def labelled(rng, n):
    return [(text(rng, lang, rng.randint(5, 120)), lang) for lang in PARTS for _ in range(n)]


def test_held_out_accuracy_and_hierarchy():
    rng = random.Random(1)
    model = L.fit(labelled(rng, 60))
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert [p[0] for p in model.pairs] == ["", "germanic", "romance"]
    held = labelled(rng, 100)
    fam, lang, sure, known = L.predict(model, *K.text_bytes(pa.array([t for t, _ in held])))
    assert np.mean([a == b for a, (_, b) in zip(lang, held)]) > 0.98
    assert all((f == "germanic") == (x in ("en", "de")) for f, x in zip(fam, lang))


def test_rejected_texts():
    rng = random.Random(2)
    model = L.fit(labelled(rng, 40))
    odd = [None, "", "123 456 !!!", "Привет мир, как дела сегодня", "你好世界", text(rng, "en", 5), "THE " + text(rng, "en", 20).upper()]
    _, lang, sure, _ = L.predict(model, *K.text_bytes(pa.array(odd)))
    assert lang == [None] * 5 + ["en", "en"] and (sure[:5] == 0).all()


def test_very_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(3)
    model = L.fit(labelled(rng, 40))
    texts = [text(rng, "en", 30) + " " + text(rng, "de", 3000), "x", text(rng, "fr", 2000)]
    want = L.margins(model, *K.text_bytes(pa.array(texts)))
    monkeypatch.setattr(K, "SEGMENT", 1000)
    have = L.margins(model, *K.text_bytes(pa.array(texts)))
    assert all(np.allclose(a, b) for a, b in zip(want, have))
    assert L.predict(model, *K.text_bytes(pa.array(texts)))[1][0] == "de"


def test_identify(spark):
    rng = random.Random(4)
    rows = [(i, t, x, 1) for i, (t, x) in enumerate(labelled(rng, 50))]
    rows += [(None, text(rng, "fr", 50), "fr", 1), (900, text(rng, "es", 50), None, 1), (901, None, "en", 1), (902, "", "en", 1), (3, rows[3][1], rows[3][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, langid int")
    got = L.identify(spark, df).select("doc_id", "text", "lang", "langid.*").collect()
    assert len(got) == len(rows)
    assert all(r["predicted"] == r["lang"] for r in got if r["text"] and r["lang"])
    assert {r["predicted"] for r in got if not r["text"]} == {None}
    assert next(r for r in got if r["doc_id"] == 900)["predicted"] == "es"


def test_one_label_none_and_no_rows(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(1, "the ship", "en"), (2, "the ship", None)]
    single = spark.createDataFrame(rows, schema)  # a text doesn't vouch for itself, and a copy of it doesn't either
    assert [r["langid"]["predicted"] for r in L.identify(spark, single).collect()] == [None, None]
    assert [r["langid"]["predicted"] for r in L.identify(spark, spark.createDataFrame([*rows, (3, "the ship", "en")], schema)).collect()] == [None] * 3
    one = spark.createDataFrame([*rows, (3, "the ship!", "en")], schema)
    assert [r["langid"]["predicted"] for r in L.identify(spark, one).collect()] == ["en"] * 3
    none = spark.createDataFrame([(1, "the ship", None)], schema)
    assert L.identify(spark, none).first()["langid"]["predicted"] is None
    assert L.identify(spark, none.limit(0)).count() == 0


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, "word " * 300, "en") for i in range(500)] + [(i, "mot", "fr") for i in range(500, 520)]
    got = L.train_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=30)
    assert {x for _, x in got} == {"en", "fr"} and all(t in ("word " * 300, "mot") for t, _ in got)


@pytest.mark.parametrize("n", [2, 9, 10, 11, 40])
def test_known_ngrams_need_two_rows_at_every_size(n):
    rows = [(f"the ship number {'abcdefghijklmnopqrstuvwxyz'[i % 26]}", "en") for i in range(n)] + [("zyq wvx kjq", "en")]
    model = L.fit(rows)
    _, lang, _, known = L.predict(model, *K.text_bytes(pa.array(["the ship", "zyq wvx kjq"])))
    assert lang == ["en", None] and known[0] > 0.9 and known[1] < 0.2


def naive(model, rows, t):
    """Family, language and known share of one text by the definition: every 3-gram of bytes, one machine after another."""
    fold = {**{c: c for c in range(0x80, 0x100)}, **{c: c for c in b"0123456789abcdefghijklmnopqrstuvwxyz"}, **{c: c + 32 for c in range(65, 91)}}
    raw = (" " + t + " ").encode()
    x = [fold.get(c, 32) for c in raw]
    for i in range(len(x) - 1):
        if x[i] == 0xC3 and 0x80 <= x[i + 1] <= 0x9E and x[i + 1] != 0x97:
            x[i + 1] += 32
    grams = []
    for i in range(len(x) - 2):
        if any(c >= 97 for c in x[i : i + 3]):
            g = x[i] | x[i + 1] << 8 | x[i + 2] << 16
            grams.append((g * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - L.BITS))
    if not grams:
        return None, None, 0.0
    known = sum(model.weights[g, -1] for g in grams) / len(grams)
    if known < L.MIN_KNOWN:
        return None, None, known

    def winner(level, names):
        votes, total = Counter(dict.fromkeys(names, 0)), Counter()
        for k, (at, yes, no) in enumerate(model.pairs):
            if at == level:
                m = sum(float(model.weights[g, k]) for g in grams) / len(grams)
                votes[yes if m >= 0 else no] += 1
                total[yes] += m
                total[no] -= m
        return max(names, key=lambda n: (votes[n], total[n]))

    family = winner("", list(model.families))
    return family, winner(family, model.families[family]), known


def test_registered_query_equals_brute_force(spark, sf):
    """A naive scorer of n-grams over all supplied documents, with the machines fitted on the same sample."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.train_sample(docs)
    model = L.fit(rows)
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and len(rows) == len(set(rows))
    right = 0
    for i, t in texts.items():
        family, lang, known = naive(model, rows, t or "")
        assert (got[i]["family"], got[i]["predicted"]) == (family, lang) and abs(got[i]["known"] - known) < 1e-6
        right += lang == got[i]["lang"]
    assert right >= 0.97 * len(texts)


def test_training_rows_are_those_least_by_hash(spark):
    df = spark.createDataFrame([(i, f"word{i}", "en") for i in range(300)] + [(7, "another text", "en"), (8, None, "en")], "doc_id long, text string, lang string")
    order = [r[0] for r in df.where("text is not null").selectExpr("text", "pmod(xxhash64(doc_id), 4503599627370496) h", "xxhash64(text) t").orderBy("h", "t").collect()]
    assert [t for t, _ in L.train_sample(df, per_lang=40)] == order[:40]
