import random

import numpy as np
import pyarrow as pa
from conftest_llm import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import token_blocks as T


def back(rows):
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(r, np.uint32) for r in rows]])
    out, row_at, starts, block_at = T.encode(ids, at)
    blob = out.tobytes()
    return [T.decode(blob[row_at[i] : row_at[i + 1]], len(r), list(starts[block_at[i] : block_at[i + 1]])).tolist() for i, r in enumerate(rows)], len(blob)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), max_size=5))
def test_round_trip(rows):
    assert back(rows)[0] == rows


def test_outliers_don_t_widen_a_block():
    rng = random.Random(1)
    ids = [rng.randint(1000, 1015) for _ in range(128)]
    plain = back([ids])[1]
    ids[7] = 2**31
    got, size = back([ids])
    assert got == [ids] and size <= plain + 5
    assert back([[5] * 128])[1] == T.HEAD  # no bits at all for equal ids


def test_any_block_decodes_alone():
    rng = random.Random(2)
    ids = [rng.randint(0, 50_000) for _ in range(1000)]
    out, _, starts, _ = T.encode(np.array(ids, np.uint32), np.array([0, 1000]))
    assert T.decode_block(out.tobytes(), int(starts[5]), 128).tolist() == ids[640:768]


def test_documents_decode_to_their_texts(spark):
    rng = random.Random(3)
    rows = [(1, "Hello, world. <|endoftext|> ça va?\n\n  x"), (2, None), (3, ""), (None, "null id"), (5, prose(rng, 60_000)), (6, "\x00\t é" * 50), (6, "\x00\t é" * 50)]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n_tokens int, data binary")
    enc = T.tokenizer()
    got = T.write_tokens(spark, df).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got):
        ids = T.decode(bytes(r["data"]), r["n_tokens"], r["block_starts"]).tolist()
        assert r["doc_id"] == i and ids == enc.encode_ordinary(t or "") and enc.decode(ids) == (t or "")
    assert T.write_tokens(spark, df.limit(0)).count() == 0


def test_null_rows_in_a_batch():
    col = next(T._blocks(T.VOCABULARY, 0.9)(iter([pa.array(["a b", None, ""])])))
    assert col.field(0).to_pylist()[1:] == [0, 0]
