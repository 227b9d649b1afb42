"""Token ids as patched frame-of-reference blocks.

Ids are cut into blocks of BLOCK. A block stores its least id, the differences from it packed at a width
that holds a given percentile of them, and the differences that don't fit as exceptions (position and
high bits). An index of byte offsets lets a reader decode any block alone.

Layout of a block, little endian: uint32 least id, uint8 width, uint8 exceptions, then ceil(n * width / 8)
bytes of packed low bits, then uint8 positions and uint32 high parts of the exceptions.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _kernels as K
from leafmill.llm._spark import arrow_batches

BLOCK = 128
#: Share of a block's values that the packed width must hold.
PERCENTILE = 0.9
HEAD = 6
#: Vocabulary file of a public byte-level BPE, and its pattern of pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encode(ids: np.ndarray, at: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row bounds in them, blocks' offsets within their row, row bounds in those).

    ids: uint32 of all rows; row i has ids[at[i]:at[i+1]].
    """
    rows = len(at) - 1
    per_row = -(-np.diff(at) // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    nb = int(block_at[-1])
    row = np.repeat(np.arange(rows), per_row)
    begin = at[row] + (np.arange(nb) - block_at[row]) * BLOCK
    size = np.minimum(BLOCK, at[row + 1] - begin) if nb else np.zeros(0, np.int64)
    col = np.arange(BLOCK)
    valid = col[None, :] < size[:, None]
    x = np.zeros((nb, BLOCK), np.uint32)
    x[valid] = ids
    low = np.where(valid, x, np.uint32(0xFFFFFFFF)).min(axis=1, initial=0xFFFFFFFF).astype(np.uint32)
    d = np.where(valid, x - low[:, None], 0).astype(np.uint32)
    need = np.zeros((nb, BLOCK), np.uint8)  # bits of each difference
    for k in (16, 8, 4, 2, 1):
        big = (d >> need.astype(np.uint32)) >= (1 << k)
        need[big] += k
    need += d > 0
    need[~valid] = 0
    sorted_need = np.sort(np.where(valid, need, 255), axis=1)
    pick = np.maximum(np.ceil(size * percentile).astype(np.int64) - 1, 0)
    width = sorted_need[np.arange(nb), pick].astype(np.int64) if nb else np.zeros(0, np.int64)
    out_of = need > width[:, None]
    n_exc = out_of.sum(axis=1)
    packed = -(-size * width // 8)
    length = HEAD + packed + 5 * n_exc
    start = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    out = np.zeros(int(start[-1]), np.uint8)
    s = start[:-1]
    for k in range(4):
        out[s + k] = (low >> np.uint32(8 * k)) & np.uint32(255)
    out[s + 4], out[s + 5] = width, n_exc
    for w in np.unique(width[width > 0]) if nb else []:
        at_w = np.flatnonzero(width == w)
        v = d[at_w] & np.uint32((1 << int(w)) - 1)
        bits = (v[:, :, None] >> np.arange(int(w), dtype=np.uint32)[None, None, :]) & np.uint32(1)
        body = np.packbits(bits.astype(np.uint8).reshape(len(at_w), -1), axis=1, bitorder="little")
        p = packed[at_w]
        keep = np.arange(body.shape[1])[None, :] < p[:, None]
        where = (s[at_w] + HEAD)[:, None] + np.arange(body.shape[1])[None, :]
        out[where[keep]] = body[keep]
    b, c = np.nonzero(out_of)
    if len(b):
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        tail = s + HEAD + packed
        out[tail[b] + rank] = c
        high = d[b, c] >> width[b].astype(np.uint32)
        place = tail[b] + n_exc[b] + 4 * rank
        for k in range(4):
            out[place + k] = (high >> np.uint32(8 * k)) & np.uint32(255)
    row_at = start[block_at]
    return out, row_at, s - row_at[row], block_at


def decode_block(data: bytes, start: int, n: int) -> np.ndarray:
    """The n ids of the block that begins at start."""
    low, width, exc = int.from_bytes(data[start : start + 4], "little"), data[start + 4], data[start + 5]
    body, packed = start + HEAD, -(-n * width // 8)
    v = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, packed, body), bitorder="little")[: n * width].reshape(n, width).astype(np.uint32)
        v = (bits << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    pos = np.frombuffer(data, np.uint8, exc, body + packed)
    high = np.frombuffer(data, "<u4", exc, body + packed + exc)
    v[pos] |= high << np.uint32(width) if width < 32 else 0
    return v + np.uint32(low)


def decode(data: bytes, n: int, starts: list[int]) -> np.ndarray:
    """All n ids of a row, from its bytes and its index."""
    return np.concatenate([np.zeros(0, np.uint32), *(decode_block(data, s, min(BLOCK, n - i * BLOCK)) for i, s in enumerate(starts))])


_ENCODERS: dict[str, object] = {}


def tokenizer(path: str = VOCABULARY):
    """The byte-level BPE of a vocabulary file of ranks; one a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _blocks(path: str, percentile: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = tokenizer(path)
        for col in batches:
            data, offs = K.text_bytes(col)
            blob = data.tobytes()
            parts, lens = [np.zeros(0, np.uint32)], np.zeros(len(offs) - 1, np.int64)
            for i in range(len(offs) - 1):
                text = blob[offs[i] : offs[i + 1]].decode()
                ids = np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32) if text else parts[0]
                parts.append(ids)
                lens[i] = len(ids)
            at = np.concatenate([[0], np.cumsum(lens)])
            out, row_at, starts, block_at = encode(np.concatenate(parts), at, percentile)
            n = len(lens)
            size = pa.array(row_at, pa.int32())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(lens),
                    pa.Array.from_buffers(pa.binary(), n, [None, size.buffers()[1], pa.py_buffer(out.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(block_at, pa.int32()), pa.array(starts)),
                ],
                ["n_tokens", "data", "block_starts"],
            )

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, n_tokens, data, block_starts) for every row: the tokens of the whole text as blocks.

    Null and empty texts have 0 tokens, empty data and no blocks; a null doc_id stays null; repeated rows
    give equal rows. Very long texts are encoded whole. No rows: no rows. Other columns aren't read.
    decode(data, n_tokens, block_starts) gives the ids back.
    """
    arrow_batches(spark, 500)
    run = _blocks(vocabulary, percentile)

    def blocks(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(it)

    t = F.arrow_udf(blocks, "struct<n_tokens:long,data:binary,block_starts:array<long>>")
    return docs.select("doc_id", t(F.col(text).cast("string")).alias("t")).select("doc_id", "t.*")
