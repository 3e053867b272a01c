"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Each piece of the splitting pattern is merged with a segment tree over its byte positions: every node keeps the
leftmost position with the lowest rank of a pair below it, so a merge is a read at the root and point updates of
the live neighbours, each logarithmic in the piece's length. Pieces recur, so merged pieces are remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a Python worker; beyond it, the memory starts anew. Results don't depend on it.
REMEMBERED = 300_000
FAR = 1 << 62


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece; an empty piece has none."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    # A leaf is rank * size + position, so that the least value is the lowest rank and, of equals, the leftmost.
    tree = [FAR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the token that starts at a position
    start = list(range(-1, n))  # of the token that ends before a position: start[p] is the previous token's start

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    while tree[1] < FAR:
        i = tree[1] % size
        j = end[i]
        k = end[i] = end[j]
        put(j, FAR)
        if k < n:
            start[k] = i
            r = get(piece[i : end[k]])
            put(i, FAR if r is None else r * size + i)
        else:
            put(i, FAR)
        if i:
            h = start[i]
            r = get(piece[h:k])
            put(h, FAR if r is None else r * size + h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encoder(ranks: dict[bytes, int]):
    """A function of a text to its ids; null and empty texts have no ids."""
    find = regex.compile(PATTERN).findall
    known: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for piece in find(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "surrogatepass"), ranks)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    return encode


def encode_column(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{NAME}") -> DataFrame:
    """(key, ids): the ids of every row's text, row by row, without a shuffle.

    Null and empty texts give an empty list; repeated rows are kept; other columns aren't read. The vocabulary
    (under 1 MB, a property of the tokenizer) is read on the driver and broadcast once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            texts, ends, flat, done = batch.column(1), [0], [], 0
            for at in range(batch.num_rows):
                flat.append(np.array(encode(texts[at].as_py()), dtype=np.int32))
                ends.append(ends[-1] + len(flat[-1]))
                if ends[-1] > 4_000_000 or at + 1 == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, at + 1 - done), ids], ["_k", "_ids"])
                    ends, flat, done = [0], [], at + 1

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, f"_k {kind}, _ids array<int>").select(F.col("_k").alias(key), F.col("_ids").alias("ids"))
