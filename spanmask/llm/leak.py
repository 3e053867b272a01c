"""Passages of held-out items in a corpus (problem 8), by winnowing.

Words are folded (look-alike characters, case, punctuation at their edges) and hashed; of every ``WINDOW``
consecutive hashes of ``GRAM`` words the leftmost least is kept as a fingerprint with its place, so every shared run of
GRAM + WINDOW - 1 = 12 words shares at least one, at the same place of the run. Fingerprints of both sides are joined, and each
hit is extended word by word to both sides of its places: a pair stays if the run has at least ``RUN`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.glyphs import fold
from spanmask.sources.lineage import cut

RUN, GRAM = 12, 5
WINDOW = RUN - GRAM + 1
#: Items, and characters of their texts, up to which their index goes to every task; beyond it, both sides are shuffled.
INDEX_ITEMS, INDEX_CHARS = 100_000, 30_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: str | None) -> list[str]:
    """Folded words; a piece between blanks that is all punctuation is no word."""
    if not text:
        return []
    out = fold(text).lower().split()
    return [w for w in (x if x.isalnum() else _EDGE.sub("", x) for x in out) if w]


class _Codes(dict):
    """The hash of the word in each piece between blanks, 0 for a piece that holds none; pieces are hashed when first met."""

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        word = piece if piece.isalnum() else _EDGE.sub("", piece)
        code = self[piece] = xxhash.xxh64_intdigest(word) if word else 0
        return code


_CODES = _Codes()


def codes(text: str | None) -> np.ndarray:
    """The hashes of a text's words, as ``words`` has them."""
    if not text:
        return np.zeros(0, np.uint64)
    out = np.array([_CODES[p] for p in fold(text).lower().split()], np.uint64)
    return out[out != 0]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(h) - k + 1
    if n < 1:
        return h[:0]
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the winnowed grams of a text's word hashes; fewer than ``RUN`` words have none."""
    g = grams(h, GRAM)
    if len(g) < WINDOW:
        return g[:0], np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, WINDOW).argmin(axis=1) + np.arange(len(g) - WINDOW + 1)
    at = np.unique(least)
    return g[at], at


def extended(ws: list, i: int, item: list, j: int) -> bool:
    """Whether the run of common words (or hashes) around places i and j has at least RUN words."""
    n, a, b = 0, i, j
    while n < RUN and a < len(ws) and b < len(item) and ws[a] == item[b]:
        n, a, b = n + 1, a + 1, b + 1
    a, b = i - 1, j - 1
    while 0 < n < RUN and a >= 0 and b >= 0 and ws[a] == item[b]:
        n, a, b = n + 1, a - 1, b - 1
    return n >= RUN


class Index:
    """Fingerprints of items, ordered by their hashes."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.keys = [k for k, _ in items]
        self.words = [words(t) for _, t in items]
        coded = [codes(t) for _, t in items]
        self.codes = [c.tolist() for c in coded]
        prints = [fingerprints(c) for c in coded]
        h = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in prints)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.items = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p[0]), i) for i, p in enumerate(prints))])[order]
        self.places = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in prints)])[order]

    def found(self, text: str | None) -> list[object]:
        """The keys of the items of which a run stands in the text; runs found by hashes are compared word by word."""
        coded = codes(text)
        h, at = fingerprints(coded)
        left, right = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hits = np.nonzero(right > left)[0]
        out: set[int] = set()
        if len(hits):
            here, ws = coded.tolist(), None
            for k in hits:
                i = int(at[k])
                for x in range(left[k], right[k]):
                    item, j = int(self.items[x]), int(self.places[x])
                    if item not in out and extended(here, i, self.codes[item], j):
                        ws = ws or words(text)
                        if extended(ws, i, self.words[item], j):
                            out.add(item)
        return [self.keys[i] for i in sorted(out)]


def _by_index(docs: DataFrame, rows: list, kinds: dict[str, str]) -> DataFrame:
    """(_k, _ik) of a few items: their index goes to every task, so no text is moved."""
    index = docs.sparkSession.sparkContext.broadcast(Index([(r["_ik"], r["_it"]) for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(k, ik) for k, t in zip(pdf["_k"], pdf["_t"]) for ik in index.value.found(t)]
            yield pd.DataFrame(pairs, columns=["_k", "_ik"])

    return docs.mapInPandas(run, f"_k {kinds['_k']}, _ik {kinds['_ik']}").distinct()


def _by_join(docs: DataFrame, tests: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(_k, _ik) of many items: fingerprints of both sides are joined, then the hits' texts come together and are extended."""

    def prints(key: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(k, int(h), int(i)) for k, t in zip(pdf[key], pdf["_t"]) for h, i in zip(*(x.tolist() for x in (lambda f: (f[0].view(np.int64), f[1]))(fingerprints(codes(t)))))]
                yield pd.DataFrame(rows, columns=[key, "_h", "_p"])

        return run

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for pdf in batches:
            keep = []
            for t, item, places in zip(pdf["_t"], pdf["_it"], pdf["_at"]):
                if len(known) > 10_000:
                    known.clear()
                ws, iw = (known.get(x) or known.setdefault(x, words(x)) for x in (t, item))
                keep.append(any(extended(ws, p["i"], iw, p["j"]) for p in places))
            yield pdf.loc[keep, ["_k", "_ik"]]

    here = docs.mapInPandas(prints("_k"), f"_k {kinds['_k']}, _h bigint, _p int")
    there = tests.withColumnRenamed("_it", "_t").mapInPandas(prints("_ik"), f"_ik {kinds['_ik']}, _h bigint, _p int").withColumnRenamed("_p", "_q")
    hits = cut(here.join(there, "_h").groupBy("_k", "_ik").agg(F.collect_set(F.struct(F.col("_p").alias("i"), F.col("_q").alias("j"))).alias("_at")))
    # Only texts with a hit are moved.
    some = docs.join(hits.select("_k").distinct(), "_k", "left_semi").dropDuplicates(["_k"])
    return hits.join(some, "_k").join(tests, "_ik").select("_k", "_ik", "_t", "_it", "_at").mapInPandas(verified, f"_k {kinds['_k']}, _ik {kinds['_ik']}")


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_id): every pair of a corpus row and an item with a common run of at least RUN words.

    Null, empty and short texts on either side have no pairs; repeated rows (same key) count once; copies under
    other keys each count; the longest texts are read whole. Columns besides those named aren't read. Items within
    INDEX_ITEMS and INDEX_CHARS are searched by an index in every task, more of them by a join; the result is the same.
    """
    docs = corpus.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    tests = items.select(F.col(item_key).alias("_ik"), F.col(item_text).alias("_it")).where("_it is not null").dropDuplicates(["_ik"])
    kinds = dict(docs.dtypes) | dict(tests.dtypes)
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_it")), F.lit(0)).alias("chars")).first()
    small = size["n"] <= INDEX_ITEMS and size["chars"] <= INDEX_CHARS
    pairs = _by_index(docs, tests.collect(), kinds) if small else _by_join(docs, tests, kinds)
    return pairs.select(F.col("_k").alias(key), F.col("_ik").alias("item_id"))
