"""Pieces of oversized texts, cut at natural boundaries (problem 4).

Sentence ends and line breaks are the candidate cuts. The words of the blocks of text before and after each
candidate give a similarity; a cut's depth is how far the similarity falls there below the peaks on both sides.
Of the candidates within reach of a piece's size the deepest is cut. Where there are none, the text is cut at
the last blank, and only where a stretch has no boundary at all within reach, at the size limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: Characters of text on either side whose words are compared.
BLOCK = 400
#: A piece is filled at least to this share of the limit where a cut allows it.
FILL = 0.5
_END = re.compile(r"[.!?…]+[\"'”’)\]»]*(?=\s)|[。！？｡।॥؟۔]+[\"'”’)\]」』）】»]*|\n+")
_BLANK = re.compile(r"\s+")
_BOUNDARY = re.compile(f"{_END.pattern}|{_BLANK.pattern}")
_WORD = re.compile(r"\w+")
_JOINING = re.compile(r"[̀-ͯ​-‏⁠︀-️﻿֑-ֽً-ٰٟऀ-ः़ा-ॏัิ-ฺ็-๎]")


def valleys(text: str, cuts: list[int]) -> np.ndarray:
    """The depth of the lexical valley at each cut: peaks of similarity on both sides minus the similarity here."""
    if not cuts:
        return np.zeros(0)
    starts, ids, known = [], [], {}
    for m in _WORD.finditer(text.lower()):
        if len(m[0]) > 3 or not m[0].isascii():
            starts.append(m.start())
            ids.append(known.setdefault(m[0], len(known)))
    counts = np.zeros((len(ids) + 1, max(1, len(known))), np.float32)
    counts[np.arange(1, len(ids) + 1), ids] = 1
    np.cumsum(counts, axis=0, out=counts)
    at = np.array(cuts)
    here = np.searchsorted(starts, at)
    left = counts[here] - counts[np.searchsorted(starts, at - BLOCK)]
    right = counts[np.searchsorted(starts, at + BLOCK)] - counts[here]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    alike = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0)
    depth = np.empty(len(cuts))
    for i in range(len(cuts)):
        j = k = i
        while j and alike[j - 1] >= alike[j]:
            j -= 1
        while k + 1 < len(cuts) and alike[k + 1] >= alike[k]:
            k += 1
        depth[i] = alike[j] + alike[k] - 2 * alike[i]
    return depth


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, cut) of a text longer than ``limit``; a shorter one is one piece.

    Each piece after the first starts ``overlap`` code points before the end of the one before, so a piece is longer than that. ``cut`` is how the
    piece ends: sentence, blank, forced (in a stretch longer than the limit without any boundary), tight (in a shorter stretch that
    the overlap keeps from fitting) or end (of the text).
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    out, start = [], 0
    left = right = 0  # the stretch without a boundary that was cut last
    # A window at a time, so that memory doesn't grow with the text.
    while n - start > limit:
        done, low, high = start + overlap, start + int(limit * FILL), start + limit
        begin = max(0, start - BLOCK)
        window = text[begin : high + BLOCK]
        cuts = [begin + m.end() for m in _END.finditer(window)]
        depth = valleys(window, [c - begin for c in cuts])
        near = [(d, c) for d, c in zip(depth, cuts) if low <= c <= high] or [(d, c) for d, c in zip(depth, cuts) if done < c <= high]
        if near:
            end, kind = max(near)[1], "sentence"
        else:
            blanks = [m.end() for m in _BLANK.finditer(text, done, high) if done < m.end() <= high]
            if blanks:
                end, kind = blanks[-1], "blank"
            else:
                end = high
                left = max([start + m.end() for m in _BOUNDARY.finditer(text[start : done + 1]) if start + m.end() <= done], default=left)
                if right < high:
                    after = _BOUNDARY.search(text, high)
                    right = after.start() if after else n
                kind = "forced" if right - left > limit else "tight"
                while end > done + 1 and _JOINING.match(text[end]):  # a mark stays with its letter
                    end -= 1
        out.append((start, end, kind))
        start = end - overlap
    return [*out, (start, n, "end")]


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, piece_start, piece_end, cut, piece): the pieces of every text longer than ``limit``.

    Null, empty and shorter texts have no rows; repeated rows (same key) count once; texts of any length are cut
    to their end; columns besides the two aren't read. Only oversized texts leave the scan.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b, cut, t[a:b]) for k, t in zip(pdf["_k"], pdf["_t"]) for i, (a, b, cut) in enumerate(split(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["_k", "piece_no", "piece_start", "piece_end", "cut", "piece"])

    big = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") > limit).dropDuplicates(["_k"])
    return big.mapInPandas(run, f"_k {kind}, piece_no int, piece_start int, piece_end int, cut string, piece string").withColumnRenamed("_k", key)
