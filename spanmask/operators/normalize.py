"""Normal form of a text and the way back to its raw places."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that go, and those that become a plain one.
GONE = "\u200b\u200c\u200d\ufeff\u00ad"
PLAIN_FROM = "\u00a0\u202f\u2009\u2003\u2002\u2013\u2014\u2019\u2018\u201c\u201d"
PLAIN_TO = "     --''\"\""
SHAPE = "struct<norm_text:string,norm_to_orig:array<int>,orig_to_norm:array<int>>"


def normal_form(text: str) -> tuple[str, list[int], list[int]]:
    """(text, place in raw of each normal character, place in normal of each raw one).

    Characters are normalised one by one, so nothing composes across two. A raw character that goes has the place of
    the last one that stayed.
    """
    plain = dict(zip(PLAIN_FROM, PLAIN_TO))
    out, back, forth, last = [], [], [], 0
    for i, c in enumerate(text):
        piece = "" if c in GONE else unicodedata.normalize("NFKC", plain.get(c, c))
        if piece:
            last = len(back)
            out.append(piece)
            back.extend([i] * len(piece))
        forth.append(last)
    return "".join(out), back, forth


def normalized(text: Column) -> Column:
    """struct(norm_text, norm_to_orig, orig_to_norm); null stays null, an empty text gives empty parts.

    ASCII texts are their own normal form and never leave the JVM.
    """

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else normal_form(t) for t in s]
        return pd.DataFrame(rows, columns=["norm_text", "norm_to_orig", "orig_to_norm"])

    odd = text.rlike(r"[^\x00-\x7F]")
    same = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    ascii_form = F.struct(text.alias("norm_text"), same.alias("norm_to_orig"), same.alias("orig_to_norm"))
    return F.when(odd, F.pandas_udf(run, SHAPE)(F.when(odd, text))).when(text.isNotNull(), ascii_form)


def raw_place(norm_to_orig: Column, norm_length: Column, raw_length: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in raw text of a span in normal text; places beyond the text are drawn in, an empty span stays empty."""
    a = F.greatest(F.lit(0), F.least(start, norm_length))
    b = F.greatest(a, F.least(end, norm_length))
    at = lambda i: F.try_element_at(norm_to_orig, i + 1)
    begin = F.when(norm_length == 0, F.lit(0)).when((a == b) & (a >= norm_length), raw_length).otherwise(at(a))
    stop = F.when(norm_length == 0, F.lit(0)).when(a == b, begin).otherwise(at(b - 1) + 1)
    return F.struct(F.least(begin, stop).cast("int").alias("start"), F.greatest(begin, stop).cast("int").alias("end"))


def run_slices(runs: Column, start: Column, end: Column) -> Column:
    """array<struct(run_index, slice_start, slice_end)> of the runs that a raw span covers, places within each run."""
    hit = F.filter(runs, lambda r: (F.greatest(r["raw_start"], start) < F.least(r["raw_end"], end)))
    return F.transform(hit, lambda r: F.struct(r["run_index"].alias("run_index"), (F.greatest(r["raw_start"], start) - r["raw_start"]).alias("slice_start"), (F.least(r["raw_end"], end) - r["raw_start"]).alias("slice_end")))


def token_count(text: Column) -> Column:
    """Pieces between blanks of any kind; null and blank texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")), F.lit(0))


def with_normal_form(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``df`` with norm_text, norm_to_orig and orig_to_norm, replacing columns of these names."""
    return df.withColumn("_n", normalized(F.col(text))).withColumns({c: F.col(f"_n.{c}") for c in ("norm_text", "norm_to_orig", "orig_to_norm")}).drop("_n")
