"""Spans as array columns: finding them with their places, windows around them, trims, splices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One span; places count code points, the end is exclusive. ``seq`` is the order of emission, which settles ties.
SPAN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("sub_type", T.StringType()),
        T.StructField("seq", T.IntegerType()),
    ]
)
SPANS = T.ArrayType(SPAN)
NO_SPANS = lambda: F.array().cast(SPANS)
_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct(start, end, text)> of all matches of a pattern, as a scan from the left finds them.

    Matches and the gaps between them come from two passes of the same matcher; a fold over their pairs
    carries the place, so it works in code points. A null text has none.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, rx, 0), F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + F.length(p["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("text"))
        return F.when(p["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    return F.when(text.rlike(pattern) if isinstance(pattern, str) else text.isNotNull(), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_FOUND))


def span(kind: Column | str, text: Column, start: Column, end: Column, confidence: float, source: str, sub_type: str | None = None, seq: Column | None = None) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        text.alias("text"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.lit(float(confidence)).alias("confidence"),
        F.array(F.lit(source)).alias("sources"),
        F.lit(sub_type).cast("string").alias("sub_type"),
        (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
    )


def window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text from ``before`` code points ahead of a span to ``after`` behind it, within the text."""
    begin = F.greatest(start - before, F.lit(0))
    return F.substring(text, begin + 1, end + after - begin)


def rtrimmed(value: Column, chars: str) -> Column:
    return F.rtrim(value, F.lit(chars))


def ltrimmed(value: Column, chars: str) -> Column:
    return F.ltrim(value, F.lit(chars))


def splice(text: Column, spans: Column, replacement) -> Column:
    """The text with disjoint spans, in order of start, replaced; gaps and replacements are joined once."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, replacement(s))).alias("out"))

    return F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
