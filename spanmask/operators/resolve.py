"""Arbitration of competing spans of one text: exact duplicates first, then a sweep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmask.functions.lexicon import PRIORITY
from spanmask.functions.spantext import NO_SPANS, SPANS


def priority(kind: Column) -> Column:
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def _order(*keys: tuple[Column, Column]) -> Column:
    """-1, 0 or 1 by the first pair of keys that differs."""
    out = F.lit(0)
    for a, b in reversed(keys):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def _last(acc: Column) -> Column:
    return F.element_at(acc, -1)


def _with_last(acc: Column, s: Column) -> Column:
    return F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s))


def merged(spans: Column) -> Column:
    """Of spans with equal places one stays: the highest type, then the surest, then the first; sources are united."""

    def compare(a: Column, b: Column) -> Column:
        c = lambda s: -F.coalesce(s["confidence"], F.lit(0.0))
        return _order((a["start"], b["start"]), (a["end"], b["end"]), (-priority(a["type"]), -priority(b["type"])), (c(a), c(b)), (a["seq"], b["seq"]))

    def step(acc: Column, s: Column) -> Column:
        last = _last(acc)
        same = (F.size(acc) > 0) & (last["start"] == s["start"]) & (last["end"] == s["end"])
        both = last.withField("sources", F.array_sort(F.array_union(last["sources"], s["sources"])))
        return F.when(same, _with_last(acc, both)).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans, compare), NO_SPANS(), step)


def resolved(spans: Column) -> Column:
    """Disjoint spans in order of start.

    Accepted spans stay disjoint, so each candidate, by start and falling length, meets the last accepted one only:
    a span around it wins if it is an address or of no lower type; of two that cross, the higher type,
    then the longer, then the earlier. Null or empty arrays give an empty array.
    """

    def compare(a: Column, b: Column) -> Column:
        return _order((a["start"], b["start"]), (b["end"] - b["start"], a["end"] - a["start"]), (a["seq"], b["seq"]))

    def step(acc: Column, s: Column) -> Column:
        last = _last(acc)
        p, q = priority(last["type"]), priority(s["type"])
        long_last, long_new = last["end"] - last["start"], s["end"] - s["start"]
        apart = (F.size(acc) == 0) | (last["end"] <= s["start"])
        inside = last["end"] >= s["end"]
        loses = inside & ((last["type"] == "ADDRESS") | (p >= q)) | ~inside & ((q < p) | (q == p) & (long_new <= long_last))
        return F.when(apart, F.concat(acc, F.array(s))).when(F.coalesce(loses, F.lit(False)), acc).otherwise(_with_last(acc, s))

    ordered = F.array_sort(merged(F.coalesce(spans, NO_SPANS())), compare)
    return F.aggregate(ordered, NO_SPANS(), step).cast(SPANS)
