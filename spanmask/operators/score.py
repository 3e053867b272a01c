"""Confidence by the words around a span, and removal of what is never personal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmask.functions import lexicon as X
from spanmask.functions.spantext import NO_SPANS, SPANS, window

REACH = 80


def not_personal(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*X.NOT_PERSONAL)


def _any(value: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(value).rlike("|".join(parts))


def scored_one(text: Column, s: Column) -> Column:
    """The span with its type and confidence as its neighbourhood has them, or null if it goes."""
    around = window(text, s["start"], s["end"], REACH, REACH)
    value, conf = s["text"], s["confidence"]
    birth, filing = around.rlike(X.BIRTH_CUE), around.rlike(X.FILING_CUE)
    date = F.when(birth & ~filing, F.least(F.lit(1.0), conf + 0.35)).when(filing, F.greatest(F.lit(0.0), conf - 0.60)).otherwise(F.greatest(F.lit(0.0), conf - 0.45))
    firm = _any(value, X.FIRM_PARTS)
    kind = F.when((s["type"] == "PERSON") & firm, F.lit("ORGANIZATION")).otherwise(s["type"])
    cue, body = around.rlike(X.PERSON_CUE), around.rlike(X.BODY_CUE)
    person = F.when(cue, F.least(F.lit(1.0), conf + 0.20)).when(body, F.greatest(F.lit(0.0), conf - 0.25)).otherwise(conf)
    org = F.when(_any(value, X.SURE_PARTS), F.least(F.lit(1.0), conf + 0.20)).otherwise(conf)
    # A person that becomes an organisation keeps its confidence.
    new = F.round(F.when(s["type"] == "DATE_OF_BIRTH", date).when((s["type"] == "PERSON") & ~firm, person).when(s["type"] == "ORGANIZATION", org).otherwise(conf), 3)
    short = F.length(F.trim(value))
    gone = (
        not_personal(value)
        | (s["type"] == "PERSON") & ~firm & (short < 3)
        | (s["type"] == "ORGANIZATION") & ~_any(value, X.SURE_PARTS) & (short < 4)
        | (kind == "DATE_OF_BIRTH") & (new < 0.50)
        | (kind == "ORGANIZATION") & (new < 0.45)
    )
    return F.when(~F.coalesce(gone, F.lit(False)), s.withField("type", kind).withField("confidence", new))


def scored(text: Column, spans: Column) -> Column:
    """The spans that stay, rescored. A null array gives an empty one; a null confidence stays null."""
    return F.filter(F.transform(F.coalesce(spans, NO_SPANS()), lambda s: scored_one(text, s)), lambda s: s.isNotNull()).cast(SPANS)
