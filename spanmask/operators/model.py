"""A place for a model: its predictions, cleaned, become spans like any other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmask.functions import lexicon as X
from spanmask.functions.spantext import SPANS, span

SOURCE = "neural_detector"
THRESHOLD = 0.55
RAW = "array<struct<label:string,text:string,start:int,end:int,score:double>>"
#: Loads a model and returns its batch function: texts to lists of {label, text, start, end, score}.
Loader = Callable[[], Callable[[list[str]], list[list[dict]]]]


def predictions(text: Column, load: Loader) -> Column:
    """Raw predictions of a model that each Python worker loads once; an Arrow batch is a model batch.

    Texts under four characters or without a letter aren't given to the model; a batch that fails is tried text by
    text, and a text that fails has no predictions. Texts go in without outer blanks; places count from the whole text.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in batches:
            out: list[list[dict]] = [[] for _ in s]
            some = [(i, t) for i, t in enumerate(s) if t is not None and len(t.strip()) >= 4 and any(c.isalpha() for c in t)]
            if some:
                model = model or load()
                try:
                    got = model([t.strip() for _, t in some])
                except Exception:
                    got = [_alone(model, t.strip()) for _, t in some]
                for (i, t), found in zip(some, got):
                    lead = len(t) - len(t.lstrip())
                    out[i] = [{"label": p["label"], "text": p["text"], "start": p["start"] + lead, "end": p["end"] + lead, "score": float(p["score"])} for p in found]
            yield pd.Series(out)

    return F.pandas_udf(run, RAW)(text)


def _alone(model: Callable[[list[str]], list[list[dict]]], text: str) -> list[dict]:
    try:
        return model([text])[0]
    except Exception:
        return []


def cleaned(raw: Column, threshold: float = THRESHOLD) -> Column:
    """Predictions as spans: known labels, trimmed, without titles, stop terms, stubs and one-word organisations."""
    names = F.create_map(*(F.lit(x) for kv in X.MODEL_LABELS.items() for x in kv))
    sure = F.filter(raw, lambda p: (p["score"] >= threshold) & names[F.lower(p["label"])].isNotNull())

    def one(p: Column) -> Column:
        kind = names[F.lower(p["label"])]
        right = F.rtrim(p["text"], F.lit(" ,;.:\t\n"))
        body = F.ltrim(right, F.lit(" \t\n"))
        bare = F.when(kind == "PERSON", F.regexp_replace(body, f"(?i){X.TITLE}", "")).otherwise(body)
        start = p["start"] + F.length(right) - F.length(bare)
        return span(kind, bare, start, start + F.length(bare), 0.0, SOURCE).withField("confidence", p["score"]).withField("sub_type", F.lower(p["label"]))

    def keep(s: Column) -> Column:
        value, named = F.trim(s["text"]), s["type"].isin("PERSON", "ORGANIZATION")
        lone = (s["type"] == "ORGANIZATION") & ~value.rlike(r"\s") & ~F.lower(value).rlike("limited|ltd|pvt")
        return ~F.lower(value).isin(*X.MODEL_STOP) & ~(named & (F.length(value) < 3)) & ~lone

    return F.filter(F.transform(sure, one).cast(SPANS), keep)


def detect(df: DataFrame, text: str, load: Loader, out: str = "spans") -> DataFrame:
    return df.withColumn(out, cleaned(predictions(F.col(text), load)))
