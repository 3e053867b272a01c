"""The row-local steps on streams: detection and redaction of arriving texts, and counts by type over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.plans.pipeline import detect_pii, redact_text


def redacted_stream(texts: DataFrame, text: str, key: bytes) -> DataFrame:
    """A stream of texts with spans and redacted texts; no state, so any trigger and sink will do."""
    return redact_text(texts, text, key)


def counts_stream(texts: DataFrame, text: str, at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, type, n) of spans by event time; rows later than the watermark are left out, and its state is dropped."""
    found = detect_pii(texts.withWatermark(at, late), text)
    return found.select(F.col(at), F.explode("spans").alias("s")).groupBy(F.window(at, width), F.col("s.type").alias("type")).agg(F.count("*").alias("n"))
