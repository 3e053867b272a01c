"""Labelled records as JSON lines, and reports as JSON or Markdown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id STRING, text STRING, entities ARRAY<STRUCT<start:INT,end:INT,label:STRING,text:STRING>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One record for each line that isn't blank; lines that are no JSON give a row of nulls, as Spark's reader has it."""
    return spark.read.schema(RECORD).json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def _table(df: DataFrame) -> Iterator[str]:
    """Rows of a result as lines of a Markdown table, partition by partition."""
    yield "| " + " | ".join(df.columns) + " |"
    yield "|" + "---|" * len(df.columns)
    for r in df.toLocalIterator():
        yield "| " + " | ".join("" if v is None else str(v) for v in r) + " |"


def markdown(metrics: DataFrame, title: str) -> str:
    """A result as a headed table, all of its rows."""
    return "\n".join([f"## {title}", "", *_table(metrics)]) + "\n"


def evaluation_report(name: str, overall: DataFrame, classes: DataFrame, ablation: DataFrame | None = None) -> str:
    """The report of a benchmark: rates over all, by class, and of each configuration of the ablation."""
    parts = [f"# Evaluation of {name}\n", markdown(overall, "Overall"), markdown(classes.orderBy("label"), "By class")]
    if ablation is not None:
        parts.append(markdown(ablation, "Ablation"))
    return "\n".join(parts)


def summary(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row: blocks, spans, and a map of spans by type."""
    each = df.select(F.explode(spans).alias("s")).groupBy("s.type").agg(F.count("*").alias("n"))
    by = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("pii_by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_pii_detected"))
    return df.agg(F.count("*").alias("total_blocks_processed")).crossJoin(by)
