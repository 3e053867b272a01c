"""Joins and reports that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` of the same ``by`` at or before ``at``; null if there is none.

    Both sides become one table, sorted once by key and time; a running last value does the rest, so no pairs are formed.
    At equal times the right rows come first, and of those the greatest values count. Null keys and times meet nothing.
    """
    taken = F.struct(*values)
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(taken.alias("v")).schema["v"].dataType)})  # noqa: E741
    r = right.select(*by, at, taken.alias("_v")).withColumn("_side", F.lit(0)).where(" and ".join(f"{c} is not null" for c in [*by, at]))
    both = l.unionByName(r, allowMissingColumns=True)
    running = Window.partitionBy(*by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    meets = F.lit(True)
    for c in [*by, at]:
        meets = meets & F.col(c).isNotNull()
    out = both.withColumn("_w", F.when(meets, F.last("_v", ignorenulls=True).over(running))).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_w.{c}").alias(c) for c in values))


def top(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows with the greatest ``by``, ties by all columns; every partition keeps ``n`` rows at most."""
    return df.orderBy(F.desc(by), *[c for c in df.columns if c != by]).limit(n)
