"""Scores of predicted spans against gold ones. Both are rows (doc_id, label, start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmask.functions.lexicon import PRIORITY
from spanmask.operators.normalize import token_count
from spanmask.sources.lineage import cut

CLASSES = tuple(sorted(PRIORITY))
KEY = ("doc_id", "start", "end", "label")


def exploded(df: DataFrame, key: str, entities: str) -> DataFrame:
    """(doc_id, label, start, end) of an array column of entities; null arrays have no rows."""
    return df.select(F.col(key).cast("string").alias("doc_id"), F.explode(entities).alias("_e")).select("doc_id", F.coalesce("_e.label", F.lit("")).alias("label"), F.col("_e.start").alias("start"), F.col("_e.end").alias("end"))


def _counted(df: DataFrame, by: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    keys = [*by, *KEY]
    return df.select(*keys, *more, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))).alias("copy"))


def strict(pred: DataFrame, gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, start, end, label, copy, outcome, near) with outcome tp, fp or fn; each gold span matches one equal prediction.

    ``near`` tells of a prediction whether a gold span of its label overlaps it, used or not. ``by`` are further columns that both
    sides have, such as a configuration. A document's gold spans of one label meet its predictions as one array.
    """
    places = gold.groupBy(*by, "doc_id", "label").agg(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("_g"))
    flagged = pred.select(*by, *KEY).join(places, [*by, "doc_id", "label"], "left")
    p = _counted(flagged.withColumn("near", F.coalesce(F.exists("_g", lambda g: F.greatest("start", g["s"]) < F.least("end", g["e"])), F.lit(False))), by, ("near",))
    on = [*by, *KEY, "copy"]
    both = p.withColumn("_p", F.lit(True)).join(_counted(gold, by).withColumn("_o", F.lit(True)), on, "full")
    outcome = F.when(F.col("_p") & F.col("_o"), "tp").when(F.col("_p"), "fp").otherwise("fn")
    return both.select(*on, outcome.alias("outcome"), F.coalesce("near", F.lit(False)).alias("near"))


def relaxed(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions that no gold span equals but one of their label overlaps, used or not."""
    return strict(pred, gold).where("outcome = 'fp' and near").select(*KEY, "copy")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, near = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "relaxed_tp"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    rp, rr = _ratio(near, near + fp), _ratio(near, near + fn)
    return df.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(_f1(p, r), 4), "relaxed_f1": F.round(_f1(rp, rr), 4), "support": F.col("tp") + F.col("fn")})


def per_class(pred: DataFrame, gold: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """label, tp, fp, fn, relaxed_tp, precision, recall, f1, relaxed_f1, support; one row for each of the classes.

    Relaxed true positives are the strict ones and the overlapping ones; the relaxed rates keep the strict fp and fn.
    With ``groups``, a few rows of further columns that both sides have, there is a row for each class and group.
    """
    by = tuple(groups.columns) if groups is not None else ()
    every = F.explode(F.array(*map(F.lit, CLASSES))).alias("label")
    names = (groups if groups is not None else pred.sparkSession.range(1).drop("id")).select(*by, every)
    kept = lambda df: df.where(F.col("label").isin(*CLASSES))
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    one = F.col("outcome")
    hits = strict(kept(pred), kept(gold), by).groupBy(*by, "label").agg(*(count(one == o, o) for o in ("tp", "fp", "fn")), count((one == "fp") & F.col("near"), "near"))
    full = names.join(hits, [*by, "label"], "left").na.fill(0)
    return _rates(full.select(*by, "label", "tp", "fp", "fn", (F.col("tp") + F.col("near")).alias("relaxed_tp")))


def overall(classes: DataFrame, tokens: DataFrame | Column | int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group ``by``: counts over all classes, micro and macro rates, and accuracy over ``tokens`` tokens.

    Macro rates are means of the rounded class rates over classes with support or false positives.
    """
    used = (F.col("support") > 0) | (F.col("fp") > 0)
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(used, F.col(c))), F.lit(0.0)), 4)
    row = classes.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "relaxed_tp")), *(mean(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "relaxed_f1")))
    row = row.join(F.broadcast(tokens)) if isinstance(tokens, DataFrame) else row.withColumn("tokens", F.lit(tokens))  # one row
    wrong = F.col("tokens") - F.col("tp") - F.col("fp") - F.col("fn")
    rates = _rates(row).drop("support")
    return rates.withColumn("accuracy", F.when(F.col("tokens") > 0, F.round((F.col("tp") + F.greatest(F.lit(0), wrong)) / F.col("tokens"), 4)).otherwise(F.lit(0.0)))


def tokens_of(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(token_count(F.col(text))), F.lit(0)).alias("tokens"))


def shifted(spans: DataFrame, docs: DataFrame, key: str, text: str, gap: int = 100) -> DataFrame:
    """Spans moved so that documents, in order of their key, lie behind one another with a gap.

    Keys are sorted into ranges of about equal size, whatever their beginnings; the running sum goes over lengths within each range,
    and only one number of each range meets in one place.
    """
    sized = docs.select(F.col(key).cast("string").alias("doc_id"), (F.coalesce(F.length(text), F.lit(0)) + gap).alias("n"))
    ranged = cut(sized.repartitionByRange("doc_id").withColumn("_b", F.spark_partition_id()))
    inside = ranged.withColumn("_w", F.coalesce(F.sum("n").over(Window.partitionBy("_b").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # As many rows as there are partitions.
    ranges = ranged.groupBy("_b").agg(F.sum("n").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = inside.join(F.broadcast(ranges), "_b").select("doc_id", (F.col("_w") + F.col("_o")).alias("base"))
    return spans.join(base, "doc_id").withColumns({"start": F.col("start") + F.col("base"), "end": F.col("end") + F.col("base")}).drop("base")


def ablation(pred: DataFrame, gold: DataFrame, configs: tuple[str, ...], tokens: DataFrame | int) -> DataFrame:
    """The overall row of each configuration. ``pred`` has a ``config`` beside (doc_id, label, start, end); gold spans hold for all."""
    names = pred.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, configs))).alias("config"))
    every = gold.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    return overall(per_class(pred, every, names), tokens, ("config",))


def counts_by_type(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.select(F.explode(spans).alias("s")).groupBy("s.type").agg(F.count("*").alias("n"))


def benchmark(records: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per class, overall) of ``found`` (id, spans) against labelled records (id, text, entities)."""
    pred = exploded(found.select("id", F.transform("spans", lambda s: F.struct(s["type"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))).alias("e")), "id", "e")
    classes = per_class(pred, exploded(records, "id", "entities"))
    return classes, overall(classes, tokens_of(records, "text"))
