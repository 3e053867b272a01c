"""Whole runs: detection in a text column, redaction, and redaction of documents with their known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.functions.spantext import NO_SPANS, SPANS, splice
from spanmask.operators import images, pseudonym, registry, rules
from spanmask.operators.address import address
from spanmask.operators.detect import identifiers, numbered
from spanmask.operators.normalize import raw_place, with_normal_form
from spanmask.operators.resolve import resolved
from spanmask.operators.score import scored
from spanmask.sources import docx
from spanmask.sources.lineage import cut


def candidates(text: Column, with_rules: bool = True) -> Column:
    """All detectors' spans. Texts under four characters or without a letter have no addresses and names."""
    worded = (F.length(F.trim(text)) >= 4) & text.rlike("[a-zA-Z]")
    parts = [identifiers(text), F.when(worded, address(text)).otherwise(NO_SPANS())]
    if with_rules:
        parts += [F.when(worded, f(text)).otherwise(NO_SPANS()) for f in (rules.organisation, rules.person, rules.birth_date)]
    return numbered(F.concat(*(F.coalesce(p, NO_SPANS()) for p in parts))).cast(SPANS)


def detect_pii(df: DataFrame, text: str, out: str = "spans", with_rules: bool = True) -> DataFrame:
    """``df`` with the disjoint, scored spans of a text column, row by row and without a shuffle.

    A null or empty text has an empty array. Steps are columns of their own, so that no expression is worked out twice.
    """
    raw = df.withColumn("_c", candidates(F.col(text), with_rules))
    return raw.withColumn("_s", scored(F.col(text), F.col("_c"))).withColumn(out, resolved(F.col("_s"))).drop("_c", "_s")


def redact_text(df: DataFrame, text: str, key: bytes, out: str = "redacted", with_rules: bool = True) -> DataFrame:
    """``df`` with spans, their replacements and the text with each span replaced by its keyed draw, distinct within the text.

    The interface for single texts: every text is a scope of its own. Null texts stay null.
    """
    found = pseudonym.distinct_in_text(detect_pii(df, text, "spans", with_rules), "spans", key, "replacements")
    return found.withColumn(out, pseudonym.masked(F.col(text), F.col("replacements")))


def carried(first: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, spans): ``first`` (key, doc_id, block_ord, spans of scored candidates) with the document's known names, scored, and all arbitrated.

    Only what the names add is scored here; the others were scored when they were found.
    """
    named = first.select("doc_id", F.col("block_ord").cast("long").alias("_o"), F.posexplode("spans").alias("_i", "s")).select("doc_id", F.struct("_o", "_i").alias("ord"), "s.type", "s.text", "s.confidence").where("doc_id is not null")
    alias = registry.aliases(registry.seeds(named))
    both = registry.propagated(texts, alias, key, existing=first.select(key, "spans"), rescore=True)
    return both.select(key, resolved(F.col("spans")).alias("spans"))


def detect_documents(blocks: DataFrame, key: str = "block_key", with_rules: bool = True, model_spans: str | None = None) -> DataFrame:
    """Blocks (key, doc_id, block_ord, raw_text, ...) with norm_text, norm_to_orig and spans in normal text, names of a document carried to all its blocks.

    The names need one shuffle by document; detection and arbitration stay in the row. ``key`` must be unique and not null.
    What is cut are keys and spans, a fraction of the texts, which are normalised again where they are needed.
    """
    normal = with_normal_form(blocks).drop("orig_to_norm")
    found = normal.withColumn("_c", candidates(F.col("norm_text"), with_rules))
    if model_spans:
        found = found.withColumn("_c", numbered(F.concat(F.col("_c"), F.coalesce(F.col(model_spans), NO_SPANS()))))
    # Detection is dear and read by several branches.
    first = cut(found.withColumn("spans", scored(F.col("norm_text"), F.col("_c"))).select(key, "doc_id", "block_ord", "spans"))
    return normal.join(cut(carried(first, normal.select(key, "doc_id", "norm_text"), key)), key)


def _replaced(found: DataFrame, key: bytes) -> DataFrame:
    """``found`` with ``_p``: its spans in raw places with their tokens, cut for several readers; only keys and spans are kept."""
    place = lambda s: raw_place(F.col("norm_to_orig"), F.length("norm_text"), F.length("raw_text"), s["start"], s["end"])
    each = F.transform("spans", lambda s: F.struct(place(s).alias("p"), s["type"].alias("type"), s["text"].alias("text")))
    return cut(found.select("doc_id", "block_id", each.alias("_p")))


def replacements(found: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, block_id, start, end, pseudonym, token, type): every span in raw places, with a replacement that is distinct in its document."""
    each = _replaced(found, key).select("doc_id", "block_id", F.explode("_p").alias("_s")).select("doc_id", "block_id", "_s.p", "_s.type", "_s.text")
    known = pseudonym.pseudonyms(each.select(F.col("doc_id").alias("scope_id"), "type", "text"), key).select(F.col("scope_id").alias("doc_id"), "token", "pseudonym")
    tokened = each.withColumn("token", pseudonym.token(F.col("type"), F.col("text"), key))
    return tokened.join(known, ["doc_id", "token"]).select("doc_id", "block_id", "p.start", "p.end", "pseudonym", "token", "type")


def redact_documents(found: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, block_id, redacted): raw texts with their spans replaced, equal values alike over a whole document."""
    changes = replacements(found, key).groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pseudonym"))).alias("_c"))
    joined = found.select("doc_id", "block_id", "raw_text").join(changes, ["doc_id", "block_id"], "left")
    new = splice(F.col("raw_text"), F.col("_c"), lambda c: c["pseudonym"])
    return joined.select("doc_id", "block_id", F.when(F.col("_c").isNull(), F.col("raw_text")).otherwise(new).alias("redacted"))


def text_results(df: DataFrame, text: str, key: bytes, with_rules: bool = True) -> DataFrame:
    """(original_text, redacted_text, total_entities, entities) of each text that isn't empty, as the text interface answers."""
    found = redact_text(df.where(F.length(text) > 0), text, key, "_r", with_rules)
    each = lambda s, r: F.struct(s["text"].alias("original"), s["type"].alias("type"), s["confidence"].alias("confidence"), r["pseudonym"].alias("pseudonym"))
    return found.select(F.col(text).alias("original_text"), F.col("_r").alias("redacted_text"), F.size("spans").alias("total_entities"), F.zip_with("spans", "replacements", each).alias("entities"))


def process_files(spark: SparkSession, path: str, folder: str, key: bytes, reader=None) -> DataFrame:
    """Word files of a path, redacted into a folder that all executors share; one row for each: blocks, spans, spans by type, and the spans.

    ``reader`` is an optical reader for embedded images; without one, images are kept.
    """
    blocks = docx.read_blocks(spark, path).withColumn("block_key", F.xxhash64("doc_id", "block_id"))
    found = detect_documents(blocks)
    pictures = images.scan(docx.read_images(spark, path), reader) if reader else None
    spans = cut(found.select("doc_id", "block_id", "block_ord", "spans"))
    docx.write_files(docx.rewrite(spark, path, replacements(found, key), pictures), folder, path)
    each = spans.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id", "s.type").agg(F.count("*").alias("n"))
    by = each.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("pii_by_type"), F.sum("n").alias("total_pii_detected"))
    entity = lambda s: F.struct(F.col("block_ord"), F.col("block_id"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"), s["confidence"].alias("confidence"))
    listed = spans.groupBy("doc_id").agg(F.count("*").alias("total_blocks_processed"), F.array_sort(F.flatten(F.collect_list(F.transform("spans", entity)))).alias("entities"))
    return listed.join(by, "doc_id", "left").na.fill({"total_pii_detected": 0})
