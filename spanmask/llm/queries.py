"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.llm import encode, glyphs, leak, level, names, personal, pieces, places, sentences
from spanmask.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.units(table(spark, sf, "blocks"), "block_key", "raw_text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.alike(table(spark, sf, "blocks"), "block_key", "raw_text")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.classes(table(spark, sf, "blocks"), "block_key", "raw_text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.linked_pairs(names.variants(table(spark, sf, "spans"), "entity_id", "doc_id", "text"), "entity_id")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.pieces(table(spark, sf, "blocks"), "block_key", "raw_text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every oversized block, and whether a cut had to be made in a stretch that no boundary breaks, by the cuts made."""
    forced = F.when(F.bool_or(F.col("cut") == "forced"), "forced").otherwise("natural")
    return p4_pieces(spark, sf).groupBy("block_key").agg(forced.alias("cut_kind"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    records, blocks = table(spark, sf, "synthetic_benchmark"), table(spark, sf, "blocks")
    tagger = personal.fit(records, "id", "text", "entities")
    shape = lambda df, key, origin: df.select(F.lit(origin).alias("origin"), F.col(key).cast("string").alias("rec_id"), "label", "pii_start", "pii_end")
    here = personal.spans(records.where("entities is null"), "id", "text", tagger)
    there = personal.spans(blocks, "block_key", "raw_text", tagger, "doc_id")
    return shape(here, "id", "synthetic_benchmark").unionByName(shape(there, "block_key", "blocks"))


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    records, blocks = table(spark, sf, "synthetic_benchmark"), table(spark, sf, "blocks")
    tagger = personal.fit(records, "id", "text", "entities")
    here = personal.masked(records, "id", "text", tagger).select(F.lit("synthetic_benchmark").alias("origin"), F.col("id").alias("rec_id"), "masked")
    there = personal.masked(blocks, "block_key", "raw_text", tagger, "doc_id").select(F.lit("blocks").alias("origin"), F.col("block_key").cast("string").alias("rec_id"), "masked")
    return here.unionByName(there)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.linked_pairs(places.locations(table(spark, sf, "spans"), "entity_id", "text"), "entity_id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_column(table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "gold_prospectus"), "id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return level.levels(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "reading_labels"), "doc_id", "band")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_masked": p5_masked, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CLOSE = "[\"''”’)\\]»]*"
SQL: dict[str, str] = {
    "p4_found": "SELECT block_key, CASE WHEN list_max(list_transform(string_split_regex(t, '" + _BLANK + "|[。！？｡।॥؟۔]+[\"''”’)\\]」』）】»]*|[.!?…]+" + _CLOSE + _BLANK + "'), lambda x: length(x))) > 1500 THEN 'forced' ELSE 'natural' END AS cut_kind "
    "FROM (SELECT block_key, any_value(raw_text) AS t FROM blocks GROUP BY block_key) WHERE length(t) > 1500",
}
