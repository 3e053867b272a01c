"""Queries of what reads and writes files, models and streams, over files that they write to the shared folder, and of plain relational operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.functions import lexicon as X
from spanmask.operators import images, model, relational
from spanmask.plans import sql as S
from spanmask.plans.sql import q
from spanmask.sources import docx
from spanmask.sources.lineage import shared_folder
from spanmask.sources.records import read_records
from spanmask.sources.tables import spread, table
from spanmask.streaming.redaction import counts_stream

#: Blocks of a Word file at most; longer filings are several files.
FILE_BLOCKS = 400
NO_XML = "[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _word_files(spark: SparkSession, sf: str) -> str:
    """The folder of Word files of all filings, written block by block with their runs."""
    b = table(spark, sf, "blocks").where("raw_text is not null").select("block_key", "doc_id", "block_ord", "raw_text", "runs").dropDuplicates(["block_key"])
    plain = F.array(F.struct(F.col("raw_text").alias("text"), F.lit(False).alias("is_italic"), F.lit(False).alias("is_bold")))
    flag = lambda r, c: F.coalesce(r[c], F.lit(False)).alias(c)
    runs = F.coalesce(F.transform("runs", lambda r: F.struct(r["text"].alias("text"), flag(r, "is_italic"), flag(r, "is_bold"))), plain)
    parts = b.select("doc_id", F.floor(F.col("block_ord") / FILE_BLOCKS).alias("part"), "block_ord", runs.alias("runs"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_ord")
        return pd.DataFrame({"doc_id": [f"/{pdf['doc_id'].iloc[0]}-{pdf['part'].iloc[0]}.docx"], "content": [docx.made(pdf["runs"])]})

    folder = _folder(spark, "word")
    docx.write_files(parts.groupBy("doc_id", "part").applyInPandas(write, "doc_id string, content binary"), folder, "/")
    return folder


def word_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Of every filing written as Word files and read again: its blocks, runs, bold runs and characters."""
    read = docx.read_blocks(spark, _word_files(spark, sf) + "/*.docx")
    each = read.select(F.regexp_extract("doc_id", r"([^/]*)-\d+\.docx$", 1).alias("filing"), F.size("runs").alias("n"), F.size(F.filter("runs", lambda r: r["is_bold"])).alias("bold"), F.length("raw_text").alias("chars"))
    return each.groupBy("filing").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_runs"), F.sum("bold").alias("n_bold"), F.sum("chars").alias("n_chars"))


def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the records, written as JSON lines and read again."""
    folder = _folder(spark, "records")
    table(spark, sf, "synthetic_benchmark").select("id", "text", "entities").write.json(folder)
    return read_records(spark, folder).select("id", F.explode("entities").alias("e")).select("id", "e.label", "e.start", "e.end", "e.text")


_TERM = re.compile(r"[A-Z][a-z]+ (?:Limited|Committee|Company|Board)|Board|Company|SEBI|[A-Z][a-z]+")


def _load():
    """Stands for a model: calls the first matches of a pattern in each text organisations, every third one weakly."""

    def predict(texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            found = [m for m in _TERM.finditer(t)][:5]
            out.append([{"label": "Company", "text": m[0], "start": m.start(), "end": m.end(), "score": 0.5 if m.start() % 3 == 0 else 0.9} for m in found])
        return out

    return predict


def model_slot(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of a stand-in model's predictions: sure ones that are neither stop terms nor single words."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return model.detect(docs, "text", _load).select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.text").alias("value"), F.col("s.start").alias("span_start"), F.col("s.type").alias("span_type"))


def image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Of every record read as an image of words: the boxes that hold an identifier by themselves."""

    def reader(data: bytes) -> list[dict]:
        return [{"text": w, "x": i, "y": 0, "w": len(w), "h": 1, "confidence": 20.0 if i % 10 == 9 else 90.0} for i, w in enumerate(data.decode().split(" "))]

    r = table(spark, sf, "synthetic_benchmark").where("text is not null").select("id", F.encode("text", "UTF-8").alias("content")).dropDuplicates(["id"])
    found = images.personal_boxes(images.boxes(F.col("content"), reader))
    return r.select("id", F.explode(found).alias("b")).select("id", "b.text", "b.x", "b.w")


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Personal information in arriving documents, by type and hour of filing; a stream that ends with what is there."""
    source, name = _folder(spark, "arriving"), f"counts_{uuid.uuid4().hex}"
    table(spark, sf, "documents").select("filed_at", "text").write.parquet(source)
    stream = spark.readStream.schema("filed_at timestamp, text string").parquet(source)
    query = counts_stream(stream, "text", "filed_at").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("window.start").alias("hour"), "type", "n")


def asof_value(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the value of the user's latest click at or before it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("clicked"), F.col("event_id").alias("click_id"))
    return relational.asof_join(e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["click_id", "clicked"]).select("event_id", "clicked")


def top_filings(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty filings with most spans."""
    n = table(spark, sf, "spans").dropDuplicates(["entity_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return relational.top(n, "n", 20)


def approximate_values(spark: SparkSession, sf: str) -> DataFrame:
    """By type, the number of different values, and whether a sketch of fixed size comes within a tenth of it."""
    s = table(spark, sf, "spans").where("text is not null and type is not null")
    each = s.groupBy("type").agg(F.count_distinct("text").alias("n"), F.approx_count_distinct("text", 0.02).alias("a"))
    return each.select("type", "n", (F.abs(F.col("a") - F.col("n")) <= F.greatest(F.lit(1), 0.1 * F.col("n"))).alias("near"))


def filings_without_names(spark: SparkSession, sf: str) -> DataFrame:
    """Filings that have spans, but none of a person: a difference of sets, distributed by filing."""
    s = table(spark, sf, "spans").where("doc_id is not null")
    return s.select("doc_id").distinct().exceptAll(s.where("upper(type) = 'PERSON'").select("doc_id").distinct())


def shared_senders(spark: SparkSession, sf: str) -> DataFrame:
    """Names that stand both as a person and as an organisation: an intersection of sets."""
    s = table(spark, sf, "spans").where("text is not null")
    return s.where("type = 'PERSON'").select("text").intersect(s.where("type = 'ORGANIZATION'").select("text"))


QUERIES = {f.__name__: f for f in (word_blocks, json_records, model_slot, image_boxes, stream_counts, asof_value, top_filings, approximate_values, filings_without_names, shared_senders)}
_RUNS = "(SELECT block_key, any_value(doc_id) AS doc_id, any_value(raw_text) AS t, any_value(runs) AS runs FROM blocks WHERE raw_text IS NOT NULL GROUP BY block_key)"
#: Outer blanks that a model is not given; texts of fewer than four other characters have no match.
_LEAD = f"(SELECT k, length(t) - length(regexp_replace(t, {q('^' + S.BLANK)}, '')) AS lead FROM {S.DOCS} AS d1)"
_STOP = S.words_in("lower(v)", X.MODEL_STOP)
_WORDS = "(SELECT id, id || '#' || i AS k, ws[i + 1] AS w, i AS x FROM (SELECT id, ws, unnest(range(0, len(ws))) AS i FROM (SELECT DISTINCT id, string_split(text, ' ') AS ws FROM synthetic_benchmark WHERE text IS NOT NULL)))"
SQL: dict[str, str] = {
    "word_blocks": "SELECT doc_id AS filing, count(*) AS n_blocks, sum(coalesce(len(runs), 1))::BIGINT AS n_runs, sum(coalesce(len(list_filter(runs, lambda r: coalesce(r.is_bold, false))), 0))::BIGINT AS n_bold, "
    f"sum(length(regexp_replace(CASE WHEN runs IS NULL THEN t ELSE array_to_string(list_transform(runs, lambda r: r.text), '') END, {q(docx.NO_XML)}, '', 'g')))::BIGINT AS n_chars FROM {_RUNS} AS b GROUP BY doc_id",
    "json_records": 'SELECT id, e.label AS label, e."start" AS "start", e."end" AS "end", e.text AS text FROM (SELECT id, unnest(entities) AS e FROM synthetic_benchmark)',
    "model_slot": f"SELECT doc_id, v AS value, b AS span_start, 'ORGANIZATION' AS span_type FROM (SELECT k AS doc_id, v, b, row_number() OVER (PARTITION BY k ORDER BY b) AS n, b - lead AS inner_ FROM {S.matches(S.DOCS, _TERM.pattern)} AS m JOIN {_LEAD} AS l USING (k)) "
    f"WHERE n <= 5 AND inner_ % 3 <> 0 AND NOT {_STOP} AND (contains(v, ' ') OR regexp_matches(lower(v), 'limited|ltd|pvt')) AND length(v) >= 3",
    "image_boxes": f"SELECT id, w AS text, x::INT AS x, length(w)::INT AS w FROM {_WORDS} AS a WHERE x % 10 <> 9 AND k IN (SELECT k FROM {S.candidates(f'(SELECT k, w AS t FROM {_WORDS} AS b)', ('identifiers',))} AS c)",
    "stream_counts": f"SELECT date_trunc('hour', filed_at) AS hour, type, count(*) AS n FROM (SELECT k, type FROM {S.resolved('(SELECT * FROM ' + S.scored(S.candidates(S.DOCS), S.DOCS) + ' AS c0)')} AS z) AS f JOIN documents ON doc_id = k WHERE filed_at IS NOT NULL GROUP BY 1, 2",
    "asof_value": "SELECT p.event_id, c.clicked FROM (SELECT * FROM events WHERE event_type <> 'click') AS p ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS clicked FROM events WHERE event_type = 'click' GROUP BY user_id, ts) AS c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "top_filings": "SELECT doc_id, count(DISTINCT entity_id) AS n FROM spans GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20",
    "approximate_values": "SELECT type, count(DISTINCT text) AS n, true AS near FROM spans WHERE text IS NOT NULL AND type IS NOT NULL GROUP BY type",
    "filings_without_names": "SELECT DISTINCT doc_id FROM spans WHERE doc_id IS NOT NULL EXCEPT SELECT doc_id FROM spans WHERE upper(type) = 'PERSON'",
    "shared_senders": "SELECT text FROM spans WHERE type = 'PERSON' AND text IS NOT NULL INTERSECT SELECT text FROM spans WHERE type = 'ORGANIZATION'",
}
