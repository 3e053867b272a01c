"""Queries of the engine's operators over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.functions import checks
from spanmask.functions import lexicon as X
from spanmask.functions.spantext import SPANS, span
from spanmask.operators import address as address_op
from spanmask.operators import detect, evaluate, normalize, pseudonym, registry, resolve, rules, score
from spanmask.plans import pipeline
from spanmask.plans import sql as S
from spanmask.plans.sql import q
from spanmask.sources.tables import spread, table

#: A fixed key, so that results can be compared; a deployment derives its own.
MASTER, SALT = bytes(range(32)), bytes(range(16))
TOKEN_KEY, VAULT_KEY = pseudonym.derive(MASTER, SALT)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("t")))


def _blocks(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Distinct blocks with their normal text, formed here from the raw text where no cleaner gave one."""
    one = table(spark, sf, "blocks").select("block_key", *more, "norm_text", "raw_text").where("norm_text is not null or raw_text is not null").dropDuplicates(["block_key"])
    made = normalize.normalized(F.when(F.col("norm_text").isNull(), F.col("raw_text")))
    return one.select("block_key", *more, F.coalesce("norm_text", made["norm_text"]).alias("t"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spans").dropDuplicates(["entity_id"])


def _found(df: DataFrame, key: str, spans: Column) -> DataFrame:
    return df.select(key, F.explode(spans).alias("s")).select(key, F.col("s.text").alias("value"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.type").alias("span_type"))


def _detector(name: str, source, key: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _found(source(spark, sf), key, detect.DETECTORS[name](F.col("t")))

    return query


_IN_DOCUMENTS, _IN_BLOCKS = ("email", "ipv4", "credit_card", "phone"), ("ipv6", "ssn", "pan", "din")
QUERIES: dict = {f"detect_{n}": _detector(n, _documents, "doc_id") for n in _IN_DOCUMENTS} | {f"detect_{n}": _detector(n, _blocks, "block_key") for n in _IN_BLOCKS}
SQL: dict[str, str] = {f"detect_{n}": S.found(S.DETECTORS[n](S.DOCS), "doc_id") for n in _IN_DOCUMENTS} | {f"detect_{n}": S.found(S.DETECTORS[n](S.BLOCKS), "block_key") for n in _IN_BLOCKS}


# ---- Normal form and runs --------------------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    """Normal form of every block that has a text."""
    b = table(spark, sf, "blocks").where("raw_text is not null").select("block_key", "raw_text").dropDuplicates(["block_key"])
    return normalize.with_normal_form(b).select("block_key", "norm_text", F.array_join("norm_to_orig", ",").alias("places"))


def spans_to_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Every span in the raw places of its text."""
    b = table(spark, sf, "blocks").where("raw_text is not null").select("block_key", "norm_text", "raw_text", "norm_to_orig").dropDuplicates(["block_key"])
    made = normalize.normalized(F.when(F.col("norm_text").isNull(), F.col("raw_text")))
    b = b.select("block_key", "raw_text", F.coalesce("norm_text", made["norm_text"]).alias("norm_text"), F.coalesce("norm_to_orig", made["norm_to_orig"]).alias("norm_to_orig"))
    s = _spans(spark, sf).select("entity_id", "block_key", "start", "end")
    place = normalize.raw_place(F.col("norm_to_orig"), F.length("norm_text"), F.length("raw_text"), F.col("start"), F.col("end"))
    return s.join(b, "block_key").select("entity_id", place.alias("p"), "raw_text").select("entity_id", F.col("p.start").alias("raw_start"), F.col("p.end").alias("raw_end"), F.expr("substring(raw_text, p.start + 1, p.end - p.start)").alias("raw_value"))


def spanned_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs that every span covers, with the covered slice of each; an interval join within the row."""
    b = table(spark, sf, "blocks").where("runs is not null").select("block_key", "runs").dropDuplicates(["block_key"])
    s = _spans(spark, sf).select("entity_id", "block_key", "start", "end")
    sliced = s.join(b, "block_key").select("entity_id", F.explode(normalize.run_slices(F.col("runs"), F.col("start"), F.col("end"))).alias("r"))
    return sliced.select("entity_id", "r.run_index", "r.slice_start", "r.slice_end")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", normalize.token_count(F.col("t")).alias("tokens"))


def text_by_block_type(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks and code points by type and filing year, with subtotals."""
    b = table(spark, sf, "blocks").select("block_key", "block_type", F.substring("doc_id", 6, 4).alias("year"), F.coalesce(F.length("raw_text"), F.lit(0)).alias("n")).dropDuplicates(["block_key"])
    return b.rollup("block_type", "year").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_chars"))


B_SQL = "(SELECT block_key, any_value(norm_text) AS norm_text, any_value(raw_text) AS raw_text, any_value(norm_to_orig) AS n2o, any_value(runs) AS runs FROM blocks GROUP BY block_key)"
SQL |= {
    "normalize_text": f"SELECT block_key, norm_text, places FROM {S.NORMAL} AS n",
    "spans_to_raw": f"SELECT entity_id, a::INT AS raw_start, z::INT AS raw_end, raw_text[a + 1:z] AS raw_value FROM (SELECT entity_id, raw_text, coalesce(n2o[s + 1], p[s + 1]::INT) AS a, coalesce(n2o[e], p[e]::INT) + 1 AS z FROM {S.ENTITIES} AS x JOIN {B_SQL} AS b USING (block_key) LEFT JOIN (SELECT block_key, string_split(places, ',') AS p FROM {S.NORMAL_OF_OTHERS} AS n0) AS n USING (block_key) WHERE raw_text IS NOT NULL)",
    "spanned_runs": f"SELECT entity_id, r.run_index AS run_index, greatest(r.raw_start, s) - r.raw_start AS slice_start, least(r.raw_end, e) - r.raw_start AS slice_end FROM (SELECT entity_id, s, e, unnest(runs) AS r FROM {S.ENTITIES} AS x JOIN {B_SQL} AS b USING (block_key)) WHERE greatest(r.raw_start, s) < least(r.raw_end, e)",
    "token_counts": f"SELECT doc_id, coalesce(len(list_filter(string_split_regex(text, {q(S.BLANK)}), lambda x: x <> '')), 0)::INT AS tokens FROM documents",
    "text_by_block_type": "SELECT block_type, year, count(*) AS n_blocks, sum(n)::BIGINT AS n_chars FROM (SELECT block_key, any_value(block_type) AS block_type, any_value(doc_id[6:9]) AS year, any_value(coalesce(length(raw_text), 0)) AS n FROM blocks GROUP BY block_key) GROUP BY ROLLUP (block_type, year)",
}
QUERIES |= {f.__name__: f for f in (normalize_text, spans_to_raw, spanned_runs, token_counts, text_by_block_type)}


# ---- Validators ------------------------------------------------------------------------------------------------


def validate_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every validator on every span's text."""
    v = F.col("text")
    return _spans(spark, sf).where("text is not null").select("entity_id", *(F.coalesce(f(v), F.lit(False)).alias(n) for n, f in (("is_email", checks.email_address), ("is_ssn", checks.us_ssn), ("is_pan", checks.indian_pan), ("is_ip", checks.ip_address), ("is_card", checks.luhn))))


def birth_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The date that a span of a birth date writes, in whichever of the formats."""
    some = _spans(spark, sf).where("upper(type) = 'DATE_OF_BIRTH' and text is not null")
    return some.select("entity_id", F.date_format(checks.birth_date(F.col("text"), F.lit("2026-01-01").cast("date")), "yyyy-MM-dd").alias("born"))


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the blocks that are a term which is never personal, and how often each occurs."""
    words = _blocks(spark, sf).select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z]+"), 0)).alias("word"))
    return words.where(score.not_personal(F.col("word"))).groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n"))


SQL |= {
    "validate_values": "SELECT entity_id, regexp_matches(lower(trim(v)), '^[a-z0-9_.+-]+@[a-z0-9-]+\\.[a-z0-9-.]+$') AND NOT contains(v, '..') AND NOT ends_with(trim(v), '.') AND length(regexp_extract(trim(v), '[^.]*$')) >= 2 AS is_email, "
    "regexp_matches(regexp_replace(v, '\\s+', '', 'g'), '^\\d{3}-\\d{2}-\\d{4}$') AND NOT regexp_matches(regexp_replace(v, '\\s+', '', 'g'), '^(000|666|9)|-00-|-0000$') AS is_ssn, "
    "regexp_matches(upper(trim(v)), '^[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]$') AS is_pan, "
    f"(regexp_matches(v, '^(?:{X.OCTET}\\.){{3}}{X.OCTET}$') AND NOT regexp_matches(v, '(?:^|\\.)0\\d')) OR regexp_matches(v, '^(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}$') AS is_ip, "
    f"CASE WHEN regexp_matches(regexp_replace(v, '[\\s-]', '', 'g'), '^\\d{{13,19}}$') THEN {S.LUHN_OK} ELSE false END AS is_card "
    f"FROM (SELECT entity_id, text AS v FROM {S.ENTITIES} AS x WHERE text IS NOT NULL)",
    "birth_dates": f"SELECT entity_id, strftime({S.BORN}, '%Y-%m-%d') AS born FROM {S.ENTITIES} AS x WHERE upper(type) = 'DATE_OF_BIRTH' AND text IS NOT NULL",
    "exclusions": f"SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(t, '[A-Za-z]+'))) AS term FROM {S.BLOCKS} AS b) WHERE {S.words_in('term', X.NOT_PERSONAL)} GROUP BY 1",
}
QUERIES |= {f.__name__: f for f in (validate_values, birth_dates, exclusions)}


# ---- Scores, arbitration, known names --------------------------------------------------------------------------


def _span_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with their detector spans as arrays. A block's spans are bounded by its length."""
    kind = F.coalesce(F.upper("type"), F.lit(""))
    one = F.struct(F.col("entity_id").alias("o"), F.struct(kind.alias("type"), "text", "start", "end", "confidence", F.col("detector_sources").alias("sources"), F.lit(None).cast("string").alias("sub_type"), F.lit(0).alias("seq")).alias("s"))
    grouped = _spans(spark, sf).groupBy("block_key").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return grouped.select("block_key", detect.numbered(F.transform("a", lambda x: x["s"])).cast(SPANS).alias("spans"))


def score_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans after scoring: type and confidence of those that stay."""
    s = _spans(spark, sf).select("entity_id", "block_key", span(F.col("type"), F.col("text"), F.col("start"), F.col("end"), 0.0, "table").withField("confidence", F.col("confidence")).alias("s"))
    kept = s.join(_blocks(spark, sf), "block_key").select("entity_id", score.scored_one(F.col("t"), F.col("s")).alias("s")).where("s is not null")
    return kept.select("entity_id", F.col("s.type").alias("new_type"), F.col("s.confidence").alias("new_confidence"))


def resolve_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint spans of every block that has any."""
    out = _span_arrays(spark, sf).select("block_key", F.explode(resolve.resolved(F.col("spans"))).alias("s"))
    return out.select("block_key", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.type").alias("span_type"))


def merge_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """One span for each place of a block, sources united."""
    out = _span_arrays(spark, sf).select("block_key", F.explode(resolve.merged(F.col("spans"))).alias("s"))
    return out.select("block_key", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.type").alias("span_type"), F.array_join(F.array_sort("s.sources"), ",").alias("sources"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select("doc_id", F.upper("type").alias("type"), "text", "confidence", F.col("entity_id").alias("ord"))


def registry_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return registry.seeds(_named(spark, sf)).select("doc_id", "canonical", "type")


def registry_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return registry.aliases(registry.seeds(_named(spark, sf))).select("doc_id", "alias_lc", "canonical", "type")


def _propagated(spark: SparkSession, sf: str, rescore: bool = False) -> DataFrame:
    texts = _blocks(spark, sf, "doc_id").withColumnRenamed("t", "norm_text")
    out = registry.propagated(texts.join(_span_arrays(spark, sf), "block_key", "left"), registry.aliases(registry.seeds(_named(spark, sf))), rescore=rescore)
    return out.withColumn("spans", F.filter("spans", registry.is_carried))


def registry_propagate(spark: SparkSession, sf: str) -> DataFrame:
    """Known names of every filing where they stand in its blocks and no span lies yet."""
    new = _propagated(spark, sf).select("block_key", F.explode("spans").alias("s"))
    return new.select("block_key", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.type").alias("span_type"), F.col("s.sub_type").alias("canonical"))


def registry_rescore(spark: SparkSession, sf: str) -> DataFrame:
    """Those of them that stay by the words around them, with their confidence."""
    new = _propagated(spark, sf, rescore=True).select("block_key", F.explode("spans").alias("s"))
    return new.select("block_key", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.type").alias("span_type"), F.col("s.confidence").alias("confidence"))


_BY_BLOCK = f"(SELECT entity_id, block_key AS k, type, text, s, e, confidence, sources FROM {S.ENTITIES} AS x)"
_UPPER = f"(SELECT entity_id AS seq, block_key AS k, coalesce(upper(type), '') AS type, text, s, e, confidence, sources FROM {S.ENTITIES} AS x)"
_NAMED = f"(SELECT doc_id, upper(type) AS type, text, confidence, entity_id AS ord FROM {S.ENTITIES} AS x)"
_BLOCK_DOCS = f"(SELECT k, doc_id, t FROM {S.BLOCKS} AS b JOIN (SELECT DISTINCT block_key AS k, doc_id FROM blocks) AS d USING (k))"
PROPAGATED = S.propagated(_BLOCK_DOCS, _UPPER, S.aliases(S.seeds(_NAMED)))
SQL |= {
    "score_spans": f"SELECT entity_id, type AS new_type, confidence AS new_confidence FROM {S.scored(_BY_BLOCK, S.BLOCKS)} AS z",
    "merge_duplicates": f"SELECT m.k AS block_key, m.s AS span_start, m.e AS span_end, m.type AS span_type, array_to_string(u.sources, ',') AS sources FROM {S.merged(_UPPER)} AS m JOIN (SELECT k, s, e, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM {_UPPER} AS v GROUP BY k, s, e) AS u USING (k, s, e)",
    "resolve_conflicts": f"SELECT k AS block_key, s AS span_start, e AS span_end, type AS span_type FROM {S.resolved(_UPPER)} AS z",
    "registry_seeds": f"SELECT doc_id, canonical, type FROM {S.seeds(_NAMED)} AS s",
    "registry_aliases": S.aliases(S.seeds(_NAMED)),
    "registry_propagate": f"SELECT k AS block_key, s AS span_start, e AS span_end, type AS span_type, canonical FROM {PROPAGATED} AS p",
    "registry_rescore": f"SELECT k AS block_key, s AS span_start, e AS span_end, type AS span_type, confidence FROM {S.scored(f'(SELECT *, 0.9::DOUBLE AS confidence FROM {PROPAGATED} AS p0)', S.BLOCKS)} AS z",
}
QUERIES |= {f.__name__: f for f in (score_spans, merge_duplicates, resolve_conflicts, registry_seeds, registry_aliases, registry_propagate, registry_rescore)}


# ---- Addresses, rules, whole runs ------------------------------------------------------------------------------


def detect_address(spark: SparkSession, sf: str) -> DataFrame:
    return _found(_blocks(spark, sf), "block_key", address_op.address(F.col("t")))


def detect_names(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations and persons by rule."""
    return _found(_blocks(spark, sf), "block_key", F.concat(rules.organisation(F.col("t")), rules.person(F.col("t"))))


def detect_birth_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates by a birth cue: found by rule, kept by score."""
    found = _blocks(spark, sf).withColumn("s", rules.birth_date(F.col("t")))
    return _found(found, "block_key", score.scored(F.col("t"), F.col("s")))


def detect_pii(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors, scored and arbitrated, on every document."""
    return _found(pipeline.detect_pii(_documents(spark, sf), "t"), "doc_id", F.col("spans"))


def pii_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of all detectors by type and language, with subtotals."""
    docs = spread(table(spark, sf, "documents").select("lang", "text")).select("lang", F.explode(detect.identifiers(F.col("text"))).alias("s"))
    return docs.select("lang", F.col("s.type").alias("span_type")).rollup("span_type", "lang").agg(F.count("*").alias("n"))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its personal information and names replaced by keyed draws, distinct within the document."""
    out = pipeline.redact_text(_documents(spark, sf), "t", TOKEN_KEY)
    return out.select("doc_id", F.size("spans").alias("n_spans"), "redacted")


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "blocks").select("block_key", "doc_id", "block_id", "block_ord", "raw_text").where("raw_text is not null").dropDuplicates(["block_key"])


def detect_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Every filing's spans in normal text: detected and scored, known names carried over the filing and scored, arbitrated."""
    return _found(pipeline.detect_documents(_filings(spark, sf)), "block_key", F.col("spans"))


def redact_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Every filing's blocks, names carried over each filing, replacements distinct within it."""
    return pipeline.redact_documents(pipeline.detect_documents(_filings(spark, sf)), TOKEN_KEY)


def _detected(source: str) -> str:
    return S.resolved(f"(SELECT * FROM {S.scored(S.candidates(source), source)} AS c0)")


NORMAL_BLOCKS = f"(SELECT k, doc_id, ord, n.norm_text AS t FROM (SELECT block_key AS k, any_value(doc_id) AS doc_id, any_value(block_ord) AS ord FROM blocks WHERE raw_text IS NOT NULL GROUP BY block_key) AS b JOIN {S.NORMAL} AS n ON n.block_key = b.k)"
_IN_FILINGS = (
    f"WITH texts AS MATERIALIZED (SELECT * FROM {NORMAL_BLOCKS} AS t0), first AS MATERIALIZED (SELECT * FROM {S.scored(S.candidates('(SELECT k, t FROM texts)'), '(SELECT k, t FROM texts)')} AS f0), "
    f"named AS MATERIALIZED (SELECT doc_id, type, text, confidence, struct_pack(o := texts.ord, i := seq) AS ord FROM first JOIN texts USING (k) WHERE doc_id IS NOT NULL), "
    f"carried AS MATERIALIZED (SELECT * FROM {S.propagated('texts', 'first', S.aliases(S.seeds('named')))} AS c0), "
    f"every AS MATERIALIZED (SELECT k, type, text, s, e, confidence, seq FROM first UNION ALL SELECT k, type, text, s, e, confidence, 1000000 + s AS seq FROM {S.scored('(SELECT k, type, text, s, e, 0.9::DOUBLE AS confidence FROM carried)', '(SELECT k, t FROM texts)')} AS s0) "
)
SQL |= {
    "detect_address": S.found(S.address(S.BLOCKS), "block_key"),
    "detect_names": S.found(S.organisation(S.BLOCKS) + " UNION ALL " + S.person(S.BLOCKS), "block_key"),
    "detect_birth_dates": S.found(f"SELECT * FROM {S.scored('(' + S.birth_date(S.BLOCKS) + ')', S.BLOCKS)} AS z", "block_key"),
    "detect_pii": S.found(f"SELECT * FROM {_detected(S.DOCS)} AS z", "doc_id"),
    "pii_by_type": f"SELECT type AS span_type, lang, count(*) AS n FROM {S.candidates(S.DOCS, ('identifiers',))} AS c JOIN documents ON k = doc_id GROUP BY ROLLUP (type, lang)",
    "redact_documents": f"WITH found AS MATERIALIZED (SELECT * FROM {_detected(S.DOCS)} AS d0) SELECT k AS doc_id, n::INT AS n_spans, redacted FROM {S.redacted(S.DOCS, 'found', TOKEN_KEY)} AS z UNION ALL SELECT doc_id, 0, text FROM documents WHERE text IS NULL",
    "detect_filings": _IN_FILINGS + S.found(f"SELECT * FROM {S.resolved('every')} AS z", "block_key"),
}
SQL["redact_filings"] = (
    _IN_FILINGS + f", final AS MATERIALIZED (SELECT * FROM {S.resolved('every')} AS z0), "
    f"placed AS MATERIALIZED (SELECT k, doc_id, type, text, p[s + 1]::INT AS s, p[e]::INT + 1 AS e, {S.token('type', 'text', TOKEN_KEY)} AS token FROM final JOIN (SELECT k, doc_id FROM texts) AS d USING (k) JOIN (SELECT block_key AS k, string_split(places, ',') AS p FROM {S.NORMAL} AS n0) AS n USING (k)), "
    f"known AS MATERIALIZED (SELECT * FROM {S.pseudonyms('(SELECT doc_id AS scope, type, text FROM placed)', TOKEN_KEY)} AS p0), "
    "raws AS (SELECT block_key AS k, any_value(doc_id) AS doc_id, any_value(block_id) AS block_id, any_value(raw_text) AS t FROM blocks WHERE raw_text IS NOT NULL GROUP BY block_key), "
    "parts AS (SELECT x.k, s, e, pseudonym, coalesce(lag(e) OVER (PARTITION BY x.k ORDER BY s), 0) AS last FROM placed AS x JOIN known AS y ON x.doc_id = y.scope AND x.token = y.token), "
    "heads AS (SELECT k, string_agg(t[last + 1:s] || pseudonym, '' ORDER BY s) AS head, max(e) AS last FROM parts JOIN raws USING (k) GROUP BY k) "
    "SELECT doc_id, block_id, CASE WHEN head IS NULL THEN t ELSE head || t[last + 1:] END AS redacted FROM raws LEFT JOIN heads USING (k)"
)
QUERIES |= {f.__name__: f for f in (detect_address, detect_names, detect_birth_dates, detect_pii, pii_by_type, redact_documents, detect_filings, redact_filings)}


# ---- Tokens, replacements, vault -------------------------------------------------------------------------------


def entity_tokens(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).where("type is not null and text is not null")
    return s.select("entity_id", pseudonym.token(F.col("type"), F.col("text"), TOKEN_KEY).alias("token"))


def _fakes(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        s = _spans(spark, sf).where(F.col("type") == kind).where("text is not null")
        return s.select("entity_id", pseudonym.fake(F.col("type"), F.col("text"), pseudonym.token(F.col("type"), F.col("text"), TOKEN_KEY), F.lit(0)).alias("pseudonym"))

    return query


def pseudonym_map(spark: SparkSession, sf: str) -> DataFrame:
    """Replacements of every filing's values, distinct within the filing."""
    s = _spans(spark, sf).select(F.col("doc_id").alias("scope_id"), "type", "text").where("scope_id is not null")
    return pseudonym.pseudonyms(s, TOKEN_KEY).select("scope_id", "token", "type", "pseudonym", "turn")


def vault_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Values sealed and opened again; a wrong token opens nothing."""
    s = _spans(spark, sf).select(F.lit("all").alias("scope_id"), "type", "text").where("type is not null and text is not null")
    values = s.select(F.trim("text").alias("value"), pseudonym.token(F.col("type"), F.col("text"), TOKEN_KEY).alias("token")).groupBy("token").agg(F.min("value").alias("value"))
    opened = pseudonym.vault(values, VAULT_KEY).withColumn("wrong", pseudonym.unseal(F.col("payload"), VAULT_KEY, F.reverse("token")))
    return opened.select("token", pseudonym.unseal(F.col("payload"), VAULT_KEY, F.col("token")).alias("value"), F.col("wrong").isNull().alias("guarded"))


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """The replacement that each span's filing has for it; spans without a type or text have none."""
    s = _spans(spark, sf).select("entity_id", F.col("doc_id").alias("scope_id"), "type", "text").where("scope_id is not null")
    known = pseudonym.pseudonyms(s.select("scope_id", "type", "text"), TOKEN_KEY)
    return pseudonym.looked_up(s, known, TOKEN_KEY).select("entity_id", "pseudonym")


_KINDS = (("ip", "IP_ADDRESS"), ("dob", "DATE_OF_BIRTH"), ("phone", "PHONE"), ("card", "CREDIT_CARD"), ("person", "PERSON"), ("organization", "ORGANIZATION"), ("address", "ADDRESS"), ("email", "EMAIL"), ("tax_id", "SSN_TAX_ID"))
_VALUES = f"(SELECT doc_id AS scope, type, text FROM {S.ENTITIES} AS x WHERE doc_id IS NOT NULL)"
SQL |= {
    "entity_tokens": f"SELECT entity_id, {S.token('type', 'text', TOKEN_KEY)} AS token FROM {S.ENTITIES} AS x WHERE type IS NOT NULL AND text IS NOT NULL",
    "vault_roundtrip": f"SELECT token, min(trim(text)) AS value, true AS guarded FROM (SELECT text, {S.token('type', 'text', TOKEN_KEY)} AS token FROM {S.ENTITIES} AS x WHERE type IS NOT NULL AND text IS NOT NULL) GROUP BY token",
    "pseudonym_map": f"SELECT scope AS scope_id, token, type, pseudonym, turn FROM {S.pseudonyms(_VALUES, TOKEN_KEY)} AS p",
    "looked_up": f"SELECT entity_id, pseudonym FROM (SELECT *, {S.token('type', 'text', TOKEN_KEY)} AS token FROM {S.ENTITIES} AS x WHERE doc_id IS NOT NULL) AS e LEFT JOIN {S.pseudonyms(_VALUES, TOKEN_KEY)} AS p ON p.scope = e.doc_id AND p.token = e.token",
}
SQL |= {f"pseudonymize_{n}": f"SELECT entity_id, {S.FAKES[k]} AS pseudonym FROM (SELECT entity_id, trim(text) AS v, {S.token('type', 'text', TOKEN_KEY)} AS tok FROM {S.ENTITIES} AS x WHERE type = '{k}' AND text IS NOT NULL)" for n, k in _KINDS}
QUERIES |= {f.__name__: f for f in (entity_tokens, pseudonym_map, vault_roundtrip, looked_up)} | {f"pseudonymize_{n}": _fakes(k) for n, k in _KINDS}


# ---- Evaluation ------------------------------------------------------------------------------------------------


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "synthetic_benchmark").where("entities is not null").dropDuplicates(["id"])
    return evaluate.exploded(records, "id", "entities")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "synthetic_benchmark").where("entities is not null and text is not null").select("id", "text")).dropDuplicates(["id"])


def _labelled(df: DataFrame, spans: Column) -> DataFrame:
    return evaluate.exploded(df.select("id", F.transform(spans, lambda s: F.struct(s["type"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))).alias("e")), "id", "e")


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """What all detectors of identifiers find in the labelled records."""
    return _labelled(_records(spark, sf).withColumn("_s", detect.identifiers(F.col("text"))), F.col("_s"))


def eval_strict(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.strict(_predicted(spark, sf), _gold(spark, sf))
    return out.groupBy("label", "outcome").agg(F.count("*").alias("n"))


def eval_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions that no gold span equals but one of their label overlaps."""
    return evaluate.relaxed(_predicted(spark, sf), _gold(spark, sf)).select("doc_id", "start", "end", "label")


def eval_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.per_class(_predicted(spark, sf), _gold(spark, sf))


def eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.overall(eval_per_class(spark, sf), evaluate.tokens_of(_records(spark, sf), "text"))


def eval_engine(spark: SparkSession, sf: str) -> DataFrame:
    """The whole model-free engine against the labels of the benchmark."""
    return evaluate.per_class(_labelled(pipeline.detect_pii(_records(spark, sf), "text"), F.col("spans")), _gold(spark, sf))


def eval_prospectus(spark: SparkSession, sf: str) -> DataFrame:
    """The whole model-free engine against the held-out prospectus items."""
    items = table(spark, sf, "gold_prospectus").where("text is not null").select("id", "text", "entities").dropDuplicates(["id"])
    return evaluate.per_class(_labelled(pipeline.detect_pii(items, "text"), F.col("spans")), evaluate.exploded(items, "id", "entities"))


def eval_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans of all records laid behind one another."""
    records = table(spark, sf, "synthetic_benchmark").dropDuplicates(["id"])
    return evaluate.shifted(_gold(spark, sf), records, "id", "text")


#: Configurations of the ablation: rules stand in for the model; with context, addresses are found too and all is scored.
CONFIGS = ("identifiers", "rules", "identifiers+rules", "identifiers+rules+context", "identifiers+rules+context+registry")


def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """The engine with parts left out; each configuration's spans are arbitrated, and each record is a document of its own."""
    text = F.col("text")
    worded = (F.length(F.trim(text)) >= 4) & text.rlike("[a-zA-Z]")
    within = lambda c: F.when(worded, c).otherwise(F.array().cast(SPANS))
    parts = {"_i": detect.identifiers(text), "_a": within(address_op.address(text)), "_r": within(F.concat(rules.organisation(text), rules.person(text), rules.birth_date(text)))}
    r = _records(spark, sf).withColumns(parts).withColumn("_c", score.scored(text, detect.numbered(F.concat("_i", "_a", "_r")).cast(SPANS)))
    r = r.select("id", F.col("id").alias("doc_id"), "text", "_i", "_r", detect.numbered(F.concat("_i", "_r")).cast(SPANS).alias("_b"), "_c", F.col("_c").alias("_k"))
    named = r.select("doc_id", F.posexplode("_c").alias("ord", "s")).select("doc_id", "ord", "s.type", "s.text", "s.confidence")
    every = registry.propagated(r, registry.aliases(registry.seeds(named)), "id", "text", "_k")
    each = every.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.col(x).alias("spans")) for c, x in zip(CONFIGS, ("_i", "_r", "_b", "_c", "_k"))))).alias("x"))
    final = each.select("doc_id", "x.config", resolve.resolved(F.col("x.spans")).alias("spans"))
    pred = final.select("doc_id", "config", F.explode("spans").alias("s")).select("doc_id", "config", F.col("s.type").alias("label"), "s.start", "s.end")
    return evaluate.ablation(pred, _gold(spark, sf), CONFIGS, evaluate.tokens_of(_records(spark, sf), "text"))


_AS_PRED = lambda spans: f"(SELECT 'all' AS config, k, type AS label, s, e FROM {spans} AS ap)"
_IDS = _AS_PRED(S.candidates(S.RECORDS, ("identifiers",)))
_ALL_GOLD = f"(SELECT 'all' AS config, * FROM {S.GOLD} AS ag)"
_WITHOUT = "SELECT * EXCLUDE (config) FROM ({}) AS w0"
ITEMS = "(SELECT DISTINCT id AS k, text AS t FROM gold_prospectus WHERE text IS NOT NULL)"
ITEMS_GOLD = "(SELECT 'all' AS config, id AS k, coalesce(x.label, '') AS label, x.\"start\" AS s, x.\"end\" AS e FROM (SELECT id, unnest(ents) AS x FROM (SELECT id, any_value(entities) AS ents FROM gold_prospectus WHERE text IS NOT NULL GROUP BY id)))"
_ABLATED = (
    f"WITH recs AS MATERIALIZED (SELECT *, k AS doc_id FROM {S.RECORDS} AS r0), ids AS MATERIALIZED (SELECT * FROM {S.candidates('(SELECT k, t FROM recs)', ('identifiers',))} AS i0), named AS MATERIALIZED (SELECT * FROM {S.candidates('(SELECT k, t FROM recs)', ('rules',))} AS n0), "
    "both_ AS MATERIALIZED (SELECT * FROM ids UNION ALL SELECT k, type, text, s, e, confidence, 1000000 + seq FROM named), "
    f"ctx AS MATERIALIZED (SELECT * FROM {S.scored(S.candidates('(SELECT k, t FROM recs)'), '(SELECT k, t FROM recs)')} AS c0), "
    f"known AS MATERIALIZED (SELECT k, type, text, s, e, confidence, seq FROM ctx UNION ALL SELECT k, type, text, s, e, 0.9::DOUBLE, 1000000 + s FROM {S.propagated('recs', 'ctx', S.aliases(S.seeds('(SELECT k AS doc_id, type, text, confidence, seq AS ord FROM ctx)')))} AS p0), "
    "pred AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{c}' AS config, k, type AS label, s, e FROM {S.resolved(x)} AS z{i}" for i, (c, x) in enumerate(zip(CONFIGS, ("ids", "named", "both_", "ctx", "known")))) + ") "
)
SQL |= {
    "eval_strict": f"SELECT label, outcome, count(*) AS n FROM {S.outcomes(_IDS, _ALL_GOLD)} AS o GROUP BY label, outcome",
    "eval_relaxed": f"SELECT k AS doc_id, s AS \"start\", e AS \"end\", label FROM {S.outcomes(_IDS, _ALL_GOLD)} AS o WHERE outcome = 'fp' AND EXISTS (SELECT 1 FROM {S.GOLD} AS g WHERE g.k = o.k AND g.label = o.label AND greatest(g.s, o.s) < least(g.e, o.e))",
    "eval_per_class": _WITHOUT.format(S.per_class(_IDS, _ALL_GOLD, evaluate.CLASSES)),
    "eval_overall": _WITHOUT.format(S.overall(S.per_class(_IDS, _ALL_GOLD, evaluate.CLASSES), S.RECORDS)),
    "eval_engine": _WITHOUT.format(S.per_class(_AS_PRED(_detected(S.RECORDS)), _ALL_GOLD, evaluate.CLASSES)),
    "eval_prospectus": _WITHOUT.format(S.per_class(_AS_PRED(_detected(ITEMS)), ITEMS_GOLD, evaluate.CLASSES)),
    "eval_shifted": f"SELECT g.k AS doc_id, label, s + base AS \"start\", e + base AS \"end\" FROM {S.GOLD} AS g JOIN (SELECT id, (coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS base FROM (SELECT id, any_value(coalesce(length(text), 0)) + 100 AS n FROM synthetic_benchmark GROUP BY id)) AS o ON g.k = o.id",
    "ablation": _ABLATED + S.overall(S.per_class("pred", f"(SELECT unnest([{', '.join(q(c) for c in CONFIGS)}]) AS config, * FROM {S.GOLD} AS ag)", evaluate.CLASSES, CONFIGS), S.RECORDS),
}
QUERIES |= {f.__name__: f for f in (eval_strict, eval_relaxed, eval_per_class, eval_overall, eval_engine, eval_prospectus, eval_shifted, ablation)}
