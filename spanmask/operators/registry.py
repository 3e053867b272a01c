"""Names known in a document, carried to all of its blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmask.functions import lexicon as X
from spanmask.functions.spantext import NO_SPANS, SPANS, span
from spanmask.operators.score import not_personal, scored_one

SOURCE = "document_entity_registry"
SEED_CONFIDENCE, SHORTEST_NAME, SHORTEST_ALIAS = 0.85, 4, 5


def seeds(spans: DataFrame) -> DataFrame:
    """(doc_id, canonical, type, seed_ord): names that may be carried, the first of each spelling.

    ``spans`` has doc_id, type, text, confidence and an order ``ord``. Sure persons of two words and more and organisations of two words or
    with a legal form count; titles go; terms that are never personal and short capitals don't count. Null texts,
    types and confidences don't count.
    """
    name = F.trim(F.regexp_replace(F.trim("text"), f"(?i){X.TITLE}", ""))
    words = F.size(F.split(name, r"\s+"))
    legal = F.lower(name).rlike("(?:" + "|".join(re.escape(e) for e in X.LEGAL_ENDS) + ")$")
    stub = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) <= 4)
    fit = F.when(F.col("type") == "PERSON", words >= 2).when(F.col("type") == "ORGANIZATION", (words >= 2) | legal).otherwise(False)
    good = spans.where((F.col("confidence") >= SEED_CONFIDENCE) & F.col("type").isin("PERSON", "ORGANIZATION"))
    kept = good.select("doc_id", name.alias("canonical"), "type", "ord", fit.alias("fit"), (not_personal(name) | stub).alias("out")).where((F.length("canonical") >= SHORTEST_NAME) & F.col("fit") & ~F.col("out"))
    return kept.groupBy("doc_id", "canonical").agg(F.min_by("type", "ord").alias("type"), F.min("ord").alias("seed_ord"))


def alias_array(name: Column, kind: Column) -> Column:
    """Ways in which a document may call a name again."""
    words = F.split(name, r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    titled = [F.concat(F.lit(f"{t} "), rest) for t in X.TITLES[:5] for rest in (last, name, F.concat_ws(" ", first, last))]
    middle = F.when(F.size(words) == 3, F.concat(first, F.lit(" "), F.substring(F.get(words, 1), 1, 1), F.lit(". "), last))
    person = F.array(name, F.concat_ws(" ", first, last), *titled, middle)
    swap = lambda a, b: F.when(name.contains(a), F.replace(name, F.lit(a), F.lit(b)))
    firm = F.array(name, swap("Limited", "Ltd"), swap("Limited", "Ltd."), swap("Private Limited", "Pvt. Ltd."), swap("Private Limited", "Pvt Ltd"), swap("Private Limited", "Pvt. Ltd"), swap("Private", "Pvt."), swap("Private", "Pvt"))
    return F.array_distinct(F.array_compact(F.when(kind == "PERSON", F.when(F.size(words) >= 2, person).otherwise(F.array(name))).otherwise(firm)))


def aliases(seed: DataFrame) -> DataFrame:
    """(doc_id, alias_lc, canonical, type, seed_ord): of names that share an alias, the last one has it."""
    each = seed.select("doc_id", "canonical", "type", "seed_ord", F.explode(alias_array(F.col("canonical"), F.col("type"))).alias("alias")).where(F.length("alias") >= SHORTEST_ALIAS)
    latest = F.max_by(F.struct("canonical", "type", "seed_ord"), F.struct("seed_ord", "canonical"))
    return each.groupBy("doc_id", F.lower("alias").alias("alias_lc")).agg(latest.alias("_s")).select("doc_id", "alias_lc", "_s.*")


def is_carried(s: Column) -> Column:
    """Whether a span was added here: it names what it was carried from."""
    return F.array_contains(s["sources"], SOURCE) & s["sub_type"].isNotNull()


def _grams(text: Column) -> Column:
    """array<struct(key, start)>: every word and every two words in a row, lower case, with their places."""
    word = re.compile(r"\w+")

    def grams(t: str) -> list[dict]:
        ws = [(m[0].lower(), m.start()) for m in word.finditer(t)]
        return [{"key": w, "start": i} for w, i in ws] + [{"key": f"{a} {b}", "start": i} for (a, i), (b, _) in zip(ws, ws[1:])]

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else grams(t))

    return F.pandas_udf(run, "array<struct<key:string,start:int>>")(text)


def propagated(blocks: DataFrame, alias: DataFrame, key: str = "block_key", text: str = "norm_text", spans: str = "spans", existing: DataFrame | None = None, rescore: bool = False) -> DataFrame:
    """``blocks`` with spans of the document's names added where no span of theirs lies yet.

    Instead of one pattern for all names of a document, whose size would grow with the document, names meet texts by
    their first two words; a meeting counts if the whole alias stands there between word boundaries. Of meetings
    that overlap the leftmost, then the longest stays. ``key`` must be unique; blocks without doc_id or text stay as they are.
    With ``existing`` (key, spans) the spans are there instead of in ``blocks``, and the result is ``existing`` with those added, so that
    no text is joined for it. With ``rescore`` the added spans are scored where their text is at hand.
    """
    head = F.regexp_extract_all("alias_lc", F.lit(r"(?U)\w+"), 0)
    known = alias.withColumn("_w", head).where(F.size("_w") > 0).withColumn("key", F.array_join(F.slice("_w", 1, 2), " ")).drop("_w")
    usable = blocks.where((F.length(F.trim(text)) >= 4) & F.col(text).rlike("[a-zA-Z]") & F.col("doc_id").isNotNull())
    at = usable.select(key, "doc_id", F.explode(_grams(F.col(text))).alias("_g")).select(key, "doc_id", "_g.key", "_g.start")
    met = at.join(known, ["doc_id", "key"]).select(key, "start", "alias_lc", "canonical", "type")
    n = F.length("alias_lc")
    here = F.substring(F.col(text), F.col("start") + 1, n)
    after = F.substring(F.col(text), F.col("start") + 1 + n, F.lit(1))
    # A boundary lies behind a word character if none follows, behind a mark only if one does.
    word_end, word_next = F.col("alias_lc").rlike(r"(?U)\w$"), after.rlike(r"(?U)\w")
    whole = met.join(usable.select(key, text), key).where((F.lower(here) == F.col("alias_lc")) & (word_end != word_next))
    best = whole.withColumn("_r", F.row_number().over(Window.partitionBy(key, "start").orderBy(n.desc(), "alias_lc"))).where("_r = 1")
    one = span(F.col("type"), F.substring(F.col(text), F.col("start") + 1, n), F.col("start"), F.col("start") + n, 0.90, SOURCE).withField("sub_type", F.col("canonical"))
    final = scored_one(F.col(text), one) if rescore else one
    lists = best.select(key, "start", one.alias("s"), final.alias("z")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "s", "z"))).alias("_carried"))

    def step(acc: Column, c: Column) -> Column:
        free = (F.size(acc) == 0) | (F.element_at(acc, -1)["s"]["end"] <= c["s"]["start"])
        return F.when(free, F.concat(acc, F.array(c))).otherwise(acc)

    scan = F.aggregate("_carried", F.filter("_carried", lambda c: F.lit(False)), step)
    free = F.filter(scan, lambda c: ~F.exists(F.coalesce(F.col(spans), NO_SPANS()), lambda s: F.greatest(s["start"], c["s"]["start"]) < F.least(s["end"], c["s"]["end"])))
    clear = F.filter(F.transform(free, lambda c: c["z"]), lambda s: s.isNotNull()).cast(SPANS)
    joined = (blocks if existing is None else existing).join(lists, key, "left")
    return joined.withColumn(spans, F.concat(F.coalesce(F.col(spans), NO_SPANS()), F.when(F.col("_carried").isNotNull(), clear).otherwise(NO_SPANS())).cast(SPANS)).drop("_carried")
