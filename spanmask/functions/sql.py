"""The engine's basic functions for SQL text, as temporary SQL functions: Catalyst inlines their bodies, no UDF runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanmask.functions.lexicon import CARD, EMAIL, IPV4, OCTET


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


_SPAN = "ARRAY<STRUCT<start INT, end INT, text STRING>>"
_BODY = (
    "aggregate(zip_with(split({t}, {rx}, -1), regexp_extract_all({t}, {rx}, 0), (g, m) -> named_struct('g', length(g), 'm', m)), "
    "named_struct('pos', 0, 'out', cast(array() AS ARRAY<STRUCT<start INT, end INT, text STRING>>)), "
    "(acc, p) -> if(p.m IS NULL, acc, named_struct('pos', acc.pos + p.g + length(p.m), 'out', concat(acc.out, array(named_struct('start', acc.pos + p.g, 'end', acc.pos + p.g + length(p.m), 'text', p.m))))), "
    "acc -> acc.out)"
)


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions and returns their names.

    spans_of(text, pattern): all matches with their places; email_spans, ipv4_spans, card_spans: of one identifier, validated;
    use them as ``SELECT k, inline(s) FROM (SELECT k, email_spans(text) AS s FROM t)``. A null text gives null.
    """
    keep = {
        "email": (EMAIL, r"s -> s.text rlike '(?i)^[a-z0-9_.+-]+@[a-z0-9-]+[.][a-z0-9-.]+$' AND NOT contains(s.text, '..')"),
        "ipv4": (IPV4, rf"s -> s.text rlike {_quoted(rf'^(?:{OCTET}\.){{3}}{OCTET}$')} AND NOT s.text rlike '(?:^|[.])0[0-9]'"),
        "card": (CARD, r"s -> luhn_check(regexp_replace(s.text, '[ -]', '')) AND NOT regexp_replace(s.text, '[^0-9]', '') rlike '^(.)\\1+$'"),
    }
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION spans_of(t STRING, rx STRING) RETURNS {_SPAN} RETURN " + _BODY.format(t="t", rx="rx"))
    for name, (pattern, test) in keep.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_spans(t STRING) RETURNS {_SPAN} RETURN filter(" + _BODY.format(t="t", rx=_quoted(pattern)) + f", {test})")
    return ["spans_of", *(f"{n}_spans" for n in keep)]
