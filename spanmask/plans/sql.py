"""The operators in DuckDB's SQL, as functions of their sources, so that queries can be put together from them.

A source of texts has k (key) and t (text); sources of spans have k, type, text, s, e, confidence and seq besides.
"""

from __future__ import annotations

import unicodedata

from spanmask.functions import lexicon as X
from spanmask.operators import address as A
from spanmask.operators import normalize, rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_in(value: str, terms) -> str:
    return f"{value} IN ({', '.join(q(t) for t in terms)})"


DOCS = "(SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL)"


def _changes() -> str:
    """c, f: what characters become in the normal form, if something else."""
    plain = dict(zip(normalize.PLAIN_FROM, normalize.PLAIN_TO))
    some = [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F252)]
    pairs = [(c, "" if c in normalize.GONE else unicodedata.normalize("NFKC", plain.get(c, c))) for c in map(chr, some)]
    return "(SELECT unnest([" + ", ".join(f"chr({ord(c)})" for c, f in pairs if c != f) + "]) AS c, unnest([" + ", ".join(q(f) for c, f in pairs if c != f) + "]) AS f)"


def _normal(where: str) -> str:
    """block_key, norm_text, places: the normal form of raw texts, character by character, and the raw place of each of its characters."""
    raw = f"(SELECT block_key, any_value(raw_text) AS t FROM blocks WHERE raw_text IS NOT NULL AND {where} GROUP BY block_key)"
    return (
        "(SELECT block_key, coalesce(string_agg(f, '' ORDER BY i), '') AS norm_text, coalesce(string_agg(CASE WHEN length(f) > 0 THEN array_to_string(list_transform(range(length(f)), lambda x: i - 1), ',') END, ',' ORDER BY i), '') AS places FROM "
        f"(SELECT block_key, i, coalesce(m.f, x.c) AS f FROM (SELECT block_key, unnest(regexp_extract_all(t, '(?s).')) AS c, unnest(range(1, length(t) + 1)) AS i FROM {raw} AS r) AS x LEFT JOIN {_changes()} AS m ON m.c = x.c) GROUP BY block_key "
        f"UNION ALL SELECT block_key, '', '' FROM {raw} AS e WHERE t = '')"
    )


NORMAL, NORMAL_OF_OTHERS = _normal("true"), _normal("norm_text IS NULL")
BLOCKS = f"(SELECT DISTINCT block_key AS k, norm_text AS t FROM blocks WHERE norm_text IS NOT NULL UNION ALL SELECT block_key AS k, norm_text AS t FROM {NORMAL_OF_OTHERS} AS n1)"
RECORDS = "(SELECT DISTINCT id AS k, text AS t FROM synthetic_benchmark WHERE entities IS NOT NULL AND text IS NOT NULL)"
ENTITIES = "(SELECT entity_id, any_value(doc_id) AS doc_id, any_value(block_key) AS block_key, any_value(type) AS type, any_value(text) AS text, any_value(\"start\") AS s, any_value(\"end\") AS e, any_value(confidence) AS confidence, any_value(detector_sources) AS sources FROM spans GROUP BY entity_id)"
BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def matches(source: str, pattern: str) -> str:
    """k, t, v, b: every match of a pattern with its place, from the matches and the gaps between them."""
    p = q(pattern)
    return (
        f"(SELECT k, t, ms[i] AS v, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::INT AS b "
        f"FROM (SELECT k, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT k, t, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM {source} AS src)))"
    )


def wordy(source: str) -> str:
    """DuckDB's word boundary knows ASCII only: letters of other scripts become "_", which is no part of the patterns, and "_" becomes "~"."""
    return rf"(SELECT k, regexp_replace(replace(t, '_', '~'), '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', '_', 'g') AS t FROM {source} AS raw)"


def _span(inner: str, kind: str, confidence: float, where: str = "true", value: str = "v", begin: str = "b") -> str:
    return f"SELECT k, '{kind}' AS type, {value} AS text, ({begin})::INT AS s, ({begin} + length({value}))::INT AS e, {confidence}::DOUBLE AS confidence FROM {inner} AS m WHERE {where}"


EMAIL_OK = r"regexp_matches(lower(v), '^[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+$') AND NOT contains(v, '..') AND NOT ends_with(v, '.') AND length(regexp_extract(v, '[^.]*$')) >= 2"
LUHN_OK = (
    r"regexp_matches(regexp_replace(v, '[\s-]', '', 'g'), '^\d{13,19}$') AND length(replace(regexp_replace(v, '[\s-]', '', 'g'), v[1], '')) > 0 AND "
    r"list_sum(list_transform(range(1, length(regexp_replace(v, '[\s-]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(regexp_replace(v, '[\s-]', '', 'g'))[i]::INT "
    r"ELSE (2 * reverse(regexp_replace(v, '[\s-]', '', 'g'))[i]::INT) // 10 + (2 * reverse(regexp_replace(v, '[\s-]', '', 'g'))[i]::INT) % 10 END)) % 10 = 0"
)
_PHONE = X.PHONE.replace(X.AFTER, r"(?:^|[\s:;,(\-])")
_PLANS = "regexp_matches(regexp_replace(d, '^00', ''), '^(?:" + "|".join(f"{c}(?:{p})" for c, p in X.DIALLING.items()) + ")$')"
PHONE_OK = (
    r"NOT regexp_matches(v, '^(?:19|20)\d{2}$') AND NOT regexp_matches(t[greatest(b - 9, 1):b], '" + X.MONEY_BEFORE + r"') AND NOT regexp_matches(lower(t[b + length(v) + 1:b + length(v) + 15]), '" + X.MONEY_AFTER + r"') "
    r"AND NOT regexp_matches(lower(t[greatest(b - 9, 1):b]), '" + X.COUNT_BEFORE + r"') AND length(d) BETWEEN 7 AND 15 AND ((regexp_matches(v, '^(?:\+|00)') AND (" + _PLANS + r")) "
    r"OR (length(d) = 10 AND regexp_matches(d, '^[6-9]')) OR (length(d) = 12 AND regexp_matches(d, '^91[6-9]')) OR (regexp_matches(v, '^0\d{2,4}[-\s]?\d{6,8}$') AND length(d) BETWEEN 10 AND 11))"
)


def email(source: str) -> str:
    m = f"(SELECT m.k, b, rtrim(o.t[b + 1:b + length(v)], ' ,;.:') AS v FROM {matches(wordy(source), X.EMAIL.replace('._%', '.~%'))} AS m JOIN {source} AS o ON m.k = o.k WHERE NOT regexp_matches(o.t[b:b + 1], '^[\\pL\\pN_]_$'))"
    return _span(m, "EMAIL", 0.99, EMAIL_OK)


def ipv4(source: str) -> str:
    return _span(matches(wordy(source), X.IPV4), "IP_ADDRESS", 0.98, r"NOT regexp_matches(v, '(?:^|\.)0\d')")


def ipv6(source: str) -> str:
    return _span(matches(wordy(source), X.IPV6), "IP_ADDRESS", 0.98)


def credit_card(source: str) -> str:
    return _span(matches(wordy(source), X.CARD), "CREDIT_CARD", 0.95, LUHN_OK)


def phone(source: str) -> str:
    m = (
        "(SELECT k, t, rtrim(w, ' ,;.:') AS v, c + length(u) - length(w) AS b FROM (SELECT k, t, regexp_replace(u, '^\\s+', '') AS w, u, c FROM (SELECT k, t, CASE WHEN regexp_matches(v, '^[\\s:;,(\\-]') AND NOT starts_with(v, '(0') THEN v[2:] ELSE v END AS u, "
        f"CASE WHEN regexp_matches(v, '^[\\s:;,(\\-]') AND NOT starts_with(v, '(0') THEN b + 1 ELSE b END AS c FROM {matches(wordy(source), _PHONE)})))"
    )
    return _span(rf"(SELECT *, regexp_replace(v, '\D', '', 'g') AS d FROM {m})", "PHONE", 0.96, PHONE_OK)


def ssn(source: str) -> str:
    return _span(matches(wordy(source), r"\b\d{3}-\d{2}-\d{4}\b"), "SSN_TAX_ID", 0.95, "NOT regexp_matches(v, '^(?:000|666|9)') AND v[5:6] <> '00' AND v[8:11] <> '0000'")


def pan(source: str) -> str:
    return _span(matches(wordy(source), X.PAN), "SSN_TAX_ID", 0.95, f"regexp_matches(v, '^[A-Z]{{3}}[ABCFGHLJPT]') AND NOT regexp_matches(t[greatest(b - 2, 1):b + length(v) + 10], {q(X.CIN)}) AND NOT regexp_matches(t[greatest(b - 2, 1):b + length(v) + 5], {q(X.GSTIN)})")


def din(source: str) -> str:
    return _span(f"(SELECT k, t, (b + length(v) - 8) AS b, v[-8:] AS v FROM {matches(wordy(source), X.DIN)})", "SSN_TAX_ID", 0.93)


#: In order of emission.
DETECTORS = {"email": email, "ipv4": ipv4, "ipv6": ipv6, "credit_card": credit_card, "phone": phone, "ssn": ssn, "pan": pan, "din": din}


def found(spans: str, key: str) -> str:
    return f"SELECT k AS {key}, text AS value, s AS span_start, e AS span_end, type AS span_type FROM ({spans}) AS f"


# ---- Addresses and rules ---------------------------------------------------------------------------------------

_GEO = "[" + ", ".join(q(x) for x in X.GEOGRAPHY) + "]"
_first = lambda v, p: f"CASE WHEN regexp_matches({v}, {q(p)}) THEN length(string_split_regex({v}, {q(p)})[1]) END"
_geo = lambda v: f"len(list_intersect(list_distinct(regexp_extract_all(lower({v}), '[a-z]+')), {_GEO}))"
_END, _START = "' ,;.:' || chr(9) || chr(10)", "' ,;:' || chr(9) || chr(10)"


def address(source: str) -> str:
    """Anchored addresses, and those back from a postal code outside them."""
    plain = f"(SELECT k, translate(t, {q(X.BLANKS)}, {q(' ' * len(X.BLANKS))}) AS t FROM {source} AS given)"
    behind = f"(SELECT k, t, ltrim(t[b + length(v) + 1:], ' ' || chr(9) || ':') AS r FROM {matches(plain, X.ADDRESS_ANCHOR)})"
    reach = f"coalesce({_first('r', X.ADDRESS_STOP)}, CASE WHEN contains(r, chr(10)) THEN strpos(r, chr(10)) - 1 END, {A.AHEAD})"
    anchored = f"(SELECT k, s, v FROM (SELECT k, (length(t) - length(r))::INT AS s, rtrim(r[1:{reach}], {_END}) AS v FROM {behind}) WHERE length(v) > {A.LEAST_ANCHORED} AND ({_geo('v')} > 0 OR regexp_matches(v, {q(X.PIN)})))"
    free = f"(SELECT * FROM {matches(plain, X.PIN)} AS p WHERE NOT EXISTS (SELECT 1 FROM {anchored} AS a WHERE a.k = p.k AND a.s <= p.b AND a.s + length(a.v) >= p.b + length(p.v)))"
    windows = f"(SELECT k, t, b, b + length(v) AS e, greatest(0, b - {A.BACK}) AS back FROM {free})"
    placed = f"(SELECT k, t, e, back, t[back + 1:b] AS w, regexp_extract(t[e + 1:e + {A.TAIL}], {q(A.at_start(X.ADDRESS_TAIL))}) AS tail FROM {windows} WHERE {_geo('t[back + 1:e]')} >= 2)"
    marked = f"(SELECT *, CASE WHEN regexp_matches(w, '[:\\n;.]') THEN ltrim(regexp_extract(w, {q(A.CLAUSE)}), ' ' || chr(9)) ELSE w END AS c FROM {placed})"
    firm = f"(SELECT *, length(regexp_extract(c, {q(A.at_start(X.ADDRESS_FIRM))})) AS f FROM {marked})"
    link = f"CASE WHEN f > 0 THEN length(regexp_extract(c[f + 1:], {q(A.at_start(X.ADDRESS_LINK))})) ELSE 0 END"
    last = f"regexp_extract_all(w, {q(X.ADDRESS_BEFORE)})"
    gaps = f"string_split_regex(w, {q(X.ADDRESS_BEFORE)})"
    begin = f"coalesce(CASE WHEN len({last}) > 0 THEN length(w) - length({gaps}[-1]) END, {_first('w', X.ADDRESS_FIRST)}, length(w) - length(c) + f + {link})"
    body = f"(SELECT k, z, ltrim(t[back + {begin} + 1:z], {_START}) AS v FROM (SELECT *, e + CASE WHEN trim(tail) <> '' THEN length(tail) ELSE 0 END AS z FROM {firm}))"
    coded = f"(SELECT k, (z - length(v))::INT AS s, rtrim(v, {_END}) AS v FROM {body})"
    both = f"SELECT k, s, v, 0.95 AS c FROM {anchored} UNION ALL SELECT k, s, v, 0.88 FROM {coded} WHERE length(v) > {A.LEAST_BY_PIN}"
    return f"SELECT a.k, 'ADDRESS' AS type, o.t[s + 1:s + length(v)] AS text, s, (s + length(v))::INT AS e, c::DOUBLE AS confidence FROM ({both}) AS a JOIN {source} AS o ON a.k = o.k"


def _cut(inner: str, kind: str, confidence: float, lead: str | None = None, trail: str | None = None, where: str = "true") -> str:
    """Matches without what the pattern takes from their beginning or end."""
    led = f"(SELECT k, b + length(v) AS z, {f'regexp_replace(v, {q(lead)}, {q("")})' if lead else 'v'} AS v FROM {inner})"
    cut = f"(SELECT k, z - length(v) AS b, {f'regexp_replace(v, {q(trail)}, {q("")})' if trail else 'v'} AS v FROM {led})"
    return _span(cut, kind, confidence, where)


def organisation(source: str) -> str:
    return _cut(matches(source, rules.ORGANISATION), "ORGANIZATION", 0.85, rules.NO_FIRM, None, r"NOT regexp_matches(v, '^(?:Private Limited|Limited|LLP|Pvt\.? Ltd\.?|Ltd\.?)$')")


def person(source: str) -> str:
    return _cut(matches(source, rules.CUED), "PERSON", 0.85, f"^{rules.CUE}") + " UNION ALL " + _cut(matches(source, rules.OFFICED), "PERSON", 0.85, rules.NO_LETTER, f"{rules.OFFICE}$")


BORN = "coalesce(" + ", ".join(f"CASE WHEN year(try_strptime(trim(text), '{f}')) BETWEEN 1910 AND 2026 THEN try_strptime(trim(text), '{f}') END" for f in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%d %B, %Y", "%d %b, %Y", "%Y/%m/%d")) + ")"


def birth_date(source: str) -> str:
    return f"SELECT * FROM ({_span(matches(source, rules.DATE), 'DATE_OF_BIRTH', 0.7)}) AS d WHERE {BORN} IS NOT NULL"


def worded(source: str) -> str:
    return f"(SELECT * FROM {source} AS w0 WHERE length(trim(t)) >= 4 AND regexp_matches(t, '[a-zA-Z]'))"


def candidates(source: str, parts=("identifiers", "addresses", "rules")) -> str:
    """k, type, text, s, e, confidence, seq: every detector's spans in order of emission."""
    some = []
    if "identifiers" in parts:
        some += [d(source) for d in DETECTORS.values()]
    if "addresses" in parts:
        some.append(address(worded(source)))
    if "rules" in parts:
        some += [f(worded(source)) for f in (organisation, person, birth_date)]
    every = " UNION ALL ".join(f"SELECT *, {i} AS d FROM ({x}) AS x{i}" for i, x in enumerate(some))
    return f"(SELECT k, type, text, s, e, confidence, row_number() OVER (PARTITION BY k ORDER BY d, s, confidence DESC) AS seq FROM ({every}))"


# ---- Scores, arbitration, known names --------------------------------------------------------------------------

PRIORITY = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.PRIORITY.items()) + " ELSE 0 END"


def _hit(rx: str) -> str:
    return f"regexp_matches(w, {q(rx)})"


def scored(spans: str, texts: str) -> str:
    """The spans that stay, with their new type and confidence; further columns of ``spans`` stay as they are."""
    firm, sure = (f"regexp_matches(lower(text), '{'|'.join(p)}')" for p in (X.FIRM_PARTS, X.SURE_PARTS))
    return (
        "(SELECT * EXCLUDE (type, confidence, kind, conf, firm, sure, w), kind AS type, round(conf, 3) AS confidence FROM (SELECT *, CASE WHEN type = 'PERSON' AND firm THEN 'ORGANIZATION' ELSE type END AS kind, "
        f"CASE WHEN type = 'DATE_OF_BIRTH' THEN CASE WHEN {_hit(X.BIRTH_CUE)} AND NOT {_hit(X.FILING_CUE)} THEN least(1.0, confidence + 0.35) WHEN {_hit(X.FILING_CUE)} THEN greatest(0.0, confidence - 0.60) ELSE greatest(0.0, confidence - 0.45) END "
        f"WHEN type = 'PERSON' AND NOT firm THEN CASE WHEN {_hit(X.PERSON_CUE)} THEN least(1.0, confidence + 0.20) WHEN {_hit(X.BODY_CUE)} THEN greatest(0.0, confidence - 0.25) ELSE confidence END "
        "WHEN type = 'ORGANIZATION' AND sure THEN least(1.0, confidence + 0.20) ELSE confidence END AS conf "
        f"FROM (SELECT x.*, t[greatest(s - 80, 0) + 1:e + 80] AS w, {firm} AS firm, {sure} AS sure FROM {spans} AS x JOIN {texts} AS y USING (k))) "
        f"WHERE NOT coalesce({words_in('lower(trim(text))', X.NOT_PERSONAL)} OR (type = 'PERSON' AND NOT firm AND length(trim(text)) < 3) OR (type = 'ORGANIZATION' AND NOT sure AND length(trim(text)) < 4) OR (kind = 'DATE_OF_BIRTH' AND round(conf, 3) < 0.5) OR (kind = 'ORGANIZATION' AND round(conf, 3) < 0.45), false))"
    )


def merged(spans: str) -> str:
    """One span for each place: the highest type, then the surest, then the first."""
    best = lambda c: f"arg_min({c}, struct_pack(p := -({PRIORITY}), c := -coalesce(confidence, 0), i := seq))"
    return f"(SELECT k, s, e, {best('type')} AS type, {best('text')} AS text, {best('seq')} AS seq FROM {spans} AS m0 GROUP BY k, s, e)"


def _fold(ordered: str, keep: str, new: str) -> str:
    """k, r: a fold over each key's rows in order n; ``keep`` gives the list after a row, from acc and the row m."""
    return (
        f"(WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM {ordered} AS o0), f AS (SELECT k, 1 AS n, [{new}] AS acc FROM m WHERE n = 1 UNION ALL "
        f"SELECT m.k, m.n, {keep} FROM f JOIN m ON m.k = f.k AND m.n = f.n + 1) SELECT k, unnest(acc) AS r FROM (SELECT *, max(n) OVER (PARTITION BY k) AS top FROM f) WHERE n = top)"
    )


def resolved(spans: str) -> str:
    """k, type, text, s, e: disjoint spans."""
    new = "{'s': m.s, 'e': m.e, 'type': m.type, 'p': m.p, 'text': m.text}"
    ordered = f"(SELECT *, {PRIORITY} AS p, row_number() OVER (PARTITION BY k ORDER BY s, s - e, seq) AS n FROM {merged(spans)} AS x)"
    keep = (
        f"CASE WHEN acc[-1].e <= m.s THEN list_append(acc, {new}) "
        "WHEN (acc[-1].e >= m.e AND (acc[-1].type = 'ADDRESS' OR acc[-1].p >= m.p)) OR (acc[-1].e < m.e AND (m.p < acc[-1].p OR (m.p = acc[-1].p AND m.e - m.s <= acc[-1].e - acc[-1].s))) THEN acc "
        f"ELSE list_append(acc[1:len(acc) - 1], {new}) END"
    )
    return f"(SELECT k, r.type AS type, r.text AS text, r.s AS s, r.e AS e FROM {_fold(ordered, keep, new)} AS z)"


TITLE = q(f"(?i){X.TITLE}")


def seeds(spans: str) -> str:
    """doc_id, canonical, type, ord of names that may be carried; ``spans`` has doc_id, type, text, confidence, ord."""
    legal = "(?:" + "|".join(e.replace(".", r"\.") for e in X.LEGAL_ENDS) + ")$"
    return (
        f"(SELECT doc_id, canonical, arg_min(type, ord) AS type, min(ord) AS ord FROM (SELECT doc_id, type, confidence, ord, trim(regexp_replace(trim(text), {TITLE}, '')) AS canonical FROM {spans} AS x) AS y "
        f"WHERE confidence >= 0.85 AND type IN ('PERSON', 'ORGANIZATION') AND length(canonical) >= 4 AND (regexp_matches(canonical, '\\s') OR (type = 'ORGANIZATION' AND regexp_matches(lower(canonical), {q(legal)}))) "
        f"AND NOT {words_in('lower(trim(canonical))', X.NOT_PERSONAL)} AND NOT (upper(canonical) = canonical AND lower(canonical) <> canonical AND length(canonical) <= 4) GROUP BY doc_id, canonical)"
    )


def aliases(seed: str) -> str:
    w = "string_split_regex(canonical, '\\s+')"
    fl = f"({w}[1] || ' ' || {w}[-1])"
    swaps = (("Limited", "Ltd"), ("Limited", "Ltd."), ("Private Limited", "Pvt. Ltd."), ("Private Limited", "Pvt Ltd"), ("Private Limited", "Pvt. Ltd"), ("Private", "Pvt."), ("Private", "Pvt"))
    return (
        f"SELECT doc_id, lower(a) AS alias_lc, arg_max(canonical, struct_pack(o := ord, c := canonical)) AS canonical, arg_max(type, struct_pack(o := ord, c := canonical)) AS type FROM (SELECT doc_id, canonical, type, ord, unnest(CASE WHEN type = 'PERSON' AND len({w}) >= 2 THEN "
        f"list_concat([canonical, {fl}, CASE WHEN len({w}) = 3 THEN {w}[1] || ' ' || {w}[2][1] || '. ' || {w}[3] END], list_concat(" + ", ".join(f"['{t} ' || {w}[-1], '{t} ' || canonical, '{t} ' || {fl}]" for t in X.TITLES[:5]) + ")) "
        "WHEN type = 'PERSON' THEN [canonical] ELSE [canonical, " + ", ".join(f"CASE WHEN contains(canonical, '{a}') THEN replace(canonical, '{a}', '{b}') END" for a, b in swaps) + f"] END) AS a FROM {seed} AS s) WHERE length(a) >= 5 GROUP BY doc_id, lower(a)"
    )


def propagated(texts: str, spans: str, alias: str) -> str:
    """k, type, text, s, e, canonical: known names in texts (k, doc_id, t) where no span lies yet, leftmost first, then longest."""
    split = f"(SELECT k, t, alias_lc, canonical, type, string_split(lower(t), alias_lc) AS gs FROM {texts} AS b JOIN ({alias}) AS a USING (doc_id) WHERE length(trim(t)) >= 4 AND regexp_matches(t, '[a-zA-Z]') AND contains(lower(t), alias_lc))"
    each = f"(SELECT *, unnest(range(1, len(gs))) AS i, length(alias_lc) AS n FROM {split})"
    at = f"(SELECT k, t, canonical, type, alias_lc, n, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * n)::INT AS s FROM {each})"
    word = r"'[\pL\pN\pM_]'"
    whole = f"(SELECT * FROM {at} WHERE (regexp_matches(alias_lc[1], {word}) <> coalesce(regexp_matches(t[s:s], {word}), false)) AND (regexp_matches(alias_lc[-1], {word}) <> coalesce(regexp_matches(t[s + n + 1:s + n + 1], {word}), false)))"
    ordered = f"(SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, -n, alias_lc) AS n0 FROM {whole})"
    new = "{'s': m.s, 'e': m.s + m.len, 'type': m.type, 'canonical': m.canonical, 'text': m.text}"
    rows = f"(SELECT k, s, n AS len, type, canonical, t[s + 1:s + n] AS text, n0 AS n FROM {ordered})"
    fold = _fold(rows, f"CASE WHEN acc[-1].e <= m.s THEN list_append(acc, {new}) ELSE acc END", new)
    return f"(SELECT z.k, r.type AS type, r.text AS text, r.s AS s, r.e::INT AS e, r.canonical AS canonical FROM {fold} AS z WHERE NOT EXISTS (SELECT 1 FROM {spans} AS y WHERE y.k = z.k AND greatest(y.s, r.s) < least(y.e, r.e)))"


# ---- Tokens and replacements -----------------------------------------------------------------------------------


def _hex(b: bytes) -> str:
    return f"unhex('{b.hex().upper()}')"


def token(kind: str, value: str, key: bytes) -> str:
    inner, outer = (bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C))
    return f"sha256({_hex(outer)} || unhex(sha256({_hex(inner)} || encode(upper(trim({kind})) || ':' || lower(trim({value}))))))"


def draw(name: str, low: int, high: int) -> str:
    return f"(('0x' || md5(tok[1:12] || '_0/{name}')[1:8])::BIGINT % {high - low + 1} + {low})"


def pick(name: str, pool: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in pool) + f"][{draw(name, 1, len(pool))}]"


def _fakes() -> dict[str, str]:
    """By type, the replacement of a value v with the token tok."""
    has = lambda *xs: "regexp_matches(lower(v), " + q("|".join(x.replace(".", r"\.") for x in xs)) + ")"
    loud = lambda out: f"CASE WHEN upper(v) = v AND lower(v) <> v THEN upper({out}) ELSE {out} END"
    digits = lambda name, n: " || ".join(draw(f"{name}{i}", 0, 9) for i in range(n))
    letter = lambda n: f"{q(X.LETTERS)}[{draw(n, 1, len(X.LETTERS))}]"
    title = f"regexp_extract(v, {TITLE})"
    body = f"trim(v[length({title}) + 1:])"
    given = f"CASE WHEN regexp_matches(lower({title}), '^(?:ms\\.|mrs\\.|smt\\.)') THEN {pick('given', X.POOLS['woman'])} ELSE {pick('given', X.POOLS['man'])} END"
    middle = f"CASE WHEN len(string_split_regex({body}, '\\s+')) >= 3 THEN {pick('middle', X.POOLS['middle'])} || ' ' ELSE '' END"
    trust = f"({has('trust')} AND NOT {has('limited', 'ltd', 'llp')})"
    suffix = f"CASE WHEN {has('private limited')} THEN 'Private Limited' WHEN {has('pvt. ltd.', 'pvt ltd')} THEN 'Pvt. Ltd.' WHEN {has('limited')} THEN 'Limited' WHEN {has('ltd')} THEN 'Ltd.' WHEN {has('llp')} THEN 'LLP' WHEN {trust} THEN 'Family Trust' ELSE 'Limited' END"
    firm = f"((CASE WHEN {trust} THEN {pick('firm', X.POOLS['trust'])} ELSE {pick('firm', X.POOLS['firm'])} || ' ' || {pick('trade', X.POOLS['trade'])} END) || ' ' || ({suffix}))"
    region = "CASE " + " ".join(f"WHEN {has(*w)} THEN {q(r)}" for w, r in X.REGIONS[:-1]) + f" ELSE {q(X.REGIONS[-1][1])} END"
    near = "(contains(v, '20') AND (contains(v, '+') OR contains(v, '91')))"
    partial = f"('4012' || {digits('card', 11)})"
    total = f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (2 * {partial}[i]::INT) // 10 + (2 * {partial}[i]::INT) % 10 ELSE {partial}[i]::INT END))"
    return {
        "PERSON": loud(f"({title} || ({given}) || ' ' || ({middle}) || {pick('surname', X.POOLS['surname'])})"),
        "ORGANIZATION": loud(firm),
        "ADDRESS": loud(f"('Unit ' || {draw('unit', 10, 999)} || ', Floor ' || {draw('floor', 1, 25)} || ', ' || ({region}))"),
        "EMAIL": f"(CASE WHEN {has('cs')} THEN 'cs.compliance' WHEN {has('compliance', 'connect')} THEN 'compliance' ELSE {pick('user', X.POOLS['user'])} END) || '.' || tok[1:8] || '@{X.MAIL_DOMAIN}'",
        "PHONE": f"CASE WHEN {near} THEN CASE WHEN contains(v, '+ ') THEN '+ 91 20 ' ELSE '+91 20 ' END || {draw('near', 4000, 4999)} || ' ' || {draw('line', 1000, 9999)} ELSE '+91 98' || {digits('mobile', 8)} END",
        "SSN_TAX_ID": f"CASE WHEN contains(v, '-') AND length(v) = 11 THEN {draw('area', 100, 665)} || '-' || {draw('group', 10, 99)} || '-' || {draw('serial', 1000, 9999)} WHEN regexp_matches(v, '^\\d{{8}}$') THEN '0' || {draw('din', 1000000, 9999999)} ELSE {letter('a')} || {letter('b')} || {letter('c')} || 'PH' || {draw('pan', 1000, 9999)} || {letter('e')} END",
        "DATE_OF_BIRTH": f"lpad({draw('day', 1, 28)}::VARCHAR, 2, '0') || ' ' || {pick('month', X.POOLS['month'])} || ' ' || {draw('year', 1965, 1995)}",
        "CREDIT_CARD": f"{partial}[1:4] || ' ' || {partial}[5:8] || ' ' || {partial}[9:12] || ' ' || {partial}[13:15] || ((10 - {total} % 10) % 10)",
        "IP_ADDRESS": f"'198.51.100.' || {draw('host', 1, 250)}",
    }


FAKES = _fakes()
FAKE = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FAKES.items()) + " ELSE '[REDACTED_' || type || ']' END"


def pseudonyms(values: str, key: bytes) -> str:
    """scope, token, type, value, pseudonym, turn of the values (scope, type, text), distinct within a scope."""
    each = f"(SELECT scope, upper(trim(type)) AS type, tok, min(trim(text)) AS v FROM (SELECT *, {token('type', 'text', key)} AS tok FROM {values} AS a WHERE type IS NOT NULL AND text IS NOT NULL) GROUP BY scope, upper(trim(type)), tok)"
    turned = f"(SELECT *, row_number() OVER (PARTITION BY scope, type, p ORDER BY tok) AS turn FROM (SELECT *, {FAKE} AS p FROM {each}))"
    numbered = "CASE WHEN turn = 1 THEN p WHEN type = 'EMAIL' THEN string_split(p, '@')[1] || '.' || turn || '@' || string_split(p, '@')[-1] ELSE p || ' ' || turn END"
    return f"(SELECT scope, tok AS token, type, v AS value, {numbered} AS pseudonym, turn::INT AS turn FROM {turned})"


def redacted(texts: str, spans: str, key: bytes) -> str:
    """k, n, redacted: texts with disjoint spans replaced, every text a scope of its own."""
    tokened = f"(SELECT *, {token('type', 'text', key)} AS token FROM {spans} AS u)"
    known = pseudonyms(f"(SELECT k AS scope, type, text FROM {spans} AS v0)", key)
    parts = f"(SELECT x.k, s, e, pseudonym, coalesce(lag(e) OVER (PARTITION BY x.k ORDER BY s), 0) AS last FROM {tokened} AS x JOIN {known} AS y ON x.k = y.scope AND x.token = y.token)"
    joined = f"(SELECT k, count(*) AS n, string_agg(t[last + 1:s] || pseudonym, '' ORDER BY s) AS head, max(e) AS last FROM {parts} JOIN {texts} AS w USING (k) GROUP BY k)"
    return f"(SELECT k, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN t ELSE head || t[last + 1:] END AS redacted FROM {texts} AS b LEFT JOIN {joined} AS h USING (k))"


# ---- Evaluation ------------------------------------------------------------------------------------------------

GOLD = "(SELECT id AS k, coalesce(x.label, '') AS label, x.\"start\" AS s, x.\"end\" AS e FROM (SELECT id, unnest(ents) AS x FROM (SELECT id, any_value(entities) AS ents FROM synthetic_benchmark WHERE entities IS NOT NULL GROUP BY id)))"


def outcomes(pred: str, gold: str) -> str:
    """config, k, label, s, e, outcome of predictions and gold spans with a config each."""
    copy = "row_number() OVER (PARTITION BY config, k, s, e, label) AS c"
    return (
        f"(SELECT coalesce(p.config, g.config) AS config, coalesce(p.k, g.k) AS k, coalesce(p.label, g.label) AS label, coalesce(p.s, g.s) AS s, coalesce(p.e, g.e) AS e, CASE WHEN p.k IS NOT NULL AND g.k IS NOT NULL THEN 'tp' WHEN p.k IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome "
        f"FROM (SELECT *, {copy} FROM {pred} AS a) AS p FULL JOIN (SELECT *, {copy} FROM {gold} AS b) AS g ON p.config = g.config AND p.k = g.k AND p.s = g.s AND p.e = g.e AND p.label = g.label AND p.c = g.c)"
    )


def _rates() -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
    np, nr = p.replace("tp", "relaxed_tp"), r.replace("tp", "relaxed_tp")
    f1 = lambda a, b: f"CASE WHEN ({a}) + ({b}) > 0 THEN 2 * ({a}) * ({b}) / (({a}) + ({b})) ELSE 0.0 END"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round({f1(p, r)}, 4) AS f1, round({f1(np, nr)}, 4) AS relaxed_f1"


def per_class(pred: str, gold: str, classes: tuple[str, ...], configs: tuple[str, ...] = ("all",)) -> str:
    names = f"(SELECT config, unnest([{', '.join(q(c) for c in classes)}]) AS label FROM (SELECT unnest([{', '.join(q(c) for c in configs)}]) AS config))"
    near = f"(SELECT o.config, o.label, outcome, outcome = 'fp' AND EXISTS (SELECT 1 FROM {gold} AS g WHERE g.config = o.config AND g.k = o.k AND g.label = o.label AND greatest(g.s, o.s) < least(g.e, o.e)) AS near FROM {outcomes(pred, gold)} AS o)"
    counts = f"(SELECT config, label, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'tp' OR near) AS relaxed_tp FROM {names} AS c LEFT JOIN {near} USING (config, label) GROUP BY config, label)"
    return f"SELECT config, label, tp, fp, fn, relaxed_tp, {_rates()}, tp + fn AS support FROM {counts} AS n"


def overall(classes: str, texts: str) -> str:
    macro = ", ".join(f"round(coalesce(avg({c}) FILTER (support > 0 OR fp > 0), 0), 4) AS macro_{c}" for c in ("precision", "recall", "f1", "relaxed_f1"))
    tokens = f"(SELECT sum(len(list_filter(string_split_regex(t, {q(BLANK)}), lambda x: x <> '')))::BIGINT FROM {texts} AS r) AS tokens"
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("tp", "fp", "fn", "relaxed_tp"))
    return f"SELECT *, {_rates()}, round((tp + greatest(0, tokens - tp - fp - fn)) / tokens, 4) AS accuracy FROM (SELECT config, {sums}, {macro}, {tokens} FROM ({classes}) GROUP BY config)"
