"""Variant spellings of the names of one person or organisation within a filing (problem 3).

Tokens that identify (a person's possible surnames, an organisation's first word) are linked by a pigeonhole segment
join: each is cut into EDITS + 1 segments, which stand in an inverted index by filing, length and segment; a token
within EDITS edits holds one of them at a shifted place. Pairs from the index are verified with a banded edit
distance. A person's given name must begin alike or be linked in the same way. Names that share an identifying
token are then compared part by part (order, initials, short forms, legal forms); full names form clusters, and shorter forms join the one cluster they can belong to.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.cluster import components, within
from spanmask.llm.glyphs import fold
from spanmask.sources.lineage import cut

EDITS = 2
#: Different names of a scope that one task compares; a larger scope is spread over tasks, with the same result.
LOCAL_NAMES = 5_000
# Titles, legal forms, abbreviations of business words, and short forms of given names.
TITLES = frozenset("mr mrs ms miss dr prof shri sri smt m herr frau sr sra mme mlle kumari adv ca cs ms/ mr/ late".split())
LEGAL = frozenset("limited ltd limted private pvt p llp inc corp corporation co company plc gmbh ag sa".split())
WORDS = dict(
    p.split("=")
    for p in "engg=engineering mfg=manufacturing tech=technologies techs=technologies technology=technologies chem=chemicals chemical=chemicals pwr=power sys=systems system=systems intl=international inds=industries ind=industries industry=industries infra=infrastructure hldgs=holdings hldg=holdings holding=holdings txtls=textiles textile=textiles fin=finance pharmaceuticals=pharma pharmaceutical=pharma log=logistics prts=ports wks=works cu=copper food=foods corpn=corporation svcs=services".split()
)
SHORT = dict(
    p.split("=")
    for p in "vicky=victoria vicki=victoria nick=nicholas theo=theodore teddy=theodore dan=daniel danny=daniel bill=william will=william billy=william sue=susan susie=susan beth=elizabeth liz=elizabeth betty=elizabeth lizzie=elizabeth sasha=alexander alex=alexander sandy=alexander peg=margaret peggy=margaret maggie=margaret meg=margaret bob=robert rob=robert bobby=robert tom=thomas tommy=thomas mike=michael mick=michael steve=stephen steven=stephen pat=patricia patty=patricia tricia=patricia kate=katherine kathy=katherine katie=katherine catherine=katherine jen=jennifer jenny=jennifer greg=gregory ed=edward eddie=edward ned=edward rick=richard dick=richard rich=richard pepe=jose venky=venkatesh harsh=harshad sid=siddharth mohd=mohammed mohammad=mohammed muhammad=mohammed meena=meenakshi mini=meenakshi leila=leela chander=chandra kittu=krishna krish=krishna bijoy=vijay eshwar=ishwar".split()
)
# Second words of a compound ("copper works") that shorter forms leave out; particles inside long names.
SECOND = frozenset("foods works dyes ports systems".split())
PARTICLES = frozenset("de del della der den da das do dos di du la le los las van von y e i bin ibn bint al el ul ur".split())
BUSINESS = frozenset(WORDS.values()) | {"works", "foods", "agro", "dyes", "ports"}
_DIGIT = re.compile(r"\d")
_INITIALS = re.compile(r"[A-Z]{2,3}")
_ACRONYM = re.compile(r"(?:[A-Z]\.?){3,6}\Z")


#: Ways to write one sound in transliterated names, longer ones first.
_SOUNDS = (("ee", "i"), ("oo", "u"), ("aa", "a"), ("ai", "e"), ("sh", "s"), ("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ck", "k"), ("w", "v"), ("y", "i"), ("q", "k"))


@lru_cache(200_000)
def sound(word: str) -> str:
    """A given name as it sounds: one letter for each sound, none twice in a row."""
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def diminutive(short: str, name: str) -> bool:
    """Whether a name is shortened to its beginning with u, y or ie behind it: Dinu of Dinesh, Danny of Daniel."""
    m = re.fullmatch(r"([a-z]{2,}?([a-z]))\2?(?:u|y|ie)", short)
    return bool(m) and len(m[1]) >= 3 and len(name) > len(m[1]) + 1 and name.startswith(m[1])


def plain(text: str) -> str:
    """Folded, without accents."""
    if text.isascii():
        return fold(text)
    return "".join(c for c in unicodedata.normalize("NFD", fold(text)) if not unicodedata.combining(c))


@lru_cache(100_000)
def parse(text: str | None) -> tuple[str, list[str], str] | None:
    """(kind, parts, legal form) of a name, or None for what can't be one.

    Kinds: P person, O organisation of several words, A acronym, W single word. A person's parts are in the order given name,
    middle names, surname where a comma shows the order; otherwise as they stand.
    """
    if not text:
        return None
    t = plain(text).strip(" .,;:()\"'")
    if not t or _DIGIT.search(t) or "@" in t or not any(c.isalpha() for c in t) or re.search(r"\[at\]|\(at\)|\bAT\b.*\bDOT\b", t):
        return None
    compact = re.sub(r"\s", "", t)
    if _ACRONYM.match(compact) and (" " not in t.strip()):
        return "A", [compact.replace(".", "").lower()], ""
    firm = bool(re.match(r"(?i)m/s\.?\s", t)) or bool(re.search(r"[&]", t))
    t = re.sub(r"(?i)^m/s\.?\s+", "", t)
    t = re.sub(r"(?i)\bl\.\s?l\.\s?p\.?", "LLP", t)
    t = re.sub(r"(?i)\(p\)", " pvt ", t)
    comma = [x.strip() for x in t.split(",")]
    words = [w for w in re.split(r"[\s.,&/()]+", t) if w and not (len(w) < 5 and set(w.lower()) == {"a", "n", "d"})]
    low = [w.lower() for w in words]
    while low and low[0] in TITLES and len(low) > 1:
        low.pop(0)
        words.pop(0)
    if not low:
        return None
    legal = "llp" if "llp" in low else "ltd" if any(w in ("limited", "ltd", "limted") for w in low) else ""
    core = [WORDS.get(w, w) for w in low if w not in LEGAL or len(w) == 1]
    if firm or legal or any(w in BUSINESS for w in core[1:]):
        core = [w for w in core if w not in ("p", "ms")]
        return ("O" if len(core) > 1 else "W", core, legal) if core else None
    if len(low) == 1:
        return ("W", low, "") if len(low[0]) > 3 else None
    if len(low) > 6 and not all(w[0].isupper() or w in PARTICLES for w in words):
        return None  # a sentence
    if len(comma) == 2 and comma[1]:  # surname, given names
        first = [w.lower() for w in re.split(r"[\s.]+", comma[0]) if w and w.lower().rstrip(".") not in TITLES]
        rest = [w.lower() for w in re.split(r"[\s.]+", comma[1]) if w]
        return ("P", [*rest, *first], "sorted") if first and rest else None
    upper = not any(c.islower() for c in t)
    if _INITIALS.fullmatch(words[0]) and not upper and len(words) == 2 and len(words[0]) <= 3:
        low = [*words[0].lower(), low[-1]]
    if len(low[-1]) == 1 and len(low) == 2:
        return None
    return "P", low, ""


def rank(kind: str, parts: list[str]) -> int:
    """How complete a name is: 3 full, 2 without middle name, 1 with an initial or acronym, 0 one word."""
    if kind == "W":
        return 0
    if kind == "A":
        return 1
    if kind == "O":
        return 3
    longer = [p for p in parts if len(p) > 1]
    if len(longer) < 2:
        return 1
    return 3 if len(parts) > 2 else 2


def same_word(a: str, b: str, seen: dict[str, int], short: bool = False) -> bool:
    """Whether two words are one, typed differently. Two words that are both frequent in the corpus are different."""
    if a == b:
        return True
    if short:
        a, b = SHORT.get(a, a), SHORT.get(b, b)
        if a == b or sound(a) == sound(b) or diminutive(a, b) or diminutive(b, a):
            return True
    k = 1 if min(len(a), len(b)) < 6 else 2
    if min(len(a), len(b)) < 4 or within(a, b, k) > k:
        return False
    few, many = sorted((seen.get(a, 1), seen.get(b, 1)))
    return few <= max(2, many // 3)


def same_middle(a: list[str], b: list[str], seen: dict[str, int]) -> bool:
    if not a or not b:
        return True
    return len(a) == len(b) and all(x == y or (len(x) == 1 or len(y) == 1) and x[0] == y[0] or same_word(x, y, seen, True) for x, y in zip(a, b))


def same_person(a: list[str], b: list[str], seen: dict[str, int]) -> bool:
    """Of parts with the surname last: the surname, the given name or its initial, and the middle names agree."""
    ga, gb = a[0], b[0]
    if not same_word(a[-1], b[-1], seen):
        return False
    one = len(ga) == 1 or len(gb) == 1
    given = SHORT.get(ga, ga)[0] == SHORT.get(gb, gb)[0] or ga[0] == gb[0] if one else same_word(ga, gb, seen, True)
    return given and same_middle(a[1:-1], b[1:-1], seen)


def same_firm(a: list[str], b: list[str], seen: dict[str, int]) -> bool:
    if len(a) != len(b):
        a, b = (x[:-1] if len(x) > 2 and x[-1] in SECOND else x for x in (a, b))
    if len(a) != len(b):  # a blank was lost or came in
        return abs(len(a) - len(b)) == 1 and len(b[0]) > 3 and within("".join(a), "".join(b), 1) <= 1
    return same_word(a[0], b[0], seen) and all(x == y or within(x, y, 2) <= 2 and min(len(x), len(y)) > 3 for x, y in zip(a[1:], b[1:]))


def segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of the EDITS + 1 segments of a word of n letters."""
    k = EDITS + 1
    size, extra = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        step = size + (i >= k - extra)
        out.append((at, step))
        at += step
    return out


def index_keys(w: str) -> list[tuple[int, int, str]]:
    return [(len(w), i, w[a : a + n]) for i, (a, n) in enumerate(segments(len(w))) if n]


def probe_keys(w: str) -> set[tuple[int, int, str]]:
    """Of words as long as this one or up to EDITS longer: the segments that this word would hold, at shifted places."""
    out = set()
    for n in range(len(w), len(w) + EDITS + 1):
        more = n - len(w)
        for i, (a, size) in enumerate(segments(n)):
            for shift in range(-EDITS, EDITS + 1):
                if abs(shift) <= i and abs(shift + more) <= EDITS - i or i == 1 and abs(shift) <= 1:
                    at = a + shift
                    if size and 0 <= at <= len(w) - size:
                        out.add((n, i, w[at : at + size]))
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for e, d, t in zip(pdf["_e"], pdf["_d"], pdf["_t"]):
            if (p := parse(t)) is not None:
                rows.append((e, d, p[0], p[1], p[2], rank(p[0], p[1])))
        yield pd.DataFrame(rows, columns=["_e", "_d", "kind", "parts", "form", "rank"])


_PAYLOAD = "kind string, parts array<string>, counts map<string,int>, rank int"


def block_keys(kind: str, parts: list[str]) -> list[tuple[str, str, str | None]]:
    """(identifying token, initial, given name) of a name: the initials that the rest may begin with, * for a single word, # for a firm."""
    g = parts[0]
    if kind == "P":
        given = SHORT.get(g, g)
        return [(parts[-1], i, given) for i in sorted({g[0], given[0]})] if len(parts[-1]) > 2 else []
    return [(g, "#" if kind == "O" else "*", None)] if kind in "OW" else []


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(d, n, *key, kind, parts, counts, level) for d, n, kind, parts, counts, level in zip(*(pdf[c] for c in ("_d", "_n", "kind", "parts", "counts", "rank"))) for key in block_keys(kind, list(parts))]
        yield pd.DataFrame(rows, columns=["_d", "_n", "token", "initial", "given", "kind", "parts", "counts", "rank"])


def _keys(probe: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, t, *k) for d, t in zip(pdf["_d"], pdf["token"]) for k in (probe_keys(t) if probe else index_keys(t))]
            yield pd.DataFrame(rows, columns=["_d", "token", "size", "place", "piece"])

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [same_word(a, b, {a: x, b: y}) for a, b, x, y in zip(pdf["token"], pdf["other"], pdf["seen"], pdf["seen_other"])]
        yield pdf.loc[keep, ["_d", "token", "other"]]


def token_pairs(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """(_d, token, other): equal and similar tokens of a filing, each pair in both orders."""
    shape = "_d string, token string, size int, place int, piece string"
    # Keys and words travel as 64-bit hashes; a collision only adds a pair that the check by words below turns down.
    words = cut(tokens.where(F.length("token") > 3).withColumn("_w", F.xxhash64("_d", "token")))
    key = F.xxhash64("_d", "size", "place", "piece").alias("_h")
    index = words.mapInPandas(_keys(False), shape).select(key, F.xxhash64("_d", "token").alias("_w"))
    probe = words.mapInPandas(_keys(True), shape).select(key, F.xxhash64("_d", "token").alias("_v"))
    near = index.join(probe, "_h").where("_w <> _v").select("_w", "_v").distinct()
    counted = words.join(seen, "token")
    other = counted.select(F.col("_d").alias("_o"), F.col("token").alias("other"), F.col("_w").alias("_v"), F.col("seen").alias("seen_other"))
    good = near.join(counted, "_w").join(other, "_v").where("_d = _o").mapInPandas(_verified, "_d string, token string, other string")
    back = good.select("_d", F.col("other").alias("token"), F.col("token").alias("other"))
    return good.unionByName(back).unionByName(tokens.select("_d", "token", F.col("token").alias("other"))).distinct()


def _compatible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sides = zip(*(pdf[c] for c in ("kind", "parts", "counts", "kind_o", "parts_o", "counts_o")))
        keep = [_agree(ka, list(pa), kb, list(pb), dict(ca) | dict(cb)) for ka, pa, ca, kb, pb, cb in sides]
        yield pdf.loc[keep, ["_n", "_o", "rank", "rank_o"]]


def _agree(ka: str, pa: list[str], kb: str, pb: list[str], seen: dict[str, int]) -> bool:
    if ka == kb == "P":
        return same_person(pa, pb, seen)
    if ka == kb == "O":
        return same_firm(pa, pb, seen)
    return "W" in (ka, kb)


def _alike(tokens: dict[str, int]) -> dict[str, set[str]]:
    """Of each token the equal and similar ones, by the pigeonhole index and the check by words; values are how often each is seen."""
    index = defaultdict(list)
    for t in tokens:
        if len(t) > 3:
            for key in index_keys(t):
                index[key].append(t)
    out = {t: {t} for t in tokens}
    for t in tokens:
        if len(t) > 3:
            for other in {o for key in probe_keys(t) for o in index.get(key, ())} - out[t]:
                if same_word(t, other, {t: tokens[t], other: tokens[other]}):
                    out[t].add(other)
                    out[other].add(t)
    return out


def clustered(names: list[tuple]) -> list[tuple[bytes, bytes]]:
    """(name, root) of one filing's names (name, kind, parts, counts, rank): the steps of ``_wide`` on plain tables."""
    by = {n[0]: n for n in names}
    seen = {t: c for n in names for t, c in n[3].items()}
    blocks = [(n[0], *x) for n in names for x in block_keys(n[1], n[2])]
    similar = _alike({t: seen.get(t, 1) for _, t, _, _ in blocks})
    apart = _alike({g: 1 for _, _, _, g in blocks if g is not None})
    at, wide, once = defaultdict(list), defaultdict(list), defaultdict(list)
    for n, t, initial, given in blocks:
        at[t, initial].append(n)
        if initial != "*":
            wide[t].append(n)
        if given is not None and initial == given[:1]:
            once[t, given].append(n)
    found = set()
    for n, t, initial, given in blocks:
        for other in similar[t]:
            found.update((n, o) for o in (wide[other] if initial == "*" else at[other, initial]))
            if given is not None and initial == given[:1]:
                found.update((n, o) for g in apart[given] if g[:1] != given[:1] for o in once.get((other, g), ()))
    parent = {n: n for n in by}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ups = set()
    for a, b in {(min(x), max(x)) for x in found if x[0] != x[1]}:
        (_, ka, pa, ca, ra), (_, kb, pb, cb, rb) = by[a], by[b]
        if _agree(ka, pa, kb, pb, ca | cb):
            if ra != rb:
                ups.add((a, b, ra) if ra < rb else (b, a, rb))
            elif ra >= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    calls = defaultdict(set)
    for n, kind, parts, _, _ in names:
        if kind == "O":
            letters = "".join(w[0] for w in parts)
            for call in (letters, letters + "l", letters + "pl"):
                calls[call].add(n)
    ups |= {(n, o, 1) for n, kind, parts, _, _ in names if kind == "A" for o in calls.get(parts[0], ())}
    fixed = {n[0]: root(n[0]) for n in names if n[4] == 3}
    for level in (2, 1, 0):
        to = defaultdict(set)
        for n, o, rank_ in ups:
            if rank_ == level and o in fixed:
                to[root(n)].add(fixed[o])
        for n in names:
            if n[4] == level:
                own = root(n[0])
                if len(to.get(own, ())) == 1:
                    fixed[n[0]] = next(iter(to[own]))
                elif level:
                    fixed[n[0]] = own
    return list(fixed.items())


def _in_one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of their filings; a filing may go over from one batch to the next."""
    scope, held = None, []
    for pdf in batches:
        out = []
        for d, n, kind, parts, counts, level in zip(*(pdf[c] for c in ("_d", "_n", "kind", "parts", "counts", "rank"))):
            if d != scope:
                out += clustered(held)
                scope, held = d, []
            held.append((bytes(n), kind, list(parts), dict(counts), int(level)))
        yield pd.DataFrame(out, columns=["_n", "root"])
    yield pd.DataFrame(clustered(held), columns=["_n", "root"])


def variants(df: DataFrame, entity: str, scope: str, text: str) -> DataFrame:
    """(entity, cluster): the cluster of every mention that is a name; entities come out as strings.

    Names are compared within a ``scope`` only. Null and empty texts, texts with digits, sentences and
    single words that belong to no fuller name are no names; repeated rows (same entity) count once; columns besides the
    three aren't read. A name that fits several fuller ones stays with its own spelling. A scope's different names are compared
    in one pass of one task up to LOCAL_NAMES of them; those of larger scopes are spread by their tokens, with the same result.
    """
    rows = df.select(F.col(entity).cast("string").alias("_e"), F.col(scope).cast("string").alias("_d"), F.col(text).alias("_t")).where("_t is not null and _d is not null and _e is not null").dropDuplicates(["_e"])
    parsed = cut(rows.mapInPandas(_parsed, "_e string, _d string, kind string, parts array<string>, form string, rank int").withColumn("_p", F.unhex(F.md5(F.concat_ws("|", "kind", "form", F.concat_ws(" ", "parts"))))))
    spelled = parsed.groupBy("_p").agg(*(F.min(c).alias(c) for c in ("kind", "parts", "form", "rank")), F.count_distinct("_d").alias("times"))
    # How often a part stands last, over all filings, tells surnames from given names.
    at = spelled.where("kind = 'P'").select("_p", "times", F.posexplode("parts").alias("i", "token"), F.size("parts").alias("n"))
    stands = at.groupBy("token").agg(((F.sum(F.when(F.expr("i = n - 1"), F.col("times")).otherwise(0)) + 0.5) / (F.sum("times") + 1)).alias("surely"))
    ends = at.where("i = 0 or i = n - 1").join(stands, "token").groupBy("_p").agg(F.min_by("surely", "i").alias("first"), F.max_by("surely", "i").alias("last"))
    turn = (F.col("kind") == "P") & (F.col("form") != "sorted") & (F.col("first") > F.col("last")) & ((F.length(F.element_at("parts", -1)) > 1) | (F.col("first") >= 0.5))
    parts = spelled.join(ends, "_p", "left").select("_p", F.when(turn, F.expr("concat(slice(parts, 2, size(parts)), slice(parts, 1, 1))")).otherwise(F.col("parts")).alias("parts"))
    # Names go by 128-bit hashes from here on, so that joins move little.
    mentions = cut(parsed.select("_e", "_d", "kind", "rank", "_p").join(parts, "_p").withColumn("_n", F.unhex(F.md5(F.concat_ws("|", "_d", "kind", F.concat_ws(" ", "parts"))))))
    plain_names = mentions.groupBy("_n").agg(*(F.min(c).alias(c) for c in ("_d", "kind", "parts", "rank")))
    # In how many filings a token stands, over the whole corpus.
    tokens = plain_names.select("_n", "_d", F.explode("parts").alias("token"))
    seen = tokens.groupBy("token").agg(F.count_distinct("_d").cast("int").alias("seen"))
    counts = tokens.select("_n", "token").distinct().join(seen, "token").groupBy("_n").agg(F.map_from_entries(F.collect_list(F.struct("token", "seen"))).alias("counts"))
    names = cut(plain_names.join(counts, "_n"))
    large = names.groupBy("_d").count().where(F.col("count") > LOCAL_NAMES).select("_d")
    fixed = names.join(large, "_d", "left_anti").repartition("_d").sortWithinPartitions("_d").mapInPandas(_in_one_pass, "_n binary, root binary")
    if large.limit(1).count():
        some = cut(names.join(large, "_d", "left_semi"))
        fixed = fixed.unionByName(_wide(some))
    return mentions.join(fixed, "_n").select(F.col("_e").alias(entity), F.col("root").alias("cluster"))


def _wide(names: DataFrame) -> DataFrame:
    """(_n, root) of names (_n, _d, kind, parts, counts, rank) of scopes of any size, by joins on their tokens."""
    seen = names.select(F.explode("counts").alias("token", "seen")).distinct()
    blocks = cut(names.mapInPandas(_blocks, f"_d string, _n binary, token string, initial string, given string, {_PAYLOAD}"))
    pairs = token_pairs(blocks.select("_d", "token").distinct(), seen)
    # Equal initials, or one side a single word; what the check needs travels along.
    renamed = {"_n": "_o", "token": "other"} | {c: f"{c}_o" for c in ("kind", "parts", "counts", "rank")}
    # Given names that differ in their first letter have no initial in common; how frequent they are is for the check by parts.
    given = blocks.where("given is not null").select("_d", F.col("given").alias("token")).distinct()
    apart = token_pairs(given, given.select("token").distinct().withColumn("seen", F.lit(1))).where("substring(token, 1, 1) <> substring(other, 1, 1)").select("_d", F.col("token").alias("given"), F.col("other").alias("given_o"))
    once = F.col("initial") == F.substring("given", 1, 1)
    more = blocks.where(once).drop("initial").join(pairs, ["_d", "token"]).drop("token").join(apart, ["_d", "given"]).drop("given")
    more = more.join(blocks.where(once).drop("initial").withColumnsRenamed(renamed | {"given": "given_o"}), ["_d", "other", "given_o"]).drop("given_o").where("_n < _o")
    there = blocks.drop("given").withColumnsRenamed(renamed)
    left = blocks.drop("given").join(pairs, ["_d", "token"]).drop("token")
    full = left.where("initial <> '*'").join(there, ["_d", "other", "initial"]).where("_n < _o")
    ones = left.where("initial = '*'").drop("initial").join(there.where("initial <> '*'").drop("initial"), ["_d", "other"])
    found = full.drop("initial").unionByName(ones).unionByName(more)
    checked = cut(found.mapInPandas(_compatible, "_n binary, _o binary, rank int, rank_o int").distinct())
    # Full names first: links of equal rank make clusters.
    linked = components(checked.where("rank = rank_o and rank >= 2"), "_n", "_o")
    own = cut(names.join(linked.select(F.col("node").alias("_n"), "root"), "_n", "left").select("_n", "rank", F.coalesce("root", "_n").alias("root")))
    both = checked.where("rank < rank_o").unionByName(checked.where("rank > rank_o").select(F.col("_o").alias("_n"), F.col("_n").alias("_o"), F.col("rank_o").alias("rank"), F.col("rank").alias("rank_o")))
    call = names.where("kind = 'A'").select("_d", "_n", F.element_at("parts", 1).alias("call"))
    firms = names.where("kind = 'O'").select("_d", F.col("_n").alias("_o"), F.array_join(F.transform("parts", lambda w: F.substring(w, 1, 1)), "").alias("_l"))
    calls = firms.select("_d", "_o", F.explode(F.array(F.concat("_l", F.lit("l")), F.concat("_l", F.lit("pl")), "_l")).alias("call"))
    every = both.unionByName(call.join(calls, ["_d", "call"]).select("_n", "_o", F.lit(1).alias("rank"), F.lit(3).alias("rank_o")))
    # Names already linked at a level decide together.
    up = cut(every.join(own.select("_n", "root"), "_n").select("root", "_o", "rank"))
    fixed = own.where("rank = 3").select("_n", "root")
    for level in (2, 1, 0):
        target = up.where(F.col("rank") == level).join(fixed.select(F.col("_n").alias("_o"), F.col("root").alias("_to")), "_o")
        choice = target.groupBy("root").agg(F.min("_to").alias("_lo"), F.max("_to").alias("_hi")).where("_lo = _hi").select("root", F.col("_lo").alias("_to"))
        # A single word that belongs to nothing is no name.
        got = own.where(F.col("rank") == level).join(choice, "root", "left" if level else "inner")
        fixed = cut(fixed.unionByName(got.select("_n", F.coalesce("_to", "root").alias("root"))))
    return fixed


def linked_pairs(clusters: DataFrame, entity: str) -> DataFrame:
    """Pairs (entity_a < entity_b) of the members of each cluster, as the result's definition asks for."""
    members = cut(clusters)
    several = members.groupBy("cluster").count().where("count > 1").select("cluster")
    some = members.join(several, "cluster", "left_semi")
    a, b = some.select("cluster", F.col(entity).alias(f"{entity}_a")), some.select("cluster", F.col(entity).alias(f"{entity}_b"))
    return a.join(b, "cluster").where(F.col(f"{entity}_a") < F.col(f"{entity}_b")).select(f"{entity}_a", f"{entity}_b")
