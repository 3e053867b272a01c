"""Postal addresses of one location, written differently (problem 6).

Addresses are parsed into components and passed several times through sorted neighbourhoods, each pass ordering
them by another sequence of components; neighbours in a window are compared by scores that tolerate typos and
swapped letters, with strict checks of house number and its letter. The house number partitions every
pass, as a strict component has to agree anyway, and so sorts run in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmask.llm.cluster import components, within
from spanmask.llm.names import plain
from spanmask.sources.lineage import cut

#: Rows after each row of a pass that it is compared with. It matters for typos only: spellings of one street and city
#: stand in a row in the first pass, each of them the same place as the next, so a run of any length is linked whole.
WINDOW = 12
#: Letters of a pass's leading component that, with number and letter, make a partition; typos in them are met in other passes.
LEAD = 2
# Kinds of street with their abbreviations, renamed cities, states and countries.
STREETS = {
    "road": "road rd", "street": "street st str", "avenue": "avenue ave av", "lane": "lane ln", "marg": "marg mg", "drive": "drive dr", "boulevard": "boulevard blvd", "way": "way", "path": "path", "highway": "highway hwy", "court": "court ct", "place": "place pl", "square": "square sq", "nagar": "nagar", "circle": "circle cir", "terrace": "terrace ter", "crescent": "crescent cres", "close": "close", "park": "park", "gardens": "gardens gdns", "colony": "colony", "layout": "layout", "chowk": "chowk", "salai": "salai", "gali": "gali",
    "row": "row", "alley": "alley", "parkway": "parkway pkwy", "bazaar": "bazaar bazar",
}
KIND = {a: k for k, names in STREETS.items() for a in names.split()}
BEFORE = {"main": "main", "mn": "main", "cross": "cross", "x": "cross", "crs": "cross"}
RENAMED = dict(p.split("=") for p in "bombay=mumbai poona=pune bangalore=bengaluru calcutta=kolkata madras=chennai cochin=kochi baroda=vadodara trivandrum=thiruvananthapuram mysore=mysuru gurgaon=gurugram banaras=varanasi benares=varanasi allahabad=prayagraj".split())
COUNTRIES = "india bharat usa u.s.a united states of america us".split()
STATES = (
    "andhra pradesh;arunachal pradesh;assam;bihar;chhattisgarh;delhi;goa;gujarat;haryana;himachal pradesh;jharkhand;karnataka;kerala;madhya pradesh;maharashtra;manipur;meghalaya;mizoram;nagaland;odisha;orissa;punjab;rajasthan;sikkim;tamil nadu;tamilnadu;telangana;tripura;uttar pradesh;uttarakhand;west bengal;"
    "alabama;alaska;arizona;arkansas;california;colorado;connecticut;delaware;florida;georgia;hawaii;idaho;illinois;indiana;iowa;kansas;kentucky;louisiana;maine;maryland;massachusetts;michigan;minnesota;mississippi;missouri;montana;nebraska;nevada;new hampshire;new jersey;new mexico;new york;north carolina;north dakota;ohio;oklahoma;oregon;pennsylvania;rhode island;south carolina;south dakota;tennessee;texas;utah;vermont;virginia;washington;west virginia;wisconsin;wyoming"
).split(";")
CODES = "ap ar as br cg dl ga gj hr hp jh ka kl mp mh mn ml mz nl od pb rj sk tn ts tg tr up uk wb al ak az ca co ct de fl hi id il in ia ks ky la me md ma mi ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tx ut vt va wa wv wi wy".split()
_STATE = re.compile(rf"\b(?:{'|'.join(s.replace(' ', r'\s+') for s in STATES)})\b")
_FLOOR = re.compile(r"\b(?:\d{1,2}(?:st|nd|rd|th)?|[ivx]{1,4}|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|ground|g|top|upper|lower)\s+(?:floor|flr|fl)\b\.?")
_UNIT = re.compile(r"(?:\b(?:suite|ste|apt|apartment|room|rm)\.?\s*#?|#)\s*(\d+\s?[a-z]?)\b")
_PIN = re.compile(r"\b(\d{3})\s?(\d{3})\b(?!\s*[-/]?\s*[a-z]?,?\s*[a-z]+\s+(?:road|rd|street|st|avenue|ave|lane|ln|marg|mg)\b)|\b(\d{5})(?:-\d{4})?\s*(?:,?\s*(?:usa|us|u\.s\.a\.?|united states.*))?\s*$")
_TYPE = "|".join(sorted(KIND, key=len, reverse=True))
_NUMBER = r"(?:\b(?:plot|house|h|door|d|flat|unit|no|survey|s|shop|office|block|gate)\.?\s*(?:no\.?)?\s*:?\s*|#\s*|\b)(\d+)\s?(?:[-/]\s?)?([a-z])?\b[\s,.]+"
_HOUSE = re.compile(rf"{_NUMBER}((?:[a-z][a-z'.]*\s+){{1,6}}?)((?:{'|'.join(BEFORE)})\.?\s+)?({_TYPE})\b\.?")
#: A street that is named by its kind only.
_KIND_ONLY = re.compile(rf"{_NUMBER}()()({_TYPE})\b\.?(?=\s*(?:,|-|\d|$))")
#: Where no kind of street follows: the kind before the name, as in the Romance languages, or a name up to a comma before a place.
BEFORE_NAME = {"rue": "rue", "via": "via", "calle": "calle", "rua": "rua", "avenida": "avenue", "chemin": "chemin", "place": "place", "plaza": "plaza"}
_LED = re.compile(rf"\b(\d+)\s?(?:[-/]\s?)?([a-z])?\b[\s,.]+(?:({'|'.join(BEFORE_NAME)})\s+)((?:[a-z][a-z'.]*\s*){{1,6}})(?=,|$)|\b(?:({'|'.join(BEFORE_NAME)})\s+)((?:[a-z][a-z'.]*\s*){{1,6}}),?\s*(\d+)\s?([a-z])?\b(?=,|$)")


def parse(text: str | None) -> tuple[str, str, str, str, str, str, str] | None:
    """(number, letter, street, kind of street, city, pin, unit), or None for what isn't an address with street and number."""
    if not text:
        return None
    t = re.sub(r"\s+", " ", plain(text).lower())
    if not any(c.isdigit() for c in t):
        return None
    t = _FLOOR.sub(" , ", t)
    if m := _HOUSE.search(t) or _KIND_ONLY.search(t):
        number, letter, street, before, kind = m[1], m[2] or "", re.sub(r"[^a-z]+", "", m[3]), BEFORE.get((m[4] or "").strip(" ."), ""), KIND[m[5]]
        if not street:  # the kind is the name
            street = kind
    elif m := _LED.search(t):
        number, letter, before, street, kind = m[1] or m[7], m[2] or m[8] or "", "", re.sub(r"[^a-z]+", "", m[4] or m[6]), BEFORE_NAME[m[3] or m[5]]
    else:
        return None
    number = number.lstrip("0") or "0"
    rest = t[m.end() :]
    pin = ""
    if p := _PIN.search(rest):
        pin = (p[1] or "") + (p[2] or "") + (p[3] or "")
        rest = rest[: p.start()] + " " + rest[p.end() :]
    unit = u[1].replace(" ", "") if (u := _UNIT.search(rest)) else ""
    rest = _UNIT.sub(" ", rest)
    rest = _STATE.sub(" ", rest)
    words = [w for w in re.split(r"[^a-z]+", rest) if w and w not in COUNTRIES and not (w in CODES and len(w) == 2)]
    city = RENAMED.get(words[-1], words[-1]) if words else ""
    return number, letter, street, f"{before} {kind}".strip(), city, pin, unit


def same_place(a: tuple, b: tuple, seen_a: int = 1, seen_b: int = 1) -> bool:
    """Number and letter strictly, street and city within typos; a part that is missing on one side doesn't count.

    Streets of nearly one name that are both written often (seen: over all addresses) are different streets; two
    letters may differ only between rare spellings with the same postal code.
    """
    (na, la, sa, ka, ca, pa, _), (nb, lb, sb, kb, cb, pb, _) = a, b
    if na != nb or la != lb or not sa or not sb:
        return False
    if sa != sb:
        few, many = sorted((seen_a, seen_b))
        far = within(sa, sb, 2)
        if min(len(sa), len(sb)) < 4 or few > max(2, many // 3) or far > (2 if pa and pa == pb and few <= 2 and min(len(sa), len(sb)) > 5 else 1):
            return False
    if ka and kb and ka != kb and not (ka.endswith(kb) or kb.endswith(ka)):
        return False
    if pa and pb and pa == pb:
        return True
    if ca and cb:
        k = 2 if min(len(ca), len(cb)) > 5 else 1
        return within(ca, cb, k) <= k
    return not (pa and pb and within(pa, pb, 1) > 1)


FIELDS = ("number", "letter", "street", "kind", "city", "pin", "unit")
#: The orders of the passes: component sequences, the strict ones being the partition.
PASSES = (("street", "kind", "city", "pin"), ("backwards", "city", "pin"), ("city", "street", "pin"), ("pin", "street", "city"), ("consonants", "pin", "city"), ("inner", "city", "pin"))


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(e, *p) for e, t in zip(pdf["_e"], pdf["_t"]) if (p := parse(t)) is not None]
        yield pd.DataFrame(rows, columns=["_e", *FIELDS])


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        a, b = pdf[[*FIELDS]].itertuples(index=False), pdf[[f"{c}_o" for c in FIELDS]].itertuples(index=False)
        yield pdf.loc[[same_place(tuple(x), tuple(y), n, m) for x, y, n, m in zip(a, b, pdf["seen"], pdf["seen_o"])], ["_n", "_o"]]


def locations(df: DataFrame, entity: str, text: str) -> DataFrame:
    """(entity, cluster): the location of every mention that is an address with a street and a number.

    Null and empty texts and those of another make have no rows; repeated rows (same entity) count once;
    equal spellings are compared once, whatever their number; columns besides the two aren't read. A street without
    city joins any city only if all spellings agree in one.
    """
    rows = df.select(F.col(entity).cast("string").alias("_e"), F.col(text).alias("_t")).where(F.col("_t").rlike(r"\d") & F.col("_e").isNotNull()).dropDuplicates(["_e"])
    strings = ", ".join(f"{c} string" for c in FIELDS)
    mentions = cut(rows.mapInPandas(_parsed, f"_e string, {strings}").withColumn("_n", F.unhex(F.md5(F.concat_ws("|", *FIELDS[:-1])))))
    once = mentions.groupBy("_n").agg(*(F.min(c).alias(c) for c in FIELDS))
    spelled = cut(once.join(once.groupBy("street").agg(F.count("*").alias("seen")), "street"))
    keyed = spelled.withColumns({"backwards": F.reverse("street"), "consonants": F.regexp_replace("street", "(?<!^)[aeiouhy]", ""), "inner": F.substring("street", 3, 20)})
    links = None
    for order in PASSES:
        # The first letters of the leading component split numbers that many addresses share.
        w = Window.partitionBy("number", "letter", F.substring(order[0], 1, LEAD)).orderBy(*order, "_n")
        near = keyed.select("_n", F.collect_list("_n").over(w.rowsBetween(1, WINDOW)).alias("_after")).select("_n", F.explode("_after").alias("_o"))
        links = near if links is None else links.unionByName(near)
    pairs = links.select(F.least("_n", "_o").alias("_n"), F.greatest("_n", "_o").alias("_o")).distinct()
    wide = pairs.join(spelled, "_n").join(spelled.select(F.col("_n").alias("_o"), *(F.col(c).alias(f"{c}_o") for c in (*FIELDS, "seen"))), "_o")
    same = cut(wide.mapInPandas(_kept, "_n binary, _o binary"))
    # Spellings with city or pin make the clusters; those without join one only.
    known = spelled.select("_n", ((F.col("city") != "") | (F.col("pin") != "")).alias("_full"))
    told = same.join(known, "_n").join(known.select(F.col("_n").alias("_o"), F.col("_full").alias("_full_o")), "_o")
    roots = components(told.where("_full = _full_o"), "_n", "_o")
    own = cut(known.join(roots.withColumnRenamed("node", "_n"), "_n", "left").select("_n", "_full", F.coalesce("root", "_n").alias("root")))
    loose = told.where("_full <> _full_o").select(F.when(F.col("_full"), F.col("_o")).otherwise(F.col("_n")).alias("_n"), F.when(F.col("_full"), F.col("_n")).otherwise(F.col("_o")).alias("_o"))
    to = loose.join(own.select(F.col("_n").alias("_o"), F.col("root").alias("_to")), "_o").join(own.select("_n", "root"), "_n").groupBy("root").agg(F.min("_to").alias("_lo"), F.max("_to").alias("_hi")).where("_lo = _hi")
    final = own.join(to, "root", "left").select("_n", F.coalesce("_lo", "root").alias("cluster"))
    return mentions.join(final, "_n").select(F.col("_e").alias(entity), "cluster")
