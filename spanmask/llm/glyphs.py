"""One form for text that prints the same (problem 2).

The operator explodes texts to positioned code points (runs of ASCII travel as one piece), joins them
with a broadcast table of decompositions and look-alikes, rebuilds the strings in the same partition,
and orders and recomposes combining marks by their canonical class.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.sources.lineage import cut

# Letters of other alphabets with the shape of a Latin letter, in pairs.
CYRILLIC = "АA ВB ЕE НH ІI ЈJ КK МM ОO РP СC ТT ХX ЅS ҮY аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϳj ρp"
LATIN = "ɑa ɡg"
#: Kinds of blank besides U+0020 and of hyphen besides U+002D.
BLANKS = "\t               　"
HYPHENS = "‐‑﹣－"
#: Compatibility tags whose characters keep their look; the others (super, fraction, circle, ...) print differently.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Ranges of <compat> characters that keep their look: digraphs, radicals, ligatures.
COMPAT = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0xFB00, 0xFB17))
#: Code points that can have another form: all but ASCII, unified ideographs, Hangul syllables, surrogates and private use.
BLOCKS = ((0, 0x20), (0x7F, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0))


def _visible_form(ch: str) -> str:
    """The decomposed form of one code point in which equal looks are equal; empty for invisible characters."""
    cat = unicodedata.category(ch)
    if ch in BLANKS:
        return " "
    if ch in HYPHENS:
        return "-"
    if cat == "Cf" or ch == "\r" or "︀" <= ch <= "️" or ch in "͏ᅟᅠㅤ឴឵":
        return ""
    tag, _, rest = (d := unicodedata.decomposition(ch)).partition(" ")
    if d and not tag.startswith("<"):
        rest = d
    elif not (tag in SAME_LOOK or tag == "<compat>" and any(a <= ord(ch) <= b for a, b in COMPAT)):
        return ch
    return "".join(_visible_form(chr(int(x, 16))) for x in rest.split())


@lru_cache(1)
def table() -> dict[str, str]:
    """Every code point whose form differs from itself; its size is bounded by Unicode (about 8,000 rows)."""
    alike = {p[0]: p[1] for p in f"{CYRILLIC} {GREEK} {LATIN}".split()}
    out = {}
    for cp in chain(*(range(a, b) for a, b in BLOCKS)):
        ch = chr(cp)
        form = "".join(alike.get(x, x) for x in _visible_form(ch))
        if form != ch:
            out[ch] = form
    return out


@lru_cache(1)
def _translation() -> dict[int, str]:
    return str.maketrans(table())


def fold(text: str) -> str:
    """The same form for one Python string; other operators use it on single texts."""
    if text.isascii():
        return text.translate({9: " ", 13: None}) if "\t" in text or "\r" in text else text
    return unicodedata.normalize("NFC", text.translate(_translation()))


def mapping(spark: SparkSession) -> DataFrame:
    t = table()
    return spark.createDataFrame(pd.DataFrame({"_p": list(t), "_f": list(t.values())}))


def _recompose(text: Column) -> Column:
    """Canonical order of marks by class, then composition; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return F.pandas_udf(run, "string")(text)


def visible(text: Column) -> Column:
    """True for texts with at least one character that prints; null counts as not visible."""
    return F.coalesce(text.rlike(r"[^\p{Z}\p{Cf}\p{Cc}͏ᅟᅠㅤ]"), F.lit(False))


def unify(df: DataFrame, key: str, text: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, form) and the columns of ``keep``: one row for each row of ``df``, whose ``key`` must be unique.

    Texts that print alike get equal forms. A null text has a null form, an empty one or one of invisible
    characters an empty form. Blanks inside are kept one by one, as their number shows; blanks at either end don't show
    and go. Other columns, whatever their names, aren't read. Where ``df`` is already partitioned by ``key``, nothing is shuffled.
    """
    extra = list(keep or {})
    base = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), *(c.alias(n) for n, c in (keep or {}).items()))
    odd = F.coalesce(F.col("_t").rlike(r"[^\x20-\x7e\n]"), F.lit(False))
    plain = base.where(~odd).select("_k", *extra, F.col("_t").alias("_form"))
    exploded = base.where(odd).select("_k", *extra, F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?s)[\x20-\x7e\n]+|."), 0)).alias("_i", "_p"))
    rebuilt = (
        exploded.join(F.broadcast(mapping(df.sparkSession)), "_p", "left")
        .groupBy("_k", *extra)
        .agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_f", "_p").alias("_f")))).alias("_a"))
        .select("_k", *extra, F.array_join(F.transform("_a", lambda x: x["_f"]), "").alias("_s"))
    )
    marks = F.col("_s").rlike(r"[^\x00-\x7f]")
    composed = rebuilt.select("_k", *extra, F.coalesce(_recompose(F.when(marks, F.col("_s"))), "_s").alias("_form"))
    return plain.unionByName(composed).select(F.col("_k").alias(key), *extra, F.trim("_form").alias("form"))


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _c, _r): each different row with visible text, the hash of its one form and that of its spelling."""
    one = df.select(F.col(key), F.col(text)).where(visible(F.col(text)) & F.col(key).isNotNull()).dropDuplicates([key])
    forms = unify(one, key, text, {"_r": F.unhex(F.md5(F.col(text)))})
    return forms.select(F.col(key).alias("_k"), F.unhex(F.md5("form")).alias("_c"), "_r")


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id): a row for each different row with visible text; rows that print alike have one class, spelled alike or not.

    Nothing is joined, so a class of any size costs its rows.
    """
    return _hashed(df, key, text).select(F.col("_k").alias(key), F.lower(F.hex("_c")).alias("class_id"))


def alike(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of different rows that print alike but differ in code points.

    Repeated rows (same key) count once; rows without visible text make no pairs. Groups are first reduced to
    their different spellings, and only groups with several are expanded to rows, so that a text repeated any
    number of times costs no more than its rows; texts are compared by 128-bit hashes.
    """
    hashed = cut(_hashed(df, key, text))
    spread = hashed.groupBy("_c").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi")).where("_lo <> _hi").select("_c")
    few = hashed.join(spread, "_c", "left_semi")
    kinds = few.select("_c", "_r").distinct()
    a = kinds.select("_c", F.col("_r").alias("_ra"))
    b = kinds.select("_c", F.col("_r").alias("_rb"))
    pairs = a.join(b, "_c").where("_ra < _rb").select("_ra", "_rb")
    ka, kb = few.select(F.col("_r").alias("_ra"), F.col("_k").alias("_ka")), few.select(F.col("_r").alias("_rb"), F.col("_k").alias("_kb"))
    full = pairs.join(ka, "_ra").join(kb, "_rb")
    return full.select(F.least("_ka", "_kb").alias(f"{key}_a"), F.greatest("_ka", "_kb").alias(f"{key}_b"))
