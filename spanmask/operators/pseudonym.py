"""Keyed tokens of values, replacements that keep a value's form, and the encrypted table of originals."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmask.functions import lexicon as X
from spanmask.functions.spantext import splice

INFO = b"pii-pseudonym-derivation-v1"


def derive(master: bytes, salt: bytes) -> tuple[bytes, bytes]:
    """(key of tokens, key of the vault), 32 bytes each, by HKDF with SHA-256."""
    base = hmac.new(salt, master, hashlib.sha256).digest()
    first = hmac.new(base, INFO + b"\x01", hashlib.sha256).digest()
    return first, hmac.new(base, first + INFO + b"\x02", hashlib.sha256).digest()


def token(kind: Column, value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of type and value, hexadecimal; the case and outer blanks of a value don't matter."""
    block = key.ljust(64, b"\0") if len(key) <= 64 else hashlib.sha256(key).digest().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    message = F.encode(F.concat(F.upper(F.trim(kind)), F.lit(":"), F.lower(F.trim(value))), "UTF-8")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def seal(value: Column, key: bytes, tok: Column) -> Column:
    """nonce, ciphertext and tag of AES-256-GCM, bound to the token."""
    return F.expr("null") if value is None else F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), tok)


def unseal(payload: Column, key: bytes, tok: Column) -> Column:
    """The original, or null if payload or token is wrong."""
    return F.when(F.length(payload) >= 28, F.try_aes_decrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), tok)).cast("string")


def _number(tok: Column, salt: Column, name: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.substring(tok, 1, 12), F.lit("_"), salt.cast("string"), F.lit(f"/{name}"))), 1, 8), 16, 10).cast("bigint")


class _Draw:
    """Independent draws for one token and salt, each under a name."""

    def __init__(self, tok: Column, salt: Column) -> None:
        self.tok, self.salt = tok, salt

    def between(self, name: str, low: int, high: int) -> Column:
        return F.pmod(_number(self.tok, self.salt, name), F.lit(high - low + 1)) + low

    def pick(self, name: str, pool: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, pool)), (self.between(name, 1, len(pool))).cast("int"))

    def text(self, name: str, low: int, high: int) -> Column:
        return self.between(name, low, high).cast("string")

    def digits(self, name: str, n: int) -> Column:
        return F.concat(*(self.text(f"{name}{i}", 0, 9) for i in range(n)))


def _upper_like(value: Column, out: Column) -> Column:
    return F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(out)).otherwise(out)


def fake(kind: Column, value: Column, tok: Column, salt: Column) -> Column:
    """A replacement of the type and form of a value, drawn by its token and a salt."""
    d, v = _Draw(tok, salt), F.trim(value)
    low = F.lower(v)
    has = lambda *xs: low.rlike("|".join(x.replace(".", r"\.") for x in xs))
    title = F.regexp_extract(v, f"(?i){X.TITLE}", 0)
    woman = F.lower(title).rlike(r"^(?:ms\.|mrs\.|smt\.)")
    given = F.when(woman, d.pick("given", X.POOLS["woman"])).otherwise(d.pick("given", X.POOLS["man"]))
    body = F.trim(F.substring(v, F.length(title) + 1, F.length(v)))
    middle = F.when(F.size(F.split(body, r"\s+")) >= 3, F.concat(d.pick("middle", X.POOLS["middle"]), F.lit(" "))).otherwise(F.lit(""))
    person = F.concat(title, given, F.lit(" "), middle, d.pick("surname", X.POOLS["surname"]))
    trust = has("trust") & ~has("limited", "ltd", "llp")
    suffix = F.when(has("private limited"), "Private Limited").when(has("pvt. ltd.", "pvt ltd"), "Pvt. Ltd.").when(has("limited"), "Limited").when(has("ltd"), "Ltd.").when(has("llp"), "LLP").when(trust, "Family Trust").otherwise("Limited")
    firm = F.concat(F.when(trust, d.pick("firm", X.POOLS["trust"])).otherwise(F.concat_ws(" ", d.pick("firm", X.POOLS["firm"]), d.pick("trade", X.POOLS["trade"]))), F.lit(" "), suffix)
    end = F.lit(X.REGIONS[-1][1])
    for words, region in reversed(X.REGIONS[:-1]):
        end = F.when(has(*words), F.lit(region)).otherwise(end)
    place = F.concat(F.lit("Unit "), d.text("unit", 10, 999), F.lit(", Floor "), d.text("floor", 1, 25), F.lit(", "), end)
    # Few users share one domain, so the token's digits tell them apart inside the local part, where they keep it valid.
    user = F.when(has("cs"), F.lit("cs.compliance")).when(has("compliance", "connect"), F.lit("compliance")).otherwise(d.pick("user", X.POOLS["user"]))
    mail = F.concat(user, F.lit("."), F.substring(tok, 1, 8), F.when(salt > 0, salt.cast("string")).otherwise(F.lit("")), F.lit(f"@{X.MAIL_DOMAIN}"))
    near = v.contains("20") & (v.contains("+") | v.contains("91"))
    phone = F.when(near, F.concat(F.when(v.contains("+ "), F.lit("+ 91 20 ")).otherwise(F.lit("+91 20 ")), d.text("near", 4000, 4999), F.lit(" "), d.text("line", 1000, 9999))).otherwise(F.concat(F.lit("+91 98"), d.digits("mobile", 8)))
    letter = lambda n: F.substring(F.lit(X.LETTERS), d.between(n, 1, len(X.LETTERS)).cast("int"), F.lit(1))
    tax = (
        F.when(v.contains("-") & (F.length(v) == 11), F.concat_ws("-", d.text("area", 100, 665), d.text("group", 10, 99), d.text("serial", 1000, 9999)))
        .when(v.rlike(r"^\d{8}$"), F.concat(F.lit("0"), d.text("din", 1000000, 9999999)))
        .otherwise(F.concat(letter("a"), letter("b"), letter("c"), F.lit("PH"), d.text("pan", 1000, 9999), letter("e")))
    )
    born = F.concat(F.lpad(d.text("day", 1, 28), 2, "0"), F.lit(" "), d.pick("month", X.POOLS["month"]), F.lit(" "), d.text("year", 1965, 1995))
    partial = F.concat(F.lit("4012"), d.digits("card", 11))
    doubled = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substring(partial, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    whole = F.concat(partial, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))
    card = F.concat_ws(" ", *(F.substring(whole, i, 4) for i in (1, 5, 9, 13)))
    ip = F.concat(F.lit("198.51.100."), d.text("host", 1, 250))
    t = F.upper(kind)
    return (
        F.when(t == "PERSON", _upper_like(v, person))
        .when(t == "ORGANIZATION", _upper_like(v, firm))
        .when(t == "ADDRESS", _upper_like(v, place))
        .when(t == "EMAIL", mail)
        .when(t == "PHONE", phone)
        .when(t == "SSN_TAX_ID", tax)
        .when(t == "DATE_OF_BIRTH", born)
        .when(t == "CREDIT_CARD", card)
        .when(t == "IP_ADDRESS", ip)
        .otherwise(F.concat(F.lit("[REDACTED_"), t, F.lit("]")))
    )


def _numbered(kind: Column, value: Column, n: Column) -> Column:
    """A replacement made distinct by a number, inside the local part of an address."""
    return F.when(F.upper(kind) == "EMAIL", F.concat(F.substring_index(value, "@", 1), F.lit("."), n.cast("string"), F.lit("@"), F.substring_index(value, "@", -1))).otherwise(F.concat(value, F.lit(" "), n.cast("string")))


def pseudonyms(values: DataFrame, key: bytes, scope: str = "scope_id") -> DataFrame:
    """(scope, token, type, value, pseudonym, turn): one row for each different value of a scope.

    ``values`` has the scope, type and text. Of values of a scope that draw the same replacement, the one with the least
    token keeps it (turn 1), the others get their turn as a number. One window over (scope, type, replacement) does it: draws are
    made of several pools, so few values share one and a scope of any size is spread over tasks. Null types and texts have no row.
    """
    base = values.where("type is not null and text is not null").select(scope, F.upper(F.trim("type")).alias("type"), F.trim("text").alias("value"))
    each = base.withColumn("token", token(F.col("type"), F.col("value"), key)).groupBy(scope, "token", "type").agg(F.min("value").alias("value"))
    drawn = each.withColumn("pseudonym", fake(F.col("type"), F.col("value"), F.col("token"), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy(scope, "type", "pseudonym").orderBy("token"))
    out = drawn.withColumn("turn", turn)
    return out.withColumn("pseudonym", F.when(F.col("turn") > 1, _numbered(F.col("type"), F.col("pseudonym"), F.col("turn"))).otherwise(F.col("pseudonym"))).select(scope, "token", "type", "value", "pseudonym", "turn")


def distinct_in_text(df: DataFrame, spans: str, key: bytes, out: str) -> DataFrame:
    """``df`` with ``out``: array<struct(start, end, token, pseudonym)> of a text's spans, row by row, by the rule of ``pseudonyms``:
    equal values of a text alike, others distinct. Steps are columns of their own, so that none is worked out for each element again.
    """
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(F.trim(s["type"])).alias("type"), F.trim(s["text"]).alias("value"), token(s["type"], s["text"], key).alias("token")))
    # Of equal tokens the least spelling draws, as over documents.
    least = F.transform("_k", lambda s: s.withField("value", F.array_min(F.transform(F.filter(F.col("_k"), lambda x: x["token"] == s["token"]), lambda x: x["value"]))))
    drawn = F.transform("_l", lambda s: s.withField("drawn", fake(s["type"], s["value"], s["token"], F.lit(0))))

    def one(s: Column) -> Column:
        earlier = F.filter(F.col("_f"), lambda x: (x["type"] == s["type"]) & (x["drawn"] == s["drawn"]) & (x["token"] < s["token"]))
        turn = F.size(F.array_distinct(F.transform(earlier, lambda x: x["token"]))) + 1
        return F.struct(s["start"], s["end"], s["token"], F.when(turn > 1, _numbered(s["type"], s["drawn"], turn)).otherwise(s["drawn"]).alias("pseudonym"))

    return df.withColumn("_k", keyed).withColumn("_l", least).withColumn("_f", drawn).withColumn(out, F.transform("_f", one)).drop("_k", "_l", "_f")


def looked_up(values: DataFrame, known: DataFrame, key: bytes, scope: str = "scope_id") -> DataFrame:
    """``values`` with the pseudonym that their scope already has for them, null if none."""
    tokened = values.withColumn("token", token(F.col("type"), F.col("text"), key))
    return tokened.join(known.select(scope, "token", "pseudonym"), [scope, "token"], "left")


def vault(names: DataFrame, key: bytes) -> DataFrame:
    """(token, payload): the originals, sealed; a token of several scopes stands once."""
    return names.groupBy("token").agg(F.min("value").alias("_v")).select("token", seal(F.col("_v"), key, F.col("token")).alias("payload"))


def reveal(stored: DataFrame, key: bytes) -> DataFrame:
    return stored.select("token", unseal(F.col("payload"), key, F.col("token")).alias("value"))


def masked(text: Column, replaced: Column) -> Column:
    """The text with every span replaced; ``replaced`` as of ``distinct_in_text``."""
    return splice(text, replaced, lambda s: s["pseudonym"])
