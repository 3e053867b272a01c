"""Detectors of identifiers: text column to array of spans, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmask.functions import checks, lexicon as X
from spanmask.functions.spantext import NO_SPANS, SPANS, matches, rtrimmed, span, window

SOURCE = "regex_detector"


def _emit(text: Column, pattern: str, kind: str, confidence: float, keep: Callable[[Column, Column], Column], cheap: Column | None = None, shape: Callable[[Column], Column] | None = None, sub_type: str | None = None) -> Column:
    """Matches, reshaped by ``shape``, kept by ``keep``(text, match), as spans; ``cheap`` tells texts that can't match."""
    found = matches(text, pattern)
    found = F.transform(found, shape) if shape else found
    kept = F.filter(found, lambda m: F.coalesce(keep(text, m), F.lit(False)))
    out = F.transform(kept, lambda m: span(kind, m["text"], m["start"], m["end"], confidence, SOURCE, sub_type)).cast(SPANS)
    return F.when(cheap, out).otherwise(NO_SPANS()) if cheap is not None else out


def _rtrim(m: Column, chars: str = " ,;.:") -> Column:
    value = rtrimmed(m["text"], chars)
    return F.struct(m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), value.alias("text"))


def _strip(m: Column) -> Column:
    """Blanks at both ends go, then marks at the end."""
    lead = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], r"^\s+", ""))
    value = rtrimmed(F.regexp_replace(m["text"], r"^\s+|\s+$", ""), " ,;.:")
    start = m["start"] + lead
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text"))


def _tail(m: Column, n: int) -> Column:
    return F.struct((m["end"] - n).alias("start"), m["end"].alias("end"), F.substring(m["text"], -n, n).alias("text"))


def email(text: Column) -> Column:
    return _emit(text, X.EMAIL, "EMAIL", 0.99, lambda t, m: checks.email_address(m["text"]), F.instr(text, "@") > 0, _rtrim)


def ipv4(text: Column) -> Column:
    return _emit(text, X.IPV4, "IP_ADDRESS", 0.98, lambda t, m: checks.ip_address(m["text"]))


def ipv6(text: Column) -> Column:
    return _emit(text, X.IPV6, "IP_ADDRESS", 0.98, lambda t, m: checks.ip_address(m["text"]), F.instr(text, ":") > 0)


def credit_card(text: Column) -> Column:
    return _emit(text, X.CARD, "CREDIT_CARD", 0.95, lambda t, m: checks.luhn(m["text"]))


def phone(text: Column) -> Column:
    """Numbers that aren't years, amounts, counts or codes by the words around them."""

    def keep(t: Column, m: Column) -> Column:
        before = window(t, m["start"], m["start"], 10, 0)
        after = F.lower(F.substring(t, m["end"] + 1, 15))
        year = m["text"].rlike(r"^(?:19|20)\d{2}$")
        return ~year & ~before.rlike(X.MONEY_BEFORE) & ~after.rlike(X.MONEY_AFTER) & ~F.lower(before).rlike(X.COUNT_BEFORE) & checks.phone_number(m["text"])

    return _emit(text, X.PHONE, "PHONE", 0.96, keep, text.rlike(r"\d{3}"), _strip)


def ssn(text: Column) -> Column:
    return _emit(text, X.SSN, "SSN_TAX_ID", 0.95, lambda t, m: checks.us_ssn(m["text"]), sub_type="US_SSN")


def pan(text: Column) -> Column:
    """Tax numbers that aren't part of a company's registration or tax-registration code."""

    def keep(t: Column, m: Column) -> Column:
        return checks.indian_pan(m["text"]) & ~window(t, m["start"], m["end"], 3, 10).rlike(X.CIN) & ~window(t, m["start"], m["end"], 3, 5).rlike(X.GSTIN)

    return _emit(text, X.PAN, "SSN_TAX_ID", 0.95, keep, sub_type="INDIAN_PAN")


def din(text: Column) -> Column:
    return _emit(text, X.DIN, "SSN_TAX_ID", 0.93, lambda t, m: F.lit(True), shape=lambda m: _tail(m, 8), sub_type="DIN")


#: In order of emission.
DETECTORS: dict[str, Callable[[Column], Column]] = {"email": email, "ipv4": ipv4, "ipv6": ipv6, "credit_card": credit_card, "phone": phone, "ssn": ssn, "pan": pan, "din": din}


def register(name: str, detector: Callable[[Column], Column]) -> None:
    """Adds a detector (text column to array of spans) to those that run by default; a name is replaced."""
    DETECTORS[name] = detector


def numbered(spans: Column) -> Column:
    """Spans with their order of emission."""
    return F.transform(spans, lambda s, i: s.withField("seq", i))


def identifiers(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """All spans of the named detectors (all by default), in order of emission. A null text gives an empty array."""
    some = [DETECTORS[n](text) for n in names or DETECTORS]
    return numbered(F.coalesce(F.concat(*some), NO_SPANS()))
