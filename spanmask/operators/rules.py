"""Rules for persons, organisations and birth dates, where no model is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmask.functions import checks
from spanmask.functions.spantext import SPANS, matches, span

SOURCE = "rule_detector"
_NAME = r"\p{Lu}[\p{L}'’]+"
#: A character before a name, which is no part of it; words that begin with a capital without being part of a firm's name.
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
NO_LETTER = r"^[^\p{L}]"
NO_FIRM = NO_LETTER + r"?(?:(?:The|Our|Company|Office) )*"
ORGANISATION = rf"{_EDGE}{_NAME}(?: (?:{_NAME}|[IVX]+|and|of|&)){{0,7}} (?:Private Limited\b|Limited\b|LLP\b|(?:Pvt\.? )?Ltd\b\.?)"
# What stands before a name, and the offices that stand behind one.
CUES = ("Mr. ", "Ms. ", "Mrs. ", "Dr. ", "Shri ", "Smt. ", "Contact Person: ", "Attn. ", "Name: ", "Employee ", "Nominee: ")
CUE = "(?:" + "|".join(c.replace(".", r"\.") for c in CUES) + ")"
OFFICES = r"CEO|CFO|CTO|COO|CS|KMP|Chair(?:man|person)|Promoter|Partner|Company Secretary|Compliance Officer|(?:[A-Z][a-z]+[- ])*Director|Chief [A-Z][a-z]+ Officer"
_PERSON_NAME = rf"{_NAME}(?: (?:\p{{Lu}}\.|{_NAME})){{1,3}}"
CUED = rf"\b{CUE}{_PERSON_NAME}"
OFFICE = rf", (?:the )?(?:{OFFICES})\b"
OFFICED = rf"{_EDGE}{_PERSON_NAME}{OFFICE}"
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} [A-Z][a-z]{2,8},? \d{4}\b|\b[A-Z][a-z]{2,8} \d{1,2}, \d{4}\b"


def _spans(found: Column, kind: str, confidence: float) -> Column:
    return F.transform(found, lambda m: span(kind, m["text"], m["start"], m["end"], confidence, SOURCE)).cast(SPANS)


def _without(found: Column, lead: str | None, trail: str | None) -> Column:
    """Matches without what a pattern takes from their beginning or end."""

    def one(m: Column) -> Column:
        body = F.regexp_replace(m["text"], lead, "") if lead else m["text"]
        start = m["end"] - F.length(body)
        value = F.regexp_replace(body, trail, "") if trail else body
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text"))

    return F.transform(found, one)


def organisation(text: Column) -> Column:
    """Capitalised words that end in a legal form, at least one before it."""
    named = _without(matches(text, ORGANISATION), NO_FIRM, None)
    return _spans(F.filter(named, lambda m: ~m["text"].rlike(r"^(?:Private Limited|Limited|LLP|Pvt\.? Ltd\.?|Ltd\.?)$")), "ORGANIZATION", 0.85)


def person(text: Column) -> Column:
    """Two to four capitalised words behind a title or a contact cue, or before an office."""
    cued, officed = _without(matches(text, CUED), f"^{CUE}", None), _without(matches(text, OFFICED), NO_LETTER, f"{OFFICE}$")
    return F.concat(_spans(cued, "PERSON", 0.85), _spans(officed, "PERSON", 0.85))


def birth_date(text: Column) -> Column:
    """Dates of a possible human age; scoring keeps those by a birth cue."""
    found = F.filter(matches(text, DATE), lambda m: checks.birth_date(m["text"]).isNotNull())
    return _spans(found, "DATE_OF_BIRTH", 0.70)
