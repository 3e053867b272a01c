"""Validators: boolean columns over candidate values. A null value gives null or false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmask.functions import lexicon as X


def luhn(value: Column) -> Column:
    """A card number by its checksum: 13 to 19 digits after blanks and hyphens go, not all the same."""
    digits = F.regexp_replace(value, r"[\s-]", "")
    return digits.rlike(r"^\d{13,19}$") & ~digits.rlike(r"^(\d)\1+$") & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def ip_address(value: Column) -> Column:
    """Four octets without leading zeros, or eight groups of hexadecimal digits."""
    return value.rlike(rf"^(?:{X.OCTET}\.){{3}}{X.OCTET}$") & ~value.rlike(r"(?:^|\.)0\d") | value.rlike(r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$")


def email_address(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return low.rlike(r"^[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+$") & ~low.contains("..") & ~low.endswith(".") & (F.length(F.element_at(F.split(low, r"\."), -1)) >= 2)


def us_ssn(value: Column) -> Column:
    return F.regexp_replace(value, r"\s+", "").rlike(r"^(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def indian_pan(value: Column) -> Column:
    return F.upper(F.trim(value)).rlike(r"^[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]$")


def phone_number(value: Column) -> Column:
    """7 to 15 digits that fit the dialling plan of their country, or the mobile forms of the home country.

    The plan covers the country codes of ``lexicon.DIALLING``; it stands in for a full numbering library.
    """
    v = F.trim(value)
    digits = F.regexp_replace(v, r"\D", "")
    n = F.length(digits)
    foreign = F.regexp_replace(digits, "^00", "")
    plans = "|".join(f"{code}(?:{plan})" for code, plan in X.DIALLING.items())
    abroad = v.rlike(r"^(?:\+|00)") & foreign.rlike(f"^(?:{plans})$")
    mobile = (n == 10) & digits.rlike("^[6-9]") | (n == 12) & digits.rlike("^91[6-9]")
    landline = v.rlike(r"^0\d{2,4}[-\s]?\d{6,8}$") & n.between(10, 11)
    return ~v.rlike("[₹$€£%]") & n.between(7, 15) & (abroad | mobile | landline)


#: Formats of dates, tried in this order.
DATE_FORMATS = ("d/M/y", "M/d/y", "y-M-d", "d-M-y", "d MMMM y", "d MMM y", "MMMM d, y", "MMM d, y", "d MMMM, y", "d MMM, y", "y/M/d")


def birth_date(value: Column, today: Column | None = None) -> Column:
    """The date that a value writes, if its year lies between 1910 and this year; else null."""
    year = F.year(F.current_date() if today is None else today)
    dates = [F.try_to_timestamp(F.trim(value), F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(*(F.when(F.year(d).between(1910, year), d) for d in dates))
