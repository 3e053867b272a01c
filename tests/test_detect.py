import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanmask.functions import checks, lexicon as X
from spanmask.functions.spantext import matches, splice
from spanmask.operators import detect
from spanmask.operators.address import address
from spanmask.operators.score import scored
from spanmask.functions.spantext import span


def spans_of(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", fn(F.col("t")).alias("s")).orderBy("i").collect()
    return [[(x["type"], x["text"], x["start"], x["end"]) for x in r["s"] or []] for r in rows]


def test_places_count_code_points(spark):
    texts = ["😀 a@b.co x@y.org", "", None, "no match", "a@b.co"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(m["start"], m["end"], m["text"]) for m in r["m"]] for r in df.select("i", matches(F.col("t"), X.EMAIL).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(X.EMAIL, t or "")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1@. é漢😀-", max_size=40), min_size=1, max_size=8))
def test_matches_equal_a_scan(spark, texts):
    rx = r"\b[a1]+(?:@[a1]+)?"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(m["start"], m["end"]) for m in r["m"]] for r in df.select("i", matches(F.col("t"), rx).alias("m")).collect()}
    for i, t in enumerate(texts):
        if "漢" not in t and "é" not in t:
            assert got[i] == [m.span() for m in re.finditer(rx, t)]
        for a, b in got[i]:
            assert re.fullmatch(r"[a1@]+", t[a:b])


def test_email_and_addresses_of_hosts(spark):
    (got,) = spans_of(spark, detect.identifiers, "Mail a@host.com or admin@192.168.1.100. The host is 10.0.0.1, not 010.1.1.1")
    assert [g[1] for g in got if g[0] == "EMAIL"] == ["a@host.com"]
    assert "10.0.0.1" in [g[1] for g in got if g[0] == "IP_ADDRESS"]
    assert "010.1.1.1" not in [g[1] for g in got]


def test_card_needs_its_checksum(spark):
    (got,) = spans_of(spark, detect.credit_card, "cards 4012 8888 8888 1881 and 4012 8888 8888 1882 and 0000 0000 0000 0000")
    assert [g[1] for g in got] == ["4012 8888 8888 1881"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call +91 9876543210 today", ["+91 9876543210"]),
        ("Tel: 020-25531234", ["020-25531234"]),
        ("Tel: + 91 20 4505 3237;", ["+ 91 20 4505 3237"]),
        ("costs ₹ 9876543210", []),
        ("sum of 9876543210 crore", []),
        ("ticket 9876543210", []),
        ("dial +1 (212) 555-0144", ["+1 (212) 555-0144"]),
        ("+99 1234567", []),
    ],
)
def test_phone_and_its_neighbours(spark, text, want):
    assert [g[1] for g in spans_of(spark, detect.phone, text)[0]] == want


def test_tax_numbers(spark):
    text = "PAN ABCPE1234F, SSN 123-45-6789 and 000-12-3456, DIN: 01234567, CIN U12345MH2010PTC123456, GSTIN 27ABCPE1234F1Z5"
    (got,) = spans_of(spark, detect.identifiers, text)
    assert [g[1] for g in got if g[0] == "SSN_TAX_ID"] == ["123-45-6789", "ABCPE1234F", "01234567"]


def test_null_and_empty_texts_have_no_spans(spark):
    assert spans_of(spark, detect.identifiers, None, "", "   ") == [[], [], []]
    assert spans_of(spark, address, None, "") == [[], []]


def test_long_text(spark):
    text = "word " * 30_000 + "a@b.co"
    assert spans_of(spark, detect.email, text)[0] == [("EMAIL", "a@b.co", 150_000, 150_006)]


def test_anchored_address_stops_before_the_telephone(spark):
    text = "Registered Office: Plot No. 12, Sector 5, Chakan, Pune 410501, Maharashtra Tel: 020-25531234"
    (got,) = spans_of(spark, address, text)
    assert [(g[1], text[g[2] : g[3]]) for g in got] == [("Plot No. 12, Sector 5, Chakan, Pune 410501, Maharashtra",) * 2]


def test_address_back_from_a_postal_code(spark):
    text = "The plant is at Survey 7, Chakan Road, Khed, Pune 410501, Maharashtra, India and runs."
    (found,) = [r["a"] for r in spark.range(1).select(address(F.lit(text)).alias("a")).collect()]
    assert [(a["text"], a["confidence"], a["sub_type"]) for a in found] == [("Survey 7, Chakan Road, Khed, Pune 410501, Maharashtra, India", 0.88, "pin_anchored")]


def test_beginnings_and_ends_of_addresses(spark):
    cases = {
        "Acme Limited operates from Plot 9, MIDC Road, Pune 411 001": "Plot 9, MIDC Road, Pune 411 001",  # behind a preposition
        "Contact: Unit 4, Tower B, Sector 9, Noida 201301, Uttar Pradesh, India": "Unit 4, Tower B, Sector 9, Noida 201301, Uttar Pradesh, India",
        "We moved. Acme Pvt. Ltd., MG Road, Pune 411001": "MG Road, Pune 411001",  # behind a firm's name
        "Address: 12 Long Lane\nTel: 5": None,  # neither a place nor a code
        "Head Office: 12 Long Lane, Thane\n\nother": "12 Long Lane, Thane",
        "410501 alone": None,
        "Corporate\u00a0Office: 9,\u00a0MG\u00a0Road, Pune": "9,\u00a0MG\u00a0Road, Pune",  # blanks of any kind
    }
    got = spans_of(spark, address, *cases)
    assert [[g[1] for g in f] for f in got] == [[w] if w else [] for w in cases.values()]


def test_rules_for_names(spark):
    from spanmask.operators import rules

    both = lambda t: F.concat(rules.organisation(t), rules.person(t))
    got = spans_of(spark, both, "Our Acme Steel Private Limited met Mr. Ravi K. Hart.", "Asha Rao, the Managing Director, left. Limited.", "Τria Steel Ltd. of 2", None)
    assert [[g[:2] for g in f] for f in got[:3]] == [[("ORGANIZATION", "Acme Steel Private Limited"), ("PERSON", "Ravi K. Hart")], [("PERSON", "Asha Rao")], [("ORGANIZATION", "Τria Steel Ltd.")]]


def test_checks(spark):
    df = spark.createDataFrame([("a..b@c.de", "12 March 1981", "31/12/1890"), ("a@b.co", "1981-03-12", "x"), (None, None, None)], "m string, d string, e string")
    got = df.select(checks.email_address(F.col("m")), checks.birth_date(F.col("d")).cast("string"), checks.birth_date(F.col("e")).cast("string")).collect()
    assert [tuple(r) for r in got] == [(False, "1981-03-12", None), (True, "1981-03-12", None), (None, None, None)]


def test_scores(spark):
    def one(kind, text, value, conf):
        start = text.index(value)
        s = F.array(span(kind, F.lit(value), F.lit(start), F.lit(start + len(value)), conf, "t"))
        return [(x["type"], round(x["confidence"], 3)) for x in spark.range(1).select(scored(F.lit(text), s).alias("s")).first()["s"]]

    assert one("DATE_OF_BIRTH", "Date of Birth: 12/03/1981", "12/03/1981", 0.7) == [("DATE_OF_BIRTH", 1.0)]
    assert one("DATE_OF_BIRTH", "Dated 12/03/1981", "12/03/1981", 0.7) == []
    assert one("PERSON", "by Abc Holdings here", "Abc Holdings", 0.8) == [("ORGANIZATION", 0.8)]
    assert one("PERSON", "the director Asha Rao", "Asha Rao", 0.7) == [("PERSON", 0.9)]
    assert one("ORGANIZATION", "seen by SEBI today", "SEBI", 0.9) == []
    assert one("PERSON", "Al", "Al", 0.9) == []


def test_splice(spark):
    s = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("r")) for a, b, r in ((0, 1, "X"), (3, 5, ""), (5, 6, "YY"))))
    assert spark.range(1).select(splice(F.lit("😀bcdefg"), s, lambda x: x["r"])).first()[0] == "XbcYYg"
