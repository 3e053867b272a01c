import random

import pytest
from pyspark.sql import functions as F

from spanmask.operators import relational
from spanmask.sources import docx


def test_asof_join_equals_a_search(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(20)) for i in range(60)] + [(60, None, 3), (61, "a", None), (62, "c", 5)]
    right = [(rng.choice("ab"), rng.randrange(20), rng.randrange(99)) for _ in range(30)] + [(None, 1, 1), ("a", None, 2)]
    l, r = spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "k string, at int, v int")  # noqa: E741
    got = {x["i"]: x["v"] for x in relational.asof_join(l, r, ["k"], "at", ["v"]).collect()}
    for i, k, at in left:
        before = [(t, v) for kk, t, v in right if None not in (k, at, kk, t) and kk == k and t <= at]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == 63
    assert relational.asof_join(l.limit(0), r, ["k"], "at", ["v"]).count() == 0
    assert relational.asof_join(l, r.limit(0), ["k"], "at", ["v"]).where("v is not null").count() == 0


def test_top_rows_and_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1), ("d", 3)], "k string, n int")
    assert [tuple(r) for r in relational.top(df, "n", 3).collect()] == [("d", 3), ("a", 2), ("b", 2)]


@pytest.mark.parametrize("text", ["plain", "tab\tline\nend ", " \x01gone\x0b", "", "ü漢 <&>"])
def test_a_made_word_file_reads_back(text):
    run = lambda t, b=False: {"text": t, "is_italic": False, "is_bold": b}
    (block,) = docx.blocks_of(docx.made([[run(text), run("bold", True)]]))
    kept = text.replace("\x01", "").replace("\x0b", "")
    assert block["raw_text"] == kept + "bold" and [r["is_bold"] for r in block["runs"]] == [False, True]


def test_reports_hold_all_rows(spark):
    from spanmask.sources.records import evaluation_report, markdown

    df = spark.range(1500).select(F.col("id").alias("label"), F.lit(None).cast("string").alias("x"))
    assert markdown(df, "All").count("\n") == 1504
    assert evaluation_report("set", df.limit(1), df, df).count("## ") == 3
