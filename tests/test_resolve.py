import random

from pyspark.sql import functions as F

from spanmask.functions.lexicon import PRIORITY
from spanmask.functions.spantext import SPANS
from spanmask.operators.resolve import merged, resolved

TYPES = [*PRIORITY, "OTHER"]


def model(spans):
    """The rules as prose has them: one span for each place, then a sweep against all accepted spans."""
    best = {}
    for s in spans:
        p = (PRIORITY.get(s["type"], 0), s["confidence"], -s["seq"])
        k = (s["start"], s["end"])
        if k not in best or p > best[k][0]:
            best[k] = (p, s)
    out = []
    for s in sorted((x for _, x in best.values()), key=lambda s: (s["start"], s["start"] - s["end"], s["seq"])):
        p, n = PRIORITY.get(s["type"], 0), s["end"] - s["start"]
        over = [a for a in out if max(a["start"], s["start"]) < min(a["end"], s["end"])]

        def beats(a):
            q, m = PRIORITY.get(a["type"], 0), a["end"] - a["start"]
            if a["start"] <= s["start"] and a["end"] >= s["end"]:
                return a["type"] == "ADDRESS" or q >= p
            return q > p or q == p and m >= n

        if any(beats(a) for a in over):
            continue
        out = [a for a in out if a not in over] + [s]
    return sorted((a["start"], a["end"], a["type"]) for a in out)


def block(rng):
    out = []
    for i in range(rng.randint(0, 9)):
        a = rng.randint(0, 20)
        t = rng.choice(TYPES)
        out.append({"type": t, "text": "x", "start": a, "end": a + rng.randint(1, 12), "confidence": rng.choice([0.5, 0.8, 0.9]), "sources": [rng.choice("abc")], "sub_type": None, "seq": i})
    return out


def test_random_blocks_against_the_rules(spark):
    rng = random.Random(7)
    blocks = [block(rng) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(blocks)), f"i int, s {SPANS.simpleString()}")
    for r in df.select("i", resolved(F.col("s")).alias("r")).collect():
        got = [(x["start"], x["end"], x["type"]) for x in r["r"]]
        assert got == model(blocks[r["i"]]), blocks[r["i"]]
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def one(spark, fn, *spans):
    rows = [{"type": t, "text": "x", "start": a, "end": b, "confidence": c, "sources": [s], "sub_type": None, "seq": i} for i, (t, a, b, c, s) in enumerate(spans)]
    df = spark.createDataFrame([(rows,)], f"s {SPANS.simpleString()}")
    return [(x["type"], x["start"], x["end"], x["sources"]) for x in df.select(fn(F.col("s"))).first()[0]]


def test_cases(spark):
    assert one(spark, resolved, ("ORGANIZATION", 0, 38, 0.9, "a"), ("PERSON", 0, 12, 0.9, "b")) == [("ORGANIZATION", 0, 38, ["a"])]
    assert one(spark, merged, ("EMAIL", 0, 5, 0.9, "b"), ("EMAIL", 0, 5, 0.99, "a")) == [("EMAIL", 0, 5, ["a", "b"])]
    assert one(spark, resolved, ("ORGANIZATION", 0, 10, 0.9, "a"), ("PHONE", 5, 19, 0.9, "a")) == [("PHONE", 5, 19, ["a"])]
    assert one(spark, resolved, ("ADDRESS", 0, 40, 0.9, "a"), ("PHONE", 5, 19, 0.9, "a")) == [("ADDRESS", 0, 40, ["a"])]


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ([],)], f"s {SPANS.simpleString()}")
    assert [r[0] for r in df.select(resolved(F.col("s"))).collect()] == [[], []]
