from spanmask.operators import evaluate as E

SCHEMA = "doc_id string, label string, start int, end int"


def test_counts_and_rates(spark):
    gold = spark.createDataFrame([("1", "EMAIL", 0, 5), ("1", "EMAIL", 0, 5), ("1", "PHONE", 9, 19), ("2", "PERSON", 3, 8)], SCHEMA)
    pred = spark.createDataFrame([("1", "EMAIL", 0, 5), ("1", "PHONE", 9, 18), ("2", "PERSON", 3, 8), ("2", "ODD", 0, 1)], SCHEMA)
    rows = {r["label"]: r for r in E.per_class(pred, gold).collect()}
    assert len(rows) == 9
    assert tuple(rows["EMAIL"][c] for c in ("tp", "fp", "fn", "precision", "recall", "f1", "support")) == (1, 0, 1, 1.0, 0.5, 0.6667, 2)
    assert tuple(rows["PHONE"][c] for c in ("tp", "fp", "fn", "relaxed_tp", "f1", "relaxed_f1")) == (0, 1, 1, 1, 0.0, 0.5)
    o = E.overall(E.per_class(pred, gold), 10).first()
    assert (o["tp"], o["fp"], o["fn"], o["macro_f1"], o["accuracy"]) == (2, 1, 2, 0.5556, 0.7)


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    o = E.overall(E.per_class(none, none), 0).first()
    assert (o["tp"], o["f1"], o["macro_f1"], o["accuracy"]) == (0, 0.0, 0.0, 0.0)


def test_ablation_and_shift(spark):
    gold = spark.createDataFrame([("1", "EMAIL", 0, 5)], SCHEMA)
    pred = spark.createDataFrame([("1", "EMAIL", 0, 5, "a"), ("1", "EMAIL", 0, 5, "both"), ("1", "PHONE", 0, 2, "both")], SCHEMA + ", config string")
    rows = {r["config"]: (r["tp"], r["fp"], r["fn"]) for r in E.ablation(pred, gold, ("a", "both", "none"), 10).collect()}
    assert rows == {"a": (1, 0, 0), "both": (1, 1, 0), "none": (0, 0, 1)}
    docs = spark.createDataFrame([("0", "abc"), ("1", None), ("2", "x")], "id string, t string")
    spans = spark.createDataFrame([("0", "A", 1, 2), ("2", "A", 0, 1)], SCHEMA)
    got = {r["doc_id"]: r["start"] for r in E.shifted(spans, docs, "id", "t").collect()}
    assert got == {"0": 1, "2": 203}
