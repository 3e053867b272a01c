import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert "redact_documents" in names


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_spans", "redacted"]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p") or n.startswith(("pi", "ps"))))
def test_core_sql_equals_spark(spark, name):
    import os

    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, row))]) for row in got.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want
