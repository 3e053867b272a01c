import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from spanmask.functions.spantext import NO_SPANS, SPANS, span
from spanmask.operators import images, model, normalize, pseudonym, registry
from spanmask.plans import pipeline
from spanmask.sources import docx
from spanmask.sources.records import markdown, read_records, summary

KEY = bytes(range(32))
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def para(*runs, style=""):
    p = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return "<w:p>" + p + "".join(f"<w:r><w:rPr>{'<w:b/>' if 'b' in k else ''}{'<w:i/>' if 'i' in k else ''}</w:rPr><w:t>{t}</w:t></w:r>" for t, k in runs) + "</w:p>"


def word_file(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        sect = '<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr>'
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}{sect}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="header1.xml"/></Relationships>')
        z.writestr("word/header1.xml", f"<w:hdr {W}>{para(('Head', ''))}<w:tbl><w:tr><w:tc>{para(('In head', ''))}</w:tc></w:tr></w:tbl></w:hdr>")
        z.writestr("word/media/a.png", b"picture")
    return out.getvalue()


TABLE = f"<w:tbl><w:tr><w:tc>{para(('cell@x.example.com', ''))}</w:tc><w:tc>{para(('1', ''))}</w:tc></w:tr></w:tbl>"


def test_blocks_of_a_word_file(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file(para(("Mr. ", ""), ("Rajesh ", "b"), ("Hegde", "i")), TABLE, para(("Note", ""), style="FootnoteText")))
    (tmp_path / "b.docx").write_bytes(b"no word file")
    rows = docx.read_blocks(spark, str(tmp_path)).orderBy("block_ord").collect()
    assert [(r["block_id"], r["block_type"], r["raw_text"]) for r in rows] == [
        ("p_0", "paragraph", "Mr. Rajesh Hegde"),
        ("p_1", "paragraph", "Note"),
        ("tbl_0_r_0_c_0_p_0", "table_cell", "cell@x.example.com"),
        ("tbl_0_r_0_c_1_p_0", "table_cell", "1"),
        ("sec_0_header_p_0", "header", "Head"),
        ("sec_0_htbl_0_r_0_c_0_p_0", "header_table_cell", "In head"),
    ]
    assert [(x["raw_start"], x["raw_end"], x["is_bold"], x["is_italic"]) for x in rows[0]["runs"]] == [(0, 4, False, False), (4, 11, True, False), (11, 16, False, True)]
    assert rows[1]["metadata"]["is_footnote_style"] == "true" and rows[0]["metadata"]["has_italic"] == "true"
    assert [(r["name"], bytes(r["content"])) for r in docx.read_images(spark, str(tmp_path)).collect()] == [("word/media/a.png", b"picture")]


def test_rebuilt_file_keeps_looks(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file(para(("Call ", ""), ("a@b", "b"), (".example", "b"), (" or x", "i")), TABLE))
    blocks = docx.read_blocks(spark, str(tmp_path)).withColumn("block_key", F.monotonically_increasing_id())
    found = pipeline.detect_documents(blocks)
    changes = pipeline.replacements(found, KEY)
    out = docx.rewrite(spark, str(tmp_path), changes)
    target = tmp_path / "out"
    assert docx.write_files(out, str(target), str(tmp_path)) == 1
    again = docx.blocks_of((target / "a.docx").read_bytes())
    text = " ".join(b["raw_text"] for b in again)
    assert "a@b.example" not in text and "cell@x" not in text and "redacted.example" in text
    runs = again[0]["runs"]
    assert runs[0]["text"] == "Call " and runs[3]["text"] == " or x" and runs[1]["is_bold"] and runs[1]["text"] and not runs[2]["text"] and runs[3]["is_italic"]


def test_spliced_runs():
    runs = [{"text": t, "raw_start": a, "raw_end": a + len(t)} for t, a in (("Mr. ", 0), ("Rajesh ", 4), ("Hegde x", 11))]
    assert docx.spliced(runs, [(4, 16, "N"), (0, 2, "M")]) == ["M. ", "N", " x"]


def test_normal_form_and_way_back(spark):
    raw = "Ofﬁce​ at Pune–MIDC"
    df = spark.createDataFrame([(1, raw, "old"), (2, "", "old"), (3, None, "old"), (4, "​", "old"), (5, "plain", "old")], "k int, raw_text string, norm_text string")
    rows = {r["k"]: r for r in normalize.with_normal_form(df).collect()}
    assert rows[1]["norm_text"] == "Office at Pune-MIDC"
    a = rows[1]["norm_text"].index("Pune")
    p = spark.createDataFrame([(rows[1]["norm_to_orig"], 19, len(raw), a, a + 4)], "n array<int>, a int, b int, s int, e int").select(normalize.raw_place(*(F.col(c) for c in "nabse"))).first()[0]
    assert raw[p["start"] : p["end"]] == "Pune"
    assert (rows[2]["norm_text"], rows[3]["norm_text"], rows[4]["norm_text"], rows[5]["norm_to_orig"]) == ("", None, "", [0, 1, 2, 3, 4])
    empty = spark.range(1).select(normalize.raw_place(F.array().cast("array<int>"), F.lit(0), F.lit(1), F.lit(0), F.lit(0))).first()[0]
    assert (empty["start"], empty["end"]) == (0, 0)


def test_names_are_carried_over_a_document(spark):
    seeds = spark.createDataFrame([("d", "PERSON", "Mr. Rajesh Kushal Hegde", 0.95, 1), ("d", "ORGANIZATION", "SEBI", 0.99, 2), ("d", "PERSON", "Asha", 0.99, 3), ("e", "PERSON", "Other One", 0.5, 4)], "doc_id string, type string, text string, confidence double, ord int")
    alias = registry.aliases(registry.seeds(seeds))
    assert {r["alias_lc"] for r in alias.collect()} >= {"rajesh kushal hegde", "mr. hegde", "rajesh hegde", "rajesh k. hegde"}
    texts = [(1, "d", "Later MR. HEGDE and Rajesh Hegde spoke to Mr. Hegdes."), (2, "e", "Mr. Hegde"), (3, "d", None), (4, None, "Mr. Hegde")]
    blocks = spark.createDataFrame(texts, "block_key int, doc_id string, norm_text string").withColumn("spans", NO_SPANS())
    got = {r["block_key"]: [(s["text"], s["start"]) for s in r["spans"]] for r in registry.propagated(blocks, alias).collect()}
    assert got == {1: [("MR. HEGDE", 6), ("Rajesh Hegde", 20)], 2: [], 3: [], 4: []}


def test_brute_force_of_carried_names(spark):
    names = ["Ana Bell", "Bell Cole", "Ana Bell Cole", "Cole Ltd Limited"]
    seeds = spark.createDataFrame([("d", "ORGANIZATION" if "Ltd" in n else "PERSON", n, 0.9, i) for i, n in enumerate(names)], "doc_id string, type string, text string, confidence double, ord int")
    alias = registry.aliases(registry.seeds(seeds))
    texts = ["Ana Bell Cole saw Bell Cole; ANA BELL, xAna Bell", "Cole Ltd Ltd. and Cole Ltd Limited", "Bell Cole Ana Bell"]
    blocks = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "block_key int, doc_id string, norm_text string").withColumn("spans", NO_SPANS())
    got = {r["block_key"]: [(s["start"], s["end"]) for s in r["spans"]] for r in registry.propagated(blocks, alias).collect()}
    rx = re.compile(r"\b(?:" + "|".join(re.escape(a) for a in sorted((r["alias_lc"] for r in alias.collect()), key=lambda a: (-len(a), a))) + r")\b", re.I)
    assert got == {i: [m.span() for m in rx.finditer(t)] for i, t in enumerate(texts)}


def test_replacements_are_stable_distinct_and_valid(spark):
    from spanmask.functions import checks

    rows = [("s", "EMAIL", f"user{i}@a.example") for i in range(30)] + [("s", "PERSON", "Mr. ASHA RAO"), ("s", "person", "mr. asha rao"), ("s", "CREDIT_CARD", "4012 8888 8888 1881"), ("s", "IP_ADDRESS", "10.0.0.1"), ("s", "ODD", "x"), ("s", None, "y"), ("s", "PHONE", None)]
    values = spark.createDataFrame(rows, "scope_id string, type string, text string")
    out = pseudonym.pseudonyms(values, KEY)
    got = out.collect()
    assert len(got) == 34 and len({(r["type"], r["pseudonym"]) for r in got}) == 34
    by = {r["type"]: r["pseudonym"] for r in got}
    assert by["ODD"] == "[REDACTED_ODD]"
    bad = out.where(~F.when(F.col("type") == "EMAIL", checks.email_address(F.col("pseudonym"))).when(F.col("type") == "CREDIT_CARD", checks.luhn(F.col("pseudonym"))).when(F.col("type") == "IP_ADDRESS", checks.ip_address(F.col("pseudonym"))).otherwise(True))
    assert bad.count() == 0
    assert {r["token"]: r["pseudonym"] for r in pseudonym.pseudonyms(values, KEY).collect()} == {r["token"]: r["pseudonym"] for r in got}
    stored = pseudonym.vault(out, KEY)
    assert {r["value"] for r in pseudonym.reveal(stored, KEY).collect()} >= {"10.0.0.1", "user1@a.example"}
    assert {r["value"] for r in pseudonym.reveal(stored, bytes(32)).collect()} == {None}


def test_replacements_of_one_text_are_distinct(spark):
    """As over a document: equal values alike, others distinct, row by row."""
    names = [f"Mr. {a} {b}" for a in ("Asha", "Ravi", "Kiran", "Tara", "Meena", "Vikas", "Dale", "Omar") for b in ("Hart", "Long", "Bell", "Gorley", "Rao", "Fox", "Nair", "Sen")]
    text = "; ".join([*names, *names[:5], "10.0.0.1, 10.0.0.2"])
    row = pipeline.redact_text(spark.createDataFrame([(text,)], "t string"), "t", KEY).first()
    by = {}
    for s, r in zip(row["spans"], row["replacements"]):
        assert by.setdefault((s["type"], s["text"].lower()), r["pseudonym"]) == r["pseudonym"]
    assert len(by) == 66 and len(set(by.values())) == 66
    assert not any(n.split(" ", 1)[1] in row["redacted"] for n in names)
    values = spark.createDataFrame([("s", s["type"], s["text"]) for s in row["spans"]], "scope_id string, type string, text string")
    assert {r["pseudonym"] for r in pseudonym.pseudonyms(values, KEY).collect()} == set(by.values())


def test_a_span_is_scored_once(spark):
    """A model's sure birth date without a cue loses once and stays; a name in body text too."""
    one = F.array(span("DATE_OF_BIRTH", F.lit("12/03/1981"), F.lit(3), F.lit(13), 0.97, "m")).cast(SPANS)
    blocks = spark.createDataFrame([(1, "d", "b", 0, "On 12/03/1981 it rained.")], "block_key bigint, doc_id string, block_id string, block_ord int, raw_text string").withColumn("m", one)
    found = pipeline.detect_documents(blocks, model_spans="m").first()["spans"]
    assert [(s["type"], s["confidence"]) for s in found] == [("DATE_OF_BIRTH", 0.52)]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.docx").write_bytes(word_file(para((f"mail {d}@x.example.com", ""))))
    pipeline.process_files(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), KEY).collect()
    texts = ["".join(b["raw_text"] for b in docx.blocks_of(p.read_bytes())) for p in sorted((tmp_path / "out").rglob("*.docx"))]
    assert len(texts) == 2 and all(t.startswith("mail ") and "@x." not in t for t in texts)


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from spanmask.sources.lineage import shared_folder

    conf = SimpleNamespace(get=lambda k, d=None: None)
    there = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://x:7077"))
    with pytest.raises(ValueError):
        shared_folder(there)


def test_token_is_an_hmac(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(pseudonym.token(F.lit("person"), F.lit(" Asha "), KEY)).first()[0]
    assert got == hmac.new(KEY, b"PERSON:asha", hashlib.sha256).hexdigest()


def test_model_slot(spark):
    def load():
        def run(texts):
            if len(texts) > 1:
                raise ValueError("batch too large")
            return [[{"label": "person", "text": "Mr. Asha Rao, ", "start": t.index("Mr."), "end": t.index("Mr.") + 14, "score": 0.9}, {"label": "company", "text": "Acme", "start": 0, "end": 4, "score": 0.9}, {"label": "person", "text": "Low", "start": 0, "end": 3, "score": 0.1}] if "Mr." in t else [] for t in texts]

        return run

    texts = ["  see Mr. Asha Rao, now", None, "12", "nothing here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: [(s["type"], s["text"], s["start"]) for s in r["spans"]] for r in model.detect(df, "t", load).collect()}
    assert got == {0: [("PERSON", "Asha Rao", texts[0].index("Asha"))], 1: [], 2: [], 3: []}


def test_images_without_libraries(spark):
    df = spark.createDataFrame([("d", "a.png", bytearray(b"abc")), ("d", "b.png", None)], "doc_id string, name string, content binary")
    assert [r["content"] for r in images.scan(df).orderBy("name").collect()] == [bytearray(b"abc"), None]
    reader = lambda data: [{"text": "a@b.example.com", "x": 1, "y": 1, "w": 5, "h": 5, "confidence": 90.0}, {"text": "word", "x": 1, "y": 1, "w": 5, "h": 5, "confidence": 90.0}, {"text": "c@d.example.com", "x": 1, "y": 1, "w": 5, "h": 5, "confidence": 10.0}]
    got = df.select(images.personal_boxes(images.boxes(F.col("content"), reader)).alias("b")).collect()
    assert [[b["text"] for b in r["b"]] for r in got] == [["a@b.example.com"], []]


def test_records_and_reports(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id":"1","text":"a@b.example.com","entities":[{"start":0,"end":15,"label":"EMAIL","text":"a@b.example.com"}]}\n\n{"id":"2","text":"x","entities":[]}\n')
    r = read_records(spark, str(tmp_path / "r.jsonl"))
    assert r.count() == 2
    found = pipeline.detect_pii(r, "text")
    s = summary(found).first()
    assert (s["total_blocks_processed"], s["total_pii_detected"], s["pii_by_type"]) == (2, 1, {"EMAIL": 1})
    assert "| EMAIL |" in markdown(found.select(F.explode("spans.type").alias("type")), "Found")


def test_stream(spark, tmp_path):
    from spanmask.streaming.redaction import counts_stream, redacted_stream

    src = tmp_path / "in"
    spark.createDataFrame([("2026-01-01 00:10:00", "mail a@b.example.com"), ("2026-01-01 00:20:00", "nothing")], "at string, t string").select(F.col("at").cast("timestamp").alias("at"), "t").write.parquet(str(src))
    stream = spark.readStream.schema("at timestamp, t string").parquet(str(src))
    q = redacted_stream(stream, "t", KEY).writeStream.format("memory").queryName("red").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["redacted"].startswith("mail ") and "a@b" not in r["redacted"] for r in spark.table("red").where("size(spans) > 0").collect()} == {True}
    q = counts_stream(stream, "t", "at").writeStream.outputMode("complete").format("memory").queryName("cnt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["type"], r["n"]) for r in spark.table("cnt").collect()] == [("EMAIL", 1)]


def test_redaction_leaves_no_raw_value(spark):
    texts = ["Mr. Asha Rao (asha@b.example.com, +91 9876543210) lives.", "", None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, t string, spans string").drop("spans")
    got = {r["i"]: r["redacted"] for r in pipeline.redact_text(df, "t", KEY, with_rules=True).collect()}
    assert not any(x in got[0] for x in ("asha@", "9876543210", "Asha Rao")) and got[1] == "" and got[2] is None


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(word_file(para(("Contact Person: Asha Rao, mail asha@x.example.com", "")), para(("Later Asha Rao and Mr. Rao spoke.", "")), TABLE))
    out = pipeline.process_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), KEY).first()
    text = " ".join(b["raw_text"] for b in docx.blocks_of((tmp_path / "out" / "a.docx").read_bytes()))
    assert out["total_blocks_processed"] == 6 and out["pii_by_type"]["EMAIL"] == 2 and out["pii_by_type"]["PERSON"] == 3
    assert len(out["entities"]) == out["total_pii_detected"] and out["entities"][0]["text"] == "Asha Rao"
    assert not any(x in text for x in ("asha@", "Asha", "Rao"))


def test_text_results_and_known_pseudonyms(spark):
    df = spark.createDataFrame([("mail a@b.example.com",), ("",), (None,)], "t string")
    row = pipeline.text_results(df, "t", KEY).collect()
    assert len(row) == 1 and row[0]["total_entities"] == 1 and row[0]["entities"][0]["pseudonym"] in row[0]["redacted_text"]
    values = spark.createDataFrame([("s", "PERSON", "Asha Rao"), ("s", "PERSON", "Unknown One")], "scope_id string, type string, text string")
    known = pseudonym.pseudonyms(values.limit(1), KEY)
    got = {r["text"]: r["pseudonym"] for r in pseudonym.looked_up(values, known, KEY).collect()}
    assert got["Asha Rao"] and got["Unknown One"] is None


def test_sql_functions(spark):
    from spanmask.functions.sql import register

    assert "email_spans" in register(spark)
    spark.createDataFrame([(1, "😀 a@b.co, 10.0.0.1; 4012 8888 8888 1881 4012 8888 8888 1882"), (2, None)], "k int, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT k, inline(s) FROM (SELECT k, concat(email_spans(t), ipv4_spans(t), card_spans(t)) AS s FROM texts)").collect()
    assert [(r["k"], r["start"], r["end"], r["text"]) for r in rows] == [(1, 2, 8, "a@b.co"), (1, 10, 18, "10.0.0.1"), (1, 20, 39, "4012 8888 8888 1881")]
    assert spark.sql("SELECT spans_of('xaxx', 'x+').start AS s").first()["s"] == [0, 2]


def test_own_detector(spark):
    from spanmask.functions.spantext import matches, span
    from spanmask.operators import detect

    detect.register("plate", lambda t: F.transform(matches(t, r"\bKA-\d{4}\b"), lambda m: span("PLATE", m["text"], m["start"], m["end"], 0.9, "own")).cast(SPANS))
    try:
        got = spark.range(1).select(detect.identifiers(F.lit("car KA-1234")).alias("s")).first()["s"]
        assert [(x["type"], x["start"]) for x in got] == [("PLATE", 4)]
    finally:
        del detect.DETECTORS["plate"]


def test_blocks_that_were_never_cleaned_are_read(spark, tmp_path):
    from spanmask.plans import queries

    rows = [(1, "Mr.\u00a0Rajesh Hegde spoke.", None), (1, "Mr.\u00a0Rajesh Hegde spoke.", None), (2, "Mr. Rajesh Hegde spoke.", "Mr. Rajesh Hegde spoke."), (3, None, None), (4, "", None)]
    rows += [(5, "Office at 12, MG Road, Mumbai 400001, Maharashtra", None), (6, "Office at 12, MG Road, Mumbai 400001, Maharashtra", "Office at 12, MG Road, Mumbai 400001, Maharashtra")]
    spark.createDataFrame(rows, "block_key bigint, raw_text string, norm_text string").write.parquet(f"{tmp_path}/blocks.parquet")
    for query, one, other in ((queries.detect_names, 1, 2), (queries.detect_address, 5, 6)):
        got = [tuple(r) for r in query(spark, str(tmp_path)).collect()]
        assert [r[1:] for r in got if r[0] == one] == [r[1:] for r in got if r[0] == other] != [], query
