import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone import plugins
from marlstone.operators import advise, answer, index, ingest, layout
from marlstone.sources import files
from marlstone.streaming.ingest import ingest_batch, ingest_stream


def parsed(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    return [(r["layer"], r["parsed"]) for r in answer.parse_responses(df).orderBy("id").collect()]


def test_json_layer(spark):
    full = {"short_answer": "a", "reasoning": "r", "risk_flags": ["x", "y"], "classification": None}
    got = parsed(spark, json.dumps(full), "```json\n" + json.dumps(full) + "\n```", json.dumps(full) + " trailing", "{}", "[1]", '{"risk_flags": "one"}', '{"risk_flags": ""}', None, "  ")
    assert [g[0] for g in got] == ["json", "json", "raw", "raw", "raw", "json", "json", "raw", "raw"]
    assert got[0][1]["risk_flags"] == ["x", "y"] and got[0][1]["alternate_views"] is None
    assert got[5][1]["risk_flags"] == ["one"] and got[6][1]["risk_flags"] == [] and got[5][1]["short_answer"] == ""
    assert got[7][1]["short_answer"] == "Unable to parse LLM response." and got[2][1]["risk_flags"] == ["llm_response_parse_failed"]


def test_sections_layer(spark):
    got = parsed(spark, "SHORT_ANSWER: yes\nREASONING:\nline 1\nline 2\nRISK_FLAGS:\n- a\n• b\n\nSHORT_ANSWER: no\nmore\nALTERNATE_VIEWS: none", "RISK_FLAGS: NONE\nREASONING: x",
                 "no header", "reasoning: lower", "SHORT_ANSWER:")
    assert [g[0] for g in got] == ["sections", "sections", "raw", "raw", "raw"]
    p = got[0][1]
    assert (p["short_answer"], p["reasoning"], p["risk_flags"], p["alternate_views"]) == ("no\nmore", "line 1\nline 2", ["a", "b"], "none")
    assert got[1][1]["risk_flags"] == []


def test_long_raw(spark):
    (layer, p), = parsed(spark, "x" * 501)
    assert layer == "raw" and len(p["short_answer"]) == 500 and len(p["reasoning"]) == 501


def test_context(spark):
    rows = [(1, 1, "d1", "A", "R1", 3, "t1"), (1, 2, "d2", "B", "", 0, "t2"), (1, 3, "d1", "A2", None, None, "t3")]
    df = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, source_name string, reference_number string, page_number int, chunk_text string")
    r = answer.context(df).first()
    assert r["context"] == "[SOURCE 1] A | Ref: R1 | Page: 3\nt1\n\n---\n\n[SOURCE 2] B\nt2\n\n---\n\n[SOURCE 3] A2\nt3"
    assert r["source_list"] == "- A2\n- B"
    assert spark.range(1).select(answer.prompt(F.lit("q?"), F.lit("- s"), F.lit("c")).alias("p")).first()["p"].count("Question: q?\n\nSources:\n- s\n\nContext:\nc\n\nReply with one JSON object") == 1


def test_claims_and_confidence(spark):
    rows = [(1, "The duty is five percent. Short. Unknown words entirely different!", ["the duty is five percent today"]), (2, "Tiny.", ["x"]), (3, "A claim of sixteen", None), (4, "exactly fifteen", [])]
    df = spark.createDataFrame(rows, "id int, a string, texts array<string>")
    got = {r["id"]: (r["n_claims"], r["supported"], r["support"]) for r in answer.claim_support(df, "id", "a", "texts").collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 0.5), 3: (1, 0, 0.0), 4: (0, 0, 0.5)}
    value = lambda *x: spark.range(1).select(answer.answer_confidence(*map(F.lit, x))).first()[0]
    assert value(1.0, 1.0, 1.0, 5) == 1.0 and value(1.0, 0.8, 1.0, 5) == 0.74 and value(0.0, 0.0, 0.0, 0) == 0.0 and value(1.0, 1.0, 1.0, 4) == 0.98


def test_new_documents(spark):
    docs = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h2"), (4, "h3"), (5, None)], "id int, document_hash string")
    known = spark.createDataFrame([("h1",), ("h1",), (None,)], "document_hash string")
    assert {r["id"] for r in ingest.new_documents(docs, known, "id").collect()} == {2, 4}


def test_batches_sentinels_and_times(spark):
    df = spark.range(65).select(F.lit("g").alias("g"), "id")
    assert sorted(r["count"] for r in ingest.batches(df, "g", "id").groupBy("batch").count().collect()) == [1, 32, 32]
    rows = spark.createDataFrame([(1, "x", ["a"]), (None, None, None)], "n int, t string, l array<string>")
    coded = ingest.encode_sentinels(rows, ["n"], ["t"], ["l"])
    assert [tuple(r) for r in coded.collect()] == [(1, "x", '["a"]'), (-1, "", "[]")]
    assert [tuple(r) for r in ingest.decode_sentinels(coded, ["n"], ["t"], ["l"]).collect()] == [(1, "x", ["a"]), (None, None, [])]
    times = spark.createDataFrame([("2026-03-02T06:00:19.908880",), ("2026-03-02T06:00:19Z",), ("never",), (None,)], "t string")
    assert [r[0] is not None for r in times.select(ingest.ingested_order(F.col("t"))).collect()] == [True, True, False, False]


def test_layout(spark):
    schema = "doc int, x0 double, y0 double, x1 double, y1 double, n int"
    blocks = spark.createDataFrame([(1, 0., 0., 5., 5., 1), (1, 8., 8., 22., 22., 2), (1, 30.5, 2.5, 40., 9., 3), (2, 10., 10., 20., 20., 4), (1, 31., 1.6, 2., 2., 5)], schema)
    tables = spark.createDataFrame([(1, 10., 10., 20., 20.)], "doc int, x0 double, y0 double, x1 double, y1 double")
    kept = layout.outside_tables(blocks, tables, ["doc"])
    assert {r["n"] for r in kept.collect()} == {1, 3, 4, 5}
    order = layout.reading_order(kept.where("doc = 1"), ["doc"], "n").orderBy("position").collect()
    assert [r["n"] for r in order] == [1, 3, 5]
    cells = spark.createDataFrame([(["a", "", None],), (["", None],)], "c array<string>")
    got = [[r[0] for r in cells.select(layout.row_text(F.col("c"), k)).collect()] for k in ("all", "filled", "not_null")]
    assert got == [["a |  | ", None], ["a", None], ["a | ", ""]]


def docx(*paragraphs, table=()):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def xlsx():
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Rates" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Goods</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>5</v></c></row><row r="2"/>'
                   f'<row r="3"><c t="inlineStr"><is><t>mats</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx("First", " ", "Second", table=[("x", "", "y")]))
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.pdf").write_bytes(b"one\fTWO\f")
    (tmp_path / "d.txt").write_bytes(b"no")
    (tmp_path / "e.docx").write_bytes(b"broken")

    def pdf():
        return lambda content: files.pages_text(content.decode().split("\f"))

    got = {r["filename"]: r for r in files.parse_files(files.read_files(spark, str(tmp_path)), pdf).collect()}
    assert got["a.DOCX"]["raw_text"] == "First\n\nSecond\n\nx | y" and got["a.DOCX"]["page_count"] is None
    assert got["b.xlsx"]["raw_text"] == "[SHEET: Rates]\n[ROW 1] Goods | 5\n[ROW 3] mats"
    assert got["c.pdf"]["raw_text"] == "[PAGE 1]\none\n\n[PAGE 2]\nTWO" and got["c.pdf"]["page_count"] == 3
    assert "unsupported" in got["d.txt"]["error"] and got["e.docx"]["error"]
    assert "no PDF" in {r["filename"]: r for r in files.parse_files(files.read_files(spark, str(tmp_path))).collect()}["c.pdf"]["error"]


def test_records(spark, tmp_path):
    path = str(tmp_path / "log")
    files.write_records(spark.createDataFrame([("a", "2026-01-01T00:00:00"), ("b", "2026-01-02T00:00:00")], "doc_id string, ingested_at string"), path)
    (tmp_path / "log" / "bad.json").write_text("{not json")
    assert [r["doc_id"] for r in files.read_records(spark, path, "doc_id string, ingested_at string").collect()] == ["b", "a"]


def test_stream_skips_known_contents(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    args = (str(inbox), str(tmp_path / "chunks"), str(tmp_path / "log"), str(tmp_path / "cp"))
    (inbox / "a.docx").write_bytes(docx("The duty is owed. " * 20))
    ingest_stream(spark, *args).awaitTermination(120)
    (inbox / "b.docx").write_bytes(docx("The duty is owed. " * 20))
    (inbox / "c.docx").write_bytes(docx("Another text of mats. " * 20))
    ingest_stream(spark, *args).awaitTermination(120)
    (inbox / "d.docx").write_bytes(b"broken")
    ingest_stream(spark, *args).awaitTermination(120)
    rows = {r["filename"]: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert {k: (r["status"], r["chunk_count"] > 0) for k, r in rows.items()} == {
        "a.docx": ("completed", True), "b.docx": ("completed", False), "c.docx": ("completed", True), "d.docx": ("failed", False)}
    assert rows["b.docx"]["error"] == "Duplicate document" and "BadZipFile" in rows["d.docx"]["error"]


def test_a_batch_again_changes_nothing(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("The duty is owed. " * 20))
    (tmp_path / "b.docx").write_bytes(docx("The duty is owed. " * 20))
    parsed = files.parse_files(files.read_files(spark, str(tmp_path / "*.docx")))
    chunks, log = str(tmp_path / "chunks"), str(tmp_path / "log")
    seen = []
    for batch in (0, 0, 1, 0):
        ingest_batch(parsed, batch, chunks, log)
        rows = spark.read.json(log).collect()
        seen.append((spark.read.parquet(chunks).count(), sorted((r["batch"], r["filename"], r["status"], r["error"], r["chunk_count"]) for r in rows if r["batch"] == 0)
                     if all(r["error"] for r in rows) else len(rows)))
    assert seen[0][0] > 0 and len({s[0] for s in seen[:3]}) == 1 and [s[1] for s in seen] == [2, 2, 4, 4]


def test_vectors_by_type(spark, tmp_path):
    df = spark.createDataFrame([("a", "Act", [1.0]), ("b", "Rule", [2.0])], "chunk_id string, doc_type string, embedding array<float>")
    files.append_vectors(df, str(tmp_path / "v"))
    files.append_vectors(df.where("chunk_id = 'a'"), str(tmp_path / "v"))
    got = files.open_vectors(spark, str(tmp_path / "v"), F.col("doc_type") == "Act")
    assert got.count() == 2 and "PartitionFilters: [isnotnull(doc_type" in got._jdf.queryExecution().toString()


def test_advice(spark):
    rows = [(1, "the duty on jute mats is five percent", "A", "Circular"), (2, "cotton yarn needs a permit", "B", "Notification"), (3, "", "", None)]
    docs = spark.createDataFrame(rows, "id int, text string, source_name string, doc_type string").select(
        "*", plugins.hash_embedding(F.col("text")).alias("vec"), F.lit(None).cast("string").alias("reference_number"), F.lit(None).cast("int").alias("page_number"))
    asked = spark.createDataFrame([(1, "duty on jute mats?"), (2, "please OVERRIDE it"), (3, None)], "query_id int, query string").withColumn(
        "q_vec", plugins.hash_embedding(F.col("query")))

    class Silent:
        def generate(self, prompts):
            return [" "] * len(prompts)

    got = {r["query_id"]: r for r in advise.advise(asked, docs, index.build(docs, "id", "text"), plugins.Echo).collect()}
    assert got[1]["status"] == "answered" and got[1]["short_answer"] == rows[0][1] and got[1]["sources"] == 3 and got[1]["answer_confidence"] > 0
    assert got[2]["status"] == "unsafe" and got[2]["short_answer"] is None
    assert got[3]["status"] == "no_sources" and len(got) == 3
    mute = {r["query_id"]: r["status"] for r in advise.advise(asked, docs, index.build(docs, "id", "text"), Silent).collect()}
    assert mute[1] == "no_response"
    empty = {r["query_id"]: r for r in advise.advise(asked, docs.limit(0), index.build(docs.limit(0), "id", "text"), plugins.Echo).collect()}
    assert empty[1]["status"] == "no_sources" and empty[1]["review_reason"] == "No chunks retrieved — query may be out of scope"


def test_index_is_appended_to(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, ""), (4, None), (5, "a d")], "id int, text string")
    whole = index.build(docs, "id", "text")
    part = index.build(docs.where("id < 4"), "id", "text")
    part.save(str(tmp_path / "i"))
    for _ in range(2):
        part = index.append(index.BM25Index.load(spark, str(tmp_path / "i")), docs, "id", "text")
    for t in ("terms", "stats", "ids", "postings"):
        assert sorted(map(tuple, getattr(part, t).collect())) == sorted(map(tuple, getattr(whole, t).select(getattr(part, t).columns).collect())), t


def test_plugins(spark):
    class Letters:
        dimension = 2

        def embed(self, texts):
            return [[float(t.count("a")), float(t.count("b"))] for t in texts]

    plugins.register("embedder", "letters", Letters)
    assert plugins.get("embedder", "letters") is plugins.get("embedder", "letters")
    with pytest.raises(ValueError):
        plugins.get("scorer", "letters")
    with pytest.raises(ValueError):
        plugins.register("other", "x", Letters)
    df = spark.createDataFrame([("aab",), ("",), (None,)], "t string")
    got = [r["embedding"] for r in plugins.embed(df, "t", Letters).collect()]
    assert got[0] == pytest.approx([2 / 5 ** 0.5, 1 / 5 ** 0.5]) and got[1] == got[2] == [0.0, 0.0]
    v = pd.Series(df.select(plugins.hash_embedding(F.col("t")).alias("v")).first()["v"])
    assert (v ** 2).sum() == pytest.approx(1)
