import json

import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.operators import benchmark, cleaner, quality
from foliant.plans import papers
from foliant.sources import files, registry, service, sinks

ARTIFACTS = f"struct<figures:array<struct<caption:string,coords:array<{files.COORD}>>>,tables:array<struct<caption:string,coords:array<{files.COORD}>>>,formulas:array<struct<text:string,coords:array<{files.COORD}>>>,text_blocks:array<struct<text:string,label:string,coords:array<{files.COORD}>>>>"
NS = "http://www.tei-c.org/ns/1.0"


@pytest.fixture(scope="module")
def records(spark):
    xml = f"""<TEI xmlns="{NS}"><teiHeader><fileDesc><titleStmt><title>A  title</title></titleStmt></fileDesc></teiHeader><text><body>
      <div><head>Methods</head><p>We trained 3 models on images.</p><p>We trained 3 models  on images.</p></div><div><head>•</head><p>Other text here.</p></div></body>
      <back><listBibl><biblStruct><analytic><title>A reference of some length</title></analytic></biblStruct></listBibl></back></text></TEI>"""
    tei = files.parsed_tei(spark.createDataFrame([("p", xml)], "path string, xml string")).select(F.col("path").alias("paper_id"), F.lit("p.pdf").alias("filename"), "tei")
    tei = tei.unionByName(spark.createDataFrame([("q", "q.pdf", None)], f"paper_id string, filename string, tei {files.TEI}"))
    audit = spark.createDataFrame([("p", ("D:20190101",), "We trained 3 models on images. Other text here.")], "paper_id string, metadata struct<creation_date:string>, text string")
    box = [(1, 1.0, 1.0, 2.0, 2.0)]
    trees = spark.createDataFrame([("p", ([("Cap", box), ("Cap", box)], [], [("a = b", box), ("a=b", box)], [("Methods", "section_header", box), ("We trained 3 models on images.", "text", box)]))], f"paper_id string, artifacts {ARTIFACTS}")
    return papers.fused(tei, audit, trees)


def test_canonical_documents(records):
    got = {r.paper_id: r for r in papers.canonical_documents(records).collect()}
    p, q = got["p"], got["q"]
    assert (p.metadata.title, p.metadata.year, p.filename) == ("A title", 2019, "p.pdf")
    assert [(s.heading, len(s.coords)) for s in p.sections] == [("Methods", 1)]
    assert [(t.text, t.section) for t in p.paragraphs] == [("We trained 3 models on images.", "Methods"), ("Other text here.", "•")]
    assert [f.formula_id for f in p.formulas] == ["formula_001"] and len(p.figures) == 1 and p.tables == [] and len(p.references) == 1
    assert p.canonical_text.startswith("A title\n\n## Methods\n\nWe trained")
    assert q.sections == [] and q.paragraphs == [] and q.canonical_text == "" and q.metadata.authors == []


def test_evaluate_of_fused_records(records):
    got = {r.paper_id: r for r in quality.evaluate(records).collect()}
    # the reader drops the repeated paragraph, so its number counts once, as in the PDF
    assert got["p"].numeric_consistency == 1.0 and got["p"].extraction_counts.paragraphs == 2 and got["p"].coordinate_integrity == 1.0
    assert got["q"].status == "poor"


def test_audit_documents(spark):
    info = spark.createDataFrame([("p", ("T",), 2), ("q", ("U",), 1)], "paper_id string, metadata struct<title:string>, num_pages int")
    rows = [("p", 1, 0, 5.0, 9.0, 6.0, 10.0, "second  7"), ("p", 1, 1, 5.0, 1.0, 6.0, 2.0, "first"), ("p", 2, 0, 0.0, 0.0, 1.0, 1.0, " \n ")]
    blocks = spark.createDataFrame(rows, "paper_id string, page_no int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r.paper_id: r for r in papers.audit_documents(blocks, info).collect()}
    assert got["p"].text == "first\n\nsecond 7" and got["p"].num_pages == 2 and [b.block_no for b in got["p"].pages[0].blocks] == [1, 0]
    assert got["p"].stats.asDict() == {"characters": 15, "words": 3, "numbers": 1, "blocks": 2}
    assert got["q"].text == "" and got["q"].stats.blocks == 0


def test_cleaned_and_chunked_documents(spark):
    meta = "struct<pdf_author:string,creation_date:string,mod_date:string,publication_date:string>"
    info = spark.createDataFrame([("p", "p.pdf", 3, ("Eve Fay", None, "none", "May 2011")), ("q", "q.pdf", 0, (None, None, None, None))], f"paper_id string, filename string, num_pages int, metadata {meta}")
    body = "This is a long enough sentence of the abstract that has more than ten words in it."
    rows = [("p", 0, "A long enough title of a paper†", None, "title", 1), ("p", 1, "Ann Lee1 & Bo Ray2*", None, "text", 1), ("p", 2, body, None, "text", 1), ("p", 3, "Keywords: x", None, "text", 1), ("p", 4, None, "e = mc", "formula", 2), ("p", 5, "References", None, "text", 3), ("p", 6, "1. A", None, "text", 3), ("p", 7, "1. a!", None, "text", 3)]
    nodes = spark.createDataFrame(rows, "paper_id string, ord int, text string, orig string, label string, page_no int")
    cleaned = papers.cleaned_documents(info, nodes)
    got = {r.paper_id: r for r in cleaned.collect()}
    p, q = got["p"], got["q"]
    assert (p.title, p.authors, p.year, p.abstract) == ("A long enough title of a paper", ["Ann Lee", "Bo Ray"], 2011, body)
    assert p.references == ["1. A"] and len(p.nodes) == 8 and p.nodes[4].text == "e = mc" and p.nodes[6].text == ""
    assert p.stats.asDict() == {"total_text_nodes": 8, "abstract_characters": len(body), "reference_count": 1}
    assert q.authors == [] and q.year is None and q.references == [] and q.stats.total_text_nodes == 0
    chunks = {r.paper_id: r for r in papers.chunk_documents(cleaned.withColumn("canonical_text", F.lit("1. Intro\nSome text. More text."))).collect()}
    assert [c.section for c in chunks["p"].chunks] == ["Abstract", "1. Intro"] and chunks["p"].num_chunks == 2 and chunks["q"].num_chunks == 1


def test_service(spark):
    df = spark.createDataFrame([("a", bytearray(b"x"), "h1"), ("b", bytearray(b"y"), "h2"), ("c", bytearray(b"z"), "h3"), ("d", bytearray(b""), "h4")], "path string, content binary, file_hash string")

    def send(path, content):
        if path == "b":
            raise OSError("down")
        return "" if path == "c" else f"<x>{len(content)}</x>"

    answers = service.tei_of(df.where("path <> 'd'"), send)
    got = {r.path: (r.xml, r.error) for r in answers.collect()}
    assert got["a"] == ("<x>1</x>", None) and got["b"][1] == "OSError: down" and got["c"][1]
    known = spark.createDataFrame([("h4",), (None,)], "file_hash string")
    out = service.outcomes(df, answers, known)
    assert {r.path: r.outcome for r in out.collect()} == {"a": "extracted", "b": "failed", "c": "failed", "d": "skipped"}
    assert {r.outcome: r["count"] for r in sinks.outcome_counts(out).collect()} == {"extracted": 1, "failed": 2, "skipped": 1}
    assert service.healthy(lambda: 200) and not service.healthy(lambda: 503) and not service.healthy(lambda: 1 / 0)
    assert service.request_fields(True)["segmentSentences"] == "1"


def test_settings(spark):
    spark.conf.set("spark.foliant.service_timeout", "7")
    try:
        assert config.settings(spark).service_timeout == 7 and config.settings(spark).max_tokens == 450
    finally:
        spark.conf.unset("spark.foliant.service_timeout")


def test_written_documents_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("p", "é", None), ("q", "y", 1)], "paper_id string, title string, year int")
    sinks.write_documents(df, f"{tmp_path}/docs")
    sinks.write_documents(df.where("paper_id = 'q'").withColumn("title", F.lit("z")), f"{tmp_path}/docs")
    got = {r.paper_id: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/docs").collect()}
    assert got == {"p": {"paper_id": "p", "title": "é", "year": None}, "q": {"paper_id": "q", "title": "z", "year": 1}}
    registry.write_registry(df, f"{tmp_path}/registry", 0)
    assert registry.read_registry(spark, f"{tmp_path}/registry")[0].count() == 2
    sinks.write_artifacts({"t": df}, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out/t").count() == 2
    (tmp_path / "papers.json").write_text(json.dumps({"paper_001": {"paper_id": "paper_001", "status": "extracted"}}))
    assert files.registry_json(spark, f"{tmp_path}/papers.json", "paper_id string, status string").first().status == "extracted"
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports/paper_001_quality.json").write_text(json.dumps({"integrity_score": 0.9, "metrics": {"abstract_integrity": 1.0}}))
    assert files.quality_reports(spark, f"{tmp_path}/reports").first().paper_id == "paper_001"
    assert files.registry_json(spark, f"{tmp_path}/none.json", "paper_id string").count() == 0


def test_reference_text_and_pages(spark):
    ref = "array<struct<title:string,authors:array<string>,year:int,doi:string>>"
    df = spark.createDataFrame([([("A title", ["Ann Lee", "Bo Ray"], 1999, None), (None, None, None, None)], [("A Title", ["Ann Lee", "Bo Ray"], 1999, "")])], f"a {ref}, b {ref}")
    got = df.select(F.transform("a", benchmark.reference_text).alias("t"), benchmark.reference_score(F.col("a"), F.col("b")).alias("f")).first()
    assert got.t == ["A title Ann Lee Bo Ray 1999", ""] and abs(got.f - 2 / 3) < 1e-9
    prov = spark.createDataFrame([([(4,), (5,)],), ([],), (None,)], "prov array<struct<page_no:int>>")
    assert [r.p for r in prov.select(cleaner.page_no(F.col("prov")).alias("p")).collect()] == [4, None, None]
