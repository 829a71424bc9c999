"""The TEI reader's rules, and versions of the registry with several writers."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.functions.similarity import line_text
from foliant.operators import dedup
from foliant.sources import files, registry, service

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
XML = f"""<?xml version="1.0" encoding="ISO-8859-1"?><TEI {NS}><teiHeader>
<fileDesc><titleStmt><title level="a">A <hi>t</hi>itle</title><title>Other</title></titleStmt>
<publicationStmt><date>no year</date></publicationStmt>
<sourceDesc><biblStruct><analytic>
<author><persName><forename>Ann</forename><forename>B.</forename><surname>Lee</surname></persName></author>
<author><persName><forename>ann</forename> <forename>b.</forename><surname>LEE</surname></persName></author><author><orgName>Org</orgName></author>
<author><persName><surname>Ray</surname></persName></author></analytic>
<monogr><imprint><date when="2019-05-01"/></imprint></monogr><idno type="DOI"> 10.1/x </idno><idno type="doi">10.1/y</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract/><abstract><div><p>First part.</p><p>Second <ref>x</ref> part.</p></div></abstract></profileDesc></teiHeader>
<text><body><div><p>Before the head.</p><head>One<coordinates page="2" x="1" y="2" width="3" height="4"/></head>
<p>In <ref>[1]</ref> one. Two sentences!<coordinates page="2"/><coordinates page="x"/></p>
<div><head>Deep</head><p>Inside.</p><div><p>Deeper, no head.</p></div></div>
<p>After <formula>E = <hi>m</hi></formula> the nested div.</p><p>inside.</p></div>
<p>Of the body.</p><div><head>One</head><p>In [1] one. Two sentences!</p></div>
<figure><figure type="Table"><label>T1</label></figure><figDesc>Outer</figDesc></figure><figure><figDesc>outer</figDesc></figure><div><note><div><head>No</head><p>No walk.</p></div></note></div></body>
<back><div><p>Not of the body.</p><listBibl>
<biblStruct><monogr><title>J</title></monogr><analytic><title>Art</title><author><persName>X Y</persName></author><author/></analytic><note type="raw_reference">raw</note></biblStruct>
<biblStruct><monogr><title>J</title></monogr><analytic><title>Art</title><author><persName>X Y</persName></author><author/></analytic><note type="raw_reference">raw</note></biblStruct>
<biblStruct><monogr><title>Book</title></monogr></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei_rules():
    r = files.parse_tei(XML)
    assert (r["title"], r["authors"], r["year"], r["doi"], r["abstract"]) == ("A title", ["Ann B. Lee", "Ray"], 2019, "10.1/x", "First part. Second x part.")
    assert [(s["heading"], s["level"], s["path"], [c["page"] for c in s["coords"]]) for s in r["sections"]] == [("One", 1, ["One"], [2]), ("Deep", 2, ["One", "Deep"], [])]
    texts = [(p["text"], p["section"], len(p["section_path"])) for p in r["paragraphs"]]
    assert texts == [("Of the body.", None, 0), ("Before the head.", "One", 1), ("In [1] one. Two sentences!", "One", 1), ("After E = m the nested div.", "One", 1), ("inside.", "One", 1), ("Inside.", "Deep", 2), ("Deeper, no head.", "Deep", 2), ("In [1] one. Two sentences!", "One", 1)]
    two = r["paragraphs"][2]
    assert two["sentences"] == ["In [1] one.", "Two sentences!"] and two["page"] == 2 and two["coords"] == [{"page": 2, "x": 0, "y": 0, "w": 0, "h": 0}]
    assert [(f["type"], f["label"], f["caption"]) for f in r["figures"]] == [("figure", "", "Outer"), ("Table", "T1", "")]
    assert r["references"] == [{"title": "Art", "authors": ["X Y"], "raw": "JArtX Yraw"}, {"title": "Book", "authors": [], "raw": "Book"}]
    parity = [p["text"] for p in files.parse_tei(XML, whole=False)["paragraphs"]]
    assert parity[2:4] == ["In [1]", "After E = m m"]


def test_empty_documents():
    r = files.parse_tei(f"<TEI {NS}/>")
    assert (r["title"], r["authors"], r["year"], r["doi"], r["abstract"], r["sections"], r["paragraphs"]) == ("", [], None, None, "", [], [])


def test_a_failed_service_fails_one_file(spark):
    def send(path, content):
        if path == "b":
            raise TimeoutError("late")
        return {"a": XML, "c": "  ", "d": "<x"}[path]

    pdfs = spark.createDataFrame([(p, b"x") for p in "abcd"], "path string, content binary")
    got = {r.path: r for r in files.parsed_tei(service.tei_of(pdfs, send)).collect()}
    assert got["a"].error is None and got["a"].tei.paragraphs[2].sentences == ["In [1] one.", "Two sentences!"]
    assert got["b"].error == "TimeoutError: late" and got["c"].error == "the service returned an empty text" and got["d"].error and not any(got[p].tei for p in "bcd")
    assert files.parsed_tei(spark.createDataFrame([("e", None), ("f", "")], "path string, xml string")).where("error = 'no text'").count() == 2


def test_numbers_without_one_task(spark):
    paths = [f"/in/{i * 7919 % 1000:04d}.pdf" for i in range(1000)]
    known = spark.createDataFrame([("paper_041", "h0")], "paper_id string, file_hash string")
    df = spark.createDataFrame([(p, f"h{i % 900}", b"x") for i, p in enumerate(paths)], "path string, file_hash string, content binary").repartition(7)
    found = dedup.registered(df, known)
    first = {}
    for i, p in enumerate(paths):
        first[f"h{i % 900}"] = min(p, first.get(f"h{i % 900}", p))
    want = {h: f"paper_{n + 42:03d}" for n, (p, h) in enumerate(sorted((p, h) for h, p in first.items() if h != "h0"))}
    assert {r.file_hash: r.paper_id for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    assert dedup.registered(df.where("false"), known).count() == 0


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/registry"
    rows = lambda n: spark.range(n).select(F.concat(F.lit("paper_"), "id").alias("paper_id"))
    assert registry.read_registry(spark, root) == (None, 0)
    assert registry.write_registry(rows(1), root, 0) == 1
    old, at = registry.read_registry(spark, root)
    assert registry.write_registry(rows(2), root, at) == 2
    with pytest.raises(registry.Conflict):  # a second writer that began with the same version
        registry.write_registry(rows(9), root, at)
    found, at = registry.read_registry(spark, root)
    assert at == 2 and found.count() == 2 and old.count() == 1 and registry.read_registry(spark, root, 1)[0].count() == 1
    assert len([x for x in os.listdir(root) if x.startswith("table-")]) == 2
    with pytest.raises(ValueError):
        registry.read_registry(spark, root, 5)


def test_a_refused_change_is_made_again(spark, tmp_path):
    root, calls = f"{tmp_path}/registry", []

    def change(found):
        calls.append(found.count() if found is not None else 0)
        if len(calls) == 1:
            registry.write_registry(spark.range(3), root, 0)
        return spark.range(calls[-1] + 1)

    assert registry.update_registry(spark, root, change) == 2 and calls == [0, 3]
    assert registry.read_registry(spark, root)[0].count() == 4


def test_an_unfinished_version(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/registry"
    registry.write_registry(spark.range(1), root, 0)
    open(f"{root}/version-000000002.json", "w").close()
    assert registry.read_registry(spark, root)[1] == 1
    with pytest.raises(registry.Conflict):
        registry.write_registry(spark.range(2), root, 1)
    monkeypatch.setattr(registry, "STALE", -1)
    assert registry.write_registry(spark.range(2), root, 1) == 2 and registry.read_registry(spark, root)[0].count() == 2


def test_layout_passes(spark):
    calls = {"a": '{"texts": [{"text": "x", "label": "formula"}]}', "b": '{"texts": [{"text": "y", "label": "text"}]}', "c": '{"texts": [{"text": "z", "label": "display_formula"}]}'}

    def light(path, content):
        if path == "d":
            raise OSError("unreadable")
        return calls[path]

    def heavy(path, content):
        if path == "c":
            raise TimeoutError("slow")
        assert path == "a" and bytes(content) == b"pdf"
        return '{"texts": [{"text": "$x$", "label": "formula"}]}'

    pdfs = spark.createDataFrame([(p, b"pdf") for p in "abcd"], "path string, content binary")
    got = {r.path: (r.json, r.formula_enrichment_ran, r.error) for r in service.layout_passes(pdfs, light, heavy).collect()}
    assert got["a"] == ('{"texts": [{"text": "$x$", "label": "formula"}]}', True, None) and got["b"] == (calls["b"], False, None)
    assert got["c"] == (None, False, "TimeoutError: slow") and got["d"] == (None, False, "OSError: unreadable")
    assert not any(r.formula_enrichment_ran for r in service.layout_passes(pdfs, light).collect())
    assert service.layout_passes(pdfs.where("false"), light, heavy).count() == 0


def test_line_text(spark):
    df = spark.createDataFrame([(" Results and discussion ﬁx ",), ("",), (None,)], "t string")
    assert [r.t for r in df.select(line_text(F.col("t")).alias("t")).collect()] == ["Results and discussion fix", "", ""]
