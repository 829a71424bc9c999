"""The folder stream against the registry, stored audits, and outcomes of stages."""

import json

from pyspark.sql import functions as F

from foliant.plans import outcomes, papers
from foliant.sources import files, registry
from foliant.streaming import ingest


def test_a_hash_stays_known_without_the_streams_state(spark, tmp_path):
    folder, root = tmp_path / "in", f"{tmp_path}/registry"
    folder.mkdir()

    def run(n):
        """A stream with a new checkpoint, so without any state."""
        ingest.registering(ingest.new_hashes(spark, str(folder)), ingest.register_batch(root), f"{tmp_path}/check{n}").trigger(availableNow=True).start().awaitTermination()
        found, version = registry.read_registry(spark, root)
        return {r.filename: r.paper_id for r in found.collect()}, version

    for name, content in (("b.pdf", b"2"), ("a.pdf", b"1"), ("c.pdf", b"1"), ("d.txt", b"3")):
        (folder / name).write_bytes(content)
    first = run(1)
    assert len(first[0]) == 2 and set(first[0].values()) == {"paper_001", "paper_002"} and first[1] == 1
    assert run(2) == first
    (folder / "e.pdf").write_bytes(b"1")
    (folder / "f.pdf").write_bytes(b"5")
    second = run(3)
    assert second == (first[0] | {"f.pdf": "paper_003"}, 2)


def test_stored_audits(spark, tmp_path):
    block = {"block_no": 0, "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "text": "some 7 words"}
    (tmp_path / "p1.json").write_text(json.dumps({"metadata": {"title": "T", "creation_date": "D:2020"}, "num_pages": 2, "pages": [{"page_no": 1, "blocks": [block, block | {"block_no": 1, "y0": 1.0, "text": "first"}]}, {"page_no": 2, "blocks": []}]}, indent=1))
    (tmp_path / "p2.json").write_text("{")
    (tmp_path / "note.txt").write_text("x")
    info, blocks = files.audit_blocks(spark, str(tmp_path))
    got = {r.paper_id: r for r in papers.audit_documents(blocks, info).collect()}
    assert got["p1"].text == "first\n\nsome 7 words" and got["p1"].num_pages == 2 and got["p1"].stats.blocks == 2 and got["p1"].metadata.title == "T"
    assert got["p2"].text == "" and got["p2"].metadata is None
    assert "blocks" not in info.select("num_pages")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_outcomes(spark):
    rows = [("a", "a.pdf", '{"texts": []}'), ("b", "b.pdf", "{"), ("c", "", '{"texts": []}'), (None, "n.pdf", '{"texts": []}'), ("d", "d.pdf", None), ("e", "e.pdf", '{"texts": []}'), ("e", "e2.pdf", '{"texts": []}'), ("f", "f.pdf", "{}"), ("g", "g.pdf", '{"texts": []}')]
    df = spark.createDataFrame(rows, "paper_id string, filename string, json string")
    results, found = outcomes.isolated(df, lambda x: x.where("paper_id <> 'g'").select("paper_id", F.lit(1).alias("v")), outcomes.cleaning_rules(), "clean")
    assert [r.paper_id for r in results.collect()] == ["a"]
    got = sorted((r.paper_id or "", r.outcome, r.error or "") for r in found.collect())
    assert got == [("", "failed", "no id"), ("a", "done", ""), ("b", "failed", "broken layout tree"), ("c", "failed", "no filename"), ("d", "failed", "no layout tree"), ("e", "failed", "repeated id"), ("e", "failed", "repeated id"), ("f", "failed", "a layout tree without texts"), ("g", "failed", "no result")]
    assert outcomes.dead_letters(df, found).count() == 8
    assert outcomes.to_do(df, found, "clean").count() == 0 and outcomes.to_do(df, found, "chunk").count() == 9
    assert outcomes.to_do(df, found, "clean", retry_failed=True).count() == 8
    _, none = outcomes.isolated(df.where("false"), lambda x: x, outcomes.cleaning_rules(), "clean")
    assert none.count() == 0
