"""canonical documents: what is stored and shuffled of papers that have no layout blocks."""

from foliant import queries
from foliant.operators import canonical


def test_texts_of_papers_without_blocks_are_not_stored(spark, monkeypatch):
    stored, real = [], canonical.materialize
    monkeypatch.setattr(canonical, "materialize", lambda df, label="table": stored.append(real(df, label)) or stored[-1])
    targets = spark.createDataFrame([(f"p{i}", f"one two three {i}") for i in range(50)], "paper_id string, text string")
    blocks = spark.createDataFrame([("p7", "one two three 7", "text")], "paper_id string, text string, label string")
    assert [tuple(r) for r in canonical.layout_pairs(targets, blocks).collect()] == [("p7", "one two three 7", "one two three 7", 1.0, 1.0)]
    assert sum(x.count() for x in stored) == 2
    stored.clear()
    assert canonical.layout_pairs(targets, blocks.where("false")).isEmpty()
    assert sum(x.count() for x in stored) == 0


def test_canonical_records_are_dealt_by_document(spark):
    plan = queries.canonical_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan
    assert any("hashpartitioning(doc_id" in x and "REPARTITION_BY_NUM" in x for x in plan.splitlines())
