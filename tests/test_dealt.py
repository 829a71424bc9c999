"""Spans of words are made behind the shuffle of documents; TEI records leave a batch in parts."""

import contextlib
import io

from foliant import queries
from foliant.sources import files


def test_font_stats_shuffles_no_spans(spark, tmp_path):
    spark.createDataFrame([(i, f"Some words {i}\nof two lines") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.font_stats(spark, str(tmp_path))
    with contextlib.redirect_stdout(io.StringIO()) as said:
        out.explain()
    assert out.count() == 20
    dealt = [x for x in said.getvalue().splitlines() if "Exchange hashpartitioning" in x]
    # whole documents are, and the lines made of spans; spans themselves are grouped where they are
    assert any("REPARTITION_BY_NUM" in x for x in dealt) and not any("line_no" in x for x in dealt), dealt


def test_tei_records_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "HELD_CHARS", 100)
    texts = [(str(i), None if i % 7 == 3 else f"<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body><p>Text {i}.</p></body></text>" + ("</TEI>" if i % 7 else "")) for i in range(40)]
    got = {r.path: r for r in files.parsed_tei(spark.createDataFrame(texts, "path string, xml string").coalesce(1)).collect()}
    assert len(got) == 40
    for path, xml in texts:
        assert (got[path].error is None) == (xml is not None and xml.endswith("</TEI>"))
        assert got[path].error is not None or [p.text for p in got[path].tei.paragraphs] == [f"Text {path}."]
