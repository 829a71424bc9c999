"""The query of the authors reads the text of the line that holds them."""

from foliant import queries


def test_names_come_from_the_lines_text(spark, tmp_path):
    lines = ["A title of twenty letters or more", "Eve Fox, Gil Hay. Ann Lee", "x"]
    rows = [(1, "\n".join(lines)), (2, "\n".join([lines[0], "Ida Jay and nothing else", "x"]))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.authors for r in queries.front_authors(spark, str(tmp_path)).collect()}
    assert found == {1: "Ann Lee|Bob Ray, ; Cy Dee|Eve Fox|Gil Hay", 2: "Ann Lee|Bob Ray, ; Cy Dee|Ida Jay and nothing else"}
