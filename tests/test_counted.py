"""Words of two texts are counted in one pass by dealt papers; equal lists are settled without being taken apart."""

import contextlib
import io

from pyspark.sql import functions as F

from foliant import queries
from foliant.functions import text
from foliant.operators import quality


def test_counted_both(spark):
    rows = [(1, ["a", "b", "a"], ["a", "c"]), (2, ["x", "x", "y"], ["x", "x", "y"]), (3, [], []), (4, [], ["z"])]
    df = spark.createDataFrame(rows, "paper_id int, l array<string>, r array<string>")
    got = {tuple(r) for r in quality.counted_both(df, "paper_id", F.col("l"), F.col("r")).collect()}
    assert got == {(1, "a", 2, 1), (1, "b", 1, 0), (1, "c", 0, 1), (2, None, 3, 3), (3, None, 0, 0), (4, "z", 0, 1)}


def test_metrics_of_odd_texts(spark):
    rows = [(1, "1 a 2", "1 a 2"), (2, "", ""), (3, "a b", "b c"), (4, "x", " \n"), (5, "7 7", "7"), (6, "?", "?"), (7, None, "a")]
    pairs = spark.createDataFrame(rows, "paper_id int, tei string, pdf string")
    f1 = {r[0]: r[1] for r in quality.cross_parser_consistency(pairs).collect()}
    assert f1 == {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 2 / 3, 6: 0.0, 7: 0.0}
    numbers = {r[0]: r[1] for r in quality.numeric_consistency(pairs).collect()}
    assert numbers == {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.5, 6: 0.5, 7: 0.0}
    share = {r[0]: r[1] for r in quality.coverage(pairs, "tei", "pdf", "paper_id").collect()}
    assert share == {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 1.0, 6: 0.0, 7: 0.0}


def test_numbers_as_by_the_plain_pattern(spark):
    items = ["a1 1a 1 1,000.5e-3% x", "١٢ é٣ 4", "1.2.3 -5 5%5", "", "_7 7_ 7"]
    df = spark.createDataFrame([(t,) for t in items], "t string")
    for pattern in (text.NUMBER, text.FAST_NUMBER):
        found = df.select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).collect()
        assert [r[0] for r in found] == [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(text.NUMBER), F.lit(0))).collect()]


def test_evaluation_shuffles_no_words(spark, tmp_path):
    spark.createDataFrame([(i, f"Some words {i}\nof two lines", "s", "en") for i in range(20)], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.integrity_evaluation(spark, str(tmp_path))
    with contextlib.redirect_stdout(io.StringIO()) as said:
        out.explain()
    assert out.count() == 20
    dealt = [x for x in said.getvalue().splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt), dealt
