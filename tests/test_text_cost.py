"""Text rules that look at whole texts: right for any white space, and no work where there is nothing to do."""

from pyspark.sql import functions as F

from foliant.functions import text

ODD = ["a b c", "  a \t b\n", "a b", "　x  y\x1c", "a\x85\x85b", " ", "", "\x1f \x0b", "é\U0001d4d0  z", "a  b", "\tq"]


def _rows(spark, items, column):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(items)], "i int, t string").orderBy("i").select(column.alias("x")).collect()]


def test_single_spaces_are_not_replaced(spark):
    assert _rows(spark, ["many words of one line", "a  b\tc \n"], F.regexp_count("t", F.lit(text.ODD_SPACES))) == [0, 3]


def test_clean_and_strip_as_python(spark):
    assert _rows(spark, ODD, text.clean("t")) == [" ".join(x.split()) for x in ODD]
    assert _rows(spark, ODD, text.strip("t")) == [x.strip() for x in ODD]
    assert _rows(spark, ["x †‡", "†", "a  b‡ c ", "q†\t"], text.title_text("t")) == ["x", "", "a b‡ c", "q"]


def test_last_word_from_the_end(spark):
    items = ["A the Cat. ", "one two 12", "x", "12 34", "", " -And", "a\nb, c3d4 5", "café é"]
    assert _rows(spark, items, text.last_word("t")) == ["cat", "two", "x", "", "", "-and", "c3d", "caf"]
    assert _rows(spark, ["the cat. 1", "x", "", "7 -", "one two-3"], text.last_clean_word(F.col("t"))) == ["cat", "x", "", "", "two"]
