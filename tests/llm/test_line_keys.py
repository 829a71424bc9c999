"""A line's keys are made once each: those that it is indexed by are among those that it probes."""

from pyspark.sql import functions as F

from foliant.llm import linededup

LINES = ["abcdefghij", "a line of twenty signs and more", "éa b\U0001d4d0 n e w.w.bb", "e" * 40, "           ", "no"]


def test_twelve_keys_all_different(spark):
    n = F.length("line")
    index, probes = linededup._index(F.col("line"), n), linededup._probes(F.col("line"), n)
    assert (len(index), len(index) + len(probes)) == (linededup.INDEXED, linededup.PROBED)
    rows = spark.createDataFrame([(x,) for x in LINES[:3]], "line string").select(F.array(*index, *probes)).collect()
    assert all(len(set(r[0])) == linededup.PROBED for r in rows)


def test_counts_as_python(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").select("line", linededup._counts(F.col("line")).alias("f")).collect()
    for line, f in rows:
        assert [f >> 4 * i & 15 for i in range(16)] == [line.count(c) % 16 for c in linededup._COUNTED]
