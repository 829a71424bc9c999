import re

from pyspark.sql import functions as F

from foliant.functions import text

TEXTS = ["Ann Lee1,  Bob\tRay and\nCy Dee & Di , & Ed,,Flo", "a and b AND c", "Mandy Sand&Andy  &  and ", " and x and ", ",", "", None, "A & B2*, & C and D", "band , and"]


def test_names_are_parted_as_by_the_plain_pattern(spark):
    def names(t):
        parts = [x.strip() for x in re.split(r",\s*|\s+and\s+|\s*&\s*", " ".join((t or "").split()))]
        return [x for i, x in enumerate(parts) if x and x.lower() not in [y.lower() for y in parts[:i]]]

    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", text.metadata_authors("t").alias("names")).collect()
    assert [r.names for r in rows] == [names(r.t) for r in rows]


def test_an_author_field_is_cleaned_once(spark):
    plan = spark.range(1).select(text.authors(F.col("id").cast("string")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # the field's white space, and a name's marks
