"""Outcomes of papers by stage: rows that a stage can't take are set aside with a reason, and runs go on with what is left to do.

A stage of DataFrame operators has no exception that belongs to one paper, so what would end the job is checked before
it, as rules on the rows; services, which do raise, give outcomes of their own (sources.service).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.scratch import materialize

DONE, FAILED = "done", "failed"


def cleaning_rules(by: str = "paper_id") -> dict[str, Column]:
    """What a parsed document needs to be cleaned, of columns by, filename and json, a layout tree."""
    text = F.coalesce("json", F.lit(""))
    return {
        "no id": F.col(by).isNotNull() & (F.col(by).cast("string") != ""),
        "no filename": F.coalesce("filename", F.lit("")) != "",
        "no layout tree": text != "",
        "broken layout tree": F.try_parse_json(text).isNotNull(),
        "a layout tree without texts": F.get_json_object(text, "$.texts").isNotNull(),
    }


def judged(papers: DataFrame, rules: dict[str, Column], by: str = "paper_id") -> DataFrame:
    """papers with error: the name of the first rule that a row breaks, `repeated id` for rows of an id that more than one has, else null."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    repeated = F.when(F.col(by).isNotNull() & (F.count("*").over(Window.partitionBy(by)) > 1), F.lit("repeated id"))
    return papers.withColumn("error", F.coalesce(reason, repeated))


def isolated(papers: DataFrame, stage: Callable[[DataFrame], DataFrame], rules: dict[str, Column], name: str, by: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(results, outcomes): stage() over the papers that break no rule, and (by, stage, outcome, error) of every paper.

    A paper that the stage gives no row for has failed as well, with the error `no result`. Papers are read once, results written once.
    """
    rows = materialize(judged(papers, rules, by), "judged")
    results = materialize(stage(rows.where("error is null").drop("error")), name)
    got = results.select(by, F.lit(True).alias("_got")).distinct()
    error = F.coalesce("error", F.when(F.col("_got").isNull(), F.lit("no result")))
    out = rows.select(by, "error").join(got, by, "left").withColumn("error", error)
    return results, out.select(by, F.lit(name).alias("stage"), F.when(F.col("error").isNull(), DONE).otherwise(FAILED).alias("outcome"), "error")


def dead_letters(papers: DataFrame, outcomes: DataFrame, by: str = "paper_id") -> DataFrame:
    """papers that failed, each with its error, to be kept and looked at."""
    bad = outcomes.where(F.col("outcome") == FAILED).select(by, "error").distinct()
    right = bad.withColumnRenamed(by, "_by")
    return papers.join(right, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def to_do(papers: DataFrame, outcomes: DataFrame, stage: str, retry_failed: bool = False, by: str = "paper_id") -> DataFrame:
    """papers that the stage has not done: those without an outcome, with retry_failed also those that failed and never were done since."""
    seen = outcomes.where(F.col("stage") == stage)
    if retry_failed:
        seen = seen.where(F.col("outcome") == DONE)
    seen = seen.select(F.col(by).alias("_by")).distinct()
    return papers.join(seen, F.col(by).eqNullSafe(F.col("_by")), "left_anti")
