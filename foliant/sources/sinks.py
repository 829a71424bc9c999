"""Writers: one table for each artifact, and counts of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifacts(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Each table below root/name, in Parquet or JSON, replacing what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{root}/{name}")


def write_documents(documents: DataFrame, root: str, by: str = "paper_id") -> None:
    """One UTF-8 JSON document for each row, below root/by=<id>, replacing those of the same ids alone."""
    documents.select(by, F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).text(root)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Rows by outcome: extracted, skipped, failed."""
    return outcomes.groupBy("outcome").count()
