"""Settings of a run: defaults, overruled by the session's configuration. Reading them makes no folder and no connection."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.foliant."


@dataclass(frozen=True)
class Settings:
    """Where a run reads and writes, and how it calls services."""

    service_url: str = "http://localhost:8070"
    service_timeout: int = 120
    embedding_model: str = "pritamdeka/S-PubMedBert-MS-MARCO"
    papers: str = "papers"
    registry: str = "storage/registry"
    tei: str = "storage/tei"
    canonical: str = "storage/canonical"
    artifacts: str = "storage/artifacts"
    evaluation: str = "storage/evaluation"
    chunks: str = "storage/chunks"
    max_tokens: int = 450
    overlap_tokens: int = 60


def settings(spark: SparkSession) -> Settings:
    """Settings with the values of spark.foliant.<name>; unknown names are ignored, a number that is none is an error."""
    found = {}
    for f in fields(Settings):
        value = spark.conf.get(PREFIX + f.name, None)
        if value is not None:
            found[f.name] = type(f.default)(value)
    return Settings(**found)
