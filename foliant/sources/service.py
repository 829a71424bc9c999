"""The boundary to services that turn PDFs into TEI or layout trees: a client of the caller's is run on the executors, file by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.scratch import materialize
from foliant.sources.files import with_formula_regions

# The service's paths and the form fields of a request.
ALIVE, FULL_TEXT = "/api/isalive", "/api/processFulltextDocument"
FIELDS = {"consolidateHeader": "0", "consolidateCitations": "0", "includeRawCitations": "1"}
COORDINATES = ("head", "p", "figure", "table")


def request_fields(segment_sentences: bool = True, coordinates: tuple[str, ...] = COORDINATES) -> dict[str, str]:
    """Form fields of a request for one file."""
    return FIELDS | {"segmentSentences": "1" if segment_sentences else "0", "teiCoordinates": ",".join(coordinates)}


def healthy(probe: Callable[[], int]) -> bool:
    """Whether a service answers; probe calls it and returns the status, and may raise what it likes."""
    try:
        return 200 <= probe() < 300
    except Exception:
        return False


def tei_of(files: DataFrame, send: Callable[[str, bytes], str]) -> DataFrame:
    """(path, xml, error) of files(path, content): what send(path, content) returns for each.

    A file that fails, or comes back empty, has an error and no xml, and stops no other. send must be
    picklable; it runs once for each file of a task, and again where a task is repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    xml = send(path, content)
                    rows.append((path, xml, None) if xml and xml.strip() else (path, None, "the service returned an empty text"))
                except Exception as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "xml", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, xml string, error string")


def _answers(files: DataFrame, send: Callable[[str, bytes], str]) -> DataFrame:
    """(path, json, error): tei_of() for services whose answers are layout trees."""
    return tei_of(files, send).withColumnRenamed("xml", "json")


def layout_passes(files: DataFrame, light: Callable[[str, bytes], str], heavy: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(path, json, formula_enrichment_ran, error) of files(path, content): the layout tree of each, by a cheap pass over all and, where that
    has found formula regions and `heavy` is given, by an expensive one instead.

    The first pass is written once, so neither branch runs it again; only files of the second one have their content read again, dealt to
    all tasks by path. A file that either pass fails has an error and no tree, and stops no other. Paths are distinct.
    """
    first = _answers(files, light).withColumn("formula_enrichment_ran", F.lit(False))
    if heavy is None:
        return first.select("path", "json", "formula_enrichment_ran", "error")
    first = materialize(first, "layout")
    formulas = with_formula_regions(first.where("json is not null")).select("path")
    again = _answers(files.join(formulas, "path", "left_semi").repartition("path"), heavy).withColumn("formula_enrichment_ran", F.col("error").isNull())
    rest = first.join(formulas, "path", "left_anti")
    return rest.unionByName(again).select("path", "json", "formula_enrichment_ran", "error")


def outcomes(files: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """(path, outcome, error) of files(path, file_hash): skipped where known has the hash, else failed or extracted as in answers."""
    seen = known.select("file_hash").where("file_hash is not null").distinct().withColumn("_seen", F.lit(True))
    rows = files.select("path", "file_hash").join(seen, "file_hash", "left").join(answers.select("path", "error", F.lit(True).alias("_done")), "path", "left")
    outcome = F.when(F.col("_seen"), "skipped").when(F.col("_done") & F.col("error").isNull(), "extracted").otherwise("failed")
    return rows.select("path", outcome.alias("outcome"), F.when(outcome == "failed", F.coalesce("error", F.lit("no answer"))).alias("error"))
