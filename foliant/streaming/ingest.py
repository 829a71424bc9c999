"""Idempotent ingest of a folder as a stream: each new file hash is registered once.

The stream's own state forgets a hash after a while; the registry is the lasting memory, which every batch is held against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from foliant.operators import dedup
from foliant.sources import registry

FILES = "path string, modificationTime timestamp, length long, content binary"
RECORD = "paper_id string, filename string, file_hash string, ingestion_date timestamp, status string"


def new_hashes(spark: SparkSession, root: str, most_files: int = 1_000, keep: str = "1 day") -> DataFrame:
    """A stream of the folder's PDFs, each content once as long as its hash is kept: until files that are newer by `keep`
    have come. A file older than that is late: it is left out, and a batch ingest of the folder takes it."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", most_files).load(root)
    return files.withColumn("file_hash", F.sha2("content", 256)).withWatermark("modificationTime", keep).dropDuplicatesWithinWatermark(["file_hash"])


def register_batch(root: str, prefix: str = "paper_") -> Callable[[DataFrame, int], None]:
    """What registers a batch of files(path, file_hash): hashes that the newest version of the registry below root doesn't know
    get records in the next version. A batch that comes again, or a hash whose state went, changes nothing; another writer's version is
    taken into account and the batch tried again."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        files = batch.select("path", "file_hash")

        def known() -> DataFrame:
            found, _ = registry.read_registry(spark, root)
            return found if found is not None else spark.createDataFrame([], RECORD)

        if dedup.new_files(files, known()).isEmpty():
            return
        registry.update_registry(spark, root, lambda found: _with_new(files, found if found is not None else spark.createDataFrame([], RECORD), prefix))

    return run


def _with_new(files: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    return known.unionByName(dedup.registered(files, known, prefix), allowMissingColumns=True)


def registering(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands every batch of new files to upsert, such as register_batch(), which must accept a batch again."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert)
