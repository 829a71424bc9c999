"""Tables in the folder that driver and executors share, used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A session in one process may have none: it gets one of its own; a cluster
    must name it, as no other machine would see a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    The files outlive any executor, so a later stage never recomputes what is upstream.
    They go when the driver's file system object is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
