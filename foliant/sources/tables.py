"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_spread(spark: SparkSession, root: str, name: str) -> DataFrame:
    """read_table(), its rows dealt to all cores where the table has fewer files than these: one row group is one
    task's. Tables of many splits stay as they are, without a shuffle."""
    table = read_table(spark, root, name)
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= 4 * cores or len(table.inputFiles()) >= cores:
        return table
    return table.repartition(cores)


def read_dealt(spark: SparkSession, root: str, name: str, key: str) -> DataFrame:
    """read_table(), its rows dealt by a key once: what is made of a row and grouped by the key isn't shuffled again. There are
    many parts for a large table, so that a part's rows, made into many more, can be sorted in memory."""
    table = read_table(spark, root, name)
    parts = max(spark.sparkContext.defaultParallelism, 8 * table.rdd.getNumPartitions())
    return table.repartition(parts, key)
