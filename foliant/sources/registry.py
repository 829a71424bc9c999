"""Versions of the registry: tables beside one another, and a manifest for each that only one writer can create.

Version n is the file `version-<n>.json`, which names the folder of its table. A writer puts its table in a folder of its own,
then creates the next version's file, which fails where it exists (compare and swap: the writer says which
version it read). Readers take the highest version; what they read stays as it is. On a store whose create isn't atomic, such as
a local disk, two writers at the same moment may both believe that they were first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: A manifest that has been empty for so many seconds is one of a writer that died.
STALE = 600


class Conflict(Exception):
    """Another writer has made, or is making, a newer version than the one that this one began with."""


def _folder(spark: SparkSession, root: str) -> tuple[JavaObject, JavaObject]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _manifests(spark: SparkSession, root: str) -> dict[int, JavaObject]:
    """The status of each version's file."""
    fs, path = _folder(spark, root)
    if not fs.exists(path):
        return {}
    names = {s.getPath().getName(): s for s in fs.listStatus(path)}
    return {int(n[8:-5]): s for n, s in names.items() if n.startswith("version-") and n.endswith(".json") and n[8:-5].isdigit()}


def newest_version(spark: SparkSession, root: str) -> int:
    """The highest version that is whole; 0 if there is none."""
    return max((n for n, s in _manifests(spark, root).items() if s.getLen() > 0), default=0)


def read_registry(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame | None, int]:
    """(table, version) of the newest version, or of the one that is asked for; (None, 0) where there is none yet."""
    at = newest_version(spark, root) if version is None else version
    if not at:
        return None, 0
    status = _manifests(spark, root).get(at)
    if status is None or not status.getLen():
        raise ValueError(f"there is no version {at} below {root}")
    text = spark.read.option("wholetext", True).text(status.getPath().toString()).first().value
    return spark.read.parquet(f"{root}/{json.loads(text)['table']}"), at


def write_registry(registry: DataFrame, root: str, expected: int) -> int:
    """Write the version after `expected`, which registry was made from (0: none), and return its number.

    Conflict where another writer was first; its table stays the newest and this one's is removed.
    """
    spark = registry.sparkSession
    fs, path = _folder(spark, root)
    table = f"table-{uuid.uuid4().hex}"
    of = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)
    _refuse(spark, root, expected)
    registry.write.parquet(f"{root}/{table}")
    try:
        _refuse(spark, root, expected)
        out = fs.create(of(f"version-{expected + 1:09d}.json"), False)
        out.write(bytearray(json.dumps({"table": table, "before": expected}).encode()))
        out.close()
    except (Py4JJavaError, Conflict) as e:
        fs.delete(of(table), True)
        if isinstance(e, Py4JJavaError) and "exist" not in str(e.java_exception).lower():
            raise
        raise Conflict(f"version {expected + 1} of {root} has another writer") from e
    return expected + 1


def _refuse(spark: SparkSession, root: str, expected: int) -> None:
    """Conflict unless `expected` is the newest version and no other writer is at the next one; what a dead one left is removed."""
    fs, _ = _folder(spark, root)
    for n, status in _manifests(spark, root).items():
        if n > expected:
            if status.getLen() or time.time() - status.getModificationTime() / 1000 < STALE:
                raise Conflict(f"version {n} of {root} is newer than {expected}")
            fs.delete(status.getPath(), False)


def update_registry(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Write change(newest registry, or None) as the next version; on a conflict again from the version that is newest then."""
    for left in reversed(range(tries)):
        found, at = read_registry(spark, root)
        try:
            return write_registry(change(found), root, at)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")
