"""Connected components of an edge table, as joins and aggregations (connected_components), or with parts contracted first (linked)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.scratch import materialize

#: A node and a label are 16 bytes.
BROADCAST_NODES = 1_000_000
#: Edges that one task contracts.
PART_EDGES = 1_000_000
SALTS = 8


def _labelled(edges: DataFrame, on: str, labels: DataFrame, small: bool) -> DataFrame:
    """edges with the columns of labels, one row for each value of `on`."""
    if small:
        return edges.join(F.broadcast(labels), on)
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(*edges.columns), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"]).drop("salt")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is connected to) of all nodes but these smallest ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (short := label[label] != label).any():
            label[short] = label[label[short]]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Stars with the components of edges(a long, b long), and whether these are whole: each part of about
    PART_EDGES edges becomes a forest of stars on its own, so few rounds are left to connected_components()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if rows:
            hi, lo = _forest(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["a", "b"])

    parts = max(1, ceil(edges.count() / PART_EDGES))
    return edges.select("a", "b").coalesce(parts).mapInArrow(run, "a long, b long"), parts == 1


def linked(edges: DataFrame) -> DataFrame:
    """connected_components() of a table in the shared folder, by contracted() first."""
    stars, whole = contracted(edges)
    if not whole:
        return connected_components(stars)
    e = materialize(stars.withColumnsRenamed({"a": "hi", "b": "lo"}), "star")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges(a long, b long); component is the smallest id that can be reached.

    Alternating large-star and small-star steps (Kiveris and others, 2014): the number of rounds
    grows with the logarithm of the size, and no group is collected. Up to BROADCAST_NODES nodes, their smallest
    neighbours are broadcast, so that edges stay where they are; beyond, they are joined by a node
    and a salt, so that a node with very many neighbours is dealt to SALTS tasks. An empty table gives an empty one; self-loops and repeats are harmless.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = materialize(e, "edges")
    small = 2 * e.count() <= BROADCAST_NODES
    before = None
    while True:
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _labelled(both.where("v > u"), "u", least, small).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = _labelled(large, "hi", low, small).select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        e = materialize(near, "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct()
        before = now
