"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Sources in code point order, null last, weigh 1, 2, 3, repeating. A source's target is its share of all
words, at most CAP times its own size; what is cut off is shared again by weight among the others.
Words go to sources by the highest quotients target / (2 * words + 1), up to CAP times the source's size,
then each source's words to its shards in the same way, so that sources of less than a block have theirs. Within a shard documents lie in a seeded order; a quota
of more words than the shard has takes it whole once or more, and the rest are blocks of BLOCK_WORDS in a seeded order,
the last of them cut, so that a shard gives exactly its quota.

A source of many documents has many shards, so no group holds more than about SHARD_ROWS of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.arrowtext import slices, words
from foliant.plans.scratch import materialize

CAP = 3
SHARD_ROWS = 50_000
#: Sources are a table of one row each, which the driver reads; more than this many are refused.
MAX_SOURCES = 1_000_000
#: Up to so many are broadcast, so that a hot source's documents stay where they are; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A shard's words are taken in blocks of so many, the last of them cut.
BLOCK_WORDS = 256
#: A prime beyond any shard's number of blocks: multiplying by it permutes them.
_STEP = 2_147_483_647


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[Fraction]:
    """Targets in words, by weight, none above cap times its size; they add up to the sum of sizes."""
    left, out = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > cap * sizes[i] * total]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def apportion(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague: seats by highest votes / (2 * got + 1), at most most[i] each; ties to the earlier entry."""
    v = np.array(votes, float)
    cap = np.array(most, np.int64)
    seats = min(seats, int(cap[v > 0].sum()))
    if seats <= 0 or not len(v):
        return [0] * len(votes)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(v / divisor + 0.5).astype(np.int64), cap)

    low, high = v.sum() / seats / 4, 4 * v.sum() / seats + 2 * v.max()
    while at(low).sum() < seats:
        low /= 4
        if low < v[v > 0].min() / (4 * seats + 4):
            break
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = at(high)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if v[i] > 0 and got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def _key(column: str) -> Column:
    """A key that is never null: null sources make a group of their own."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), part.column("digest"), pa.array(words(part.column("text")).counts)], ["id", "source", "digest", "size"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, source string, digest long, size long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per row of docs: (id, source, digest, size, source_size, target, taken, passes, spans).

    size: words `[^\\x20\\x09-\\x0D]+` of the text, 0 for a null one. taken: words that the mix takes of it,
    passes whole copies and the word ranges in spans; never over CAP times its size. Documents without
    words have taken 0. An empty table gives no rows. Equal inputs give equal results, however they are
    partitioned; rows that repeat an id are separate documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sized").withColumn("key", _key("source"))
    found = sized.groupBy("key").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(found, key=lambda r: (r.key == "-", r.key))
    sizes = [r.source_size for r in rows]
    total = sum(sizes)
    block = BLOCK_WORDS
    want = targets(sizes, [1 + i % 3 for i in range(len(rows))])
    quota = apportion([float(x) for x in want], total, [CAP * s for s in sizes])
    table = [(r.key, r.source_size, float(w), q, max(1, ceil(r.docs / SHARD_ROWS))) for r, w, q in zip(rows, want, quota, strict=True)]
    sources = spark.createDataFrame(table, "key string, source_size long, target double, quota long, shards long")
    if len(table) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    order = F.xxhash64(F.col("id"), F.lit(seed))
    dealt = sized.join(sources, "key").withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("shards")))

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", kind="stable")
        t = group["tokens"].tolist()
        group["give"] = apportion([float(x) for x in t], int(group["quota"].iloc[0]), [CAP * x for x in t])
        return group[["key", "shard", "tokens", "give"]]

    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("tokens"), F.first("quota").alias("quota"))
    shards = shards.groupBy("key").applyInPandas(deal, "key string, shard long, tokens long, give long")
    place = Window.partitionBy("key", "shard").orderBy("order", "id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(place)).join(shards, ["key", "shard"])
    placed = placed.withColumn("begin", F.col("end") - F.col("size"))
    placed = placed.withColumn("passes", F.when(F.col("tokens") > 0, F.expr("give div tokens")).otherwise(F.lit(0).cast("long")))
    placed = placed.withColumn("rest", F.col("give") - F.col("passes") * F.col("tokens")).withColumn("full", F.expr(f"tokens div {block}"))
    placed = placed.withColumn("offset", F.when(F.col("full") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.col("full"))).otherwise(F.lit(0).cast("long")))

    def span(b: Column) -> Column:
        rank = F.when(b < F.col("full"), F.pmod(F.pmod(b * _STEP, F.col("full")) + F.col("offset"), F.col("full"))).otherwise(F.col("full"))
        have = F.least(F.lit(block), F.col("tokens") - b * block)
        use = F.greatest(F.lit(0), F.least(have, F.col("rest") - rank * block))
        lo = F.greatest(b * block, F.col("begin"))
        hi = F.least(b * block + use, F.col("end"))
        return F.struct((lo - F.col("begin")).cast("long").alias("lo"), (hi - F.col("begin")).cast("long").alias("hi"))

    blocks = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))
    spans = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.filter(F.transform(blocks, span), lambda s: s["hi"] > s["lo"])).otherwise(F.expr("array()").cast("array<struct<lo:bigint,hi:bigint>>"))
    out = placed.withColumn("spans", spans)
    part = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["hi"] - s["lo"])
    return out.select("id", "source", "digest", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"), "passes", "spans")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy that it takes of a document,
    and a row with its selected blocks, if any, as they stand in the text, one to a line.

    A null id or source, and repeated rows, are documents like others; a document without words, so a null or
    empty one too, is in no mix; an empty table gives none. Columns of docs may have any names.
    """
    chosen = plan(docs, id_col, text_col, source_col, seed).where("taken > 0").select("id", "digest", "passes", "spans", "size")
    turn = Window.partitionBy("id", "digest").orderBy("size")
    chosen = chosen.withColumn("turn", F.row_number().over(turn.orderBy("passes", "spans")))
    # the row travels as one value, so its names can't clash with others
    names, schema = docs.columns, docs.schema
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("mark"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("own", "mark").orderBy(F.col("row")[source_col])))
    joined = rows.join(chosen, F.col("own").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("digest")) & (F.col("place") == F.col("turn")))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = dict(zip(names, batch.column("row").flatten(), strict=True))
            whole = pa.RecordBatch.from_arrays(list(fields.values()), names)
            copies, spans = batch.column("passes").to_numpy(), batch.column("spans").to_pylist()
            begin = 0
            for part in slices(whole, text_col):
                own = slice(begin, begin + part.num_rows)
                begin += part.num_rows
                yield part.take(pa.array(np.repeat(np.arange(part.num_rows), copies[own])))
                some = [i for i, s in enumerate(spans[own]) if s]
                if some:
                    w = words(part.column(at))
                    cut = []
                    for i in some:
                        first = w.first[i]
                        cut.append(b"\n".join(w.data[w.starts[first + s["lo"]] : w.ends[first + s["hi"] - 1]].tobytes() for s in spans[own][i]).decode())
                    rest = part.take(pa.array(some))
                    yield rest.set_column(at, rest.schema.field(at), pa.array(cut, rest.schema.field(at).type))

    return joined.select("row", "passes", "spans").mapInArrow(run, schema)
