"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Method. A text's set is its distinct word shingles. Two collections of TABLES_A and TABLES_B short
sketches, each of ROWS minhashes, give TABLES_A * TABLES_B bucket keys: key (i, j) combines sketch i
of the first with sketch j of the second, so 48 minhashes serve 144 tables of 4 rows each. At the
similarity 0.8 a pair misses all tables with probability 2 * (1 - 0.64)**12 < 1e-5.

Links. Rows of one bucket become candidate pairs: all pairs in a bucket of up to STAR rows, and pairs
with one leader in a larger one. Candidates are confirmed on the whole sets: first two for each text from some of the tables, then those of all
tables whose texts the links so far don't join, so that a large group takes few confirmations. What a star may miss is
made up for exactly: the buckets over STAR rows, in all or in one map part, tie their members into coarse clusters, and every
member of a coarse cluster that is outside the cluster's largest component is compared with the
members of other components there that it can be linked to at all: a pair shares no more of the shingles
that half the cluster has, and no more of the others that are in several texts, than either text has of them,
nor more of any class of such shingles by hash. Where it is fewer, only members meet that share one of their rarest
shingles in the cluster, of which so many are taken that linked texts share one (a prefix filter, exact too): chance
chains ever more short texts to one cluster as the table grows, and all of its pairs would grow with its square.
The same bound holds off candidates before their sets are fetched.

Scale. Texts with equal sets are one row from the start, and buckets of a map batch over STAR rows
are reduced to two rows before the shuffle, so that a group which holds a third of all rows reaches no
reducer whole. Candidate rows grow in proportion to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.arrowtext import distinct, grouped, mix, shingles, slices, words
from foliant.llm.components import _forest, linked
from foliant.plans.scratch import materialize

TABLES_A = TABLES_B = 12
ROWS = 2
BITS = 64
STAR = 4
LEADERS = 1
#: Of BITS one-bit minhashes, a pair at 0.8 agrees in 57.6 on average; 42 is over six deviations less.
AGREE = 42
KEYS_PER_TASK = 2_000_000
#: Rows of a map part whose keys are sorted together.
PART_ROWS = 512
#: Of BITS, so many agree in pairs that are worth a look first.
LIKELY = 54
#: Salts of the hot side where members of a coarse cluster meet.
SALTS = 16
#: Classes of shingles by hash whose counts bound what two members share.
CLASSES = 32

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 32, BITS, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, BITS, dtype=np.uint32)
_SECOND = np.uint64(0x5851F42D4C957F2D)
_SEED = _rng.integers(0, 1 << 63, LEADERS, dtype=np.uint64)
_TABLE = mix(np.arange(1, TABLES_A * TABLES_B + 1, dtype=np.uint64))
ALL = np.arange(TABLES_A * TABLES_B)
#: The tables that are looked at first.
SOME = ALL[(ALL // TABLES_B - ALL % TABLES_B) % TABLES_B < 2]

SIGNED = "id long, n_shingles long, s1 long, s2 long, halves binary, sketch long"
ROUTED = "route long, id long, other long, sketch long, component long, sizes long, usual long, kind int"
EDGES = "a long, b long, agree int, big boolean"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """SIGNED for every row of docs(id, text): set size, 128-bit set signature, half keys, one-bit sketch.

    A text that is null, empty or without words has n_shingles 0 and null in what follows.
    """

    used = (TABLES_A + TABLES_B) * ROWS

    def signed(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = part.column("id"), part.num_rows
        first, h = distinct(*shingles(words(part.column("text"), lower=True), size), n)
        count = np.diff(first)
        full = np.flatnonzero(count)
        at = first[:-1][full]
        least = np.zeros((len(full), BITS), np.uint32)
        s = np.zeros((2, len(full)), np.uint64)
        if len(full):
            short = (h >> np.uint64(32)).astype(np.uint32)
            for k in range(BITS):
                least[:, k] = np.minimum.reduceat((short ^ _XOR[k]) * _MUL[k], at)
            s[0] = np.add.reduceat(mix(h), at)
            s[1] = np.add.reduceat(mix(h ^ _SECOND), at)
        least = mix(least.astype(np.uint64))
        half = least[:, :used:ROWS].copy()
        for k in range(1, ROWS):
            half = mix(half + np.uint64(k)) ^ least[:, k:used:ROWS]
        half = mix(half)
        bits = np.bitwise_or.reduce((least & np.uint64(1)) << np.arange(BITS, dtype=np.uint64), axis=1) if len(full) else np.zeros(0, np.uint64)
        spot = np.full(n, -1)
        spot[full] = np.arange(len(full))
        take = pa.array(spot, mask=spot < 0)
        halves = pa.array([x.tobytes() for x in half], pa.binary())
        return pa.RecordBatch.from_arrays([ids, pa.array(count.astype(np.int64)), _long(s[0]).take(take), _long(s[1]).take(take), halves.take(take), _long(bits).take(take)], ["id", "n_shingles", "s1", "s2", "halves", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(signed(part) for batch in batches for part in slices(batch))

    return docs.select("id", "text").mapInArrow(run, SIGNED)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, size) of each run of equal keys in a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _stars(key: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each group of a sorted key array the index of its leader: least by one of LEADERS seeded orders."""
    if not len(first):
        return np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), size)
    rows = np.concatenate([np.arange(f, f + s) for f, s in zip(first, size, strict=True)])
    rank = mix(ids[rows].astype(np.uint64) ^ _SEED[(key[rows] % np.uint64(LEADERS)).astype(np.int64)])
    order = np.lexsort((rank, group))
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    return rows[order[starts]]


def _emit(route: np.ndarray, ids: np.ndarray, other: np.ndarray, sketch: np.ndarray, component: np.ndarray, sizes: np.ndarray, usual: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    columns = [_long(route), pa.array(ids.astype(np.int64)), pa.array(other.astype(np.int64)), _long(sketch), pa.array(component), pa.array(sizes), pa.array(usual), pa.array(kind.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["route", "id", "other", "sketch", "component", "sizes", "usual", "kind"])


def _agree(x: np.ndarray, y: np.ndarray, sketch: np.ndarray, component: np.ndarray, cluster: np.ndarray, sizes: np.ndarray, usual: np.ndarray, percent: int) -> np.ndarray:
    """Sketch bits in which rows x and y agree; 0 if they are in one component, or can't be linked by their sizes.

    sizes: shingles << 32 | those that others in the row's cluster have too; usual: those that half the cluster has.
    Two texts of a cluster share no more usual shingles, and no more of the others, than either has.
    """
    n, rare = sizes >> 32, (sizes & 0xFFFFFFFF) - usual
    most = np.where(cluster[x] == cluster[y], np.minimum(usual[x], usual[y]) + np.minimum(rare[x], rare[y]), np.minimum(n[x], n[y]))
    can = (component[x] != component[y]) & (100 * most >= percent * (n[x] + n[y] - most))
    return np.where(can, BITS - np.bitwise_count(sketch[x] ^ sketch[y]).astype(np.int32), 0)


def _bucket_rows(batches: Iterator[pa.RecordBatch], tables: np.ndarray = ALL, percent: int = 80) -> Iterator[pa.RecordBatch]:
    """Map side: rows (bucket key, id) of some tables, and star edges of buckets that are large in the batch itself.

    kind -1: a row of the bucket `route`; kind -2: one that stands for a bucket that is large. Others: an
    edge of a large bucket, the number of sketch bits that agree, or 0 where _agree() says so. A bucket row has its cluster as other.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(begin, PART_ROWS)
            n = part.num_rows
            ids = part.column("id").to_numpy()
            sketch, own = part.column("sketch").to_numpy().view(np.uint64), part.column("component").to_numpy()
            cluster, sizes, usual = (part.column(c).to_numpy() for c in ("cluster", "sizes", "usual"))
            half = np.frombuffer(b"".join(part.column("halves").to_pylist()), np.uint64).reshape(n, -1)
            a, b = half[:, :TABLES_A], half[:, TABLES_A:]
            key = mix((a[:, :, None] * np.uint64(0xA24BAED4963EE407) + b[:, None, :]).reshape(n, -1)[:, tables] ^ _TABLE[tables]).ravel()
            who = np.repeat(np.arange(n), len(tables))
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            first, size = _groups(key)
            large = size > STAR
            f, s = first[large], size[large]
            lead = _stars(key, ids[who], f, s)
            keep, kind = np.ones(len(key), bool), np.full(len(key), -1)
            kind[np.repeat(large, size)] = -2
            if len(f):
                rows = np.concatenate([np.arange(x, x + y) for x, y in zip(f, s, strict=True)])
                head = np.repeat(lead, s)
                keep[rows] = False
                keep[lead] = True
                second = np.where(f == lead, f + 1, f)
                keep[second] = True
                pair = np.unique(np.stack([who[rows], who[head]], 1), axis=0)
                pair = pair[pair[:, 0] != pair[:, 1]]
                x, y = pair[:, 0], pair[:, 1]
                yield _emit(mix(ids[x].astype(np.uint64) * np.uint64(3) + ids[y].astype(np.uint64)), ids[x], ids[y], sketch[x], own[x], sizes[x], usual[x], _agree(x, y, sketch, own, cluster, sizes, usual, percent))
            who = who[keep]
            yield _emit(key[keep], ids[who], cluster[who], sketch[who], own[who], sizes[who], usual[who], kind[keep])


def _bucket_edges(batches: Iterator[pa.RecordBatch], percent: int = 80) -> Iterator[pa.RecordBatch]:
    """Reduce side, over one partition of bucket rows: EDGES, each once in the partition.

    agree is that of _agree(); edges where it is low are left out. Those of large buckets come as a forest (big).
    """
    got = [[x.column(k).to_numpy() for k in ("route", "id", "other", "sketch", "component", "sizes", "usual", "kind")] for x in batches]
    if not got:
        return
    route, ids, other, sketch, own, sizes, usual, kind = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    m = kind >= 0
    edges = [(np.minimum(ids[m], other[m]), np.maximum(ids[m], other[m]), kind[m], np.ones(m.sum(), bool))]
    rows = np.flatnonzero(~m)
    # a key that occurs once says nothing, unless its bucket was large in a map part
    rows = rows[np.argsort(route[rows].view(np.uint64))]
    first, size = _groups(route[rows])
    rows = rows[np.repeat(size > 1, size)]
    rows = rows[np.lexsort((ids[rows], route[rows].view(np.uint64)))]
    cut, key, ids, sketch, own = kind[rows] == -2, route[rows].view(np.uint64), ids[rows], sketch[rows].view(np.uint64), own[rows]
    cluster, sizes, usual = other[rows], sizes[rows], usual[rows]
    first, size = _groups(key)
    # few rows are left here of a bucket that was large in a map part: they tie its rows, as in a larger one
    cut = np.logical_or.reduceat(cut, first) if len(first) else cut

    def add(x: np.ndarray, y: np.ndarray, big: bool) -> None:
        agree = _agree(x, y, sketch, own, cluster, sizes, usual, percent)
        use = (ids[x] != ids[y]) & ((agree >= AGREE) | big)
        x, y, agree = x[use], y[use], agree[use]
        edges.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), agree, np.full(len(x), big)))

    for n in range(2, STAR + 1):
        for big in (False, True):
            f = first[(size == n) & (cut == big)]
            if len(f):
                i, j = np.triu_indices(n, 1)
                add((f[:, None] + i).ravel(), (f[:, None] + j).ravel(), big)
    large = size > STAR
    if large.any():
        f, s = first[large], size[large]
        lead = np.repeat(_stars(key, ids, f, s), s)
        add(np.concatenate([np.arange(x, x + y) for x, y in zip(f, s, strict=True)]), lead, True)
    a, b, agree, big = (np.concatenate(x) for x in zip(*edges, strict=True))
    # of the ties of large buckets a forest says all
    hi, lo = _forest(a[big], b[big])
    near = np.flatnonzero(agree >= AGREE)
    near = near[np.lexsort((b[near], a[near]))]
    keep = np.ones(len(near), bool)
    keep[1:] = (a[near][1:] != a[near][:-1]) | (b[near][1:] != b[near][:-1])
    near = near[keep]
    agree = np.concatenate([agree[near], np.zeros(len(hi))]).astype(np.int32)
    big = np.arange(len(agree)) >= len(near)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[near], lo])), pa.array(np.concatenate([b[near], hi])), pa.array(agree), pa.array(big)], ["a", "b", "agree", "big"])


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, members): the sorted shingle hashes of each text as bytes."""

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        first, h = distinct(*shingles(words(part.column("text"), lower=True), size), part.num_rows)
        raw = h.tobytes()
        members = pa.array([raw[8 * x : 8 * y] for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("id"), members], ["id", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(sets(part) for batch in batches for part in slices(batch))

    return docs.select("id", "text").mapInArrow(run, "id long, members binary")


def _members(tied: DataFrame, size: int) -> DataFrame:
    """(cluster, id, several, h): a row for each shingle of tied(id, cluster, several, text)."""

    def members(part: pa.RecordBatch) -> pa.RecordBatch:
        first, h = distinct(*shingles(words(part.column("text"), lower=True), size), part.num_rows)
        at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(first)))
        return pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("cluster", "id", "several")), _long(h)], ["cluster", "id", "several", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(members(part) for batch in batches for part in slices(batch))

    return tied.select("cluster", "id", "several", "text").mapInArrow(run, "cluster long, id long, several boolean, h long")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose whole sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (n + m - common))
            out = batch.select(["a", "b"])
            yield out.filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(docs.join(needed, "id", "left_semi"), size)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """components(id, component) with those that links(a, b), a table in the shared folder, tie made one."""
    if not links.limit(1).count():
        return components
    of = lambda side: components.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    ties = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = linked(materialize(ties, "ties")).select(F.col("id").alias("component"), F.col("component").alias("to"))
    own = components.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    # ends that had no link so far
    new = moved.select(F.col("component").alias("id"), F.col("to").alias("component"))
    return materialize(own.unionByName(new).distinct(), "components")


def _placed(coarse: DataFrame, fine: DataFrame, reps: DataFrame, known: DataFrame, size: int, percent: int | None = None) -> DataFrame:
    """Members of the clusters of coarse that have several components of fine: (id, cluster, component, main, sketch,
    n_shingles, common, usual, classes). main: the cluster's largest component. common: shingles that others in the cluster have too,
    usual: those that half of its members have; classes: the common ones by class of hash. With percent, also prefix: the
    common ones among so many of a text's rarest shingles in the cluster that two linked texts have one there in both."""
    member = coarse.withColumnRenamed("component", "cluster").join(fine, "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = materialize(member, "members")
    main = member.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n"), F.sum("count").alias("texts")).where("n > 1").drop("n")
    member = member.join(main, "cluster")
    # an id that has several texts is in no bound
    several = reps.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1")
    tied = member.select("id", "cluster").join(known, "id").join(several, "id", "left").withColumn("several", F.col("texts").isNotNull()).drop("texts")
    seen = _members(tied, size).withColumn("n", F.count("*").over(Window.partitionBy("cluster", "h"))).join(main.select("cluster", "texts"), "cluster")
    sums = [F.count_if(F.col("n") == 1).alias("own"), F.count_if((F.col("n") > 1) & (2 * F.col("n") >= F.col("texts"))).alias("usual"), F.array(*[F.count_if((F.col("n") > 1) & (F.col("h").bitwiseAND(CLASSES - 1) == k)).cast("int") for k in range(CLASSES)]).alias("classes")]
    if percent is not None:
        # those of one text alone are the rarest; rows that repeat a text only make a prefix longer
        least = F.count("*") - F.ceil(F.count("*") * percent / 100) + 1 - F.count_if(F.col("n") == 1)
        ranked = F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.struct("n", "h"))))
        sums.append(F.transform(F.when(F.max("several"), ranked).otherwise(F.slice(ranked, 1, F.greatest(least, F.lit(0)).cast("int"))), lambda x: x["h"]).alias("prefix"))
    seen = seen.groupBy("cluster", "id").agg(*sums)
    member = member.drop("texts").join(reps.select("id", "sketch", "n_shingles"), "id").join(seen, ["cluster", "id"], "left")
    one = lambda c: F.when(F.col("texts").isNull(), F.coalesce(c, F.lit(0))).otherwise(0)
    return materialize(member.join(several, "id", "left").withColumns({"common": F.col("n_shingles") - one("own"), "usual": one("usual"), "classes": F.when(F.col("texts").isNull(), F.col("classes"))}).drop("own", "texts"), "common")


def _meeting(member: DataFrame) -> DataFrame:
    """member of _placed() with a null prefix where fewer pairs meet if all odd ones of the cluster meet all of its members
    than if they meet at the shingles of their prefixes. Both are exact; a cluster that chance has chained needs the latter."""
    rows = member.withColumn("odd", (F.col("component") != F.col("main")).cast("long"))
    at = rows.select("cluster", "odd", F.explode("prefix").alias("h")).groupBy("cluster", "h").agg((F.count("*") * F.sum("odd")).alias("pairs")).groupBy("cluster").agg(F.sum("pairs").alias("pairs"))
    whole = rows.groupBy("cluster").agg((F.count("*") * F.sum("odd")).alias("whole")).join(at, "cluster", "left")
    few = whole.where("whole <= coalesce(pairs, 0)").select("cluster", F.lit(True).alias("few"))
    return member.join(few, "cluster", "left").withColumn("prefix", F.when(F.col("few").isNull(), F.col("prefix"))).drop("few")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, kept).

    Texts are lower-cased in A-Z and cut into words `[^\\x20\\x09-\\x0D]+`; a text of fewer than `size` words
    is one shingle of all its words. Two documents are linked where 100 * |intersection| >= percent *
    |union|. component_id is the smallest id that links reach, kept says that it is the row's own.
    A null, empty or blank text has n_shingles 0 and is its own component. Ids are integers; rows that repeat an id
    are one document if their texts agree, and are linked through the id if not. A null id makes no link:
    its component_id is null and kept is false. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, size), "signed")
    full = signed.where("n_shingles > 0 and id is not null")
    reps = full.groupBy("n_shingles", "s1", "s2").agg(F.min("id").alias("id"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "sets")
    n = reps.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n * TABLES_A * TABLES_B / KEYS_PER_TASK))
    known = docs.where("id is not null")

    def edges(rows: DataFrame, tables: np.ndarray) -> DataFrame:
        """EDGES of the tables' buckets; rows: reps with the component, cluster and common of each."""
        rows = rows.withColumn("sizes", F.shiftleft("n_shingles", 32) + F.col("common"))
        routed = rows.select("id", "halves", "sketch", "component", "cluster", "sizes", "usual").mapInArrow(partial(_bucket_rows, tables=tables, percent=percent), ROUTED)
        return materialize(routed.repartition(parts, "route").mapInArrow(partial(_bucket_edges, percent=percent), EDGES), "found")

    # two pairs of each text from some tables first: with its first likely leader, and with the most alike
    first = edges(reps.withColumns({"component": F.col("id"), "cluster": F.col("id"), "common": F.col("n_shingles"), "usual": F.lit(0).cast("long")}), SOME)
    some = first.where((F.col("agree") >= AGREE) & (F.col("a") != F.col("b")))
    ends = some.select(F.col("a").alias("id"), F.col("b").alias("other"), "agree").unionByName(some.select(F.col("b").alias("id"), F.col("a").alias("other"), "agree"))
    lead = F.struct((F.col("agree") < LIKELY).alias("unlikely"), F.xxhash64("other").alias("order"), "other")
    best = ends.groupBy("id").agg(F.min(lead)["other"].alias("lead"), F.max(F.struct("agree", "other"))["other"].alias("alike"))
    best = best.select("id", F.explode(F.array("lead", "alike")).alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    fine = linked(materialize(_confirm(best, known, size, percent), "links"))
    # then all tables' pairs whose texts these links don't join
    in_cluster = _placed(linked(first.where("big")), fine, reps, known, size).groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("common").alias("common"), F.min("usual").alias("usual"))
    placed = reps.join(fine, "id", "left").join(in_cluster, "id", "left")
    placed = placed.select(*reps.columns, *(F.coalesce(c, other).alias(c) for c, other in (("component", "id"), ("cluster", "id"), ("common", "n_shingles"))), F.coalesce("usual", F.lit(0)).cast("long").alias("usual"))
    found = edges(placed, ALL)
    pairs = found.where((F.col("agree") >= AGREE) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    fine = _joined(fine, materialize(_confirm(pairs, known, size, percent), "links"))
    member = _meeting(_placed(linked(found.where("big")), fine, reps, known, size, percent))
    odd = member.where("component <> main")
    x = odd.select("cluster", F.explode(F.coalesce("prefix", F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))).alias("spot"), F.col("id").alias("xi"), F.col("component").alias("xc"), F.col("sketch").alias("xs"), F.col("main").alias("xm"), F.col("n_shingles").alias("xn"), F.col("common").alias("xo"), F.col("usual").alias("xu"), F.col("classes").alias("xk"))
    y = member.select("cluster", F.explode(F.coalesce("prefix", F.array(F.pmod(F.xxhash64("id"), F.lit(SALTS))))).alias("spot"), F.col("id").alias("yi"), F.col("component").alias("yc"), F.col("sketch").alias("ys"), F.col("n_shingles").alias("yn"), F.col("common").alias("yo"), F.col("usual").alias("yu"), F.col("classes").alias("yk"))
    most = F.least("xu", "yu") + F.least(F.col("xo") - F.col("xu"), F.col("yo") - F.col("yu"))
    enough = 100 * most >= percent * (F.col("xn") + F.col("yn") - most)
    # of each class they share no more than either has
    shared = F.aggregate(F.zip_with("xk", "yk", lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n)
    enough = enough & F.coalesce((100 + percent) * shared >= percent * (F.col("xn") + F.col("yn")), F.lit(True))
    once = (F.col("yc") == F.col("xm")) | (F.col("xi") < F.col("yi"))
    apart = F.col("xc") != F.col("yc")
    alike = F.bit_count(F.col("xs").bitwiseXOR(F.col("ys"))) <= BITS - AGREE
    rest = x.join(y, (x["cluster"] == y["cluster"]) & (x["spot"] == y["spot"]) & apart & once & alike & enough).select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct()
    more = materialize(_confirm(rest, known, size, percent), "more")
    fine = _joined(fine, more)
    sets = reps.select("n_shingles", "s1", "s2", F.col("id").alias("rep")).join(fine.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = signed.select("id", "n_shingles", "s1", "s2").join(sets, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: that with the smallest id; exact repeats of it go too.

    Rows without words, and rows with a null id, stay.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent)
    drop = found.where(F.col(id_col).isNotNull() & ~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    # the row travels as one value, so its names can't clash with others
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    left = packed.join(drop, packed["key"] == drop["gone"], "left_anti")
    order = Window.partitionBy("key", F.xxhash64("text")).orderBy("text")
    ranked = left.withColumn("turn", F.when(F.col("key").isNull() | F.col("text").isNull(), 1).otherwise(F.row_number().over(order)))
    return ranked.where("turn = 1").select("row.*")
