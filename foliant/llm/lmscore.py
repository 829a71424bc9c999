"""Document scores by cross-entropy difference of two models of word pairs.

A target model (texts that are labelled good) and a background model (all texts) give each pair of neighbouring
words (the first of a text follows a start mark) the probability

    (1 - SPELLED) * count of the pair / count of all pairs + SPELLED * spelling of both words,

where the spelling of a word is its probability under a trigram model of byte classes. So every pair
has a probability above 0 and those of a model add up to 1 at most. Both models are over the same pairs of lower-cased (A-Z) words,
with the same smoothing. A document's own occurrences are taken out of the counts it is scored with, in
the background and, where it is a target text, in the target, so that labelled and other texts compare. The score is the mean over its pairs
of the target's loss less the background's, in bits: the lower, the more like the target.

Counts cover every pair of every text. They are never one table: texts are worked on in groups; a group deals its
(pair, document, count) entries to tasks by a hash of the pair, as packed arrays; a task counts its pairs and
sends each group its losses back, which are summed by document. Pairs that many documents have, at most
some multiple of a document's number of pairs, are counted within each group first, and their totals are
handed to all tasks. What is gathered grows with the corpus; each task's part doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtext import Words, mix, slices, words
from foliant.plans.scratch import materialize

#: Up to so many ids (8 bytes each) of target texts are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Weight of the spelling.
SPELLED = 0.4
#: A pair that more than this share of documents has is counted within groups first; for the search one
#: document of SEARCHED is looked at. This decides where counting is done, not what is counted.
COMMON, SEARCHED = 1 / 64, 8
#: Bytes of text of a group, and its documents at most; entries that a task gets, about.
GROUP_BYTES, GROUP_DOCS = 4 << 20, 1 << 16
ENTRIES_PER_TASK = 2_000_000

# Byte classes. 0 ends a word; letters have one each, digits one, other ASCII one, four of the high bytes one.
_CLASS = np.full(256, 60, np.int32)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[0x80:] = 28 + (np.arange(128) >> 2)
_SIZE = np.log2(np.maximum(np.bincount(_CLASS, minlength=64), 1))
_SIZE[0] = 0
_CODES = 1 << 18
_ENTRY = np.dtype([("pair", "<u8"), ("doc", "<u2"), ("n", "<u2"), ("t", "<f2"), ("b", "<f2")])
_LOSS = np.dtype([("doc", "<u2"), ("t", "<f4"), ("b", "<f4")])
_TOTAL = np.dtype([("pair", "<u8"), ("t", "<i8"), ("b", "<i8")])
_DOC = np.dtype([("n", "<i8"), ("good", "?")])
ROWS = "route long, grp long, kind int, data binary"
ENTRIES, TOTALS, DOCS, LOSSES = range(4)


@dataclass
class Spelling:
    """What both models need of the corpus besides pairs: losses by trigram of classes, pairs, common pairs."""

    losses: np.ndarray
    pairs: np.ndarray
    common: np.ndarray
    totals: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))


def _codes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(trigram code at each byte, whether the byte belongs to a word or ends one)."""
    c = _CLASS[w.data]
    c1, c2 = np.zeros_like(c), np.zeros_like(c)
    c2[1:] = c[:-1]
    c1[2:] = np.where(c[1:-1] == 0, 0, c[:-2])
    return (c1 << 12) | (c2 << 6) | c, (c > 0) | (c2 > 0)


def _pairs(w: Words) -> np.ndarray:
    """Hash of each word with the one before it; a text's first follows 0."""
    h = w.hashes()
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    before[w.first[:-1][w.counts > 0]] = 0
    return mix(before * np.uint64(0x9FB21C651E98DF25) + h)


def spelling(marked: DataFrame) -> Spelling:
    """Of all texts of marked(good, text). The driver gets a row for each trigram of classes, at most 2 ** 18, and for each
    common pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, _CODES + 1), np.int64)
        seen: dict[int, int] = {}
        docs = searched = 0
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                codes, use = _codes(w)
                found[1, :-1] += np.bincount(codes[use], minlength=_CODES)
                found[1, -1] += len(w.starts)
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
                for i in np.flatnonzero(good):
                    f, e = w.first[i], w.first[i + 1]
                    if e > f:
                        own = slice(w.starts[f], w.ends[e - 1] + 1)
                        found[0, :-1] += np.bincount(codes[own][use[own]], minlength=_CODES)
                        found[0, -1] += e - f
                some = np.flatnonzero((docs + np.arange(part.num_rows)) % SEARCHED == 0)
                docs += part.num_rows
                pairs = _pairs(w) if len(some) else None
                for i in some:
                    searched += 1
                    for p in np.unique(pairs[w.first[i] : w.first[i + 1]]).tolist():
                        seen[p] = seen.get(p, 0) + 1
                if len(seen) > 1 << 18:  # as in Misra and Gries: what is rare so far can't be common in all
                    seen = {p: k for p, k in seen.items() if k > COMMON * searched / 2}
        used = np.flatnonzero(found[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(used), np.int32)), pa.array(used), pa.array(found[0, used]), pa.array(found[1, used])], ["kind", "key", "t", "b"])
        common = np.array([p for p, k in seen.items() if k > max(1, COMMON * searched)], np.uint64).view(np.int64)
        one = np.ones(len(common), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(common), pa.array(one), pa.array(one)], ["kind", "key", "t", "b"])

    rows = marked.select("good", "text").mapInArrow(count, "kind int, key long, t long, b long").groupBy("kind", "key").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect()
    counts = np.zeros((2, _CODES + 1))
    for r in rows:
        if r.kind == 0:
            counts[:, r.key] = r.t, r.b
    grams = counts[:, :-1].reshape(2, -1, 64)
    p = (grams + 0.5) / (grams.sum(2, keepdims=True) + 32)
    losses = (_SIZE - np.log2(p)).reshape(2, -1)
    return Spelling(losses, counts[:, -1], np.sort(np.array([r.key for r in rows if r.kind == 1], np.int64).view(np.uint64)))


def _entries(w: Words, spelled: Spelling) -> np.ndarray:
    """An _ENTRY for each distinct pair of each text, in the order of texts; those that come very often have several."""
    codes, use = _codes(w)
    cost = np.where(use, spelled.losses[:, codes], 0)
    cost = np.concatenate([np.zeros((2, 1)), np.cumsum(cost, axis=1)], axis=1)
    cost = cost[:, w.ends + 1] - cost[:, w.starts]
    before = np.zeros_like(cost)
    before[:, 1:] = cost[:, :-1]
    before[:, w.first[:-1][w.counts > 0]] = 0
    cost = np.minimum(cost + before, 60000)
    pair, doc = _pairs(w), w.doc
    order = np.empty(len(pair), np.int64)
    for f, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        order[f:e] = pair[f:e].argsort() + f
    pair, doc = pair[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(pair)))
    out = np.zeros(len(at), _ENTRY)
    out["pair"], out["doc"], out["n"] = pair[at], doc[at], np.minimum(n, 65535)
    out["t"], out["b"] = cost[:, order[at]]
    big = np.flatnonzero(n > 65535)
    again = np.repeat(big, -(-n[big] // 65535) - 1)
    more = out[again]
    for i in np.flatnonzero(np.concatenate([again[1:] != again[:-1], [True]])) if len(again) else []:
        more["n"][i] = n[again[i]] % 65535 or 65535
    return np.concatenate([out, more])


def _packed(e: np.ndarray) -> bytes:
    """Entries of one route as columns; of a pair 48 bits, the route stands for the highest ones."""
    pair = np.ascontiguousarray(e["pair"]).view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([pair.tobytes(), *(e[c].tobytes() for c in ("doc", "n", "t", "b"))])


def _unpacked(data: bytes, skip: int, route: int) -> np.ndarray:
    size = (len(data) - skip) // 14
    out = np.zeros(size, _ENTRY)
    pair = np.zeros((size, 8), np.uint8)
    pair[:, :6] = np.frombuffer(data, np.uint8, 6 * size, skip).reshape(-1, 6)
    out["pair"] = pair.view("<u8").ravel() | np.uint64((route & 0xFFFF) << 48)
    for k, c in enumerate(("doc", "n", "t", "b")):
        out[c] = np.frombuffer(data, _ENTRY[c], size, skip + (6 + 2 * k) * size)
    return out


def _total(sums: np.ndarray, entries: np.ndarray, group: np.ndarray, good: np.ndarray) -> None:
    """Add entries' counts to the rows `group` of sums (target, background)."""
    sums[:, 1] += np.bincount(group, weights=entries["n"], minlength=len(sums))
    sums[:, 0] += np.bincount(group, weights=entries["n"] * good, minlength=len(sums))


def _losses(entries: np.ndarray, own: np.ndarray, good: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Bits of each entry by model, all its occurrences; own: the document's occurrences of its pair."""
    out = np.empty((2, len(entries)))
    for m, (name, less) in enumerate((("t", own * good), ("b", own))):
        share = (counts[:, m] - less) / max(pairs[m], 1)
        out[m] = -entries["n"].astype(float) * np.log2((1 - SPELLED) * share + SPELLED * np.exp2(-entries[name].astype(np.float64)))
    return out


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    route, group, kind, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(group, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["route", "grp", "kind", "data"])


def _dealt(marked: DataFrame, spelled: Spelling, routes: int) -> DataFrame:
    """ROWS: the entries of all groups by route, common pairs' totals by group, and the groups' documents."""
    bits = np.uint64(32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for big in slices(batch, limit=GROUP_BYTES):
                for begin in range(0, big.num_rows, GROUP_DOCS):
                    part, parts, begin_doc = big.slice(begin, GROUP_DOCS), [], 0
                    sizes = []
                    for small in slices(part):
                        w = words(small.column("text"), lower=True)
                        e = _entries(w, spelled)
                        e["doc"] += begin_doc
                        begin_doc += small.num_rows
                        parts.append(e)
                        sizes.append(w.counts)
                    e = np.concatenate(parts)
                    docs = np.zeros(part.num_rows, _DOC)
                    docs["n"], docs["good"] = np.concatenate(sizes), part.column("good").to_numpy(zero_copy_only=False)
                    ids = pa.table({"row": part.column("row")}).to_batches()[0]
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, ids.schema) as out:
                        out.write_batch(ids)
                    spot = np.searchsorted(spelled.common, e["pair"])
                    shared = spelled.common[np.minimum(spot, len(spelled.common) - 1)] == e["pair"] if len(spelled.common) else np.zeros(len(e), bool)
                    own, e = e[shared], e[~shared]
                    totals = np.zeros((len(spelled.common), 2))
                    _total(totals, own, spot[shared], docs["good"][own["doc"]])
                    used = np.flatnonzero(totals[:, 1])
                    t = np.zeros(len(used), _TOTAL)
                    t["pair"], t["t"], t["b"] = spelled.common[used], totals[used, 0], totals[used, 1]
                    head = np.array([len(docs), len(own)], np.int64).tobytes()
                    rows = [(-1 - group, group, DOCS, head + docs.tobytes() + own.tobytes() + sink.getvalue().to_pybytes()), (-1 - group, group, TOTALS, t.tobytes())]
                    to = (((e["pair"] >> bits) * np.uint64(routes)) >> bits).astype(np.int64)
                    order = to.argsort(kind="stable")
                    to, e = to[order], e[order]
                    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
                    good = np.packbits(docs["good"]).tobytes()
                    head = np.array([len(docs)], np.int64).tobytes() + good
                    for f, x in zip(cut, np.append(cut[1:], len(to)), strict=False):
                        rows.append((int(to[f]), group, ENTRIES, head + _packed(e[f:x])))
                    group += 1
                    yield _sent(rows)

    return marked.mapInArrow(deal, ROWS)


def _scored(spelled: Spelling):  # noqa: ANN202
    pairs = spelled.pairs

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one partition of routes: losses of each group's documents; other rows go on as they are."""
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            own = np.flatnonzero(batch.column("kind").to_numpy() == ENTRIES)
            yield batch.filter(pa.array(batch.column("kind").to_numpy() != ENTRIES))
            for i in own.tolist():
                group, data = batch.column("grp")[i].as_py(), batch.column("data")[i].as_py()
                n = int(np.frombuffer(data, np.int64, 1)[0])
                skip = 8 + (n + 7) // 8
                e = _unpacked(data, skip, batch.column("route")[i].as_py())
                held.append((group, e, np.unpackbits(np.frombuffer(data, np.uint8, skip - 8, 8))[:n][e["doc"]].astype(bool)))
        if not held:
            return
        e, good = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
        order = e["pair"].argsort()
        pair = e["pair"][order]
        group = np.empty(len(e), np.int64)
        group[order] = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))
        counts = np.zeros((int(group.max()) + 1, 2))
        _total(counts, e, group, good)
        begin = 0
        for grp, own, mine in held:
            g = group[begin : begin + len(own)]
            begin += len(own)
            # entries of one document and pair follow each other, but for those that come very often
            several = own["n"].astype(np.int64)
            if (several == 65535).any():
                key = g * (GROUP_DOCS + 1) + own["doc"]
                _, back = np.unique(key, return_inverse=True)
                several = np.bincount(back, weights=several)[back]
            loss = _losses(own, several, mine, counts[g], pairs)
            docs, back = np.unique(own["doc"], return_inverse=True)
            out = np.zeros(len(docs), _LOSS)
            out["doc"], out["t"], out["b"] = docs, np.bincount(back, weights=loss[0]), np.bincount(back, weights=loss[1])
            yield _sent([(0, grp, LOSSES, out.tobytes())])

    return score


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_words, target_loss, background_loss, score).

    The background model is of all texts of docs, the target model of those whose id is in target, each text without its own
    words when it is scored. Losses are bits per pair of words, score is target less background. A null or empty text, or one without
    words, has n_words 0 and null in the rest. Whole texts count. Repeated rows are separate texts and give repeated rows;
    other columns are ignored; an empty table gives none. Null texts and ids that docs doesn't have add
    nothing to the target, repeated ids of it count once; with an empty target every text gets its losses all the same.
    """
    spark = docs.sparkSession
    good = target.select(F.col(id_col).alias("_good")).where("_good is not null").distinct()
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    marked = rows.join(good, F.col("row") == F.col("_good"), "left").select("row", F.coalesce(F.col("_good").isNotNull() & F.col("text").isNotNull(), F.lit(False)).alias("good"), F.coalesce("text", F.lit("")).alias("text"))
    spelled = spelling(marked)
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(spelled.pairs[1] / ENTRIES_PER_TASK))
    sent = _dealt(marked, spelled, routes * 4).repartition(routes, "route").mapInArrow(_scored(spelled), ROWS)
    sent = materialize(sent, "losses")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.frombuffer(b"".join(batch.column("data").to_pylist()), _TOTAL)
            yield pa.RecordBatch.from_arrays([pa.array(t["pair"].view(np.int64)), pa.array(t["t"]), pa.array(t["b"])], ["pair", "t", "b"])

    # at most one row for each common pair
    found = {r.pair: (r.t, r.b) for r in sent.where(F.col("kind") == TOTALS).select("data").mapInArrow(unpack, "pair long, t long, b long").groupBy("pair").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect()}
    totals = np.array([found.get(p, (0, 0)) for p in spelled.common.view(np.int64).tolist()], float).reshape(-1, 2)
    common, pairs = spelled.common, spelled.pairs
    kind = dict(docs.dtypes)[id_col]

    def finish(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        """Of all rows (kind, data) of a group."""
        data = next(x for k, x in rows if k == DOCS)
        n, m = np.frombuffer(data, np.int64, 2)
        at = 16 + n * _DOC.itemsize
        table, own = np.frombuffer(data, _DOC, n, 16), np.frombuffer(data, _ENTRY, m, at)
        ids = pa.ipc.open_stream(data[at + m * _ENTRY.itemsize :]).read_next_batch().column("row")
        sums = np.zeros((2, n))
        for k, x in rows:
            if k == LOSSES:
                loss = np.frombuffer(x, _LOSS)
                sums[0, loss["doc"]] += loss["t"]
                sums[1, loss["doc"]] += loss["b"]
        if m:
            spot = np.searchsorted(common, own["pair"])
            _, back = np.unique(spot * (GROUP_DOCS + 1) + own["doc"], return_inverse=True)
            several = np.bincount(back, weights=own["n"])[back]
            loss = _losses(own, several, table["good"][own["doc"]], totals[spot], pairs)
            for model in range(2):
                sums[model] += np.bincount(own["doc"], weights=loss[model], minlength=n)
        none = table["n"] == 0
        mean = sums / np.maximum(table["n"], 1)
        columns = [ids, pa.array(table["n"]), *(pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1]))]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "target_loss", "background_loss", "score"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for group, k, data in zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "data")), strict=True):
                if held and group != last:
                    yield finish(held)
                    held = []
                held.append((k, data))
                last = group
        if held:
            yield finish(held)

    mine = sent.where(F.col("kind") != TOTALS).select("grp", "kind", "data")
    return mine.repartition(routes, "grp").sortWithinPartitions("grp").mapInArrow(gather, f"`{id_col}` {kind}, n_words long, target_loss double, background_loss double, score double")
