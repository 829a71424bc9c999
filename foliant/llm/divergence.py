"""How far the sources of a language lie apart in their terms: byte tries, merged by prefix range.

A task counts the terms of its documents in one radix trie for each language: an edge holds bytes, a leaf holds the
number of documents and, by source, of occurrences. A full trie is cut into pieces of equal first PREFIX bytes, which
Spark deals by ranges of (language, prefix); a task merges the tries of each prefix, walks the result in byte order, that
is in code point order, and keeps terms of enough documents. Kept terms travel in chunks of leaves with their
counters. Chunks yield the parts of all pairs' sums and each group's best candidates in the order of the walk, so that ties
come in their final order.

All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.scratch import materialize

#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
#: Ranks that part `term` reports.
TOP = 10
#: Terms of one task whose first bytes are equal are one row.
PREFIX = 3
#: A prefix that holds over 1/HOT of all leaves is cut by so many bytes.
HOT, LONG = 100, 5
#: Texts whose terms are told apart together.
SLICE_BYTES = 4 << 20
#: A task's tries are emitted when they have so many leaves or counters.
FULL_LEAVES, FULL_CELLS = 150_000, 1 << 21
#: Leaves of a chunk, and counters that are laid out as a table at once.
CHUNK, CELLS = 4096, 1 << 20
#: Groups of (language, source) up to which their totals are broadcast; beyond, chunks meet them in a salted shuffle.
BROADCAST_GROUPS = 100_000
SALTS = 16
SCALE = 1_000_000_000


class RadixTrie:
    """Terms as byte strings; each has a number, in the order in which they came."""

    def __init__(self) -> None:
        self.root: list = [b"", -1, {}]  # bytes of the edge to it, number of the term that ends here or -1, children by first byte
        self.size = 0

    def numbers(self, terms: list[bytes]) -> list[int]:
        """Each term's number; terms that aren't there are put in. terms ascend, so that one goes on from where it parts
        from the one before."""
        out = []
        path = [(b"", self.root)]  # nodes down to the term before, with the bytes that lead to each
        for term in terms:
            while not term.startswith(path[-1][0]):
                path.pop()
            before, node = path[-1]
            at, whole = len(before), len(term)
            while at < whole:
                kids = node[2]
                kid = kids.get(term[at])
                if kid is None:
                    kid = kids[term[at]] = [term[at:], -1, {}]
                    at = whole
                else:
                    edge = kid[0]
                    if term.startswith(edge, at):
                        at += len(edge)
                    else:
                        same = 1
                        while at + same < whole and edge[same] == term[at + same]:
                            same += 1
                        mid = kids[term[at]] = [edge[:same], -1, {edge[same]: kid}]
                        kid[0] = edge[same:]
                        kid, at = mid, at + same
                node = kid
                path.append((term[:at], node))
            if node[1] < 0:
                node[1] = self.size
                self.size += 1
            out.append(node[1])
        return out

    def walk(self) -> tuple[list[bytes], list[int]]:
        """All terms in byte order, and their numbers."""
        terms, numbers = [], []
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            term = before + node[0]
            if node[1] >= 0:
                terms.append(term)
                numbers.append(node[1])
            if kids := node[2]:
                stack += [(term, kids[b]) for b in sorted(kids, reverse=True)] if len(kids) > 1 else [(term, kid) for kid in kids.values()]
        return terms, numbers


def _terms(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """(distinct terms, index of each occurrence, text of each): runs of letters A-Z, in lower case, and bytes beyond ASCII."""
    data = np.frombuffer(b"\0".join([b"", *texts, b""]).lower(), np.uint8)  # bytes.lower() is that of ASCII
    inside = ((data - np.uint8(0x61)) < 26) | (data >= 0x80)
    edges = (np.flatnonzero(inside[1:] != inside[:-1]) + 1).astype(np.int64)
    if not len(edges):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # terms and what is between them lie behind one another; every other one is a term
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    coded = every.take(pa.array(np.arange(0, len(every), 2))).dictionary_encode()
    begins = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(begins, edges[::2], "right") - 1


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(key, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, back, count)
    return distinct, out


class Counter:
    """One trie for each language, and their leaves' counters as arrays."""

    def __init__(self) -> None:
        self.tries: dict[str, RadixTrie] = {}
        self.sources: dict[str, int] = {}
        self.docs: dict[str, list[np.ndarray]] = {}
        self.cells: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.pending = 0

    def full(self) -> bool:
        return self.pending > FULL_CELLS or sum(t.size for t in self.tries.values()) > FULL_LEAVES

    def add(self, lang: str, texts: list[bytes], sources: list[str]) -> None:
        terms, index, text = _terms(texts)
        trie = self.tries.setdefault(lang, RadixTrie())
        order = pc.array_sort_indices(terms)
        number = np.empty(len(terms), np.int64)
        number[order.to_numpy()] = trie.numbers(terms.take(order).to_pylist())
        own = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        self.docs.setdefault(lang, []).append(number[np.unique(index * len(texts) + text) // len(texts)])
        key, count = np.unique(number[index] << 32 | own[text], return_counts=True)
        self.cells.setdefault(lang, []).append((key, count))
        self.pending += len(key) + len(self.docs[lang][-1])

    def pieces(self) -> Iterator[dict[str, object]]:
        """The tries in pieces by language and prefix, each in byte order."""
        names = pa.array(list(self.sources), pa.string())
        for lang, trie in self.tries.items():
            terms, order = trie.walk()
            if not terms:
                continue
            place = np.empty(trie.size, np.int64)
            place[order] = np.arange(trie.size)
            docs = np.bincount(place[np.concatenate(self.docs[lang])], minlength=trie.size)
            key = np.concatenate([k for k, _ in self.cells[lang]])
            key, count = _summed(place[key >> 32] << 32 | key & 0xFFFFFFFF, np.concatenate([c for _, c in self.cells[lang]]))
            sizes = np.bincount(key >> 32, minlength=trie.size)
            leaves = {"terms": pa.array(terms, pa.binary()), "docs": pa.array(docs), "sizes": pa.array(sizes), "sources": names.take(pa.array(key & 0xFFFFFFFF)), "counts": pa.array(count)}
            yield from _cut(lang, leaves, PREFIX)


def _cut(lang: str, leaves: dict[str, pa.Array], size: int) -> Iterator[dict[str, object]]:
    """Pieces of ascending leaves whose terms' first `size` bytes are equal."""
    prefix = pc.binary_slice(leaves["terms"], 0, size)
    runs = pc.run_end_encode(prefix)
    ends = runs.run_ends.to_pylist()
    cells = np.concatenate([[0], np.cumsum(leaves["sizes"].to_numpy())]).tolist()
    low = 0
    for value, high in zip(runs.values.to_pylist(), ends, strict=True):
        own, its = slice(low, high), slice(cells[low], cells[high])
        yield {"lang": lang, "prefix": value, "terms": leaves["terms"][own], "docs": leaves["docs"][own], "sizes": leaves["sizes"][own], "sources": leaves["sources"][its], "counts": leaves["counts"][its]}
        low = high


_LEAVES = pa.schema([("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PIECE = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), *_LEAVES])
_ARRAYS = "terms array<binary>, docs array<long>, sizes array<long>, sources array<string>, counts array<long>"


def _batches(rows: Iterator[dict[str, object]], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` counters; array columns come as arrays."""
    held: list[dict[str, object]] = []
    total = 0

    def column(field: pa.Field) -> pa.Array:
        values = [r[field.name] for r in held]
        if field.name not in _LEAVES.names:
            return pa.array(values, field.type)
        offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([v.cast(field.type.value_type) for v in values]))

    for row in rows:
        held.append(row)
        total += len(row["counts"])
        if total >= most:
            yield pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Pieces of the tries of each task: (lang, prefix, terms, docs, sizes, sources, counts). terms ascend; sizes are how
    many of sources and counts belong to each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict[str, object]]:
            counter = Counter()
            held: dict[str, tuple[list[bytes], list[str]]] = {}
            total = 0

            def flush() -> None:
                for lang, (texts, sources) in held.items():
                    counter.add(lang, texts, sources)
                held.clear()

            for batch in batches:
                texts = batch.column("text").cast(pa.binary())
                for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                    mine = held.setdefault(lang, ([], []))
                    mine[0].append(raw := text.as_py())
                    mine[1].append(source)
                    total += len(raw)
                    if total >= SLICE_BYTES:
                        flush()
                        total = 0
                        if counter.full():
                            yield from counter.pieces()
                            counter = Counter()
            flush()
            yield from counter.pieces()

        return _batches(rows(), _PIECE)

    chosen = docs.select(_filled(text_col).alias("text"), _filled(lang_col).alias("lang"), _filled(source_col).alias("source"))
    return chosen.mapInArrow(run, f"lang string, prefix binary, {_ARRAYS}")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, dict[str, object]]]:
    for batch in batches:
        columns = {n: batch.column(n) for n in _LEAVES.names}
        for i, (lang, prefix) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("prefix").to_pylist(), strict=True)):
            yield lang, prefix, {n: c[i].values for n, c in columns.items()}


def _spread(pieces: DataFrame) -> DataFrame:
    """Pieces with those of prefixes that hold over 1/HOT of all leaves cut again, by LONG bytes: no range of prefixes is
    then much larger than others. There are at most HOT such prefixes, so they are broadcast."""
    whole = pieces.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    hot = pieces.groupBy("lang", "prefix").agg(F.sum(F.size("terms")).alias("n")).where(F.col("n") * HOT > whole).select("lang", "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for lang, _, piece in _pieces(batches) for row in _cut(lang, piece, LONG)), _PIECE)

    hot = F.broadcast(materialize(hot, "hot"))
    again = pieces.join(hot, ["lang", "prefix"], "left_semi").mapInArrow(run, pieces.schema)
    return pieces.join(hot, ["lang", "prefix"], "left_anti").unionByName(again)


def merged(pieces: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Tries of equal language and prefix merged, terms in fewer than `least` documents left out: chunks (lang, terms, docs, sizes,
    sources, counts) of up to about CHUNK terms, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leaves(parts: list[dict[str, pa.Array]]) -> dict[str, pa.Array]:
            trie = RadixTrie()
            number = np.concatenate([trie.numbers(p["terms"].to_pylist()) for p in parts])
            terms, order = trie.walk()
            place = np.empty(trie.size, np.int64)
            place[order] = np.arange(trie.size)
            at = place[number]
            docs = np.zeros(trie.size, np.int64)
            np.add.at(docs, at, np.concatenate([p["docs"].to_numpy() for p in parts]))
            keep = docs >= least
            coded = pa.concat_arrays([p["sources"] for p in parts]).dictionary_encode()
            leaf = np.repeat(at, np.concatenate([p["sizes"].to_numpy() for p in parts]))
            own = keep[leaf]
            key, count = _summed(leaf[own] << 32 | coded.indices.to_numpy()[own], np.concatenate([p["counts"].to_numpy() for p in parts])[own])
            sizes = np.bincount(key >> 32, minlength=trie.size)[keep]
            return {"terms": pa.array(terms, pa.binary()).filter(pa.array(keep)), "docs": pa.array(docs[keep]), "sizes": pa.array(sizes), "sources": coded.dictionary.take(pa.array(key & 0xFFFFFFFF)), "counts": pa.array(count)}

        def chunk(lang: str, found: list[dict[str, pa.Array]]) -> dict[str, object]:
            return {"lang": lang} | {k: pa.concat_arrays([f[k] for f in found]) for k in _LEAVES.names}

        def rows() -> Iterator[dict[str, object]]:
            now, parts = None, []
            found: list[dict[str, object]] = []

            def close() -> None:
                """Merge what has come of a prefix."""
                if parts and len((got := leaves(parts))["terms"]):
                    found.append(got)

            for lang, prefix, piece in _pieces(batches):
                if now != (lang, prefix):
                    close()
                    if found and (now[0] != lang or sum(len(f["terms"]) for f in found) >= CHUNK):
                        yield chunk(now[0], found)
                        found = []
                    now, parts = (lang, prefix), []
                parts.append(piece)
            close()
            if found:
                yield chunk(now[0], found)

        return _batches(rows(), pa.schema([("lang", pa.string()), *_LEAVES]), 1)

    dealt = _spread(pieces).repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(run, f"lang string, {_ARRAYS}")


def _shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division in three steps, so that nothing overflows."""
    rest, out, whole = count + 2, np.zeros(np.broadcast(count, total).shape, np.int64), np.asarray(total) + 2 * terms
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, lang, source, item, value) of chunks that have met their language's totals."""
    names = ["part", "lang", "source", "item", "value"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            lang, v = row["lang"].as_py(), row["v"].as_py()
            groups = row["groups"].values
            sources, totals = groups.field("source").to_pylist(), groups.field("total").to_numpy(zero_copy_only=False)
            place = {s: k for k, s in enumerate(sources)}
            terms, sizes = row["terms"].as_py(), row["sizes"].values.to_numpy()
            coded = row["sources"].values.dictionary_encode()
            column = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            counts, first = row["counts"].values.to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            step = max(1, CELLS // len(sources))
            best: list[list[tuple[int, int]]] = [[] for _ in sources]
            sums = np.zeros((len(sources), len(sources)), np.int64) if len(sources) ** 2 <= 4 * CELLS else None
            for lo in range(0, len(terms), step):
                hi = min(lo + step, len(terms))
                table = np.zeros((hi - lo, len(sources)), np.int64)
                cells = slice(first[lo], first[hi])
                table[np.repeat(np.arange(hi - lo), sizes[lo:hi]), column[cells]] = counts[cells]
                p = _shares(table, totals, v)
                q = _shares(table.sum(1), int(totals.sum()), v)[:, None]
                value = np.where((table > 0) & (p > q), _apart(p, q), -1)
                for s in range(len(sources)):
                    have = np.flatnonzero(value[:, s] >= 0)
                    top = have[np.argsort(-value[have, s], kind="stable")[:TOP]]
                    best[s] = sorted(best[s] + [(-int(value[t, s]), lo + int(t)) for t in top])[:TOP]
                    near = _apart(p[:, s : s + 1], p[:, s + 1 :]).sum(0)
                    if sums is not None:
                        sums[s, s + 1 :] += near
                    elif len(near):
                        k = len(near)
                        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * k), pa.array([lang] * k), pa.array([sources[s]] * k), pa.array([x.encode() for x in sources[s + 1 :]]), pa.array(near)], names)
            rows = [("term", lang, sources[s], terms[t], -value) for s, found in enumerate(best) for value, t in found]
            if sums is not None:
                rows += [("pair", lang, sources[s], sources[t].encode(), int(sums[s, t])) for s in range(len(sources)) for t in range(s + 1, len(sources))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs in docs.

    A term is a run of letters A-Z, in lower case, and characters beyond ASCII; a language keeps those in at least `least` of its
    documents. A kept term's share in a group, or in its whole language, is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N
    the group's occurrences of all V kept terms; two shares are f = floor((p - q)^2 / (p + q)) apart.
    Part `pair`: item is each other source of the language, value the sum of f over all kept terms (0 without any). Part
    `term`: the TOP kept terms that the group has, and has a larger share of than its language, by f. Ranks go by value descending,
    then item in UTF-8 order.

    Null texts, languages and sources are ''; each row is a document, repeats too; a group without terms has shares like others;
    other columns are ignored; an empty table gives none. The result has a row for each ordered pair of sources of a language, and one
    row holds the names and totals of a language's sources.
    """
    groups = docs.select(_filled(lang_col).alias("lang"), _filled(source_col).alias("source")).distinct()
    kept = materialize(merged(materialize(tries(docs, text_col, lang_col, source_col), "tries"), least), "terms")
    counts = kept.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("total"))
    kept_terms = kept.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    known = materialize(groups.join(counts, ["lang", "source"], "left").na.fill(0, ["total"]), "groups")
    langs = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")).join(kept_terms, "lang")
    if known.count() <= BROADCAST_GROUPS:
        chunks = kept.join(F.broadcast(langs), "lang")
    else:
        spread = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        chunks = kept.withColumn("salt", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(SALTS)).cast("int")).join(spread, ["lang", "salt"])
    chosen = chunks.select("lang", "terms", "sizes", "sources", "counts", "groups", "v")
    scored = materialize(chosen.mapInArrow(_scored, "part string, lang string, source string, item binary, value long").withColumn("item", F.col("item").cast("string")), "scores")

    half = scored.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    bare = known.join(kept_terms, "lang", "left_anti")
    zero = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = half.unionByName(other).unionByName(zero).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
