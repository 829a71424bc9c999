"""Alignment of two tokenizers' tokens over the bytes of the same texts, and how often their ids meet.

A byte-level BPE (A) reads a space and the text, a piece BPE (B) the text, before which it puts a space itself. A
cumulated sum of the tokens' lengths gives the bytes at which they end; where tokens of both end is a common cut
(intersect1d), and the cuts part both lists into groups (searchsorted). A token of A meets the tokens of B from the one
that its first byte lies in to the one that its last byte lies in; these ranges are unfolded to links by repeating indices.
All texts of a slice are worked on at once: their bytes lie behind one another, so each text's end is a cut as well.

Links are counted by text and pair of ids before they leave the task. What the corpus has of each pair is summed in two
shuffles, first by pair and salt, then by pair, and the sums go back to the texts by a join: a broadcast up to
BROADCAST_PAIRS pairs, a salted shuffle beyond.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.arrowtext import grouped, slices
from foliant.llm.piece import Encoder, _joined, load
from foliant.plans.scratch import materialize

#: Texts that are aligned together.
SLICE_BYTES = 1 << 20
#: Distinct words whose ids a task keeps.
KEPT_WORDS = 1 << 18
#: A pair's counts are a few tens of bytes in a broadcast table.
BROADCAST_PAIRS = 2_000_000
SALTS = 16


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others for
    the code points from 256 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_bytes(path: str) -> ByteModel:
    return ByteModel(path)


class ByteModel:
    """A byte-level BPE vocabulary: the library's encoder and the bytes of each id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        letters = _byte_letters()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        self.bytes_of = pa.array([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens], pa.large_binary())
        self.sizes = pc.binary_length(self.bytes_of).to_numpy().astype(np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class ByteEncoder:
    """Ids of texts by a byte-level BPE, each distinct word encoded once as long as the task keeps it.

    A word begins at a single space between two characters of which neither is white space: no token of these
    vocabularies holds a space behind another character, so no merge crosses such a place.
    """

    def __init__(self, model: ByteModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where those of each row begin and at last end). A row begins with its space or is empty."""
        if len(self.words) > KEPT_WORDS:
            self._clear()
        data = np.frombuffer(b"".join(rows), np.uint8)
        begins = np.cumsum([0, *map(len, rows)])
        start = np.zeros(len(data), bool)
        if len(data) > 2:
            ascii_ = (data > 0x20) & (data < 0x7F)
            # the second byte of a character from U+00C0 to U+07FF, of which none is white space
            two = np.zeros(len(data), bool)
            two[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
            lead = ascii_ | (data >= 0xC3) & ~((data >= 0xE1) & (data <= 0xE3))
            start[1:-1] = (data[1:-1] == 0x20) & (ascii_[:-2] | two[:-2]) & lead[2:]
        start[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(start)
        offsets = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            place[new] = len(self.words) + np.arange(new.sum())
            fresh = coded.dictionary.filter(pa.array(new))
            listed = [x.ids for x in self.model.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in fresh.to_pylist()], add_special_tokens=False)]
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids = np.concatenate([self.ids, *(np.array(x, np.int32) for x in listed)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in listed])])
        word = place[coded.indices.to_numpy()]
        count = self.first[word + 1] - self.first[word]
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids[_ranges(self.first[word], count)], ends[np.searchsorted(starts, begins)]


def _distinct(doc: np.ndarray, pair: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's pairs begin and at last end, distinct pairs of each text, how often it has them)."""
    key, times = np.unique(doc * width + pair, return_counts=True)
    return np.searchsorted(key, np.arange(n + 1) * width), key % width, times.astype(np.int32)


class Aligner:
    """Groups and links of slices of texts."""

    def __init__(self, a: str, b: str):
        self.a, self.b = load_bytes(a), load(b)
        self.of_a, self.of_b = ByteEncoder(self.a), Encoder(self.b)
        self.b_sizes = np.array([len(x) for x in self.b.raw], np.int64)
        ids_a, ids_b = ([str(i) for i in range(n)] for n in (self.a.size, self.b.size))
        #: Ids as text with what follows them: for A "," or, at a group's end, "|"; for B "," or ";".
        self.text_of = pa.array([f"{i}{end}".encode() for ids, ends in ((ids_a, ",|"), (ids_b, ",;")) for end in ends for i in ids], pa.large_binary())

    def align(self, texts: list[bytes | None]) -> dict[str, np.ndarray | list[bytes]]:
        """n_a, n_b, n_groups, n_links and groups of each text; first, pairs and times: its distinct pairs a * B + b."""
        n = len(texts)
        rows = [b" " + x if x else b"" for x in texts]
        a, first_a = self.of_a.encode(rows)
        counts_b, listed, decoded = self.of_b.encode(texts)
        b = np.fromstring(b"".join(listed)[:-1], np.int32, sep=",") if any(listed) else np.zeros(0, np.int32)
        joined_a = _joined(self.a.bytes_of, a, first_a[1:]).to_pylist()
        good = np.array([x == y == z for x, y, z in zip(rows, joined_a, decoded, strict=True)], bool)
        count_a = np.diff(first_a)
        if not good.all():
            a, b = a[np.repeat(good, count_a)], b[np.repeat(good, counts_b)]
            count_a, counts_b = count_a * good, counts_b * good
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b_sizes[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        text_ends = np.cumsum([len(x) if g else 0 for x, g in zip(rows, good, strict=True)])
        n_groups = np.diff(np.searchsorted(cuts, text_ends, "right"), prepend=0)

        begins_a, begins_b = ends_a - self.a.sizes[a], ends_b - self.b_sizes[b]
        low = np.searchsorted(ends_b, begins_a, "right")
        met = np.searchsorted(begins_b, ends_a, "left") - low
        doc_a = np.repeat(np.arange(n), count_a)
        pair = np.repeat(a.astype(np.int64), met) * self.b.size + b[_ranges(low, met)]
        first, pairs, times = _distinct(np.repeat(doc_a, met), pair, self.a.size * self.b.size, n)
        n_links = np.bincount(doc_a, met, n).astype(np.int64)

        # in the text of groups a token of A stands behind all tokens of the groups before, one of B also behind its group's of A
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        take = np.zeros(len(a) + len(b), np.int64)
        take[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + last_a * self.a.size
        take[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + last_b * self.b.size + 2 * self.a.size
        groups = [x[:-1] for x in _joined(self.text_of, take, np.cumsum(count_a + counts_b)).to_pylist()]
        return {"n_a": count_a, "n_b": counts_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "first": first, "pairs": pairs, "times": times}


def token_pairs(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """One row per row of docs: (row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<long>, times array<int>,
    with groups=True also groups string). row tells rows apart; a pair is a's id times B's size plus b's id."""
    kind = dict(docs.dtypes)[id_col]
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>" + ", groups string" * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            got = aligner.align(part.column("text").cast(pa.binary()).to_pylist())
            first = pa.array(got["first"].astype(np.int32))
            columns = [part.column("row"), part.column("id"), *(pa.array(got[k].astype(np.int64)) for k in ("n_a", "n_b", "n_groups", "n_links"))]
            columns.append(pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in got["groups"]]))
            columns += [pa.ListArray.from_arrays(first, pa.array(got[k])) for k in ("pairs", "times")]
            if groups:
                columns.append(pa.array(got["groups"], pa.binary()).cast(pa.string()))
            return pa.RecordBatch.from_arrays(columns, names)

        return grouped(one(part) for batch in batches for part in slices(batch, "text", SLICE_BYTES))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) over links(row, pairs, times): best where no pair of the same id of B has more. Two shuffles, the first salted."""
    salted = links.groupBy("pairs", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("count"))
    summed = salted.groupBy(F.col("pairs").alias("pair")).agg(F.sum("count").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.pmod("pair", F.lit(width))))
    return summed.withColumn("best", F.col("count") == most)


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """One row per row of docs: (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]).

    n_best: links whose pair of ids is, over all of docs, no rarer than any other with the same id of B; count_sum: over
    links, how many links have their pair of ids. groups: `a1,a2|b1;a3|b2,b3`, ids in order, groups apart by ";".

    A null or empty text, and one that a tokenizer's tokens don't give back byte by byte (it holds U+2581, say), has no
    tokens: zeros and ''. Special tokens' strings are plain text. Rows that repeat, or have a null id, are rows of their own, and each
    counts; other columns are ignored; an empty table gives none. Both paths must be readable on every executor. One text is
    worked on whole and needs some 100 times its bytes.
    """
    width = load(b).size
    found = materialize(token_pairs(docs, a, b, id_col, text_col, groups), "aligned")
    links = found.select("row", F.inline(F.arrays_zip("pairs", "times")))
    pairs = materialize(pair_counts(links, width), "pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(pairs), F.col("pairs") == F.col("pair"))
    else:
        spread = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).withColumnRenamed("pairs", "pair").join(spread, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    more = ["groups_sha256", *(["groups"] if groups else [])]
    out = found.drop("pairs", "times").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), *more)
