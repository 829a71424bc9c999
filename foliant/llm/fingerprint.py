"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text (Chakraborty, Goldenberg and Koucky, 2016): at step j it notes the
character under a pointer, and moves the pointer on or not by a random bit that depends on j and on the
character. Texts at a small edit distance fall back into step, so that their walks differ in few places.
A fingerprint keeps a sample of the walk: 4 bits of the character at about SAMPLES steps. Sampled steps
are nested: those of level l + 1 are one of each two of level l, so that texts of different lengths
compare at the coarser level of the two. The likeness of two fingerprints is the share of sampled steps,
up to the longer end, that agree.

The walk is sequential in a text, so it runs over many texts at once: a numpy step moves the pointers of
all texts of a slice. The last few, longest ones go on one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtext import mix
from foliant.plans.scratch import materialize

SAMPLES = 128
_WIDTH = SAMPLES * 3 // 2
_PERIOD = 8191
_PAD = 64
#: Characters whose texts walk together: few enough that the pointers' surroundings stay in a core's cache.
_SLICE_CHARS = 1 << 20
#: Of so few texts each goes on alone.
_FEW = 24
#: Ranges of ids for each task that they are dealt to.
_RANGES = 8
#: Stands for a null id.
_NO_ID = -(1 << 63)
_MOVE = np.random.default_rng(91).integers(0, 2, (_PERIOD, 256), dtype=np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_EMPTY = "0."


@cache
def _choice(level: int, n: int) -> np.ndarray:
    """Which of two samples of the level below each of n samples of a level is: 0 or 1."""
    return (mix(np.arange(n, dtype=np.uint64) + (np.uint64(level) << np.uint64(40))) & np.uint64(1)).astype(np.int64)


def _highest(steps: int) -> np.ndarray:
    """The highest level at which each step is sampled."""
    out, at, level = np.zeros(steps, np.int8), np.arange(steps), 0
    while len(at) > 1:
        level += 1
        m = len(at) // 2
        at = at[2 * np.arange(m) + _choice(level, _round_up(m))[:m]]
        out[at] = level
    return out


def _round_up(n: int) -> int:
    return 1 << max(10, n.bit_length())


def _level(n: int) -> int:
    return max(0, (2 * n - 1).bit_length() - SAMPLES.bit_length() + 1) if n else 0


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text, `level.samples` in hexadecimal; equal texts have equal ones."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    out = [_EMPTY] * len(texts)
    if not len(order):
        return out
    gap = "\0" * _PAD
    code = np.frombuffer((gap.join(texts[i] for i in order) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = code.astype(np.uint8)
    wide = np.flatnonzero(code > 255)
    kind[wide] = mix(code[wide].astype(np.uint64)) & np.uint64(255)
    shade = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(60)).astype(np.uint8)
    n = sizes[order]
    begin = np.concatenate([[0], np.cumsum(n + _PAD)[:-1]])
    level = np.array([_level(int(x)) for x in n])
    grid = np.full((len(order), _WIDTH), 255, np.uint8)
    row, pos, end, lev = np.arange(len(order)), begin.copy(), begin + n, level.copy()
    steps = int(3 * n.max())
    highest = _highest(steps)
    j = 0
    while len(row) > _FEW and j < steps:
        # levels fall along the rows: those of at most l are the rows from since[l] on
        since = np.searchsorted(-lev, -np.arange(lev[0] + 1))
        for j in range(j, min(j + _PAD, steps)):  # noqa: B020
            c = kind.take(pos)
            top = min(int(highest[j]), len(since) - 1)
            first = since[top]
            if first < len(row):
                col = j >> lev[first:]
                ok = (pos[first:] < end[first:]) & (col < _WIDTH)
                grid[row[first:][ok], col[ok]] = shade[c[first:][ok]]
            pos += _MOVE[j % _PERIOD].take(c)
        j += 1
        live = (pos < end) & (j < (_WIDTH << lev))
        if not live.all():
            row, pos, end, lev = row[live], pos[live], end[live], lev[live]
    for r, at, last, l in zip(row.tolist(), pos.tolist(), end.tolist(), lev.tolist(), strict=True):
        _walk(kind, at, last, j, np.flatnonzero(highest[: min(steps, _WIDTH << l)] >= l), l, shade, grid[r])
    filled = (grid != 255).sum(1)
    text = _HEX[np.where(grid == 255, 0, grid)]
    for i, k in enumerate(order):
        out[k] = f"{level[i]:x}." + text[i, : filled[i]].tobytes().decode()
    return out


_MOVES = [x.tobytes() for x in _MOVE]


def _walk(kind: np.ndarray, pos: int, end: int, j: int, sampled: np.ndarray, level: int, shade: np.ndarray, out: np.ndarray) -> None:
    """One text's walk from step j on, with pos and end in kind; its samples at the steps `sampled` go to out."""
    text, seen = kind[pos:end].tobytes(), []
    sampled = sampled[np.searchsorted(sampled, j) :]
    at, n = 0, end - pos
    for step in sampled.tolist():
        # the pointer can't leave the text within as many steps as it has characters left
        while j < step and at < n:
            f = j % _PERIOD
            for moves in _MOVES[f : f + min(step - j, n - at)]:
                at += moves[text[at]]
                j += 1
        if at >= n:
            break
        seen.append(text[at])
    cols = sampled[: len(seen)] >> level
    out[cols] = shade[np.array(seen, np.int64)]


def likeness(a: str, b: str) -> float:
    """Share of agreeing samples of two fingerprints, 0 to 1; two empty texts are alike, an empty and another not."""
    if a == b:
        return 1.0
    if _EMPTY in (a, b):
        return 0.0
    (la, x), (lb, y) = (s.split(".") for s in (a, b))
    la, lb = int(la, 16), int(lb, 16)
    u, v = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    while la < lb:
        u, la = _coarser(u, la), la + 1
    while lb < la:
        v, lb = _coarser(v, lb), lb + 1
    n = min(len(u), len(v))
    return float((u[:n] == v[:n]).sum() / max(len(u), len(v), 1))


def _coarser(u: np.ndarray, level: int) -> np.ndarray:
    at = 2 * np.arange((len(u) + 1) // 2) + _choice(level + 1, 1 << 10)[: (len(u) + 1) // 2]
    return u[at[at < len(u)]]


ROW = "bucket int, last int, id long, text string"


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """ROW: docs(id, text) dealt to ranges of ids, sorted; after each range the first rows of the next one (last = 1)."""
    n = parts * _RANGES
    ids = docs.agg(F.min("id").alias("low"), F.percentile_approx("id", [i / n for i in range(1, n)], 10_000).alias("cuts")).first()
    low = ids.low if ids.low is not None else 0
    cuts = np.array(sorted({c for c in (ids.cuts or []) if c > low}), np.int64)
    ends = np.append(cuts, low)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("id").to_numpy()
            bucket = np.searchsorted(cuts, x, "right")
            again = np.flatnonzero(np.isin(x, ends))
            at = np.where(x[again] == low, len(cuts), bucket[again] - 1)
            rows = pa.array(np.concatenate([np.arange(len(x)), again]))
            last = np.concatenate([np.zeros(len(x)), np.ones(len(again))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket, at]).astype(np.int32)), pa.array(last), batch.column("id").take(rows), batch.column("text").take(rows)], ["bucket", "last", "id", "text"])

    return docs.mapInArrow(deal, ROW).repartition(parts, "bucket").sortWithinPartitions("bucket", "last", "id", "text")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next text by ascending id (after the last the first). Whole texts are read; a null text is empty.
    Ids are integers; rows of the same id follow by text; a null id comes before all others, and stays null. near_edited and near_next
    are the likeness to the edited and to the next text. A table of one row is followed by itself; an
    empty table gives none; other columns are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def emit(ids: list[int], texts: list[str], own: list[bool]) -> pa.RecordBatch:
        """Of every row but the last, if it is its range's own."""
        keep = [i for i in range(len(ids) - 1) if own[i]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in keep]
        prints = fingerprints(texts + edited)
        mine, changed = prints[: len(texts)], prints[len(texts) :]
        columns = [
            pa.array([None if ids[i] == _NO_ID else ids[i] for i in keep], pa.int64()),
            pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
            pa.array([mine[i] for i in keep], pa.string()),
            pa.array(changed, pa.string()),
            pa.array([likeness(mine[i], x) for i, x in zip(keep, changed, strict=True)], pa.float64()),
            pa.array([likeness(mine[i], mine[i + 1]) for i in keep], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        own: list[bool] = []
        held = 0
        for batch in batches:
            for i, text, last in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                own.append(not last)
                held += len(text)
                if held > _SLICE_CHARS and len(ids) > 1:
                    yield emit(ids, texts, own)
                    ids, texts, own, held = ids[-1:], texts[-1:], own[-1:], len(text)
        if len(ids) > 1:
            yield emit(ids, texts, own)

    return _in_order(rows, parts).mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


BANDS, BAND_SAMPLES = 24, 6


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """(a, b, likeness): texts with fingerprints alike by at least `least`, found by bit-sampled banding.

    Each band is BAND_SAMPLES samples of a fingerprint, at its own level and the next coarser one. Texts
    with equal fingerprints are one text, that with the smallest id; copies(a fingerprint each) are not
    expanded. All pairs of a band's bucket are compared, so their number grows with the square of a group of
    near texts. Null ids and texts take no part.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spots = np.random.default_rng(92).integers(0, SAMPLES // 2, (BANDS, BAND_SAMPLES))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text").to_pylist()), pa.string())], ["id", "print"])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("print").to_pylist(), strict=True):
                level, x = text.split(".")
                u = np.frombuffer(x.encode(), np.uint8)
                for up, v in ((0, u), (1, _coarser(u, int(level, 16)))):
                    for k, at in enumerate(spots):
                        ids.append(i)
                        keys.append(f"{int(level, 16) + up:x}.{k}." + "".join(chr(v[p]) if p < len(v) else "-" for p in at))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [likeness(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], ["a", "b", "likeness"])
            yield out.filter(pa.array([s >= least for s in score], pa.bool_()))

    one = materialize(rows.mapInArrow(prints, "id long, print string").groupBy("print").agg(F.min("id").alias("id")).where(F.col("print") != _EMPTY), "prints")
    band = one.select("id", "print").mapInArrow(bands, "id long, band string")
    band = materialize(band, "bands")
    pairs = band.withColumnRenamed("id", "a").join(band.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct()
    named = pairs.join(one.select(F.col("id").alias("a"), F.col("print").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("print").alias("y")), "b")
    return named.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, likeness double")
