"""Language identification by nearest centroid.

A text's vector holds TF-IDF weights of hashed byte bigrams and trigrams of its letters (ASCII letters
in lower case, other ASCII as one space), normalised to length one. Document frequencies come from all
training texts. Each language has CENTROIDS spherical k-means centroids, fitted on at most SAMPLE
training texts of the language that have a letter: those of the lowest hashes of id and text together, a row that repeats both
counting once. SAMPLE is the documented bound of the fit, and no language with such a text falls out of it.
A text gets the language of the centroid with the highest cosine. It is rejected if the distance to
that centroid is beyond what the centroid's own members show (or if it has no letter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.arrowtext import grouped, slices

DIMS = 4096
CENTROIDS = 4
SAMPLE = 400
ROUNDS = 12
#: Of a centroid's lowest member cosine, the part below which a text is rejected.
REJECT = 0.35
UNDECIDED = "und"

#: More languages than this are refused: each is some rows on the driver.
MAX_LANGS = 10_000
#: Places of the hashes that choose the sample.
PLACES = 1 << 31
#: Texts, and bytes of them, whose vectors are made together, so that they stay in a core's cache.
ROWS, SLICE_BYTES = 16, 1 << 16
_FOLD = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))
_LOG = np.log1p(np.arange(4096, dtype=np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text mod 5 is 0; such documents teach nothing. A null id isn't held out: its text may teach."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts by text and dimension, whether a text has a letter)."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    n = len(raw)
    data = np.frombuffer(b"  ".join([b"", *raw, b"  "]).translate(_FOLD), np.uint8)
    begins = np.cumsum([2, *(len(x) + 2 for x in raw)])
    # windows start at the space before each text and end in the two spaces behind it
    m = begins[-1] - begins[0]
    a, b, c = (data[k : k + m].astype(np.uint32) for k in (1, 2, 3))
    at = np.repeat(np.arange(0, n * DIMS, DIMS), np.diff(begins))
    pair = (a << np.uint32(8)) | b
    at[pair == 0x2020] = n * DIMS  # runs of spaces say nothing
    two = (pair * np.uint32(0x9E3779B1)) >> np.uint32(20)
    three = (((pair << np.uint32(8)) | c) * np.uint32(0x85EBCA77)) >> np.uint32(20)
    size = (n + 1) * DIMS
    counts = (np.bincount(at + two, minlength=size) + np.bincount(at + three, minlength=size))[: n * DIMS]
    ascii_letters = np.add.reduceat(data != 0x20, begins[:-1]) if n else np.zeros(0, np.int64)
    letters = np.array([bool(k) and (x.isascii() or any(ch.isalpha() for ch in x.decode("utf-8", "replace"))) for k, x in zip(ascii_letters, raw, strict=True)], bool)
    return counts.reshape(n, DIMS), letters


def _weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(TF-IDF weights, length of each row)."""
    v = _LOG[counts] if counts.size == 0 or counts.max() < len(_LOG) else np.log1p(counts.astype(np.float32))
    v *= idf
    return v, np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v), np.float32(1e-12)))


def _parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    for part in slices(batch, column, SLICE_BYTES):
        for begin in range(0, part.num_rows, ROWS):
            yield part.slice(begin, ROWS)


def _kmeans(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centroids, lowest member cosine of each). Starts from far-apart members."""
    chosen = [0]
    near = v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    cosine = v @ c.T
    own = cosine.argmax(1)
    return c, np.array([cosine[own == i, i].min() if (own == i).any() else 1.0 for i in range(len(c))])


class CentroidModel:
    """Centroids with their languages and rejection bounds, and the IDF weights."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], bounds: np.ndarray):
        self.idf, self.centroids, self.langs, self.bounds = idf, centroids, langs, bounds

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine 0 to 1, accepted) of each text."""
        counts, letters = _counts(texts)
        if not self.langs:
            return [UNDECIDED] * len(letters), np.zeros(len(letters)), np.zeros(len(letters), bool)
        v, length = _weights(counts, self.idf)
        cosine = (v @ self.centroids.T) / length[:, None]
        best = cosine.argmax(1) if len(cosine) else np.zeros(0, int)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
        ok = letters & (score >= self.bounds[best] * REJECT)
        return [self.langs[b] if a else UNDECIDED for a, b in zip(letters, best, strict=True)], np.where(letters, score, 0.0), ok


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> CentroidModel:
    """A model of docs' labelled texts; rows with a null text or language teach nothing.

    Sent to the driver: one count for each language, DIMS document frequencies, CENTROIDS vectors for
    each language; more than MAX_LANGS languages are refused. Ids may be null or repeated. Equal texts of a language are one and
    the same to k-means but for their number, rows of equal id and text in that too; its ties go to the lower hash. Without a
    labelled text the model knows no language.
    """
    train = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    able = train.where(F.col("text").rlike(r"\p{L}"))
    place = F.pmod("h", F.lit(PLACES))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for part in _parts(batch):
                df += (_counts(part.column("text"))[0] > 0).sum(0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append([n], df))], ["dim", "n"])

    found = {r.dim: r.n for r in train.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = found.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + found.get(i, 0))) + 1 for i in range(DIMS)], np.float32)
    # about twice as many as the sample asks for, and the lowest one in any case
    seen = able.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min(place).alias("low")).limit(MAX_LANGS + 1).collect()
    if len(seen) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not seen:
        return CentroidModel(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    limits = F.create_map(*[F.lit(x) for r in seen for x in (r.lang, max(r.low + 1, int(min(1.0, 2 * SAMPLE / r.n) * PLACES)))])
    chosen = able.where(place < limits[F.col("lang")])

    def vector(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, letters = _counts(part.column("text"))
        v, length = _weights(counts, idf)
        v /= length[:, None]
        keep = np.flatnonzero(letters)
        at = pa.array(keep)
        return pa.RecordBatch.from_arrays([part.column("lang").take(at), part.column("h").take(at), pa.array([x.tobytes() for x in v[keep]], pa.binary())], ["lang", "h", "vector"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(vector(part) for batch in batches for part in _parts(batch))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        c, low = _kmeans(np.stack([np.frombuffer(x, np.float32) for x in group["vector"]]), CENTROIDS)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "i": range(len(c)), "low": low, "vector": [x.astype(np.float32).tobytes() for x in c]})

    each = chosen.mapInArrow(vectors, "lang string, h long, vector binary").groupBy("lang", "h").agg(F.min("vector").alias("vector"))
    lowest = each.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(PLACES)), "h"))).where(F.col("turn") <= SAMPLE)
    rows = lowest.groupBy("lang").applyInPandas(cluster, "lang string, i int, low double, vector binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.i))
    centroids = np.stack([np.frombuffer(r.vector, np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return CentroidModel(idf, centroids, [r.lang for r in rows], np.array([r.low for r in rows]))


def predictions(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, lang_pred, score, accepted).

    lang_pred is a learned language, or `und` with score 0 if the text is null, empty or without a
    letter, or nothing was learned; such texts are not accepted. Whole texts are read. Other columns
    are ignored, repeated rows give repeated rows, an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, ok = model.predict(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], [id_col, "lang_pred", "score", "accepted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(one(part) for batch in batches for part in _parts(batch))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: CentroidModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model accepts; repeated rows stay, if they do, as often."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [model.predict(part.column(text_col))[2] for part in _parts(batch, text_col)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *ok])))

    return docs.mapInArrow(run, schema)
