"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

A word is a run of bytes other than U+0020 and U+0009..U+000D. These bytes never occur inside
a multi-byte character, so bytes give the same words as characters do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from ctypes import CDLL
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are worked on together: few enough that the arrays made from them stay in a core's cache.
SLICE_BYTES = 1 << 17
#: Bytes of text whose results go back to the JVM as one batch.
BATCH_BYTES = 1 << 22

#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_NEXT = np.uint64(0x9E6C63D0876A9A4B | 1)


def _keep_freed_memory() -> None:
    """Let glibc keep up to 64 MB of freed memory, so that arrays which come and go don't fault their pages in again."""
    with suppress(OSError, AttributeError):
        for option, value in ((-3, 32 << 20), (-1, 64 << 20)):  # fixed values: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            CDLL(None).mallopt(option, value)


_keep_freed_memory()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply), so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's texts hold about `limit` bytes at most; one longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > begin:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    yield batch.slice(begin)


def grouped(parts: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small batches, so that each that is yielded has about `limit` bytes at least, but for the last one."""
    held: list[pa.RecordBatch] = []
    total = 0
    for part in parts:
        held.append(part)
        total += part.nbytes
        if total >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Words:
    """Words of a batch: bytes from starts to ends of data; those of text i are first[i]..first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight at a time, and of its length."""
        size = self.ends - self.starts
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, strides=(1,))
        h = mix((eight[self.starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _NEXT)
        at, done = np.flatnonzero(size > 8), 8
        while len(at):
            left = size[at] - done
            h[at] = mix(h[at] * _NEXT + (eight[self.starts[at] + done] & _FIRST[np.minimum(left, 8)]))
            at, done = at[left > 8], done + 8
        return h


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none. White space stands around all of data."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    whole = b" ".join([b"", *raw, b" " * 8])
    data = np.frombuffer(whole.lower() if lower else whole, np.uint8)  # bytes.lower() is that of ASCII
    space = (data == 0x20) | (data - np.uint8(0x09) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([1, *(len(x) + 1 for x in raw)])
    return Words(data, starts, ends, np.searchsorted(starts, begins))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of `size` words; of all words where a text has fewer, but has any."""
    h = w.hashes()
    doc, counts = w.doc, w.counts
    left = w.first[1:][doc] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
    short = (counts < size)[doc]
    take = np.flatnonzero(np.where(short, np.arange(len(h)) == w.first[:-1][doc], left >= size))
    run = np.minimum(size, counts[doc[take]])
    out = mix(h[take] + run.astype(np.uint64))
    for k in range(1, size):
        more = run > k
        out[more] = mix(out[more] * np.uint64(0xD6E8FEB86659FD93) + h[take[more] + k])
    return doc[take], out


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by text: (first index by text, hashes sorted within each text). doc ascends."""
    h = h.copy()
    begins = np.searchsorted(doc, np.arange(n + 1)).tolist()
    for f, e in zip(begins[:-1], begins[1:], strict=True):
        h[f:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[keep], h[keep]
    return np.searchsorted(doc, np.arange(n + 1)), h
