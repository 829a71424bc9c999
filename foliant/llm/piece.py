"""SentencePiece BPE encoding and decoding as vectorised merge rounds in numpy.

The model file is read for its vocabulary only. Encoding: spaces become the word mark, a mark is put
before each text, and texts fall into words between characters that no piece has next to each other, such as
a letter and a mark, so no merge crosses such a place. Words are told apart exactly by
Arrow's dictionary encoding; each distinct word is encoded once as long as the task keeps it. The symbols of many
words lie in one flat array. A round finds each word's best-ranked pair, merges its occurrences from the left at the same
time in all words, and compacts the array; words without a pair leave. Where a merge would make a pair
that ranks before the one just merged, later occurrences in that word wait for the next round, so that
the order is that of one merge at a time.

Decoding maps ids to bytes, marks to spaces, and drops the first mark of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliant.llm.arrowtext import grouped, slices

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Texts that are encoded together.
SLICE_BYTES = 2 << 20
#: Symbols that are merged together: few enough that their arrays stay in a core's cache.
MERGE_SYMBOLS = 1 << 15
#: Rounds that they have on their own; words with more to merge go on together, as few are left.
OWN_ROUNDS = 8
#: Encoded words that a task keeps for its next slices; of more, those stay that several slices had.
KEPT_WORDS = 1 << 18
_NONE = np.int32((1 << 31) - 1)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        width = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            if width is None:
                width, i = varint(i)
            value, i = raw[i : i + width], i + width
        yield key >> 3, value



class PieceModel:
    """Vocabulary and merge table of a BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        entries = [dict(_fields(v)) for k, v in model if k == 1]
        norm = dict(_fields(next(v for k, v in model if k == 3)))
        train = dict(_fields(next(v for k, v in model if k == 2)))
        if train.get(3) != 2 or norm.get(2) or norm.get(3, 1) != 1 or norm.get(4, 1) != 0 or not train.get(35):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix, kept white space and byte fallback are read")
        self.pieces = [e[1].decode() for e in entries]
        kinds = [e.get(3, NORMAL) for e in entries]
        if set(kinds) - {NORMAL, UNKNOWN, BYTE, 3}:
            raise ValueError("user-defined and unused pieces aren't supported")
        scores = [np.frombuffer(e.get(2, b"\0\0\0\0"), "<f4")[0] for e in entries]
        self.size = len(entries)
        self.unknown = kinds.index(UNKNOWN)
        self.index = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        #: By the last byte of a character and the first one of the next: whether no piece has these two inside.
        self.cuts = np.ones((256, 256), bool)
        self.cuts[:, 0x80:0xC0] = False
        for piece in self.index:
            chars = [c.encode() for c in piece.replace(MARK, " ")]
            for x, y in zip(chars[:-1], chars[1:], strict=True):
                self.cuts[x[-1], y[0]] = False
        self.cuts = self.cuts.ravel()
        self.byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        levels = sorted({-float(scores[i]) for i in self.index.values()})
        rank = {x: k for k, x in enumerate(levels)}
        #: The piece of each rank, and whether several have it.
        self.ranked, self.tied = np.zeros(len(levels), np.int32), np.zeros(len(levels), bool)
        seen = set()
        for i in self.index.values():
            k = rank[-float(scores[i])]
            self.ranked[k], self.tied[k] = i, k in seen
            seen.add(k)
        pairs = {}
        self._tied_pairs: dict[tuple[int, int], int] = {}
        for piece, i in self.index.items():
            k = rank[-float(scores[i])]
            for cut in range(1, len(piece)):
                left, right = self.index.get(piece[:cut]), self.index.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = k
                    if self.tied[k]:
                        self._tied_pairs[left, right] = i
        self._fill(pairs)
        self._char = np.full(0x110000, -1, np.int32)
        for piece, i in self.index.items():
            if len(piece) == 1:
                self._char[0x20 if piece == MARK else ord(piece)] = i
        self.ids_text = pa.array([f"{i}," for i in range(self.size)], pa.large_binary())
        self.count = np.ones(self.size, np.int64)
        control = [k == 3 for k in kinds]
        raw = [b"" if c else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k, c in zip(self.pieces, kinds, control, strict=True)]
        self.bytes_of = pa.array(raw, pa.large_binary())
        self.raw = raw

    def _fill(self, pairs: dict[int, int]) -> None:
        """A cuckoo table: each pair's key << 20 | rank lies in one of two slots."""
        bits = max(4, (2 * len(pairs)).bit_length())
        self._shift = np.uint64(64 - bits)
        slots = [-1] * (1 << bits)
        for item in (key << 20 | rank for key, rank in pairs.items()):
            turn = 0
            for _ in range(1000):
                at = (((item >> 20) * int(_ODD[turn])) & ((1 << 64) - 1)) >> (64 - bits)
                item, slots[at] = slots[at], item
                if item < 0:
                    break
                turn = int((((item >> 20) * int(_ODD[0])) & ((1 << 64) - 1)) >> (64 - bits) == at)
            else:
                raise ValueError("the merge table can't be built")
        self._slots = np.array(slots, np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair merges to; _NONE where there is none."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = 1 << 42
        h = key.view(np.uint64)
        out = np.full(len(key), _NONE)
        for odd in _ODD:
            slot = self._slots[((h * odd) >> self._shift).view(np.int64)]
            hit = slot >> 20 == key
            out[hit] = slot[hit] & 0xFFFFF
        return out

    def _merged(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of these ranks become."""
        out = self.ranked[rank]
        for i in np.flatnonzero(self.tied[rank]):
            out[i] = self._tied_pairs[int(left[i]), int(right[i])]
        return out

    def merge(self, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all words until no pair remains. parts: (symbols, word of each, ascending)."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        late = []
        for sym, seg in parts:
            rank = np.full(len(sym), _NONE)
            inner = np.flatnonzero(seg[1:] == seg[:-1])
            rank[inner] = self.pair(sym[inner], sym[inner + 1])
            late.append(self._rounds(sym, seg, rank, OWN_ROUNDS, done))
        self._rounds(*(np.concatenate(x) for x in zip(*late, strict=True)), 1 << 62, done)
        sym, seg = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _rounds(self, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, most: int, done: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Up to `most` rounds; words without a pair go to done, the others are returned. rank: of each symbol with its next."""
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            over = best == _NONE
            if over.any():
                out = np.repeat(over, size)
                done.append((sym[out], seg[out]))
                keep = ~out
                sym, seg, rank = sym[keep], seg[keep], rank[keep]
                best, size = best[~over], size[~over]
            if not len(sym) or not most:
                break
            most -= 1
            low = np.repeat(best, size)
            hit = np.flatnonzero(rank == low)
            merged = self._merged(low[hit], sym[hit], sym[hit + 1])
            if len(hit) > len(best):  # some words have their best pair more than once
                word = seg[hit]
                again = np.concatenate([[False], word[1:] == word[:-1], [False]])
                several = np.flatnonzero(again[1:] | again[:-1])
                use = np.ones(len(hit), bool)
                use[several] = self._together(sym, seg, hit[several], merged[several], low[hit[several]])
                hit, merged = hit[use], merged[use]
            sym[hit] = merged
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            # merges are apart, so a merged symbol has moved by the number of those before it
            at = hit - np.arange(len(hit))
            rank[at] = _NONE
            at = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(at + 1, len(sym) - 1)
            same = (seg[at] == seg[after]) & (after > at)
            rank[at] = _NONE
            at = at[same]
            rank[at] = self.pair(sym[at], sym[at + 1])
        return sym, seg, rank

    def _together(self, sym: np.ndarray, seg: np.ndarray, hit: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which of the occurrences of words' best pairs merge in the same round; merged: what they become."""
        # of touching occurrences every other one counts, from the left
        fresh = np.concatenate([[True], (np.diff(hit) != 1)])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        use = (np.arange(len(hit)) - run) % 2 == 0
        chosen = np.flatnonzero(use)
        hit, merged, rank = hit[chosen], merged[chosen], rank[chosen]
        word = seg[hit]
        again = np.concatenate([[False], word[1:] == word[:-1]])
        # occurrences behind one that makes an equal or better pair wait
        touch = again & np.concatenate([[False], hit[1:] == hit[:-1] + 2])
        before = np.where(touch, np.concatenate([[0], merged[:-1]]), sym[np.maximum(hit - 1, 0)])
        has_left = (hit > 0) & (seg[np.maximum(hit - 1, 0)] == word)
        at = np.minimum(hit + 2, len(sym) - 1)
        has_right = (hit + 2 < len(sym)) & (seg[at] == word)
        stop = (has_left & (self.pair(before, merged) <= rank)) | (has_right & (self.pair(merged, sym[at]) <= rank))
        seen = np.cumsum(stop) - stop
        use[chosen] = seen - np.maximum.accumulate(np.where(again, 0, seen)) == 0
        return use


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _joined(values: pa.Array, take: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Concatenation of values[take] in runs that end at `ends` (exclusive)."""
    flat = values.take(pa.array(take))
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    cut = offsets[np.concatenate([[0], ends])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cut.astype(np.int64).tobytes()), flat.buffers()[2]])


class Encoder:
    """Encodes slices of texts one after the other, and keeps words that it has encoded."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        none = pa.array([], pa.large_binary())
        self.words, self.ids, self.decoded = none, none, none
        self.sizes = self.slices_of = np.zeros(0, np.int64)
        self.unknown: dict[int, int] = {}  # code points without a piece, in the order in which they came

    def _symbols(self, chars: np.ndarray) -> np.ndarray:
        """Piece of each code point; size + k for the k-th unknown one."""
        out = self.model._char[chars]
        lost = np.flatnonzero(out < 0)
        if len(lost):
            distinct, back = np.unique(chars[lost], return_inverse=True)
            out[lost] = self.model.size + np.array([self.unknown.setdefault(int(c), len(self.unknown)) for c in distinct])[back]
        return out

    def _add(self, new: pa.Array) -> None:
        """Encode words that aren't kept yet."""
        offsets = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(new.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        # a character begins at each byte that continues none
        chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets - offsets[0]]
        cuts = [0]
        while cuts[-1] < len(new):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begins, begins[cuts[-1]] + MERGE_SYMBOLS, "right")) - 1))
        sym, seg = self.model.merge((self._symbols(chars[begins[f] : begins[e]]), np.repeat(np.arange(f, e, dtype=np.int32), np.diff(begins[f : e + 1]))) for f, e in zip(cuts[:-1], cuts[1:], strict=True))
        model = self.model
        fallback = [[model.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in self.unknown]
        ids_text = pa.concat_arrays([model.ids_text, pa.array([("".join(f"{i}," for i in x)).encode() for x in fallback], pa.large_binary())])
        bytes_of = pa.concat_arrays([model.bytes_of, pa.array([b"".join(model.raw[i] for i in x) for x in fallback], pa.large_binary())])
        count = np.concatenate([model.count, np.array([len(x) for x in fallback], np.int64)])
        ends = np.searchsorted(seg, np.arange(len(new)), "right")
        self.words = pa.concat_arrays([self.words, new])
        self.ids = pa.concat_arrays([self.ids, _joined(ids_text, sym, ends)])
        self.decoded = pa.concat_arrays([self.decoded, _joined(bytes_of, sym, ends)])
        self.sizes = np.concatenate([self.sizes, np.add.reduceat(count[sym], np.concatenate([[0], ends[:-1]]))])
        self.slices_of = np.concatenate([self.slices_of, np.zeros(len(new), np.int64)])

    def _make_room(self) -> None:
        if len(self.unknown) > KEPT_WORDS:
            self._clear()
        if len(self.words) <= KEPT_WORDS:
            return
        often = np.flatnonzero(self.slices_of > 1)
        keep = np.sort(often[np.argsort(-self.slices_of[often], kind="stable")[: KEPT_WORDS // 2]])
        at = pa.array(keep)
        self.words, self.ids, self.decoded = (x.take(at) for x in (self.words, self.ids, self.decoded))
        self.sizes, self.slices_of = self.sizes[keep], self.slices_of[keep] // 2

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """(number of ids, ids as text with a comma behind each, decoded bytes) of each text."""
        self._make_room()
        mark = MARK.encode()
        rows = [(b" " + (x.replace(mark, b" ") if mark in x else x)) if x else b"" for x in texts]
        data = np.frombuffer(b"".join(rows), np.uint8)
        begins = np.cumsum([0, *map(len, rows)])
        start = np.ones(len(data), bool)
        start[1:] = self.model.cuts[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
        start[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(start)
        first = np.searchsorted(starts, begins)
        offsets = np.append(starts, len(data)).astype(np.int64)
        listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = listed.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            place[new] = len(self.words) + np.arange(new.sum())
            self._add(coded.dictionary.filter(pa.array(new)))
        self.slices_of[place] += 1
        word = place[coded.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(self.sizes[word])])
        whole = (_joined(x, word, first[1:]).to_pylist() for x in (self.ids, self.decoded))
        return total[first[1:]] - total[first[:-1]], *whole


def encode(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text; none for a null or empty one."""
    _, ids, _ = Encoder(load(path)).encode([None if x is None else x.encode("utf-8", "surrogatepass") for x in texts])
    return [[int(i) for i in x.split(b",")[:-1]] for x in ids]


def _text_of(raw: bytes) -> bytes:
    """Decoded bytes of a text: without the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
    raw = raw[1:] if raw[:1] == b" " else raw
    return raw.decode("utf-8", "replace").encode()


def decode(ids: list[list[int]], path: str) -> list[str]:
    """Text of each list of ids."""
    model = load(path)
    return [_text_of(b"".join(model.raw[i] for i in x)).decode() for x in ids]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per row of docs: (id_col, n_tokens, ids array<int>, ids_sha256, decoded, decoded_sha256).

    ids and decoded are left out with ids=False. Texts are encoded whole; a null or empty text has no
    tokens, and digests of the empty string. Rows that repeat give repeated rows; other columns are
    ignored; an empty table gives none. `path` must be readable on every executor.
    """
    more = ", ids array<int>, decoded string" if ids else ""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path))

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes, listed, decoded = encoder.encode(part.column("text").cast(pa.binary()).to_pylist())
            out = [_text_of(x) for x in decoded]
            columns = [
                part.column("id"),
                pa.array(sizes),
                pa.array([hashlib.sha256(memoryview(x)[:-1]).hexdigest() for x in listed]),
                pa.array([hashlib.sha256(x).hexdigest() for x in out]),
            ]
            if ids:
                flat = np.fromstring(b"".join(listed)[:-1], np.int32, sep=",") if any(listed) else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)))
                columns.append(pa.array(out, pa.binary()).cast(pa.string()))
            return pa.RecordBatch.from_arrays(columns, names)

        return grouped(one(part) for batch in batches for part in slices(batch, "text", SLICE_BYTES))

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, schema)
