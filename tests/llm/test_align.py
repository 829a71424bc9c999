"""Token alignment against plain Python over the libraries' own tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import align, queries

DATA = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = ["", None, " ", "  a  b", "a  b c ", "▁ a", "x <|endoftext|> y", "é è  ñ 日本 語 テ　 a", "<0x41> </s> <unk> <s>", "aaaa" * 300 + " " + " " * 50 + "b", "tab\t a\n b  c \n", "don't we'll 's 've  've", "𝒳 😀 a 😀‍ b", "a \x00 b \x1c c\x85 d", "naïve café – “x” … y", "a" + "word " * 20_000]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """[(id, end)] of both, or nothing where the bytes don't come back."""
    if not text:
        return [], []
    a, b = libraries
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    coded, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    of_a = [bytes(letters[c] for c in t) for t in coded.tokens]
    of_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids)]
    raw = (" " + text).encode()
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return [], []

    def ends(ids, parts):
        out, at = [], 0
        for i, p in zip(ids, parts, strict=True):
            at += len(p)
            out.append((i, at))
        return out

    return ends(coded.ids, of_a), ends(ids, of_b)


def plain(libraries, texts):
    """Rows as the query gives them."""
    found, corpus = [], Counter()
    for text in texts:
        a, b = tokens(libraries, text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = []
        i = j = 0
        for c in cuts:
            left, right = i, j
            while i < len(a) and a[i][1] <= c:
                i += 1
            while j < len(b) and b[j][1] <= c:
                j += 1
            groups.append((left, i, right, j))
        links = Counter()
        for left, i, right, j in groups:
            for x in range(left, i):
                for y in range(right, j):
                    if max(a[x - 1][1] if x else 0, b[y - 1][1] if y else 0) < min(a[x][1], b[y][1]):
                        links[a[x][0], b[y][0]] += 1
        corpus.update(links)
        shown = ";".join("|".join(",".join(str(t[0]) for t in part) for part in (a[left:i], b[right:j])) for left, i, right, j in groups)
        found.append((len(a), len(b), len(groups), links, shown))
    best = Counter()
    for (_, y), n in corpus.items():
        best[y] = max(best[y], n)
    out = []
    for n_a, n_b, n_groups, links, shown in found:
        top = sum(n for (x, y), n in links.items() if corpus[x, y] == best[y])
        out.append((n_a, n_b, n_groups, links.total(), top, sum(n * corpus[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


def test_op11_equals_plain_python(spark, libraries):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = plain(libraries, [d["text"] for d in docs])
    got = queries.queries()["op11_token_alignment"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted((d["doc_id"], *w) for d, w in zip(docs, want, strict=True))


@pytest.mark.parametrize("limit", [align.BROADCAST_PAIRS, 0])
def test_hard_texts_and_rows(spark, libraries, monkeypatch, limit):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", limit)
    texts = [*HARD, HARD[4], HARD[4]]
    ids = [None, None, *range(len(texts) - 3), 1]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "id", "pair", "pairs", "times", "count", "salt", "n_a")}).repartition(3)
    got = align.aligned(docs, A, B, groups=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    rows = got.collect()
    want = [(i, *w) for i, w in zip(ids, plain(libraries, texts), strict=True)]
    assert sorted((tuple(r)[:8] for r in rows), key=key) == sorted(want, key=key)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows)
    assert sum(r.n_a == 0 for r in rows) == 3
    assert align.aligned(docs.where("false"), A, B).count() == 0


def test_words_are_kept_and_cleared(libraries, monkeypatch):
    monkeypatch.setattr(align, "KEPT_WORDS", 3)
    encoder = align.ByteEncoder(align.load_bytes(A))
    for text in [*(t for t in HARD[3:-1]), *HARD[3:-1]]:
        ids, first = encoder.encode([b"", (" " + text).encode(), b""])
        assert ids.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids and first.tolist() == [0, 0, len(ids), len(ids)]
