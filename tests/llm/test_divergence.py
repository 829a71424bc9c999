"""Divergence of sources against plain Python with its own whole numbers, and tries against sorted lists."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, least=10):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [([re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)], source) for text, x, source in docs if x == lang]
        seen = Counter(t for ts, _ in mine for t in set(ts))
        kept = {t for t, n in seen.items() if n >= least}
        count = {s: Counter() for _, s in mine}
        for ts, s in mine:
            count[s].update(t for t in ts if t in kept)
        whole = sum(count.values(), Counter())

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [*"the of Über größe x Y zz z ź 日本 日 the-end ß İ I".split(), *(f"{a}{b}" for a in "abcdé" for b in "stuvwxyz")]
    out = [(rng.choice(["", " ", "\n", "1", "a\x00b"]).join(rng.choices(words, [3 + k % 7 for k in range(len(words))], k=rng.randrange(60))), rng.choice(["en", "fr", None, ""]), rng.choice(["s0"] * 6 + ["s1", "s2", "ŝ", "𝒳", None])) for _ in range(600)]
    return [*out, *out[:40], (None, "en", "only null"), ("12 34", "none", "a"), (None, "none", "b"), ("rare", "none", None), ("word " * 50_000, "en", "s1")]


@pytest.mark.parametrize("limit", [divergence.BROADCAST_GROUPS, 0])
def test_equals_plain_python(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", limit)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("terms", "groups", "total", "v", "item", "part", "prefix", "salt")}).repartition(5)
    got = sorted(map(tuple, divergence.divergence(docs).collect()))
    assert got == plain(rows)
    assert {r[:4] for r in got if r[0] == "none"} == {("none", x, "pair", y) for x in ("", "a", "b") for y in ("", "a", "b") if x != y}
    assert divergence.divergence(docs.where("false")).count() == 0


def test_trie(rows):
    terms = [t.encode() for text, *_ in rows for t in TERM.findall(text or "")] + [b""]
    random.Random(1).shuffle(terms)
    trie = divergence.RadixTrie()
    number = {}
    for k in range(0, len(terms), 1000):
        part = sorted(terms[k : k + 1000])
        for t, n in zip(part, trie.numbers(part), strict=True):
            assert number.setdefault(t, n) == n
    assert list(zip(*trie.walk(), strict=True)) == sorted(number.items()) and trie.size == len(number)


def test_small_slices_tables_and_pieces(monkeypatch):
    """Counters of many pieces add up; a table of few counters gives what one of many does."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(divergence, "PREFIX", 1)
    counter = divergence.Counter()
    counter.add("en", [b"one two two", b"two three"], ["a", "b"])
    counter.add("en", [b"Two on", b""], ["b", "c"])
    pieces = list(counter.pieces())
    assert [(p["prefix"], *(p[k].to_pylist() for k in ("terms", "docs", "sizes", "sources", "counts"))) for p in pieces] == [(b"o", [b"on", b"one"], [1, 1], [1, 1], ["b", "a"], [1, 1]), (b"t", [b"three", b"two"], [1, 3], [1, 2], ["b", "a", "b"], [1, 2, 2])]
    row = {"lang": "en", "terms": [b"on", b"one", b"two"], "sizes": [1, 2, 2], "sources": ["b", "a", "b", "a", "b"], "counts": [1, 2, 1, 2, 2], "groups": [{"source": "a", "total": 4}, {"source": "b", "total": 4}, {"source": "c", "total": 0}], "v": 3}
    batch = pa.RecordBatch.from_pylist([row])
    found = []
    for cells in (1 << 20, 3, 1):
        monkeypatch.setattr(divergence, "CELLS", cells)
        sums = Counter()
        for b in divergence._scored(iter([batch])):
            for r in b.to_pylist():
                sums[r["part"], r["source"], r["item"]] += r["value"]
        found.append(sums)
    assert found[0] == found[1] == found[2] and ("pair", "a", b"b") in found[0]
    big = divergence._shares(np.array([10**14, 0]), 5 * 10**14, 10**10)
    assert big.tolist() == [1 + 10**9 * (n + 2) // (5 * 10**14 + 2 * 10**10) for n in (10**14, 0)]
