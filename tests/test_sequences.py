"""Greedy list matching, near sentences and the first page's abstract against plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest

from foliant.functions.similarity import without_near_sentences
from foliant.operators import benchmark, regions


def test_greedy_list_f1(spark):
    rng = random.Random(2)
    words = ["introduction", "introductions", "methods", "method", "results", "result", "", "a", "conclusions and outlook", "conclusion and outlook"]
    rows = [([rng.choice(words) for _ in range(rng.randrange(6))], [rng.choice(words) for _ in range(rng.randrange(6))]) for _ in range(80)] + [(None, ["a"]), ([], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, e array<string>")
    for r in df.select("i", benchmark.list_f1()("a", "e").alias("m")).collect():
        actual, free, matched = rows[r.i][0] or [], list(rows[r.i][1] or []), 0
        n = len(free)
        for x in actual:
            scores = [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for y in free]
            if scores and max(scores) >= 0.85:
                free.pop(scores.index(max(scores)))
                matched += 1
        p, q = (matched / len(actual) if actual else 0.0), (matched / n if n else 0.0)
        assert (r.m.matched, r.m.precision, r.m.recall) == (matched, p, q) and r.m.f1 == pytest.approx(2 * p * q / (p + q) if p + q else 0.0)


def test_near_sentences(spark):
    rng = random.Random(4)
    base = ["The model works well on all of the images that we have.", "The model works well on all the images that we have!", "Short one.", "Shorter one.", "The model works well on all of the images that we have. We", "!!!", "Another thing is said here, at some length, once."]
    texts = [" ".join(rng.choice(base) + (f" Then {rng.randrange(40)} more." if rng.random() < 0.7 else "") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None]
    key = lambda s: " ".join(re.sub(r"[^\w\s]", "", s.lower()).split())

    def plain(text):
        if not text:
            return text
        kept = []
        for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text)):
            if not s:
                continue
            near = False
            for p in kept[-15:]:
                a, b = key(s), key(p)
                near |= SequenceMatcher(None, b, a).ratio() >= 0.92 or len(a) > 40 and (a in b or b in a)
            if not near:
                kept.append(s)
        return " ".join(kept)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.t for r in df.select("i", without_near_sentences("t").alias("t")).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_page_abstract(spark):
    long = "This is a block of the abstract which has more than sixty characters in it."
    rows = [(0, "Open access", 1), (1, "A long enough title of a paper", 1), (2, "Ann Lee1, Bo Ray2", 1), (3, "1 Department of Physics, Some University, in a town that has a long name", 1), (4, f"  {long} ", 1), (5, "Too short.", 1), (6, f"{long} doi.org", 1), (7, "Keywords: x", 1), (8, long, 1), (9, long, 2)]
    df = spark.createDataFrame([("p", *r) for r in rows] + [("q", 0, "1. Introduction to the title of it", 1), ("q", 1, "1.2 Heading", 1), ("q", 2, long, 1)], "paper_id string, ord int, text string, page_no int")
    assert {r.paper_id: r.abstract for r in regions.page_abstract(df).collect()} == {"p": f"{long} {long} doi.org"}
    assert regions.page_abstract(df.where("false")).count() == 0
