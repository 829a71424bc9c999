"""List items are matched by value or behind counts of characters; the result is that of comparing every pair."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest

from foliant.operators import benchmark


def plain(xs, ys, bound):
    free, matched = set(range(len(ys))), 0
    for x in xs:
        best, at = 0.0, -1
        for j in sorted(free):
            s = SequenceMatcher(None, x, ys[j]).ratio() if x and ys[j] else 0.0
            if s > best:
                best, at = s, j
        if best >= bound:
            free.discard(at)
            matched += 1
    return matched


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcé\U0001d4d0 ", k=rng.choice([1, 6, 12, 30])))
    rows = []
    for _ in range(60):
        xs = [word() for _ in range(rng.randrange(9))]
        ys = [x if rng.random() < 0.3 else x[: len(x) // 2] + rng.choice("abé") + x[len(x) // 2 :] for x in xs] + [word() for _ in range(3)]
        rng.shuffle(ys)
        rows.append((xs + xs[:2], ys + ys[:1] + [""]))
    return [*rows, ([], ["a"]), (["a", None, "a"], ["a", None]), (["a"], [])]


@pytest.mark.parametrize("bound", [0.5, 0.85, 1.0])
def test_as_every_pair(spark, lists, bound):
    df = spark.createDataFrame([(i, a, e) for i, (a, e) in enumerate(lists)], "i int, a array<string>, e array<string>")
    out = df.select("i", benchmark.list_f1(bound)("a", "e").alias("m")).select("i", "m.*").orderBy("i").collect()
    assert [r.matched for r in out] == [plain(a, e, bound) for a, e in lists]
    assert sum(r.matched for r in out) > 60


def test_unlike_texts_are_not_compared(spark, monkeypatch):
    made = benchmark.list_f1().func

    class Refused(SequenceMatcher):
        def set_seq1(self, a):
            if a and a[0] == "u":
                raise AssertionError("an unlike text was compared")
            super().set_seq1(a)

    monkeypatch.setattr(benchmark, "SequenceMatcher", Refused)
    found = made(pd.Series([["uvwx" * 9, "same"]]), pd.Series([["abcd" * 9, "uuuu" * 9, "same"]]))
    assert found.matched.tolist() == [1]
