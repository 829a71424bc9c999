"""Filtered similarity joins against all pairs, and how many pairs they let meet."""

import random
from difflib import SequenceMatcher

import pytest

from foliant.operators import benchmark, canonical, simjoin


def norm(x):
    return " ".join((x or "").lower().split())


def score(x, y):
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.9
    words = set(x.split(" "))
    return 0.65 * len(words & set(y.split(" "))) / len(words) + 0.35 * SequenceMatcher(None, x, y).ratio()


def brute_layout(targets, blocks, heading):
    out = {}
    for paper, t, text in targets:
        x = norm(text)
        found = [(score(x, norm(b[2])), b) for b in blocks if b[0] == paper and x and norm(b[2]) and (not heading or b[3] == "section_header")]
        found = sorted((f for f in found if f[0] >= 0.45), key=lambda f: (-f[0], f[1][1]))
        if not found:
            continue
        coords = []
        for s, b in found[:1] if heading else found:
            if s < 0.8 * found[0][0] or len(coords) >= 20:
                break
            coords += b[4]
        out[paper, t] = coords
    return out


@pytest.fixture(scope="module")
def papers():
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "rt", "s", "")] + ["the", "of", "a", "I", "2"]
    weights = [1] * (len(words) - 5) + [30, 20, 10, 5, 5]
    blocks, targets = [], []
    for paper in ("p1", "p2"):
        for i in range(70):
            text = " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 3, 6, 15, 40])))
            blocks.append((paper, i, text.title(), rng.choice(["text", "section_header"]), [i] * rng.randrange(8)))
        for t in range(60):
            base = rng.choice(blocks)[2].split(" ")
            kind = rng.randrange(5)
            cut = base[rng.randrange(len(base)) :] or base
            text = {0: " ".join(base), 1: " ".join(cut)[1:], 2: " ".join(rng.choice(words) if rng.random() < 0.3 else w for w in base), 3: " ".join([rng.choice(words), *base, rng.choice(words)]), 4: " ".join(rng.choices(words, weights, k=8))}[kind]
            targets.append((paper, t, text))
    return [*targets, ("p1", 900, ""), ("p1", 901, None), ("p3", 1, "alone"), ("p1", 902, targets[0][2])], [*blocks, ("p1", 800, "", "text", [1]), ("p1", 801, blocks[0][2], "text", [7])]


@pytest.mark.parametrize("heading", [False, True])
def test_layout_matches(spark, papers, heading):
    targets, blocks = papers
    t = spark.createDataFrame(targets, "paper_id string, t int, text string").repartition(3)
    b = spark.createDataFrame(blocks, "paper_id string, ord int, text string, label string, coords array<int>").repartition(3)
    got = {(r.paper_id, r.t): r.coords for r in canonical.layout_matches(t, b, heading).collect()}
    assert got == brute_layout(targets, blocks, heading)
    assert canonical.layout_matches(t.where("false"), b).count() == 0 == canonical.layout_matches(t, b.where("false")).count()


def test_pairs_that_meet_grow_with_the_rows(spark):
    """Blocks of words of their own and two that all have: all pairs would be n * n, here few meet."""
    for n in (100, 400):
        rows = [("p", i, f"the {' '.join(f'w{i}x{k}' for k in range(10))} of", "text") for i in range(n)]
        df = spark.createDataFrame(rows, "paper_id string, t int, text string, label string")
        items = [("p", r[1], r[2].split(" ")) for r in rows]
        left = spark.createDataFrame([(*r, len(r[2]) - 2 + 2, 2) for r in items], "paper_id string, a int, items array<string>, prefix int, need int")
        right = spark.createDataFrame([(*r, len(r[2])) for r in items], "paper_id string, b int, items array<string>, prefix int")
        assert simjoin.sharing(left.withColumn("prefix", left.prefix - 2), right, "paper_id").count() == n
        assert canonical.layout_pairs(df, df).where("direct = 1").count() == n


def test_paragraph_coverage(spark):
    rng = random.Random(9)
    letters = "abcdefgh " * 3 + "xyz"
    actual, expected = [], []
    for paper in ("p1", "p2"):
        for _ in range(120):
            actual.append((paper, "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 250])))))
        for i in range(120):
            chars = list(rng.choice(actual)[1])
            for _ in range(round(len(chars) * rng.choice([0, 0.1, 0.2, 0.25, 0.3, 0.5]))):
                at = rng.randrange(len(chars)) if chars else 0
                chars[at : at + rng.randrange(2)] = rng.choice(letters) if rng.random() < 0.6 else ""
            expected.append((paper, i, "".join(chars)))
    expected += [("p1", 900, ""), ("p1", 901, None), ("p3", 0, "abc"), ("p1", 902, "abc"), ("p2", 903, "ac")]
    actual += [("p1", "ac"), ("p2", "abc"), ("p1", ""), ("p2", None)]
    e = spark.createDataFrame(expected, "paper_id string, ord int, text string").repartition(3)
    a = spark.createDataFrame(actual, "paper_id string, text string").repartition(3)
    got = {r.paper_id: r.paragraphs for r in benchmark.paragraph_coverage(a, e).collect()}
    for paper in ("p1", "p2", "p3"):
        ys = {norm(y) for p, y in actual if p == paper} - {""}
        hits = [any(SequenceMatcher(None, y, norm(x)).ratio() >= 0.8 for y in ys) if norm(x) else False for p, _, x in expected if p == paper]
        assert got[paper] == pytest.approx(sum(hits) / len(hits)), paper
    met = benchmark.paragraph_pairs(e.selectExpr("paper_id", "lower(text) as x").where("x <> ''"), a.selectExpr("paper_id", "lower(text) as y").where("y <> ''")).count()
    assert 0 < met < 0.5 * 2 * 120 * 120
