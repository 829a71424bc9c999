"""Accuracy of a canonical document against ground truth."""

from __future__ import annotations

from collections import Counter, deque
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.similarity import ratio, ratio_bound
from foliant.functions.text import doi_key, normalize
from foliant.operators import simjoin
from foliant.plans.scratch import materialize

# Match bounds and the weights of the overall score.
TEXT_MATCH, FORMULA_MATCH, PARAGRAPH_MATCH = 0.85, 0.75, 0.80
#: Texts of up to so many characters may be alike without two neighbours in common.
TINY = 3
#: Classes of characters by which items of lists are told apart first, and what rounding may move a bound by.
CLASSES, SLACK = 128, 1e-6
#: Texts' counts that are kept for the next pairs.
KEPT_COUNTS = 1000
WEIGHTS = {"metadata": 0.20, "sections": 0.15, "paragraphs": 0.20, "formulas": 0.15, "references": 0.10, "tables": 0.05, "figures": 0.05, "abstract": 0.10}


def similarity(a: Column, b: Column) -> Column:
    return ratio(normalize(a), normalize(b))


def reference_text(s: Column) -> Column:
    """A reference's title, authors, year and doi, those that it has, with spaces between."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.concat_ws(" ", some(s["title"]), some(F.array_join(s["authors"], " ")), F.when(s["year"] != 0, s["year"].cast("string")), some(s["doi"]))


def reference_score(actual: Column, expected: Column) -> Column:
    """F1 of two lists of references, by the text of each."""
    sides = [F.transform(c, lambda s: normalize(reference_text(s))) for c in (actual, expected)]
    return list_f1()(*sides)["f1"]


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def count_score(actual: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.greatest(F.lit(0.0), 1 - F.abs(actual - expected) / expected)).otherwise(0.0)


def counted_classes(items: list[str | None]) -> np.ndarray:
    """A row for each text: how many of its characters are in each of CLASSES classes. No two texts have more characters in common than
    their rows have, so a bound on these is one on their ratio."""
    data = np.frombuffer("".join(x or "" for x in items).encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
    row = np.repeat(np.arange(len(items)), [len(x or "") for x in items])
    return np.bincount(row * CLASSES + data, minlength=len(items) * CLASSES).reshape(len(items), CLASSES).astype(np.int32)


def list_f1(bound: float = TEXT_MATCH):  # noqa: ANN201
    """A function of two columns array<string> (normalised): struct matched, precision, recall, f1.

    Each actual item in order takes the best expected one that is free and at least `bound` alike.
    """

    @F.pandas_udf("matched int, precision double, recall double, f1 double")
    def run(actual: pd.Series, expected: pd.Series) -> pd.DataFrame:
        out = []
        for xs, ys in zip(actual, expected, strict=True):
            xs, ys = list(xs) if xs is not None else [], list(ys) if ys is not None else []
            free, matched = np.ones(len(ys), bool), 0
            # equal items are found by value, the places of each in order; of the others, only those whose counts allow the bound
            places: dict[str, deque[int]] = {}
            for j, y in enumerate(ys):
                if y:
                    places.setdefault(y, deque()).append(j)
            counts, size = counted_classes(ys), np.array([len(y or "") for y in ys], np.int64)
            matchers: dict[int, SequenceMatcher] = {}
            wanted = counted_classes(xs)
            for i, x in enumerate(xs):
                if not x:
                    continue
                best, at = 0.0, -1
                same = places.get(x)
                while same and not free[same[0]]:
                    same.popleft()
                if same:
                    best, at = 1.0, same[0]
                elif len(ys):
                    near = np.flatnonzero(free & (size > 0) & (2 * np.minimum(size, len(x)) >= bound * (size + len(x)) - SLACK))
                    common = np.minimum(counts[near], wanted[i]).sum(1)
                    for j in near[2 * common >= bound * (size[near] + len(x)) - SLACK].tolist():
                        m = matchers.setdefault(j, SequenceMatcher(None, "", ys[j]))
                        m.set_seq1(x)
                        if m.quick_ratio() >= max(best, bound):
                            s = m.ratio()
                            if s > best:
                                best, at = s, j
                if best >= bound:
                    free[at] = False
                    matched += 1
            p = matched / len(xs) if xs else 0.0
            r = matched / len(ys) if ys else 0.0
            out.append((matched, p, r, 2 * p * r / (p + r) if p + r else 0.0))
        return pd.DataFrame(out, columns=["matched", "precision", "recall", "f1"])

    return run


def paragraph_pairs(expected: DataFrame, actual: DataFrame, by: str = "paper_id") -> DataFrame:
    """(by, x, y): distinct texts of expected(by, x) and actual(by, y) whose ratio may be PARAGRAPH_MATCH or more.

    A ratio of 0.8 needs 0.4 T matching characters of T in both. What doesn't match, at most 0.2 T, parts the rest into at
    most 0.2 T + 1 runs, so the two share 0.2 T - 1 pairs of neighbours, counted with repeats, or more; as one is at most half as long again as the
    other, that is at least a third of either one's length less one. So they meet at the rarest pairs of neighbours, all but that
    many (simjoin.sharing); texts of up to three characters at single ones. Then all of both are counted. In papers of few pairs
    all of like length are counted at once.
    """
    side = lambda rows, c: materialize(rows.select(by, c).where(F.col(c) != "").repartition(by).distinct(), "texts")
    few, many = simjoin.few_and_many(side(expected, "x"), side(actual, "y"), by)
    x, y, common = F.col("x"), F.col("y"), F.col("common")
    total = F.length(x) + F.length(y)
    counted = few[0].join(few[1], by).where(ratio_bound(x, y) >= PARAGRAPH_MATCH).withColumn("common", common_runs(x, y))
    pairs = counted.where((5 * common["ones"] >= 2 * total) & (5 * common["twos"] >= total - 5)).select(by, "x", "y")
    return pairs.unionByName(_alike(*many, by)) if many else pairs


@F.pandas_udf(T.StructType([T.StructField("ones", T.IntegerType()), T.StructField("twos", T.IntegerType())]))
def common_runs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many characters and pairs of neighbours two texts have in common, counted with repeats."""
    counts: dict[tuple[str, int], Counter] = {}

    def of(t: str, n: int) -> Counter:
        if (t, n) not in counts:
            if len(counts) >= KEPT_COUNTS:
                counts.clear()
            counts[t, n] = Counter(t if n == 1 else map(str.__add__, t, t[1:]))
        return counts[t, n]

    def common(s: str, t: str, n: int) -> int:
        u, v = of(s, n), of(t, n)
        return sum(min(u[k], v[k]) for k in u.keys() & v.keys())

    return pd.DataFrame([(common(s, t, 1), common(s, t, 2)) for s, t in zip(a, b, strict=True)], columns=["ones", "twos"])


def _alike(expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """paragraph_pairs() by filters."""

    def texts(rows: DataFrame, key: str, c: str) -> DataFrame:
        rows = rows.select(by, F.xxhash64(c).alias(key), F.col(c).alias("text"))
        grams = [simjoin.numbered_grams(rows, n, by, key).withColumnRenamed("items", f"{c}{n}") for n in (1, 2)]
        none = F.array().cast("array<string>")
        joined = rows.join(grams[0], [by, key]).join(grams[1], [by, key], "left")
        return materialize(joined.select(by, key, F.col("text").alias(c), f"{c}1", F.coalesce(f"{c}2", none).alias(f"{c}2")), "grams")

    def items(rows: DataFrame, key: str, c: str, size: int) -> DataFrame:
        rows = rows.where(F.length(c) > TINY) if size == 2 else rows.where(F.length(c) <= 2 * TINY)
        least = F.greatest(F.lit(1), F.expr(f"(length({c}) - 1) div 3").cast("int")) if size == 2 else F.lit(1)
        return rows.select(by, key, F.col(f"{c}{size}").alias("items"), (F.size(f"{c}{size}") - least + 1).alias("prefix"), F.lit(1).alias("need"))

    left, right = texts(expected, "a", "x"), texts(actual, "b", "y")
    met = reduce(DataFrame.unionByName, [simjoin.sharing(items(left, "a", "x", n), items(right, "b", "y", n), by) for n in (2, 1)])
    pairs = met.distinct().join(left, [by, "a"]).join(right, [by, "b"])
    x, y = F.col("x"), F.col("y")
    total = F.length(x) + F.length(y)
    common = lambda n: F.size(F.array_intersect(f"x{n}", f"y{n}"))
    pairs = pairs.where(ratio_bound(x, y) >= PARAGRAPH_MATCH)
    return pairs.where((5 * common(1) >= 2 * total) & (5 * common(2) >= total - 5)).select(by, "x", "y")


def paragraph_coverage(actual: DataFrame, expected: DataFrame, by: str = "paper_id") -> DataFrame:
    """Share of expected(by, ord, text) with an actual(by, text) paragraph at least PARAGRAPH_MATCH alike.

    Equal texts are settled by a join; of the others only paragraph_pairs() reach the ratio. Empty texts match nothing; a paper
    without expected paragraphs has no row.
    """
    e = expected.select(by, F.col("ord").alias("e"), normalize("text").alias("x"))
    a = actual.select(by, normalize("text").alias("y")).where("y <> ''").distinct()
    texts = e.select(by, "x").where("x <> ''").distinct()
    same = texts.join(a.withColumnRenamed("y", "x"), [by, "x"], "left_semi")
    open_ = texts.join(same, [by, "x"], "left_anti")
    near = paragraph_pairs(open_, a, by).where(ratio("y", "x") >= PARAGRAPH_MATCH).select(by, "x").distinct()
    hit = same.unionByName(near).withColumn("hit", F.lit(1))
    return e.join(hit, [by, "x"], "left").groupBy(by).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("paragraphs"))


def metadata_score(author_f1: Column) -> Column:
    """Of columns title, year, doi and their expected_ forms."""
    title = similarity(F.col("title"), F.col("expected_title"))
    year = F.col("year").eqNullSafe(F.col("expected_year")).cast("int")
    expected = doi_key("expected_doi")
    doi = F.coalesce((expected != "") & (doi_key("doi") == expected), F.lit(False)).cast("int")
    return (title + year + doi + author_f1) / 4


def overall() -> Column:
    return sum((F.col(m) * w for m, w in WEIGHTS.items()), F.lit(0.0))


