"""Extraction-integrity metrics of papers, their score, status and issues, and the corpus report.

Inputs are long tables with paper_id: paragraphs(paper_id, ord, text, section), sections(paper_id, heading),
references(paper_id, title, raw), blocks(paper_id, coords), and texts per paper. Every metric is one
conditional aggregate, so all of them share a shuffle by paper_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import classify
from foliant.functions.text import clean, last_clean_word, length_score, let, normalize, numbers, strip, tokens

# Weights in the order of the report, and issue bounds in the order of issues.
WEIGHTS = {"coordinate_integrity": 0.03, "reference_integrity": 0.03, "abstract_integrity": 0.06, "duplication_integrity": 0.06, "contamination_integrity": 0.06, "numeric_consistency": 0.11, "structure_integrity": 0.13, "metadata_integrity": 0.14, "truncation_integrity": 0.16, "cross_parser_consistency": 0.22}
ISSUES = {"metadata_integrity": (0.75, "metadata_integrity_low"), "abstract_integrity": (0.75, "abstract_integrity_low"), "structure_integrity": (0.80, "structure_integrity_low"), "duplication_integrity": (0.90, "duplicate_text_detected"), "reference_integrity": (0.80, "reference_integrity_low"), "truncation_integrity": (0.85, "possible_truncation"), "numeric_consistency": (0.80, "numeric_consistency_low"), "cross_parser_consistency": (0.70, "cross_parser_disagreement"), "contamination_integrity": (0.85, "possible_contamination"), "coordinate_integrity": (0.90, "coordinate_integrity_low")}
HEALTHY, REVIEW = 0.85, 0.70
LOW_WEIGHT, HIGH_STD, FEW_PAPERS = 0.06, 0.02, 15


def is_truncated(text: Column) -> Column:
    return _truncated(clean(text))


def _truncated(c: Column) -> Column:
    ends = F.lit(False)
    for mark in classify.BAD_MARKS:
        ends = ends | c.endswith(mark)
    return ends | last_clean_word(c).isin(*classify.BAD_ENDINGS)


def is_contaminated(text: Column, repeats: Column) -> Column:
    """repeats: how often the paper has the normalised text."""
    return let(clean(text), lambda c: _contaminated(c, F.lower(c), repeats))


def _contaminated(c: Column, low: Column, repeats: Column) -> Column:
    return ((F.length(c) < 180) & (repeats >= 3)) | classify.lower_running_text(low) | classify.looks_like_email_block(c) | classify.clean_chart_text(c, low)


def paragraph_metrics(paragraphs: DataFrame, by: str = "paper_id") -> DataFrame:
    """duplication_integrity, truncation_integrity, contamination_integrity, orphan_paragraph_ratio by paper."""
    # texts are cleaned and put in lower case once
    cleaned = paragraphs.select(by, "section", clean("text").alias("c"))
    judged = lambda c: let(F.lower(c), lambda low: F.struct(c.alias("c"), low.alias("low"), _truncated(c).alias("truncated"), _contaminated(c, low, F.lit(0)).alias("bad")))
    rows = cleaned.select(by, "section", judged(F.col("c")).alias("j"))
    # a paper's equal texts are told apart by a digest, so the window's keys stay short
    marked = rows.select(by, "section", F.md5("j.low").alias("key"), F.length("j.low").alias("key_n"), F.length("j.c").alias("n"), "j.truncated", "j.bad")
    marked = marked.withColumn("repeats", F.count(F.when(F.col("n") >= 20, 1)).over(Window.partitionBy(by, "key")))
    share = lambda bad, of: F.coalesce(1 - F.sum(F.when(of, bad.cast("int"))) / F.count(F.when(of, 1)), F.lit(0.0))
    assigned = F.coalesce(F.col("section"), F.lit("")) != ""
    long = F.col("key_n") >= 40
    return marked.groupBy(by).agg(
        F.coalesce(F.count_distinct(F.when(long, F.col("key"))) / F.nullif(F.count(F.when(long, 1)), F.lit(0)), F.lit(0.0)).alias("duplication_integrity"),
        share(F.col("truncated"), F.col("n") >= 50).alias("truncation_integrity"),
        share(F.col("bad") | ((F.col("n") < 180) & (F.col("repeats") >= 3)), F.col("n") >= 20).alias("contamination_integrity"),
        F.avg((~assigned).cast("int")).alias("orphan_paragraph_ratio"),
    )


def metadata_integrity(title: Column, authors: Column, year: Column, doi: Column) -> Column:
    have = [F.coalesce(title != "", F.lit(False)), F.coalesce(F.size(authors) > 0, F.lit(False)), F.coalesce(year != 0, F.lit(False)), F.coalesce(doi != "", F.lit(False))]
    return sum((h.cast("int") for h in have), F.lit(0)) / 4


def structure_integrity(sections: DataFrame, paragraphs: DataFrame, by: str = "paper_id") -> DataFrame:
    valid = sections.groupBy(by).agg(F.avg((~classify.is_bad_heading(F.col("heading"))).cast("int")).alias("valid"))
    assigned = paragraphs.groupBy(by).agg(F.avg((F.coalesce(F.col("section"), F.lit("")) != "").cast("int")).alias("assigned"))
    score = F.when(F.col("valid").isNull() | F.col("assigned").isNull(), 0.0).otherwise(0.6 * F.col("valid") + 0.4 * F.col("assigned"))
    return valid.join(assigned, by, "full").select(by, score.alias("structure_integrity"))


def reference_integrity(references: DataFrame, by: str = "paper_id") -> DataFrame:
    """Share of references whose text has 20 characters or more."""
    listed = F.when(F.size("authors") > 0, F.concat(F.lit("['"), F.array_join("authors", "', '"), F.lit("']"))) if "authors" in references.columns else F.lit(None)
    text = clean(F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("raw"), F.lit("")), listed))
    return references.groupBy(by).agg(F.avg((F.length(text) >= 20).cast("int")).alias("reference_integrity"))


def coordinate_integrity(blocks: DataFrame, by: str = "paper_id") -> DataFrame:
    """Share of blocks with a valid coordinate record in the array coords."""
    return blocks.groupBy(by).agg(F.avg(F.coalesce(F.exists("coords", classify.valid_coord), F.lit(False)).cast("int")).alias("coordinate_integrity"))


def counted(df: DataFrame, by: str, items: Column, name: str) -> DataFrame:
    return df.select(by, F.explode(items).alias("item")).groupBy(by, "item").agg(F.count("*").alias(name))


def counted_both(df: DataFrame, by: str, left: Column, right: Column) -> DataFrame:
    """(by, item, a, b): how often each item of two lists is in the left and in the right one, counted in one pass without a join. Two
    equal lists are one row without an item, as each of their items is in both as often: a and b are their sizes."""
    tagged = lambda items, a: F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")))
    one = lambda x: F.array(F.struct(F.lit(None).cast("string").alias("item"), F.size(x).alias("a"), F.size(x).alias("b")))
    told = lambda p: F.when(p["x"] == p["y"], one(p["x"])).otherwise(F.concat(tagged(p["x"], 1), tagged(p["y"], 0)))
    rows = df.select(by, F.explode(let(F.struct(left.alias("x"), right.alias("y")), told)).alias("_i")).select(by, "_i.*")
    return rows.groupBy(by, "item").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def numeric_consistency(pairs: DataFrame, by: str = "paper_id") -> DataFrame:
    """Of pairs(by, tei, pdf): share of the TEI's numbers, with repeats, that the PDF text has too.

    0 if a text is empty, 0.5 if the TEI has no number.
    """
    both = counted_both(pairs, by, numbers("tei"), numbers(F.lower("pdf")))
    hit = both.groupBy(by).agg((F.sum(F.least("a", "b")) / F.nullif(F.sum("a"), F.lit(0))).alias("hit"))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    empty = blank("tei") | blank("pdf")
    return pairs.join(hit, by, "left").select(by, F.when(empty, 0.0).otherwise(F.coalesce("hit", F.lit(0.5))).alias("numeric_consistency"))


def cross_parser_consistency(pairs: DataFrame, by: str = "paper_id") -> DataFrame:
    """Multiset token F1 of the two texts; 0 if either has no token."""
    both = counted_both(pairs, by, tokens("tei"), tokens("pdf")).groupBy(by).agg(F.sum(F.least("a", "b")).alias("o"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    f1 = 2 * F.col("o") / F.nullif(F.col("a") + F.col("b"), F.lit(0))
    return pairs.select(by).join(both, by, "left").select(by, F.coalesce(f1, F.lit(0.0)).alias("cross_parser_consistency"))


def covered(counts: DataFrame, known: DataFrame, by: str, on: tuple[str, ...]) -> DataFrame:
    """(by, coverage, n_tokens) of counts(by, item, n): the share of items, with repeats, that known has. on: the columns
    that known, distinct in them, is told apart by."""
    found = counts.join(known.select(*on, F.lit(1).alias("in")), list(on), "left").groupBy(by)
    return found.agg((F.sum(F.when(F.col("in") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"), F.sum("n").alias("n_tokens"))


def coverage(pairs: DataFrame, source: str, target: str, by: str) -> DataFrame:
    """Share of the source's tokens, with repeats, that occur in the target; 0 without any."""
    both = counted_both(pairs, by, tokens(source), tokens(target))
    hit = both.groupBy(by).agg((F.sum(F.when(F.col("b") > 0, F.col("a")).otherwise(0)) / F.nullif(F.sum("a"), F.lit(0))).alias("coverage"))
    return pairs.select(by).join(hit, by, "left").select(by, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def abstract_integrity(pairs: DataFrame, by: str = "paper_id") -> DataFrame:
    """Of pairs(by, abstract, pdf): 1 if contained, else coverage; by length alone without a PDF text."""
    a, p = normalize("abstract"), normalize("pdf")
    known = F.when(a == "", 0.0).when(p == "", length_score(F.length(clean("abstract")))).when(p.contains(a), 1.0)
    scored = pairs.select(by, "abstract", "pdf", known.alias("known"))
    # words are counted only where the coverage is asked for
    text = lambda c: F.when(F.col("known").isNull(), F.col(c)).otherwise("").alias(c)
    open_ = coverage(scored.select(by, text("abstract"), text("pdf")), "abstract", "pdf", by)
    return scored.select(by, "known").join(open_, by).select(by, F.coalesce("known", "coverage").alias("abstract_integrity"))


def integrity_score(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the metric columns; weights of a part of the metrics are scaled up to 1."""
    total = sum(weights.values())
    return sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0)) / total


def status(score: Column) -> Column:
    return F.when(score >= HEALTHY, "healthy").when(score >= REVIEW, "review").otherwise("poor")


def issues(metrics: tuple[str, ...] = tuple(ISSUES)) -> Column:
    flags = [F.when(F.col(m) < ISSUES[m][0], ISSUES[m][1]) for m in ISSUES if m in metrics]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def report(metrics: DataFrame, names: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """metrics with integrity_score (4 places), status and issues, both by the unrounded values."""
    weights = {m: WEIGHTS[m] for m in names}
    scored = metrics.withColumn("integrity_score", integrity_score(weights))
    return scored.withColumns({"status": status(F.col("integrity_score")), "issues": issues(names)}).withColumn("integrity_score", F.round("integrity_score", 4))


def _listed(records: DataFrame, by: str, items: str, *fields: str) -> DataFrame:
    """(by, ord, fields) of an array of structs."""
    return records.select(by, F.posexplode(items).alias("ord", "_r")).select(by, "ord", *[F.col(f"_r.{f}").alias(f) for f in fields])


def body_text(abstract: Column, paragraphs: Column) -> Column:
    """The abstract and the paragraphs' texts (an array of structs), stripped, by line; empty ones go."""
    texts = F.concat(F.array(abstract), F.coalesce(F.transform(paragraphs, lambda p: p["text"]), F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(texts, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != ""), "\n")


def evaluate(records: DataFrame, by: str = "paper_id") -> DataFrame:
    """The quality report of each of records(by, tei, pdf_text, artifacts): integrity_score, status, issues, the ten metrics,
    orphan_paragraph_ratio, artifact_counts and extraction_counts, rounded to 4 places.

    tei is a struct as parsed_tei() gives it, artifacts one of the arrays that layout_artifacts() gives. A list that is null
    or empty makes its metric 0 (orphan_paragraph_ratio 1); ids are taken to be distinct.
    """
    pairs = records.select(by, body_text(F.col("tei.abstract"), F.col("tei.paragraphs")).alias("tei"), F.coalesce("tei.abstract", F.lit("")).alias("abstract"), F.coalesce("pdf_text", F.lit("")).alias("pdf"))
    paragraphs = _listed(records, by, "tei.paragraphs", "text", "section")
    sections = _listed(records, by, "tei.sections", "heading")
    references = _listed(records, by, "tei.references", "title", "authors", "raw")
    blocks = _listed(records, by, "artifacts.text_blocks", "coords")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    kind = F.col("tei.figures")
    own = records.select(
        by,
        metadata_integrity(F.col("tei.title"), F.col("tei.authors"), F.col("tei.year"), F.col("tei.doi")).alias("metadata_integrity"),
        F.struct(*[size(F.col(f"artifacts.{c}")).alias(c) for c in ("figures", "tables", "formulas", "text_blocks")]).alias("artifact_counts"),
        F.struct(
            *[size(F.col(f"tei.{c}")).alias(c) for c in ("sections", "paragraphs", "references")],
            F.when(kind.isNull(), 0).otherwise(F.size(F.filter(kind, lambda f: f["type"] != "table"))).alias("figures"),
            F.when(kind.isNull(), 0).otherwise(F.size(F.filter(kind, lambda f: f["type"] == "table"))).alias("tables"),
            size(F.col("artifacts.formulas")).alias("formulas"),
        ).alias("extraction_counts"),
    )
    found = [paragraph_metrics(paragraphs, by), structure_integrity(sections, paragraphs, by), reference_integrity(references, by), coordinate_integrity(blocks, by), numeric_consistency(pairs.select(by, "tei", "pdf"), by), cross_parser_consistency(pairs.select(by, "tei", "pdf"), by), abstract_integrity(pairs.select(by, "abstract", "pdf"), by)]
    for table in found:
        own = own.join(table, by, "left")
    own = own.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in WEIGHTS} | {"orphan_paragraph_ratio": F.coalesce("orphan_paragraph_ratio", F.lit(1.0))})
    return report(own).withColumns({m: F.round(m, 4) for m in (*WEIGHTS, "orphan_paragraph_ratio")})


def variance_report(metrics: DataFrame, by: str = "paper_id", names: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """metric, weight, mean, population std, min, worst paper, n, flagged, few: a row for each metric, by weight."""
    long = metrics.unpivot([by], list(names), "metric", "value").where("value is not null")
    order = F.create_map(*[F.lit(x) for i, m in enumerate(WEIGHTS) for x in (m, i)])
    weight = F.create_map(*[F.lit(x) for m, w in WEIGHTS.items() for x in (m, w)])
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.min_by(by, F.struct("value", by)).alias("worst"), F.count("*").alias("n"))
    out = out.withColumn("weight", weight[F.col("metric")])
    out = out.withColumns({"flagged": (F.col("weight") <= LOW_WEIGHT) & (F.col("std") > HIGH_STD), "few": F.col("n") < FEW_PAPERS})
    return out.orderBy("weight", order[F.col("metric")])
