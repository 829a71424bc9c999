"""Queries over the driver's tables, one for each operator family, and their SQL equivalents.

A document's lines stand for the paragraphs of a paper; a page's visible text and its article's text stand for
two parsers of one paper.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import classify, text
from foliant.functions.similarity import token_overlap, without_near_sentences
from foliant.functions.text import block_key, block_text, clean, let, normalize, numbers, sentence_key, sentences, tokens, without_publisher_text
from foliant.operators import benchmark, canonical, chunk, cleaner, dedup, layout, quality, regions
from foliant.operators.regions import carry_forward, folded_references
from foliant.plans import outcomes, papers
from foliant.sources import files, service, sinks
from foliant.sources.tables import read_dealt
from foliant.sources.tables import read_spread as read_table

METRICS = ("duplication_integrity", "contamination_integrity", "truncation_integrity")


def _paragraphs(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """(doc_id, ord, text, section): lines of documents, which may be dealt by id for what groups them."""
    docs = (read_dealt(spark, d, "documents", "doc_id") if dealt else read_table(spark, d, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return docs.withColumn("section", F.lit(None).cast("string"))


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    """First document of each text, by id, numbered on."""
    docs = read_table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("file_hash"))
    return dedup.first_wins(docs, ["file_hash"], ["doc_id"])


def line_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    out = layout.distinct_blocks(_paragraphs(spark, d), ("doc_id",))
    return out.select("doc_id", "ord", block_key("text").alias("key"))


def paragraph_integrity(spark: SparkSession, d: str) -> DataFrame:
    out = quality.paragraph_metrics(_paragraphs(spark, d), "doc_id")
    return out.select("doc_id", *[F.round(m, 6).alias(m) for m in METRICS], "orphan_paragraph_ratio")


def header_footer_filter(spark: SparkSession, d: str) -> DataFrame:
    return layout.without_headers(_paragraphs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    return layout.audit_stats(read_table(spark, d, "documents")).select("doc_id", "characters", "words", "numbers")


def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", F.explode(numbers("text")).alias("number"))
    return rows.groupBy("doc_id", "number").agg(F.count("*").alias("n"))


def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, tei, pdf): text of a page's paragraphs, and of the whole page."""
    html = F.col("html")
    strip_tags = lambda c: clean(F.regexp_replace(c, r"<[^>]*>", " "))
    paragraphs = F.array_join(F.regexp_extract_all(html, F.lit(r"<p>([^<]*)"), F.lit(1)), "\n")
    return read_table(spark, d, "pages").select("page_id", clean(paragraphs).alias("tei"), strip_tags(html).alias("pdf"))


def page_numeric_consistency(spark: SparkSession, d: str) -> DataFrame:
    out = quality.numeric_consistency(_page_pairs(spark, d), "page_id")
    return out.select("page_id", F.round("numeric_consistency", 6).alias("numeric_consistency"))


def page_token_f1(spark: SparkSession, d: str) -> DataFrame:
    out = quality.cross_parser_consistency(_page_pairs(spark, d), "page_id")
    return out.select("page_id", F.round("cross_parser_consistency", 6).alias("cross_parser_consistency"))


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A page's title, heading as author, language, and no year."""
    pages = read_table(spark, d, "pages")
    pick = lambda p: clean(F.regexp_extract("html", p, 1))
    out = pages.select("page_id", pick("<title>([^<]*)</title>").alias("title"), pick("<h1>([^<]*)</h1>").alias("heading"), pick('<html lang="([^"]*)"').alias("lang"))
    authors = F.filter(F.array("heading"), lambda x: x != "")
    return out.withColumn("completeness", quality.metadata_integrity(F.col("title"), authors, F.lit(0), F.col("lang")))


def publisher_text_truncation(spark: SparkSession, d: str) -> DataFrame:
    cut = without_publisher_text("text")
    rows = _paragraphs(spark, d).select("doc_id", F.length("text").alias("n"), F.length(cut).alias("left"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_chars"), F.sum("left").alias("n_left"))


def author_and_person_filters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _paragraphs(spark, d).groupBy("doc_id").agg(
        F.count_if(classify.looks_like_author_block(c)).alias("author_blocks"),
        F.count_if(classify.looks_like_affiliation(c)).alias("affiliations"),
        F.count_if(classify.looks_like_body_sentence(c)).alias("body_sentences"),
        F.count_if(classify.is_caption(c)).alias("captions"),
        F.count_if(classify.is_reference(c)).alias("numbered"),
        F.count_if(classify.is_keywords(c)).alias("keywords"),
    )


def heading_filters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _paragraphs(spark, d).groupBy("doc_id").agg(F.count_if(classify.is_garbage_heading(c)).alias("garbage"), F.count_if(classify.is_bad_heading(c)).alias("bad"), F.count_if(classify.is_major_section(c)).alias("major"))


def conversation_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last user text at each turn."""
    rows = read_table(spark, d, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.col("text")))
    out = carry_forward(rows, "asked", "conv_id", "turn")
    return out.select("conv_id", "turn", "role", "asked")


def section_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents; a line of up to 60 characters opens one, and is numbered by its place."""
    rows = _paragraphs(spark, d)
    numbered = let(clean("text"), lambda c: F.when((F.length("text") <= 60) & (c != ""), F.concat(F.col("ord") + 1, F.lit(". "), c)).otherwise(c))
    out = chunk.sections(rows.select("doc_id", "ord", numbered.alias("line")), "doc_id")
    return out.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section", F.length("text").alias("n_chars"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Score, status and issues by the three metrics that a plain text has, weights scaled up to 1."""
    metrics = quality.paragraph_metrics(_paragraphs(spark, d), "doc_id").drop("orphan_paragraph_ratio")
    labels = read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    out = quality.report(metrics, METRICS).join(labels, "doc_id", "left")
    return out.select("doc_id", *[F.round(m, 6).alias(m) for m in METRICS], "integrity_score", "status", F.array_join("issues", ",").alias("issues"), "label")


def metric_variance_report(spark: SparkSession, d: str) -> DataFrame:
    metrics = quality.paragraph_metrics(_paragraphs(spark, d), "doc_id")
    out = quality.variance_report(metrics, "doc_id", METRICS)
    return out.select("metric", "weight", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("min", 6).alias("min"), "worst", "n", "flagged", "few")


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Papers by outcome of the report."""
    outcomes = quality_report(spark, d).select(F.col("status").alias("outcome"))
    return sinks.outcome_counts(outcomes).select(F.col("outcome").alias("status"), F.col("count").alias("n"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", F.posexplode(sentences("text")).alias("ord", "sentence"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("n_chars"), F.max(F.length("sentence")).alias("longest"))


def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    body = read_table(spark, d, "documents").select("doc_id", F.lit(0).alias("section_no"), F.lit("Introduction").alias("section"), "text")
    none = body.select("doc_id", F.lit("").alias("abstract")).where("false")
    out = chunk.chunks(none, body, "doc_id")
    return out.select("doc_id", "chunk_id", "section", "page_no", F.sha2(F.col("text"), 256).alias("text_sha256"))


def near_duplicate_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.length(without_near_sentences("text")).alias("n_left"))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    once = let(clean("text"), lambda c: F.struct(F.md5(c).alias("cleaned"), F.md5(F.lower(c)).alias("normalized")))
    rows = docs.select("doc_id", once.alias("c"), F.md5(block_text("text")).alias("block"), F.md5(sentence_key(F.col("text"))).alias("sentence_key"))
    return rows.select("doc_id", "c.*", "block", "sentence_key")


def benchmark_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each benchmark item's tokens, with repeats, that the corpus has."""
    items = quality.counted(read_table(spark, d, "benchmark"), "item_id", tokens("text"), "n")
    known = read_table(spark, d, "documents").select(F.explode(tokens("text")).alias("item")).distinct()
    out = quality.covered(items, known, "item_id", ("item",))
    return out.select("item_id", F.round("coverage", 6).alias("coverage"), "n_tokens")


def greedy_list_f1(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each page's whole text against those of its paragraphs."""
    pairs = _page_pairs(spark, d)
    sides = [F.transform(sentences(c), normalize) for c in ("pdf", "tei")]
    return pairs.select("page_id", benchmark.list_f1()(*sides).alias("m")).select("page_id", "m.*")


def reference_folding(spark: SparkSession, d: str) -> DataFrame:
    """Numbered turns of conversations as a reference list."""
    turns = read_table(spark, d, "conversations")
    body = turns.select("conv_id", (F.col("turn") + 1).alias("ord"), F.when(F.col("role") == "user", F.concat(F.col("turn") + 1, F.lit(") "), F.col("text"))).otherwise(F.col("text")).alias("line"))
    heads = turns.select("conv_id", F.lit(0).cast("long").alias("ord"), F.lit("References").alias("line")).distinct()
    out = folded_references(heads.unionByName(body), "conv_id")
    return out.select("conv_id", "ref_no", F.md5("reference").alias("reference_md5"))


def layout_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks at made-up places of a page of two columns: their turns in column and in page order."""
    n = F.length("text")
    rows = _paragraphs(spark, d).select("doc_id", "ord", (n % 600).cast("double").alias("x0"), (n * 7 % 90).cast("double").alias("y0"), (F.col("ord") % 3 + 1).alias("page_no"))
    turn = lambda keys: F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys))
    placed = rows.withColumns({"in_columns": turn(layout.column_order(F.lit(600.0))), "in_pages": turn(layout.page_order())})
    return placed.select("doc_id", "ord", "in_columns", "in_pages")


def font_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words as spans with made-up sizes and flags: blocks by way of lines, and the body's size."""
    words = _paragraphs(spark, d, dealt=True).select("doc_id", (F.expr("ord div 4")).alias("block_no"), F.col("ord").alias("line_no"), F.posexplode(F.split("text", " ")).alias("span_no", "text"))
    size = (8 + (F.col("line_no") + F.col("span_no")) % 5 * 0.55).cast("double")
    spans = words.withColumns({"page_no": F.lit(1), "size": size, "flags": F.col("span_no") * 8}).withColumn("text", F.concat("text", F.lit(" ")))
    by = ("doc_id", "page_no", "block_no")
    lines = layout.spans_to_lines(spans, (*by, "line_no"))
    blocks = layout.lines_to_blocks(lines, by).join(layout.body_font_size(lines, "doc_id"), "doc_id")
    return blocks.select("doc_id", "block_no", F.md5("text").alias("text_md5"), F.round("font_size", 1).alias("font_size"), "is_bold", F.round("body_font_size", 3).alias("body_font_size"))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks of made-up places on pages of seven: each document's text, without headers and repeats, in reading order."""
    o, n = F.col("ord"), F.length("text")
    rows = _paragraphs(spark, d).select("doc_id", "ord", "text", F.expr("ord div 7 + 1").alias("page_no"), (n % 6 * 90).cast("double").alias("x0"), (60 + o * 37 % 11 * 60).cast("double").alias("y0"))
    blocks = rows.withColumns({"x1": F.col("x0") + 80, "y1": F.col("y0") + 20})
    out = layout.paper_texts(layout.page_texts(blocks, "doc_id"), "doc_id")
    return out.select("doc_id", "num_pages", F.md5("text").alias("text_md5"))


def coordinate_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks, each with a made-up coordinate record whose keys have either names."""
    o, n = F.col("ord"), F.length("text")
    text = lambda c: c.cast("string")
    one = F.create_map(F.lit("page"), F.when(o % 7 != 0, text(o % 3 + 1)), F.lit("x"), text(n % 11 - 1), F.lit("y"), text(o), F.lit("w"), text(n % 5), F.lit("h"), text(o % 4))
    two = F.create_map(F.lit("page_no"), text(o % 3 + 1), F.lit("x"), text(n % 11), F.lit("y"), text(o), F.lit("width"), text(n % 3), F.lit("height"), F.lit("2.5"))
    rows = _paragraphs(spark, d).select("doc_id", F.array(classify.coord_record(F.when(o % 2 == 0, one).otherwise(two))).alias("coords"))
    out = quality.coordinate_integrity(rows, "doc_id")
    return out.select("doc_id", F.round("coordinate_integrity", 6).alias("coordinate_integrity"))


def reference_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Lines as references: some as title, some as raw text, the source as an author."""
    o, t = F.col("ord"), F.col("text")
    docs = read_table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    rows = docs.select("doc_id", F.when(o % 2 == 0, t).alias("title"), F.when(o % 5 == 1, t).alias("raw"), F.when(o % 3 == 0, F.array("source", "source")).alias("authors"))
    out = quality.reference_integrity(rows, "doc_id")
    return out.select("doc_id", F.round("reference_integrity", 6).alias("reference_integrity"))


def structure_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line as a heading; the others as paragraphs, some with a section."""
    rows, o = _paragraphs(spark, d), F.col("ord")
    sections = rows.where(o % 5 == 0).select("doc_id", F.col("text").alias("heading"))
    paragraphs = rows.where(o % 5 != 0).select("doc_id", F.when(o % 4 == 0, F.lit("Methods")).when(o % 4 == 1, F.lit("")).alias("section"))
    out = quality.structure_integrity(sections, paragraphs, "doc_id")
    return out.select("doc_id", F.round("structure_integrity", 6).alias("structure_integrity"))


def abstract_integrity(spark: SparkSession, d: str) -> DataFrame:
    """A page's text as abstract, in its other text or, for some pages, in that without vowels or none."""
    p = F.col("page_id")
    abstract = F.when(p % 5 == 4, F.lit("")).otherwise(F.col("tei"))
    pdf = F.when(p % 5 == 0, F.lit("")).when(p % 5 == 1, F.regexp_replace("pdf", "[aeiou]", "")).otherwise(F.col("pdf"))
    out = quality.abstract_integrity(_page_pairs(spark, d).select("page_id", abstract.alias("abstract"), pdf.alias("pdf")), "page_id")
    return out.select("page_id", F.round("abstract_integrity", 6).alias("abstract_integrity"))


def abstract_regions(spark: SparkSession, d: str) -> DataFrame:
    """Lines as paragraphs of made-up sections: those from the first abstract to the next major section."""
    rows, o = _paragraphs(spark, d), F.col("ord")
    named = rows.withColumn("section", F.when(o % 7 == 2, F.lit(" Abstract")).when(o % 7 == 5, F.lit("Results")).when(o % 7 == 4, F.lit("Other")))
    out = regions.abstract_region(named, "doc_id")
    return out.select("doc_id", F.md5("abstract").alias("abstract_md5"))


def artifact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines as formulas, references, headings and figures: what is left of each by first wins."""
    rows = _paragraphs(spark, d).withColumn("page", F.col("ord") % 3)
    o, t = F.col("ord"), F.col("text")
    formulas = canonical.formulas(rows.select("doc_id", "ord", "page", t.alias("text")), "doc_id")
    references = canonical.references(rows.select("doc_id", "ord", t.alias("title"), F.when(o % 2 == 0, t).alias("raw")), "doc_id")
    sections = canonical.sections(rows.where(F.length(t) <= 60).select("doc_id", "ord", t.alias("heading")), "doc_id")
    figures = canonical.artifacts(rows.select("doc_id", "ord", "page", F.lit("figure").alias("type"), t.alias("label"), F.lit("").alias("caption")), "doc_id")
    kept = [f.select("doc_id", "ord", F.lit(k).alias("kind"), name.alias("name")) for k, f, name in (("formula", formulas, F.col("formula_id")), ("reference", references, F.lit("")), ("section", sections, F.lit("")), ("figure", figures, F.lit("")))]
    return reduce(DataFrame.unionByName, kept)


def canonical_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines as paragraphs under short lines as headings, some of them without a section: carried forward, first wins."""
    rows = _paragraphs(spark, d)
    kept = canonical.sections(rows.where(F.length("text") <= 60).select("doc_id", "ord", F.col("text").alias("heading")), "doc_id")
    section = F.when(F.length("text") <= 60, F.concat(F.lit(" "), F.col("text"))).when(F.col("ord") % 3 == 0, F.lit("Else"))
    raw = rows.select("doc_id", "ord", "text", section.alias("section"), (F.col("ord") % 2).alias("page"))
    abstract = rows.where("ord = 0").select("doc_id", F.col("text").alias("abstract"))
    out = canonical.paragraphs(raw, kept, abstract, "doc_id")
    return out.select("doc_id", "ord", F.md5("text").alias("text_md5"), "section")


def title_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first lines that can be a title by two rules."""
    nodes = _paragraphs(spark, d)
    a, b = (regions.first_title(nodes, rule, "doc_id") for rule in (classify.is_sane_title, classify.is_title_candidate))
    return a.join(b.select("doc_id", F.col("title_ord").alias("candidate_ord")), "doc_id", "full").select("doc_id", F.md5("title").alias("title_md5"), "title_ord", "candidate_ord")


def front_authors(spark: SparkSession, d: str) -> DataFrame:
    """Names at the beginning of documents: some made ones before the second line, and what that line's marks part it into."""
    o, t = F.col("ord"), F.col("text")
    made = F.when(o == 1, F.array(F.concat(F.lit("Ann Lee"), F.col("doc_id") % 7, F.lit("* & Bob Ray2, ; Cy Dee")), F.regexp_replace(t, "[.!?,]", " &"))).when(o == 2, F.array(F.lit("Department of X"))).otherwise(F.array(t))
    nodes = _paragraphs(spark, d).select("doc_id", "ord", F.posexplode(made).alias("k", "text")).select("doc_id", (o * 2 + F.col("k")).alias("ord"), "text")
    return regions.front_authors(nodes, "doc_id").select("doc_id", F.array_join("authors", "|").alias("authors"))


def page_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks of a first page, some made affiliations, authors, headings or keywords: what is its abstract."""
    o, t = F.col("ord"), F.col("text")
    made = F.when(o % 6 == 1, F.concat(F.lit("1 Department of "), t)).when(o % 6 == 2, F.concat(F.lit("Lee2 "), t)).when((o % 6 == 5) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("2.1 "), t)).when((o % 6 == 4) & (F.col("doc_id") % 3 == 1), F.concat(F.lit(" Keywords "), t)).otherwise(t)
    out = regions.page_abstract(_paragraphs(spark, d).select("doc_id", "ord", made.alias("text"), F.when(o < 40, 1).otherwise(2).alias("page_no")), "doc_id")
    return out.select("doc_id", F.md5("abstract").alias("abstract_md5"), F.length("abstract").alias("n_chars"))


def person_and_front_matter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _paragraphs(spark, d).groupBy("doc_id").agg(
        F.count_if(classify.looks_like_person_line(c)).alias("person_lines"),
        F.count_if(classify.looks_like_person_name(c)).alias("person_names"),
        F.count_if(classify.is_correspondence(c)).alias("correspondence"),
        F.count_if(classify.is_front_matter(c, F.col("ord") % 2 + 1)).alias("front_matter"),
        F.count_if(classify.is_references_heading(c)).alias("reference_headings"),
        F.count_if(classify.is_chunk_metadata(c)).alias("chunk_metadata"),
        F.count_if(classify.looks_like_metadata(c)).alias("metadata"),
    )


def year_rules(spark: SparkSession, d: str) -> DataFrame:
    """Years of made-up values with a document's numbers in them."""
    i = F.col("doc_id")
    number = F.concat(i % 300 + 1850, F.lit(""))
    docs = read_table(spark, d, "documents")
    return docs.select(
        "doc_id",
        text.year_of(F.when(i % 2 == 0, number).otherwise(F.concat(F.lit("c. "), number, F.lit("x")))).alias("year_of"),
        text.pdf_year(F.concat(F.when(i % 3 == 0, F.lit("D:")).otherwise(F.lit("")), number, F.lit("0501"))).alias("pdf_year"),
        text.stated_year(F.concat(F.lit("Published: May "), number, F.lit(" x"))).alias("stated_year"),
        text.metadata_year(F.concat(F.when(i % 3 == 0, F.lit("D:")).otherwise(F.lit("on ")), number, F.when(i % 2 == 0, F.lit("0501")).otherwise(F.lit("-05")))).alias("metadata_year"),
        text.length_score(F.length("text")).alias("length_score"),
    )


def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the smaller text rules on documents and what is made of them."""
    t, i = F.col("text"), F.col("doc_id")
    docs = read_table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.size(text.plain_sentences(t)).alias("n_sentences"),
        F.size(text.lines(F.concat(t, F.lit("\r\nx\n")))).alias("n_lines"),
        F.md5(text.formula_key(t)).alias("formula_key"),
        text.doi_key(F.concat(F.when(i % 3 == 0, F.lit(" https://doi.org/")).when(i % 3 == 1, F.lit("DOI:")).otherwise(F.lit("")), F.lit("10.1/X"), i)).alias("doi_key"),
        F.md5(text.title_text(F.concat(t, F.lit("†‡ ")))).alias("title"),
        text.heading_text(F.concat(i % 5, F.lit(". Some  heading "), i % 3, F.lit("."))).alias("heading"),
        text.last_word(t).alias("last_word"),
        F.round(token_overlap(t, F.regexp_replace(t, "[aeiou]", "")), 6).alias("overlap"),
    )


def layout_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every third line as a paragraph's text, others behind a number as headings; the lines, each with a word more at times, as layout
    blocks: pairs of distinct texts that can match, by how they are scored."""
    rows, o = _paragraphs(spark, d), F.col("ord")
    blocks = rows.select("doc_id", F.when(o % 5 == 2, F.concat(F.lit("Fig "), "text")).otherwise(F.col("text")).alias("text"), F.when(o % 2 == 0, "section_header").otherwise("text").alias("label"))
    found = []
    for heading, targets in ((False, rows.where(o % 3 == 0)), (True, rows.where(o % 3 == 1).withColumn("text", F.concat(F.lit("2 "), "text")))):
        found.append(canonical.layout_pairs(targets, blocks, heading, "doc_id").withColumn("heading", F.lit(heading)))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "heading").agg(
        F.count_if(F.col("direct") == 1.0).alias("n_equal"),
        F.count_if(F.col("direct") == 0.9).alias("n_held"),
        F.count_if(F.col("direct").isNull()).alias("n_ratio"),
        F.round(F.sum("overlap"), 6).alias("overlap"),
    )


def paragraph_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of odd places as expected paragraphs, the others as extracted ones: pairs that can be as alike as a match asks."""
    rows = _paragraphs(spark, d).select("doc_id", "ord", normalize("text").alias("x")).where("x <> ''")
    found = benchmark.paragraph_pairs(rows.where("ord % 2 = 1"), rows.where("ord % 2 = 0").withColumnRenamed("x", "y"), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum(F.length("x")).alias("n_expected"), F.sum(F.length("y")).alias("n_actual"))


def _made_up_layout(path: str, content: bytes) -> str:
    """A layout service's cheap answer: each line a text, those with a digit formulas; it fails on some files."""
    if int(path) % 40 == 3:
        raise ValueError("no layout")
    return json.dumps({"texts": [{"text": x, "label": "formula" if any("0" <= c <= "9" for c in x) else "text"} for x in content.decode().split("\n")]})


def _made_up_formulas(path: str, content: bytes) -> str:
    """An expensive answer, with formulas spelled out."""
    if int(path) % 40 == 5:
        raise TimeoutError("too slow")
    tree = json.loads(_made_up_layout(path, content))
    return json.dumps({"texts": [t | {"text": f"${t['text']}$"} if t["label"] == "formula" else t for t in tree["texts"]]})


def layout_passes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of two made-up layout services: the trees of the cheap one, or where it found formulas of the other one."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    out = files.layout_artifacts(service.layout_passes(docs, _made_up_layout, _made_up_formulas))
    size = lambda c: F.when(F.col("error").isNull(), c)
    chars = F.aggregate("text_blocks", F.lit(0), lambda n, b: n + F.length(b["text"]))
    return out.select(F.col("path").cast("long").alias("doc_id"), size(F.size("text_blocks")).alias("n_blocks"), size(F.size("formulas")).alias("n_formulas"), size(chars).alias("n_chars"), F.col("formula_enrichment_ran").alias("enriched"), F.split("error", ":")[0].alias("error"))


def cleaning_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as parsed papers, some of them bad: what became of each, and which of them a second run takes up again."""
    i = F.col("doc_id")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("text"), F.lit("text").alias("label")))
    tree = F.to_json(F.struct(lines.alias("texts")))
    tree = F.when(i % 50 == 1, F.lit(None)).when(i % 50 == 2, F.concat(F.lit("<"), tree)).when(i % 50 == 3, F.lit("{}")).otherwise(tree)
    papers = read_table(spark, d, "documents").select("doc_id", F.when(i % 50 != 4, F.concat(i, F.lit(".pdf"))).alias("filename"), tree.alias("json"))
    results, found = outcomes.isolated(papers, lambda rows: files.layout_artifacts(rows).where("doc_id % 50 <> 5"), outcomes.cleaning_rules("doc_id"), "clean", "doc_id")
    again = outcomes.to_do(papers, found, "clean", True, "doc_id").select("doc_id", F.lit(True).alias("again"))
    sizes = results.select("doc_id", F.size("text_blocks").alias("n_blocks"))
    return found.join(sizes, "doc_id", "left").join(again, "doc_id", "left").select("doc_id", "outcome", "error", "n_blocks", F.coalesce("again", F.lit(False)).alias("again"))


def registry_update(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: those of new hashes are numbered on, the others' records lose their error."""
    docs = read_table(spark, d, "documents")
    files = docs.select(F.format_string("/in/%09d.pdf", "doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    old = docs.where("doc_id % 4 = 0").select(F.format_string("paper_%03d", F.col("doc_id") + 1).alias("paper_id"), F.format_string("%d.pdf", "doc_id").alias("filename"), F.sha2("text", 256).alias("file_hash"), F.lit("failed").alias("status"), F.lit("e").alias("error"))
    new = dedup.registered(files, old).select("paper_id", "filename", "file_hash", "status").withColumn("error", F.lit(None).cast("string"))
    seen = dedup.seen_files(files, old).groupBy("paper_id").agg(F.lit("extracted").alias("status"))
    return dedup.upsert(old, seen, removed=("error",)).unionByName(new)


def layout_tree(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the text nodes of a layout tree in JSON: numbers of artifacts and of their coordinates."""
    o, n = F.col("ord"), F.length("text")
    box = F.struct(F.lit(1.0).alias("l"), (n + 2.0).alias("t"), (o + 3.0).alias("r"), F.lit(2.0).alias("b"))
    prov = F.array(F.struct(F.when(o % 5 != 0, o % 4 + 1).alias("page_no"), box.alias("bbox")))
    node = F.struct(F.when(o % 3 != 0, F.col("text")).alias("text"), F.lit("orig").alias("orig"), F.when(o % 4 == 0, F.lit("formula")).otherwise(F.lit("text")).alias("label"), prov.alias("prov"))
    trees = _paragraphs(spark, d).groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(node).alias("texts"))).alias("json"))
    out = files.layout_artifacts(trees)
    coords = F.flatten(F.transform("text_blocks", lambda b: b["coords"]))
    area = F.aggregate(coords, F.lit(0.0), lambda acc, c: acc + c["w"] * c["h"])
    return out.select("doc_id", F.size("text_blocks").alias("n_blocks"), F.size("formulas").alias("n_formulas"), F.size(F.filter("formulas", lambda f: f["text"] == "orig")).alias("n_orig"), F.size(coords).alias("n_coords"), F.round(area, 3).alias("area"), F.size("figures").alias("n_figures"))


def tei_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as TEI texts of nested sections with a table and references, read back; some are broken, some null."""
    plain = F.regexp_replace("text", r"[^A-Za-z \n]", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.concat(F.lit("<div><head>H"), F.length(x), F.lit("</head><p coords='1,2,3,4,5'>a <ref>b</ref> "), x, F.lit(". Done now.</p><div><head>Sub</head><p>"), x, F.lit("</p></div></div>")))
    head = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><fileDesc><titleStmt><title>T"
    table = "<figure type='table'><label>L</label><figDesc>All <hi>of</hi> it</figDesc><coordinates page='3' x='1' y='2' width='3' height='4'/></figure>"
    work = F.concat(F.lit("<biblStruct><monogr><title>Journal</title></monogr><analytic><title>Ref "), F.col("doc_id"), F.lit("</title><author>Ann <surname>Lee</surname></author></analytic></biblStruct>"))
    xml = F.concat(F.lit(head), F.col("doc_id"), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body>"), F.array_join(lines, ""), F.when(F.col("doc_id") % 50 == 7, F.lit("<broken>")).otherwise(F.lit("")), F.lit(table + "</body><back><listBibl>"), work, work, F.lit("</listBibl></back></text></TEI>"))
    xml = F.when(F.col("doc_id") % 50 != 9, xml)
    out = files.parsed_tei(read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), xml.alias("xml")))
    p, first = F.col("tei.paragraphs"), lambda c: F.get(F.col(c), F.lit(0))
    return out.select(
        F.col("path").cast("long").alias("doc_id"),
        "tei.title",
        F.size("tei.sections").alias("n_sections"),
        F.size(p).alias("n_paragraphs"),
        F.aggregate(p, F.lit(0), lambda acc, x: acc + F.length(x["text"])).alias("n_chars"),
        F.aggregate(p, F.lit(0), lambda acc, x: acc + F.size(x["sentences"])).alias("n_sentences"),
        F.size(F.filter(p, lambda x: F.size(x["section_path"]) == 2)).alias("n_nested"),
        F.size(F.filter(p, lambda x: x["page"] == 1)).alias("n_placed"),
        F.size(F.flatten(F.transform(p, lambda x: x["coords"]))).alias("n_coords"),
        F.size("tei.figures").alias("n_figures"),
        first("tei.figures")["page"].alias("table_page"),
        first("tei.figures")["caption"].alias("caption"),
        F.size("tei.references").alias("n_references"),
        first("tei.references")["title"].alias("ref_title"),
        first("tei.references")["raw"].alias("ref_raw"),
        F.col("error").isNotNull().alias("failed"),
    )


def accuracy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of made-up counts: the parts of the overall score."""
    n, i = F.col("n_chars"), F.col("doc_id")
    share = lambda m: (i % m / m)
    docs = read_table(spark, d, "documents").select("doc_id", benchmark.count_score(n % 13, i % 11).alias("tables"), benchmark.count_score(n % 7, i % 5).alias("figures"), benchmark.f1(share(4), share(3)).alias("sections"), share(5).alias("paragraphs"), share(6).alias("formulas"), share(7).alias("references"), share(8).alias("abstract"), share(9).alias("metadata"))
    return docs.select("doc_id", *[F.round(c, 6).alias(c) for c in ("tables", "figures", "sections")], F.round(benchmark.overall(), 6).alias("overall"))


def metadata_scores(spark: SparkSession, d: str) -> DataFrame:
    """Documents' texts as titles, some of them missing or with other white space on one side, with made-up years and identifiers."""
    i, t = F.col("doc_id"), F.col("text")
    rows = read_table(spark, d, "documents").select(
        "doc_id",
        t.alias("title"),
        F.when(i % 3 == 0, F.lit("")).when(i % 3 == 1, F.concat(F.lit("  "), t)).otherwise(F.concat(t, F.lit(" \n"))).alias("expected_title"),
        F.when(i % 4 != 0, 1990 + i % 4).alias("year"),
        F.when(i % 8 != 0, F.when(i % 8 == 1, F.lit(1991)).otherwise(1990 + i % 5)).alias("expected_year"),
        F.when(i % 5 != 0, F.concat(F.lit("https://doi.org/10.1/"), i)).alias("doi"),
        F.when(i % 7 != 0, F.concat(F.lit("10.1/"), i + (i % 11 == 0).cast("int"))).otherwise(F.lit("")).alias("expected_doi"),
    )
    return rows.select("doc_id", F.round(benchmark.metadata_score(i % 6 / 6), 6).alias("metadata"))


def provenance_rules(spark: SparkSession, d: str) -> DataFrame:
    """Lines as layout nodes with made-up provenance: how many have a page and a box with an area."""
    o, n = F.col("ord"), F.length("text")
    number = lambda c: c.cast("double")
    box = F.struct(number(o % 3).alias("l"), number(n % 7).alias("t"), number(n % 4).alias("r"), number(o % 5).alias("b"))
    prov = F.struct(F.when(o % 6 != 0, o % 4).alias("page_no"), F.when(n % 9 != 0, box).alias("bbox"))
    rows = _paragraphs(spark, d).select("doc_id", prov.alias("p"))
    return rows.groupBy("doc_id").agg(F.count_if(classify.valid_provenance(F.col("p"))).alias("n_valid"), F.count_if(classify.valid_box(F.col("p.bbox"))).alias("n_boxes"))


def author_names(spark: SparkSession, d: str) -> DataFrame:
    """Lines in made-up author fields, with marks and separators: the names by the rules of a TEI text, of a PDF's metadata and of a list."""
    o, t = F.col("ord"), F.col("text")
    field = F.when(o % 4 == 0, F.concat(t, F.lit(" & Bob Ray2*, "), t)).when(o % 4 == 1, F.concat(F.lit("Ann Lee1, "), t, F.lit(" and Cy  Dee"))).when(o % 4 == 2, F.concat(F.lit("Ann Lee,ann lee , "), t)).otherwise(t)
    rows = _paragraphs(spark, d).select("doc_id", "ord", field.alias("field"), F.array(F.lit(" Bob Ray; "), t, F.concat(F.lit(", "), t, F.lit(" .")), field).alias("names"))
    listed = lambda names: F.md5(F.array_join(names, "|"))
    return rows.select("doc_id", "ord", listed(text.authors("field")).alias("tei_md5"), listed(text.metadata_authors("field")).alias("pdf_md5"), listed(text.clean_authors("names")).alias("list_md5"))


def node_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines as layout nodes, some of them formulas that have an original alone: their texts and pages."""
    o, t = F.col("ord"), F.col("text")
    prov = F.when(o % 5 != 0, F.transform(F.sequence(F.lit(1), o % 5), lambda i: F.struct((i + o % 3).alias("page_no")))).otherwise(F.array().cast("array<struct<page_no:int>>"))
    nodes = _paragraphs(spark, d).select("doc_id", "ord", F.when(o % 3 == 0, t).when(o % 3 == 1, F.lit("")).alias("text"), F.concat(F.lit(" f =\x0b"), t).alias("orig"), F.when(o % 4 < 2, F.lit("formula")).otherwise(F.lit("text")).alias("label"), prov.alias("prov"))
    return cleaner.item_text(nodes).select("doc_id", "ord", F.md5("text").alias("text_md5"), cleaner.page_no(F.col("prov")).alias("page_no"))


def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lines as nodes behind a made-up heading References, most of them numbered, some of them alike: the references."""
    o, t = F.col("ord"), F.col("text")
    made = F.when(o == 2, F.lit(" References ")).when(o % 10 == 4, F.lit("[7]  Lee, A.: A title.")).when(o % 10 == 9, F.lit("7. lee a A Title")).when(o % 2 == 0, F.concat(F.lit("["), o, F.lit("] "), t)).when(o % 3 == 0, F.concat(o, F.lit(". "), t)).otherwise(t)
    out = cleaner.cleaned_references(_paragraphs(spark, d).select("doc_id", "ord", made.alias("text")), "doc_id")
    return out.select("doc_id", "ord", F.md5("text").alias("text_md5"))


def front_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as nodes of a first page, some of them made names, affiliations, an abstract's beginning or keywords: its abstract."""
    o, t = F.col("ord"), F.col("text")
    i = F.col("doc_id")
    made = F.when(o % 6 == 1, F.concat(F.lit("Ann Lee1 & "), t)).when(o % 6 == 2, F.concat(F.lit("Department of "), t)).when((o == 3) & (i % 3 == 0), F.concat(F.lit("ABSTRACT : "), t)).when((o % 9 == 8) & (i % 2 == 0), F.concat(F.lit(" Keywords "), t)).otherwise(t)
    out = regions.front_abstract(_paragraphs(spark, d).select("doc_id", "ord", made.alias("text")), "doc_id")
    return out.select("doc_id", F.md5("abstract").alias("abstract_md5"), F.length("abstract").alias("n_chars"))


def canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as paragraphs under short lines as headings, under other sections or none: the text of each document."""
    rows = _paragraphs(spark, d)
    kept = canonical.sections(rows.where(F.length("text") <= 60).select("doc_id", "ord", F.col("text").alias("heading")), "doc_id")
    o = F.col("ord")
    texts = rows.select("doc_id", "ord", clean("text").alias("text"), F.when(F.length("text") <= 60, F.concat(F.lit(" "), F.col("text"))).when(o % 3 == 0, F.lit("Else")).when(o % 3 == 1, F.lit("")).alias("section")).where("text <> ''")
    papers = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" in  "), "lang")).alias("abstract"))
    return canonical.canonical_text(papers, kept, texts, "doc_id").select("doc_id", F.md5("canonical_text").alias("text_md5"), F.length("canonical_text").alias("n_chars"))


def reference_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lines' digests as references, with some changed, repeated or left out on the expected side: the F1 of both lists."""
    side = lambda kept, key: F.collect_list(F.when(kept, F.struct(F.sha2(key, 256).alias("title"), F.array("source").alias("authors"), (F.length("text") % 3).alias("year"), F.lit("").alias("doi"))))
    o, t = F.col("ord"), F.col("text")
    rows = read_table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    lists = rows.groupBy("doc_id").agg(side(o % 5 != 0, t).alias("a"), side(o % 4 != 1, F.when(o % 3 == 0, F.concat(t, F.lit("?"))).otherwise(t)).alias("e"))
    return lists.select("doc_id", F.size("a").alias("n_actual"), F.size("e").alias("n_expected"), F.round(benchmark.reference_score(F.col("a"), F.col("e")), 6).alias("reference_f1"))


def sentence_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rounds of twelve sentences, the digest of the text and a number in each, some cut short when they come again: each stays once."""
    lines = F.split("text", "\n")
    digest = lambda i: F.sha2(F.concat((i % 12).cast("string"), F.lit(" "), F.col("text")), 256)
    made = F.transform(lines, lambda x, i: F.concat(F.lit("S"), F.when((i >= 12) & (i % 5 == 0), F.substring(digest(i), 1, 50)).otherwise(digest(i)), F.when(i % 2 == 0, F.lit(".")).otherwise(F.lit(" !"))))
    docs = read_table(spark, d, "documents").select("doc_id", F.size(lines).alias("n_made"), without_near_sentences(F.array_join(made, "  ")).alias("t"))
    return docs.select("doc_id", "n_made", F.md5("t").alias("text_md5"))


def abstract_choices(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines under made-up sections beside a PDF's text: the abstract that is given, else the section's, else the PDF text's."""
    i, o, t = F.col("doc_id"), F.col("ord"), F.col("text")
    pdf = F.when(i % 4 == 1, F.concat(F.lit("Title ABSTRACT : "), t, F.lit(" Keywords: none"))).when(i % 4 == 2, F.concat(F.lit("Abstract short. Introduction "), t)).otherwise(t)
    papers = read_table(spark, d, "documents").select("doc_id", F.when(i % 4 == 0, F.concat(F.lit(" by "), "source")).alias("abstract"), pdf.alias("pdf_text"))
    rows = _paragraphs(spark, d).withColumn("section", F.when((o == 1) & (i % 3 == 0), F.lit(" Abstract")).when(o == 4, F.lit("Methods")))
    return canonical.abstracts(papers, rows, "doc_id").select("doc_id", F.md5("abstract").alias("abstract_md5"), F.length("abstract").alias("n_chars"))


def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as three parsers' records, the lines as sections, paragraphs, artifacts and references: the canonical document of each."""
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    section = lambda x, k: F.when(F.length(x) <= 60, F.concat(F.lit(" "), x)).when(k % 3 == 0, F.lit("Else")).when(k % 3 == 1, F.lit(""))
    coords = lambda k: F.array(F.struct((1 + k % 2).alias("page"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h")))
    tei = F.struct(
        F.concat(F.lit(" T  "), "source").alias("title"),
        F.array(F.lit(" Ann Lee; "), F.col("source"), F.concat("source", F.lit(" ."))).alias("authors"),
        (i % 300 + 1850).alias("year"),
        F.when(i % 4 != 0, F.concat(F.lit(" 10.1/"), i)).otherwise(F.lit("  ")).alias("doi"),
        F.when(i % 3 == 0, F.get(lines, F.lit(0))).alias("abstract"),
        F.transform(F.filter(lines, lambda x: F.length(x) <= 60), lambda x: F.struct(x.alias("heading"), F.lit(1).alias("level"))).alias("sections"),
        F.transform(lines, lambda x, k: F.struct(x.alias("text"), section(x, k).alias("section"), coords(k).alias("coords"))).alias("paragraphs"),
        F.transform(lines, lambda x, k: F.struct(x.alias("title"), F.array("source").alias("authors"), F.when(k % 2 == 0, x).otherwise(F.lit("")).alias("raw"))).alias("references"),
    )
    place = lambda name: F.transform(lines, lambda x, k: F.struct(x.alias(name), coords(k).alias("coords")))
    artifacts = F.struct(F.filter(F.transform(lines, lambda x, k: F.struct(x.alias("text"), F.lit("text").alias("label"), coords(k).alias("coords"))), lambda b: F.lit(False)).alias("text_blocks"), place("text").alias("formulas"), place("caption").alias("figures"), F.filter(place("caption"), lambda b: F.length(b["caption"]) > 60).alias("tables"))
    # dealt by id once, whole: every part is grouped by it, and all read one exchange
    records = read_dealt(spark, d, "documents", "doc_id").select("doc_id", F.concat(i, F.lit(".pdf")).alias("filename"), tei.alias("tei"), F.lit("").alias("pdf_text"), artifacts.alias("artifacts"))
    out = papers.canonical_documents(records, "doc_id")
    return out.select("doc_id", "metadata.title", F.array_join("metadata.authors", "|").alias("authors"), "metadata.year", "metadata.doi", *[F.size(c).alias(f"n_{c}") for c in ("sections", "paragraphs", "formulas", "figures", "tables", "references")], F.md5("canonical_text").alias("text_md5"))


def cleaned_papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as papers of a layout tree, their lines its nodes, with made-up authors, year, abstract and references: the cleaned document of each."""
    i, o, t = F.col("doc_id"), F.col("ord"), F.col("text")
    made = F.when(o == 1, F.concat(F.lit("Ann Lee"), i % 7, F.lit("* & Bob Ray2, "))).when(o == 2, F.lit("Department of X")).when(o == 3, F.concat(F.lit("Published: 2 May "), i % 30 + 1990)).when((o == 4) & (i % 3 == 0), F.concat(F.lit("ABSTRACT : "), t)).when(o == 8, F.lit("REFERENCES")).when((o > 8) & (o % 3 != 0), F.concat(F.lit("["), o, F.lit("] "), t)).otherwise(t)
    nodes = _paragraphs(spark, d).where((o != 1) | (i % 2 == 0)).select("doc_id", "ord", made.alias("text"), F.lit(None).cast("string").alias("orig"), F.lit("text").alias("label"), F.when(o < 6, 1).otherwise(2).alias("page_no"))
    none = F.lit(None).cast("string")
    meta = F.struct(F.when(i % 3 != 0, F.lit("Zed Poe, Cy  Dee and zed poe")).alias("pdf_author"), F.when(i % 4 == 0, F.lit("D:20110203")).alias("creation_date"), none.alias("mod_date"), F.when(i % 4 == 1, F.lit("in 1987")).alias("publication_date"))
    made_of = read_table(spark, d, "documents").select("doc_id", F.concat(i, F.lit(".pdf")).alias("filename"), F.lit(2).alias("num_pages"), meta.alias("metadata"))
    out = papers.cleaned_documents(made_of, nodes, "doc_id")
    kept = F.size(F.filter("nodes", lambda x: x["text"] != ""))
    return out.select("doc_id", F.md5("title").alias("title_md5"), F.array_join("authors", "|").alias("authors"), "year", (F.coalesce("abstract", F.lit("")) != "").alias("has_abstract"), F.size("references").alias("n_references"), F.md5(F.array_join("references", "|")).alias("references_md5"), "stats.total_text_nodes", kept.alias("n_kept"))


def integrity_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of documents as papers: lines are paragraphs, and blocks with coordinates; what a plain text
    doesn't have is made of it."""
    lines, first = F.split("text", "\n"), F.element_at(F.split("text", "\n"), 1)
    # dealt by id once: every metric is grouped by it
    docs = read_dealt(spark, d, "documents", "doc_id")
    section = lambda i: F.when(i % 4 != 0, F.lit("S"))
    tei = F.struct(
        F.when(F.col("doc_id") % 2 == 0, first).otherwise(F.lit("")).alias("title"),
        F.when(F.col("source").isNotNull(), F.array("source")).alias("authors"),
        F.lit(2024).alias("year"),
        F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("abstract"),
        F.transform(lines, lambda x: F.struct(x.alias("heading"))).alias("sections"),
        F.transform(lines, lambda x, i: F.struct(x.alias("text"), section(i).alias("section"))).alias("paragraphs"),
        F.transform(lines, lambda x: F.struct(x.alias("title"), F.lit(None).cast("array<string>").alias("authors"), F.lit("").alias("raw"))).alias("references"),
        F.transform(lines, lambda x, i: F.struct(F.when(i % 2 == 0, F.lit("table")).otherwise(F.lit("figure")).alias("type"))).alias("figures"),
    )
    coord = lambda i: F.array(F.struct(F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (i % 3).cast("double").alias("w"), F.lit(1.0).alias("h")))
    blocks = F.transform(lines, lambda x, i: F.struct(coord(i).alias("coords")))
    artifacts = F.struct(lines.alias("figures"), lines.alias("tables"), F.lit(None).cast("array<string>").alias("formulas"), blocks.alias("text_blocks"))
    records = docs.select("doc_id", tei.alias("tei"), F.col("text").alias("pdf_text"), artifacts.alias("artifacts"))
    out = quality.evaluate(records, "doc_id")
    return out.select("doc_id", "integrity_score", "status", F.array_join("issues", ",").alias("issues"), *quality.WEIGHTS, "orphan_paragraph_ratio", *[F.col(f"artifact_counts.{c}").alias(f"n_{c}") for c in ("figures", "text_blocks", "formulas")], *[F.col(f"extraction_counts.{c}").alias(f"tei_{c}") for c in ("sections", "paragraphs", "references", "figures", "tables")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        quality_report, metric_variance_report, dedup_exact, line_dedup_first_wins, paragraph_integrity, header_footer_filter, audit_stats, numeric_tokens,
        token_frequency, page_numeric_consistency, page_token_f1, page_metadata, publisher_text_truncation, author_and_person_filters, heading_filters,
        conversation_carry_forward, section_segmentation, run_counters, sentence_split, chunk_packing, near_duplicate_sentences, normalized_text,
        benchmark_coverage, greedy_list_f1, reference_folding, layout_order, font_stats, coordinate_integrity, reference_integrity, structure_integrity,
        abstract_integrity, abstract_regions, artifact_dedup, canonical_paragraphs, title_rules, front_authors, person_and_front_matter, year_rules,
        text_rules, registry_update, layout_tree, tei_records, accuracy_scores, integrity_evaluation, layout_pairs, paragraph_pairs, layout_passes, page_blocks, cleaning_outcomes, page_abstracts, metadata_scores, provenance_rules,
        author_names, node_items, reference_lists, front_abstracts, canonical_texts, reference_scores, sentence_repeats,
        abstract_choices, canonical_records, cleaned_papers,
    )
    return {f.__name__: f for f in listed}
