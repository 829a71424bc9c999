"""Predicates on lines, blocks, headings and coordinates, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import clean, let, strip

# The word lists and patterns of the rules.
BAD_ENDINGS = ("and", "or", "the", "of", "to", "for", "with", "a", "an", "by", "from", "in", "on", "using", "that")
BAD_MARKS = (",", ":", ";", "-", "(")
MAJOR_SECTIONS = ("abstract", "introduction", "related work", "background", "materials and methods", "materials method", "methods", "methodology", "experiments", "results", "results and discussion", "discussion", "conclusion", "conclusions", "limitations", "references")
RUNNING_TEXT = (r"^page\s+\d+$", r"^\d+\s+of\s+\d+$", r"copyright\s+\d{4}", r"©\s*\d{4}", "open access", "all rights reserved", "published by", "springer nature", r"scientific reports\s*\|", "mdpi", "proceedings of the .* conference")
HEADER_FOOTER = (r"eng\.\s*proc\.", r"scientific reports\s*\|", r"www\.nature\.com", r"\d+\s+of\s+\d+$", r"vol\.:", r"vol:\.")
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CORRESPONDENCE = ("correspondence:", "corresponding author", "email:", "e-mail:")
CHART_TERMS = ("accuracy", "precision", "recall", "sensitivity", "specificity", "parameters", "top-1", "top1", "f1", "auc", "epoch", "epochs")
AFFILIATION = ("department", "university", "school of", "faculty", "college", "institute", "email:", "@")
BLOCK_AFFILIATION = ("department", "university", "school of", "faculty", "institute", "college", "email", "@")
PERSON_LINE_STOPS = ("@", "department", "university")
AUTHOR_SKIPS = ("department", "university", "school of", "faculty", "email", "@")
METADATA_LINES = ("proceeding paper", "open", "open access")
TEXT_METADATA = ("scientific reports", "www.nature.com", "doi.org", "open access", "eng. proc.")
CHUNK_METADATA = ("scientific reports", "eng. proc.", "www.nature.com", "doi.org")


def has_any(c: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | c.contains(t)
    return found


def is_header_footer(c: Column, y0: Column | None = None, y1: Column | None = None) -> Column:
    """A running header or footer by its start, or a bare number at the page's edge."""
    text = F.lower(strip(c))
    found = text.rlike(r"(?d)\A(?:" + "|".join(HEADER_FOOTER) + ")")
    if y0 is None or y1 is None:
        return found
    return found | (text.rlike(r"(?U)\A\d+\z") & F.coalesce((y0 < 60) | (y1 > 760), F.lit(False)))


def looks_like_running_text(c: Column) -> Column:
    return lower_running_text(F.lower(c))


def lower_running_text(low: Column) -> Column:
    """looks_like_running_text() of a text in lower case. Whole-line patterns can match short texts alone; the others
    are looked for where a text has the words that they begin with."""
    whole = [p for p in RUNNING_TEXT if p.startswith("^")]
    inside = [p for p in RUNNING_TEXT if not p.startswith("^")]
    begins = tuple(re.match(r"[\w ©]+", p)[0].strip() for p in inside)
    return low.rlike("(?d)\\A(?:" + "|".join(f"(?:{p[1:]})" for p in whole) + ")") | (has_any(low, begins) & low.rlike("(?d)" + "|".join(f"(?:{p})" for p in inside)))


def looks_like_email_block(c: Column) -> Column:
    n = F.when(c.contains("@"), F.regexp_count(c, F.lit(EMAIL))).otherwise(0)
    return let(n, lambda n: (n >= 2) | ((n >= 1) & has_any(F.lower(c), CORRESPONDENCE)))


def looks_like_chart_text(c: Column) -> Column:
    """Twelve words or more, a quarter of them numbers, and a chart term."""
    return clean_chart_text(clean(c), F.lower(c))


def clean_chart_text(c: Column, low: Column) -> Column:
    """looks_like_chart_text() of a text that is clean(), and its lower case."""
    number = r"(?U)(?<![^ ])[,.;:()\[\]]*+[-+]?\d+(?:\.\d+)?%?[,.;:()\[\]]*+(?![^ ])"

    def enough(words: Column) -> Column:
        return (words >= 12) & (F.regexp_count(c, F.lit(number)) / F.greatest(words, F.lit(1)) >= 0.25)

    return F.when(has_any(low, CHART_TERMS) & c.rlike(r"(?U)\d"), let(F.size(F.split(c, " ")), enough)).otherwise(False)


def _formula_like(text: Column) -> Column:
    return (F.size(F.split(text, " ")) <= 10) & text.rlike(r"[=^_{}]")


def is_garbage_heading(c: Column) -> Column:
    """The builder's rule."""
    text = clean(c)
    low = F.lower(text)
    return (text == "") | (F.length(text) > 180) | text.isin("•", "-", "_") | text.rlike(r"\A[\d\s%=+\-*/().]+\z") | low.rlike(r"scientific reports\s*\||proceedings of the .*conference|\b(?:copyright|correspondence to)\b") | _formula_like(text)


def is_bad_heading(c: Column) -> Column:
    """The metric's rule; it knows fewer patterns but a word limit."""
    text = clean(c)
    return (text == "") | (F.length(text) > 180) | (F.size(F.split(text, " ")) > 20) | _formula_like(text)


def is_major_section(c: Column) -> Column:
    return F.lower(clean(c)).isin(*MAJOR_SECTIONS)


def is_sane_title(c: Column) -> Column:
    return F.length(c).between(20, 300) & ~F.lower(c).contains("pdftitle") & ~c.startswith("\\")


def looks_like_metadata(c: Column) -> Column:
    return has_any(F.lower(c), TEXT_METADATA)


def is_title_candidate(c: Column) -> Column:
    return F.length(c).between(20, 250) & ~looks_like_metadata(c)


def looks_like_affiliation(c: Column) -> Column:
    return has_any(F.lower(c), AFFILIATION)


def is_correspondence(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("email") | low.contains("correspondence") | c.contains("*")


def looks_like_person_name(c: Column) -> Column:
    n = F.size(F.split(clean(c), " "))
    return n.between(2, 6) & ~c.rlike(r"(?U)\d")


def looks_like_person_line(c: Column) -> Column:
    return (F.length(c) <= 250) & ~has_any(F.lower(c), PERSON_LINE_STOPS) & (c.contains(" & ") | c.rlike(r"\b[A-Z][a-z]+\d"))


def looks_like_author_block(c: Column) -> Column:
    return (F.length(c) <= 300) & c.rlike(r"[A-Z][a-z]+\d")


def is_affiliation(c: Column) -> Column:
    return has_any(F.lower(c), BLOCK_AFFILIATION)


def looks_like_body_sentence(c: Column) -> Column:
    return (F.length(c) >= 60) & (F.size(F.split(clean(c), " ")) >= 10) & c.rlike(r"[.!?]")


def is_front_matter(c: Column, page: Column) -> Column:
    from foliant.functions.text import PUBLISHER

    low = F.lower(clean(c))
    return F.coalesce(page == 1, F.lit(False)) & (low.isin(*METADATA_LINES) | looks_like_affiliation(c) | is_correspondence(c) | has_any(low, PUBLISHER))


def is_caption(c: Column) -> Column:
    return c.rlike(r"(?i)\A(?:Figure|Fig\.|Table)\s*\d+\b")


def is_reference(c: Column) -> Column:
    return c.rlike(r"\A\s*(?:\[\d+\]|\d+\.)\s+")


def is_keywords(c: Column) -> Column:
    return c.rlike(r"(?i)\A\s*keywords?\b")


def is_references_heading(c: Column) -> Column:
    return c.rlike(r"(?i)\A\s*references\s*\z")


def is_chunk_metadata(c: Column) -> Column:
    low = F.lower(strip(c))
    found = F.lit(False)
    for t in CHUNK_METADATA:
        found = found | low.startswith(t)
    return found


def valid_coord(s: Column) -> Column:
    """A struct page, x, y, w, h with a place and an area."""
    return F.coalesce(s["page"].isNotNull() & (s["x"] >= 0) & (s["y"] >= 0) & (s["w"] > 0) & (s["h"] > 0), F.lit(False))


def coord_record(m: Column) -> Column:
    """valid_coord()'s struct of a map of texts, whose keys may also be page_no, width and height."""
    number = lambda *names: F.coalesce(*[m[n] for n in names]).try_cast("double")
    return F.struct(number("page", "page_no").cast("int").alias("page"), number("x").alias("x"), number("y").alias("y"), number("w", "width").alias("w"), number("h", "height").alias("h"))


def valid_provenance(s: Column) -> Column:
    """A struct page_no, bbox (l, t, r, b) with a page and a box that has an area."""
    return F.coalesce(s["page_no"].isNotNull() & valid_box(s["bbox"]), F.lit(False))


def valid_box(s: Column) -> Column:
    """A struct l, t, r, b with r over l and t over b."""
    return F.coalesce((s["r"] > s["l"]) & (s["t"] > s["b"]), F.lit(False))
