"""The layout-tree cleaner: nodes of a paper with what isn't body text blanked, in the order of its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import classify
from foliant.functions.similarity import without_near_sentences
from foliant.functions.text import clean, heading_text, sentence_key, without_publisher_text
from foliant.operators.dedup import first_wins
from foliant.operators.regions import after_references


def item_text(nodes: DataFrame) -> DataFrame:
    """nodes with text: their own, or a formula's original; control and line breaks become spaces."""
    text = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("text")).when(F.col("label") == "formula", F.col("orig"))
    return nodes.withColumn("text", clean(text))


def page_no(provenance: Column) -> Column:
    """The page of a node's first provenance record, an array of structs with page_no; null without one."""
    return F.get(provenance, F.lit(0))["page_no"]


def cleaned_nodes(nodes: DataFrame, by: str = "paper_id") -> DataFrame:
    """nodes(by, ord, text, page_no) with cleaned text; rows keep their places, blanked ones have "".

    After the heading References everything is blanked, then front matter of page 1, captions,
    publisher text, keywords; headings are tidied and nearly repeated sentences dropped.
    """
    rows = after_references(nodes.withColumn("text", clean("text")), by)
    text = F.col("text")
    blank = F.col("in_references") | classify.is_front_matter(text, F.col("page_no")) | classify.is_caption(text) | classify.is_keywords(text)
    rows = rows.withColumn("text", F.when(blank, F.lit("")).otherwise(heading_text(without_publisher_text("text"))))
    return rows.withColumn("text", without_near_sentences("text")).drop("in_references")


def cleaned_references(nodes: DataFrame, by: str = "paper_id") -> DataFrame:
    """Numbered nodes after References, the first of each."""
    rows = after_references(nodes.withColumn("text", clean("text")), by).where(F.col("in_references") & classify.is_reference(F.col("text")))
    return first_wins(rows.withColumn("_key", sentence_key("text")).where("_key <> ''"), [by, "_key"], ["ord"]).select(by, "ord", "text")
