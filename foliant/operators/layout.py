"""Reading order, line and block assembly, header and footer removal, and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import classify
from foliant.functions.similarity import line_text
from foliant.functions.text import AUDIT_NUMBER, block_key, block_text, clean
from foliant.operators.dedup import first_wins

BOLD_BIT, DEFAULT_SIZE = 4, 10.0


def column_order(width: Column) -> list[Column]:
    """Sort keys of blocks x0, y0, ord on a page of two columns."""
    return [F.when(F.col("x0") < width / 2, 0).otherwise(1), F.col("y0"), F.col("ord")]


def page_order() -> list[Column]:
    return [F.col("page_no"), F.col("y0"), F.col("x0"), F.col("ord")]


def spans_to_lines(spans: DataFrame, by: tuple[str, ...] = ("paper_id", "page_no", "block_no", "line_no")) -> DataFrame:
    """Lines of spans(…, span_no, text, size, flags): texts joined and composed, largest size (1 place), bold if any span is."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    bold = F.bool_or((F.shiftright(F.col("flags"), BOLD_BIT).bitwiseAND(1)) == 1)
    lines = spans.groupBy(*by).agg(text.alias("text"), F.round(F.max("size"), 1).alias("font_size"), bold.alias("is_bold"))
    return lines.withColumn("text", line_text(F.col("text"))).where("text <> ''")


def lines_to_blocks(lines: DataFrame, by: tuple[str, ...] = ("paper_id", "page_no", "block_no")) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return lines.groupBy(*by).agg(text.alias("text"), F.max("font_size").alias("font_size"), F.bool_or("is_bold").alias("is_bold"))


def body_font_size(lines: DataFrame, by: str = "paper_id") -> DataFrame:
    return lines.groupBy(by).agg(F.coalesce(F.median("font_size"), F.lit(DEFAULT_SIZE)).alias("body_font_size"))


def without_headers(blocks: DataFrame) -> DataFrame:
    y0, y1 = (F.col("y0"), F.col("y1")) if "y0" in blocks.columns else (None, None)
    return blocks.where(~classify.is_header_footer(F.col("text"), y0, y1))


def distinct_blocks(blocks: DataFrame, by: tuple[str, ...] = ("paper_id", "page_no")) -> DataFrame:
    """The first block of each key on a page; blocks without a key go."""
    # equal keys are told apart by a digest, so the window's keys stay short
    keyed = blocks.withColumn("_key", F.md5(F.nullif(block_key("text"), F.lit("")))).where("_key is not null")
    return first_wins(keyed, [*by, "_key"], ["ord"]).drop("_key")


def page_texts(blocks: DataFrame, by: str = "paper_id") -> DataFrame:
    """Clean, headers out, distinct, in reading order: (by, page_no, text)."""
    rows = distinct_blocks(without_headers(blocks.withColumn("text", block_text("text")).where("text <> ''")), (by, "page_no"))
    grouped = rows.groupBy(by, "page_no").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text"))).alias("r"))
    return grouped.select(by, "page_no", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))


def paper_texts(pages: DataFrame, by: str = "paper_id") -> DataFrame:
    """(by, num_pages, text); num_pages counts pages with a block that stayed."""
    grouped = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("r"))
    return grouped.select(by, F.size("r").alias("num_pages"), F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))


def audit_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with characters, words and numbers."""
    words = F.filter(F.split(clean(text), " "), lambda x: x != "")
    return texts.withColumns({"characters": F.length(text), "words": F.size(words), "numbers": F.regexp_count(F.col(text), F.lit(AUDIT_NUMBER))})
