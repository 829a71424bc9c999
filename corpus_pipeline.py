"""A training corpus from documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import langid, linededup, mixing, neardup, piece
from foliant.llm.queries import tokenizer_path
from foliant.plans.scratch import materialize
from foliant.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text a centroid of a known language accepts. Null and empty texts, and those without a letter, go;
    repeated rows stay; without a labelled text no document stays."""
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly, an earlier one of the corpus. Every row stays, with an
    empty text if all its lines go; a null text stays null; rows of equal id and text are one document."""
    return linededup.without_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, 0.8). Texts without words
    and rows with a null id stay; of rows of equal id and text one stays."""
    return neardup.keep_first(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; documents that it takes again are repeated, those without words go. Null
    sources are one source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their digest, and the decoded text's; a null text has no ids. Rows that repeat stay."""
    return piece.encoded(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Clusters, merge rounds and shingle verification aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    *others, (_, last) = STAGES
    docs = reduce(lambda d, stage: materialize(stage[1](spark, d, sf_dir), stage[0]), others, docs)
    return last(spark, docs, sf_dir)
