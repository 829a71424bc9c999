"""Sections and token-bounded chunks of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.classify import is_chunk_metadata
from foliant.functions.text import clean, heading_text, let, sentences, strip

MAX_TOKENS, OVERLAP = 450, 60
HEADING = r"\A\s*[0-9]+(?:\.[0-9]+)*\.?\s+.+?\s*\z"


def sections(lines: DataFrame, by: str = "paper_id") -> DataFrame:
    """(by, section_no, section, text) of lines(by, ord, line): a numbered line opens a section.

    Text before the first heading is Introduction; metadata lines and empty sections go.
    """

    def judged(line: Column) -> Column:
        """Everything that is known of a line, from the stripped text; what isn't a line of the text is null."""
        use = (line != "") & ~is_chunk_metadata(line)
        opens = line.rlike(r"\A[0-9]") & line.rlike(HEADING)
        return let(F.when(use, opens).otherwise(False), lambda o: F.struct(F.when(use & ~o, line).alias("line"), o.cast("int").alias("opens"), F.when(o, heading_text(line)).alias("heading")))

    rows = lines.select(by, "ord", let(strip("line"), judged).alias("_l")).select(by, "ord", "_l.*")
    w = Window.partitionBy(by).orderBy("ord")
    rows = rows.withColumn("section_no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("line").isNotNull(), F.struct("ord", "line"))
    grouped = rows.groupBy(by, "section_no").agg(F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["line"]), " ").alias("text"))
    return grouped.where("text <> ''").select(by, "section_no", F.coalesce("heading", F.lit("Introduction")).alias("section"), "text")


def word_count(sentence: Column) -> Column:
    """Default token counts; a tokenizer's own counts may take their place."""
    return F.size(F.filter(F.split(clean(sentence), " "), lambda x: x != ""))


def packed(parts: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Texts of the chunks of parts, an array of structs s (sentence) and n (its tokens).

    A chunk is closed where the next sentence would exceed `most`; the next one starts with the last
    sentences whose tokens stay within `overlap`. A longer sentence is a chunk of its own.
    """
    start = F.expr("named_struct('out', cast(array() as array<string>), 'now', cast(array() as array<struct<s:string,n:int>>), 'n', 0)")

    def tail(now: Column) -> Column:
        first = F.expr("named_struct('on', true, 'n', 0, 'keep', cast(array() as array<struct<s:string,n:int>>))")

        def back(acc: Column, x: Column) -> Column:
            fits = acc["on"] & (acc["n"] + x["n"] <= overlap)
            return F.struct(fits.alias("on"), F.when(fits, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(F.array(x), acc["keep"])).otherwise(acc["keep"]).alias("keep"))

        return F.aggregate(F.reverse(now), first, back)

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["n"] + x["n"] > most)
        rest = tail(acc["now"])
        text = F.array_join(F.transform(acc["now"], lambda y: y["s"]), " ")
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"),
            F.concat(F.when(full, rest["keep"]).otherwise(acc["now"]), F.array(x)).alias("now"),
            (F.when(full, rest["n"]).otherwise(acc["n"]) + x["n"]).alias("n"),
        )

    def close(acc: Column) -> Column:
        text = F.array_join(F.transform(acc["now"], lambda y: y["s"]), " ")
        return F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(text))).otherwise(acc["out"])

    return F.aggregate(parts, start, step, close)


def counted_sentences(text: Column | str) -> Column:
    return F.transform(sentences(text), lambda s: F.struct(s.alias("s"), word_count(s).cast("int").alias("n")))


def chunks(abstracts: DataFrame, body: DataFrame, by: str = "paper_id", most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(by, chunk_id, section, text, page_no, source) of abstracts(by, abstract) and body(by, section_no, section, text).

    Abstract chunks are numbered from 0, the body's go on from their number.
    """
    a = abstracts.where(clean("abstract") != "").select(by, F.posexplode(packed(counted_sentences("abstract"), most, overlap)).alias("i", "text"))
    a = a.select(by, F.lit("Abstract").alias("section"), "text", F.lit(1).alias("page_no"), F.col("i"), F.format_string(f"%s_abstract_%03d", F.col(by).cast("string"), F.col("i")).alias("chunk_id"))
    n = a.groupBy(by).agg(F.count("*").alias("n"))
    b = body.select(by, "section_no", "section", F.posexplode(packed(counted_sentences("text"), most, overlap)).alias("k", "text"))
    b = b.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy("section_no", "k")) - 1).join(n, by, "left")
    i = (F.col("i") + F.coalesce("n", F.lit(0))).cast("int")
    b = b.select(by, "section", "text", F.lit(None).cast("int").alias("page_no"), i.alias("i"), F.format_string("%s_chunk_%03d", F.col(by).cast("string"), i).alias("chunk_id"))
    return a.unionByName(b).withColumn("source", F.lit("pymupdf")).drop("i")
