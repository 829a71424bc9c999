"""Chat formatting: messages of typed content parts become one text with a loss mask, in DataFrame functions only.

A visitor folds over a message's parts: text gathers in a run, in which control strings are escaped once it ends, so that
two text parts can't form one between them; an image, audio or document part ends the run, leaves its placeholder and
is recorded with its reference, its place and the number of tokens that it expands to. Messages are formatted where they lie;
one shuffle by conversation orders them, sums up where each begins, and joins them.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. In texts `<`, any backslashes and a control string's rest get one
backslash more, and reading back takes it away; in roles a backslash and a line break are escaped as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import let

START, END = "<|im_start|>", "<|im_end|>"
#: attachments' kinds and the file extensions that tell them in a text.
KINDS = {"image": "png|jpe?g|gif|webp|bmp|svg", "audio": "wav|mp3|flac|ogg|m4a", "document": "pdf|docx?|pptx?|xlsx?|epub"}
_CONTROL = rf"<(\\*)\|(im_start|im_end|{'|'.join(KINDS)})\|>"
_ESCAPED = rf"<\\(\\*)\|(im_start|im_end|{'|'.join(KINDS)})\|>"
#: A reference to a file in a text: ![name](file.png), also with other files of these kinds.
MARKUP = rf"!\[[^\[\]\n]*\]\([^()\x00-\x20]+\.(?:{'|'.join(KINDS.values())})\)"
#: Tokens of an attachment: an image's by tiles of so many pixels, audio's by second, a document's by page; each at least one.
TILE, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512
#: Tiles, seconds and pages of those that don't say.
UNKNOWN_TILES, UNKNOWN_SECONDS, UNKNOWN_PAGES = 256, 30, 1

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_RUNS = "array<struct<lo:bigint,hi:bigint>>"
_ATTACHED = "array<struct<kind:string,ref:string,source:string,at:bigint,tokens:bigint>>"


def escaped(text: Column) -> Column:
    """text without control strings, reversibly."""
    return F.regexp_replace(text, _CONTROL, r"<\\$1|$2|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|$2|>")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    """Undo _role(): between doubled backslashes, a backslash and an n are a line break."""
    between = F.transform(F.split(unescaped(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(between, "\\")


def _tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to."""
    tiles = F.ceil(part["width"] / TILE) * F.ceil(part["height"] / TILE)
    by_kind = F.when(part["kind"] == "image", F.coalesce(tiles, F.lit(UNKNOWN_TILES))).when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(UNKNOWN_SECONDS)) * AUDIO_TOKENS)).otherwise(F.coalesce(part["pages"], F.lit(UNKNOWN_PAGES)) * PAGE_TOKENS)
    return F.greatest(by_kind.cast("bigint"), F.lit(1).cast("bigint"))


def visited(parts: Column) -> Column:
    """struct(body, runs, attachments) of an array of parts: the flattened text, the places lo to hi of its text in it, and
    what its placeholders stand for, each with its place. Places count code points from the body's beginning."""
    start = F.struct(F.lit("").alias("body"), F.lit("").alias("run"), F.expr("array()").cast(_RUNS).alias("runs"), F.expr("array()").cast(_ATTACHED).alias("attachments"))

    def ended(state: Column) -> Column:
        """struct(body, runs, attachments) with the run that is open."""

        def close(body: Column) -> Column:
            run = F.struct(F.length(state["body"]).cast("bigint").alias("lo"), F.length(body).cast("bigint").alias("hi"))
            runs = F.when(state["run"] == "", state["runs"]).otherwise(F.concat(state["runs"], F.array(run)))
            return F.struct(body.alias("body"), runs.alias("runs"), state["attachments"].alias("attachments"))

        return let(F.concat(state["body"], escaped(state["run"])), close)

    def visit(state: Column, part: Column) -> Column:
        def attach(s: Column) -> Column:
            record = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), F.coalesce(part["text"], F.lit("")).alias("source"), F.length(s["body"]).cast("bigint").alias("at"), _tokens(part).alias("tokens"))
            return F.struct(F.concat(s["body"], F.lit("<|"), part["kind"], F.lit("|>")).alias("body"), F.lit("").alias("run"), s["runs"].alias("runs"), F.concat(s["attachments"], F.array(record)).alias("attachments"))

        text = F.struct(state["body"].alias("body"), F.concat(state["run"], F.coalesce(part["text"], F.lit(""))).alias("run"), state["runs"].alias("runs"), state["attachments"].alias("attachments"))
        return F.when(part["kind"].isin(*KINDS), let(ended(state), attach)).otherwise(text)

    return F.aggregate(F.coalesce(parts, F.expr("array()").cast(f"array<{PART}>")), start, visit, ended)


def text_part(text: Column) -> Column:
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))


def text_parts(text: Column) -> Column:
    """The parts of a plain text: references to files in it (MARKUP) are attachments, which keep their source as text."""

    def found(source: Column) -> Column:
        ref = F.regexp_extract(source, r"\(([^()]*)\)$", 1)
        kind = F.lit(None).cast("string")
        for name, extensions in KINDS.items():
            kind = F.coalesce(kind, F.when(ref.rlike(rf"\.(?:{extensions})$"), F.lit(name)))
        none = {"width": "int", "height": "int", "seconds": "double", "pages": "int"}
        return F.struct(kind.alias("kind"), source.alias("text"), ref.alias("ref"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))

    sources = F.transform(F.regexp_extract_all(text, F.lit(f"({MARKUP})"), 1), found)
    between = F.transform(F.split(text, MARKUP, -1), text_part)
    mixed = F.flatten(F.zip_with(between, sources, lambda t, a: F.when(a.isNull(), F.array(t)).otherwise(F.array(t, a))))
    return F.when(text.contains("]("), mixed).otherwise(F.array(text_part(text)))


def formatted(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: (id_col, formatted string, turns array<struct<begin, body, loss, attachments>>, n_expanded long).

    messages has a row for each message; parts is an array of PART, of kinds text, image, audio and document (any other kind,
    or none, is text). An attachment's own text, if any, is what it was written as and isn't shown. Turns come in the order of the
    turn, null first, then of role and formatted text. In turns, begin is where the turn begins in formatted, body where its
    text does; loss lists the ranges lo to hi of text that a loss counts, those of messages of the `trained` roles without
    their placeholders; attachments are (kind, ref, source, at, tokens). All places are code points in formatted.
    n_expanded: tokens of all attachments.

    A null role is an empty one; null parts and texts are empty; repeated rows are turns of their own; rows with a null id are one
    conversation; other columns are ignored; an empty table gives none. A conversation is one text, so its messages meet in one task.
    """
    rows = messages.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), visited(F.col(parts_col)).alias("v"))
    rows = rows.select("id", "turn", "role", "v", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("head"))
    rows = rows.withColumn("block", F.concat("head", F.col("v")["body"], F.lit(f"{END}\n")))
    order = Window.partitionBy("id").orderBy("turn", "role", "block")
    before = F.coalesce(F.sum(F.length("block").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("begin", before)
    at = F.col("begin") + F.length("head")
    loss = F.when(F.col("role").isin(*trained), F.transform(F.col("v")["runs"], lambda r: F.struct((r["lo"] + at).alias("lo"), (r["hi"] + at).alias("hi")))).otherwise(F.expr("array()").cast(_RUNS))
    attachments = F.transform(F.col("v")["attachments"], lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), a["source"].alias("source"), (a["at"] + at).alias("at"), a["tokens"].alias("tokens")))
    turn = F.struct(F.col("begin"), at.alias("body"), loss.alias("loss"), attachments.alias("attachments"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("no", "block", turn.alias("turn")))).alias("all"), F.sum(F.aggregate(F.col("v")["attachments"], F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])).alias("n_expanded"))
    return whole.select(F.col("id").alias(id_col), F.array_join(F.col("all")["block"], "").alias("formatted"), F.col("all")["turn"].alias("turns"), "n_expanded")


def _blocks(formatted_: Column) -> Column:
    """Each turn's text from behind its start to the next one's."""
    pieces = F.split(formatted_, r"<\|im_start\|>", -1)
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def read_turns(formatted_: Column, turns: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: roles and texts as they came, attachments as they were written."""

    def one(block: Column, turn: Column) -> Column:
        inner = F.substring(block, F.lit(1), F.length(block) - len(END) - 1)
        head = F.locate("\n", inner)
        texts = F.transform(F.split(F.substring(inner, head + 1, F.length(inner)), rf"<\|(?:{'|'.join(KINDS)})\|>", -1), unescaped)
        text = F.array_join(F.flatten(F.zip_with(texts, turn["attachments"]["source"], lambda t, s: F.array(t, F.coalesce(s, F.lit(""))))), "")
        return F.struct(_role_back(F.substring(inner, F.lit(1), head - 1)).alias("role"), text.alias("text"))

    return F.zip_with(_blocks(formatted_), turns, one)


def read_loss(formatted_: Column, turns: Column) -> Column:
    """array<string>: for each turn all text under the loss mask, unescaped."""

    def one(block: Column, turn: Column) -> Column:
        cut = turn["begin"] + len(START)
        return F.array_join(F.transform(turn["loss"], lambda r: unescaped(F.substring(block, (r["lo"] - cut + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")

    return F.zip_with(_blocks(formatted_), turns, one)


def messages_of(rows: DataFrame, role_col: str = "role", text_col: str = "text", plain: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """rows with a column parts: the text's own parts, or for the roles in `plain`, whose text is learned as it stands, one text part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.withColumn("parts", F.when(F.col(role_col).isin(*plain), F.array(text_part(text))).otherwise(let(text, text_parts)))
