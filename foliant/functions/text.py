"""Scalar text functions as Column expressions, with Unicode white space as Python defines it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the patterns of numbers and tokens.
WS = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as plain characters, and as a class whose first part turns letters away: the whole class is slow for each character.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = rf"[\x00-\x20\x7f-\uffff&&{WS}]"
#: White space that isn't one space already.
ODD_SPACES = rf"{SPACE}(?:{SPACE}+|(?<! ))"
#: What parts names in a text that is clean(): `,\s*|\s+and\s+|\s*&\s*`, other characters being turned away first.
NAME_END = "(?=[ ,&])(?:, ?| and | ?& ?)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NUMBER = r"(?U)(?<![\w])\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?%?(?![\w])"
#: The same numbers; places without a digit are turned away before what is in front of them is looked at.
FAST_NUMBER = NUMBER.replace("(?U)", r"(?U)(?=\d)")
TOKEN = r"(?U)\b[\w%.-]+\b"
AUDIT_NUMBER = r"(?U)\b\d+(?:\.\d+)?%?\b"
YEAR = r"(?:19|20)[0-9]{2}"
PUBLISHER = ("citation:", "academic editors:", "copyright:", "licensee", "published:", "received:", "accepted:", "https://www.mdpi.com", "https://creativecommons.org", "www.nature.com", "vol.:(0123456789)", "vol:.(1234567890)")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once: the optimizer copies an alias into each place, a lambda's variable not."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(c: Column | str, chars: str = SPACES) -> Column:
    """Without leading and trailing characters that are in `chars`."""
    return F.btrim(_col(c), F.lit(chars))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; single spaces, nearly all of them, aren't replaced."""
    return F.regexp_replace(_col(c), ODD_SPACES, " ")


def clean(c: Column | str) -> Column:
    """Runs of white space become one space, ends are stripped; null becomes empty."""
    return F.trim(collapse(F.coalesce(_col(c).cast("string"), F.lit(""))))


def normalize(c: Column | str) -> Column:
    """clean() in lower case."""
    return F.lower(clean(c))


def block_text(c: Column | str) -> Column:
    """Lines with blanks collapsed and stripped; blank lines go."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t](?:[ \t]+|(?<! ))", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def block_key(c: Column | str) -> Column:
    """Key of a block: white space collapses first, then punctuation goes."""
    return strip(F.regexp_replace(collapse(F.lower(_col(c))), r"(?U)[^\w\s]", ""))


def sentence_key(c: Column | str) -> Column:
    """Key of a sentence or reference: punctuation goes first, then white space collapses."""
    return strip(collapse(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\s]", "")))


def formula_text(c: Column | str) -> Column:
    return clean(F.regexp_replace(_col(c), "\x08", " "))


def formula_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), SPACE + "+|\x08", "")


def doi_key(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\Ahttps?://doi\.org/", ""), r"\Adoi:", "")


def title_text(c: Column | str) -> Column:
    return F.trim(F.rtrim(clean(c), F.lit("†‡")))


def heading_text(c: Column | str) -> Column:
    """"3. Title 3." becomes "3. Title" where both numbers agree."""
    pattern = r"\A([0-9]+(?:\.[0-9]+)*\.)\s+(.*?)\s+([0-9]+(?:\.[0-9]+)*\.)\z"
    text = clean(c)
    first, last = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)
    return F.when((first != "") & (first == last), F.concat_ws(" ", first, F.regexp_extract(text, pattern, 2))).otherwise(text)


def without_publisher_text(c: Column | str) -> Column:
    """Cut at each publisher phrase in turn, wherever it first occurs."""
    text = F.coalesce(_col(c), F.lit(""))
    for phrase in PUBLISHER:
        text = F.regexp_replace(text, rf"(?is)\Q{phrase}\E.*", "")
    return strip(text)


def year_of(c: Column | str) -> Column:
    """A year from 1900 to 2100: the value itself, or the first such number with 19 or 20 in its text."""
    text = _col(c).cast("string")
    whole = strip(text).try_cast("int")
    found = F.regexp_extract(text, f"({YEAR})", 1)
    return F.when(whole.between(1900, 2100), whole).otherwise(F.when(found != "", found.cast("int")))


def pdf_year(c: Column | str) -> Column:
    """Year of a PDF date such as D:20240501."""
    found = F.regexp_extract(_col(c), r"\AD:([0-9]{4})", 1)
    return F.when(found != "", found.cast("int"))


def metadata_year(c: Column | str) -> Column:
    """Year of a metadata value: that of a PDF date, else the first number that reads as one; a falsy value has none."""
    text = _col(c).cast("string")
    found = F.regexp_extract(text, rf"\b({YEAR})\b", 1)
    return F.coalesce(pdf_year(text), F.when(found != "", found.cast("int")))


def stated_year(c: Column | str) -> Column:
    """Year after Published, Accepted or Received."""
    found = F.regexp_extract(_col(c), rf"(?i)\b(?:Published|Accepted|Received)[^0-9]{{0,30}}({YEAR})", 1)
    return F.when(found != "", found.cast("int"))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def numbers(c: Column | str) -> Column:
    """Numbers in order, without thousands commas."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(FAST_NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def sentences(c: Column | str) -> Column:
    """Parts after . ! or ? and white space, before an ASCII capital or digit."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), rf"(?<=[.!?]){WS}+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def plain_sentences(c: Column | str) -> Column:
    """Parts after . ! or ? and white space."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), rf"(?<=[.!?]){WS}+"), lambda x: strip(x)), lambda x: x != "")


def lines(c: Column | str) -> Column:
    """Lines as Python's splitlines gives them."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def ordered_distinct(items: Column | str, key=F.lower) -> Column:  # noqa: ANN001
    """First of each key, in order; empty items go."""
    firsts = lambda items, keys: F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    some = F.filter(_col(items), lambda x: x.isNotNull() & (x != ""))
    return let(some, lambda items: let(F.transform(items, lambda x: key(x)), lambda keys: firsts(items, keys)))


def authors(c: Column | str) -> Column:
    """Names in "A & B" or "A and B", without index marks."""
    parts = lambda text: F.when(text.contains(" & "), F.split(text, " & ")).when(F.lower(text).contains(" and "), F.split(text, " and ")).otherwise(F.array(text))
    plain = F.transform(let(clean(c), parts), lambda x: strip(F.regexp_replace(x, r"[0-9]+[*†‡]*", ""), " ,.*"))
    return F.filter(plain, lambda x: x != "")


def metadata_authors(c: Column | str) -> Column:
    """Names in a PDF's author field."""
    return ordered_distinct(F.transform(F.split(clean(c), NAME_END), lambda x: strip(x)))


def clean_authors(items: Column | str) -> Column:
    return ordered_distinct(F.transform(_col(items), lambda x: strip(clean(x), " ,;.")))


def last_word(c: Column | str) -> Column:
    """Last word in lower case, after what isn't an ASCII letter at the end is cut. Found from the text's end."""
    return F.lower(F.regexp_extract(F.coalesce(_col(c), F.lit("")), rf"(?s)\A(?:.*{WS})?([^{WS[1:-1]}]*[a-zA-Z])", 1))


def last_clean_word(c: Column) -> Column:
    """last_word() of a text that is clean(): the end alone is looked at."""
    return F.lower(F.regexp_extract(c, r"(?s)\A(?:.* )?([^ ]*[a-zA-Z])", 1))


def length_score(n: Column) -> Column:
    return F.when(n >= 500, 1.0).when(n >= 300, 0.95).when(n >= 200, 0.85).when(n >= 100, 0.70).when(n > 0, 0.40).otherwise(0.0)
