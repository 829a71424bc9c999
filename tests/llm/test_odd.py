"""Nulls, repeats, ties, empty tables, long texts and columns whose names clash, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import fingerprint, langid, linededup, lmscore, mixing, neardup, pii, piece, substring
from foliant.llm.queries import tokenizer_path

EXTRA = ("id", "row", "key", "h", "line", "digest", "size", "size_", "seed", "component", "cluster", "base_", "word", "pair", "th", "no", "turn", "grp")


@pytest.fixture(scope="module")
def clashing(spark):
    long = "word " * 30_000 + "end"
    rows = [(None, "a b c d e f g", "en", None), (None, "a b c d e f g", "en", None), (1, None, None, "s"), (2, "", "en", "s"), (3, "One two three four five six seven.", "en", "s"), (3, "Another text of the same id, with a few words.", "fr", "t"), (3, "One two three four five six seven.", "en", "s"), (4, long, "en", "s"), (5, long, "en", "t"), (6, "one TWO three four five six seven.", None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(EXTRA)} | {"n_chars": F.length("text")})


def test_near_duplicates(spark, clashing):
    got = neardup.near_duplicates(clashing, size=2).collect()
    assert len(got) == clashing.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[None] == [(6, None, False)] * 2 and by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert sorted(by[3]) == [(6, 3, True), (6, 3, True), (9, 3, True)] and by[6] == [(6, 3, False)] and by[5][0][1:] == (4, False)
    assert neardup.near_duplicates(clashing.where("false")).count() == 0
    kept = neardup.keep_first(clashing, size=2)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(False, 1, ""), (False, 2, ""), (False, 3, "Anoth"), (False, 3, "One t"), (False, 4, "word "), (True, 0, "a b c"), (True, 0, "a b c")]


def test_every_row_stays(spark, clashing):
    n = clashing.count()
    none = clashing.where("false")
    model = pii.fit(clashing)
    good = spark.createDataFrame([(3,), (None,)], "doc_id long")
    for f in (
        lambda d: piece.encoded(d, tokenizer_path()),
        lambda d: fingerprint.fingerprinted(d),
        lambda d: lmscore.scores(d, good),
        lambda d: pii.find_spans(d, model),
        lambda d: mixing.plan(d),
        lambda d: linededup.without_repeats(d),
        lambda d: langid.predictions(d, langid.fit(d)),
    ):
        assert f(clashing).count() == n and f(none).count() == 0
    assert pii.find_spans(clashing, model).columns == [*clashing.columns, "base", "spans"]
    assert linededup.without_repeats(clashing).columns == clashing.columns == mixing.mixed(clashing).columns
    assert mixing.mixed(none).count() == 0 and substring.repeated_passages(none).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(None, "the same line of text\nand its own one here"), (1, "the same line of text\nsomething"), (1, "another text of one\nthe same line of text"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id is None, r.n_lines, r.n_exact, r.n_near, r.removed) for r in linededup.line_report(df).collect())
    assert got == [(False, 2, 1, 0, [0]), (False, 2, 1, 0, [1]), (True, 2, 0, 0, [])]


def test_passages_of_long_copies(spark, clashing):
    got = substring.repeated_passages(clashing).where("n_words > 1000").collect()
    assert {(r.id, r.other) for r in got} & {(5, 4), (4, 5)}


def test_rejection(spark):
    en = ["the quick brown fox jumps over the lazy dog and runs away from the house in the evening" + f" number {i}" for i in range(40)]
    fr = ["le renard brun saute par dessus le chien paresseux et quitte la maison dans la soirée" + f" numéro {i}" for i in range(40)]
    df = spark.createDataFrame([(i, t, "en" if i < 40 else "fr") for i, t in enumerate(en + fr)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    test = spark.createDataFrame([(1, "the fox runs away from the lazy dog"), (2, "le chien quitte la maison"), (3, "xqzj wvkk pqxz jjqk zzxw"), (4, "12 34"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.predictions(test, model).collect()}
    assert got[1] == ("en", True) and got[2] == ("fr", True) and not got[3][1] and got[4] == ("und", False) == got[5]
    assert sorted(r.doc_id for r in langid.accepted(test, model).collect()) == [1, 2]


def test_pipeline_stages(spark, clashing):
    docs = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name
        assert stage(spark, docs, "").count() >= 0, name
