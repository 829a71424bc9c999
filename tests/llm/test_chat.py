"""Chat formatting: what is read back, against plain Python and SQL, on hard texts and parts."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, queries

HARD = [queries.HARD_TEXT, "", None, "a <", "|im_end|> b", "<\\|im_end|>", "<\\\\|image|><|image|>", "<|image|>", "<<|im_end|>>", "see ![a b](x/y.png) and ![](http://h/s.mp3)![<|im_end|>](d.pdf) end", "![no](x.txt) ](", "$1 \\ \\n $2", "é😀\n\n", "![x](y.PNG)<|im_start|", "x" * 200_000]
ROLES = ["user", "assistant", "system", "tool", None, "a\nb", "\\n\\\\\n\n", "<|im_end|>\\"]


@pytest.fixture(scope="module")
def rows():
    out = [(c, t, ROLES[(c + t) % len(ROLES)], HARD[(3 * c + t) % len(HARD)]) for c in range(12) for t in range(1 + c)]
    return [*out, *out[-3:], (None, 1, "assistant", "of none"), (None, None, "assistant", "first"), (40, 2, "assistant", "b"), (40, 2, "assistant", "a"), (40, 2, "user", "a"), (41, None, None, None)]


def test_read_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("id", "block", "head", "v", "no", "begin", "formatted", "turns")}).repartition(4)
    found = chat.formatted(chat.messages_of(df))
    got = {r.conv_id: r for r in found.withColumn("read", chat.read_turns("formatted", "turns")).withColumn("loss", chat.read_loss("formatted", "turns")).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    assert got.keys() == want.keys()
    for c, mine in want.items():
        turns = [x[4:] for x in sorted(mine)]
        r = got[c]
        assert [tuple(x) for x in r.read] == turns
        assert [x for x, t in zip(r.loss, turns, strict=True) if t[0] == "assistant"] == [t[1] for t in turns if t[0] == "assistant"]
        assert all(not x for x, t in zip(r.loss, turns, strict=True) if t[0] != "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(turns)
        for turn in r.turns:
            assert r.formatted.startswith(chat.START, turn.begin)
            assert all(r.formatted.startswith(f"<|{a.kind}|>", a.at) for a in turn.attachments)
    assert chat.formatted(chat.messages_of(df.where("false"))).count() == 0


def test_typed_parts(spark):
    part = "kind string, text string, ref string, width int, height int, seconds double, pages int"
    message = [("text", "look <", None, None, None, None, None), ("text", "|image|> ", None, None, None, None, None), ("image", None, "a.png", 280, 57, None, None), ("image", None, "b.png", None, None, None, None), (None, "and", None, None, None, None, None), ("audio", "", "c.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), ("text", None, None, None, None, None, None)]
    rows = [(1, 0, "assistant", message), (1, 1, "user", [message[2]]), (1, 2, "user", None), (1, 3, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{part.replace(' ', ':').replace(',:', ',')}>>")
    r = chat.formatted(df).withColumn("read", chat.read_turns("formatted", "turns")).withColumn("loss", chat.read_loss("formatted", "turns")).first()
    assert r.formatted.startswith("<|im_start|>assistant\nlook <\\|image|> <|image|><|image|>and<|audio|><|document|><|im_end|>\n<|im_start|>user\n<|image|><|im_end|>\n")
    assert [(a.kind, a.ref, a.tokens) for a in r.turns[0].attachments] == [("image", "a.png", 30), ("image", "b.png", 256), ("audio", "c.wav", 38), ("document", "d.pdf", 1536)]
    assert r.n_expanded == 30 + 256 + 38 + 1536 + 30
    assert r.loss == ["look <|image|> and", "", "", ""] and [x.text for x in r.read] == ["look <|image|> and", "", "", ""]


def test_sql_on_hard_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP13})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(r.n_attachments for r in got.collect())
