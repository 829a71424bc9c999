"""The registered queries on whole small tables against plain Python or SQL."""

import glob
import hashlib
import os
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pyarrow.parquet as pq
import pytest

from foliant.llm import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def run(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    return rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equal_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    rows = run(spark, name)
    columns = rows[0].__fields__
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_op1_base(spark, docs):
    def luhn(d):
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return total % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15}
    got = {r.doc_id: r for r in run(spark, "op1_pii_spans")}
    assert len(got) == len(docs)
    for d in docs:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, d["text"] or "") if ok[k](m[0])]
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in spans) for k in patterns)
        assert set(spans) <= set(r.spans.split(","))


def _distance(a, b, most):
    """Edit distance, or anything above `most` where it is above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1 if j <= i + most - 1 else most + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    return row[-1]


def test_op2_removed_lines(spark, docs):
    lines = [(d["doc_id"], no, x) for d in docs for no, x in enumerate((d["text"] or "").split("\n")) if x.strip(" ")]
    texts = sorted({x for _, _, x in lines})
    near = {x: x for x in texts}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    by_size = {}
    for x in texts:
        by_size.setdefault(len(x), []).append(x)
    for n, group in by_size.items():
        for x in group:
            most = 0 if n < 10 else 1 if n < 20 else 2
            for m in range(max(8, n - most), n + 1):
                for y in by_size.get(m, []):
                    # one of three even parts of the shorter text lies in the other one near its place
                    if x != y and most and any(y[k * m // 3 : (k + 1) * m // 3] in x for k in range(3)) and _distance(x, y, most) <= most:
                        near[root(x)] = root(y)
    first, want = {}, Counter()
    removed = {}
    for i, no, x in sorted(lines):
        c = root(x)
        if c in first:
            removed.setdefault(i, []).append(no)
            want[i, "exact" if first[c] == x else "near"] += 1
        else:
            first[c] = x
    got = {r.doc_id: r for r in run(spark, "op2_line_dedup")}
    assert len(got) == len(docs)
    count = Counter(i for i, _, _ in lines)
    for i, r in got.items():
        assert (r.n_lines, r.n_exact, r.n_near) == (count[i], want[i, "exact"], want[i, "near"])
        assert (r.removed or "") == ",".join(map(str, removed.get(i, [])))


def test_op6_edited_texts(spark, docs):
    rows = sorted(docs, key=lambda d: d["doc_id"])
    got = {r.doc_id: r for r in run(spark, "op6_document_fingerprint")}
    for d, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, more = d["text"] or "", after["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + more[:half]
        r = got[d["doc_id"]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and (r.fingerprint != r.edited_fingerprint or r.near_edited == 1)
    near = sorted(r.near_edited for r in got.values())
    far = sorted(r.near_next for r in got.values())
    assert near[len(near) // 2] > 2 * far[len(far) // 2]


def test_op7_plan(spark, docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    of = Counter()
    for d in docs:
        of[d["source"]] += size[d["doc_id"]]
    sources = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    left, target, free = Fraction(sum(of.values())), {}, list(sources)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * of[s]]
        for s in over or free:
            target[s] = Fraction(3 * of[s]) if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in target]
    taken = Counter()
    rows = run(spark, "op7_mix_sources")
    source = {d["doc_id"]: d["source"] for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == of[s] and abs(r.target - float(target[s])) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - float(target[s])) <= 1 for s in sources)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op7_mix_sources")))


def test_op8_equals_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    for r in run(spark, "op8_sentencepiece"):
        ids = model.encode(next(d["text"] for d in docs if d["doc_id"] == r.doc_id) or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_op10_held_out(spark, docs):
    import zlib

    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = run(spark, "op10_language_id")
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.95 * len(own)
