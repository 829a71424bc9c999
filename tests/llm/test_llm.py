import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import fingerprint, langid, linededup, lmscore, mixing, neardup, pii, piece, substring, topk
from foliant.llm.components import connected_components
from foliant.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi".split()) + str(r.randrange(40)) for _ in range(n)]


def odd_docs(spark):
    """Null and empty texts, nulls in each column, a repeated row, a long text."""
    long = " ".join(words(3000, 1))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (4, "One two three.", "en", "a", 14), (4, "One two three.", "en", "a", 14), (5, long, "en", "b", len(long)), (6, long, None, "b", None), (7, "é😀 ñ", "es", "c", 4)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (2, 2), (7, 8), (9, 8)], "a long, b long")
    assert {r.id: r.component for r in connected_components(edges).collect()} == {4: 4, 5: 4, 7: 4, 8: 4, 9: 4, 1: 1, 2: 1}
    assert connected_components(edges.where("false")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(2)
    texts = [words(60, i) for i in range(12)]
    for i in range(90):
        base = list(texts[r.randrange(4)])
        for _ in range(r.randrange(0, 9)):
            base[r.randrange(len(base))] = "w" + str(r.randrange(10**6))
        texts.append(base)
    texts = [" ".join(x) for x in texts] + ["", None, "Lone", "lone", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in neardup.near_duplicates(df, size=2).collect()}

    def of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])

    sets, root = [of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {i: (x.component_id, x.n_shingles) for i, x in got.items()} == {i: (find(i), len(sets[i])) for i in range(len(texts))}


def test_bucket_that_is_large_in_one_part_ties_all(spark):
    import pyarrow as pa

    half = np.arange(24, dtype=np.uint64).tobytes()
    spots = [(1, 0), (2, -1), (3, 0xFFFF), (4, 1), (5, 2), (6, 3)], [(7, 0x5555555555555555)]
    parts = [pa.RecordBatch.from_pydict({"id": [i for i, _ in p], "halves": [half] * len(p), "sketch": pa.array([s for _, s in p], pa.int64()), "component": [i for i, _ in p], "cluster": [i for i, _ in p], "sizes": [10 << 32 | 10] * len(p), "usual": [0] * len(p)}) for p in spots]
    rows = [x for p in parts for x in neardup._bucket_rows(iter([p]))]
    edges = [e for b in neardup._bucket_edges(iter(rows)) for e in b.to_pylist()]
    assert any(7 in (e["a"], e["b"]) and e["big"] for e in edges)


def test_line_join_equals_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abc dé") for _ in range(r.randrange(6, 40))) for _ in range(20)]
    lines = set(base)
    for _ in range(120):
        s = list(r.choice(base))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(s))
            s[i : i + r.randrange(2)] = r.choice(["", "x", "é"])
        lines.add("".join(s))
    lines = sorted(x for x in lines if x.strip())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def most(n):
        return 0 if n < 10 else 1 if n < 20 else 2

    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    name = {x.h: x.line for x in df.collect()}
    got = {tuple(sorted((name[x.a], name[x.b]))) for x in linededup.near_lines(df).collect()}
    assert got == {(a, b) for i, b in enumerate(lines) for a in lines[:i] if abs(len(a) - len(b)) < 3 and distance(a, b) <= most(max(len(a), len(b)))}


def test_lines_of_no_pair_are_not_shuffled(spark):
    r = random.Random(68)
    df = spark.createDataFrame([(i, r.randbytes(10_000).hex()) for i in range(100)], "doc_id long, text string")
    before = written(spark)
    assert linededup.line_report(df).agg(F.sum("n_exact"), F.sum("n_near")).first() == (0, 0)
    assert sum(n for k, n in written(spark).items() if k not in before) < 0.3 * 100 * 20_000


def test_lines_go_once(spark, odd, none):
    df = spark.createDataFrame([(2, "x\nthis line is here twice or so\ny", 1), (1, "this line is here twice or so\n\nz", 1), (3, "this line is here twica or so", 1), (4, None, 1)], "doc_id long, text string, _id int")
    got = {r.doc_id: r.text for r in linededup.without_repeats(df).collect()}
    assert got == {1: "this line is here twice or so\n\nz", 2: "x\ny", 3: "", 4: None}
    assert linededup.without_repeats(odd).count() == 8 and linededup.without_repeats(none).count() == 0


def test_pii_base_equals_plain_patterns(spark, odd, none):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    texts = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (578) 555-6437 +44 20 7946 0958. +1", "é😀 bob@x.org", "9" * 30000, " ".join(["1" * 40] * 50), "a" * 9000 + "@x.yy", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(df, pii.fit(df)).collect():
        assert [(s.kind, s.b, s.e) for s in r.base] == [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, texts[r.doc_id] or "") if ok(m[0])]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert pii.find_spans(odd, pii.fit(odd)).count() == 8 and pii.find_spans(none, pii.fit(none)).count() == 0
    cut = pii.redacted(spark.createDataFrame([("é bob@x.org, 1.2.3.4",), (None,)], "text string"), pii.boost([])).collect()
    assert [r.text for r in cut] == ["é <EMAIL>, <IP>", None]


def test_pii_adds_disguised_addresses_and_plain_numbers(spark):
    texts = [f"write to bob{i} (at) mail{i % 7}x (dot) com today" for i in range(150)] + [f"call: 555-{100 + i}-{4000 + i} now" for i in range(150)] + [f"in {1000 + i} 20 30 we saw {i}" for i in range(150)]
    texts.append("password: " + "aB3_" * 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.b : s.e]) for s in r.spans] for r in pii.find_spans(df, pii.fit(df)).collect()}
    assert got[3] == [("email", "bob3 (at) mail3x (dot) com")] and got[153] == [("phone", "555-103-4003")] and got[303] == []
    tokens = pii._with_spans(df.where("doc_id = 450"), "text").select(F.explode("_cand").alias("c")).where("c.gen = 2").select("c.b", "c.e", "c.y").collect()
    assert [tuple(t) for t in tokens] == [(10, 250, True)]


def test_passages(spark, odd, none):
    shared = words(70, 9)
    fuzzy = [*shared[:30], "other", *shared[31:]]
    rows = [(1, " ".join(words(50, 1) + shared + words(20, 2))), (2, " ".join(words(10, 3) + fuzzy)), (3, " ".join(words(300, 4))), (4, None), (5, " ".join(words(300, 4)))]
    got = {(r.id, r.other): r for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 2), (2, 1), (5, 3)}
    assert (got[1, 2].begin_word, got[1, 2].end_word, got[1, 2].other_begin) == (50, 120, 10) and got[1, 2].identity > 0.95
    assert {(r.id, r.other) for r in substring.repeated_passages(odd).collect()} == {(6, 5)}
    assert substring.repeated_passages(none).count() == 0


@pytest.mark.parametrize("gap", [100, 200])
def test_chain_is_cut_into_its_good_parts(spark, gap):
    one, two = words(60, 21), words(60, 22)
    rows = [(i, " ".join(words(15 * i, 30 + i) + one + words(gap, 40 + i) + two + words(10, 50 + i))) for i in (1, 2)]
    got = {(r.id, r.begin_word, r.end_word, r.other, r.other_begin, r.other_end, r.identity) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spots = {i: [(15 * i, 15 * i + 60), (15 * i + 60 + gap, 15 * i + 120 + gap)] for i in (1, 2)}
    assert got == {(i, *spots[i][k], 3 - i, *spots[3 - i][k], 1.0) for i in (1, 2) for k in (0, 1)}


def test_parts_of_blocks():
    runs = np.array([(0, 0, 40), (60, 60, 40), (300, 200, 60), (365, 270, 10), (600, 700, 30)])
    assert substring.parts(runs) == [(0, 100, 0, 100, 80), (300, 360, 200, 260, 60)]
    assert substring.parts(runs[:0]) == []


def test_passages_of_frequent_seeds(spark):
    """Two documents in the middle share a passage whose every seed is frequent before and behind them."""
    shared = words(50, 60)
    bits = [shared[i : i + 24] for i in range(0, 27, 2)]
    rows = [(k * 100 + i, " ".join(words(30, 1000 * k + i) + bit + words(30, 2000 * k + i))) for k in (1, 9) for i, bit in enumerate(bits)]
    rows += [(500 + i, " ".join(words(20, 70 + i) + shared + words(20, 80 + i))) for i in (1, 2)]
    # one word of every eight is another
    fuzzy = words(96, 61)
    rows += [(601, " ".join(fuzzy)), (602, " ".join(["other" if i % 8 == 7 else x for i, x in enumerate(fuzzy)]))]
    got = {(r.id, r.other, r.n_words) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, o) for i, o, _ in got} == {(501, 502), (502, 501), (601, 602), (602, 601)}
    assert all(n >= 50 for *_, n in got)


def test_every_tie_of_frequent_seeds(spark, monkeypatch):
    """Two documents in the middle share a fuzzy passage whose every seed is frequent before and behind them."""
    monkeypatch.setattr(substring, "TIES_AT_ONCE", 50)
    base = words(120, 62)
    rows = [(k * 100 + i, " ".join(words(30, 3000 * k + i) + base[2 * i : 2 * i + 24] + words(30, 4000 * k + i))) for k in (1, 9) for i in range(48)]
    one = base[30:90]
    two = ["other" if i % 10 == 9 else x for i, x in enumerate(one)]
    rows += [(501, " ".join(words(20, 71) + one)), (502, " ".join(two + words(20, 72)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.other): (r.begin_word, r.other_begin, r.n_words) for r in substring.repeated_passages(df, every=True).collect()}
    assert set(got) == {(501, 502), (502, 501)}
    assert got[501, 502][:2] == (20, 0) and got[502, 501][:2] == (0, 20) and got[501, 502][2] >= 50


def test_passages_of_repeated_ids_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """Copies, a repeated row, an id of several texts, and runs of frequent seeds."""
    a, b = words(70, 63), words(80, 64)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (4, a[:60] + words(30, 65)), (5, words(90, 66))] + [(100 + i, words(9, 90 + i) + b[5:75]) for i in range(12)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    found = []
    for limit in (substring.BROADCAST_IDS, 0):
        monkeypatch.setattr(substring, "BROADCAST_IDS", limit)
        found.append(sorted(substring.repeated_passages(df).collect()))
    assert found[0] == found[1]
    pairs = {(r.id, r.other) for r in found[0]}
    assert {(2, 1), (4, 1), (1, 4), (3, 2), (100, 2), (111, 2), (2, 111)} <= pairs and not any(5 in p for p in pairs)


def written(spark):
    """Bytes of shuffle by stage of the session."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    numbers = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    none = spark.sparkContext._jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(none, False, False, numbers, none)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}


def test_texts_without_passages_are_not_shuffled(spark):
    r = random.Random(67)
    rows = [(i, " ".join(r.randbytes(50).hex() for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = written(spark)
    assert substring.repeated_passages(df).count() == 0
    after = written(spark)
    assert sum(n for k, n in after.items() if k not in before) < 0.1 * sum(len(x) for _, x in rows)


def test_a_run_stands_for_its_anchors():
    """A run's tie gives the chain that anchors at its places give, in any order and repeated."""
    tied = np.array([(1, 2, i, -1 - (i + 7)) for i in (3, 4, 9)] + [(1, 2, 80, 90)])
    plain = np.array([(1, 2, i + k, i + k + 7) for i in (9, 3, 4, 4) for k in (0, 15, 30, 45)] + [(1, 2, 80, 90)])
    got = substring._chain_rows(tied).to_pylist()
    assert got == substring._chain_rows(plain).to_pylist() and (got[0]["lo"], got[0]["olo"]) == (3, 10)


def test_a_pair_fills_whole_batches_of_anchors():
    """One pair's anchors go on over batches that hold no other pair."""
    names = ["id", "other", "pos", "opos"]
    rows = [(1, 2, i, i + 7) for i in range(0, 90, 3)] + [(1, 3, i, i) for i in range(0, 60, 3)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def found(size):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        parts = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names) for part in cut]
        return [r for x in substring._chains(iter(parts)) for r in x.to_pylist()]

    whole = found(1000)
    assert [(r["id"], r["other"], r["lo"], r["hi"], r["olo"], r["ohi"]) for r in whole] == [(1, 2, 0, 92, 7, 99), (1, 3, 0, 62, 0, 62)]
    assert all(found(size) == whole for size in (1, 4, 10, 30, 45))


def test_members_of_a_chance_cluster_meet_where_they_can_be_linked(spark):
    """Short texts that chance has put in one cluster: few pairs meet, but all linked ones do, of an id with two texts too."""
    texts = {i: " ".join(["the of", *words(12 + i % 9, 500 + i), "and the"]) for i in range(300)}
    rows = list(texts.items()) + [(1000 + i, texts[i] + " more") for i in range(0, 300, 10)] + [(2000, "some other words here"), (2000, texts[7] + " end")]
    known = spark.createDataFrame(rows, "id long, text string")
    reps = neardup.signatures(known, 2)
    coarse = known.select("id", F.lit(0).cast("long").alias("component")).distinct()
    member = neardup._meeting(neardup._placed(coarse, coarse.limit(0), reps, known, 2, 80)).collect()
    spots = {r.id: set(r.prefix) for r in member}
    sets = [(i, set(zip(x.split(), x.split()[1:], strict=False))) for i, x in rows]
    near = {(i, o) for i, x in sets for o, y in sets if i < o and 100 * len(x & y) >= 80 * len(x | y)}
    met = {(i, o) for i in spots for o in spots if i < o and spots[i] & spots[o]}
    assert (7, 2000) in near and len(near) > 30 and near <= met and len(met) < 0.2 * len(spots) ** 2 / 2
    # a cluster whose members all share their rarest shingles: all odd ones meet all members
    alike = spark.createDataFrame([(i, "a b c d") for i in range(9)], "id long, text string")
    dense = neardup._placed(alike.select("id", F.lit(0).cast("long").alias("component")), coarse.limit(0), neardup.signatures(alike, 2), alike, 2, 80)
    assert all(r.prefix is None for r in neardup._meeting(dense).collect())


def test_chains_are_collinear():
    x, y = np.array([0, 20, 40, 60]), np.array([5, 25, 300, 65])
    best = substring.chain(x, y)[0]
    assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(best, best[1:], strict=False))


@pytest.mark.parametrize(("shard", "block"), [(8192, 4096), (64, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(300, 8)), np.tile(r.normal(size=8), (200, 1))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (950, [float("nan")] * 8), (960, [None] * 8)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(q.query_id, q.rank, q.vec_id, q.score) for q in topk.top_k(v.where("id % 50 = 0"), v, 5).orderBy("query_id", "rank").collect()]
    z = np.floor(x * 256).astype(np.int64)
    want = []
    for q in range(0, 500, 50):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(500), -s)) if i != q][:5]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert got == want
    assert topk.top_k(v.where("false"), v).count() == 0


def test_fingerprints(spark, odd, none):
    texts = ["abc" * 200, "", "abc" * 199 + "abd", "zyx" * 400, "é😀" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprint.fingerprinted(df).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprints([t])[0]
    assert fingerprint.likeness(got[0].fingerprint, got[2].fingerprint) > 0.9
    assert fingerprint.fingerprinted(odd).count() == 8 and fingerprint.fingerprinted(none).count() == 0


def test_fingerprints_of_null_ids(spark):
    rows = [(None, "first text"), (0, "x" * 9), (None, "another"), (5, None)]
    got = fingerprint.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 0), (False, 9), (True, 7), (True, 10)]
    edited = {r.n_chars: r.edited_sha256 for r in got}
    assert edited[10] == hashlib.sha256(b"first" + b"x" * 5).hexdigest()


def test_near_texts_equal_brute_force(spark):
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh ") for _ in range(1500))
    texts = [base[:i] + "#" + base[i + 1 :] for i in range(100, 1300, 100)] + ["".join(r.choice("abcdefgh ") for _ in range(1500)) for _ in range(4)]
    prints = fingerprint.fingerprints(texts)
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and fingerprint.likeness(prints[a], prints[b]) >= 0.9}
    got = {(x.a, x.b) for x in fingerprint.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=0.9).collect()}
    assert got == want and any(a > 0 for a, _ in want)


def test_mixing(spark, odd, none):
    rows = [(i, " ".join(words(5 + i % 40, i)), "en", None if i % 7 == 0 else f"s{i % 4}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan(df).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in plan)
    taken = {}
    for r in plan:
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in taken.values())
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in plan)
    assert mixing.plan(odd).count() == 8 and mixing.plan(none).count() == 0
    assert mixing.targets([10, 1, 0], [1, 2, 3]) == [8, 3, 0]
    assert mixing.apportion([53, 24, 23], 7, [9, 9, 9]) == [3, 2, 2]


def test_small_sources_of_a_large_corpus_are_mixed(spark):
    # 17,000,000 words beside sources of 20 and 100 words
    rows = [(i, "word " * 10_000, "en", "a", 0) for i in range(1700)] + [(5000 + i, "word " * (20 if i % 2 else 100), "en", f"s{i}", 0) for i in range(12)]
    taken = {}
    for r in mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.taken <= 3 * r.size
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert len(taken) == 13 and all(abs(a - b) <= 1 for a, b in taken.values())


def test_pieces_equal_the_library(spark, odd, none):
    import sentencepiece

    path = tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = ["", None, " ", "  a  b ", "a▁b", "x<s>y", "\0a", "日本語", "aaaaaaa", "x" * 7 + " " * 33 + "y", "a" * 2000]
    texts += ["".join(r.choice("aeinrst  thé日\n!.▁1") for _ in range(r.randrange(1, 90))) for _ in range(400)]
    ids = piece.encode(texts, path)
    assert ids == [sp.encode(t or "") for t in texts]
    assert piece.decode(ids, path) == [sp.decode(i) for i in ids]
    got = {x.doc_id: x for x in piece.encoded(odd, path).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[5].ids == sp.encode(odd.where("doc_id = 5").first().text)
    assert piece.encoded(none, path).count() == 0


def test_scores(spark, odd, none):
    good = spark.createDataFrame([(5,), (5,), (None,), (99,)], "doc_id long")
    rows = lmscore.scores(odd, good).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and got[1].score is None and got[2].n_words == 0 and got[3].n_words == 0 and got[4].n_words == 3
    assert lmscore.scores(none, good).count() == 0
    nothing = lmscore.scores(odd, good.where("false")).collect()
    assert len(nothing) == 8 and all(np.isfinite(r.target_loss) for r in nothing if r.n_words)


def test_scores_equal_exact_counts(spark):
    """Every pair of words has a count of its own; a document's own pairs don't count for it."""
    from collections import Counter

    texts = ["a b a c", "b c d", "A b", "x9 ñandú a b"] + ["the same " + " ".join(f"w{(i * 7919 + k * k) % 300007}" for k in range(1000)) for i in range(40)]
    texts += ["again again " * 70_000, "again again again"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 46, 2)], "doc_id long")
    kinds = ["\0"] + list("abcdefghijklmnopqrstuvwxyz") + ["9"]

    def spell(w):
        out = []
        for c in w.encode():
            out.append(kinds.index(chr(c)) if c < 128 and chr(c) in kinds else 27 if 48 <= c < 58 else 28 + (c - 128) // 4 if c >= 128 else 60)
        return [0, 0, *out, 0]

    sizes = Counter({27: 10, 60: 128 - 26 - 10 - 6} | {28 + k: 4 for k in range(32)})
    pairs, grams, context = ([Counter(), Counter()] for _ in range(3))
    split = [t.lower().split() for t in texts]
    for i, w in enumerate(split):
        for m in (0, 1) if i % 2 == 0 else (1,):
            pairs[m].update(zip(["", *w], w, strict=False))
            for x in w:
                s = spell(x)
                grams[m].update(zip(s, s[1:], s[2:], strict=False))
                context[m].update(zip(s[:-2], s[1:-1], strict=True))

    def spelled(m, x):
        s = spell(x)
        return sum(np.log2((grams[m][a, b, c] + 0.5) / (context[m][a, b] + 32)) - (np.log2(sizes[c]) if sizes[c] else 0) for a, b, c in zip(s, s[1:], s[2:], strict=False))

    def loss(m, i):
        own = Counter(zip(["", *split[i]], split[i], strict=False))
        less = own if m == 1 or i % 2 == 0 else Counter()
        total = 0
        for (a, b), n in own.items():
            share = (pairs[m][a, b] - less[a, b]) / pairs[m].total()
            total -= n * np.log2(0.6 * share + 0.4 * 2 ** ((spelled(m, a) if a else 0) + spelled(m, b)))
        return total / own.total()

    got = {r.doc_id: r for r in lmscore.scores(df, good).collect()}
    assert len(got) == len(texts)
    for i in (0, 1, 2, 3, 4, 5, 20, 43, 44, 45):
        assert got[i].n_words == len(split[i])
        assert abs(got[i].target_loss - loss(0, i)) < 0.02 and abs(got[i].background_loss - loss(1, i)) < 0.02
        assert abs(got[i].score - loss(0, i) + loss(1, i)) < 0.02


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    got = langid.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out("doc_id")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    empty = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(odd, model).collect()}
    assert empty[1] == empty[2] == empty[3] == ("und", 0.0)
    assert langid.predictions(none, langid.fit(none)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "n_tokens"} <= set(out.columns) and out.count() > 0.5 * docs.count()


@pytest.mark.parametrize("one_id", [None, 7])
def test_language_sample(spark, monkeypatch, one_id):
    """With null ids, one repeated id and repeated rows no language falls out of the sample."""
    words = {"en": "the cat sat on a mat and ate", "fr": "le chat est sur la table et il mange"}
    rows = [(one_id, f"{words[lang]} {'abcdefghij'[i % 10]}{'klmnop'[i % 6]} {i}", lang) for lang in words for i in range(300)]
    rows += [(i, "der Hund schl\u00e4ft", "de") for i in range(1)] + [(one_id, "gatto nero", "it")] * 500 + [(i, "12 34", "xx") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE", 20)
    model = langid.fit(docs)
    assert sorted(set(model.langs)) == ["de", "en", "fr", "it"]
    assert model.langs.count("it") == 1
    got = langid.predictions(docs.where("lang <> 'xx'").select("doc_id", "text", "lang"), model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 300, "fr": 300, "de": 1, "it": 500}
