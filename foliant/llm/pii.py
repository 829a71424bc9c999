"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Base spans come from four patterns with checks (e-mail, IP, card with Luhn, phone). Beside them three
high-recall generators propose spans that may overlap: disguised addresses, number-like runs and long
mixed tokens. Every candidate has a few small-valued features of its format and context. The corpus
teaches the model: a positive is a candidate that meets a base span, a mixed token that follows a word such as
`password`, an address with a bracketed `at` or after a word such as `mail`, or a number of 8 to 15 digits after
a word such as `call`; any other is a negative. All candidates of all texts are counted by their feature
cells, apart for one text of HELD and the others. The number of cells that occur is bounded by the features' values, whatever the
corpus, and more than MAX_CELLS are refused. Boosted regression trees
are fitted to the others' log odds, and each generator has the lowest score threshold above which its
positives among the held-out candidates reach PRECISION. Candidates over it that meet no base span are added.

Each pattern is looked for in the texts alone that have what it can't do without: a digit, an @, or an `at` written out.
A mail name of over 64 characters, a host label of over 63 and a number of over 42 are no candidates, though
they may be base spans.

The trees are CASE expressions, so that reading and scoring stay in the JVM; spans are found by splitting
a text at a pattern's matches, which gives all their places at once.
"""

from __future__ import annotations

from functools import partial
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of spans, in the order of results.
KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns. Possessive repeats and the guards in front give the same matches as
# the plain patterns, without backtracking over long runs: a match starts at the start of a run or where
# the match before it has ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[](?:at|At|AT)[)\]]|\x20(?:at|AT)\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[](?:dot|Dot|DOT)[)\]]|\x20(?:dot|Dot|DOT)\x20)\x20?[A-Za-z0-9-]{2,63}+)++",
    "phone": r"(?<![A-Za-z0-9])[+(]?[0-9][0-9().\x20/-]{5,40}[0-9](?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{14,}+(?![A-Za-z0-9_/+-])",
}
# An address candidate has an @, or an `at` like these before a host.
WRITTEN_AT = r"[(\[](?:at|At|AT)[)\]]|\x20(?:at|AT)\x20{1,2}[A-Za-z0-9-]{1,63}\x20?(?:\.|[(\[]|\x20?(?:dot|Dot|DOT)\x20)"
WORDS = {
    1: r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|reach)[^A-Za-z0-9]{0,8}+$",
    2: r"(?i)(?:card|visa|credit|iban|account|pay)[^A-Za-z0-9]{0,8}+$",
    3: r"(?i)(?:ip|host|addr|address|server)[^A-Za-z0-9]{0,8}+$",
    4: r"(?i)(?:password|passwd|pwd|token|secret|key)[^A-Za-z0-9]{0,8}+$",
}
CONTEXT = 24
PRECISION = 0.95
TREES, DEPTH, RATE = 24, 3, 0.3
#: Of so many texts one is held out for the thresholds.
HELD = 5
MAX_CELLS = 500_000
FEATURES = ("gen", "digits", "size", "plus", "paren", "marks", "at", "case", "word", "left", "right")


def matches(text: Column, pattern: str) -> Column:
    """Array of (b, e, m): places in code points, end exclusive, and text of the pattern's matches from the left."""
    # gap i comes before match i; the last gap has no match behind it
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<b:int,e:int,m:string>>))")

    def step(acc: Column, x: Column) -> Column:
        b = acc["at"] + F.length(x["g"])
        e = b + F.length(x["m"])
        grown = F.concat(acc["out"], F.array(F.struct(b.alias("b"), e.alias("e"), x["m"].alias("m"))))
        return F.struct(F.coalesce(e, b).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(grown).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _valid(kind: str, s: Column) -> Column:
    m = s["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"\A(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|\z)){4}\z")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _placed(kind: int, s: Column) -> Column:
    return F.struct(F.lit(kind).alias("k"), s["b"].alias("b"), s["e"].alias("e"))


def _with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _base (k, b, e) and _cand (FEATURES, b, e, y, base) of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<b:int,e:int,m:string>>)")
    rows = docs.withColumns({"_digit": text.rlike("[0-9]"), "_at": text.contains("@")})
    digit, at = F.col("_digit"), F.col("_at")
    base_gates = {"email": at, "ip": digit, "card": digit, "phone": digit & text.contains("+")}
    gates = {"email": at | text.rlike(WRITTEN_AT), "phone": digit, "secret": digit}
    rows = rows.withColumns({f"_b_{k}": F.when(base_gates[k], F.filter(matches(text, p), partial(_valid, k))).otherwise(none) for k, p in BASE.items()})
    rows = rows.withColumns({f"_g_{k}": F.when(gates[k], matches(text, p)).otherwise(none) for k, p in GENERATORS.items()})
    base = F.concat(*[F.transform(f"_b_{k}", partial(_placed, i)) for i, k in enumerate(BASE)])
    rows = rows.withColumn("_base", base)

    def features(gen: int, s: Column) -> Column:
        m, before = s["m"], F.substring(text, F.greatest(F.lit(1), s["b"] - CONTEXT + 1), F.least(F.lit(CONTEXT), s["b"]))
        count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
        lower, upper = m.rlike("[a-z]"), m.rlike("[A-Z]")
        case = F.when(lower & upper, 3).when(upper, 2).when(lower & m.rlike(r"\A[0-9a-f]++\z"), 4).when(lower, 1).otherwise(0)
        word = F.lit(0)
        for k, p in WORDS.items():
            word = F.when(before.rlike(p), k).otherwise(word)
        left = F.when(before == "", 0).when(before.rlike(r"[\x20\n\t]\z"), 1).when(before.rlike(r"[(\[\"'=:]\z"), 2).otherwise(3)
        after = F.substring(text, s["e"] + 1, F.lit(1))
        right = F.when(after == "", 0).when(after.rlike(r"[\s.,;)\]\"']"), 1).otherwise(2)
        hit = F.exists("_base", lambda b: (b["b"] < s["e"]) & (s["b"] < b["e"]))
        sure = F.lit(False)
        if gen == 0:
            sure = m.rlike(r"[(\[](?i:at)[)\]]") | ((word == 1) & m.rlike(r"(?i)[a-z]{2}\z"))
        if gen == 1:
            sure = (word == 1) & count("[0-9]").between(8, 15)
        label = hit | sure | ((word == 4) & F.lit(gen == 2)) | (F.lit(gen == 2) & m.rlike(r"\AAKIA[A-Z0-9]{16}\z"))
        values = [F.lit(gen), F.least(count("[0-9]"), F.lit(20)), F.least(F.floor((s["e"] - s["b"]) / 4), F.lit(16)).cast("int"), m.startswith("+").cast("int"), m.contains("(").cast("int"), F.least(count("[^A-Za-z0-9]"), F.lit(5)), m.contains("@").cast("int"), case, F.when(F.lit(gen == 2) & (word == 4), 0).otherwise(word), left, right]
        return F.struct(*[v.alias(n) for n, v in zip(FEATURES, values, strict=True)], s["b"].alias("b"), s["e"].alias("e"), label.alias("y"), hit.alias("hit"))

    return rows.withColumn("_cand", F.concat(*[F.transform(f"_g_{k}", partial(features, i)) for i, k in enumerate(GENERATORS)]))


Tree = tuple  # (feature, bound, low side, high side) or a leaf's float


class SpanModel:
    """Boosted trees over FEATURES and a score threshold for each generator."""

    def __init__(self, trees: list[Tree | float], bounds: list[float]):
        self.trees, self.bounds = trees, bounds

    def score(self, cell: dict[str, int]) -> float:
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if cell[node[0]] <= node[1] else node[3]
            total += node
        return total

    def column(self, c: Column) -> Column:
        """The score of a candidate struct."""

        def of(node: Tree | float) -> Column:
            return F.when(c[node[0]] <= node[1], of(node[2])).otherwise(of(node[3])) if isinstance(node, tuple) else F.lit(float(node))

        total = F.lit(0.0)
        for node in self.trees:
            total = total + of(node)
        return total


def _grow(cells: list[tuple[dict[str, int], float, float]], depth: int) -> Tree | float:
    """A regression tree on (cell, gradient, hessian), by second-order gain."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    leaf = RATE * g / (h + 1.0)
    if depth == 0 or len(cells) < 2:
        return leaf
    best = (1e-6, None, None)
    for f in FEATURES:
        sums: dict[int, list[float]] = {}
        for cell, dg, dh in cells:
            s = sums.setdefault(cell[f], [0.0, 0.0])
            s[0] += dg
            s[1] += dh
        lg = lh = 0.0
        for v in sorted(sums)[:-1]:
            lg, lh = lg + sums[v][0], lh + sums[v][1]
            gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, f, v)
    if best[1] is None:
        return leaf
    _, f, v = best
    return (f, v, _grow([c for c in cells if c[0][f] <= v], depth - 1), _grow([c for c in cells if c[0][f] > v], depth - 1))


def boost(cells: list[tuple[dict[str, int], int, int, int, int]]) -> SpanModel:
    """Fit to (cell, candidates, positives, held-out candidates, and positives): trees for the log odds, then thresholds
    that keep PRECISION among the held-out ones. Without held-out candidates a generator adds nothing."""
    score = [0.0] * len(cells)
    trees: list[Tree | float] = []
    for _ in range(TREES if cells else 0):
        p = [1 / (1 + exp(-s)) for s in score]
        trees.append(_grow([(c, y - n * q, n * q * (1 - q)) for (c, n, y, _, _), q in zip(cells, p, strict=True)], DEPTH))
        one = SpanModel(trees[-1:], [])
        score = [s + one.score(c) for s, (c, *_) in zip(score, cells, strict=True)]
    bounds = []
    for gen in range(len(GENERATORS)):
        own = sorted(((s, n, y) for s, (c, _, _, n, y) in zip(score, cells, strict=True) if c["gen"] == gen and n), reverse=True)
        bound, total, good = 1e9, 0, 0
        for i, (s, n, y) in enumerate(own):
            total, good = total + n, good + y
            if (i + 1 == len(own) or own[i + 1][0] < s) and good >= PRECISION * total:
                bound = s
        bounds.append(max(bound, log(PRECISION / (1 - PRECISION)) if bound < 1e9 else bound))
    return SpanModel(trees, bounds)


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """A model from all texts of docs; repeated rows count as often, null and empty texts add nothing, an empty table gives a
    model that adds nothing. The driver gets one row for each feature cell that occurs."""
    found = _with_spans(docs.select(text_col), text_col).select((F.pmod(F.xxhash64(text_col), F.lit(HELD)) == 0).alias("held"), F.explode("_cand").alias("c"))
    y = F.col("c.y")
    sums = [F.count_if(~F.col("held")).alias("n"), F.count_if(~F.col("held") & y).alias("y"), F.count_if("held").alias("hn"), F.count_if(F.col("held") & y).alias("hy")]
    cells = found.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(*sums)
    rows = sorted(cells.limit(MAX_CELLS + 1).collect(), key=lambda r: tuple(r))
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} feature cells")
    return boost([({f: r[f] for f in FEATURES}, r.n, r.y, r.hn, r.hy) for r in rows])


def find_spans(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (kind, b, e), in the order of KINDS, then by place.

    Places are code points, ends exclusive. base has the checked matches of BASE; spans has these and what
    the model adds. A null or empty text has none. Equal texts get equal spans; all rows and columns
    stay, but columns of docs that are named base or spans give way.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    rows = _with_spans(docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text")), "text")

    def passes(c: Column) -> Column:
        limit = F.lit(1e9)
        for gen, b in enumerate(model.bounds):
            limit = F.when(c["gen"] == gen, F.lit(b)).otherwise(limit)
        return ~c["hit"] & (model.column(c) >= limit)

    kind_of = F.create_map(*[F.lit(x) for i, k in enumerate(GENERATORS) for x in (i, KINDS.index(k))])
    added = F.transform(F.filter("_cand", passes), lambda c: F.struct(F.element_at(kind_of, c["gen"]).alias("k"), c["b"].alias("b"), c["e"].alias("e")))
    name = F.array(*[F.lit(k) for k in KINDS])
    named = lambda spans: F.transform(F.array_sort(F.array_distinct(spans)), lambda s: F.struct(F.get(name, s["k"]).alias("kind"), s["b"].alias("b"), s["e"].alias("e")))
    return rows.withColumn("_added", added).select("row.*", named(F.col("_base")).alias("base"), named(F.concat("_base", "_added")).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["e"].cast("string"))), ",")


def redacted(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with text_col's spans replaced by <KIND>; of overlapping spans the first one counts.

    Null texts stay null.
    """
    found = find_spans(docs, model, text_col)
    text = F.col(text_col)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), s["kind"].alias("kind"))))
    start = F.expr("named_struct('at', 0, 'out', '')")

    def step(acc: Column, s: Column) -> Column:
        skip = s["b"] < acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["b"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(skip, acc["at"]).otherwise(s["e"]).alias("at"), F.when(skip, acc["out"]).otherwise(piece).alias("out"))

    whole = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(text.isNotNull(), whole)).drop("base", "spans")
