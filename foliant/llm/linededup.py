"""Line dedup by a segment-partition edit join, in DataFrame expressions alone.

Lines of equal text are one line, told apart by 128 bits of hashes. Two different lines are near if their edit distance is at most
allowed(): 1 where the longer has NEAR_FROM characters or more, TAU from TWO_FROM on, else none. For
these, the join of Li, Deng and Feng (Pass-Join, 2012): each distinct line of length n is cut into TAU + 1 even
segments, indexed by (length, segment number, segment text); a line probes, for every length from n - TAU
to n, the few substrings that such a segment can have become (the multi-match-aware selection). Two lines
within TAU edits share an intact segment, so none is missed. Candidates whose counts of sixteen common
characters differ by more than 2 * TAU are none; the others lose the chunks that they begin and end with
in common, and are verified by a bit-parallel automaton over the band of 2 * TAU + 1 diagonals, first on a few
characters, where most others fall out of the band. Near lines form classes (connected components), and of each class the
first line in the order of (id, line number) stays.

Only hashes go through the join; the text of a line is fetched where it is in a candidate pair. A segment that very many
different lines share still meets as many lines in one place of the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import connected_components
from foliant.plans.scratch import materialize

TAU = 2
NEAR_FROM, TWO_FROM = 10, 20
#: Keys that a line is indexed by, and that it probes, these among them.
INDEXED, PROBED = TAU + 1, 12
#: Up to so many line hashes (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Characters that are compared at once where two lines begin or end alike, and those that are verified first.
CHUNK, FIRST = 16, 48
#: Characters whose counts are compared before texts are fetched.
_COUNTED = " eantoirhdsluw.b"


def _lines(docs: DataFrame) -> DataFrame:
    """(id, th, no, line, h, h2): the lines of docs(id, text) that hold more than white space; th: hash of the text."""
    rows = docs.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(F.trim("line") != "").withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """(start from 1, length) of each of the TAU + 1 segments of a line; the last ones are longer by one."""
    short = F.floor(length / (TAU + 1)).cast("int")
    longer = (length - short * (TAU + 1)).cast("int")
    out = []
    for i in range(TAU + 1):
        extra = F.greatest(F.lit(0), longer - (TAU + 1 - i))
        out.append((short * i + extra + 1, short + (longer >= TAU + 1 - i).cast("int")))
    return out


def _key(part: Column, segment: int, length: Column) -> Column:
    return F.xxhash64(part, length.cast("int") * (TAU + 1) + segment)


def _index(line: Column, n: Column) -> list[Column]:
    return [_key(F.substring(line, b, k), i, n) for i, (b, k) in enumerate(_segments(n))]


def _probes(line: Column, n: Column) -> list[Column]:
    """All but those that are keys of _index() too, which a line probes as well."""
    out = []
    for delta in range(TAU + 1):
        for i, (b, k) in enumerate(_segments(n - delta)):
            low = max(-i, delta - (TAU - i))
            high = min(i, delta + (TAU - i))
            out += [_key(F.substring(line, b + shift, k), i, n - delta) for shift in range(low, high + 1) if delta or shift]
    return out


def _counts(line: Column) -> Column:
    """Counts (mod 16) of the characters of _COUNTED, four bits each. Each is taken out of what the ones before it left,
    which grows short; equal parts of an expression are computed once."""
    total, left = F.lit(0).cast("long"), line
    for i, c in enumerate(_COUNTED):
        # lengths in bytes, as these characters have one each
        rest = F.replace(left, F.lit(c), F.lit(""))
        total = total.bitwiseOR(F.shiftleft((F.octet_length(left) - F.octet_length(rest)).cast("long").bitwiseAND(15), 4 * i))
        left = rest
    return total


def _apart(a: Column, b: Column) -> Column:
    """How far two _counts are apart at least; an edit moves them by two at most."""
    total = F.lit(0)
    for i in range(len(_COUNTED)):
        d = F.abs(F.shiftrightunsigned(a, 4 * i).bitwiseAND(15) - F.shiftrightunsigned(b, 4 * i).bitwiseAND(15))
        total = total + F.least(d, 16 - d)
    return total


def allowed(n: Column) -> Column:
    """Edits at which lines count as near, by the length of the longer one."""
    return F.when(n < NEAR_FROM, 0).when(n < TWO_FROM, 1).otherwise(TAU)


def _shared(x: Column, y: Column) -> Column:
    """Characters of the whole chunks that x and y begin with in common."""
    chunks = F.floor(F.least(F.length(x), F.length(y)) / CHUNK).cast("int")
    each = F.when(chunks > 0, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(each, lambda i: F.substring(x, i * CHUNK + 1, F.lit(CHUNK)) == F.substring(y, i * CHUNK + 1, F.lit(CHUNK)))
    return _let(F.array_position(same, False), lambda p: F.when(p == 0, chunks).otherwise(p - 1).cast("int") * CHUNK)


def _rest(x: Column, y: Column) -> Column:
    """(x, y) without these, turned round."""
    rest = lambda z, k: F.reverse(F.substring(z, k + 1, F.length(z)))
    return _let(_shared(x, y), lambda k: F.struct(rest(x, k).alias("x"), rest(y, k).alias("y")))


def within(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The rows of pairs whose texts x and y are at most allowed() edits apart; those with a null text are left out,
    two empty or equal texts are 0 apart, repeated rows stay.

    State r_d, a bit for each diagonal: the distance of the prefixes on it is at most d. All diagonals of a
    state move on together with each character of x.
    """
    band = (1 << (2 * TAU + 1)) - 1
    # bit d + TAU is diagonal d; at the start the distance on diagonal d >= 0 is d
    start = F.struct(F.lit(0).alias("i"), *[F.lit(sum(1 << (TAU + k) for k in range(d + 1))).alias(f"r{d}") for d in range(TAU + 1)])

    def step(ys: Column, acc: Column, c: Column) -> Column:
        same = F.lit(0)
        for d in range(-TAU, TAU + 1):
            at = acc["i"] + d
            hit = F.coalesce((at >= 0) & (F.get(ys, at) == c), F.lit(False))
            same = same.bitwiseOR(F.when(hit, 1 << (d + TAU)).otherwise(0))
        return _let(same, lambda same: F.struct((acc["i"] + 1).alias("i"), *_moved(acc, same, band)))

    def run(s: Column, xs: Column) -> Column:
        return F.aggregate(xs, start, lambda acc, c: step(s["ys"], acc, c))

    def reached(s: Column, end: Column) -> Column:
        on = [end[f"r{d}"].bitwiseAND(F.call_function("shiftleft", F.lit(1), F.size(s["ys"]) - F.size(s["xs"]) + TAU)) != 0 for d in range(TAU + 1)]
        most = allowed(F.greatest(F.length(x), F.length(y)))
        return F.when(most == 0, on[0]).when(most == 1, on[1]).otherwise(on[TAU])

    def chars(m: Column) -> Column:
        list_of = lambda z: F.filter(F.split(z, ""), lambda c: c != "")
        return F.struct(list_of(m["x"]).alias("xs"), list_of(m["y"]).alias("ys"))

    def verified(s: Column) -> Column:
        alive = F.size(s["xs"]) <= FIRST
        alive = alive | (run(s, F.slice(s["xs"], 1, FIRST))[f"r{TAU}"] != 0)
        return F.when(alive, _let(run(s, s["xs"]), lambda end: reached(s, end))).otherwise(False)

    middle = _let(_rest(F.col(x), F.col(y)), lambda m: _rest(m["x"], m["y"]))
    close = pairs.where(F.abs(F.length(y) - F.length(x)) <= TAU)
    return close.where(_let(_let(middle, chars), verified))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once: the optimizer copies an alias into each place, a lambda's variable not."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _moved(acc: Column, same: Column, band: int) -> list[Column]:
    new: list[Column] = []
    for d in range(TAU + 1):
        r = acc[f"r{d}"].bitwiseAND(same)
        if d:
            old = acc[f"r{d - 1}"]
            r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
        new.append(r)
    return [r.alias(f"r{d}") for d, r in enumerate(new)]


def near_lines(lines: DataFrame, node: str = "h") -> DataFrame:
    """(a, b): the different lines of lines(line, h) that are near, each pair once, a < b.

    h is a 64-bit hash of the line, node a column that names it for good, and that a and b are values of. Repeated lines
    are one; a null, empty or short line is near none; an empty table gives none.
    """
    lines = lines.select("line", "h", F.col(node).alias("node"))
    long = lines.where(F.length("line") >= NEAR_FROM - TAU)
    # keys are made before lines meet their copies, so that no text is shuffled and sorted; those of one line are equal
    keyed = long.select("h", "node", _counts(F.col("line")).alias("f"), _let(F.length("line"), lambda n: F.array(*_index(F.col("line"), n), *_probes(F.col("line"), n))).alias("keys"))
    names = [f"k{i}" for i in range(PROBED)]
    distinct = keyed.groupBy("h", "node").agg(F.max("f").alias("f"), *[F.max(F.get("keys", F.lit(i))).alias(c) for i, c in enumerate(names)])
    # both sides name all keys, so that they read the same shuffle
    first = lambda n: F.explode(F.slice(F.array(*names), 1, n)).alias("key")
    index = distinct.select("h", "f", first(INDEXED))
    probe = distinct.select(F.col("h").alias("ph"), F.col("f").alias("pf"), first(PROBED))
    close = (F.col("h") != F.col("ph")) & (_apart(F.col("f"), F.col("pf")) <= 2 * TAU)
    pairs = probe.join(index.hint("shuffle_hash"), (probe["key"] == index["key"]) & close)
    pairs = materialize(pairs.select(F.least("h", "ph").alias("a"), F.greatest("h", "ph").alias("b")).distinct(), "linepairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    if pairs.count() * 2 <= BROADCAST_HASHES:
        need = F.broadcast(need)
    texts = lines.join(need, "h", "left_semi").groupBy("h", "node").agg(F.first("line").alias("line"))
    x = texts.select(F.col("h").alias("a"), F.col("node").alias("p"), F.col("line").alias("x"))
    y = texts.select(F.col("h").alias("b"), F.col("node").alias("q"), F.col("line").alias("y"))
    return within(pairs.join(x, "a").join(y, "b")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_lines, n_exact, n_near, removed) for each text of docs that has a line with more than white space.

    th: xxhash64 of the text. n_lines: such lines. n_exact, n_near: those that repeat their class's first line, or another
    one of its class; first is by id, then th, then line number. removed: their numbers,
    ascending, from 0. A null id comes first. Texts that are null, empty or blank have no row. Rows of equal id
    and text are one document. An empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    lines = _lines(rows)
    node = F.struct("h", "h2").alias("node")
    links = materialize(near_lines(lines.select("line", "h", node), "node"), "lines")
    # where each distinct line comes first, and how often it comes
    place = F.struct("id", "th", "no")
    seen = materialize(lines.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")), "seen")
    classes = connected_components(links).select(F.col("id.h").alias("h"), F.col("id.h2").alias("h2"), F.col("component").alias("c"))
    if links.count() * 2 <= BROADCAST_HASHES:
        classes = F.broadcast(classes)
    seen = seen.join(classes, ["h", "h2"], "left")
    best = F.struct("first", "h", "h2")
    of_class = seen.where("c is not null").groupBy("c").agg(F.min(best).alias("best"))
    alone = seen.where("c is null and n > 1").select("h", "h2", best.alias("best"))
    repeated = materialize(seen.drop("n", "first").join(of_class, "c").select("h", "h2", "best").unionByName(alone), "repeated")
    if repeated.count() <= BROADCAST_HASHES // 4:
        repeated = F.broadcast(repeated)
    judged = lines.drop("line").join(repeated, ["h", "h2"]).where(~place.eqNullSafe(F.col("best.first")))
    exact = (F.col("h") == F.col("best.h")) & (F.col("h2") == F.col("best.h2"))
    gone = judged.distinct().groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_near"), F.array_sort(F.collect_list("no")).alias("removed"))
    full = F.size(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != ""))
    counted = rows.select("id", F.xxhash64("text").alias("th"), full.cast("long").alias("n_lines")).where("n_lines > 0").distinct()
    out = counted.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")]
    return out.select("id", "th", "n_lines", *zero, F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, each text without the lines that line_report() removes.

    A text all of whose lines repeat earlier ones becomes empty.
    """
    report = line_report(docs, id_col, text_col).where(F.size("removed") > 0)
    # the row travels as one value, so its names can't clash with others
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("digest"))
    joined = packed.join(report, F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("th")), "left")
    own = F.col("row")[text_col]
    kept = F.filter(F.split(own, "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), own).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
