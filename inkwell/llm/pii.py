"""Operator 5: personal data by candidate gradient boosting; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base scan, written so that they never try a run of characters twice: where a match of the plain
# pattern can only begin at the head of a run, or where the last match ended, nothing else is tried; possessive
# repetitions stand where giving back could not help. Cards are the runs of 16 to 19 digits only.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be worth a try.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# High-recall generators beside them: written-out addresses and local telephone numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.(-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])",
}
WIDE_HINTS = {"email": "at", "phone": None}
# Near misses of the wide forms, from which the trees learn what is no personal data: signs without a domain, and
# grouped numbers that are no telephone number, as dates and part numbers are.
MISSES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@(?![A-Za-z0-9-]+\.[A-Za-z0-9-])",
    "phone": r"(?<![0-9+.(-])(?<![0-9] )(?!\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9]))"
    r"[0-9]{1,5}+[ .-][0-9]{1,5}+[ .-][0-9]{1,5}+(?![ .-]?[0-9])",
}
CONTEXT = 32  # characters before a candidate that features look at
CUES = r"(?i)mail|phone|tel|call|contact|reach|fax|mobile|card|visa|credit|account|pay|host|server|addr|ip\b"
FEATURES = ("wide", "cue", "separators", "long", "letters", "grouped", "after_space")
CHUNK = 64  # matches whose places are summed up in one fold
_MATCH = "struct<n:int,c:string,v:string>"
_SPAN = "array<struct<s:int,v:string,c:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost matches v that don't overlap, each with the length n and the end c of the gap before it; after the last, a null one."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("c")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(gaps, found, lambda g, v: F.struct(g["n"].alias("n"), g["c"].alias("c"), v.alias("v")).cast(_MATCH))


def _found(text: Column, pattern: str) -> Column:
    """The matches with their starts in code points.

    Matches and the gaps between them alternate, so running lengths give the starts. They are summed up in chunks, the
    chunks' own sums first: a fold copies what it has gathered at each step, so none gathers all matches of a long text.
    """

    def size(x: Column) -> Column:
        return x["n"] + F.coalesce(F.length(x["v"]), F.lit(0))

    def running(items: Column, start: Column, step: Callable[[Column], Column], kind: str, out: Callable[[Column, Column], Column]) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))
        one = lambda acc, x: F.struct((acc["at"] + step(x)).alias("at"), F.array_append(acc["out"], out(acc["at"], x)).alias("out"))
        return F.aggregate(items, begin, one, lambda acc: acc["out"])

    def span(at: Column, x: Column) -> Column:
        return F.struct((at + x["n"]).alias("s"), x["v"].alias("v"), x["c"].alias("c"))

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + size(x)))
        starts = running(sums, F.lit(0), lambda n: n, "array<int>", lambda at, _: at)
        return F.flatten(F.zip_with(parts, starts, lambda p, at: running(p, at, size, _SPAN, span)))

    def in_chunks(m: Column) -> Column:
        last = F.floor((F.size(m) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(m, i * CHUNK + 1, F.lit(CHUNK)))

    return F.filter(_let(_let(_matches(text, pattern), in_chunks), placed), lambda x: x["v"].isNotNull())


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _small(part: Column) -> Column:
    p = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


def valid(kind: str, v: Column) -> Column:
    """Whether a match of the base pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _small)
    if kind == "card":
        return F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def _features(kind: str, wide: bool, x: Column) -> Column:
    v, c = x["v"], x["c"]
    bits = [F.lit(wide), c.rlike(CUES), v.rlike("[ ().-]"), F.length(v) >= 14, v.rlike("[A-Za-z]"), v.rlike("[0-9]{3}[ ).-]{1,2}[0-9]{3,}"), (c == "") | c.rlike(r"[\s(:\[]$")]
    return sum((b.cast("int") * F.lit(1 << i) for i, b in enumerate(bits)), F.lit(KINDS.index(kind) << len(FEATURES)))


def _candidate(kind: str, wide: bool):
    k = KINDS.index(kind)
    return lambda x: F.struct(
        F.lit(k).alias("k"),
        x["s"].alias("s"),
        (x["s"] + F.length(x["v"])).alias("e"),
        F.lit(not wide).alias("base"),
        (F.lit(False) if wide else valid(kind, x["v"])).alias("ok"),
        _features(kind, wide, x).alias("f"),
    )


def _worth(text: Column, kind: str, wide: bool) -> Column:
    """Whether a text can hold a match of the kind's pattern at all."""
    hint = (WIDE_HINTS if wide else HINTS)[kind]
    if wide and kind == "email":
        return text.rlike(r"[(\[]at[)\]]")
    if hint is None:
        return text.rlike("[0-9]")
    return F.contains(text, F.lit(hint)) & text.rlike("[0-9]") if kind == "ip" else F.contains(text, F.lit(hint))


def candidates(text: Column) -> Column:
    """Array of (k kind, s start, e end, base, ok, f features) of all generators; spans of different ones may overlap."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    out = []
    for wide, patterns in ((False, PATTERNS), (True, WIDE)):
        for kind, pattern in patterns.items():
            spans = F.when(_worth(text, kind, wide), _found(text, pattern)).otherwise(F.array().cast(_SPAN))
            out.append(F.transform(spans, _candidate(kind, wide)))
    return F.concat(*out)


def _rewritten(kind: str, v: Column) -> Column:
    """A match of the base pattern in the form that the wide generator looks for."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(v, "@", " [at] "), r"\.", " [dot] ")
    digits = F.right(F.concat(F.lit("0000000000"), _digits(v)), F.lit(10))
    return F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4))


def examples(text: Column) -> Column:
    """Array of (f features, y whether personal data) from which the trees learn.

    Base matches with their checks; those of e-mail addresses and telephone numbers that pass once more, rewritten in
    the wide forms where they stand, as positive examples of those; and near misses of the wide forms, rewritten alike,
    as negative ones. The wide forms thus differ by what stands around them.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    none = F.array().cast(f"array<{_MATCH}>")

    def matches(pattern: str, worth: Column) -> Column:
        return F.filter(F.when(worth, _matches(text, pattern)).otherwise(none), lambda x: x["v"].isNotNull())

    def one(kind: str, wide: bool, y: Callable[[Column], Column]):
        def made(x: Column) -> Column:
            v = _rewritten(kind, x["v"]) if wide else x["v"]
            return F.struct(_features(kind, wide, {"v": v, "c": x["c"]}).alias("f"), y(x).alias("y"))

        return made

    def checked(kind: str):
        ok = lambda x: valid(kind, x["v"])

        def made(m: Column) -> Column:
            plain = F.transform(m, one(kind, False, ok))
            if kind not in WIDE:
                return plain
            return F.concat(plain, F.transform(F.filter(m, ok), one(kind, True, lambda x: F.lit(True))))

        return made

    out = [_let(matches(pattern, _worth(text, kind, False)), checked(kind)) for kind, pattern in PATTERNS.items()]
    for kind, pattern in MISSES.items():
        worth = F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")
        out.append(F.transform(matches(pattern, worth), one(kind, True, lambda x: F.lit(False))))
    return F.concat(*out)


def fit_trees(rows: list[tuple[int, float, float]], rounds: int = 30, rate: float = 0.3) -> list[tuple]:
    """Gradient-boosted trees of depth two on (features, rows, of them positive) for the logistic loss.

    The features are bits and the kind's number, so the table has a bounded number of rows, whatever the corpus.
    A tree is (test, (test, leaf, leaf), (test, leaf, leaf)); a test is a mask and the value that the masked bits have.
    """
    n = len(FEATURES)
    tests = [(1 << i, 1 << i) for i in range(n)] + [(((1 << 2) - 1) << n, k << n) for k in range(len(KINDS))]
    score = {f: 0.0 for f, _, _ in rows}

    def leaf(part: list, gh: dict) -> float:
        return -rate * sum(gh[f][0] for f, _, _ in part) / (sum(gh[f][1] for f, _, _ in part) + 1.0)

    def gain(part: list, gh: dict) -> float:
        return sum(gh[f][0] for f, _, _ in part) ** 2 / (sum(gh[f][1] for f, _, _ in part) + 1.0)

    def best(part: list, gh: dict) -> tuple:
        cut = lambda t: ([r for r in part if r[0] & t[0] == t[1]], [r for r in part if r[0] & t[0] != t[1]])
        t = max(tests, key=lambda t: sum(gain(side, gh) for side in cut(t)))
        return t, *cut(t)

    trees = []
    for _ in range(rounds if rows else 0):
        gh = {}
        for f, m, y in rows:
            p = 1 / (1 + math.exp(-score[f]))
            gh[f] = (m * p - y, m * p * (1 - p))
        root, yes, no = best(rows, gh)
        tree = (root, *((t, leaf(a, gh), leaf(b, gh)) for t, a, b in (best(yes, gh), best(no, gh))))
        trees.append(tree)
        for f in score:
            score[f] += tree_value(tree, f)
    return trees


def tree_value(tree: tuple, f: int) -> float:
    side = tree[1] if f & tree[0][0] == tree[0][1] else tree[2]
    return side[1] if f & side[0][0] == side[0][1] else side[2]


def tree_score(trees: list[tuple], f: Column) -> Column:
    """The trees' sum as one expression."""
    when = lambda t, a, b: F.when(f.bitwiseAND(F.lit(t[0])) == t[1], a).otherwise(b)
    return sum((when(t, when(a[0], F.lit(a[1]), F.lit(a[2])), when(b[0], F.lit(b[1]), F.lit(b[2]))) for t, a, b in trees), F.lit(0.0))


def calibrate(rows: list[tuple[int, float, float]], trees: list[tuple], precision: float) -> float:
    """The lowest score above which at least this share of the checked candidates is right; infinity if there is none."""
    ranked = sorted(((sum(tree_value(t, f) for t in trees), m, y) for f, m, y in rows), reverse=True)
    most, right, low = 0.0, 0.0, math.inf
    for i, (s, m, y) in enumerate(ranked):
        most, right = most + m, right + y
        if (right + 1) / (most + 2) >= precision and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
            low = s
    return low


def fit(docs: DataFrame, text_col: str, precision: float = 0.95) -> tuple[list[tuple], float]:
    """Trees and threshold from the examples of all texts; a fifth of the texts, by hash, is held out for the threshold.

    What reaches the driver is counts by features, whose number is bounded.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select((F.crc32(text.cast("binary")) % 5 == 0).alias("held"), examples(text).alias("all"))
    rows = rows.select("held", F.explode("all").alias("x"))
    counts = rows.groupBy("held", "x.f").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.y").alias("y")).orderBy("f").collect()
    # half a row of either outcome each, so that one-sided counts stay finite
    table = lambda held: [(r["f"], r["n"] + 1.0, r["y"] + 0.5) for r in counts if r["held"] == held]
    trees = fit_trees(table(False))
    return trees, calibrate(table(True) or table(False), trees, precision)


def chosen(found: Column, model: tuple[list[tuple], float]) -> Column:
    """Base candidates that pass their check and wider ones that the trees select where no base span stands."""
    trees, threshold = model
    base = F.filter(found, lambda x: x["base"] & x["ok"])
    if not trees or math.isinf(threshold):
        more = F.filter(found, lambda x: F.lit(False))
    else:
        more = F.filter(found, lambda x: ~x["base"] & (tree_score(trees, x["f"]) >= threshold))
        more = F.filter(more, lambda x: ~F.exists(base, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    return F.concat(base, more)


def _written(spans: Column) -> Column:
    one = lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))), one), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base, spans) for every document; base and spans hold kind:start:end.

    Null text counts as empty: no spans. Repeated rows give repeated rows; other columns are not read; an empty table
    gives an empty one. The model is fitted on the counts of all examples in this table.
    """
    model = fit(docs, text_col, precision)
    found = docs.select(F.col(id_col), candidates(F.col(text_col)).alias("c"))
    out = found.withColumn("spans", chosen(F.col("c"), model)).withColumn("base", F.filter("c", lambda x: x["base"] & x["ok"]))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(id_col, *counts, _written(F.col("base")).alias("base"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """``docs`` with each selected span in the text replaced by its kind in brackets.

    Base matches that pass their check, kind by kind, then the wider ones that the trees select. Of overlapping spans
    the first kind counts. Rows and columns stay, whatever their names; null text stays null and empty text empty. The
    model is fitted on the counts of all examples in this table.
    """
    trees, threshold = fit(docs, text_col, precision)
    name = next(f"_text{i}" for i in range(len(docs.columns) + 1) if f"_text{i}" not in docs.columns)
    out = docs.withColumn(name, F.col(text_col).cast("string"))
    steps = [(kind, p, False) for kind, p in PATTERNS.items()]
    if trees and not math.isinf(threshold):
        steps += [(kind, p, True) for kind, p in WIDE.items()]

    def piece(kind: str, wide: bool):
        def made(g: Column, v: Column) -> Column:
            f = {"v": v, "c": F.right(g, F.lit(CONTEXT))}
            good = tree_score(trees, _features(kind, True, f)) >= threshold if wide else valid(kind, v)
            return F.concat(g, F.when(v.isNull(), "").when(good, F.lit(f"[{kind.upper()}]")).otherwise(v))

        return made

    for kind, pattern, wide in steps:
        text = F.col(name)
        # gaps and matches alternate, so the text comes together in one pass
        parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece(kind, wide))
        out = out.withColumn(name, F.when(_worth(text, kind, wide), F.array_join(parts, "")).otherwise(text))
    return out.select(*[F.col(name).alias(c) if c == text_col else F.col(c) for c in docs.columns])
