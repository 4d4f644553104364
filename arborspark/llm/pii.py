"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose overlapping spans; boosted trees score each by its format
and the characters and words around it; a calibrated threshold selects what is added to the
base spans. The labels are weak: whether a candidate overlaps a verified base span. What
those rules demand by form (the plus sign, the exact pattern) is kept from the trees, so that
they have to go by the rest, and a candidate that looks like verified ones but lacks the
demanded form can be found. Numbers that fail a check (Luhn's sum, octets up to 255) say so
in a feature; they are the clearest negatives.

Trees are fitted on three of four texts and the threshold is set on the others, by a hash of
the text, so that copies are on one side. Both count every candidate, by feature cell. At
most ``most_cells`` come to the driver: where there are more, features are read in coarser
bins and the cells' counts are added up. The fitted trees are one Spark expression. Chosen
candidates that overlap a base span add nothing; the others are added as their union.

Defined results: a null text counts as empty; a text without findings has counts 0 and the
empty span string; without any candidate nothing is added; repeated rows and repeated or
null ids give one row each; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import table, text_of
from arborspark.llm.spans import labelled, let, matches, merged, overlapping, written

KINDS = ["email", "ip", "card", "phone", "likely"]
#: Fixed patterns of the base kinds, without backtracking into runs: what follows a run is never in it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of candidates: anything with an at sign, dotted or coloned digits, long runs of digits; digits do not begin or end inside a word.
GENERATORS = [r"(?<![^\s<>(),;])[^\s@<>(),;]++@[^\s@<>(),;]++", r"(?<![0-9A-Za-z])[0-9]++(?:[.:][0-9]++){2,}+(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,}+(?![A-Za-z])"]
FEATURES = ("kind", "digits", "failed", "dots", "gaps", "left", "right", "context")
#: Those that are read in coarser bins where cells are too many; 63 is their last bin.
BINNED = ("digits", "dots", "gaps", "left", "right")
CONTEXT = r"(?i)(?:tel|phone|fon|call|mail|contact|card|karte|carte|tarjeta|ip|addr)[^\n]{0,16}$"
#: Texts of which hash are kept for the threshold, of so many.
APART, PARTS = 0, 4


def luhn(text: Column) -> Column:
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(d == "", 0).otherwise(F.element_at(F.when(i % 2 == 1, F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))).otherwise(F.array(*map(F.lit, range(10)))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def digits_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def base_spans(t: Column) -> list[Column]:
    """The four base kinds, verified."""
    has_digit = t.rlike("[0-9]")
    ip = F.filter(matches(t, IP, F.contains(t, F.lit(".")) & has_digit), lambda m: F.forall(F.split(m["t"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m["t"], r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))
    card = F.filter(matches(t, CARD, has_digit), lambda m: digits_of(m["t"]).between(16, 19) & luhn(m["t"]))
    phone = F.filter(matches(t, PHONE, F.contains(t, F.lit("+"))), lambda m: digits_of(m["t"]).between(8, 15))
    return [matches(t, EMAIL, F.contains(t, F.lit("@"))), ip, card, phone]


def side(c: Column) -> Column:
    """What kind of character stands next to a candidate: none or white space, a letter, a digit, another one."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[A-Za-z]"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def failed(s: Column) -> Column:
    """Whether a text has the form of a card number or an address in digits, but not a right sum or right octets."""
    octets = F.exists(F.split(s, r"\."), lambda p: F.right(p, F.lit(9)).cast("int") > 255)
    return F.when(s.rlike(r"^[0-9]++(?:\.[0-9]++){3}$"), octets).otherwise(s.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & digits_of(s).between(13, 19) & ~luhn(s))


def candidates(t: Column, base: Column) -> Column:
    """Proposed spans with features and the weak label."""
    has_digit = t.rlike("[0-9]")
    found = [matches(t, GENERATORS[0], F.contains(t, F.lit("@"))), matches(t, GENERATORS[1], has_digit), matches(t, GENERATORS[2], has_digit)]

    def row(kind: int):
        def made(m: Column) -> Column:
            s = m["t"]
            small = lambda x, most: F.least(x, F.lit(most)).cast("int")
            return F.struct(
                m["s"].alias("s"),
                m["e"].alias("e"),
                F.lit(kind).alias("kind"),
                small(digits_of(s), 24).alias("digits"),
                failed(s).cast("int").alias("failed"),
                small(F.length(s) - F.length(F.translate(s, ".", "")), 5).alias("dots"),
                small(F.length(s) - F.length(F.translate(s, " -/()", "")), 6).alias("gaps"),
                side(F.right(m["before"], F.lit(1))).alias("left"),
                side(m["after"]).alias("right"),
                m["before"].rlike(CONTEXT).cast("int").alias("context"),
            )

        return made

    every = F.concat(*[F.transform(m, row(k)) for k, m in enumerate(found)])
    with_label = lambda c: F.zip_with(c, overlapping(c, base), lambda m, hit: F.struct(m["s"].alias("s"), m["e"].alias("e"), *[m[f].alias(f) for f in FEATURES], hit.cast("int").alias("label")))
    return let(every, with_label)


Tree = tuple  # a leaf: (value,); else (feature, threshold, tree at or below, tree above)


def _leaf(cells: Sequence[tuple[tuple[int, ...], float, float]]) -> float:
    return sum(g for _, g, _ in cells) / (sum(h for _, _, h in cells) + 1.0)


def _split(cells: Sequence[tuple[tuple[int, ...], float, float]], depth: int) -> Tree:
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-6, None)
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for x, gi, hi in cells:
            at = by.setdefault(x[f], [0.0, 0.0])
            at[0] += gi
            at[1] += hi
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            best = max(best, (gain, (f, v)), key=lambda b: b[0])
    if depth == 0 or best[1] is None:
        return (_leaf(cells),)
    f, v = best[1]
    return f, v, _split([c for c in cells if c[0][f] <= v], depth - 1), _split([c for c in cells if c[0][f] > v], depth - 1)


def _value(tree: Tree, x: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def boost(cells: list[tuple[tuple[int, ...], int, int]], rounds: int = 20, rate: float = 0.3, depth: int = 3) -> tuple[float, list[Tree]]:
    """Newton boosting of logistic loss on ``(features, rows, positive rows)``."""
    n, p = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((p + 0.5) / (n - p + 0.5))
    margins, trees = [start] * len(cells), []
    for _ in range(rounds):
        slopes = []
        for m, (x, rows, up) in zip(margins, cells, strict=True):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))
            slopes.append((x, up - rows * q, rows * q * (1 - q)))
        tree = _split(slopes, depth)
        trees.append(tree)
        margins = [m + rate * _value(tree, x) for m, (x, _, _) in zip(margins, cells, strict=True)]
    return start, [_scaled(t, rate) for t in trees]


def _scaled(tree: Tree, by: float) -> Tree:
    return (tree[0] * by,) if len(tree) == 1 else (tree[0], tree[1], _scaled(tree[2], by), _scaled(tree[3], by))


def threshold(cells: list[tuple[tuple[int, ...], int, int]], start: float, trees: list[Tree], precision: float) -> float:
    """The least margin at which the calibrated share of positive rows is as asked; none: infinity.

    The share is calibrated by isotonic regression on the margin, so it is that of the
    candidates near the margin, not of all above it.
    """
    steps: list[list[float]] = []  # margin from which the step holds, rows, positive rows
    for margin, n, p in sorted((start + sum(_value(t, x) for t in trees), n, p) for x, n, p in cells if n):
        steps.append([margin, n, p])
        while len(steps) > 1 and (steps[-2][0] == margin or steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]):
            _, more, up = steps.pop()
            steps[-1][1] += more
            steps[-1][2] += up
    return min((margin for margin, n, p in steps if p >= precision * n), default=math.inf)


def as_expression(tree: Tree, m: Column) -> Column:
    if len(tree) == 1:
        return F.lit(float(tree[0]))
    f, v, low, high = tree
    return F.when(m[FEATURES[f]] <= v, as_expression(low, m)).otherwise(as_expression(high, m))


def collected(counts: DataFrame, most: int) -> list[tuple[tuple[int, ...], tuple[int, int], tuple[int, int]]]:
    """All counts by feature cell, rows and positive ones, to fit on and kept apart; in bins of doubled width until there are at most ``most``.

    A bin goes by its largest value, so a tree's threshold on bins holds for the values themselves.
    """
    names = ("n", "up", "n_apart", "up_apart")
    for bits in range(1, 8):
        rows = counts.limit(most + 1).collect()
        if len(rows) <= most:
            return sorted(((tuple(r[f] for f in FEATURES), (r["n"], r["up"]), (r["n_apart"], r["up_apart"])) for r in rows), key=lambda c: (-c[1][0], c[0]))
        wide = [F.col(f).bitwiseOR(F.lit((1 << bits) - 1)).alias(f) if f in BINNED else F.col(f) for f in FEATURES]
        counts = counts.select(*wide, *names).groupBy(*FEATURES).agg(*[F.sum(c).alias(c) for c in names])
    raise ValueError(f"more than {most} cells in the coarsest bins")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.8, most_cells: int = 4096) -> DataFrame:
    """``id_col, base, spans`` (arrays of ``struct<s, k, e>``) of every row. Texts are read once."""
    t = F.col("text")
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kinds = [labelled(m, k).alias(f"k{k}") for k, m in enumerate(base_spans(t))]
    rows = rows.select("id", "text", *kinds).withColumn("base", F.concat("k0", "k1", "k2", "k3"))
    apart = F.pmod(F.xxhash64("text"), F.lit(PARTS)) == APART
    rows = table(rows.select("id", "base", apart.alias("apart"), candidates(t, F.col("base")).alias("proposed")), "pii-candidates")
    each = rows.select("apart", F.explode("proposed").alias("c")).select("apart", *[F.col("c")[f].alias(f) for f in FEATURES], F.col("c")["label"].alias("label"))
    only = lambda kept, x: F.sum(F.when(F.col("apart") == kept, x).otherwise(0))
    counts = each.groupBy(*FEATURES).agg(only(False, F.lit(1)).alias("n"), only(False, F.col("label")).alias("up"), only(True, F.lit(1)).alias("n_apart"), only(True, F.col("label")).alias("up_apart"))
    cells = collected(counts, most_cells)
    added = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    fitted = [(x, *n) for x, n, _ in cells if n[0]]
    if fitted:
        start, trees = boost(fitted)
        least = threshold([(x, *n) for x, _, n in cells], start, trees, precision)
        if least < math.inf:

            def chosen(m: Column) -> Column:
                total = F.lit(start)
                for tree in trees:
                    total = total + as_expression(tree, m)
                return total >= least - 1e-9

            picked = F.filter("proposed", lambda m: (m["label"] == 0) & chosen(m))
            added = F.transform(merged(picked), lambda m: F.struct(m["s"].alias("s"), F.lit(4).alias("k"), m["e"].alias("e")))
    return rows.select(F.col("id").alias(id_col), "base", F.concat("base", added).alias("spans"))


def find_query(df: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` of every document, by kind and then start."""
    rows = find(df)
    by_kind = lambda c: F.transform(F.sort_array(F.transform(c, lambda m: F.struct(m["k"].alias("k"), m["s"].alias("s"), m["e"].alias("e")))), lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    shown = lambda c: written(by_kind(F.col(c)), KINDS)
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
