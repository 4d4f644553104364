"""Quality rules: base statistics and a learned decision list, in DataFrame functions only.

Sequential covering learns an ordered list of threshold conjunctions from labelled
statistics: a rule grows, condition by condition, by information gain on two thirds of the
rows, is pruned from its end on the other third, and is kept while it is right more often
than ``precision``; the rows it covers are taken away. The list becomes one ordered Spark
conditional expression. It is learned from a bounded sample of labelled rows (``per_class``
of each label, those of the least id hash); every document is judged on its whole text.

Defined results: a null text has no words and fails the base rules; rows without a label
are judged but not learned from; with labels of one class only the list is empty and keeps
what passes the base rules; repeated rows give repeated rows; an empty table gives an empty
table; other columns are dropped. Equal windows and words are told by 64-bit hashes within
one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import fold_of, least_hashed, table, text_of, texts_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What conditions may ask for.
FEATURES = ("symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share", "word_length")

Rule = list[tuple[str, str, float]]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the statistics of every document's whole text."""
    t = F.col("text")
    gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", "text", F.btrim("text", F.lit(SPACES)).alias("body"))
    empty = F.expr("cast(array() as array<string>)")
    rows = rows.select(
        "id",
        (F.length(t) - gone(SPACES)).cast("bigint").alias("word_chars"),
        gone(SYMBOLS).cast("bigint").alias("n_symbols"),
        gone("!?;:=").cast("bigint").alias("n_marks"),
        gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_upper"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.when(F.col("body") == "", empty).otherwise(F.split("body", r"[\x20\x09-\x0D]+")).alias("words"),
    )
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("marks")).drop("words")
    n = F.size("marks")
    windows = F.col("marks")
    for width in (1, 2, 4):  # hashes of 2, 4 and then 8 words, each from two hashes of half as many
        windows = _paired(windows, width)
    rows = rows.select(
        *["id", "word_chars", "n_symbols", "n_marks", "n_upper"],
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        n.cast("bigint").alias("n_words"),
        F.size(F.array_distinct("marks")).alias("n_distinct"),
        F.when(n >= WINDOW, windows).otherwise(F.expr("cast(array() as array<bigint>)")).alias("windows"),
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0)).otherwise(_covered(F.col("windows"))).cast("bigint")).drop("windows")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_marks", "word_chars").alias("mark_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_distinct", "n_words").alias("distinct_share"),
        share("word_chars", "n_words").alias("word_length"),
    )


def _paired(hashes: Column, apart: int) -> Column:
    """The hash of each element and the one so many places behind it."""

    def made(a: Column) -> Column:
        n = F.size(a) - apart
        return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(apart + 1), n), lambda x, y: F.xxhash64(x, y))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.transform(F.array(hashes), made)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash stands twice or more: sorted by hash, then the places' gaps added up."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(by: Column) -> Column:
        twice = F.filter(by, lambda x, k: (F.get(by, k - 1)["h"] == x["h"]) | (F.get(by, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x)

    # An array of one binds its element, so that each step is computed once.
    return F.transform(F.transform(F.array(placed), places), total)[0]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _holds(row: dict, rule: Rule) -> bool:
    return all(row[f] >= t if op == ">=" else row[f] <= t for f, op, t in rule)


def _grow(rows: list[tuple[dict, bool]], features: tuple[str, ...], cuts: int, longest: int) -> Rule:
    rule: Rule = []
    while len(rule) < longest:
        p0 = sum(y for _, y in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
        for f in features:
            order = sorted(rows, key=lambda r: r[0][f])
            ups = [0]
            for _, y in order:
                ups.append(ups[-1] + y)
            step = max(1, len(order) // cuts)
            for k in range(step, len(order), step):
                low, high = order[k - 1][0][f], order[k][0][f]
                if low == high:
                    continue
                middle = (low + high) / 2
                below, above = (ups[k], k - ups[k]), (p0 - ups[k], len(order) - k - (p0 - ups[k]))
                for (p, n), op in ((below, "<="), (above, ">=")):
                    best = max(best, (_gain(p, n, p0, n0), (f, op, middle)), key=lambda b: b[0])
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _holds(r[0], [best[1]])]
    return rule


def _worth(rule: Rule, rows: list[tuple[dict, bool]]) -> float:
    hit = [y for x, y in rows if _holds(x, rule)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def learn(rows: list[tuple[dict, bool]], features: tuple[str, ...] = FEATURES, precision: float = 0.9, cuts: int = 200, longest: int = 3, most: int = 12) -> list[Rule]:
    """Ordered rules for the rows marked True (to be rejected)."""
    rules: list[Rule] = []
    while len(rules) < most and any(y for _, y in rows):
        grow = [r for k, r in enumerate(rows) if k % 3 < 2]
        prune = [r for k, r in enumerate(rows) if k % 3 == 2] or grow
        rule = _grow(grow, features, cuts, longest)
        while len(rule) > 1 and _worth(rule[:-1], prune) >= _worth(rule, prune):
            rule = rule[:-1]
        hit = [y for x, y in rows if rule and _holds(x, rule)]
        if not hit or sum(hit) < 3 or sum(hit) / len(hit) < precision:
            break
        rules.append(rule)
        rows = [r for r in rows if not _holds(r[0], rule)]
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        hold = F.lit(True)
        for f, op, t in rules[k]:
            hold = hold & (F.col(f) >= t if op == ">=" else F.col(f) <= t)
        out = F.when(hold, F.lit(k + 1)).otherwise(out)
    return out


def learn_from(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, train: Column) -> list[Rule]:
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and key is not null").where(train)
    parts = [least_hashed(known.where(F.col("label") == k).select(F.col("key").alias("id"), "label"), per_class) for k in (0, 1)]
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    texts = texts_of(docs, parts[0].unionByName(parts[1]), "rules-sample")
    rows = with_statistics(texts.select(F.struct("id", "label").alias("both"), "text"), "both", "text")
    # Not filtered in Spark: a pushed-down filter would compute the statistics anew inside its own condition.
    got = rows.select("id.id", "id.label", base_failed().alias("failed"), *FEATURES).collect()
    got = sorted((r for r in got if not r["failed"]), key=lambda r: (str(r["id"]), r["label"]))
    return learn([({f: r[f] for f in FEATURES}, r["label"] == 0) for r in got])


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """``id_col``, the base statistics, ``base_failed``, ``kept`` and ``rule`` (of the list, null: none) of every document."""
    rules = learn_from(df, labels, id_col, text_col, label_col, per_class, fold_of(F.col("key"), folds) != held_fold)
    # Written down, as a later filter on these columns would be pushed below them and compute them many times.
    rows = table(with_statistics(df, id_col, text_col), "quality-statistics")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
