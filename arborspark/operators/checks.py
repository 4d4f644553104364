"""Checks of documents, indexes, rankings and runs: each gives the violations as rows, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.text import folded, stripped


def counted(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule, n`` for each rule that rows break: one aggregation for all rules."""
    totals = rows.groupBy(key).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])
    return totals.select(key, F.explode(pairs).alias("r")).select(key, "r.rule", "r.n").where("n > 0")


def document_issues(units: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, rule, n`` of units (``doc_id, paragraph, section, heading, start, end``) against their documents (``doc_id, title, text``).

    Paragraph numbers count up from 0, spans are in order and apart and inside the text, a
    section is one stretch of units with one heading, and a document has an id, a title and a text.
    """
    by = Window.partitionBy("doc_id").orderBy("paragraph", "start")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = units.join(docs.select("doc_id", F.length("text").alias("size")), "doc_id", "left")
    changed = F.coalesce(~F.col("section").eqNullSafe(F.lag("section").over(by)), F.lit(True)) | (F.row_number().over(by) == 1)
    rows = rows.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0))).withColumn("begins", changed).withColumn("place", F.row_number().over(by) - 1)
    again = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("doc_id", "section"))
    other = F.min("heading").over(Window.partitionBy("doc_id", "section")) != F.max("heading").over(Window.partitionBy("doc_id", "section"))
    rows = rows.withColumn("again", again).withColumn("other", other)
    out = counted(
        rows,
        "doc_id",
        {
            "number": ~F.col("paragraph").eqNullSafe(F.col("place").cast("bigint")),
            "span": ~((F.col("reach") <= F.col("start")) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size"))),
            "section": F.col("section").isNull() | (F.col("section") < 0),
            "scattered_section": F.col("again") > 1,
            "headings_differ": F.col("other"),
            "no_heading": F.col("heading").isNull(),
        },
    )
    return out.unionByName(counted(docs, "doc_id", {"no_text": F.col("text").isNull(), "no_title": F.col("title").isNull()}))


def index_issues(nodes: DataFrame, docs: DataFrame, sha: str | None = None, centrals: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``doc_id, rule, n`` of an index read back: its text's digest, ids, spans, central sentences, contents targets.

    ``docs`` has ``doc_id, text`` and a stored digest in the column ``sha``; ``centrals`` has
    ``doc_id, node_id, start, end, text`` and ``targets`` ``doc_id, node_id, target_id``.
    """
    size = docs.select("doc_id", F.length("text").alias("size"), *([F.col(sha).alias("stored"), F.sha2("text", 256).alias("own")] if sha else []))
    ids = nodes.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("times"))
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    rows = nodes.join(size.select("doc_id", "size"), "doc_id").join(up, ["doc_id", "parent_id"], "left")
    inside = (F.coalesce("ps", F.lit(0)) <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.coalesce("pe", "size"))
    out = [counted(rows, "doc_id", {"span": ~inside, "orphan": F.col("parent_id").isNotNull() & F.col("ps").isNull()}), counted(ids, "doc_id", {"repeated_id": F.col("times") > 1})]
    if sha:
        out.append(counted(size, "doc_id", {"digest": ~F.col("stored").eqNullSafe(F.col("own"))}))
    if centrals is not None:
        at = centrals.select("doc_id", "node_id", F.col("start").alias("cs"), F.col("end").alias("ce"), F.col("text").alias("said"))
        rows = at.join(nodes.select("doc_id", "node_id", "start", "end"), ["doc_id", "node_id"]).join(docs.select("doc_id", "text"), "doc_id")
        within = (F.col("start") <= F.col("cs")) & (F.col("cs") < F.col("ce")) & (F.col("ce") <= F.col("end"))
        out.append(counted(rows, "doc_id", {"central_outside": ~within, "central_text": within & (F.substring("text", F.col("cs") + 1, F.col("ce") - F.col("cs")) != F.col("said"))}))
    if targets is not None:
        heads = nodes.select("doc_id", F.col("node_id").alias("target_id"), "kind")
        rows = targets.where("target_id is not null").join(heads, ["doc_id", "target_id"], "left")
        out.append(counted(rows, "doc_id", {"target": ~F.col("kind").eqNullSafe(F.lit("heading"))}))
    return reduce(DataFrame.unionByName, out)


def span_issues(spans: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """``query, rule, n`` of candidate passages (``query, doc_id, item, start, end, text``): bounds, exact text, no overlap, no repeated item."""
    by = Window.partitionBy(query, "doc_id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("lap", F.coalesce(reach > F.col("start"), F.lit(False))).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(query, "item")))
    rows = rows.join(docs.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    bounds = (F.lit(0) <= F.col("start")) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("source"))
    exact = F.substring("source", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return counted(rows, query, {"bounds": ~F.coalesce(bounds, F.lit(False)), "text": bounds & ~exact, "overlap": F.col("lap"), "repeated": F.col("times") > 1})


def score_issues(scores: DataFrame, key: str, asked: str, score: str) -> DataFrame:
    """``key, rule, n``: scores (arrays) that are not one finite number of [0, 1] for each item of ``asked``."""
    bad = F.count_if(F.exists(F.col(score), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)))
    rows = scores.groupBy(key).agg(F.count_if(~F.size(score).eqNullSafe(F.size(asked))).alias("count"), bad.alias("range"))
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in ("count", "range")])
    return rows.select(key, F.explode(pairs).alias("r")).select(key, "r.*").where("n > 0")


def need_issues(needs: DataFrame, key: str, need: str, most: int = 3, longest: int = 300) -> DataFrame:
    """``key, rule, n`` of the needs of each query: one to ``most``, not blank, not too long, different but for case."""
    rows = needs.withColumn("bare", stripped(F.col(need)))
    per = rows.groupBy(key).agg(F.count(need).alias("size"), F.count_if(F.coalesce(F.col("bare") == "", F.lit(False))).alias("blank"), F.count_if(F.length(need) > longest).alias("long"), (F.count(need) - F.count_distinct(folded(F.col("bare")))).alias("repeated"))
    count = F.when((F.col("size") < 1) | (F.col("size") > most), F.col("size")).otherwise(F.lit(0))
    pairs = F.array(F.struct(F.lit("count").alias("rule"), count.alias("n")), *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in ("blank", "long", "repeated")])
    return per.select(key, F.explode(pairs).alias("r")).select(key, "r.*").where("n > 0 or (rule = 'count' and n is null)")


def requests(needs: DataFrame, questions: DataFrame, key: str, need: str, question: str) -> DataFrame:
    """``key, request, place``: the needs in order and then the question, each text where it is first."""
    rows = needs.select(key, F.col("place").cast("bigint").alias("place"), F.col(need).alias("request"))
    last = questions.select(key, F.lit(2**62).alias("place"), F.col(question).alias("request"))
    first = rows.unionByName(last).groupBy(key, "request").agg(F.min("place").alias("at"))
    order = Window.partitionBy(key).orderBy("at")
    return first.select(key, "request", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def without_covered(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """The chosen nodes (``doc_id, node_id``) that do not lie below another chosen one; ``paths`` has ids from the root, joined by ``/``."""
    up = chosen.select("doc_id", "node_id").distinct().join(paths, ["doc_id", "node_id"])
    above = up.select("doc_id", "node_id", F.explode(F.split("path", "/")).alias("over")).where("over <> node_id")
    held = chosen.select("doc_id", F.col("node_id").alias("over")).distinct()
    covered = above.join(held, ["doc_id", "over"], "left_semi").select("doc_id", "node_id").distinct()
    return chosen.join(covered, ["doc_id", "node_id"], "left_anti")


def dangling(owners: DataFrame, owner: str, refs: str, known: DataFrame, item: str) -> DataFrame:
    """``owner, n_refs, missing``: references (an array) that name no known item; owners with none missing are left out."""
    rows = owners.select(owner, F.size(refs).cast("bigint").alias("n_refs"), F.explode(F.array_distinct(refs)).alias(item))
    lost = rows.join(known.select(item).distinct(), item, "left_anti")
    return lost.groupBy(owner).agg(F.max("n_refs").alias("n_refs"), F.array_sort(F.collect_list(item)).alias("missing"))


def clusters(rows: DataFrame, text: str, facets: list[str]) -> DataFrame:
    """``facet, value, n, n_texts, chars``: rows and distinct texts (by SHA-256) of each value, and the characters of the distinct ones."""
    keyed = rows.select(F.sha2(text, 256).alias("cluster"), F.length(text).alias("size"), F.explode(F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), *[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in facets])).alias("f"))
    once = keyed.groupBy("f.facet", "f.value", "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return once.groupBy("facet", "value").agg(F.sum("n").alias("n"), F.count("cluster").alias("n_texts"), F.sum("size").cast("bigint").alias("chars"))


def pools_differ(left: DataFrame, right: DataFrame, key: str, item: str, place: str, most: int) -> DataFrame:
    """``key, n_left, n_right, same``: whether two rankings have the same first ``most`` items in the same order."""
    pool = lambda rows, name: rows.where(F.col(place) <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place, item))).alias(name))
    both = pool(left, "a").join(pool(right, "b"), key, "full")
    names = lambda c: F.transform(c, lambda x: x[item])
    return both.select(key, F.coalesce(F.size("a"), F.lit(0)).cast("bigint").alias("n_left"), F.coalesce(F.size("b"), F.lit(0)).cast("bigint").alias("n_right"), names(F.col("a")).eqNullSafe(names(F.col("b"))).alias("same"))


def prediction_issues(predicted: DataFrame, items: DataFrame, packed: DataFrame, again: DataFrame, key: str, item: str) -> DataFrame:
    """``key, rule, n``: rankings with repeated or unknown items or gaps in their places, and packings that a new packing does not give.

    ``predicted`` has ``key, item, rank``, ``packed`` and ``again`` ``key, item, taken``.
    """
    rows = predicted.join(items.select(key, item).distinct().withColumn("known", F.lit(True)), [key, item], "left")
    rows = rows.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(key, item))).withColumn("due", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    out = counted(rows, key, {"repeated": F.col("times") > 1, "unknown": F.col("known").isNull(), "place": F.col("rank") != F.col("due")})
    both = packed.select(key, item, F.col("taken").alias("a")).join(again.select(key, item, F.col("taken").alias("b")), [key, item], "full")
    return out.unionByName(counted(both, key, {"packing": ~F.col("a").eqNullSafe(F.col("b"))}))


def moved_leaves(before: DataFrame, after: DataFrame, kinds: tuple[str, ...] = ("section", "paragraph", "sentence")) -> DataFrame:
    """``doc_id, n_lost, n_new, root_before, root_after``: leaves that a repair of the hierarchy changed, and the root's children before and after."""
    keep = lambda rows: rows.where(F.col("kind").isin(*kinds)).select("doc_id", "node_id", "kind", "start", "end")
    both = keep(before).withColumn("old", F.lit(1)).join(keep(after).withColumn("new", F.lit(1)), ["doc_id", "node_id", "kind", "start", "end"], "full")
    changes = both.groupBy("doc_id").agg(F.count_if(F.col("new").isNull()).alias("n_lost"), F.count_if(F.col("old").isNull()).alias("n_new"))
    tops = lambda rows, name: rows.where("parent_id = 'root'").groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    return changes.join(tops(before, "root_before"), "doc_id", "left").join(tops(after, "root_after"), "doc_id", "left")


def capped_pick(rows: DataFrame, stratum: str, group: str, item: str, n: int, seed: str, used: str | None = None) -> DataFrame:
    """The first ``n`` of each stratum in hash order: one of each group first, a second one only where these are too few.

    ``used`` is a column with the number of a group's items that were taken before.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")), 256)
    hashed = rows.withColumn("hash", digest)
    nth = F.row_number().over(Window.partitionBy(stratum, group).orderBy("hash", item)) + (F.coalesce(F.col(used), F.lit(0)) if used else 0)
    hashed = hashed.withColumn("nth", nth).where("nth <= 2")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("nth", "hash", item)).cast("bigint")
    return hashed.withColumn("place", place).where(F.col("place") <= n).select(*rows.columns, "place")


def batched(rows: DataFrame, key: str, group: str, order: str, size: int) -> DataFrame:
    """Adds ``batch``: within each key, rows go in order to the first batch with room that has nothing of their group.

    Batches of a group only rise, and a full batch stays full, so a row looks from its
    group's last batch on and skips full ones by pointers. A key's rows are walked in one task.
    """

    def walk(pdf):
        pdf = pdf.sort_values(order)
        room: list[int] = []
        ahead: list[int] = []  # of a full batch: where to look next
        last: dict = {}

        def open_from(b: int) -> int:
            trail = []
            while b < len(ahead) and ahead[b] != b:
                trail.append(b)
                b = ahead[b]
            for t in trail:
                ahead[t] = b
            return b

        batch = []
        for g in pdf[group]:
            b = open_from(last.get(g, -1) + 1)
            if b == len(room):
                room.append(size)
                ahead.append(b)
            room[b] -= 1
            if not room[b]:
                ahead[b] = b + 1
            last[g] = b
            batch.append(b)
        return pdf.assign(batch=batch)

    from pyspark.sql import types as T

    return rows.groupBy(key).applyInPandas(walk, T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))
