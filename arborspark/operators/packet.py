"""Evidence packets: targets with the passages that they lean on, and contexts packed by what they cost when rendered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.text import CONTINUATION, INTRODUCTION, heading_path, stripped, tokens
from arborspark.sources.work import importable

#: Roles of links, fixed values, in the order in which a target names them.
ROLES = ("active_source_introduction", "preceding_source_paragraph", "dependent_source_continuation", "following_source_paragraph")
#: Roles that an expansion follows.
FOLLOWED = (ROLES[0], ROLES[2])


def links(units: DataFrame, allowance: int = 6000) -> DataFrame:
    """``doc_id, target, context, role, omitted``: for each unit what it leans on in its own section and heading.

    The last introduction before it and the unit right before it come from what precedes; a
    unit that introduces something itself takes neither. They share ``allowance`` characters,
    the introduction first; what does not fit is marked as omitted. The unit behind it is
    always linked.
    """
    by = Window.partitionBy("doc_id", "section", "heading").orderBy("paragraph")
    stretch = F.sum(F.coalesce((F.lag("paragraph").over(by) != F.col("paragraph") - 1).cast("int"), F.lit(0))).over(by)
    rows = units.withColumn("stretch", stretch)
    on = Window.partitionBy("doc_id", "section", "heading", "stretch").orderBy("paragraph")
    before = on.rowsBetween(Window.unboundedPreceding, -1)
    intro = F.col("text").rlike(INTRODUCTION)
    unit = lambda: F.struct(F.col("paragraph").alias("p"), F.length("text").alias("n"))
    rows = rows.select("doc_id", F.col("paragraph").alias("target"), intro.alias("own"), F.last(F.when(intro, unit()), ignorenulls=True).over(before).alias("intro"), F.lag(unit()).over(on).alias("lag"), F.lead("paragraph").over(on).alias("next"), "text", F.lead("text").over(on).alias("after"))
    leans = F.regexp_extract(F.rtrim("text"), "[,:]$", 0).isin(",", ":") | stripped(F.col("after")).rlike(CONTINUATION)
    first = F.when(~F.col("own") & F.col("intro").isNotNull(), F.col("intro"))
    second = F.when(~F.col("own") & F.col("lag").isNotNull() & ~F.col("lag.p").eqNullSafe(F.col("intro.p")), F.col("lag"))
    rows = rows.withColumn("first", first).withColumn("second", second)
    fits_one = F.coalesce(F.col("first.n") <= allowance, F.lit(False))
    used = F.when(fits_one, F.col("first.n")).otherwise(0)
    link = lambda who, role, omitted: F.struct(who.alias("context"), F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), omitted.alias("omitted"))
    every = F.array(
        F.when(F.col("first").isNotNull(), link(F.col("first.p"), ROLES[0], ~fits_one)),
        F.when(F.col("second").isNotNull(), link(F.col("second.p"), ROLES[1], used + F.col("second.n") > allowance)),
        F.when(F.col("next").isNotNull(), link(F.col("next"), F.when(leans, ROLES[2]).otherwise(ROLES[3]), F.lit(False))),
    )
    return rows.select("doc_id", "target", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("l")).select("doc_id", "target", "l.*")


def packet(ranked: DataFrame, found: DataFrame, query: str, base: int = 12, expand: bool = False, most: int = 20) -> DataFrame:
    """``query, doc_id, paragraph, is_target, hop``: the first ``base`` of a ranking, and what their links name, once each.

    With ``expand``, what introductions and dependent continuations name become targets, in
    the order of the links, for two hops and up to ``most`` targets in all.
    """
    if base < 1 or most < base:
        raise ValueError("base must be positive and no more than most")
    keys = [query, "doc_id"]
    order = Window.partitionBy(*keys).orderBy("rank")
    targets = ranked.withColumn("seat", F.row_number().over(order).cast("bigint")).where(F.col("seat") <= base).select(*keys, F.col("paragraph").alias("target"), "seat", F.lit(0).alias("hop"))
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    kept = found.where("not omitted").withColumn("order", place)
    for hop in (1, 2) if expand else ():
        named = targets.join(kept.where(F.col("role").isin(*FOLLOWED)), ["doc_id", "target"]).groupBy(*keys, F.col("context").alias("target")).agg(F.min(F.struct("seat", "order")).alias("at"))
        fresh = named.join(targets.select(*keys, "target"), [*keys, "target"], "left_anti")
        taken = targets.groupBy(*keys).agg(F.max("seat").alias("last"))
        rows = fresh.join(taken, keys).withColumn("seat", F.col("last") + F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
        targets = targets.unionByName(rows.where(F.col("seat") <= most).select(*keys, "target", "seat", F.lit(hop).alias("hop")))
    near = targets.join(kept, ["doc_id", "target"]).select(*keys, F.col("context").alias("paragraph"), F.lit(False).alias("is_target"), F.lit(None).cast("int").alias("hop"))
    own = targets.select(*keys, F.col("target").alias("paragraph"), F.lit(True).alias("is_target"), "hop")
    return own.unionByName(near).groupBy(*keys, "paragraph").agg(F.max("is_target").alias("is_target"), F.min("hop").cast("bigint").alias("hop"))


def words(text: Column) -> Column:
    return F.size(tokens(text)).cast("bigint")


def render(title: str, parts: list[tuple[int, str, str]]) -> str:
    """A title line and the numbered passages (start, heading, text) in source order."""
    return f"Title: {title}\n" + "\n\n".join(f"[{k}] {h}\n{t}" for k, (_, h, t) in enumerate(sorted(parts), 1))


def merged(title: str, ranked: list[dict], parents: list[dict], count: Callable[[str], int], budget: int, coverage: float | None = None) -> tuple[list[dict], list[str]]:
    """Passages taken in rank order while their rendering fits; a parent replaces two or more of its own where they cover enough of it.

    What is enough rises from a third to two thirds as the budget fills, unless given.
    """
    cost = lambda rows: count(render(title, [(r["start"], r["heading"], r["text"]) for r in rows]))
    held: list[dict] = []
    grown: list[str] = []
    over = lambda r: next((p for p in parents if p["start"] <= r["start"] and r["end"] <= p["end"]), None)
    for r in ranked:
        if any(h["start"] <= r["start"] and r["end"] <= h["end"] for h in held):
            continue
        if any(h["start"] < r["end"] and r["start"] < h["end"] for h in held):
            raise ValueError("passages overlap in part")
        used = cost([*held, r])
        if used > budget:
            continue
        held.append(r)
        if (p := over(r)) is None:
            continue
        own = [h for h in held if over(h) is p]
        share = sum(h["end"] - h["start"] for h in own) / (p["end"] - p["start"])
        wide = [h for h in held if h not in own] + [p]
        if len(own) > 1 and share >= (coverage or (1 + used / budget) / 3) and cost(wide) <= budget:
            held = wide
            grown.append(p["item"])
    return held, grown


def merged_contexts(ranked: DataFrame, parents: DataFrame, titles: DataFrame, query: str, budget: int, count: Callable[[str], int], coverage: float | None = None) -> DataFrame:
    """``query, doc_id, spans, merged, context, used``: one reading context for each query and document.

    ``ranked`` has ``query, doc_id, item, rank, start, end, heading, text`` (a bounded number
    for each query), ``parents`` ``doc_id, item, start, end, heading, text``, ``titles`` ``doc_id, title``.
    """
    row = F.struct(*[F.col(c) for c in ("rank", "item", "start", "end", "heading", "text")])
    own = F.struct(*[F.col(c) for c in ("start", "end", "item", "heading", "text")])
    lists = ranked.groupBy(query, "doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # Only parents that hold a ranked passage are moved, once for each query.
    held = ranked.select(query, "doc_id", F.col("start").alias("s"), F.col("end").alias("e")).join(parents, "doc_id").where("start <= s and e <= end")
    tops = held.groupBy(query, "doc_id").agg(F.array_sort(F.collect_set(own)).alias("tops"))
    rows = lists.join(tops, [query, "doc_id"], "left").join(titles, "doc_id", "left")
    kinds = rows.schema
    schema = f"{query} {kinds[query].dataType.simpleString()}, doc_id {kinds['doc_id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint>>, merged array<string>, context string, used bigint"

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                held, grown = merged(r["title"] or "", [dict(x) for x in r["rows"]], [dict(x) for x in (r["tops"] if r["tops"] is not None else [])], count, budget, coverage)
                text = render(r["title"] or "", [(h["start"], h["heading"], h["text"]) for h in held])
                out.append((r[query], r["doc_id"], [{"start": h["start"], "end": h["end"]} for h in sorted(held, key=lambda h: h["start"])], grown, text, count(text)))
            yield pdf.__class__(out, columns=[query, "doc_id", "spans", "merged", "context", "used"])

    return importable(rows).mapInPandas(run, schema)


def coverage(title: str, cards: list[dict], count: Callable[[str], int], budget: int, weight: float = 0.6, power: float = 0.5) -> list[int]:
    """Places of cards taken one by one by gain of need coverage and relevance over cost, while the rendering fits.

    A card has ``needs`` (scores), ``relevance``, ``start``, ``heading`` and ``text``; ties
    go by relevance and then to the earlier card.
    """
    costs = [max(1, count(c["text"])) ** power for c in cards]
    reached = [0.0] * (len(cards[0]["needs"]) if cards else 0)
    taken: list[int] = []
    part = lambda i: (cards[i]["start"], cards[i]["heading"], cards[i]["text"])
    while len(taken) < len(cards):
        fits = [i for i in range(len(cards)) if i not in taken and count(render(title, [part(k) for k in [*taken, i]])) <= budget]
        worth = [((weight * sum(max(0.0, n - r) for n, r in zip(cards[i]["needs"], reached, strict=True)) / len(reached) + (1 - weight) * cards[i]["relevance"]) / costs[i], cards[i]["relevance"], -i) for i in fits]
        if not worth or max(worth)[0] <= 0:
            break
        best = -max(worth)[2]
        taken.append(best)
        reached = [max(r, n) for r, n in zip(reached, cards[best]["needs"], strict=True)]
    return taken


def covered(cards: DataFrame, titles: DataFrame, query: str, needs: list[str], budget: int, count: Callable[[str], int], **how) -> DataFrame:
    """``query, item, place``: :func:`coverage` over the cards of each query, which the search before it bounds.

    ``cards`` has ``query, item, start, heading, text, relevance`` and a column for each need; ``titles`` ``query, title``.
    """
    row = F.struct(*[F.col(c) for c in ("item", "start", "heading", "text", "relevance")], F.array(*needs).alias("needs"))
    rows = cards.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rows")).join(titles, query, "left")
    kinds = cards.schema

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                own = [dict(x) | {"needs": list(x["needs"])} for x in r["rows"]]
                out += [(r[query], own[i]["item"], k) for k, i in enumerate(coverage(r["title"] or "", own, count, budget, **how))]
            yield pdf.__class__(out, columns=[query, "item", "place"])

    return importable(rows).mapInPandas(run, f"{query} {kinds[query].dataType.simpleString()}, item {kinds['item'].dataType.simpleString()}, place bigint")


def cards(nodes: DataFrame, centrals: DataFrame, cues: int = 6) -> DataFrame:
    """``doc_id, node_id, kind, heading_path, title, excerpts, routing_text, child_headings``: what a router is shown of each node.

    Paragraphs and sentences show their whole text; other nodes their central sentence and
    those of the first ``cues`` children, from both ends inward, each span once. ``nodes``
    has ``text`` for paragraphs and sentences, ``centrals`` ``doc_id, node_id, start, end, text``.
    """
    own = centrals.select("doc_id", "node_id", F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("text").alias("text")).alias("central"))
    rows = nodes.join(own, ["doc_id", "node_id"], "left")
    child = rows.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), "start", "kind", "title", "central")
    by = Window.partitionBy("doc_id", "node_id").orderBy("start", "child")
    i, n = F.row_number().over(by) - 1, F.count(F.lit(1)).over(Window.partitionBy("doc_id", "node_id"))
    child = child.withColumn("i", i).withColumn("depth", F.least("i", n - 1 - F.col("i")))
    child = child.withColumn("visit", F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("depth", "i")))
    said = F.when((F.col("visit") <= cues) & F.col("central").isNotNull(), F.struct("visit", "central"))
    head = F.when(F.col("kind") == "heading", F.struct(F.col("start").alias("at"), F.col("child"), F.col("title")))
    below = child.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(said)).alias("said"), F.array_sort(F.collect_list(head)).alias("heads"))
    path = rows.where("kind = 'heading'").select("doc_id", F.col("title").alias("above"), F.col("start").alias("hs"), F.col("end").alias("he"))
    over = rows.select("doc_id", "node_id", "start", "end").join(path, "doc_id").where("hs <= start and end <= he").groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("hs", "above"))).alias("path"))
    rows = rows.join(below, ["doc_id", "node_id"], "left").join(over, ["doc_id", "node_id"], "left")
    leaf = F.col("kind").isin("paragraph", "sentence")
    whole = F.array(F.struct(F.col("start"), F.col("end"), F.col("text"), F.lit("full_source").alias("role")))
    own_cue = F.when(F.col("central").isNotNull(), F.array(F.struct(F.col("central.start").alias("start"), F.col("central.end").alias("end"), F.col("central.text").alias("text"), F.lit("central").alias("role")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string,role:string>>"))
    cue = F.transform(F.coalesce("said", F.array().cast("array<struct<visit:int,central:struct<start:bigint,end:bigint,text:string>>>")), lambda s: F.struct(s["central"]["start"].alias("start"), s["central"]["end"].alias("end"), s["central"]["text"].alias("text"), F.lit("child_central").alias("role")))
    both = F.concat(own_cue, cue)
    # A span is shown where it comes first; cues are few.
    once = F.transform(F.array(both), lambda xs: F.filter(xs, lambda x, k: ~F.exists(F.slice(xs, 1, k), lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]))))[0]
    heads = F.transform(F.coalesce("heads", F.array().cast("array<struct<at:bigint,child:string,title:string>>")), lambda h: h["title"])
    names = F.transform(F.coalesce("path", F.array().cast("array<struct<hs:bigint,above:string>>")), lambda p: p["above"])
    short = F.when(F.col("kind") == "sentence", F.col("text")).otherwise(F.coalesce("central.text", "title", F.lit("")))
    out = rows.select("doc_id", "node_id", "kind", names.alias("heading_path"), F.when(F.col("kind").isin("heading", "document"), F.col("title")).otherwise("").alias("title"), F.coalesce("central.text", F.lit("")).alias("central"), F.when(leaf, whole).otherwise(once).alias("excerpts"), short.alias("short"), heads.alias("child_headings"))
    lines = F.concat(F.col("heading_path"), F.array(F.coalesce("title", F.lit("")), F.col("central")), F.transform("excerpts", lambda x: x["text"]), F.col("child_headings"))
    routing = F.array_join(F.concat(F.col("heading_path"), F.array("short")), "\n")
    return out.select("doc_id", "node_id", "kind", "heading_path", "title", "excerpts", "child_headings", routing.alias("routing_text"), F.array_join(lines, "\n").alias("navigation_text"))


def option_text(question: Column, options: Column) -> Column:
    """A question with its options on lettered lines."""
    letters = F.array(*[F.lit(chr(65 + k)) for k in range(26)])
    lines = F.transform(options, lambda x, i: F.concat(F.element_at(letters, i + 1), F.lit(". "), x))
    return F.array_join(F.concat(F.array(question), lines), "\n")


def path_of(heading: Column) -> Column:
    return heading_path(heading)
