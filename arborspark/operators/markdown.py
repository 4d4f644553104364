"""Markdown to blocks, contents and content trees, as windows over lines.

A line is what ends in a line feed, with or without a carriage return before it. Fences
are settled on the fence lines of a document alone; every other rule is a window.
Offsets are code points. White space means the six ASCII characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.text import blank_before, nfkc, normal_title, slug, stripped
from arborspark.sources.work import written

#: Block grammar, after the CommonMark text: up to three blanks of indent before any mark.
FENCE = "^ {0,3}(`{3,}|~{3,})"
SHUT = "^ {0,3}(`{3,}|~{3,})[ \\t\\x0B\\f\\r]*$"
ATX = "^ {0,3}#{1,6}([ \\t]|$)"
UNDERLINE = "^ {0,3}(=+|-+)[ \\t\\x0B\\f\\r]*$"
#: Titles of a table of contents, fixed values.
CONTENTS = ("contents", "table of contents", "目录")
#: Order of node kinds that begin at one place.
KIND_ORDER = ("document", "heading", "toc", "toc_entry", "section", "paragraph", "sentence")


def _bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _fence_roles(lines: Column) -> Column:
    """For each line ``o`` (opens a fence), ``c`` (closes it) or an empty string.

    Only lines with a fence mark are folded; the roles are then laid out over all lines.
    """
    marks = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, FENCE, 1).alias("mark"), x.rlike(SHUT).alias("bare"))),
        lambda m: m["mark"] != "",
    )
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        idle = acc["open"] == ""
        shut = ~idle & m["bare"] & (F.left(m["mark"], F.lit(1)) == F.left(acc["open"], F.lit(1))) & (F.length(m["mark"]) >= F.length(acc["open"]))
        role = F.when(idle, "o").when(shut, "c").otherwise("-")
        return F.struct(F.when(idle, m["mark"]).when(shut, "").otherwise(acc["open"]).alias("open"), F.concat(acc["out"], role).alias("out"))

    def laid_out(m: Column) -> Column:
        roles = F.split(F.aggregate(m, start, step, lambda acc: acc["out"]), "")

        def spread(r: Column) -> Column:
            gap = lambda n: F.array_repeat(F.lit(""), n)
            before = lambda k: F.when(k > 0, F.get(m, k - 1)["i"]).otherwise(F.lit(-1))
            parts = F.transform(m, lambda x, k: F.concat(gap(x["i"] - before(k) - 1), F.array(F.get(r, k))))
            return F.concat(F.flatten(parts), gap(F.size(lines) - 1 - F.element_at(m, -1)["i"]))

        return F.when(F.size(m) == 0, F.array_repeat(F.lit(""), F.size(lines))).otherwise(_bound(roles, spread))

    return _bound(marks, laid_out)


def dealt(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """``rows`` dealt by document before they grow: few splits of a small table become many tasks, and no window by document moves a line."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, line, start, stop, fence``: lines without their ends, from ``start`` to the next line's start, with the start of the fence they are in."""
    docs = dealt(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    raw = docs.select("doc_id", F.split("text", "\n").alias("raw"), F.length("text").alias("size"))
    rows = raw.select("doc_id", "size", _bound(F.col("raw"), lambda x: F.zip_with(x, _fence_roles(x), lambda raw, role: F.struct(raw.alias("raw"), role.alias("role")))).alias("xs"))
    # A text has one line at least. Without "outer", Spark would fold every text once more to see that, before documents are dealt.
    rows = rows.select("doc_id", "size", F.posexplode_outer("xs").alias("pos", "x")).select("doc_id", "size", F.col("pos").cast("bigint").alias("pos"), "x.raw", "x.role")
    by = Window.partitionBy("doc_id").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("bigint")
    opened = F.count_if(F.col("role") == "o").over(by.rowsBetween(Window.unboundedPreceding, 0))
    shut = F.coalesce(F.count_if(F.col("role") == "c").over(before), F.lit(0))
    rows = rows.withColumn("start", start).withColumn("fence", F.when(opened > shut, opened))
    return rows.select("doc_id", "pos", F.rtrim(F.col("raw"), F.lit("\r")).alias("line"), "start", F.least(F.col("start") + F.length("raw") + 1, F.col("size").cast("bigint")).alias("stop"), "fence")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, block, kind, start, end, title, level, verbatim``: headings, paragraphs and fenced code.

    Lines between blank ones, headings and fences form an island. While its lines come in
    pairs of a title and an underline, these are headings; what is left is one paragraph.
    A block is told on one of its lines, so lines are made and passed over once.
    """
    rows = lines_of(docs, id_col, text_col)
    by = Window.partitionBy("doc_id").orderBy("pos")
    text = stripped(F.col("line")) != ""
    atx = F.col("fence").isNull() & F.col("line").rlike(ATX)
    rows = rows.withColumn("atx", atx).withColumn("inner", F.col("fence").isNull() & text & ~atx)
    rows = rows.withColumn("island", F.sum((~F.col("inner")).cast("int")).over(by))
    on = Window.partitionBy("doc_id", "island", "inner").orderBy("pos")
    idx = F.row_number().over(on) - 1
    rule = F.col("line").rlike(UNDERLINE)
    paired = F.when(idx % 2 == 0, F.coalesce(F.lead(rule).over(on), F.lit(False))).otherwise(rule)
    rows = rows.withColumn("idx", idx).withColumn("paired", paired).withColumn("after", F.lead("line").over(on)).withColumn("after_stop", F.lead("stop").over(on))
    rows = rows.withColumn("setext", F.col("inner") & F.min("paired").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    make = lambda kind, start, end, title, level, verbatim: F.struct(F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), title.alias("title"), level.cast("bigint").alias("level"), F.lit(verbatim).alias("verbatim"))

    # Headings are told on their first line, paragraphs on theirs, fences on their last one.
    line, start, fence = F.col("line"), F.col("start"), F.col("fence")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", fence.isNotNull() & ~fence.eqNullSafe(F.lag("fence").over(by))).withColumn("shuts", fence.isNotNull() & ~fence.eqNullSafe(F.lead("fence").over(by)))
    rows = rows.withColumn("opened", F.max(F.when(F.col("opens"), start)).over(so_far)).withColumn("said", F.max(F.when(line != "", start + F.length("line"))).over(so_far))
    whole = on.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("until", F.last(start + F.length(F.rtrim(line, F.lit(" \t\x0b\x0c\r")))).over(whole)).withColumn("goes_on", ~F.coalesce(F.lag("setext").over(on), F.lit(True)))
    bare = F.regexp_replace(stripped(F.regexp_replace("line", "^ {0,3}#{1,6}", "")), "[ \\t\\x0B\\f\\r]+#+$", "")
    none, zero = F.lit(""), F.lit(0)
    block = (
        F.when(F.col("atx"), make("heading", start, F.col("stop"), stripped(bare), F.length(F.regexp_extract("line", "^ *(#+)", 1)), False))
        .when(F.col("setext") & (F.col("idx") % 2 == 0), make("heading", start, F.col("after_stop"), stripped(line), F.when(F.ltrim("after").startswith("="), 1).otherwise(2), False))
        .when(F.col("inner") & ~F.col("setext") & ~F.col("goes_on"), make("paragraph", start + blank_before(line), F.col("until"), none, zero, False))
        .when(F.col("shuts"), make("paragraph", F.col("opened"), F.col("said"), none, zero, True))
    )
    out = rows.select("doc_id", block.alias("b")).where("b is not null").select("doc_id", "b.*")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return out.select("doc_id", number.cast("bigint").alias("block"), "kind", "start", "end", "title", "level", "verbatim")


def with_text(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``text``, the source of each span: spans go to their document as one list, so a text is moved once."""
    names = [c for c in found.columns if c != "doc_id"]
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("xs"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("source")).join(spans, "doc_id")
    rows = rows.select("doc_id", F.explode(F.transform("xs", lambda x: F.struct(x.alias("span"), F.substring(F.col("source"), x["start"] + 1, x["end"] - x["start"]).alias("text")))).alias("r"))
    return rows.select("doc_id", "r.span.*", "r.text")


def heading_parents(heads: DataFrame, levels: int = 6) -> DataFrame:
    """Adds ``parent`` (the ``start`` of the heading above, null at the top) and ``until`` (where the next heading of this level or a higher one begins).

    The heading above is the nearest one before with a lower level; one window value for
    each level tells it.
    """
    by = Window.partitionBy("doc_id").orderBy("start")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    level, start = F.col("level"), F.col("start")
    above = [F.last(F.when(level < v, start), ignorenulls=True).over(before) for v in range(1, levels + 1)]
    next_one = [F.first(F.when(level <= v, start), ignorenulls=True).over(behind) for v in range(1, levels + 1)]
    pick = lambda xs: reduce(lambda acc, v: F.when(level == v, xs[v - 1]).otherwise(acc), range(1, levels + 1), F.lit(None).cast("bigint"))
    return heads.withColumn("parent", pick(above)).withColumn("until", pick(next_one))


def units(found: DataFrame) -> DataFrame:
    """``doc_id, paragraph, section, heading, start, end, verbatim`` of paragraph blocks: the heading path ``A ::: B`` and a section for each heading."""
    by = Window.partitionBy("doc_id").orderBy("block")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("kind") == "heading"
    last = lambda v: F.last(F.when(is_head & (F.col("level") <= v), F.struct(F.col("level"), F.col("title"))), ignorenulls=True).over(so_far)
    # The open heading of level v is the last one of a level up to v, if that is v itself.
    rows = found.select("*", *[last(v).alias(f"h{v}") for v in range(1, 7)], F.sum(is_head.cast("int")).over(so_far).cast("bigint").alias("section"))
    path = F.array_join(F.filter(F.array(*[F.when(F.col(f"h{v}")["level"] == v, F.col(f"h{v}")["title"]) for v in range(1, 7)]), lambda x: x.isNotNull()), " ::: ")
    rows = rows.withColumn("heading", path).where(~is_head)
    number = F.row_number().over(by) - 1
    return rows.select("doc_id", number.cast("bigint").alias("paragraph"), "section", "heading", "start", "end", "verbatim")


def hinted(found: DataFrame, hints: DataFrame) -> DataFrame:
    """``doc_id, start, issue``: what is wrong with a heading hint (``doc_id, start, end, title, level``); no row, if nothing is.

    A hint must lie in exactly one block that is not verbatim, name its own source text, and
    overlap no other hint; on a native heading it may only repeat it.
    """
    rows = hints.select("doc_id", F.col("start").alias("hs"), F.col("end").alias("he"), "title", "level")
    by = Window.partitionBy("doc_id").orderBy("hs", "he")
    rows = rows.withColumn("laps", F.coalesce(F.max("he").over(by.rowsBetween(Window.unboundedPreceding, -1)) > F.col("hs"), F.lit(False)))
    pairs = rows.join(found.select("doc_id", "kind", "start", "end", "verbatim", F.col("title").alias("own"), "text"), "doc_id", "left").where("start is null or (start < he and hs < end)")
    one = pairs.groupBy("doc_id", "hs", "he", "title", "level", "laps").agg(F.count("start").alias("n"), F.min(F.struct("kind", "start", "verbatim", "own", "text")).alias("b"))
    all_hints = rows.join(one, ["doc_id", "hs", "he", "title", "level", "laps"], "left")
    said = stripped(F.substring(F.col("b.text"), F.col("hs") - F.col("b.start") + 1, F.col("he") - F.col("hs")))
    issue = (
        F.when((F.col("hs") < 0) | (F.col("he") <= F.col("hs")) | ~F.col("level").between(1, 64), "span_or_level")
        .when(F.col("laps"), "overlap")
        .when(stripped(F.col("title")) == "", "title")
        .when(F.coalesce("n", F.lit(0)) != 1, "not_one_block")
        .when((F.col("b.kind") == "heading") & ((F.col("hs") != F.col("b.start")) | (normal_title(F.col("title")) != normal_title(F.col("b.own")))), "conflict")
        .when((F.col("b.kind") != "heading") & (F.col("b.verbatim") | (said != F.col("title"))), "not_source_text")
    )
    return all_hints.select("doc_id", F.col("hs").alias("start"), issue.alias("issue")).where("issue is not null")


def with_hints(found: DataFrame, hints: DataFrame) -> DataFrame:
    """The blocks (with ``text``) with valid hints made headings: a paragraph is cut around each; native headings win.

    The pieces before and after a hint are paragraphs, without their outer white space.
    """
    bad = hinted(found, hints).select("doc_id", "start").distinct()
    good = hints.join(bad, ["doc_id", "start"], "left_anti").select("doc_id", F.struct("start", "end", "title", "level").alias("h"))
    own = found.select("doc_id", F.col("start").alias("bs"), F.col("end").alias("be")).where(F.col("kind") == "paragraph")
    inside = good.join(own, "doc_id").where((F.col("h.start") >= F.col("bs")) & (F.col("h.end") <= F.col("be")))
    lists = inside.groupBy("doc_id", F.col("bs").alias("start")).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    rows = found.drop("block").join(lists, ["doc_id", "start"], "left")
    piece = "struct<kind:string,start:bigint,end:bigint,title:string,level:bigint,verbatim:boolean,text:string>"
    part = lambda kind, s, e, title, level, text: F.struct(kind.alias("kind"), s.cast("bigint").alias("start"), e.cast("bigint").alias("end"), title.alias("title"), level.cast("bigint").alias("level"), F.lit(False).alias("verbatim"), text.alias("text"))
    cut = lambda s, e: F.substring("text", s - F.col("start") + 1, e - s)

    def between(s: Column, e: Column) -> Column:
        raw = cut(s, e)
        begin = s + blank_before(raw)
        return part(F.lit("paragraph"), begin, begin + F.length(stripped(raw)), F.lit(""), F.lit(0), stripped(raw))

    ended = lambda k: F.when(k > 0, F.get("hs", k - 1)["end"]).otherwise(F.col("start"))
    heads = F.transform("hs", lambda h, k: F.array(between(ended(k), h["start"]), part(F.lit("heading"), h["start"], h["end"], h["title"], h["level"], cut(h["start"], h["end"]))))
    tail = F.array(between(F.element_at("hs", -1)["end"], F.col("end")))
    whole = F.array(F.struct("kind", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "title", F.col("level").cast("bigint").alias("level"), "verbatim", "text"))
    parts = F.when(F.col("hs").isNull(), whole.cast(f"array<{piece}>")).otherwise(F.filter(F.concat(F.flatten(heads), tail), lambda x: (x["kind"] == "heading") | (x["text"] != "")).cast(f"array<{piece}>"))
    out = rows.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1
    return out.withColumn("block", number.cast("bigint"))


#: What a line of a table of contents may be: a link to an anchor, or a title, dots and a page.
LIST_MARK = r"^([-*+]|[0-9]+[.)])[ \t]+"
LINK = r"^\[([^\]]+)\]\(#([^ \t)]+)\)$"
PRINTED = r"^(.+?)[ \t]*[.]{2,}[ \t]*([0-9]+|[ivxlcdmIVXLCDM]+)$"


def contents(found: DataFrame) -> DataFrame:
    """``doc_id, block, entry, start, end, title, anchor, page``: lines of the tables of contents, of blocks with ``text``.

    Blocks after a heading that is titled as a table of contents, up to the next heading,
    count where every line of theirs is an entry. Anchors have their percent codes decoded.
    """
    return _entries(_listed(found).where("listed")).drop("at")


def _bare(line: Column) -> Column:
    return F.regexp_replace(stripped(line), LIST_MARK, "")


def _listed(found: DataFrame) -> DataFrame:
    """Adds ``listed``: whether a block with ``text`` is one of a table of contents."""
    by = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    under = F.last(F.when(F.col("kind") == "heading", F.struct("title")), ignorenulls=True).over(by)
    titled = (F.col("kind") == "paragraph") & ~F.col("verbatim") & normal_title(F.col("over")["title"]).isin(*CONTENTS)
    listed = F.forall(F.split("text", "\n"), lambda x: (stripped(x) == "") | _bare(x).rlike(LINK) | stripped(x).rlike(PRINTED))
    return found.withColumn("over", under).withColumn("listed", F.when(titled, listed).otherwise(False) & (stripped(F.col("text")) != "")).drop("over")


def _entries(listed: DataFrame) -> DataFrame:
    """:func:`contents` of the blocks that are listed, with ``at``, where the block begins."""
    one = _bare
    rows = listed.select("doc_id", "block", F.col("start").alias("at"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id", "block").orderBy("pos")
    begin = F.col("at") + F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + blank_before(F.col("line"))
    rows = rows.withColumn("begin", begin.cast("bigint")).where(stripped(F.col("line")) != "")
    is_link = one(F.col("line")).rlike(LINK)
    title = stripped(F.when(is_link, F.regexp_extract(one(F.col("line")), LINK, 1)).otherwise(F.regexp_extract(stripped(F.col("line")), PRINTED, 1)))
    anchor = F.when(is_link, F.try_url_decode(F.replace(F.regexp_extract(one(F.col("line")), LINK, 2), F.lit("+"), F.lit("%2B"))))
    number = (F.row_number().over(order) - 1).cast("bigint")
    return rows.select("doc_id", "block", "at", number.alias("entry"), F.col("begin").alias("start"), (F.col("begin") + F.length(stripped(F.col("line")))).alias("end"), title.alias("title"), anchor.alias("anchor"), F.when(~is_link, F.regexp_extract(stripped(F.col("line")), PRINTED, 2)).alias("page"))


def anchors(heads: DataFrame) -> DataFrame:
    """``doc_id, start, title, slug``: repeated slugs of a document get the next number that no slug before has.

    Equal slugs are numbered by their place. Only where a title spells out what another one's
    number would make (``a-1`` beside ``a``) does a slug depend on all before it; headings of
    such documents are walked in order.
    """
    rows = heads.select("doc_id", "start", "title", slug(nfkc(F.col("title"))).alias("base"))
    stems = rows.where(F.col("base").rlike("-[0-9]+$")).select("doc_id", F.regexp_replace("base", "-[0-9]+$", "").alias("base"))
    tangled = rows.select("doc_id", "base").join(stems, ["doc_id", "base"], "left_semi").select("doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("start")) - 1
    plain = rows.join(tangled, "doc_id", "left_anti").withColumn("nth", nth)
    plain = plain.select("doc_id", "start", "title", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("nth").cast("string"))).alias("slug"))

    def walk(pdf):
        pdf = pdf.sort_values("start")
        taken: dict[str, int] = {}  # of each name: the last number tried behind it
        names = []
        for base in pdf["base"]:
            name = base
            while name in taken:
                taken[base] += 1
                name = f"{base}-{taken[base]}"
            taken[name] = 0
            names.append(name)
        return pdf[["doc_id", "start", "title"]].assign(slug=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    walked = rows.join(tangled, "doc_id", "left_semi").groupBy("doc_id").applyInPandas(walk, f"doc_id {kind}, start bigint, title string, slug string")
    return plain.unionByName(walked)


def resolved(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """``doc_id, start, target, status`` of contents entries: the heading (its ``start``) that they name, by anchor or else title.

    A heading that a table of contents stands under is no target.
    """
    named = anchors(heads).select("doc_id", "start", "slug", normal_title(nfkc(F.col("title"))).alias("name"), normal_title(F.col("title")).isin(*CONTENTS).alias("own"))
    by_slug = named.select("doc_id", F.col("slug").alias("anchor"), F.struct("start", "own").alias("s"))
    by_name = named.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "own")).alias("t"))
    rows = entries.withColumn("name", normal_title(nfkc(F.col("title")))).join(by_slug, ["doc_id", "anchor"], "left").join(by_name, ["doc_id", "name"], "left")
    linked = F.col("anchor").isNotNull()
    n = F.when(linked, F.col("s").isNotNull().cast("int")).otherwise(F.coalesce("n", F.lit(0)))
    hit = F.when(linked, F.col("s")).otherwise(F.col("t"))
    fine = (n == 1) & ~hit["own"]
    return rows.select("doc_id", "start", F.when(fine, hit["start"]).alias("target"), F.when(fine, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"))


def index(docs: DataFrame, topics, found: DataFrame | None = None, sentences=None, title_col: str | None = None) -> DataFrame:
    """The content tree of Markdown documents: ``doc_id, node_id, parent_id, kind, title, start, end, depth``.

    ``topics(units)`` gives ``doc_id, paragraph, topic`` for runs of paragraphs between
    headings (a run stands for a document there). Headings nest by level; contents and their
    entries, topic sections, paragraphs and sentences hang below the heading before them.
    Ids number the nodes in source order, outer ones first.
    """
    from arborspark.operators import parse

    sentences = sentences or parse.sentences
    # Blocks, and then paragraphs with their topics, are read by several branches of the plan.
    found = written(with_text(blocks(docs), docs)) if found is None else found
    source = docs.select("doc_id", "text").where("text is not null")
    heads = heading_parents(found.where("kind = 'heading'"))
    by = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = _listed(found)
    border = (F.col("kind") == "heading") | F.col("listed")
    rows = rows.withColumn("run", F.sum(border.cast("int")).over(by)).withColumn("under", F.last(F.when(F.col("kind") == "heading", F.col("start")), ignorenulls=True).over(by))
    toc = rows.where("listed")
    body = rows.where(~border).withColumn("paragraph", F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1)
    runs = body.select(F.struct("doc_id", "run").alias("doc_id"), F.col("paragraph").cast("bigint").alias("paragraph"), "text", "start", "end")
    topic = topics(runs).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.run").alias("run"), "paragraph", "topic")
    body = written(body.join(topic, ["doc_id", "run", "paragraph"]))
    # A parent is known by its kind and start until ids are given.
    key = lambda kind, start: F.concat_ws(":", F.lit(kind), start.cast("string"))
    above = lambda start: F.coalesce(F.when(start.isNotNull(), key("heading", start)), F.lit("document:0"))
    node = lambda df, kind, title, start, end, parent: df.select("doc_id", F.lit(kind).alias("kind"), title.alias("title"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), parent.alias("up"), key(kind, start).alias("own"))
    size = source.select("doc_id", F.length("text").cast("bigint").alias("size"), *([F.col(title_col).alias("named")] if title_col else []))
    heads = heads.join(size.select("doc_id", "size"), "doc_id")
    groups = body.groupBy("doc_id", "run", "topic").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("under", "start").alias("under"))
    body = body.withColumn("first", F.min("start").over(Window.partitionBy("doc_id", "run", "topic")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "first").orderBy("start")).cast("string")
    inner = sentences(body.select("doc_id", "paragraph", "start", F.when(F.col("verbatim"), F.lit("")).otherwise(F.col("text")).alias("text"), "verbatim", F.col("start").alias("first")), ["doc_id", "paragraph", "first"])
    whole = body.where("verbatim").select("doc_id", "paragraph", "start", "end", "text", F.col("start").alias("first"))
    inner = inner.select("doc_id", "paragraph", "start", "end", "text", "first").unionByName(whole)
    parts = [
        node(size, "document", F.lit(None).cast("string"), F.lit(0), F.col("size"), F.lit(None).cast("string")),
        node(heads, "heading", F.col("title"), F.col("start"), F.coalesce("until", "size"), above(F.col("parent"))),
        node(toc, "toc", F.lit("Contents entries"), F.col("start"), F.col("end"), above(F.col("under"))),
        node(_entries(toc), "toc_entry", F.col("title"), F.col("start"), F.col("end"), key("toc", F.col("at"))),
        node(groups, "section", F.lit(None).cast("string"), F.col("start"), F.col("end"), above(F.col("under"))),
        node(body, "paragraph", F.concat(F.lit("Paragraph "), nth), F.col("start"), F.col("end"), key("section", F.col("first"))),
        node(inner, "sentence", F.col("text"), F.col("start"), F.col("end"), key("paragraph", F.col("first"))),
    ]
    rows = written(reduce(DataFrame.unionByName, parts))
    order = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", order)) - 1
    rows = rows.withColumn("node_id", F.when(F.col("kind") == "document", F.lit("root")).otherwise(F.concat(F.lit("n"), F.lpad(number.cast("string"), 6, "0"))))
    up = rows.select("doc_id", F.col("own").alias("up"), F.col("node_id").alias("parent_id"))
    return rows.join(up, ["doc_id", "up"], "left").select("doc_id", "node_id", "parent_id", "kind", "title", "start", "end")


def outline(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, parent_id, kind, title`` of headings and contents, as a reader sees them."""
    return nodes.where(F.col("kind").isin("heading", "toc", "toc_entry")).select("doc_id", "node_id", "parent_id", "kind", "title", "start")


def scope(nodes: DataFrame, targets: DataFrame, asked: DataFrame) -> DataFrame:
    """``doc_id, asked, node_id``: the nodes below (and with) each asked node; an entry of a table of contents stands for its heading.

    ``targets`` has ``doc_id, start, target`` of entries; an entry without a target gives no rows.
    """
    rows = asked.join(nodes.select("doc_id", F.col("node_id").alias("asked"), "kind", "start", "end"), ["doc_id", "asked"])
    rows = rows.join(targets.select("doc_id", "start", "target"), ["doc_id", "start"], "left")
    is_entry = F.col("kind") == "toc_entry"
    heads = nodes.where("kind = 'heading'").select("doc_id", F.col("start").alias("target"), F.col("start").alias("hs"), F.col("end").alias("he"))
    rows = rows.join(heads, ["doc_id", "target"], "left").where(~is_entry | F.col("hs").isNotNull())
    spans = rows.select("doc_id", "asked", F.when(is_entry, F.col("hs")).otherwise(F.col("start")).alias("a"), F.when(is_entry, F.col("he")).otherwise(F.col("end")).alias("b"))
    return nodes.join(spans, "doc_id").where("start >= a and end <= b").select("doc_id", "asked", "node_id")
