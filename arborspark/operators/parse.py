"""Documents to units, sentences and blocks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.arrays import let, running
from arborspark.functions.text import blank_before, sentence_pieces, slug, stripped
from arborspark.operators import markdown

BLANK = " \t\n\x0b\x0c\r"


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, start, end, text``: the lines with text, with exact offsets; in one pass, by document."""
    def placed(lines):
        ends = running(F.transform(lines, lambda x: F.length(x) + 1), lambda a, b: a + b, 0)
        return let(ends, lambda e: F.transform(lines, lambda x, i: F.struct((e[i] - F.length(x) - 1).cast("bigint").alias("start"), x.alias("text"))))

    full = F.filter(let(F.split(text_col, "\n"), placed), lambda x: stripped(x["text"]) != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(full).alias("paragraph", "x"))
    start, text = F.col("x.start"), F.col("x.text")
    return rows.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def sentences(units: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sentence, start, end, text`` of units with ``start, text``; in one pass, by unit."""
    def placed(pieces):
        ends = running(F.transform(pieces, lambda x: F.length(x)), lambda a, b: a + b, 0)
        return let(ends, lambda e: F.transform(pieces, lambda x, i: F.struct((e[i] - F.length(x)).alias("at"), x.alias("piece"))))

    full = F.filter(let(sentence_pieces(F.col("text")), placed), lambda x: stripped(x["piece"]) != "")
    rows = units.select(*keys, "start", F.posexplode(full).alias("sentence", "x"))
    begin = (F.col("start") + F.col("x.at") + blank_before(F.col("x.piece"))).cast("bigint")
    body = stripped(F.col("x.piece"))
    return rows.select(*keys, F.col("sentence").cast("bigint").alias("sentence"), begin.alias("start"), (begin + F.length(body)).alias("end"), body.alias("text"))


def joined_documents(parts: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """``doc_id, paragraph, start, end, text``: parts with text joined by a blank line, as offsets into the whole."""
    rows = parts.where(stripped(F.col(text)) != "")
    by = Window.partitionBy(doc).orderBy(order)
    start = F.coalesce(F.sum(F.length(text) + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start)
    return rows.select(F.col(doc).alias("doc_id"), (F.row_number().over(by) - 1).cast("bigint").alias("paragraph"), "start", (F.col("start") + F.length(text)).alias("end"), F.col(text).alias("text"))


class BlockReader:
    """The block grammar of :mod:`arborspark.operators.markdown` on one text, in plain Python, for callers without a table.

    ``read`` gives ``(kind, start, end, title, level, verbatim)`` in source order.
    """

    def __init__(self) -> None:
        self.fence, self.shut, self.atx, self.rule = (re.compile(p.replace("\\x0B", "\x0b")) for p in (markdown.FENCE, markdown.SHUT, markdown.ATX, markdown.UNDERLINE))

    def fences(self, lines: list[str]) -> dict[int, int]:
        """Number of each line in a fence, to that of the fence's first line."""
        inside, first, mark = {}, None, ""
        for k, line in enumerate(lines):
            found = self.fence.match(line)
            if first is None and found:
                first, mark = k, found[1]
                inside[k] = k
            elif first is not None:
                inside[k] = first
                if found and self.shut.match(line) and found[1][0] == mark[0] and len(found[1]) >= len(mark):
                    first = None
        return inside

    def read(self, source: str) -> list[tuple[str, int, int, str, int, bool]]:
        raw = source.split("\n")
        at = [0]
        for line in raw:
            at.append(at[-1] + len(line) + 1)
        at = [min(x, len(source)) for x in at]
        lines = [x.rstrip("\r") for x in raw]
        inside, out, k = self.fences(lines), [], 0
        plain = lambda j: j < len(lines) and j not in inside and bool(lines[j].strip(BLANK)) and not self.atx.match(lines[j])
        for first in sorted(set(inside.values())):
            last = max(j for j, f in inside.items() if f == first and lines[j])
            out.append(("paragraph", at[first], at[last] + len(lines[last]), "", 0, True))
        while k < len(lines):
            if not plain(k):
                if k not in inside and lines[k].strip(BLANK):
                    marks = re.match(" *(#+)", lines[k])
                    rest = lines[k][marks.end() :].strip(BLANK)
                    out.append(("heading", at[k], at[k + 1], re.sub(f"[{BLANK}]+#+$", "", rest), len(marks[1]), False))
                k += 1
                continue
            # An island: titles and their underlines as long as these come in pairs, then one paragraph.
            while plain(k) and plain(k + 1) and self.rule.match(lines[k + 1]):
                out.append(("heading", at[k], at[k + 2], lines[k].strip(BLANK), 1 if lines[k + 1].strip().startswith("=") else 2, False))
                k += 2
            first = k
            while plain(k):
                k += 1
            if k > first:
                start, end = at[first] + len(lines[first]) - len(lines[first].lstrip(BLANK)), at[k - 1] + len(lines[k - 1].rstrip(BLANK))
                out.append(("paragraph", start, end, "", 0, False))
        return sorted(out, key=lambda b: b[1])


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, block, kind, start, end, title, level, verbatim``: headings, paragraphs and fenced code."""
    return markdown.blocks(docs, id_col, text_col)


def contents_entries(blocks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Entries of blocks all of whose lines are links or dotted titles with a page: ``keys, entry, title, anchor, page``."""
    bare = lambda x: F.regexp_replace(x, markdown.LIST_MARK, "")
    lines = F.filter(F.transform(F.split(text_col, "\n"), stripped), lambda x: x != "")
    rows = blocks.select(*keys, lines.alias("entry_lines")).where((F.size("entry_lines") > 0) & F.forall("entry_lines", lambda x: bare(x).rlike(markdown.LINK) | x.rlike(markdown.PRINTED)))
    rows = rows.select(*keys, F.posexplode("entry_lines").alias("entry", "line"))
    is_link = bare(F.col("line")).rlike(markdown.LINK)
    of_link, of_page = (lambda k: F.regexp_extract(bare(F.col("line")), markdown.LINK, k)), (lambda k: F.regexp_extract("line", markdown.PRINTED, k))
    title = stripped(F.when(is_link, of_link(1)).otherwise(of_page(1)))
    return rows.select(*keys, F.col("entry").cast("bigint").alias("entry"), title.alias("title"), F.when(is_link, of_link(2)).alias("anchor"), F.when(~is_link, of_page(2)).alias("page"))


def resolve_contents(entries: DataFrame, headings: DataFrame, keys: list[str]) -> DataFrame:
    """Entries joined to the heading they name, by anchor or else title: resolved, ambiguous or unresolved.

    Repeated slugs of a document are numbered in heading order.
    """
    order = Window.partitionBy(*keys, "base").orderBy("block")
    named = headings.withColumn("base", slug(F.col("title"))).withColumn("nth", F.row_number().over(order) - 1)
    named = named.withColumn("slug", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", "nth")))
    from arborspark.functions.text import normal_title

    by_title = named.groupBy(*keys, normal_title(F.col("title")).alias("name")).agg(F.count(F.lit(1)).alias("n_title"), F.min("block").alias("title_block"))
    by_slug = named.select(*keys, F.col("slug").alias("anchor"), F.col("block").alias("slug_block"))
    rows = entries.withColumn("name", normal_title(F.col("title"))).join(by_title, [*keys, "name"], "left").join(by_slug, [*keys, "anchor"], "left")
    n = F.when(F.col("anchor").isNotNull(), F.col("slug_block").isNotNull().cast("int")).otherwise(F.coalesce("n_title", F.lit(0)))
    target = F.when(F.col("anchor").isNotNull(), F.col("slug_block")).when(F.col("n_title") == 1, F.col("title_block"))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return rows.select(*keys, "entry", "title", target.alias("target_block"), status.alias("status"))
