"""Queries over Markdown structure: blocks, units, contents, hints and the content tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborspark.operators import markdown, scopes, segment
from arborspark.plans.corpus import BLANKS, jaccard_sql, posterior_sql, set_sql
from arborspark.plans.registry import load, query
from arborspark.sources.work import written

#: A guide for each customer: contents with links, a printed entry and a dead one, nested and repeated headings, a fence, underlined titles.
GUIDE = (
    r"concat('# Guide ', c_custkey, '\n\n## Contents\n\n- [Part A](#part-a)\n* [Second](#part-a-1)\n1. [Gone](#no-such)\nClosing words .... 7\nPart A .. iv\n\n', "
    r"'## Part A ##\n\n', c_comment_or_name, ' begins here. It goes on!\nsecond line of it\n\nAnother topic of ', c_custkey % 11, ' follows. And ends.\n\n', "
    r"'### Detail ', c_custkey % 7, '\n   ~~~~\n# not a heading\n~~~\n~~~~  \nBody after code.\n\n', "
    r"CASE WHEN c_custkey % 3 = 0 THEN '## Part A\nA repeated title with text.\n\n' ELSE '#### Deep\n' END, "
    r"'Closing words\n---\n---\nThe end of ', c_custkey, '.\n***\n\nLast title\n=====\n', CASE WHEN c_custkey % 5 = 0 THEN '```\nopen to the end' ELSE '' END)"
)


def guide_expr(name: str) -> str:
    return GUIDE.replace("c_comment_or_name", name)


def _guides(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(guide_expr("c_name")).alias("text"))


_SQL_GUIDE = guide_expr("c_name").replace(r"\n", "' || chr(10) || '")
#: Lines, fences (walked over fence lines only), islands and blocks.
BLOCKS = rf"""guides AS MATERIALIZED (SELECT c_custkey AS doc_id, {_SQL_GUIDE} AS text FROM customer),
raw_lines AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos, length(text) AS size FROM guides),
at_lines AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS mark FROM raw_lines),
fence_lines AS MATERIALIZED (SELECT doc_id, pos, mark, regexp_matches(line, '^ {{0,3}}(`{{3,}}|~{{3,}})[ \t]*$') AS bare, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM at_lines WHERE mark <> ''),
fence_walk AS (SELECT doc_id, k, pos, mark AS open, 'o' AS role FROM fence_lines WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, n.pos, CASE WHEN w.open = '' THEN n.mark WHEN n.bare AND left(n.mark, 1) = left(w.open, 1) AND length(n.mark) >= length(w.open) THEN '' ELSE w.open END,
    CASE WHEN w.open = '' THEN 'o' WHEN n.bare AND left(n.mark, 1) = left(w.open, 1) AND length(n.mark) >= length(w.open) THEN 'c' ELSE '-' END
  FROM fence_walk w JOIN fence_lines n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
fenced AS (SELECT l.*, least(l.start + length(line) + 1, size) AS stop, count(*) FILTER (role = 'o') OVER w AS opened, coalesce(count(*) FILTER (role = 'c') OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shut
  FROM at_lines l LEFT JOIN fence_walk f ON f.doc_id = l.doc_id AND f.pos = l.pos WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.pos)),
kinds AS (SELECT *, CASE WHEN opened > shut THEN opened END AS fence, opened <= shut AND regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t]|$)') AS atx FROM fenced),
inners AS (SELECT *, fence IS NULL AND NOT atx AND trim(line, {BLANKS}) <> '' AS inner_line, regexp_matches(line, '^ {{0,3}}(=+|-+)[ \t]*$') AS rule FROM kinds),
islands_of AS (SELECT *, sum((NOT inner_line)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM inners),
placed_lines AS (SELECT *, row_number() OVER w - 1 AS idx, lead(rule) OVER w AS next_rule, lead(line) OVER w AS next_line, lead(stop) OVER w AS next_stop FROM islands_of WINDOW w AS (PARTITION BY doc_id, island, inner_line ORDER BY pos)),
paired AS MATERIALIZED (SELECT *, inner_line AND bool_and(CASE WHEN idx % 2 = 0 THEN coalesce(next_rule, false) ELSE rule END) OVER (PARTITION BY doc_id, island, inner_line ORDER BY pos) AS setext FROM placed_lines),
all_blocks AS (
  SELECT doc_id, 'heading' AS kind, start, stop AS "end", regexp_replace(trim(regexp_replace(line, '^ {{0,3}}#{{1,6}}', ''), {BLANKS}), '[ \t]+#+$', '') AS title, length(regexp_extract(line, '^ *(#+)', 1)) AS level, false AS verbatim FROM paired WHERE atx
  UNION ALL SELECT doc_id, 'heading', start, next_stop, trim(line, {BLANKS}), CASE WHEN starts_with(ltrim(next_line), '=') THEN 1 ELSE 2 END, false FROM paired WHERE setext AND idx % 2 = 0
  UNION ALL SELECT doc_id, 'paragraph', min(start) + arg_min(length(line) - length(ltrim(line, {BLANKS})), pos), arg_max(start + length(rtrim(line, {BLANKS})), pos), '', 0, false FROM paired WHERE inner_line AND NOT setext GROUP BY doc_id, island
  UNION ALL SELECT doc_id, 'paragraph', min(start), max(start + length(line)) FILTER (line <> ''), '', 0, true FROM paired WHERE fence IS NOT NULL GROUP BY doc_id, fence),
blocks AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS block, kind, start, "end", title, CAST(level AS BIGINT) AS level, verbatim, substr(text, start + 1, "end" - start) AS text FROM all_blocks JOIN guides USING (doc_id))"""
BLOCK_COLUMNS = 'doc_id, block, kind, start, "end", title, level, verbatim'


@query(f"WITH RECURSIVE {BLOCKS} SELECT {BLOCK_COLUMNS} FROM blocks")
def guide_blocks(spark, sf):
    return markdown.blocks(_guides(spark, sf))


HEADS = """heads AS MATERIALIZED (SELECT h.doc_id, h.block, h.start, h.title, h.level, (SELECT max(p.start) FROM blocks p WHERE p.kind = 'heading' AND p.doc_id = h.doc_id AND p.start < h.start AND p.level < h.level) AS parent,
  (SELECT min(p.start) FROM blocks p WHERE p.kind = 'heading' AND p.doc_id = h.doc_id AND p.start > h.start AND p.level <= h.level) AS until FROM blocks h WHERE h.kind = 'heading')"""


@query(f"WITH RECURSIVE {BLOCKS}, {HEADS} SELECT doc_id, start, title, level, parent, until FROM heads")
def guide_headings(spark, sf):
    heads = markdown.blocks(_guides(spark, sf)).where("kind = 'heading'")
    return markdown.heading_parents(heads).select("doc_id", "start", "title", "level", "parent", "until")


@query(f"""WITH RECURSIVE {BLOCKS}, {HEADS}, trail AS (SELECT doc_id, start, start AS top, title AS path FROM heads WHERE parent IS NULL
  UNION ALL SELECT h.doc_id, h.start, t.top, t.path || ' ::: ' || h.title FROM heads h JOIN trail t ON t.doc_id = h.doc_id AND t.start = h.parent),
numbered AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY block) AS section, max(CASE WHEN kind = 'heading' THEN start END) OVER (PARTITION BY doc_id ORDER BY block) AS under FROM blocks)
SELECT n.doc_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.block) - 1 AS paragraph, CAST(n.section AS BIGINT) AS section, coalesce(t.path, '') AS heading, n.start, n."end", n.verbatim
FROM numbered n LEFT JOIN trail t ON t.doc_id = n.doc_id AND t.start = n.under WHERE n.kind = 'paragraph'""")
def document_units(spark, sf):
    """Paragraphs of Markdown with the path of the headings that they stand under."""
    return markdown.units(markdown.blocks(_guides(spark, sf)))


ENTRY_LINE = r"^([-*+]|[0-9]+[.)])[ \t]+"
LINKED = r"^\[([^\]]+)\]\(#([^ \t)]+)\)$"
PRINTED = r"^(.+?)[ \t]*[.]{2,}[ \t]*([0-9]+|[ivxlcdmIVXLCDM]+)$"
TITLE = rf"lower(trim(regexp_replace({{x}}, '[ \t\n]+', ' ', 'g')))"
SLUG = r"regexp_replace(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_ \t-]', '', 'g')), '[ \t]', '-', 'g')"
ENTRIES = rf"""under_heads AS (SELECT *, arg_max(CASE WHEN kind = 'heading' THEN title END, CASE WHEN kind = 'heading' THEN block END) OVER (PARTITION BY doc_id ORDER BY block) AS under FROM blocks),
toc_lines AS (SELECT doc_id, block, start AS at0, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM under_heads WHERE kind = 'paragraph' AND NOT verbatim AND {TITLE.format(x='under')} IN ('contents', 'table of contents', '目录')),
toc_marked AS (SELECT *, trim(line, {BLANKS}) AS s, regexp_replace(trim(line, {BLANKS}), '{ENTRY_LINE}', '') AS bare FROM toc_lines),
toc_good AS (SELECT *, regexp_matches(bare, '{LINKED}') AS is_link, bool_and(s = '' OR regexp_matches(bare, '{LINKED}') OR regexp_matches(s, '{PRINTED}')) OVER (PARTITION BY doc_id, block) AS good,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM toc_marked),
entries AS MATERIALIZED (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) - 1 AS entry, CAST(at0 + ahead + length(line) - length(ltrim(line, {BLANKS})) AS BIGINT) AS start, CAST(at0 + ahead + length(line) - length(ltrim(line, {BLANKS})) + length(s) AS BIGINT) AS "end",
  trim(CASE WHEN is_link THEN regexp_extract(bare, '{LINKED}', 1) ELSE regexp_extract(s, '{PRINTED}', 1) END) AS title, CASE WHEN is_link THEN regexp_extract(bare, '{LINKED}', 2) END AS anchor, CASE WHEN NOT is_link THEN regexp_extract(s, '{PRINTED}', 2) END AS page FROM toc_good WHERE good AND s <> ''),
slugs AS (SELECT doc_id, start, title, {TITLE.format(x='title')} AS name, {SLUG.format(x='title')} AS base, row_number() OVER (PARTITION BY doc_id, {SLUG.format(x='title')} ORDER BY start) - 1 AS nth FROM blocks WHERE kind = 'heading'),
named_heads AS MATERIALIZED (SELECT *, CASE WHEN nth = 0 THEN base ELSE base || '-' || nth END AS slug, name IN ('contents', 'table of contents', '目录') AS own FROM slugs),
hits AS (SELECT e.doc_id, e.start, e.anchor, count(h.start) AS n, min(h.start) AS target, bool_or(h.own) AS own FROM entries e LEFT JOIN named_heads h ON h.doc_id = e.doc_id AND CASE WHEN e.anchor IS NOT NULL THEN h.slug = e.anchor ELSE h.name = {TITLE.format(x='e.title')} END GROUP BY ALL),
targets AS MATERIALIZED (SELECT doc_id, start, CASE WHEN n = 1 AND NOT own THEN target END AS target, CASE WHEN n = 1 AND NOT own THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM hits)"""


@query(f"WITH RECURSIVE {BLOCKS}, {ENTRIES} SELECT * FROM entries")
def guide_contents(spark, sf):
    return markdown.contents(_found(spark, sf))


def _found(spark, sf):
    docs = _guides(spark, sf)
    return written(markdown.with_text(markdown.blocks(docs), docs))


def _targets(found):
    return markdown.resolved(markdown.contents(found), found.where("kind = 'heading'"))


@query(f"WITH RECURSIVE {BLOCKS}, {ENTRIES} SELECT * FROM targets")
def guide_targets(spark, sf):
    """Entries of tables of contents and the headings they lead to."""
    return _targets(_found(spark, sf))


#: Topic runs between headings and contents, cut as in the topic queries; sentences; nodes with ids in source order.
TREE = rf"""runs AS (SELECT b.*, l.block IS NOT NULL AS listed, sum((b.kind = 'heading' OR l.block IS NOT NULL)::INT) OVER w AS run, max(CASE WHEN b.kind = 'heading' THEN b.start END) OVER w AS under
  FROM blocks b LEFT JOIN (SELECT DISTINCT doc_id, block FROM entries) l ON l.doc_id = b.doc_id AND l.block = b.block WINDOW w AS (PARTITION BY b.doc_id ORDER BY b.block)),
body AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS paragraph, row_number() OVER (PARTITION BY doc_id, run ORDER BY block) AS k, {set_sql('text')} AS s FROM runs WHERE kind <> 'heading' AND NOT listed),
walk AS (SELECT doc_id, run, k, s AS anchor_set, CAST(0.95 AS DOUBLE) AS prev, false AS cut FROM body WHERE k = 1
  UNION ALL SELECT doc_id, run, k, CASE WHEN c THEN s ELSE anchor_set END, CASE WHEN c THEN 0.95 ELSE p END, c
  FROM (SELECT *, p <= 0.5 AND prev - p >= 0.2 AS c FROM (SELECT *, {posterior_sql('j', 0.95)} AS p FROM (SELECT n.doc_id, n.run, n.k, n.s, w.anchor_set, w.prev, {jaccard_sql('w.anchor_set', 'n.s')} AS j FROM walk w JOIN body n ON n.doc_id = w.doc_id AND n.run = w.run AND n.k = w.k + 1)))),
topics AS MATERIALIZED (SELECT doc_id, run, k, sum(cut::INT) OVER (PARTITION BY doc_id, run ORDER BY k) AS topic FROM walk),
full_body AS MATERIALIZED (SELECT b.*, t.topic, min(b.start) OVER (PARTITION BY b.doc_id, b.run, t.topic) AS first FROM body b JOIN topics t ON t.doc_id = b.doc_id AND t.run = b.run AND t.k = b.k),
cut_sentences AS (SELECT doc_id, paragraph, start AS at0, string_split(regexp_replace(text, '([.!?。！？]+["''”’)]*(?:[ \t\n\x0B\f\r]+|$))', '\1' || chr(1), 'g'), chr(1)) AS ps FROM full_body WHERE NOT verbatim),
each_sentence AS (SELECT doc_id, paragraph, at0, unnest(ps) AS piece, unnest(range(len(ps))) AS q FROM cut_sentences),
laid AS (SELECT *, at0 + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, paragraph ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM each_sentence),
inner_nodes AS (SELECT doc_id, paragraph, b + length(piece) - length(ltrim(piece, {BLANKS})) AS start, b + length(piece) - length(ltrim(piece, {BLANKS})) + length(trim(piece, {BLANKS})) AS "end", trim(piece, {BLANKS}) AS title FROM laid WHERE trim(piece, {BLANKS}) <> ''
  UNION ALL SELECT doc_id, paragraph, start, "end", text FROM full_body WHERE verbatim),
sections AS (SELECT doc_id, run, topic, min(start) AS start, max("end") AS "end", any_value(under) AS under FROM full_body GROUP BY ALL),
all_nodes AS (SELECT doc_id, 0 AS o, 'document' AS kind, CAST(NULL AS VARCHAR) AS title, 0 AS start, length(text) AS "end", CAST(NULL AS VARCHAR) AS up FROM guides
  UNION ALL SELECT h.doc_id, 1, 'heading', h.title, h.start, coalesce(h.until, length(g.text)), coalesce('heading:' || h.parent, 'document:0') FROM heads h JOIN guides g USING (doc_id)
  UNION ALL SELECT doc_id, 2, 'toc', 'Contents entries', start, "end", coalesce('heading:' || under, 'document:0') FROM runs WHERE listed
  UNION ALL SELECT e.doc_id, 3, 'toc_entry', e.title, e.start, e."end", 'toc:' || b.start FROM entries e JOIN blocks b ON b.doc_id = e.doc_id AND b.block = e.block
  UNION ALL SELECT doc_id, 4, 'section', NULL, start, "end", coalesce('heading:' || under, 'document:0') FROM sections
  UNION ALL SELECT doc_id, 5, 'paragraph', 'Paragraph ' || row_number() OVER (PARTITION BY doc_id, first ORDER BY start), start, "end", 'section:' || first FROM full_body
  UNION ALL SELECT i.doc_id, 6, 'sentence', i.title, i.start, i."end", 'paragraph:' || b.start FROM inner_nodes i JOIN full_body b USING (doc_id, paragraph)),
keyed AS (SELECT *, kind || ':' || start AS own, CASE WHEN kind = 'document' THEN 'root' ELSE 'n' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, o) - 1 AS VARCHAR), 6, '0') END AS node_id FROM all_nodes),
tree_nodes AS MATERIALIZED (SELECT k.doc_id, k.node_id, p.node_id AS parent_id, k.kind, k.title, CAST(k.start AS BIGINT) AS start, CAST(k."end" AS BIGINT) AS "end" FROM keyed k LEFT JOIN keyed p ON p.doc_id = k.doc_id AND p.own = k.up)"""
GUIDE_TREE = f"{BLOCKS}, {HEADS}, {ENTRIES}, {TREE}"


def _topics(units):
    return segment.groups(units, segment.anchor_drop(units, 0.95))


def _tree(spark, sf, found=None):
    return written(markdown.index(_guides(spark, sf), _topics, _found(spark, sf) if found is None else found))


@query(f"WITH RECURSIVE {GUIDE_TREE} SELECT * FROM tree_nodes")
def guide_tree(spark, sf):
    """The content tree of Markdown documents: headings by level, contents, topic sections, paragraphs, sentences."""
    return _tree(spark, sf)


@query(f"WITH RECURSIVE {GUIDE_TREE} SELECT doc_id, node_id, parent_id, kind, title, start FROM tree_nodes WHERE kind IN ('heading', 'toc', 'toc_entry')")
def guide_outline(spark, sf):
    return markdown.outline(_tree(spark, sf))


@query(f"""WITH RECURSIVE {GUIDE_TREE}, asked AS (SELECT n.doc_id, n.node_id AS asked, n.kind, CASE WHEN n.kind = 'toc_entry' THEN h.start ELSE n.start END AS a, CASE WHEN n.kind = 'toc_entry' THEN h."end" ELSE n."end" END AS b
  FROM tree_nodes n LEFT JOIN targets t ON t.doc_id = n.doc_id AND t.start = n.start LEFT JOIN tree_nodes h ON h.doc_id = n.doc_id AND h.kind = 'heading' AND h.start = t.target WHERE n.kind IN ('toc_entry', 'heading'))
SELECT n.doc_id, asked, count(*) AS n_nodes, max(n.node_id) AS last_node FROM asked JOIN tree_nodes n ON n.doc_id = asked.doc_id AND n.start >= a AND n."end" <= b GROUP BY ALL""")
def guide_scopes(spark, sf):
    """What lies below each heading and below the heading that each entry of the contents leads to."""
    docs = _guides(spark, sf)
    return scopes.scopes(docs, markdown.blocks(docs), scopes.TreeReader(0.95))


#: Hints on the guides: the second line of a paragraph, a native heading's own title, and faulty ones.
HINTS = """hints AS (SELECT doc_id, start, "end", title, level FROM (
  SELECT doc_id, CAST(instr(text, 'second line of it') - 1 AS BIGINT) AS start, CAST(instr(text, 'second line of it') + 16 AS BIGINT) AS "end", 'second line of it' AS title, 3 AS level FROM guides
  UNION ALL SELECT doc_id, 0, 9, CASE WHEN doc_id % 2 = 0 THEN 'guide ' || doc_id ELSE 'Another' END, 1 FROM guides
  UNION ALL SELECT doc_id, CAST(instr(text, '# not a heading') - 1 AS BIGINT), CAST(instr(text, '# not a heading') + 14 AS BIGINT), '# not a heading', 2 FROM guides
  UNION ALL SELECT doc_id, CAST(length(text) - 1 AS BIGINT), CAST(length(text) - 3 AS BIGINT), 'x', 2 FROM guides))"""


def _hints(spark, sf):
    g = _guides(spark, sf)
    at = lambda what: F.instr(F.col("text"), what).cast("bigint") - 1
    row = lambda s, e, title, level: F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"), title.alias("title"), F.lit(level).alias("level"))
    two, code = "second line of it", "# not a heading"
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("guide "), F.col("doc_id").cast("string"))).otherwise("Another")
    rows = F.array(row(at(two), at(two) + 17, F.lit(two), 3), row(F.lit(0), F.lit(9), title, 1), row(at(code), at(code) + 15, F.lit(code), 2), row(F.length("text") - 1, F.length("text") - 3, F.lit("x"), 2))
    return g.select("doc_id", F.explode(rows).alias("h")).select("doc_id", "h.*")


@query(f"""WITH RECURSIVE {BLOCKS}, {HINTS}, pairs AS (SELECT h.doc_id, h.start, h."end", h.title, h.level, count(b.start) AS n, any_value(b.kind) AS kind, any_value(b.start) AS bs, any_value(b.verbatim) AS verbatim, any_value(b.title) AS own, any_value(b.text) AS text
  FROM hints h LEFT JOIN blocks b ON b.doc_id = h.doc_id AND b.start < h."end" AND h.start < b."end" GROUP BY ALL),
lapped AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false) AS laps FROM pairs),
judged AS (SELECT doc_id, start, CASE WHEN "end" <= start OR level NOT BETWEEN 1 AND 64 THEN 'span_or_level' WHEN laps THEN 'overlap' WHEN trim(title) = '' THEN 'title' WHEN n <> 1 THEN 'not_one_block'
  WHEN kind = 'heading' AND (start <> bs OR {TITLE.format(x='title')} <> {TITLE.format(x='own')}) THEN 'conflict' WHEN kind <> 'heading' AND (verbatim OR trim(substr(text, start - bs + 1, "end" - start), {BLANKS}) <> title) THEN 'not_source_text' END AS issue FROM lapped)
SELECT * FROM judged WHERE issue IS NOT NULL""")
def hint_issues(spark, sf):
    return markdown.hinted(_found(spark, sf), _hints(spark, sf))


@query(f"""WITH RECURSIVE {BLOCKS}, cut AS (SELECT b.*, instr(b.text, 'second line of it') - 1 AS o FROM blocks b),
parts AS (SELECT doc_id, kind, start, "end", title, level, verbatim FROM cut WHERE o < 0 OR kind <> 'paragraph' OR verbatim
  UNION ALL SELECT doc_id, 'paragraph', start, start + length(rtrim(left(text, o), {BLANKS})), '', 0, false FROM cut WHERE o > 0
  UNION ALL SELECT doc_id, 'heading', start + o, start + o + 17, 'second line of it', 3, false FROM cut WHERE o >= 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") - 1 AS block, kind, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", title, CAST(level AS BIGINT) AS level, verbatim FROM parts""")
def hinted_blocks(spark, sf):
    """Blocks with the valid hints made headings."""
    return markdown.with_hints(_found(spark, sf), _hints(spark, sf)).drop("text")
