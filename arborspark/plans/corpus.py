"""Queries over units, sentences, topics, trees and lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.functions import probability as P
from arborspark.functions import text as T
from arborspark.operators import lexical, parse, segment, tree
from arborspark.plans.registry import load, query

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UNITS = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, pos, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines),
units AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS paragraph, start, start + length(text) AS "end", text FROM placed WHERE trim(text, {BLANKS}) <> '')"""
GAP = r"[ \t\n\x0B\f\r]+"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"


def set_sql(x: str) -> str:
    return f"list_distinct({tokens_sql(x)})"


def jaccard_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"


def posterior_sql(s: str, prior: float) -> str:
    odds = f"(ln({prior}) - ln(1 - {prior}) + ln(least(greatest({s}, 1e-9), 1 - 1e-9)) - ln(1 - least(greatest({s}, 1e-9), 1 - 1e-9)))"
    return f"(1 / (1 + exp(-{odds})))"


SENTENCES = UNITS + rf""",
cut AS (SELECT doc_id, paragraph, start, string_split(regexp_replace(replace(text, chr(1), ' '), '([.!?。！？]+["''”’)]*(?:[ \t\n\x0B\f\r]+|$))', '\1' || chr(1), 'g'), chr(1)) AS pieces FROM units),
each_piece AS (SELECT doc_id, paragraph, start, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM cut),
laid AS (SELECT *, start + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, paragraph ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM each_piece),
sentences AS (SELECT doc_id, paragraph, CAST(row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY k) - 1 AS BIGINT) AS sentence,
  CAST(begin + length(piece) - length(ltrim(piece, {BLANKS})) AS BIGINT) AS start, CAST(begin + length(piece) - length(ltrim(piece, {BLANKS})) + length(trim(piece, {BLANKS})) AS BIGINT) AS "end", trim(piece, {BLANKS}) AS text
  FROM laid WHERE trim(piece, {BLANKS}) <> '')"""

TURNS = f"""turns AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS paragraph, text,
  CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM conversations WHERE trim(text, {BLANKS}) <> '')"""


def turn_units(spark: SparkSession, sf: str) -> DataFrame:
    return parse.joined_documents(load(spark, sf, "conversations"), "conv_id", "turn", "text")


def doc_units(spark: SparkSession, sf: str) -> DataFrame:
    return parse.line_units(load(spark, sf, "documents"))


@query(f"WITH {UNITS} SELECT doc_id, paragraph, start, \"end\", length(text) AS n_chars FROM units")
def units_offsets(spark, sf):
    return doc_units(spark, sf).select("doc_id", "paragraph", "start", "end", F.length("text").cast("bigint").alias("n_chars"))


@query(f"WITH {SENTENCES} SELECT doc_id, paragraph, sentence, start, \"end\" FROM sentences")
def sentences(spark, sf):
    return parse.sentences(doc_units(spark, sf), ["doc_id", "paragraph"]).select("doc_id", "paragraph", "sentence", "start", "end")


@query(f"WITH {UNITS} SELECT doc_id, paragraph, CAST(len({tokens_sql('text')}) AS BIGINT) AS n_tokens, CAST(len({set_sql('text')}) AS BIGINT) AS n_distinct FROM units")
def tokens(spark, sf):
    t = doc_units(spark, sf)
    return t.select("doc_id", "paragraph", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(T.token_set(F.col("text"))).cast("bigint").alias("n_distinct"))


@query(f"""WITH {UNITS}, sets AS (SELECT doc_id, paragraph, {set_sql('text')} AS s FROM units),
pairs AS (SELECT doc_id, paragraph, s, lag(s) OVER (PARTITION BY doc_id ORDER BY paragraph) AS before FROM sets)
SELECT doc_id, paragraph, round({jaccard_sql('s', 'before')}, 6) AS similarity FROM pairs WHERE before IS NOT NULL""")
def jaccard_adjacent(spark, sf):
    by = Window.partitionBy("doc_id").orderBy("paragraph")
    rows = doc_units(spark, sf).select("doc_id", "paragraph", T.token_set(F.col("text")).alias("s"))
    rows = rows.withColumn("before", F.lag("s").over(by)).where("before is not null")
    return rows.select("doc_id", "paragraph", F.round(T.jaccard(F.col("s"), F.col("before")), 6).alias("similarity"))


@query(f"""SELECT doc_id, sha256(array_to_string({tokens_sql('text')}, ' ')) AS words_key,
sha256(trim(regexp_replace(text, '{GAP}', ' ', 'g'))) AS space_key FROM documents WHERE text IS NOT NULL""")
def normalized_keys(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(T.normal_words(F.col("text")), 256).alias("words_key"), F.sha2(T.collapsed(F.col("text")), 256).alias("space_key"))


H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"


@query(rf"""SELECT page_id, trim(regexp_replace(replace(lower({H1}), 'ß', 'ss'), '{GAP}', ' ', 'g')) AS title,
regexp_replace(trim(regexp_replace(replace(lower({H1}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r-]', '', 'g'), {BLANKS}), '[ \t\n\x0B\f\r]', '-', 'g') AS slug FROM pages""")
def heading_slugs(spark, sf):
    h = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return load(spark, sf, "pages").select("page_id", T.normal_title(h).alias("title"), T.slug(h).alias("slug"))


@query(f"""WITH {TURNS} SELECT doc_id, paragraph, start, start + length(text) AS "end" FROM turns""")
def build_document(spark, sf):
    return turn_units(spark, sf).select("doc_id", "paragraph", "start", "end")


@query(f"""WITH {TURNS} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY paragraph)) AS text_sha256, count(*) AS n_units FROM turns GROUP BY doc_id""")
def document_text(spark, sf):
    by = turn_units(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("us"), F.count(F.lit(1)).alias("n_units"))
    return by.select("doc_id", F.sha2(F.array_join(F.transform("us", lambda u: u["text"]), "\n\n"), 256).alias("text_sha256"), "n_units")


GRID = "grid AS (SELECT p_partkey AS id, (p_partkey % 101) / 100.0::DOUBLE AS s, (p_partkey % 17) / 16.0::DOUBLE AS w, (p_partkey % 13) / 24.0::DOUBLE AS parent FROM part)"


def grid(spark, sf):
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(k.alias("id"), (k % 101 / 100.0).alias("s"), (k % 17 / 16.0).alias("w"), (k % 13 / 24.0).alias("parent"))


@query(f"WITH {GRID} SELECT id, round({posterior_sql('s', 0.7)}, 6) AS p70, round({posterior_sql('s', 0.95)}, 6) AS p95 FROM grid")
def posterior(spark, sf):
    s = F.col("s")
    return grid(spark, sf).select("id", F.round(P.posterior_same(s, 0.7), 6).alias("p70"), F.round(P.posterior_same(s, 0.95), 6).alias("p95"))


@query(f"""WITH {GRID} SELECT id, round(CASE WHEN s IN (0, 1) THEN s ELSE 1 / (1 + exp(-(ln(s) - ln(1 - s) + ln(0.8) - ln(0.2) - ln(0.2) + ln(0.8)))) END, 6) AS adjusted FROM grid""")
def adjusted_probability(spark, sf):
    return grid(spark, sf).select("id", F.round(P.adjust_probability(F.col("s"), 0.8, 0.2), 6).alias("adjusted"))


@query(f"""WITH {GRID} SELECT id, round(s - w, 6) AS leaf_signal, round(CASE WHEN parent >= 0.05 THEN (s - w) / parent END, 6) AS raw_ratio,
round(CASE WHEN parent >= 0.05 THEN least(greatest((s - w) / parent, 0.0), 1.0) END, 6) AS score,
CASE WHEN parent >= 0.05 THEN least(greatest((s - w) / parent, 0.0), 1.0) <= 0.4 END AS accept_split,
CASE WHEN parent < 0.05 THEN 'insufficient_parent_reference' ELSE 'scored' END AS status FROM grid""")
def separation(spark, sf):
    made = P.separation(F.col("s"), F.col("w"), F.col("parent"), 0.4)
    return grid(spark, sf).select("id", *[(F.round(v, 6) if k in ("leaf_signal", "raw_ratio", "score") else v).alias(k) for k, v in made.items()])


def cuts_sql(prior: float) -> str:
    return f"""{TURNS}, sets AS (SELECT doc_id, paragraph, {set_sql('text')} AS s FROM turns),
walk AS (
  SELECT doc_id, paragraph, s AS anchor_set, paragraph AS anchor, CAST({prior} AS DOUBLE) AS prev, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS posterior, CAST(NULL AS DOUBLE) AS previous, false AS cut, paragraph AS shown_anchor FROM sets WHERE paragraph = 0
  UNION ALL
  SELECT doc_id, paragraph, CASE WHEN c THEN s ELSE anchor_set END, CASE WHEN c THEN paragraph ELSE anchor END, CASE WHEN c THEN {prior} ELSE p END, j, p, prev, c, anchor
  FROM (SELECT *, p <= 0.5 AND prev - p >= 0.2 AS c FROM (SELECT *, {posterior_sql('j', prior)} AS p FROM (
    SELECT n.doc_id, n.paragraph, n.s, w.anchor_set, w.anchor, w.prev, {jaccard_sql('w.anchor_set', 'n.s')} AS j FROM walk w JOIN sets n ON n.doc_id = w.doc_id AND n.paragraph = w.paragraph + 1))))"""


def _cuts(spark, sf, prior):
    d = segment.anchor_drop(turn_units(spark, sf), prior)
    return d.select("doc_id", "paragraph", "anchor", *[F.round(c, 6).alias(c) for c in ("score", "posterior", "previous")], "cut")


CUT_COLUMNS = "doc_id, paragraph, shown_anchor AS anchor, round(score, 6) AS score, round(posterior, 6) AS posterior, round(previous, 6) AS previous, cut"


@query(f"WITH RECURSIVE {cuts_sql(0.95)} SELECT {CUT_COLUMNS} FROM walk WHERE paragraph > 0")
def topic_cuts_p95(spark, sf):
    return _cuts(spark, sf, 0.95)


@query(f"WITH RECURSIVE {cuts_sql(0.7)} SELECT {CUT_COLUMNS} FROM walk WHERE paragraph > 0")
def topic_cuts_p70(spark, sf):
    return _cuts(spark, sf, 0.7)


TOPICS = cuts_sql(0.95) + ", topics AS (SELECT doc_id, paragraph, CAST(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY paragraph) AS BIGINT) AS topic FROM walk)"


def _topics(spark, sf):
    units = turn_units(spark, sf)
    return units, segment.groups(units, segment.anchor_drop(units, 0.95))


@query(f"WITH RECURSIVE {TOPICS} SELECT doc_id, paragraph, topic FROM topics")
def topic_groups(spark, sf):
    return _topics(spark, sf)[1]


TURN_SENTENCES = SENTENCES.replace(UNITS, TURNS).replace("FROM units", "FROM turns")
NODES = TOPICS + "," + TURN_SENTENCES.split(TURNS + ",", 1)[1] + """,
spans AS (SELECT t.doc_id, t.paragraph, t.start, t.start + length(t.text) AS "end", topic FROM turns t JOIN topics USING (doc_id, paragraph)),
nodes AS (
  SELECT doc_id, 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'document' AS kind, CAST(0 AS BIGINT) AS start, max("end") AS "end", CAST(0 AS BIGINT) AS depth FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, 'b' || topic, 'root', 'section', min(start), max("end"), 1 FROM spans GROUP BY doc_id, topic
  UNION ALL SELECT doc_id, 'p' || paragraph, 'b' || topic, 'paragraph', start, "end", 2 FROM spans
  UNION ALL SELECT doc_id, 'p' || paragraph || 's' || sentence, 'p' || paragraph, 'sentence', start, "end", 3 FROM sentences)"""


def _nodes(spark, sf):
    units, topics = _topics(spark, sf)
    return tree.build(units, topics, parse.sentences(units, ["doc_id", "paragraph"]))


@query(f"WITH RECURSIVE {NODES} SELECT * FROM nodes")
def tree_nodes(spark, sf):
    return _nodes(spark, sf)


@query(f"""WITH RECURSIVE {NODES}, trail AS (SELECT doc_id, node_id, node_id AS path FROM nodes WHERE parent_id IS NULL
UNION ALL SELECT n.doc_id, n.node_id, t.path || '/' || n.node_id FROM trail t JOIN nodes n ON n.doc_id = t.doc_id AND n.parent_id = t.node_id) SELECT * FROM trail""")
def node_paths(spark, sf):
    return tree.paths(_nodes(spark, sf))


@query(f"""WITH RECURSIVE {NODES} SELECT doc_id, parent_id AS node_id, count(*) AS n_children, arg_min(node_id, {{'s': start, 'n': node_id}}) AS first_child FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL""")
def node_children(spark, sf):
    return tree.children(_nodes(spark, sf))


@query(f"""WITH RECURSIVE {NODES}, up AS (SELECT doc_id, node_id AS leaf, node_id, parent_id FROM nodes
UNION ALL SELECT u.doc_id, u.leaf, n.node_id, n.parent_id FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node_id = u.parent_id)
SELECT doc_id, node_id, count(*) - 1 AS n_below FROM up GROUP BY ALL""")
def subtree_sizes(spark, sf):
    return tree.subtree_sizes(_nodes(spark, sf))


@query(f"""WITH RECURSIVE {NODES}, child AS (SELECT c.*, p.start AS ps, p."end" AS pe FROM nodes c LEFT JOIN nodes p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id WHERE c.parent_id IS NOT NULL)
SELECT doc_id, 'repeated_id' AS rule, count(*) - count(DISTINCT node_id) AS n FROM nodes GROUP BY doc_id
UNION ALL SELECT doc_id, 'missing_parent', count(*) FILTER (ps IS NULL) FROM child GROUP BY doc_id
UNION ALL SELECT doc_id, 'outside_parent', count(*) FILTER (start < ps OR "end" > pe) FROM child GROUP BY doc_id
UNION ALL SELECT doc_id, 'overlap', count(*) FILTER (before > start) FROM (SELECT *, lag("end") OVER (PARTITION BY doc_id, parent_id ORDER BY start, "end", node_id) AS before FROM child) GROUP BY doc_id""")
def tree_violations(spark, sf):
    return tree.violations(_nodes(spark, sf))


BM25 = f"""{UNITS}, words AS (SELECT doc_id, paragraph, {tokens_sql('text')} AS w FROM units),
scope AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT doc_id, paragraph, length, term, count(*) AS tf FROM (SELECT doc_id, paragraph, len(w) AS length, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id AS question, unnest({set_sql('text')}) AS term FROM benchmark),
scored AS (SELECT question, doc_id, paragraph, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), scope GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id, paragraph) AS rank FROM scored)"""


def _bm25(spark, sf, limit=64):
    return lexical.bm25(doc_units(spark, sf), ["doc_id", "paragraph"], "text", load(spark, sf, "benchmark"), "item_id", "text", limit)


@query(f"WITH {BM25} SELECT question, doc_id, paragraph, score, rank FROM ranked WHERE rank <= 64")
def bm25_find(spark, sf):
    return _bm25(spark, sf)


@query(f"""WITH {BM25}, best AS (SELECT *, round(score / max(score) OVER (PARTITION BY question), 6) AS relevance FROM ranked WHERE rank <= 64)
SELECT question, doc_id, paragraph, score, rank, relevance FROM best WHERE relevance >= 0.3 AND rank <= 5""")
def lexical_rerank(spark, sf):
    return lexical.rerank(_bm25(spark, sf), 5, 0.3)


@query(f"""WITH {SENTENCES}, sets AS (SELECT doc_id, paragraph, sentence, {set_sql('text')} AS s FROM sentences),
pairs AS (SELECT a.doc_id, a.paragraph, a.sentence, avg({jaccard_sql('a.s', 'b.s')}) AS m FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND a.sentence <> b.sentence GROUP BY ALL)
SELECT doc_id, paragraph, sentence, round(coalesce(m, 1.0), 6) AS score FROM sets LEFT JOIN pairs USING (doc_id, paragraph, sentence)""")
def mean_pairwise(spark, sf):
    s = parse.sentences(doc_units(spark, sf), ["doc_id", "paragraph"])
    return segment.mean_pairwise(s, ["doc_id", "paragraph"], "sentence", "text").withColumn("score", F.round("score", 6))


VISITS = f"""{SENTENCES}, sets AS (SELECT doc_id, paragraph, sentence, {set_sql('text')} AS s, {set_sql('first(text) OVER (PARTITION BY doc_id, paragraph ORDER BY sentence)')} AS lead,
 count(*) OVER (PARTITION BY doc_id, paragraph) AS n FROM sentences),
depths AS (SELECT doc_id, paragraph, sentence, round({jaccard_sql('s', 'lead')}, 9) AS score, least(sentence, n - 1 - sentence) AS depth FROM sets),
visits AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY depth, sentence) - 1 AS visit FROM depths)"""


def _scored(spark, sf):
    s = parse.sentences(doc_units(spark, sf), ["doc_id", "paragraph"])
    lead = F.first("text").over(Window.partitionBy("doc_id", "paragraph").orderBy("sentence"))
    return s.withColumn("lead", lead).select("doc_id", "paragraph", "sentence", F.round(T.jaccard(T.token_set(F.col("text")), T.token_set(F.col("lead"))), 9).alias("score"))


@query(f"WITH {VISITS} SELECT doc_id, paragraph, sentence, depth, visit FROM visits")
def outside_in(spark, sf):
    return segment.outside_in(_scored(spark, sf), ["doc_id", "paragraph"], "sentence").select("doc_id", "paragraph", "sentence", "depth", "visit")


BEST = "SELECT doc_id, paragraph, arg_max(sentence, {'s': score, 'v': -visit}) AS sentence, round(max(score), 6) AS score, count(*) AS visited"


@query(f"WITH {VISITS} {BEST} FROM visits WHERE visit < 2 GROUP BY ALL")
def representatives_budget(spark, sf):
    return segment.representatives(_scored(spark, sf), ["doc_id", "paragraph"], "sentence", budget=2).withColumn("score", F.round("score", 6))


@query(f"WITH {VISITS}, last AS (SELECT doc_id, paragraph, min(depth) AS last FROM visits WHERE score >= 0.5 GROUP BY ALL) {BEST} FROM visits LEFT JOIN last USING (doc_id, paragraph) WHERE last IS NULL OR depth <= last GROUP BY ALL")
def representatives_early_stop(spark, sf):
    return segment.representatives(_scored(spark, sf), ["doc_id", "paragraph"], "sentence", stop=0.5).withColumn("score", F.round("score", 6))


MARKDOWN = "concat('# Guide ', c_custkey, '\n\n', 'Intro text of ', c_name, '.\nsecond line\n\n', '## Part ', c_custkey % 7, ' ##\n', '```\n# not a heading\n```\n', 'Title line\n===\n\n- [Guide ', c_custkey, '](#guide-', c_custkey, ')\n')"


@query()
def markdown_blocks(spark, sf):
    """A Markdown text for each customer; headings, Setext lines, fences and link lists in it."""
    docs = load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(MARKDOWN.replace("\n", "\\n")).alias("text"))
    return parse.markdown_blocks(docs)


CONTENTS = """entries_text AS (SELECT page_id AS doc_id, CAST(0 AS BIGINT) AS block, 'Contents' AS title FROM pages)"""


def _headings(spark, sf):
    h = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1))).alias("block", "title"))
    return h.select(F.col("page_id").alias("doc_id"), F.col("block").cast("bigint").alias("block"), "title")


@query(r"""WITH heads AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)) AS title, unnest(range(len(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)))) AS block FROM pages),
named AS (SELECT *, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS name FROM heads)
SELECT a.doc_id, a.block AS entry, a.title, CASE WHEN b.n = 1 THEN b.first END AS target_block, CASE WHEN b.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
FROM named a JOIN (SELECT doc_id, name, count(*) AS n, min(block) AS first FROM named GROUP BY ALL) b USING (doc_id, name)""")
def contents_resolve(spark, sf):
    heads = _headings(spark, sf)
    entries = heads.select("doc_id", F.col("block").alias("entry"), "title", F.lit(None).cast("string").alias("anchor"))
    return parse.resolve_contents(entries, heads, ["doc_id"])


LISTS = "concat('1. [', p_name, '](#', replace(lower(p_name), ' ', '-'), ')', chr(10), CASE WHEN p_partkey % 3 = 0 THEN 'plain prose' ELSE p_brand || ' ..... ' || p_size END)"


@query(rf"""WITH b AS (SELECT p_partkey AS doc_id, string_split({LISTS}, chr(10)) AS ls FROM part),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS entry FROM b WHERE p_ok(ls))
SELECT doc_id, entry, trim(CASE WHEN line LIKE '1. [%' THEN regexp_extract(line, '\[([^\]]+)\]', 1) ELSE regexp_extract(line, '^(.+?)[ \t]*\.{{2,}}', 1) END) AS title,
CASE WHEN line LIKE '1. [%' THEN regexp_extract(line, '\(#([^ \t)]+)\)$', 1) END AS anchor, CASE WHEN line NOT LIKE '1. [%' THEN regexp_extract(line, '([0-9]+)$', 1) END AS page FROM e""".replace("p_ok(ls)", "len(list_filter(ls, lambda x: x = 'plain prose')) = 0"))
def contents_entries(spark, sf):
    b = load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(LISTS).alias("text"))
    return parse.contents_entries(b, ["doc_id"])
