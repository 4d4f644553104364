"""Queries over reading contexts, promotions, barriers and heading paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborspark.functions import text as T
from arborspark.operators import context, dense, fusion, tree
from arborspark.plans.corpus import TURNS, _nodes, jaccard_sql, set_sql, turn_units
from arborspark.plans.evaluation import GOLD, _refs
from arborspark.plans.registry import SQL, load, query
from arborspark.plans.retrieval import CARDS, DENSE, NEIGHBOURS, _beam, _cards, _links, _whole
from arborspark.sources.work import written

#: Headings of the conversations: runs of six turns, runs of three within them, single turns.
HEADINGS = f"""{TURNS}, headings AS (SELECT doc_id, paragraph, 'S' || paragraph // 6 || CASE WHEN paragraph % 3 > 0 THEN ' ::: T' || paragraph // 3 ELSE '' END
  || CASE WHEN paragraph % 3 = 2 THEN ' ::: U' ELSE '' END AS title FROM turns),
cut AS (SELECT doc_id, paragraph, string_split(title, ' ::: ') AS ps FROM headings),
lagged AS (SELECT *, lag(ps) OVER (PARTITION BY doc_id ORDER BY paragraph) AS before FROM cut),
opened AS (SELECT *, unnest(range(len(ps))) AS depth FROM lagged),
flagged AS (SELECT *, ps[depth + 1] AS title, depth + 1 = len(ps) AS own, depth + 1 = len(ps) OR NOT coalesce(len(before) > depth AND ps[1:depth + 1] = before[1:depth + 1], false) AS new FROM opened),
begun AS (SELECT *, max(CASE WHEN new THEN paragraph END) OVER (PARTITION BY doc_id, depth ORDER BY paragraph) AS b FROM flagged),
named AS (SELECT *, 'h' || b || '.' || depth AS node_id, lag('h' || b || '.' || depth) OVER (PARTITION BY doc_id, paragraph ORDER BY depth) AS parent FROM begun)"""


@query(f"""WITH {HEADINGS} SELECT doc_id, node_id, coalesce(arg_min(parent, paragraph), 'root') AS parent_id, arg_min(title, paragraph) AS title, arg_min(depth, paragraph) AS depth,
NOT arg_min(own, paragraph) AS implicit, min(paragraph) AS first, max(paragraph) AS last FROM named GROUP BY doc_id, node_id""")
def heading_hierarchy(spark, sf):
    p = F.col("paragraph")
    part = lambda name, n: F.concat(F.lit(name), F.floor(p / n).cast("string"))
    title = F.concat(part("S", 6), F.when(p % 3 > 0, part(" ::: T", 3)).otherwise(""), F.when(p % 3 == 2, " ::: U").otherwise(""))
    return context.heading_tree(turn_units(spark, sf).select("doc_id", "paragraph", title.alias("title")), "doc_id", "paragraph", "title")


REACHED = f"""nodes AS ({SQL['tree_nodes']}), beam AS ({SQL['beam_search']}), leaves AS (SELECT doc_id, node_id, rank FROM beam WHERE depth = 3),
best AS (SELECT l.doc_id, n.parent_id AS node_id, min(rank) AS place FROM leaves l JOIN nodes n USING (doc_id, node_id) GROUP BY ALL),
core AS (SELECT b.*, n.parent_id, n.start, n."end" FROM best b JOIN nodes n USING (doc_id, node_id))"""
RANKED = """one AS (SELECT doc_id, start, "end", min(place_at) AS place_at FROM every_span GROUP BY ALL)
SELECT doc_id, start, "end", place_at[1] AS tier, row_number() OVER (PARTITION BY doc_id ORDER BY place_at, start, "end") AS rank FROM one"""
BOTTOM_UP = f"""WITH {REACHED}, par AS (SELECT c.doc_id, c.place, p.node_id, p.parent_id AS over, p.start, p."end" FROM core c JOIN nodes p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id),
rows_in AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY start, node_id) AS i FROM nodes WHERE kind = 'paragraph'),
near AS (SELECT c.doc_id, c.place, r.start, r."end", row_number() OVER (PARTITION BY c.doc_id, c.place ORDER BY abs(r.i - m.i), r.i) AS turn
  FROM core c JOIN rows_in m ON m.doc_id = c.doc_id AND m.node_id = c.node_id JOIN rows_in r ON r.doc_id = c.doc_id AND r.parent_id = c.parent_id AND r.i <> m.i),
every_span AS (SELECT doc_id, start, "end", [0, place, 0] AS place_at FROM core
UNION ALL SELECT doc_id, start, "end", [1, rank, 0] FROM leaves JOIN nodes USING (doc_id, node_id)
UNION ALL SELECT doc_id, start, "end", [2, place, 0] FROM par
UNION ALL SELECT doc_id, start, "end", [3, turn, place] FROM near
UNION ALL SELECT p.doc_id, n.start, n."end", [4, p.place, 0] FROM par p JOIN nodes n ON n.doc_id = p.doc_id AND n.node_id = p.over AND n.kind = 'document'), {RANKED}"""


def _reached(spark, sf):
    """The nodes and the leaves that the beam reached, both written down."""
    nodes = written(_nodes(spark, sf))
    return nodes, written(_beam(spark, sf, nodes).where("depth = 3").select("doc_id", "node_id", "rank"))


@query(BOTTOM_UP)
def bottom_up_context(spark, sf):
    """From the reached paragraphs outward; the tree's document node stands for a heading."""
    nodes, leaves = _reached(spark, sf)
    return context.bottom_up(leaves, nodes, heading="document")


@query(f"""WITH {REACHED}, up AS ({SQL['node_paths']}), trail AS (SELECT doc_id, node_id, list_reverse(string_split(path, '/')) AS tops FROM up),
mine AS (SELECT doc_id, place, start AS cs, "end" AS ce, unnest(tops) AS top, unnest(range(len(tops))) AS tier FROM core JOIN trail USING (doc_id, node_id)),
below AS (SELECT doc_id, start, "end", unnest(tops) AS top FROM nodes JOIN trail USING (doc_id, node_id) WHERE kind = 'paragraph'),
turns_of AS (SELECT doc_id, b.start, b."end", tier, place, row_number() OVER (PARTITION BY doc_id, place, tier ORDER BY greatest(0, b.start - ce, cs - b."end"), b.start, b."end") AS turn FROM mine JOIN below b USING (doc_id, top) WHERE tier > 0),
every_span AS (SELECT doc_id, start, "end", [tier, turn, place] AS place_at FROM turns_of UNION ALL SELECT doc_id, start, "end", [0, rank, 0] FROM leaves JOIN nodes USING (doc_id, node_id)), {RANKED}""")
def ancestor_context(spark, sf):
    nodes, leaves = _reached(spark, sf)
    first = leaves.join(nodes.select("doc_id", "node_id", "start", "end"), ["doc_id", "node_id"])
    return context.ancestors(context.cores(leaves, nodes), nodes, tree.paths(nodes), first)


@query()
def packed_context(spark, sf):
    """The bottom-up reading order under a budget of words of the union of its spans."""
    return context.fit_spans(bottom_up_context(spark, sf), _whole(spark, sf).withColumnRenamed("w", "text"), 60)


#: Longer cards are preferred, by a logistic of the difference in words.
LONGER = "1 / (1 + exp(-({a}.cost - {b}.cost) / 8.0))"
PROMOTE = f"least({LONGER.format(a='c', b='f')}, 1 - {LONGER.format(a='f', b='c')})"


@query(f"""WITH RECURSIVE {CARDS}, top AS MATERIALIZED (SELECT question, item, rank, cost FROM cards WHERE rank <= 30),
slots AS (SELECT question, 1 AS n, list(item ORDER BY rank)[1:1] AS done FROM top GROUP BY question
UNION ALL SELECT s.question, s.n + 1, list_append(s.done, (SELECT arg_max(c.item, {{'won': c.item <> f.item, 'p': CASE WHEN c.item = f.item THEN 0.0 ELSE {PROMOTE} END, 'o': -c.rank}}) FROM top c
  JOIN (SELECT t.question, arg_min(t.item, t.rank) AS item, arg_min(t.cost, t.rank) AS cost FROM top t WHERE t.question = s.question AND NOT list_contains(s.done, t.item) GROUP BY t.question) f ON f.question = c.question
  WHERE NOT list_contains(s.done, c.item) AND (c.item = f.item OR {PROMOTE} >= 0.8)))
  FROM slots s WHERE s.n < 5 AND EXISTS (SELECT 1 FROM top t WHERE t.question = s.question AND NOT list_contains(s.done, t.item))),
last_slots AS (SELECT question, arg_max(done, n) AS done FROM slots GROUP BY question)
SELECT question, item, row_number() OVER (PARTITION BY question ORDER BY coalesce(list_position(done, item), 100 + rank)) AS rank, list_contains(done, item) AS selected FROM top JOIN last_slots USING (question)""")
def promoted_evidence(spark, sf):
    better = lambda a, b: 1 / (1 + F.exp(-(a["cost"] - b["cost"]) / 8.0))
    return context.promoted(_cards(spark, sf).where("rank <= 30").select("question", "item", "rank", "cost"), "question", "item", "rank", better)


@query(f"""WITH {CARDS}, asks AS (SELECT item_id AS question, {set_sql('text')} AS q FROM benchmark),
pool AS (SELECT question, item, rank, {jaccard_sql('s', 'q')} AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY question) AS n FROM cards JOIN asks USING (question) WHERE rank <= 30 WINDOW w AS (PARTITION BY question ORDER BY rank)),
mixed AS (SELECT question, item, rank AS before, round(0.7 * p + 0.3 * (1 - i / greatest(n - 1, 1)), 9) AS blend FROM pool)
SELECT question, item, blend, row_number() OVER (PARTITION BY question ORDER BY blend DESC, before) AS rank FROM mixed""")
def final_rerank(spark, sf):
    asks = load(spark, sf, "benchmark").select(F.col("item_id").alias("question"), T.token_set(F.col("text")).alias("q"))
    rows = _cards(spark, sf).join(asks, "question").withColumn("p", T.jaccard(F.col("s"), F.col("q")))
    return context.blended(rows, "question", "item", "rank", "p", weight=0.7)


@query(f"""WITH {GOLD}, sizes AS (SELECT question, ref, count(DISTINCT doc_id) AS m FROM refs GROUP BY ALL)
SELECT question, round(max(2.0 * least(5, m) / (least(5, m) + m)), 6) AS oracle_f1 FROM sizes GROUP BY question""")
def oracle_f1(spark, sf):
    """The best F1 that five passages can reach."""
    sizes = _refs(spark, sf).groupBy("question", "ref").agg(F.count_distinct("doc_id").alias("m"))
    most = F.least(F.lit(5), F.col("m"))
    return sizes.groupBy("question").agg(F.round(F.max(2 * most / (most + F.col("m"))), 6).alias("oracle_f1"))


BARRIERS = f"""up AS ({SQL['node_paths']}), beam AS ({SQL['beam_search']}),
targets AS (SELECT doc_id, node_id, string_split(path, '/') AS steps FROM up WHERE regexp_matches(node_id, '^p[0-9]*[02468]$')),
way AS (SELECT doc_id, node_id, unnest(steps) AS step, unnest(range(len(steps))) AS depth FROM targets),
lost AS (SELECT w.*, b.node_id IS NULL AS lost FROM way w LEFT JOIN (SELECT DISTINCT doc_id, node_id FROM beam) b ON b.doc_id = w.doc_id AND b.node_id = w.step WHERE depth > 0),
barriers AS (SELECT doc_id, node_id, count(*) AS n_levels, coalesce(min(depth) FILTER (lost), max(depth) + 1) - 1 AS n_reached, arg_min(step, depth) FILTER (lost) AS barrier FROM lost GROUP BY ALL)"""


#: The paragraphs that the SQL of the twins follows.
EVEN = "node_id rlike '^p[0-9]*[02468]$'"


def _barriers(spark, sf, targets=EVEN):
    nodes = written(_nodes(spark, sf))
    return context.first_barriers(nodes.where(targets), tree.paths(nodes), _beam(spark, sf, nodes))


@query(f"WITH {BARRIERS} SELECT * FROM barriers")
def search_barriers(spark, sf):
    return _barriers(spark, sf)


@query(f"""WITH {BARRIERS}, each_depth AS (SELECT doc_id, n_reached, unnest(range(1, n_levels + 1)) AS depth FROM barriers)
SELECT doc_id, depth, count(*) AS n_targets, count(*) FILTER (n_reached >= depth) AS n_retained FROM each_depth GROUP BY ALL""")
def evidence_by_depth(spark, sf):
    return context.retained_by_depth(_barriers(spark, sf))


#: The same for every paragraph.
BARRIERS_ALL = f"""up AS MATERIALIZED ({SQL['node_paths']}), beam AS MATERIALIZED (SELECT DISTINCT doc_id, node_id FROM ({SQL['beam_search']})),
way AS (SELECT doc_id, node_id, unnest(string_split(path, '/')) AS step, unnest(range(len(string_split(path, '/')))) AS depth FROM up WHERE regexp_matches(node_id, '^p[0-9]+$')),
lost AS (SELECT w.*, b.node_id IS NULL AS lost FROM way w LEFT JOIN beam b ON b.doc_id = w.doc_id AND b.node_id = w.step WHERE depth > 0),
barriers AS (SELECT doc_id, node_id, count(*) AS n_levels, coalesce(min(depth) FILTER (lost), max(depth) + 1) - 1 AS n_reached, arg_min(step, depth) FILTER (lost) AS barrier FROM lost GROUP BY ALL)"""


@query(f"WITH {BARRIERS_ALL} SELECT * FROM barriers")
def search_barriers_all(spark, sf):
    """Of every paragraph; the twin of ``search_barriers`` has the even ones only."""
    return _barriers(spark, sf, "kind = 'paragraph'")


@query(f"""WITH {BARRIERS_ALL}, each_depth AS (SELECT doc_id, n_reached, unnest(range(1, n_levels + 1)) AS depth FROM barriers)
SELECT doc_id, depth, count(*) AS n_targets, count(*) FILTER (n_reached >= depth) AS n_retained FROM each_depth GROUP BY ALL""")
def evidence_by_depth_all(spark, sf):
    """Over every paragraph; the twin of ``evidence_by_depth`` has the even ones only."""
    return context.retained_by_depth(search_barriers_all(spark, sf))


@query(f"""WITH {CARDS}, top AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc_id, paragraph) AS i FROM cards WHERE rank <= 5)
SELECT question, 'Title: ' || question || chr(10) || chr(10) || string_agg('[' || i || '] ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS context FROM top GROUP BY question""")
def rendered_context(spark, sf):
    top = _cards(spark, sf).where("rank <= 5").withColumn("title", F.col("question"))
    return context.rendered(top, "question", "title", ["doc_id", "paragraph"], "doc_id", "text")


@query(f"""WITH {TURNS}, {NEIGHBOURS} SELECT l.doc_id, l.paragraph, concat_ws(chr(10), i.text, p.text, t.text) AS card
FROM links l JOIN turns t USING (doc_id, paragraph) LEFT JOIN turns i ON i.doc_id = l.doc_id AND i.paragraph = l.introduction LEFT JOIN turns p ON p.doc_id = l.doc_id AND p.paragraph = l.preceding""")
def contextual_cards(spark, sf):
    """Each paragraph after the introduction and the neighbour it depends on."""
    u = turn_units(spark, sf).select("doc_id", "paragraph", "text")
    other = lambda name: u.select("doc_id", F.col("paragraph").alias(name), F.col("text").alias(f"{name}_text"))
    rows = u.join(_links(spark, sf), ["doc_id", "paragraph"]).join(other("introduction"), ["doc_id", "introduction"], "left").join(other("preceding"), ["doc_id", "preceding"], "left")
    return rows.select("doc_id", "paragraph", F.concat_ws("\n", "introduction_text", "preceding_text", "text").alias("card"))


@query(f"""WITH {DENSE}, lists AS (SELECT query_id // 100 AS question, query_id, vec_id, rank FROM near WHERE rank <= 10),
fused AS (SELECT question, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM fused""")
def dense_need_fusion(spark, sf):
    """Dense lists of several needs of one question, fused by reciprocal rank."""
    e = load(spark, sf, "embeddings")
    near = dense.top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    lists = near.select(F.floor(F.col("query_id") / 100).alias("question"), F.col("query_id").alias("source"), "vec_id", "rank")
    return fusion.fused(lists, "question", "vec_id", "rank")


@query(f"""WITH RECURSIVE nodes AS ({SQL['tree_nodes']}), live AS (SELECT doc_id, node_id, parent_id FROM nodes WHERE kind = 'sentence'
UNION SELECT n.doc_id, n.node_id, n.parent_id FROM live l JOIN nodes n ON n.doc_id = l.doc_id AND n.node_id = l.parent_id) SELECT doc_id, node_id FROM live""")
def eligible_nodes(spark, sf):
    return context.eligible(_nodes(spark, sf))
