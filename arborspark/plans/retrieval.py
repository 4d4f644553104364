"""Queries over dense search, fusion, selection and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborspark.functions import text as T
from arborspark.operators import dense, fusion, lexical, markdown, pack, segment, select, tree
from arborspark.plans.corpus import BLANKS, BM25, NODES, TURNS, UNITS, _bm25, _nodes, doc_units, jaccard_sql, set_sql, tokens_sql, turn_units
from arborspark.plans.registry import load, query
from arborspark.sources.work import written

DOT = "list_dot_product(a.v, b.v)"
VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings)".replace("[64]", "[]")
DENSE = f"""{VEC}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id, round(least(greatest(({DOT} + 1) / 2, 0.0), 1.0), 6) AS score FROM vec a JOIN vec b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""


def _near(spark, sf, k=10):
    e = load(spark, sf, "embeddings")
    return dense.top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", k)


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 10")
def dense_topk(spark, sf):
    return _near(spark, sf)


@query(f"""WITH {VEC}, steps AS (SELECT label, vec_id, 1 - list_dot_product(v, lag(v) OVER (PARTITION BY label ORDER BY vec_id)) AS distance FROM vec),
cuts AS (SELECT *, coalesce(quantile_cont(distance, 0.85) OVER (PARTITION BY label), 2.0) AS threshold FROM steps)
SELECT label, vec_id, round(distance, 6) AS distance, round(threshold, 6) AS threshold, coalesce(distance > threshold, false) AS cut FROM cuts""")
def quantile_split(spark, sf):
    rows = segment.quantile_split(load(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return rows.withColumn("distance", F.round("distance", 6)).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {VEC}, pairs AS (SELECT a.label, a.vec_id, avg({DOT}) AS m FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT label, vec_id, round(coalesce(least(greatest((m + 1) / 2, 0.0), 1.0), 1.0), 6) AS score FROM vec LEFT JOIN pairs USING (label, vec_id)""")
def centroid_scores(spark, sf):
    return segment.centroid_scores(load(spark, sf, "embeddings"), "label", "vec_id", "embedding").withColumn("score", F.round("score", 6))


#: Document lists for each question: by its best unit, and by how many of its units match.
LISTS = BM25 + """,
by_best AS (SELECT question, 'best' AS source, doc_id, min(rank) AS place FROM ranked WHERE rank <= 64 GROUP BY ALL),
by_count AS (SELECT question, 'count' AS source, doc_id, row_number() OVER (PARTITION BY question ORDER BY n DESC, doc_id) AS place FROM (SELECT question, doc_id, count(*) AS n FROM ranked WHERE rank <= 64 GROUP BY ALL)),
lists AS (SELECT * FROM by_best UNION ALL SELECT * FROM by_count),
placed_lists AS (SELECT question, source, doc_id, row_number() OVER (PARTITION BY question, source ORDER BY place) AS p FROM lists)"""


def _lists(spark, sf):
    hits = _bm25(spark, sf)
    best = hits.groupBy("question", "doc_id").agg(F.min("rank").alias("place"), F.count(F.lit(1)).alias("n"))
    count = Window.partitionBy("question").orderBy(F.desc("n"), "doc_id")
    one = best.select("question", F.lit("best").alias("source"), "doc_id", "place")
    return one.unionByName(best.select("question", F.lit("count").alias("source"), "doc_id", F.row_number().over(count).cast("bigint").alias("place")))


@query(f"""WITH {LISTS}, fused AS (SELECT question, doc_id, round(sum(1.0 / (60 + p)), 9) AS score FROM placed_lists GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fused""")
def rrf_fusion(spark, sf):
    return fusion.fused(_lists(spark, sf), "question", "doc_id", "place")


@query(f"""WITH {LISTS}, fused AS (SELECT question, doc_id, round(sum(CASE source WHEN 'best' THEN 0.25 ELSE 0.75 END / (60 + p)), 9) AS score FROM placed_lists GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fused""")
def weighted_fusion(spark, sf):
    lists = _lists(spark, sf).withColumn("w", F.when(F.col("source") == "best", 0.25).otherwise(0.75))
    return fusion.fused(lists, "question", "doc_id", "place", weight="w")


@query(f"""WITH {LISTS}, first AS (SELECT question, doc_id, min({{'p': place, 'n': CASE source WHEN 'best' THEN 0 ELSE 1 END}}) AS spot FROM lists GROUP BY ALL)
SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY spot.p, spot.n, doc_id) AS rank FROM first""")
def need_interleave(spark, sf):
    lists = _lists(spark, sf).withColumn("need", F.when(F.col("source") == "best", 0).otherwise(1))
    first = lists.groupBy("question", "doc_id").agg(F.min(F.struct("place", "need")).alias("at"))
    order = Window.partitionBy("question").orderBy("at", "doc_id")
    return first.select("question", "doc_id", F.row_number().over(order).cast("bigint").alias("rank"))


HIT_SPANS = BM25 + """, hits AS (SELECT question, doc_id, u.start, u."end" FROM ranked JOIN units u USING (doc_id, paragraph) WHERE rank <= 64),
wide AS (SELECT question, doc_id, greatest(start - 40, 0) AS start, "end" + 40 AS "end" FROM hits),
marked AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY question, doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM wide),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY question, doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT question, doc_id, min(start) AS start, max("end") AS "end" FROM islands GROUP BY question, doc_id, island)"""


def _wide(spark, sf):
    u = doc_units(spark, sf).select("doc_id", "paragraph", "start", "end")
    hits = lexical.with_passages(_bm25(spark, sf), u, ["doc_id", "paragraph"])
    return hits.select("question", "doc_id", F.greatest(F.col("start") - 40, F.lit(0)).alias("start"), (F.col("end") + 40).alias("end"))


@query(f"WITH {HIT_SPANS} SELECT * FROM merged")
def span_union(spark, sf):
    return fusion.span_union(_wide(spark, sf), ["question", "doc_id"])


@query(f"""WITH {HIT_SPANS} SELECT m.question, u.doc_id, u.paragraph FROM merged m JOIN units u ON u.doc_id = m.doc_id AND u.start >= m.start AND u."end" <= m."end" """)
def covered_paragraphs(spark, sf):
    u = doc_units(spark, sf).select("doc_id", "paragraph", "start", "end")
    spans = written(_wide(spark, sf))
    asked = lexical.with_passages(spans.select("question", "doc_id").distinct(), u, ["doc_id"])
    return fusion.covered_items(asked, spans, ["question", "doc_id"]).select("question", "doc_id", "paragraph")


CARDS = BM25 + f""", cards AS (SELECT question, doc_id, paragraph, doc_id || ':' || paragraph AS item, rank, score, CAST(len({tokens_sql('u.text')}) AS BIGINT) AS cost, {set_sql('u.text')} AS s, u.text FROM ranked JOIN units u USING (doc_id, paragraph) WHERE rank <= 64)"""


def _cards(spark, sf):
    u = doc_units(spark, sf).select("doc_id", "paragraph", "text")
    rows = lexical.with_passages(_bm25(spark, sf), u, ["doc_id", "paragraph"])
    return rows.select("question", "doc_id", "paragraph", F.concat_ws(":", "doc_id", "paragraph").alias("item"), "rank", "score", F.size(T.tokens(F.col("text"))).cast("bigint").alias("cost"), T.token_set(F.col("text")).alias("s"), "text")


def pack_sql(budget: int, most: int | None = None, header: int = 0, joint: int = 0) -> str:
    price = f"(c.cost + CASE WHEN w.n > 0 THEN {joint} ELSE 0 END)"
    fits = f"w.used + {price} <= {budget}" + ("" if most is None else f" AND w.n < {most}")
    return f"""{CARDS}, walk AS (SELECT question, CAST(0 AS BIGINT) AS rank, CAST('' AS VARCHAR) AS item, false AS taken, CAST({header} AS BIGINT) AS used, 0 AS n FROM (SELECT DISTINCT question FROM cards)
UNION ALL SELECT c.question, c.rank, c.item, {fits},
  CAST(w.used + CASE WHEN {fits} THEN {price} ELSE 0 END AS BIGINT), w.n + CASE WHEN {fits} THEN 1 ELSE 0 END
  FROM walk w JOIN cards c ON c.question = w.question AND c.rank = w.rank + 1)"""


PACKED = "SELECT question, item, rank, taken, used FROM walk WHERE rank > 0"


@query(f"WITH RECURSIVE {pack_sql(600)} {PACKED}")
def candidate_pool(spark, sf):
    return pack.packed(_cards(spark, sf), "question", "item", "rank", "cost", 600)


@query(f"WITH RECURSIVE {pack_sql(300, 1000)} {PACKED}")
def pack_paragraphs(spark, sf):
    return pack.packed(_cards(spark, sf), "question", "item", "rank", "cost", 300)


@query(f"WITH RECURSIVE {pack_sql(400, 1000, 5, 3)} {PACKED}")
def pack_rendered(spark, sf):
    return pack.packed(_cards(spark, sf), "question", "item", "rank", "cost", 400, header=5, joint=3)


@query(f"WITH {CARDS}, run AS (SELECT question, item, rank, CAST(sum(cost) OVER (PARTITION BY question ORDER BY rank) AS BIGINT) AS used FROM cards) SELECT * FROM run WHERE used <= 500")
def pack_until_full(spark, sf):
    return pack.first_that_fit(_cards(spark, sf), "question", "rank", "cost", 500).select("question", "item", "rank", "used")


@query(f"""WITH RECURSIVE {UNITS}, sized AS (SELECT doc_id, paragraph, CAST(len({tokens_sql('text')}) AS BIGINT) AS c FROM units),
walk AS (SELECT doc_id, paragraph, c AS used, CAST(0 AS BIGINT) AS pack FROM sized WHERE paragraph = 0
UNION ALL SELECT s.doc_id, s.paragraph, CASE WHEN w.used > 0 AND w.used + s.c > 128 THEN s.c ELSE w.used + s.c END, w.pack + CASE WHEN w.used > 0 AND w.used + s.c > 128 THEN 1 ELSE 0 END
FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.paragraph = w.paragraph + 1) SELECT doc_id, paragraph, pack FROM walk""")
def pack_units(spark, sf):
    u = doc_units(spark, sf).withColumn("cost", F.size(T.tokens(F.col("text"))).cast("bigint"))
    return pack.packed_units(u, ["doc_id"], "paragraph", "cost", 128)


PREF = "1 / (1 + exp(-(round({a}.score, 6) - round({b}.score, 6))))"


@query(f"""WITH {CARDS}, top AS (SELECT * FROM cards WHERE rank <= 30),
pairs AS (SELECT a.question, a.item AS ai, b.item AS bi, CASE WHEN {PREF.format(a='a', b='b')} > 0.6 AND {PREF.format(a='b', b='a')} < 0.4 THEN 1.0 WHEN {PREF.format(a='a', b='b')} < 0.4 AND {PREF.format(a='b', b='a')} > 0.6 THEN 0.0 ELSE 0.5 END AS w FROM top a JOIN top b ON a.question = b.question AND a.rank < b.rank),
sides AS (SELECT question, ai AS item, w FROM pairs UNION ALL SELECT question, bi, 1 - w FROM pairs),
wins AS (SELECT question, item, sum(w)::DOUBLE AS wins FROM sides GROUP BY ALL)
SELECT t.question, t.item, coalesce(wins, 0.0) AS wins, row_number() OVER (PARTITION BY t.question ORDER BY coalesce(wins, 0.0) DESC, t.rank) AS rank FROM top t LEFT JOIN wins USING (question, item)""")
def pairwise_wins(spark, sf):
    better = lambda a, b: 1 / (1 + F.exp(-(F.round(a["score"], 6) - F.round(b["score"], 6))))
    cards = _cards(spark, sf).select("question", "item", "rank", "score")
    return select.pairwise_wins(cards, "question", "item", "rank", better, threshold=0.6)


@query(f"""WITH {CARDS}, asks AS (SELECT item_id AS question, {set_sql('text')} AS q FROM benchmark),
asked_cards AS (SELECT question, item, rank, {jaccard_sql('s', 'q')} AS a, {jaccard_sql('q', 's')} * 0.5 + 0.5 / rank AS b FROM cards JOIN asks USING (question) WHERE rank <= 12),
means AS (SELECT question, item, rank AS prior, round((a + b) / 2, 9) AS mean FROM asked_cards),
placed_all AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY mean DESC, prior) AS place FROM means)
SELECT question, item, round(mean, 6) AS mean, place AS rank, place <= 5 AS selected FROM placed_all""")
def joint_select(spark, sf):
    asks = load(spark, sf, "benchmark").select(F.col("item_id").alias("question"), T.token_set(F.col("text")).alias("q"))
    rows = _cards(spark, sf).where("rank <= 12").join(asks, "question")
    rows = rows.withColumn("a", T.jaccard(F.col("s"), F.col("q"))).withColumn("b", T.jaccard(F.col("q"), F.col("s")) * 0.5 + 0.5 / F.col("rank"))
    return select.joint_selection(rows, "question", "item", "rank", "a", "b")


#: Of the conversations: one section each; a turn that ends in a colon or names a list introduces one.
INTRO_SQL = r"(?i)\b(?:following|below)\b.{0,100}\b(?:methods|models|tasks|approaches|settings|variants|steps)\b|:[ \t\n\x0B\f\r]*$"
CONT_SQL = r"(?i)^(?:where\b|such that\b|which\b|and\b|or\b|with\b|respectively\b)"
NEIGHBOURS = f"""secs AS (SELECT doc_id, paragraph // 3 AS section, paragraph, CASE WHEN paragraph % 4 = 0 THEN text || ':' WHEN paragraph % 4 = 2 THEN 'and ' || text ELSE text END AS text FROM turns),
flags AS (SELECT *, regexp_matches(text, '{INTRO_SQL}') AS is_intro FROM secs),
near AS (SELECT *, last_value(CASE WHEN is_intro THEN paragraph END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li,
  lag(paragraph) OVER w AS lp, lead(paragraph) OVER w AS following, lead(text) OVER w AS after FROM flags WINDOW w AS (PARTITION BY doc_id, section ORDER BY paragraph)),
links AS (SELECT doc_id, section, paragraph, is_intro, CASE WHEN NOT is_intro THEN li END AS introduction, CASE WHEN NOT is_intro AND (li IS NULL OR lp <> li) THEN lp END AS preceding, following,
  CASE WHEN following IS NOT NULL THEN CASE WHEN right(rtrim(text), 1) IN (',', ':') OR regexp_matches(trim(after, {BLANKS}), '{CONT_SQL}') THEN 'dependent_source_continuation' ELSE 'following_source_paragraph' END END AS following_role FROM near)"""


def _links(spark, sf):
    u = turn_units(spark, sf)
    p = F.col("paragraph")
    text = F.when(p % 4 == 0, F.concat("text", F.lit(":"))).when(p % 4 == 2, F.concat(F.lit("and "), "text")).otherwise(F.col("text"))
    rows = u.select("doc_id", F.floor(p / 3).alias("section"), "paragraph", text.alias("text"))
    return select.neighbours(rows, "doc_id", "section", "paragraph", "text")


@query(f"WITH {TURNS}, {NEIGHBOURS} SELECT * FROM links")
def neighbor_context(spark, sf):
    return _links(spark, sf)


TURN_HITS = BM25.replace(UNITS, TURNS).replace("FROM units", "FROM turns")


@query(f"""WITH {TURN_HITS}, {NEIGHBOURS}, targets AS (SELECT question, doc_id, paragraph FROM ranked WHERE rank <= 12),
everything AS (SELECT question, doc_id, paragraph, true AS is_target FROM targets
UNION ALL SELECT question, doc_id, introduction, false FROM targets JOIN links USING (doc_id, paragraph) WHERE introduction IS NOT NULL
UNION ALL SELECT question, doc_id, preceding, false FROM targets JOIN links USING (doc_id, paragraph) WHERE preceding IS NOT NULL
UNION ALL SELECT question, doc_id, following, false FROM targets JOIN links USING (doc_id, paragraph) WHERE following IS NOT NULL)
SELECT question, doc_id, paragraph, bool_or(is_target) AS is_target FROM everything GROUP BY ALL""")
def evidence_packet(spark, sf):
    hits = lexical.bm25(turn_units(spark, sf), ["doc_id", "paragraph"], "text", load(spark, sf, "benchmark"), "item_id", "text", 12)
    return select.packet(hits.select("question", "doc_id", "paragraph"), _links(spark, sf), "question", "doc_id", "paragraph")


@query(f"""WITH RECURSIVE {NODES}, body AS (SELECT n.doc_id, n.node_id, n.parent_id, n.kind, n.start, n.depth, {set_sql('substr(d.text, n.start + 1, n."end" - n.start)')} AS s
  FROM nodes n JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM turns GROUP BY doc_id) d USING (doc_id)),
asks AS (SELECT conv_id AS doc_id, {set_sql('text')} AS q FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
scored AS (SELECT b.*, round({jaccard_sql('s', 'q')}, 6) AS score FROM body b JOIN asks USING (doc_id)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, node_id) AS rank FROM scored WHERE depth = 1),
l2 AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.start, s.node_id) AS rank FROM scored s JOIN l1 ON l1.doc_id = s.doc_id AND l1.node_id = s.parent_id AND l1.rank <= 2),
l3 AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.start, s.node_id) AS rank FROM scored s JOIN l2 ON l2.doc_id = s.doc_id AND l2.node_id = s.parent_id AND l2.rank <= 2)
SELECT doc_id, depth, node_id, score, rank FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE rank <= 2""")
def beam_search(spark, sf):
    return _beam(spark, sf)


def _beam(spark, sf, nodes=None):
    from arborspark.operators import search

    return search.beam(_scored_nodes(spark, sf, nodes), depth=3, width=2)


def _scored_nodes(spark, sf, nodes=None):
    """Node scores, written down: a document's text meets the list of its nodes once, and only the scores leave."""
    c = load(spark, sf, "conversations")
    asks = c.groupBy(F.col("conv_id").alias("doc_id")).agg(T.token_set(F.max_by("text", "turn")).alias("ask"))
    whole = _whole(spark, sf).withColumnRenamed("w", "text")
    rows = markdown.with_text(_nodes(spark, sf) if nodes is None else nodes, whole).join(asks, "doc_id")
    return written(rows.select("doc_id", "node_id", "parent_id", "kind", "start", "depth", F.round(T.jaccard(T.token_set(F.col("text")), F.col("ask")), 6).alias("score")))


@query(f"""WITH RECURSIVE {NODES}, body AS (SELECT n.doc_id, n.node_id, n.parent_id, n.kind, n.start, n."end", n.depth, {set_sql('substr(d.text, n.start + 1, n."end" - n.start)')} AS s
  FROM nodes n JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM turns GROUP BY doc_id) d USING (doc_id)),
asks AS (SELECT conv_id AS doc_id, {set_sql('text')} AS q FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
scored AS (SELECT b.*, round({jaccard_sql('s', 'q')}, 6) AS score FROM body b JOIN asks USING (doc_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, node_id) AS hit FROM scored WHERE depth > 0),
up AS (SELECT doc_id, node_id AS leaf, node_id, parent_id FROM nodes UNION ALL SELECT u.doc_id, u.leaf, n.node_id, n.parent_id FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node_id = u.parent_id),
opened AS (SELECT h.doc_id, h.hit, p.node_id, p.score, row_number() OVER (PARTITION BY h.doc_id, h.hit ORDER BY p.score DESC, p.start, p.node_id) AS k
  FROM hits h JOIN up ON up.doc_id = h.doc_id AND up.node_id = h.node_id JOIN scored p ON p.doc_id = up.doc_id AND p.node_id = up.leaf AND p.kind = 'paragraph' WHERE h.hit <= 5)
SELECT doc_id, hit, node_id, score FROM opened WHERE k <= 3""")
def global_hits(spark, sf):
    from arborspark.operators import search

    nodes = _scored_nodes(spark, sf)
    return search.open_hits(nodes, tree.paths(nodes), hits=5, best=3)


@query()
def evidence_coverage(spark, sf):
    """Greedy coverage over the cards of each question, with two needs: the words of its halves."""
    asks = load(spark, sf, "benchmark").select(F.col("item_id").alias("question"), T.tokens(F.col("text")).alias("w"))
    half = F.ceil(F.size("w") / 2).cast("int")
    asks = asks.select("question", F.array_distinct(F.slice("w", F.lit(1), F.greatest(half, F.lit(1)))).alias("n0"), F.array_distinct(F.slice("w", F.greatest(half, F.lit(1)), F.size("w") + 1)).alias("n1"))
    rows = _cards(spark, sf).where("rank <= 30").join(asks, "question")
    rows = rows.select("question", "item", T.jaccard(F.col("s"), F.col("n0")).alias("a"), T.jaccard(F.col("s"), F.col("n1")).alias("b"), (F.col("score") / 100).alias("relevance"), "cost")
    return select.select_evidence(rows, "question", "item", ["a", "b"], "relevance", "cost", 300)


@query()
def frontier_search(spark, sf):
    """Layer beam with deferred nodes taken up again while the decision budget lasts."""
    from arborspark.operators import search

    return search.resumed(_scored_nodes(spark, sf), width=2, accept=0.02, budget=40)


WHOLE = "whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS w FROM turns GROUP BY doc_id)"


def _whole(spark, sf):
    by = turn_units(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("us"))
    return by.select("doc_id", F.array_join(F.transform("us", lambda u: u["text"]), "\n\n").alias("w"))


@query(f"""WITH RECURSIVE {NODES}, {WHOLE}, cites AS (SELECT doc_id, node_id, substr(w, 1, start) AS before, substr(w, start + 1, "end" - start) AS body FROM nodes JOIN whole USING (doc_id))
SELECT doc_id, node_id, length(before) - length(replace(before, chr(10), '')) + 1 AS first_line,
length(before) - length(replace(before, chr(10), '')) + length(body) - length(replace(body, chr(10), '')) + 1 AS last_line, sha256(body) AS sha FROM cites""")
def read_citation(spark, sf):
    return tree.citations(_nodes(spark, sf), _whole(spark, sf).withColumnRenamed("w", "text"))


@query(f"""WITH RECURSIVE {NODES}, held AS MATERIALIZED (SELECT * FROM nodes) SELECT c.doc_id, c.node_id, c.kind, p.node_id AS parent_id, p.kind AS parent_kind, p."end" - p.start AS parent_chars
FROM held c JOIN held p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id""")
def node_parents(spark, sf):
    n = written(_nodes(spark, sf))
    p = n.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), (F.col("end") - F.col("start")).alias("parent_chars"))
    return n.select("doc_id", "node_id", "kind", "parent_id").join(p, ["doc_id", "parent_id"])


@query(f"""WITH {CARDS}, per_doc AS (SELECT question, doc_id, count(*) AS n, sum(cost) AS used, min(rank) AS best FROM cards WHERE rank <= 30 GROUP BY ALL),
widths AS (SELECT doc_id, sum(len({tokens_sql('text')})) AS whole_cost FROM units GROUP BY doc_id)
SELECT question, doc_id, n, used::BIGINT AS used, best, whole_cost::BIGINT AS whole_cost, n >= 2 AND used / whole_cost >= (1 + used / 2048) / 3 AS merged FROM per_doc JOIN widths USING (doc_id)""")
def context_merge(spark, sf):
    """Hits of one document give way to the whole of it where they cover a share of it that grows with the budget used."""
    hits = _cards(spark, sf).where("rank <= 30").groupBy("question", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("used"), F.min("rank").alias("best"))
    whole = doc_units(spark, sf).groupBy("doc_id").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("whole_cost"))
    merged = (F.col("n") >= 2) & (F.col("used") / F.col("whole_cost") >= (1 + F.col("used") / 2048) / 3)
    return hits.join(whole, "doc_id").select("question", "doc_id", "n", "used", "best", "whole_cost", merged.alias("merged"))
