"""Queries over packets, layer search, checks and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborspark.functions import text as T
from arborspark.operators import checks, fusion, markdown, pack, packet, tree, walk
from arborspark.plans.corpus import BLANKS, NODES, TURNS, _nodes, jaccard_sql, set_sql, turn_units
from arborspark.plans.registry import load, query
from arborspark.plans.retrieval import CARDS, CONT_SQL, INTRO_SQL, LISTS, TURN_HITS, _cards, _lists
from arborspark.plans.structure import GUIDE_TREE, _found, _guides, _targets, _tree
from arborspark.sources.work import written

#: Of the conversations: sections of three turns, headings of six; some turns introduce a list or carry on another.
LEANING = f"""parts AS MATERIALIZED (SELECT doc_id, paragraph, paragraph // 3 AS section, 'H' || paragraph // 6 AS heading, CASE WHEN paragraph % 4 = 0 THEN text || ':' WHEN paragraph % 4 = 2 THEN 'and ' || text ELSE text END AS text FROM turns),
flagged_parts AS (SELECT *, regexp_matches(text, '{INTRO_SQL}') AS own FROM parts),
near_parts AS (SELECT *, last_value(CASE WHEN own THEN paragraph END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ip, lag(paragraph) OVER w AS lp, lead(paragraph) OVER w AS np, lead(text) OVER w AS after
  FROM flagged_parts WINDOW w AS (PARTITION BY doc_id, section ORDER BY paragraph)),
sized_parts AS (SELECT n.*, length(i.text) AS il, length(l.text) AS ll FROM near_parts n LEFT JOIN parts i ON i.doc_id = n.doc_id AND i.paragraph = n.ip LEFT JOIN parts l ON l.doc_id = n.doc_id AND l.paragraph = n.lp),
leans AS MATERIALIZED (SELECT doc_id, paragraph AS target, ip AS context, 'active_source_introduction' AS role, il > 90 AS omitted FROM sized_parts WHERE NOT own AND ip IS NOT NULL
  UNION ALL SELECT doc_id, paragraph, lp, 'preceding_source_paragraph', CASE WHEN ip IS NOT NULL AND il <= 90 THEN il ELSE 0 END + ll > 90 FROM sized_parts WHERE NOT own AND lp IS NOT NULL AND lp IS DISTINCT FROM ip
  UNION ALL SELECT doc_id, paragraph, np, CASE WHEN right(rtrim(text), 1) IN (',', ':') OR regexp_matches(trim(after, {BLANKS}), '{CONT_SQL}') THEN 'dependent_source_continuation' ELSE 'following_source_paragraph' END, false FROM sized_parts WHERE np IS NOT NULL)"""


def _parts(spark, sf):
    p = F.col("paragraph")
    text = F.when(p % 4 == 0, F.concat("text", F.lit(":"))).when(p % 4 == 2, F.concat(F.lit("and "), "text")).otherwise(F.col("text"))
    return turn_units(spark, sf).select("doc_id", "paragraph", F.floor(p / 3).alias("section"), F.concat(F.lit("H"), F.floor(p / 6).cast("string")).alias("heading"), text.alias("text"))


@query(f"WITH {TURNS}, {LEANING} SELECT * FROM leans")
def packet_links(spark, sf):
    """What each paragraph leans on, within an allowance of characters."""
    return packet.links(_parts(spark, sf), allowance=90)


ORDERED = "list_position(['active_source_introduction', 'preceding_source_paragraph', 'dependent_source_continuation', 'following_source_paragraph'], role)"


def _hop(n: int) -> str:
    return f"""named{n} AS (SELECT t.question, t.doc_id, l.context AS target, min({{'s': t.seat, 'o': {ORDERED}}}) AS spot FROM t{n - 1} t JOIN leans l ON l.doc_id = t.doc_id AND l.target = t.target WHERE NOT omitted AND role IN ('active_source_introduction', 'dependent_source_continuation') GROUP BY ALL),
fresh{n} AS (SELECT n.*, (SELECT max(seat) FROM t{n - 1} m WHERE m.question = n.question AND m.doc_id = n.doc_id) + row_number() OVER (PARTITION BY n.question, n.doc_id ORDER BY spot) AS seat FROM named{n} n ANTI JOIN t{n - 1} USING (question, doc_id, target)),
t{n} AS MATERIALIZED (SELECT * FROM t{n - 1} UNION ALL SELECT question, doc_id, target, seat, {n} FROM fresh{n} WHERE seat <= 4)"""


@query(f"""WITH {TURN_HITS}, {LEANING}, placed_hits AS (SELECT question, doc_id, paragraph AS target, row_number() OVER (PARTITION BY question, doc_id ORDER BY rank) AS seat FROM ranked WHERE rank <= 64),
t0 AS MATERIALIZED (SELECT *, 0 AS hop FROM placed_hits WHERE seat <= 2), {_hop(1)}, {_hop(2)},
every_part AS (SELECT question, doc_id, target AS paragraph, true AS is_target, hop FROM t2 UNION ALL SELECT t.question, t.doc_id, l.context, false, NULL FROM t2 t JOIN leans l ON l.doc_id = t.doc_id AND l.target = t.target WHERE NOT omitted)
SELECT question, doc_id, paragraph, bool_or(is_target) AS is_target, CAST(min(hop) AS BIGINT) AS hop FROM every_part GROUP BY ALL""")
def packet_expanded(spark, sf):
    """Packets of two targets that grow over introductions and continuations to at most four."""
    from arborspark.operators import lexical

    hits = lexical.bm25(turn_units(spark, sf), ["doc_id", "paragraph"], "text", load(spark, sf, "benchmark"), "item_id", "text", 64)
    return packet.packet(hits.select("question", "doc_id", "paragraph", "rank"), packet.links(_parts(spark, sf), allowance=90), "question", base=2, expand=True, most=4)


#: Scores of the nodes of each conversation for two needs: the words of its last turn and of its first one.
NEEDS = f"""nodes_of AS MATERIALIZED (SELECT * FROM nodes), whole_text AS MATERIALIZED (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS w FROM turns GROUP BY doc_id),
asked_needs AS (SELECT conv_id AS doc_id, {set_sql('arg_max(text, turn)')} AS q0, {set_sql('arg_min(text, turn)')} AS q1 FROM conversations GROUP BY conv_id),
node_sets AS (SELECT n.*, {set_sql('substr(w, n.start + 1, n."end" - n.start)')} AS s FROM nodes_of n JOIN whole_text USING (doc_id)),
scored_nodes AS MATERIALIZED (SELECT doc_id, node_id, parent_id, kind, start, depth, round({jaccard_sql('s', 'q0')}, 6) AS s0, round({jaccard_sql('s', 'q1')}, 6) AS s1 FROM node_sets JOIN asked_needs USING (doc_id))"""


def _need_scores(spark, sf):
    units = turn_units(spark, sf)
    whole = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("us")).select("doc_id", F.array_join(F.transform("us", lambda u: u["text"]), "\n\n").alias("text"))
    c = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("first"))
    asks = c.select("doc_id", T.token_set(F.col("last")).alias("q0"), T.token_set(F.col("first")).alias("q1"))
    rows = markdown.with_text(written(_nodes(spark, sf)), whole).withColumn("s", T.token_set(F.col("text"))).join(asks, "doc_id")
    score = lambda q: F.round(T.jaccard(F.col("s"), F.col(q)), 6)
    return written(rows.select("doc_id", "node_id", "parent_id", "kind", "start", "depth", score("q0").alias("s0"), score("q1").alias("s1")))


LAYERS = walk.Limits(beam=2, acceptance=0.02)
LAYER_SQL = f"""WITH RECURSIVE {NODES}, {NEEDS}, by_need AS (SELECT doc_id, node_id, parent_id, kind, start, depth, unnest([0, 1]) AS need, unnest([s0, s1]) AS score FROM scored_nodes WHERE kind <> 'sentence'),
first_layer AS (SELECT *, row_number() OVER (PARTITION BY doc_id, need ORDER BY score DESC, start, node_id) AS r FROM by_need WHERE depth = 1 AND score >= 0.02),
told AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id, p.need ORDER BY p.score DESC, p.node_id) AS place FROM by_need p JOIN first_layer f ON f.doc_id = p.doc_id AND f.need = p.need AND f.node_id = p.parent_id AND f.r <= 2 WHERE p.depth = 2)"""


@query(f"""{LAYER_SQL}, fused AS (SELECT doc_id, node_id, round(sum(1.0 / (60 + place)), 9) AS score FROM told GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id) AS rank FROM fused""")
def layer_search(spark, sf):
    """Layer beam for two needs: every paragraph that is scored stays, the needs' rankings are fused."""
    return walk.ranking(walk.trace(_need_scores(spark, sf), ["s0", "s1"], LAYERS))


@query(f"{LAYER_SQL} SELECT doc_id, need, node_id, score, place FROM told")
def need_rankings(spark, sf):
    return walk.need_rankings(walk.trace(_need_scores(spark, sf), ["s0", "s1"], LAYERS)).withColumn("need", F.col("need").cast("int"))


@query()
def deferred_search(spark, sf):
    """The layer beam under a budget, with a second look at weak nodes and deferred nodes taken up again."""
    limits = walk.Limits(beam=1, acceptance=0.02, refine_below=0.1, decisions=60, extra=0.5)
    return walk.ranking(walk.trace(_need_scores(spark, sf), ["s0", "s1"], limits, second=["s1", "s0"]))


@query()
def strict_search(spark, sf):
    """The layer beam that asks paragraphs for acceptance and a place in the beam as well."""
    return walk.ranking(walk.trace(_need_scores(spark, sf), ["s0", "s1"], walk.Limits(beam=2, acceptance=0.05, strict=True)))


@query()
def route_tree(spark, sf):
    """Root-to-leaf beam for two needs with routing budgets, paid a round at a time; a node's tokens are its length in tens of characters."""
    nodes = _need_scores(spark, sf).join(_nodes(spark, sf).select("doc_id", "node_id", F.floor((F.col("end") - F.col("start")) / 10).alias("cost")), ["doc_id", "node_id"])
    return walk.routed(nodes, ["s0", "s1"], beam=2, acceptance=0.02, depth=3, most_nodes=30, most_tokens=600, cost="cost")


@query(f"""WITH RECURSIVE {NODES}, {NEEDS}, rules(rule) AS (VALUES ('children'), ('lineage'), ('unselected'), ('repeated')), searched AS (SELECT DISTINCT doc_id FROM scored_nodes WHERE parent_id IS NOT NULL)
SELECT doc_id, rule, 0 AS n FROM searched, rules""")
def trace_conformance(spark, sf):
    """Every step of every trace follows from the tree and the steps before: no violation of any rule."""
    nodes = _need_scores(spark, sf)
    return walk.conformance(written(walk.trace(nodes, ["s0", "s1"], LAYERS)), nodes).withColumn("n", F.col("n").cast("int"))


@query(f"""WITH {TURNS}, units_of AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 AND paragraph = 2 THEN 7 ELSE paragraph END AS paragraph, CASE WHEN doc_id % 5 = 2 THEN paragraph % 2 ELSE paragraph // 3 END AS section, CASE WHEN doc_id % 5 = 3 THEN 'h' || paragraph ELSE 'h' || paragraph // 3 END AS heading,
  start, start + length(text) + CASE WHEN doc_id % 5 = 4 THEN 5 ELSE 0 END AS "end" FROM turns),
sizes AS (SELECT doc_id, max(start + length(text)) AS size, doc_id % 7 = 0 AS untitled FROM turns GROUP BY doc_id),
seen AS (SELECT u.*, size, coalesce(max("end") OVER (PARTITION BY u.doc_id ORDER BY paragraph, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach, section IS DISTINCT FROM lag(section) OVER w OR row_number() OVER w = 1 AS begins, row_number() OVER w - 1 AS place FROM units_of u JOIN sizes USING (doc_id) WINDOW w AS (PARTITION BY u.doc_id ORDER BY paragraph, start)),
judged AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, section) AS again, min(heading) OVER (PARTITION BY doc_id, section) <> max(heading) OVER (PARTITION BY doc_id, section) AS other FROM seen),
broken AS (SELECT doc_id, 'number' AS rule, count(*) FILTER (paragraph <> place) AS n FROM judged GROUP BY doc_id UNION ALL SELECT doc_id, 'span', count(*) FILTER (NOT (reach <= start AND start < "end" AND "end" <= size)) FROM judged GROUP BY doc_id
  UNION ALL SELECT doc_id, 'scattered_section', count(*) FILTER (again > 1) FROM judged GROUP BY doc_id UNION ALL SELECT doc_id, 'headings_differ', count(*) FILTER (other) FROM judged GROUP BY doc_id UNION ALL SELECT doc_id, 'no_title', untitled::INT FROM sizes)
SELECT * FROM broken WHERE n > 0""")
def document_issues(spark, sf):
    """Faults put into one conversation of five of each kind, and what the check of documents says of them."""
    u, d, p = turn_units(spark, sf), F.col("doc_id"), F.col("paragraph")
    whole = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("us"))
    docs = whole.select("doc_id", F.when(d % 7 != 0, "t").alias("title"), F.array_join(F.transform("us", lambda x: x["text"]), "\n\n").alias("text"))
    third = F.floor(p / 3)
    rows = u.select("doc_id", F.when((d % 5 == 1) & (p == 2), 7).otherwise(p).cast("bigint").alias("paragraph"), F.when(d % 5 == 2, p % 2).otherwise(third).alias("section"), F.concat(F.lit("h"), F.when(d % 5 == 3, p).otherwise(third).cast("string")).alias("heading"), "start", (F.col("end") + F.when(d % 5 == 4, 5).otherwise(0)).alias("end"))
    return checks.document_issues(rows, docs)


FAULTY = """faulty AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND node_id = 'n000003' THEN 'n000002' ELSE node_id END AS node_id, CASE WHEN doc_id % 4 = 2 AND node_id = 'n000004' THEN 'gone' ELSE parent_id END AS parent_id, kind, start, CASE WHEN doc_id % 4 = 3 AND kind = 'sentence' THEN "end" + 900 ELSE "end" END AS "end" FROM tree_nodes)"""


@query(f"""WITH RECURSIVE {GUIDE_TREE}, {FAULTY}, sizes AS (SELECT doc_id, length(text) AS size FROM guides),
checked AS (SELECT c.*, size, p.start AS ps, p."end" AS pe FROM faulty c JOIN sizes USING (doc_id) LEFT JOIN faulty p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id),
told_targets AS (SELECT t.doc_id, h.node_id AS target_id, h.kind FROM targets t JOIN tree_nodes h ON h.doc_id = t.doc_id AND h.start = t.target AND h.kind = 'heading'),
broken AS (SELECT doc_id, 'span' AS rule, count(*) FILTER (NOT (coalesce(ps, 0) <= start AND start <= "end" AND "end" <= coalesce(pe, size))) AS n FROM checked GROUP BY doc_id
  UNION ALL SELECT doc_id, 'orphan', count(*) FILTER (parent_id IS NOT NULL AND ps IS NULL) FROM checked GROUP BY doc_id
  UNION ALL SELECT doc_id, 'repeated_id', count(*) FILTER (times > 1) FROM (SELECT doc_id, node_id, count(*) AS times FROM faulty GROUP BY ALL) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'digest', (doc_id % 6 = 0)::INT FROM guides
  UNION ALL SELECT t.doc_id, 'target', count(*) FILTER (f.kind IS DISTINCT FROM 'heading') FROM told_targets t LEFT JOIN faulty f ON f.doc_id = t.doc_id AND f.node_id = t.target_id GROUP BY t.doc_id)
SELECT * FROM broken WHERE n > 0""")
def index_issues(spark, sf):
    """Faults put into the content trees of guides, and what the check of an index says of them."""
    found = _found(spark, sf)
    nodes, d, name = _tree(spark, sf, found), F.col("doc_id"), F.col("node_id")
    bad = nodes.select("doc_id", F.when((d % 4 == 1) & (name == "n000003"), "n000002").otherwise(name).alias("node_id"), F.when((d % 4 == 2) & (name == "n000004"), "gone").otherwise(F.col("parent_id")).alias("parent_id"), "kind", "start", (F.col("end") + F.when((d % 4 == 3) & (F.col("kind") == "sentence"), 900).otherwise(0)).alias("end"))
    docs = _guides(spark, sf).withColumn("sha", F.when(d % 6 == 0, "stale").otherwise(F.sha2("text", 256)))
    heads = nodes.where("kind = 'heading'").select("doc_id", F.col("start").alias("target"), F.col("node_id").alias("target_id"))
    targets = _targets(found).join(heads, ["doc_id", "target"]).select("doc_id", "start", "target_id")
    return checks.index_issues(bad, docs, sha="sha", targets=targets)


@query(f"""WITH {CARDS}, given AS (SELECT question, c.doc_id, CASE WHEN rank = 3 THEN 'same' WHEN rank = 4 THEN 'same' ELSE item END AS item, u.start + CASE WHEN rank = 2 THEN 1 ELSE 0 END AS start, u."end" + CASE WHEN rank = 5 THEN 999999 ELSE 0 END AS "end", u.text FROM cards c JOIN units u USING (doc_id, paragraph) WHERE rank <= 8),
lapped AS (SELECT g.*, d.text AS source, coalesce(max("end") OVER (PARTITION BY question, g.doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false) AS lap, count(*) OVER (PARTITION BY question, item) AS times FROM given g JOIN documents d USING (doc_id)),
flags AS (SELECT question, coalesce(0 <= start AND start < "end" AND "end" <= length(source), false) AS bounds, substr(source, start + 1, "end" - start) = text AS exact, lap, times FROM lapped),
broken AS (SELECT question, 'bounds' AS rule, count(*) FILTER (NOT bounds) AS n FROM flags GROUP BY ALL UNION ALL SELECT question, 'text', count(*) FILTER (bounds AND NOT exact) FROM flags GROUP BY ALL UNION ALL SELECT question, 'overlap', count(*) FILTER (lap) FROM flags GROUP BY ALL UNION ALL SELECT question, 'repeated', count(*) FILTER (times > 1) FROM flags GROUP BY ALL)
SELECT * FROM broken WHERE n > 0""")
def span_issues(spark, sf):
    from arborspark.operators import lexical
    from arborspark.plans.corpus import doc_units

    u = doc_units(spark, sf).select("doc_id", "paragraph", "start", "end")
    r = F.col("rank")
    rows = lexical.with_passages(_cards(spark, sf).where("rank <= 8"), u, ["doc_id", "paragraph"])
    rows = rows.select("question", "doc_id", F.when(r.isin(3, 4), "same").otherwise(F.col("item")).alias("item"), (F.col("start") + F.when(r == 2, 1).otherwise(0)).alias("start"), (F.col("end") + F.when(r == 5, 999999).otherwise(0)).alias("end"), "text")
    docs = lexical.with_passages(rows.select("doc_id").distinct(), load(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    return checks.span_issues(rows, docs, "question")


@query("""WITH s AS (SELECT o_custkey AS k, list(CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 1.5 ELSE (o_orderkey % 11) / 10.0 END) AS xs, count(*) + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS asked FROM orders GROUP BY o_custkey),
broken AS (SELECT k, 'count' AS rule, (len(xs) <> asked)::INT AS n FROM s UNION ALL SELECT k, 'range', (len(list_filter(xs, lambda x: x IS NULL OR x < 0 OR x > 1)) > 0)::INT FROM s) SELECT * FROM broken WHERE n > 0""")
def score_issues(spark, sf):
    k = F.col("o_orderkey")
    x = F.struct(F.when(k % 31 == 0, F.lit(None).cast("double")).when(k % 37 == 0, 1.5).otherwise(k % 11 / 10.0).alias("x"))
    s = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(x).alias("xs"))
    s = s.select("k", F.transform("xs", lambda v: v["x"]).alias("score"), F.array_repeat(F.lit(1), F.size("xs") + F.when(F.col("k") % 13 == 0, 1).otherwise(0)).alias("asked"))
    return checks.score_issues(s, "k", "asked", "score")


@query(f"""WITH n AS (SELECT conv_id AS k, turn, CASE WHEN conv_id % 4 = 0 THEN lower(role) WHEN conv_id % 4 = 1 AND turn % 2 = 0 THEN ' ' ELSE text END AS need FROM conversations),
per AS (SELECT k, count(need) AS size, count(*) FILTER (trim(need, {BLANKS}) = '') AS blank, count(*) FILTER (length(need) > 120) AS long, count(need) - count(DISTINCT replace(lower(trim(need, {BLANKS})), 'ß', 'ss')) AS repeated FROM n GROUP BY k),
broken AS (SELECT k, 'count' AS rule, CASE WHEN size < 1 OR size > 3 THEN size ELSE 0 END AS n FROM per UNION ALL SELECT k, 'blank', blank FROM per UNION ALL SELECT k, 'long', long FROM per UNION ALL SELECT k, 'repeated', repeated FROM per) SELECT * FROM broken WHERE n > 0""")
def need_issues(spark, sf):
    c = load(spark, sf, "conversations")
    need = F.when(F.col("conv_id") % 4 == 0, F.lower("role")).when((F.col("conv_id") % 4 == 1) & (F.col("turn") % 2 == 0), " ").otherwise(F.col("text"))
    return checks.need_issues(c.select(F.col("conv_id").alias("k"), need.alias("need")), "k", "need", longest=120)


@query("""WITH n AS (SELECT conv_id AS k, turn AS place, role AS request FROM conversations), q AS (SELECT conv_id, arg_max(CASE WHEN conv_id % 2 = 0 THEN text ELSE role END, turn) AS request FROM conversations GROUP BY conv_id),
every AS (SELECT * FROM n UNION ALL SELECT conv_id, 4611686018427387904, request FROM q), first_at AS (SELECT k, request, min(place) AS spot FROM every GROUP BY ALL)
SELECT k, request, row_number() OVER (PARTITION BY k ORDER BY spot) - 1 AS place FROM first_at""")
def search_requests(spark, sf):
    """The needs of a search in order, then its question, each once."""
    c = load(spark, sf, "conversations")
    needs = c.select(F.col("conv_id").alias("k"), F.col("turn").alias("place"), F.col("role").alias("need"))
    q = c.groupBy(F.col("conv_id").alias("k")).agg(F.max_by(F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.col("role")), "turn").alias("question"))
    return checks.requests(needs, q, "k", "need", "question")


PICKED = "substr(sha256(doc_id || ':' || node_id), 1, 1) < '6'"


@query(f"""WITH RECURSIVE {NODES}, nodes_of AS MATERIALIZED (SELECT doc_id, node_id, parent_id FROM nodes), chosen AS MATERIALIZED (SELECT * FROM nodes_of WHERE {PICKED}),
up AS (SELECT doc_id, node_id, parent_id AS over FROM chosen WHERE parent_id IS NOT NULL UNION ALL SELECT u.doc_id, u.node_id, n.parent_id FROM up u JOIN nodes_of n ON n.doc_id = u.doc_id AND n.node_id = u.over WHERE n.parent_id IS NOT NULL)
SELECT doc_id, node_id FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM up u JOIN chosen o ON o.doc_id = u.doc_id AND o.node_id = u.over WHERE u.doc_id = c.doc_id AND u.node_id = c.node_id)""")
def outermost_evidence(spark, sf):
    """Chosen nodes without those that lie below another chosen one."""
    nodes = written(_nodes(spark, sf))
    chosen = nodes.where(F.substring(F.sha2(F.concat_ws(":", "doc_id", "node_id"), 256), 1, 1) < "6").select("doc_id", "node_id")
    return checks.without_covered(chosen, tree.paths(nodes))


@query("""WITH refs AS (SELECT l_orderkey AS owner, list(DISTINCT l_partkey) AS xs, count(*) AS n_refs FROM lineitem GROUP BY l_orderkey), lost AS (SELECT owner, n_refs, unnest(xs) AS p_partkey FROM refs)
SELECT owner, n_refs, list(p_partkey ORDER BY p_partkey) AS missing FROM lost WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY ALL""")
def dangling_references(spark, sf):
    """Gold ids that no known item has, by question."""
    refs = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_list("l_partkey").alias("refs"))
    return checks.dangling(refs, "owner", "refs", load(spark, sf, "part").where("p_partkey % 10 <> 0"), "p_partkey")


@query("""WITH k AS (SELECT sha256(text) AS cluster, length(text) AS size, unnest([{'f': 'all', 'v': 'all'}, {'f': 'lang', 'v': coalesce(lang, 'null')}, {'f': 'source', 'v': coalesce(source, 'null')}]) AS x FROM documents WHERE text IS NOT NULL),
one AS (SELECT x.f AS facet, x.v AS value, cluster, count(*) AS n, max(size) AS size FROM k GROUP BY ALL) SELECT facet, value, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_texts, CAST(sum(size) AS BIGINT) AS chars FROM one GROUP BY ALL""")
def context_clusters(spark, sf):
    return checks.clusters(load(spark, sf, "documents").where("text is not null"), "text", ["lang", "source"])


POOLS = LISTS + """, fuse AS (SELECT question, doc_id, round(sum(1.0 / (60 + p)), 9) AS a, round(sum(CASE source WHEN 'best' THEN 0.25 ELSE 0.75 END / (60 + p)), 9) AS b FROM placed_lists GROUP BY ALL),
tops AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY a DESC, CAST(doc_id AS VARCHAR)) AS ra, row_number() OVER (PARTITION BY question ORDER BY b DESC, CAST(doc_id AS VARCHAR)) AS rb FROM fuse)"""


@query(f"""WITH {POOLS} SELECT question, count(*) FILTER (ra <= 10) AS n_left, count(*) FILTER (rb <= 10) AS n_right, list(doc_id ORDER BY ra) FILTER (ra <= 10) = list(doc_id ORDER BY rb) FILTER (rb <= 10) AS same FROM tops GROUP BY question""")
def pool_equality(spark, sf):
    lists = written(_lists(spark, sf))
    weighted = lists.withColumn("w", F.when(F.col("source") == "best", 0.25).otherwise(0.75))
    one, two = fusion.fused(lists, "question", "doc_id", "place"), fusion.fused(weighted, "question", "doc_id", "place", weight="w")
    return checks.pools_differ(one, two, "question", "doc_id", "rank", 10)


@query(f"""WITH {CARDS}, given AS (SELECT question, CASE WHEN rank = 3 AND score > 3 THEN 'nowhere' WHEN rank = 2 THEN (SELECT item FROM cards o WHERE o.question = c.question AND o.rank = 1) ELSE item END AS item, CASE WHEN rank >= 6 THEN rank + 1 ELSE rank END AS rank FROM cards c WHERE rank <= 8),
flags AS (SELECT g.question, k.item IS NULL AS unknown, count(*) OVER (PARTITION BY g.question, g.item) > 1 AS repeated, g.rank <> row_number() OVER (PARTITION BY g.question ORDER BY g.rank) AS place FROM given g LEFT JOIN (SELECT DISTINCT question, item FROM cards) k ON k.question = g.question AND k.item = g.item),
broken AS (SELECT question, 'repeated' AS rule, count(*) FILTER (repeated) AS n FROM flags GROUP BY ALL UNION ALL SELECT question, 'unknown', count(*) FILTER (unknown) FROM flags GROUP BY ALL UNION ALL SELECT question, 'place', count(*) FILTER (place) FROM flags GROUP BY ALL)
SELECT * FROM broken WHERE n > 0""")
def prediction_issues(spark, sf):
    """Rankings with faults put in; packings are made again and agree."""
    cards = written(_cards(spark, sf))
    first = F.max(F.when(F.col("rank") == 1, F.col("item"))).over(Window.partitionBy("question"))
    item = F.when((F.col("rank") == 3) & (F.col("score") > 3), "nowhere").when(F.col("rank") == 2, first).otherwise(F.col("item"))
    rows = cards.where("rank <= 8").select("question", item.alias("item"), (F.col("rank") + F.when(F.col("rank") >= 6, 1).otherwise(0)).alias("rank"))
    packed = pack.packed(cards, "question", "item", "rank", "cost", 300)
    return checks.prediction_issues(rows, cards, packed, packed, "question", "item")


@query(f"""WITH RECURSIVE {GUIDE_TREE}, tops AS (SELECT doc_id, count(*) FILTER (kind = 'heading' OR parent_id = 'root') AS root_before, count(*) FILTER (parent_id = 'root') AS root_after FROM tree_nodes GROUP BY doc_id)
SELECT doc_id, 0 AS n_lost, 0 AS n_new, root_before, root_after FROM tops""")
def hierarchy_audit(spark, sf):
    """Flat headings against nested ones: leaves stay as they are, the root has fewer children."""
    nodes = _tree(spark, sf)
    flat = nodes.withColumn("parent_id", F.when(F.col("kind") == "heading", "root").otherwise(F.col("parent_id")))
    return checks.moved_leaves(flat, nodes)


@query("""WITH h AS (SELECT doc_id, lang, source, sha256('pick:' || doc_id) AS hash FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY hash, doc_id) AS nth FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY nth, hash, doc_id) AS place FROM n WHERE nth <= 2) SELECT doc_id, lang, source, place FROM p WHERE place <= 6""")
def capped_pick(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "lang", "source")
    return checks.capped_pick(rows, "lang", "source", "doc_id", 6, "pick")


@query()
def disjoint_batches(spark, sf):
    """Orders in batches of eight in which no customer occurs twice, by priority."""
    rows = load(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return checks.batched(rows, "o_orderpriority", "o_custkey", "o_orderkey", 8)


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 3 > 0 THEN chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type ELSE '' END AS question FROM part""")
def option_text(spark, sf):
    options = F.when(F.col("p_size") % 3 > 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "part").select("p_partkey", packet.option_text(F.col("p_name"), options).alias("question"))


@query("""WITH grid AS (SELECT a, b, c, d FROM (SELECT unnest([-1, 15, 30, 50]) AS a), (SELECT unnest([-1, 85, 90, 95]) AS b), (SELECT unnest([2, 4]) AS c), (SELECT unnest([-1, 30, 50, 70]) AS d)),
h AS (SELECT *, sha256('grid:' || a || ',' || b || ',' || c || ',' || d) AS hash FROM grid) SELECT *, row_number() OVER (ORDER BY hash) AS place FROM h QUALIFY place <= 13""")
def parameter_grid(spark, sf):
    """Settings drawn from a grid of parameters by hash order."""
    from arborspark.plans.config import grid_sample

    return grid_sample(spark, {"a": [-1, 15, 30, 50], "b": [-1, 85, 90, 95], "c": [2, 4], "d": [-1, 30, 50, 70]}, 13, "grid")


@query("""SELECT o_orderpriority AS method, round(avg(CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 4 = o_custkey % 4)::INT ELSE 0 END), 6) AS accuracy, count(*) FILTER (o_orderkey % 9 = 0) AS invalid, count(*) AS n FROM orders GROUP BY ALL""")
def closed_book(spark, sf):
    """Label accuracy in which an answer that names no option counts as wrong."""
    from arborspark.operators.metrics import accuracy

    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("method"), F.when(k % 9 != 0, k % 4).alias("answer"), (F.col("o_custkey") % 4).alias("label"))
    return accuracy(rows, ["method"], "answer", "label")


@query()
def merged_context(spark, sf):
    """Reading contexts of each question and document, in which two or more hits of one topic block may give way to all of it."""
    from arborspark.operators import lexical

    u = turn_units(spark, sf)
    hits = lexical.bm25(u, ["doc_id", "paragraph"], "text", load(spark, sf, "benchmark"), "item_id", "text", 64)
    rows = hits.join(u, ["doc_id", "paragraph"]).select("question", "doc_id", F.concat(F.lit("p"), "paragraph").alias("item"), "rank", "start", "end", F.lit("turn").alias("heading"), "text")
    whole = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("us")).select("doc_id", F.array_join(F.transform("us", lambda x: x["text"]), "\n\n").alias("text"))
    blocks = markdown.with_text(_nodes(spark, sf).where("kind = 'section'").select("doc_id", "node_id", "start", "end"), whole).select("doc_id", F.col("node_id").alias("item"), "start", "end", F.lit("block").alias("heading"), "text")
    titles = u.select("doc_id").distinct().select("doc_id", F.concat(F.lit("conversation "), "doc_id").alias("title"))
    return packet.merged_contexts(rows, blocks, titles, "question", 60, lambda text: len(text.split()))
