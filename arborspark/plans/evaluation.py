"""Queries over metrics, statistics, splits and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborspark.functions import text as T
from arborspark.operators import metrics, segment, splits
from arborspark.plans.corpus import BM25, TOPICS, UNITS, _bm25, _topics, doc_units, tokens_sql, turn_units
from arborspark.plans.registry import load, query

#: Gold: documents that hold the question's passage word for word; two alternative sets of them.
GOLD = """gold AS (SELECT b.item_id AS question, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
refs AS (SELECT question, 0 AS ref, doc_id FROM gold UNION ALL SELECT question, 1, doc_id FROM gold WHERE doc_id % 2 = 0)"""
DOCS = BM25 + ", found AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY min(rank)) AS place FROM ranked WHERE rank <= 64 GROUP BY question, doc_id)"


def _found(spark, sf):
    best = _bm25(spark, sf).groupBy("question", "doc_id").agg(F.min("rank").alias("r"))
    return best.select("question", "doc_id", F.row_number().over(Window.partitionBy("question").orderBy("r")).cast("bigint").alias("place"))


def _gold(spark, sf):
    """Which documents hold which passage. The questions are a stated set, held against all documents."""
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("passage"))
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return docs.join(items, F.contains("text", F.col("passage"))).select("question", "doc_id")


def _refs(spark, sf):
    g = _gold(spark, sf)
    return g.select("question", F.lit(0).alias("ref"), "doc_id").unionByName(g.where("doc_id % 2 = 0").select("question", F.lit(1).alias("ref"), "doc_id"))


@query(f"""WITH {DOCS}, {GOLD}, top AS (SELECT * FROM found WHERE place <= 5),
sizes AS (SELECT question, ref, count(DISTINCT doc_id) AS m FROM refs GROUP BY ALL),
hits AS (SELECT question, ref, count(*) AS h FROM refs JOIN top USING (question, doc_id) GROUP BY ALL),
n AS (SELECT question, count(*) AS n FROM top GROUP BY ALL),
pr AS (SELECT question, ref, m, coalesce(h, 0) AS h, CASE WHEN coalesce(n, 0) > 0 THEN coalesce(h, 0) / n ELSE 0.0 END AS p, coalesce(h, 0) / m AS r FROM sizes LEFT JOIN hits USING (question, ref) LEFT JOIN n USING (question))
SELECT question, round(max(p), 6) AS precision, round(max(r), 6) AS recall, round(max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1, max((h = m)::INT::DOUBLE) AS complete FROM pr GROUP BY question""")
def paragraph_metrics(spark, sf):
    return metrics.paragraph_metrics(_found(spark, sf), _refs(spark, sf), "question", "doc_id", "place")


@query(f"""WITH {DOCS}, {GOLD}, sizes AS (SELECT question, count(DISTINCT doc_id) AS m FROM gold GROUP BY ALL),
hits AS (SELECT question, min(place) AS first_hit, count(*) FILTER (place <= 3) AS h3 FROM found JOIN (SELECT DISTINCT * FROM gold) USING (question, doc_id) GROUP BY ALL)
SELECT question, first_hit, coalesce((first_hit = 1)::INT, 0) AS hit_1, round(coalesce(h3 / m, 0.0), 6) AS recall_3, round(coalesce(1 / first_hit, 0.0), 6) AS rr FROM sizes LEFT JOIN hits USING (question)""")
def reciprocal_ranks(spark, sf):
    return metrics.reciprocal_ranks(_found(spark, sf), _gold(spark, sf), "question", "doc_id", "place")


@query(f"""WITH RECURSIVE {TOPICS}, p AS (SELECT doc_id, paragraph FROM walk WHERE cut), g AS (SELECT doc_id, paragraph FROM turns WHERE paragraph > 0 AND paragraph % 3 = 0),
n AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.paragraph = g.paragraph)
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM n""")
def boundary_f1(spark, sf):
    units = turn_units(spark, sf)
    cuts = segment.anchor_drop(units, 0.95).where("cut").select("doc_id", "paragraph")
    return metrics.boundary_f1(cuts, units.where("paragraph > 0 and paragraph % 3 = 0"), ["doc_id", "paragraph"])


#: Scores of three methods for every order, by customer (cluster) and priority (dataset).
SCORES = """scores AS (SELECT o_orderkey AS id, o_custkey AS cluster, o_orderpriority AS dataset, 'm' || m AS method, ((o_orderkey * (m + 3)) % 97) / 96.0::DOUBLE AS score, CASE WHEN (o_orderkey + m) % 50 = 0 THEN 'failed' ELSE 'complete' END AS status
FROM orders, (SELECT unnest([0, 1, 2]) AS m))"""


def _scores(spark, sf):
    m = F.explode(F.array(*map(F.lit, range(3)))).alias("m")
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", m)
    k = F.col("o_orderkey")
    return rows.select(k.alias("id"), F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("m"), F.col("m")).alias("method"), (k * (F.col("m") + 3) % 97 / 96.0).alias("score"), F.when((k + F.col("m")) % 50 == 0, "failed").otherwise("complete").alias("status"))


@query(f"WITH {SCORES} SELECT dataset, method, round(avg(CASE WHEN status = 'complete' THEN score END), 6) AS mean, count(*) AS n, count(*) FILTER (status = 'failed') AS failed FROM scores GROUP BY ALL")
def method_summary(spark, sf):
    return _scores(spark, sf).groupBy("dataset", "method").agg(F.round(F.avg(F.when(F.col("status") == "complete", F.col("score"))), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))


@query(f"WITH {SCORES} SELECT dataset, method, round(median(score), 6) AS p50, round(quantile_disc(score, 0.95), 6) AS p95 FROM scores GROUP BY ALL")
def usage_percentiles(spark, sf):
    s = _scores(spark, sf)
    return s.groupBy("dataset", "method").agg(F.round(F.median("score"), 6).alias("p50"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score)"), 6).alias("p95"))


@query(f"""WITH {SCORES}, bad AS (SELECT DISTINCT id FROM scores WHERE status = 'failed')
SELECT dataset, method, round(avg(score), 6) AS mean, count(*) AS n FROM scores WHERE id NOT IN (SELECT id FROM bad) GROUP BY ALL""")
def common_denominator(spark, sf):
    s = _scores(spark, sf)
    good = s.join(s.where("status = 'failed'").select("id").distinct(), "id", "left_anti")
    return good.groupBy("dataset", "method").agg(F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORES}, means AS (SELECT dataset, method, avg(score) AS m FROM scores GROUP BY ALL), base AS (SELECT dataset, max(m) AS b FROM means WHERE method <> 'm2' GROUP BY ALL),
gains AS (SELECT method, avg(m - b) AS gain FROM means JOIN base USING (dataset) GROUP BY ALL)
SELECT method, round(gain, 6) AS mean_gain, row_number() OVER (ORDER BY round(gain, 9) DESC, method) AS rank FROM gains""")
def winner(spark, sf):
    means = _scores(spark, sf).groupBy("dataset", "method").agg(F.avg("score").alias("m"))
    base = means.where("method <> 'm2'").groupBy("dataset").agg(F.max("m").alias("b"))
    gains = means.join(base, "dataset").groupBy("method").agg(F.avg(F.col("m") - F.col("b")).alias("gain"))
    return gains.select("method", F.round("gain", 6).alias("mean_gain"), F.row_number().over(Window.orderBy(F.desc(F.round("gain", 9)), "method")).cast("bigint").alias("rank"))


@query(f"""WITH {SCORES}, means AS (SELECT dataset, method, avg(score) AS m FROM scores GROUP BY ALL),
signs AS (SELECT *, CASE WHEN method = 'm0' THEN -1 ELSE 1 END AS a, CASE WHEN method = 'm1' THEN -1 ELSE 1 END AS b FROM means)
SELECT dataset, round(sum(a * m) / 4, 6) AS effect_a, round(sum(b * m) / 4, 6) AS effect_b, round(sum(a * b * m) / 4, 6) AS effect_ab FROM signs GROUP BY dataset""")
def factor_effects(spark, sf):
    means = _scores(spark, sf).groupBy("dataset", "method").agg(F.avg("score").alias("m"))
    a, b = F.when(F.col("method") == "m0", -1).otherwise(1), F.when(F.col("method") == "m1", -1).otherwise(1)
    effect = lambda c, name: F.round(F.sum(c * F.col("m")) / 4, 6).alias(name)
    return means.groupBy("dataset").agg(effect(a, "effect_a"), effect(b, "effect_b"), effect(a * b, "effect_ab"))


DIFFS = SCORES + """, diffs AS (SELECT x.dataset, y.method AS other, x.cluster, x.score - y.score AS d FROM scores x JOIN scores y ON x.id = y.id AND x.method = 'm0' AND y.method <> 'm0')"""


def _diffs(spark, sf):
    s = _scores(spark, sf)
    x, y = s.where("method = 'm0'"), s.where("method <> 'm0'").select("id", F.col("method").alias("other"), F.col("score").alias("theirs"))
    return x.join(y, "id").select("dataset", "other", "cluster", (F.col("score") - F.col("theirs")).alias("d"))


SIGN = f"""WITH {DIFFS}, sums AS (SELECT dataset, other, cluster, sum(d) AS s, count(*) AS n FROM diffs GROUP BY ALL),
observed AS (SELECT dataset, other, sum(s) AS total, sum(n) AS n FROM sums GROUP BY ALL),
moved AS (SELECT dataset, other, draw, sum(s * CASE WHEN substr(sha256('7:' || draw || ':' || cluster), 1, 1) < '8' THEN 1 ELSE -1 END) AS t FROM sums, (SELECT unnest(range(1, 41)) AS draw) GROUP BY ALL),
tested AS (SELECT dataset, other, round(any_value(total) / any_value(n), 6) AS mean, round((count(*) FILTER (abs(t) >= abs(total) - 1e-9) + 1) / 41, 6) AS p FROM moved JOIN observed USING (dataset, other) GROUP BY ALL)"""


@query(SIGN + " SELECT * FROM tested")
def sign_test(spark, sf):
    return metrics.sign_test(_diffs(spark, sf), ["dataset", "other"], "cluster", "d", draws=40)


@query(SIGN + """, steps AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, dataset, other) + 1)) AS step FROM tested)
SELECT dataset, other, p, round(max(step) OVER (ORDER BY p, dataset, other ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM steps""")
def holm(spark, sf):
    tested = metrics.sign_test(_diffs(spark, sf), ["dataset", "other"], "cluster", "d", draws=40).withColumn("family", F.lit(0))
    return metrics.holm(tested, ["family"], "p", ["dataset", "other"]).select("dataset", "other", "p", "adjusted")


@query(f"""WITH {SCORES}, sums AS (SELECT dataset, method, cluster, sum(score) AS s, count(*) AS n FROM scores GROUP BY ALL),
drawn AS (SELECT *, CAST('0x' || substr(sha256('7:' || draw || ':' || cluster), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM sums, (SELECT unnest(range(1, 41)) AS draw)),
weighted AS (SELECT *, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 ELSE 3 END AS w FROM drawn),
means AS (SELECT dataset, method, draw, sum(w * s) / nullif(sum(w * n), 0) AS m FROM weighted GROUP BY ALL),
ends AS (SELECT dataset, method, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means GROUP BY ALL)
SELECT dataset, method, round(sum(s) / sum(n), 6) AS mean, any_value(low) AS low, any_value(high) AS high FROM sums JOIN ends USING (dataset, method) GROUP BY dataset, method""")
def bootstrap(spark, sf):
    return metrics.bootstrap(_scores(spark, sf), ["dataset", "method"], "cluster", "score", draws=40)


#: Draws that a report takes. The twins above have 40, from which no test of ten can be significant.
DRAWS = 10_000


@query()
def sign_test_10k(spark, sf):
    return metrics.sign_test(_diffs(spark, sf), ["dataset", "other"], "cluster", "d", draws=DRAWS)


@query()
def holm_10k(spark, sf):
    tested = sign_test_10k(spark, sf).withColumn("family", F.lit(0))
    return metrics.holm(tested, ["family"], "p", ["dataset", "other"]).select("dataset", "other", "p", "adjusted")


@query()
def bootstrap_10k(spark, sf):
    return metrics.bootstrap(_scores(spark, sf), ["dataset", "method"], "cluster", "score", draws=DRAWS, steps=metrics.POISSON)


WORDS_KEY = f"array_to_string({tokens_sql('text')}, ' ')"
DUPES = f"""keys AS (SELECT doc_id, sha256({WORDS_KEY}) AS a, CASE WHEN len({tokens_sql('text')}) >= 20 THEN sha256(array_to_string({tokens_sql('text')}[1:20], ' ')) END AS b FROM documents WHERE text IS NOT NULL),
edges AS (SELECT DISTINCT x.doc_id AS f, y.m AS t FROM keys x JOIN (SELECT a, min(doc_id) AS m FROM keys GROUP BY a) y USING (a) UNION SELECT DISTINCT x.doc_id, y.m FROM keys x JOIN (SELECT b, min(doc_id) AS m FROM keys WHERE b IS NOT NULL GROUP BY b) y USING (b)),
sym AS (SELECT f, t FROM edges UNION SELECT t, f FROM edges),
reach AS (SELECT doc_id AS src, doc_id AS node FROM keys UNION SELECT r.src, s.t FROM reach r JOIN sym s ON s.f = r.node),
grps AS (SELECT src AS doc_id, min(node) AS grp FROM reach GROUP BY src)"""


def _groups(spark, sf):
    w = T.tokens(F.col("text"))
    d = load(spark, sf, "documents").where("text is not null")
    keys = d.select("doc_id", F.sha2(F.array_join(w, " "), 256).alias("a"), F.when(F.size(w) >= 20, F.sha2(F.array_join(F.slice(w, 1, 20), " "), 256)).alias("b"))
    return splits.duplicate_groups(keys, "doc_id", ["a", "b"])


@query(f"WITH RECURSIVE {DUPES} SELECT doc_id, grp FROM grps")
def duplicate_groups(spark, sf):
    return _groups(spark, sf)


PARTITION = "CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'development' ELSE 'train' END"


@query(f"""WITH RECURSIVE {DUPES}, own AS (SELECT doc_id, grp, list_position(['train', 'development', 'test'], {PARTITION}) AS r FROM grps),
least_of AS (SELECT *, min(r) OVER (PARTITION BY grp) AS m FROM own)
SELECT doc_id, grp, ['train', 'development', 'test'][m] AS partition, m <> r AS moved FROM least_of""")
def split_registry(spark, sf):
    items = load(spark, sf, "documents").select("doc_id", F.expr(PARTITION).alias("partition"))
    return splits.registry(items, _groups(spark, sf), "doc_id", ["train", "development", "test"])


@query("""WITH ordered AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('split:' || doc_id), doc_id) AS place FROM documents) SELECT * FROM ordered WHERE place <= 100""")
def hash_sample(spark, sf):
    return splits.first_by_hash(load(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 100, "split")


@query("""WITH expected AS (SELECT c_custkey AS k, m FROM customer, (SELECT unnest([0, 1]) AS m)), actual AS (SELECT o_custkey AS k, CAST(o_orderkey % 3 AS INT) AS m FROM orders),
counts AS (SELECT k, m, count(*) AS n FROM actual GROUP BY ALL)
SELECT coalesce(e.k, c.k) AS k, coalesce(e.m, c.m) AS m, CASE WHEN c.n IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'duplicate' END AS issue
FROM expected e FULL JOIN counts c ON e.k = c.k AND e.m = c.m WHERE c.n IS NULL OR e.k IS NULL OR c.n > 1""")
def coverage(spark, sf):
    expected = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
    actual = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("m"))
    return splits.coverage(expected, actual, ["k", "m"])


GAP_SQL = r"[ \t\n\x0B\f\r]+"


@query(f"""WITH {UNITS}, evidence AS (SELECT doc_id, paragraph AS item, CASE paragraph % 3 WHEN 0 THEN text WHEN 1 THEN '  ' || replace(text, ' ', '  ') ELSE text || '?' END AS e FROM units),
loose AS (SELECT doc_id, trim(regexp_replace(text, '{GAP_SQL}', ' ', 'g')) AS k, count(*) AS n, min(paragraph) AS id FROM units GROUP BY ALL),
exact AS (SELECT doc_id, text AS k, count(*) AS n, min(paragraph) AS id FROM units GROUP BY ALL)
SELECT v.doc_id, item, CASE WHEN coalesce(x.n, l.n) = 1 THEN coalesce(x.id, l.id) END AS passage, CASE WHEN coalesce(x.n, l.n) IS NULL THEN 'unmatched' WHEN coalesce(x.n, l.n) > 1 THEN 'ambiguous' END AS issue
FROM evidence v LEFT JOIN exact x ON x.doc_id = v.doc_id AND x.k = v.e LEFT JOIN loose l ON l.doc_id = v.doc_id AND l.k = trim(regexp_replace(v.e, '{GAP_SQL}', ' ', 'g'))""")
def align_references(spark, sf):
    u = doc_units(spark, sf).select("doc_id", "paragraph", "text")
    p = F.col("paragraph")
    e = u.select("doc_id", p.alias("item"), F.when(p % 3 == 0, F.col("text")).when(p % 3 == 1, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(F.concat("text", F.lit("?"))).alias("text"))
    return splits.align(e, u, ["doc_id"], "text", "paragraph").select("doc_id", "item", "passage", "issue")


@query("""WITH r AS (SELECT l_orderkey % 500 AS question, l_partkey AS context, l_linenumber AS method, l_orderkey AS id FROM lineitem),
k AS (SELECT *, sha256(question || '|' || context) AS key FROM r)
SELECT key, count(*) AS n_uses, count(DISTINCT method) AS n_methods, min(id) AS first_id FROM k GROUP BY key""")
def request_dedupe(spark, sf):
    r = load(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("question"), F.col("l_partkey").alias("context"), F.col("l_linenumber").alias("method"), F.col("l_orderkey").alias("id"))
    return r.groupBy(F.sha2(F.concat_ws("|", "question", "context"), 256).alias("key")).agg(F.count(F.lit(1)).alias("n_uses"), F.count_distinct("method").alias("n_methods"), F.min("id").alias("first_id"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(median(value), 6) AS p50 FROM events GROUP BY event_type""")
def usage_rollup(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.median("value"), 6).alias("p50"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def inventory(spark, sf):
    return load(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


STAGE = "CASE WHEN l_tax > 0.06 THEN 'not_indexed' WHEN l_discount > 0.06 THEN 'not_retrieved' WHEN l_quantity > 40 THEN 'not_selected' WHEN l_returnflag = 'R' THEN 'misread' ELSE 'complete' END"


@query(f"SELECT {STAGE} AS stage, count(*) AS n FROM lineitem GROUP BY ALL")
def failure_stages(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.expr(STAGE).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORES}, c AS (SELECT id, method, sha256(CAST(id % 7 * CASE method WHEN 'm2' THEN 2 ELSE 1 END AS VARCHAR)) AS context FROM scores)
SELECT a.method AS one, b.method AS other, count(*) AS n, count(*) FILTER (a.context = b.context) AS same FROM c a JOIN c b ON a.id = b.id AND a.method < b.method GROUP BY ALL""")
def identical_contexts(spark, sf):
    s = _scores(spark, sf)
    c = s.select("id", "method", F.sha2((F.col("id") % 7 * F.when(F.col("method") == "m2", 2).otherwise(1)).cast("string"), 256).alias("context"))
    o = c.select("id", F.col("method").alias("other"), F.col("context").alias("theirs"))
    return c.join(o, "id").where("method < other").groupBy(F.col("method").alias("one"), "other").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("context") == F.col("theirs")).alias("same"))


@query("""WITH o AS (SELECT o_custkey AS q, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS full_order FROM orders GROUP BY ALL)
SELECT q, list_concat(full_order[1:2], list_filter(list_sort(full_order), lambda x: NOT list_contains(full_order[1:2], x))) AS repaired,
list_sort(full_order) = list_sort(list_distinct(full_order)) AS is_permutation FROM o""")
def ranking_repair(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))).alias("xs"))
    o = o.withColumn("full", F.transform("xs", lambda x: x["k"]))
    kept = F.slice("full", 1, 2)
    return o.select("q", F.concat(kept, F.array_except(F.array_sort("full"), kept)).alias("repaired"), (F.array_sort("full") == F.array_sort(F.array_distinct("full"))).alias("is_permutation"))


@query(f"""WITH RECURSIVE {TOPICS}, picks AS (SELECT doc_id, topic, min(paragraph) AS first, arg_max(paragraph, {{'l': length(text), 'p': -paragraph}}) AS longest FROM topics JOIN turns USING (doc_id, paragraph) GROUP BY ALL)
SELECT doc_id, count(*) AS n, count(*) FILTER (first = longest) AS agree FROM picks GROUP BY doc_id""")
def representative_agreement(spark, sf):
    units, topics = _topics(spark, sf)
    rows = topics.join(units.select("doc_id", "paragraph", "text"), ["doc_id", "paragraph"])
    picks = rows.groupBy("doc_id", "topic").agg(F.min("paragraph").alias("first"), F.max_by("paragraph", F.struct(F.length("text"), -F.col("paragraph"))).alias("longest"))
    return picks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == F.col("longest")).alias("agree"))
