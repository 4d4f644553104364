"""The queries of this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborspark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.bpe_stream import encode_digests

    return encode_digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.quality_nbsvm import score_quality

    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.quality_rules import judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.secret_scan import scan_query

    return scan_query(read(spark, sf_dir, "documents"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.pii import find_query

    return find_query(read(spark, sf_dir, "documents"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(read(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.simhash_dedup import near_groups

    return near_groups(read(spark, sf_dir, "documents"))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.llm.mixing import mixing_query

    return mixing_query(read(spark, sf_dir, "documents"))


SQL["op8_source_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS draw_key
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
goal AS (SELECT least(sum(source_size) * 1.5, sum(source_size) * 2.0) AS total FROM sources),
-- each round deals what is left among the sources not yet at their cap, by weight
rounds AS (
  SELECT 0 AS round, list({'source': source, 'cap': source_size * 2.0, 'weight': weight, 'full': false}) AS state, max(total) AS remaining
  FROM sources, goal
  UNION ALL
  SELECT round + 1,
         list_transform(state, lambda s: {'source': s['source'], 'cap': s['cap'], 'weight': s['weight'],
           'full': s['full'] OR s['cap'] < remaining / list_sum(list_transform(list_filter(state, lambda o: NOT o['full']), lambda o: o['weight'])) * s['weight']}),
         remaining - list_sum(list_transform(list_filter(state, lambda s: NOT s['full'] AND
           s['cap'] < remaining / list_sum(list_transform(list_filter(state, lambda o: NOT o['full']), lambda o: o['weight'])) * s['weight']), lambda s: s['cap']))
  FROM rounds
  WHERE len(list_filter(state, lambda s: NOT s['full'] AND
           s['cap'] < remaining / list_sum(list_transform(list_filter(state, lambda o: NOT o['full']), lambda o: o['weight'])) * s['weight'])) > 0),
settled AS (
  SELECT remaining / list_sum(list_transform(list_filter(state, lambda o: NOT o['full']), lambda o: o['weight'])) AS level FROM rounds ORDER BY round DESC LIMIT 1),
targets AS (SELECT source, source_size, least(source_size * 2.0, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM sources, settled)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             CAST(('0x' || substr(md5(draw_key || ':42'), 1, 12)) AS BIGINT) / 281474976710656.0 AS draw
      FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
"""


def _secret_sql() -> str:
    from arborspark.llm import secret_scan as s

    patterns = [s.ASSIGN, s.ACCESS, s.HEX, *[p for p, _ in s.MORE.values()]]
    quoted = [p.replace("'", "''") for p in patterns]
    rules = ", ".join(f"({k}, '{name}', '{p}')" for k, (name, p) in enumerate(zip(s.KINDS, quoted, strict=True)))
    count = lambda k: f"count(*) FILTER (k = {k}) AS n_{s.KINDS[k]}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
rules(k, kind, pattern) AS (VALUES {rules}),
cut AS (SELECT rid, k, kind, string_split_regex(regexp_replace(t, pattern, chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]') AS pieces FROM d, rules WHERE regexp_matches(t, pattern)),
p AS (SELECT rid, k, kind, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM cut),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY rid, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM p),
found AS (SELECT rid, k, kind, b, b + length(piece) AS e FROM placed WHERE i % 2 = 1 AND (k <> 0 OR length(regexp_extract(piece, '{quoted[0]}', 2)) >= 6))
SELECT doc_id, {count(0)}, {count(1)}, {count(2)},
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e), '') AS spans
FROM d LEFT JOIN found USING (rid) GROUP BY rid, doc_id"""


SQL["op4_secret_scan"] = _secret_sql()
