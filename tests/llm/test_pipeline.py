"""The pipeline's stages on a small table, each against what it was given."""

import collections

import corpus_pipeline
import __spark_entry__ as entry
from arborspark.llm import bpe_stream, simhash_dedup, toxicity
from arborspark.llm.common import table
from arborspark.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    clean = table(stages["toxicity"](spark, docs, SF), "t")
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).collect() if r["predicted"]}
    assert clean.columns == names
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - toxic

    single = table(stages["simhash near-dedup"](spark, clean, SF), "t")
    assert single.columns == names
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in simhash_dedup.near_groups(clean).collect()}

    safe = table(stages["secret scan"](spark, single, SF), "t")
    assert safe.columns == names and safe.count() == single.count()
    assert safe.where("n_chars <> length(text)").count() == 0

    mixed = table(stages["source mixing"](spark, safe, SF), "t")
    assert mixed.columns == names
    assert max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2

    ids = stages["bpe"](spark, mixed, SF)
    own = bpe_stream.encode_digests(mixed, vocabulary("word_bpe_49k.json"))
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, own.collect()))


def test_all_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


def test_the_whole_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty, blank and repeated rows, clashing column names; against the stages' own rules in plain Python."""
    junk = "clown " * 30
    rows = [(k, f"plain words number {k} " + " ".join(f"w{k}x{j}" for j in range(30)), "en", "ab"[k % 2], 0, "x", "y") for k in range(40)]
    rows += [(100 + k, f"{junk} t{k}", "en", "a", 0, "x", "y") for k in range(30)]
    rows += [(200, None, "en", "a", 7, "x", "y"), (201, "", None, None, 0, "x", "y"), (202, " \t\n", "en", "a", 3, "x", "y"), (None, "no id " + "here " * 20, "en", "c", 0, None, None)]
    rows += [(300, rows[3][1], "en", "a", 0, "x", "y"), (300, rows[3][1], "en", "a", 0, "x", "y"), (301, 'token = "0123456789abcdef0123" ' + " ".join(f"s{j}" for j in range(30)), "en", "b", 0, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string, mix_copy string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + k, 0, 1) for k in range(30)] + [(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    staged = docs
    for name in ("toxicity", "simhash near-dedup", "secret scan"):
        staged = table(dict(corpus_pipeline.STAGES)[name](spark, staged, str(tmp_path)), "t")
    safe = {r["doc_id"]: r["text"] for r in staged.collect()}
    assert set(safe) == set(range(40)) | {200, None, 301} and staged.count() == 43 and staged.columns == docs.columns
    assert safe[200] is None and safe[301].startswith("[SECRET]") and all(safe[k] == rows[k][1] for k in range(40))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= set(safe)
    counts = collections.Counter(r["doc_id"] for r in got)
    assert max(counts.values()) <= 2
    lib = bpe_stream.WordBPE(vocabulary("word_bpe_49k.json"))
    assert all(r["n_tokens"] == len(lib.encode(safe[r["doc_id"]] or "")) for r in got)


def test_an_empty_table_goes_through(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
