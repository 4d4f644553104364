"""Sources and sinks: whole texts, JSON lines, index bundles, append-only logs, vector caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HINTS = "start long, end long, title string, level int, origin string, source_ref string, page int"
PARTS = ("units", "nodes", "decisions")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (the path), ``text``: one row for each file, line ends as they are."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows are cut at ``\\n`` only, as other line marks may stand in a string; gzip files are read as they are."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def heading_hints(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, HINTS)


def write_index(parts: dict[str, DataFrame], path: str, docs: DataFrame | None = None, config: str | None = None) -> None:
    """Each table of an index as Parquet under one folder; an existing one is an error.

    With ``docs`` (``doc_id, text``) the bundle holds the source too, with the digest of
    each text; with ``config``, a JSON text, the settings it was made with.
    """
    for name, df in parts.items():
        if name not in PARTS:
            raise ValueError(f"unknown table {name!r}")
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    if docs is not None:
        docs.select("doc_id", "text", F.sha2("text", 256).alias("sha")).write.mode("errorifexists").parquet(f"{path}/docs")
        if config is not None:
            docs.sparkSession.createDataFrame([(2, config)], "schema_version int, config string").coalesce(1).write.mode("errorifexists").json(f"{path}/settings")


def read_index(spark: SparkSession, path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of an index; with ``check``, its violation counts must all be 0."""
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in PARTS}
    if check is not None and not check(parts["nodes"]).where("n > 0").isEmpty():
        raise ValueError(f"the index at {path} is not sound")
    return parts


def read_bundle(spark: SparkSession, path: str, parts: tuple[str, ...] = ("nodes",)) -> tuple[dict[str, DataFrame], DataFrame, str | None]:
    """``(tables, docs, config)`` of a bundle whose texts, ids and spans agree; anything else is an error."""
    from arborspark.operators import checks

    docs, tables = spark.read.parquet(f"{path}/docs"), {n: spark.read.parquet(f"{path}/{n}") for n in parts}
    issues = checks.index_issues(tables["nodes"], docs, sha="sha").first()
    if issues is not None:
        raise ValueError(f"the bundle at {path} is not sound: {issues['rule']} in {issues['doc_id']}")
    said = spark.read.schema("schema_version int, config string").json(f"{path}/settings").first()
    if said is None or said["schema_version"] not in (1, 2):
        raise ValueError("a bundle of an unknown version")
    return tables, docs, said["config"]


def append_log(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("append").option("compression", compression).json(path)


def with_vectors(texts: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame], cache: str, model: str, dims: int) -> DataFrame:
    """Adds ``embedding`` from a cache keyed by model, size and text; each missing text is embedded once and appended.

    ``embed`` takes ``key, text`` and returns ``key, embedding``.
    """
    spark = texts.sparkSession
    schema = "key string, embedding array<double>"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    keyed = texts.withColumn("__key", F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(dims)), text), 256))
    wanted = keyed.groupBy(F.col("__key").alias("key")).agg(F.first(text).alias("text"))
    missing = wanted.join(spark.read.schema(schema).parquet(cache), "key", "left_anti")
    embed(missing).select("key", "embedding").write.mode("append").parquet(cache)
    known = spark.read.schema(schema).parquet(cache).withColumnRenamed("key", "__key").dropDuplicates(["__key"])
    return keyed.join(known, "__key", "left").drop("__key")


def qasper_paragraphs(papers: DataFrame) -> DataFrame:
    """``paper_id, section, paragraph, heading, text`` of nested papers (``id, title, abstract, full_text``); the abstract is section 0."""
    first = F.array(F.struct(F.lit("Abstract").alias("section_name"), F.array("abstract").alias("paragraphs")))
    body = F.transform("full_text", lambda s: F.struct(F.coalesce(s["section_name"], F.lit("")).alias("section_name"), s["paragraphs"].alias("paragraphs")))
    rows = papers.select(F.col("id").alias("paper_id"), F.posexplode(F.concat(first, body)).alias("section", "s"))
    rows = rows.select("paper_id", "section", F.col("s.section_name").alias("heading"), F.posexplode("s.paragraphs").alias("paragraph", "text"))
    return rows.where(F.btrim("text") != "").select("paper_id", "section", "paragraph", "heading", "text")


def answerability(answers: DataFrame) -> DataFrame:
    """``question_id, kind`` from ``question_id, unanswerable`` (one row for each answer)."""
    every, some = F.bool_and("unanswerable"), F.bool_or("unanswerable")
    return answers.groupBy("question_id").agg(F.when(every, "unanswerable").when(some, "mixed").otherwise("answerable").alias("kind"))
