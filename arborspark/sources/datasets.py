"""Shapes of the evaluation data sets: nested papers, articles with multiple-choice questions, long contexts, gold document lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.sources.tables import answerability, json_array, json_lines

PAPERS = (
    "id string, title string, abstract string, full_text array<struct<section_name:string,paragraphs:array<string>>>, "
    "qas array<struct<question_id:string,question:string,answers:array<struct<answer:struct<unanswerable:boolean,free_form_answer:string,extractive_spans:array<string>,yes_no:boolean,evidence:array<string>>>>>>"
)
ARTICLES = "article_id string, title string, article string, questions array<struct<question_unique_id:string,question:string,options:array<string>,gold_label:int,difficult:int>>"
CONTEXTS = "_id string, context string, question string, domain string, difficulty string, length string"
#: What figures and tables leave in a list of evidence, a fixed value.
FLOAT_MARK = "FLOAT SELECTED"


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers as rows; a file may be one JSON object that maps ids to papers, or JSON lines."""
    raw = spark.read.text(path, wholetext=True).select("value")
    body = PAPERS.removeprefix("id string, ")
    keyed = raw.select(F.explode(F.from_json("value", f"map<string, struct<{_as_struct(body)}>>")).alias("id", "p")).select("id", "p.*")
    whole = keyed.where("full_text is not null")
    return whole if not whole.isEmpty() else json_lines(spark, path, PAPERS)


def _as_struct(fields: str) -> str:
    """``a string, b array<...>`` with colons, as a struct type has it."""
    out, depth = [], 0
    for word in fields.replace(", ", ",").split(","):
        depth_before = depth
        depth += word.count("<") - word.count(">")
        out.append(word.replace(" ", ":", 1) if depth_before == 0 else word)
    return ",".join(out)


def questions(rows: DataFrame) -> DataFrame:
    """``question_id, paper_id, question, kind, n_answers`` of papers: unanswerable by all, by some, or by none of the annotations."""
    asked = rows.select(F.col("id").alias("paper_id"), F.explode("qas").alias("q")).select("paper_id", "q.question_id", "q.question", "q.answers")
    answers = asked.select("question_id", F.explode_outer("answers").alias("a")).select("question_id", F.coalesce("a.answer.unanswerable", F.lit(False)).alias("unanswerable"))
    return asked.select("question_id", "paper_id", "question", F.size("answers").cast("bigint").alias("n_answers")).join(answerability(answers), "question_id")


def evidence(rows: DataFrame) -> DataFrame:
    """``question_id, paper_id, ref, place, text, is_float`` of the answers' evidence; figures and tables are marked."""
    asked = rows.select(F.col("id").alias("paper_id"), F.explode("qas").alias("q"))
    refs = asked.select("paper_id", "q.question_id", F.posexplode("q.answers").alias("ref", "a"))
    texts = refs.select("question_id", "paper_id", "ref", F.posexplode("a.answer.evidence").alias("place", "text"))
    return texts.withColumn("is_float", F.startswith("text", F.lit(FLOAT_MARK)))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, article_id, question, options, label, hard`` of JSON lines; an article under two texts is an error."""
    rows = json_lines(spark, path, ARTICLES)
    twice = rows.groupBy("article_id").agg(F.count_distinct("article").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"article {twice.first()['article_id']} has different texts")
    asked = rows.select("article_id", F.explode("questions").alias("q"))
    return asked.select(F.col("q.question_unique_id").alias("question_id"), "article_id", "q.question", "q.options", F.col("q.gold_label").alias("label"), (F.col("q.difficult") == 1).alias("hard"))


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, cluster, question, domain, difficulty, length, context`` of a JSON array; equal contexts share a cluster."""
    rows = json_array(spark, path, CONTEXTS)
    return rows.select(F.col("_id").alias("question_id"), F.sha2("context", 256).alias("cluster"), "question", "domain", "difficulty", "length", "context")
