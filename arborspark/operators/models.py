"""Places for learned models: callbacks on batches, asked once for each distinct input.

A callback runs in the executors' Python workers on whole Arrow batches; what it needs is
loaded by ``load`` once for each worker. Each distinct input is asked about once, so equal
inputs have equal answers whatever batch they stand in. None is called to plan a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.sources.work import importable


def asked(rows: DataFrame, inputs: dict[str, Column], answer: Callable[[object, list[dict]], list[float]], out: str = "score", kind: str = "double", load: Callable[[], object] = lambda: None, batch: int = 256) -> DataFrame:
    """``rows`` with the answer for their inputs; ``answer(model, inputs)`` gives one value for each of at most ``batch`` inputs."""
    names = list(inputs)
    keyed = rows.withColumn("asked_key", F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in inputs.items()])), 256))
    once = rows.select(*[c.alias(n) for n, c in inputs.items()]).withColumn("asked_key", F.sha2(F.to_json(F.struct(*names)), 256)).dropDuplicates(["asked_key"])
    arrow = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            questions, keys, found = b.select(names).to_pylist(), b.column(len(names)), []
            for at in range(0, len(questions), batch):
                part = questions[at : at + batch]
                got = list(answer(model, part))
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} inputs, but {len(got)} answers")
                found += got
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, arrow)], ["asked_key", out])

    answers = importable(once).mapInArrow(run, f"asked_key string, {out} {kind}")
    return keyed.join(answers, "asked_key").drop("asked_key")


def checked(score: Column) -> Column:
    """A score that is finite and in [0, 1], or an error."""
    fine = score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= 1)
    return F.when(fine, score).otherwise(F.raise_error(F.concat(F.lit("not a score: "), F.coalesce(score.cast("string"), F.lit("null")))).cast("double"))


def pair_scores(pairs: DataFrame, left: str, right: str, score_many: Callable[[object, list[dict]], list[float]], **how) -> DataFrame:
    """Adds ``score`` of text pairs, for boundaries and representatives."""
    out = asked(pairs, {"left": F.col(left), "right": F.col(right)}, score_many, **how)
    return out.withColumn("score", checked(F.col("score")))


def reranked(cards: DataFrame, question: str, text: str, rerank: Callable[[object, list[dict]], list[float]], **how) -> DataFrame:
    """Adds ``relevance`` of cards to their question."""
    out = asked(cards, {"question": F.col(question), "text": F.col(text)}, rerank, out="relevance", **how)
    return out.withColumn("relevance", checked(F.col("relevance")))


def compared(pairs: DataFrame, question: str, one: str, other: str, compare: Callable[[object, list[dict]], list[float]], **how) -> DataFrame:
    """Adds ``p``: how surely one passage is better evidence than the other; each orientation is asked on its own."""
    out = asked(pairs, {"question": F.col(question), "one": F.col(one), "other": F.col(other)}, compare, out="p", **how)
    return out.withColumn("p", checked(F.col("p")))


def embedded(rows: DataFrame, text: str, embed: Callable[[object, list[dict]], list[list[float]]], dimensions: int, purpose: str = "document", **how) -> DataFrame:
    """Adds ``vector`` of unit length; a vector of other dimensions, or of zeros, is an error."""
    out = asked(rows, {"text": F.col(text), "purpose": F.lit(purpose)}, embed, out="vector", kind="array<double>", **how)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    good = (F.size("vector") == dimensions) & (norm > 0)
    return out.withColumn("vector", F.when(good, F.transform("vector", lambda x: x / norm)).otherwise(F.raise_error(F.lit("not a vector")).cast("array<double>")))


def yes(probability: Callable[[str], float]) -> Callable[[object, list[dict]], list[float]]:
    """A callback from a plain function of one text."""
    return lambda model, inputs: [float(probability(next(iter(i.values())))) for i in inputs]
