"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of the corpus at large the unlabelled ones;
no text is taken to be clean. A numpy classifier minimises the class-prior-corrected risk:
the prior times the positives' loss, plus the unlabelled loss as negatives less the prior
times the positives' loss as negatives, that difference held at zero from below.

The features are words and word beginnings, and whether they occur once, twice or four
times: those that tell positives from unlabelled texts best, chosen from all of the
sample's. The sample is bounded: ``positives`` confirmed ids and ``unlabelled`` ids, those
of the least hash. Scoring covers every whole text in one map pass.

How many features and how much decay are chosen by folds inside that sample, by a measure
that needs no clean text: the squared recall of confirmed texts over the share of unlabelled
ones that are called toxic. Rows kept out of the training fold have no part in it. The class
prior is the confirmed share of the labelled rows learned from, as labels are taken to cover
the corpus evenly; where they do not, it is to be given.

Defined results: a null text counts as empty, and a text without words has the score of
the bias alone; null labels are not learned from; with no confirmed toxic row every score
is 0; a null id is in no held-out fold; repeated rows give repeated rows; an empty table
gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import columns, fold_of, fresh, least_hashed, prepare, text_of, texts_of
from arborspark.llm.ngrams import word_prefixes

BITS, FEATURES = 20, 256
#: A feature counts once for each of these numbers of occurrences that a text reaches.
TIERS = (1, 2, 4)


def tiers(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([counts >= t for t in TIERS], axis=-1)


@dataclass
class Model:
    place: np.ndarray  # of each hashed feature: 0, or its number from 1
    weights: np.ndarray
    bias: float

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(FEATURES + 1, np.int64)
        for x in word_prefixes(text, BITS):
            total += np.bincount(self.place[x], minlength=FEATURES + 1)
        return total[1:]

    def score(self, text: str) -> float:
        m = float(self.weights[tiers(self.counts(text))].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``feature, n_pos, n_unl``: texts of either kind (``text, positive``) that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, positive in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                got = [*word_prefixes(text.as_py(), BITS)]
                if got:
                    n[0 if positive else 1, np.unique(np.concatenate(got))] += 1
        found = np.flatnonzero(n[0] + n[1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[0, found], pa.int64()), pa.array(n[1, found], pa.int64())], ["feature", "n_pos", "n_unl"])

    return texts.mapInArrow(run, "feature bigint, n_pos bigint, n_unl bigint").groupBy("feature").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_unl").alias("n_unl"))


def choose(frequencies: DataFrame, n_pos: int, n_unl: int) -> list[int]:
    """The features of the largest log-likelihood gain among those at least twice as common in positives."""
    p = (F.col("n_pos") + 0.5) / float(n_pos + 1)
    u = (F.col("n_unl") + 0.5) / float(n_unl + 1)
    gain = F.col("n_pos") * F.log(p / u)
    rows = frequencies.where((F.col("n_pos") >= 3) & (p > 2 * u)).withColumn("gain", F.round(gain, 9))
    return [r[0] for r in rows.orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 250, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss.

    Afterwards the bias is moved until the mean score of the unlabelled texts is the prior.
    """
    positive, unlabelled = positive.astype(np.float32), unlabelled.astype(np.float32)
    w, b = np.zeros(positive.shape[1], np.float32), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for k in range(1, rounds + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        p, u = logistic(zp), logistic(zu)
        if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
            up, uu = np.full(len(p), -prior / len(p), np.float32), u / len(u)
        else:  # the corrected loss of the unlabelled went below zero: step back along it
            up, uu = prior * p / len(p), -u / len(u)
        g = np.append(positive.T @ up + unlabelled.T @ uu + decay * w, up.sum() + uu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    z, low, high = unlabelled @ w, -40.0, 20.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (low, b) if logistic(z + b).mean() > prior else (b, high)
    return w, float(b)


def columns_of(features: int) -> np.ndarray:
    """The places of the first so many features among all tiers."""
    return np.concatenate([np.arange(features) + k * FEATURES for k in range(len(TIERS))])


def settle(x: dict[bool, np.ndarray], prior: float, settings: tuple[tuple[int, float], ...], folds: int, threshold: float) -> tuple[int, float]:
    """The setting of the best squared recall over called share, on folds of both kinds of texts; the first of equals."""
    best, chosen = -1.0, settings[0]
    for setting in settings if min(map(len, x.values())) >= folds else ():
        features, decay = setting
        cols = columns_of(features)
        recall, called = [], []
        for f in range(folds):
            inner = {k: np.arange(len(v)) % folds != f for k, v in x.items()}
            w, b = fit(x[True][inner[True]][:, cols], x[False][inner[False]][:, cols], prior, decay=decay)
            says = lambda k: x[k][~inner[k]][:, cols] @ w + b >= np.log(threshold / (1 - threshold))
            recall.append(says(True).mean())
            called.append(says(False).mean())
        value = float(np.mean(recall)) ** 2 / max(float(np.mean(called)), 1e-4)
        if value > best + 1e-9:
            best, chosen = value, setting
    return chosen


def train_model(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    positives: int = 2000,
    unlabelled: int = 6000,
    prior: float | None = None,
    settings: tuple[tuple[int, float], ...] = ((FEATURES, 5e-4), (FEATURES // 2, 5e-4), (FEATURES, 5e-3)),
    inner_folds: int = 2,
    threshold: float = 0.3,
) -> Model | None:
    """From ``docs(id, text)`` and ``labels(id, label)``; ``settings`` are numbers of features and decays to choose from."""
    spark = docs.sparkSession
    known = labels.where(train & F.col("label").isNotNull() & F.col("id").isNotNull())
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = prior or min(0.9, n_toxic / n_known)
    sampled = least_hashed(known.where("label = 1").select("id"), positives).withColumn("label", F.lit(True))
    sampled = sampled.unionByName(least_hashed(docs.where("id is not null").select("id"), unlabelled).withColumn("label", F.lit(False)))
    texts = texts_of(docs, sampled, "toxicity-sample").select("text", F.col("label").alias("positive"))
    n_pos, n_unl = texts.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_pos or not n_unl:
        return None
    chosen = choose(document_frequencies(texts), n_pos, n_unl)
    place = np.zeros(1 << BITS, np.uint16)
    place[chosen] = np.arange(1, len(chosen) + 1)
    bare = spark.sparkContext.broadcast(Model(place, np.zeros(0), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.minimum(bare.value.counts(t.as_py()), TIERS[-1]).astype(np.uint8).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["positive", "x"])

    got = texts.mapInArrow(run, "positive boolean, x binary").toArrow()
    rows = sorted(zip(got["positive"].to_pylist(), got["x"].to_pylist(), strict=True))
    x = {k: tiers(np.array([np.frombuffer(r, np.uint8) for q, r in rows if q == k])).astype(np.float32) for k in (True, False)}
    features, decay = settle({k: v[np.random.default_rng(42).permutation(len(v))] for k, v in x.items()}, prior, settings, inner_folds, threshold)
    cols, weights = columns_of(features), np.zeros(len(TIERS) * FEATURES, np.float32)
    weights[cols], b = fit(x[True][:, cols], x[False][:, cols], prior, decay=decay)
    return Model(place, weights, b)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_fold: int = 2, threshold: float = 0.3, **how) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document; labels of the held-out fold are not learned from."""
    prepare(df.sparkSession)
    out = with_scores(df.select(id_col, text_col), labels, id_col, text_col, label_col, folds, held_fold, threshold=threshold, **how)
    held = F.coalesce(fold_of(F.col("id"), folds) == held_fold, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_fold: int = 2, score_col: str | None = None, **how) -> DataFrame:
    """``id, score`` of every row, or all columns of ``df`` with the score as ``score_col``."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    model = spark.sparkContext.broadcast(train_model(docs, known, fold_of(F.col("id"), folds) != held_fold, **how))

    def scores(texts) -> pa.Array:
        return pa.array([model.value.score(t.as_py()) if model.value else 0.0 for t in texts], pa.float64())

    if score_col:
        # Columns go by number on the way, as their names may hold dots.
        at, safe = df.columns.index(text_col), [f"c{k}" for k in range(len(df.columns) + 1)]

        def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, scores(batch.column(at).fill_null(""))], safe)

        fields = [T.StructField(n, f.dataType) for n, f in zip(safe, df.schema.fields, strict=False)]
        return df.toDF(*safe[:-1]).mapInArrow(run_all, T.StructType([*fields, T.StructField(safe[-1], T.DoubleType())])).toDF(*df.columns, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), scores(batch.column(1))], ["id", "score"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double")


def drop_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows whose score is below the threshold, with their own columns."""
    (score,) = fresh(df, "toxicity_score")
    return with_scores(df, labels, threshold=threshold, score_col=score, **how).where(F.col(score) < threshold).select(columns(df.columns))
