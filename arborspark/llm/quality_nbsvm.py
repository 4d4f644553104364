"""Quality scores by a linear model on naive-Bayes-scaled n-gram indicators.

N-gram indicators are scaled by the class log-count ratio of their n-gram; a linear model
with hinge loss is fitted to the scaled indicators by dual coordinate descent, and its
margin is turned into a probability on rows kept out of that fit.

The model is fitted on a bounded sample of labelled rows (``per_class`` ids of each class,
those of the least hash); scoring covers every whole text in one map pass without a shuffle.

Defined results: a null text counts as empty, and the empty text has the score of the
bias alone; rows without a label, or with a null one, are scored but not learned from; a
null id is in no held-out fold; with labels of one class only, every score is that class's
share; with none, 0.5; an id labelled twice alike counts once, and where it stands on
several texts the one of the least hash is learned from; repeated rows give repeated rows;
an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import fold_of, least_hashed, prepare, text_of, texts_of
from arborspark.llm.ngrams import indicators, shape_ngrams

BITS = 16


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, text: str, mark: np.ndarray) -> float:
        found = indicators(shape_ngrams(text, BITS), mark)
        return _logistic(self.slope * (float(self.weights[found].sum()) + self.bias) + self.offset)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1 + e)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the class-normalised, smoothed counts' quotient, by n-gram."""
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss; one dual variable a row, each within 0 and c by class share."""
    w, bias = np.zeros(len(scale)), 0.0
    share = {k: len(y) / (2 * max(1, int((y == k).sum()))) for k in (-1, 1)}
    values = [scale[x] for x in rows]
    norms = [float(v @ v) + 1 for v in values]
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v, t = rows[i], values[i], y[i]
            slack = t * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), c * share[int(t)])
            if step := (new - alpha[i]) * t:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, r = p - target, p * (1 - p) + 1e-9
        ga, gb = float(g @ margins) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float(r @ (margins * margins)) + 1e-3, float(r @ margins), float(r.sum())
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: list[int], c: float = 0.05, epochs: int = 12, seed: int = 42) -> Model:
    y = np.where(np.array(labels, np.int64) > 0, 1, -1)
    if not len(y) or len(set(y)) < 2:
        share = 0.5 if not len(y) else float(np.clip((y > 0).mean(), 0.01, 0.99))
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, math.log(share / (1 - share)))
    out = np.arange(len(y)) % 5 == 4
    if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
        out = np.zeros(len(y), bool)
    inside, outside = np.flatnonzero(~out), np.flatnonzero(out)
    ratio = log_count_ratio([rows[i] for i in inside], y[inside])
    w, bias = dual_descent([rows[i] for i in inside], y[inside], ratio, c, epochs, seed)
    w = w * ratio
    held = outside if len(outside) else inside
    slope, offset = calibrate(np.array([w[rows[i]].sum() + bias for i in held]), y[held])
    return Model(w.astype(np.float32), float(bias), slope, offset)


def sample_of(docs: DataFrame, labels: DataFrame, per_class: int, train: F.Column = None) -> DataFrame:
    """``id, text, label`` of at most so many ids of each label, written down."""
    wanted = labels.where("label in (0, 1) and id is not null" if train is None else train & F.expr("label in (0, 1) and id is not null"))
    parts = [least_hashed(wanted.where(F.col("label") == k).select("id", "label"), per_class) for k in (0, 1)]
    return texts_of(docs, parts[0].unionByName(parts[1]), "quality-sample")


def train_model(docs: DataFrame, labels: DataFrame, per_class: int = 2500, train: F.Column = None) -> Model:
    """From ``docs(id, text)`` and ``labels(id, label)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            found = [indicators(shape_ngrams(t.as_py(), BITS), mark).astype(np.uint16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "label", "x"])

    kind = docs.schema["id"].dataType.simpleString()
    got = sample_of(docs, labels, per_class, train).mapInArrow(run, f"id {kind}, label int, x binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (str(got["id"][i]), got["label"][i].as_py()))
    return fit([np.frombuffer(got["x"][i].as_py(), np.uint16).astype(np.int64) for i in order], [got["label"][i].as_py() for i in order])


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = 0.3, per_class: int = 2500) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document; labels of the held-out fold are not learned from."""
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    model = spark.sparkContext.broadcast(train_model(docs, known, per_class, fold_of(F.col("id"), folds) != held_fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            scores = [model.value.score(t.as_py(), mark) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    out = docs.mapInArrow(run, f"id {kind}, score double")
    held = F.coalesce(fold_of(F.col("id"), folds) == held_fold, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
