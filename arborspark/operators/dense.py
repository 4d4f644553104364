"""Exact dense search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.vectors import dot
from arborspark.sources.work import importable

#: Query vectors sent to the executors at once, and the tile of queries by rows whose scores are held at once: 8 MB.
BLOCK, QUERIES, ROWS = 4096, 512, 2048


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each row, ties by the lesser id, with their ids; both sorted."""
    if scores.shape[1] <= k:
        order = np.lexsort((ids, -scores), axis=1)
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(scores >= least)  # the k-th best score and what ties with it
    s, i = scores[row, col], ids[row, col]
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    kept = nth < k
    return s[kept].reshape(-1, k), i[kept].reshape(-1, k)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 10, itself: bool = False) -> DataFrame:
    """``query_id, id_col, score, rank``: the k most similar unit vectors, score (cosine + 1) / 2.

    All rows against the stated queries, in blocks of queries of fixed size: each block goes
    to the executors, every task keeps its k best of each query and hands them on at its
    end, and the rest is one small sort.
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col(id_col).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-numbered.count() // BLOCK))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = None
    for block in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast((part["q"].to_numpy(), np.array(part["v"].to_pylist(), np.float64)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best = [(np.full((len(ids[a : a + QUERIES]), k), -1.0), np.full((len(ids[a : a + QUERIES]), k), np.iinfo(np.int64).max)) for a in range(0, len(ids), QUERIES)]
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, ROWS):
                    own = batch.column(0).slice(at, ROWS).to_numpy()
                    v = np.array(batch.column(1).slice(at, ROWS).to_pylist(), np.float64).T
                    for n, a in enumerate(range(0, len(ids), QUERIES)):
                        s = np.round(np.clip((q[a : a + QUERIES] @ v + 1) / 2, 0, 1), 6)
                        if not itself:
                            s[ids[a : a + QUERIES, None] == own[None, :]] = -1
                        best[n] = best_of(np.hstack((best[n][0], s)), np.hstack((best[n][1], np.broadcast_to(own, s.shape))), k)
            if best:
                s, i = np.vstack([b[0] for b in best]).ravel(), np.vstack([b[1] for b in best]).ravel()
                keep = s >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[keep]), pa.array(i[keep]), pa.array(s[keep])], ["query_id", "id", "score"])

        found = importable(rows).mapInArrow(run, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(id_col), "score", "rank")


def adjacent(vectors: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    by = Window.partitionBy(group).orderBy(order)
    v = F.col(vector).cast("array<double>")
    return vectors.select(group, order, dot(v, F.lag(v).over(by)).alias("similarity"))
