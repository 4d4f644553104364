"""Evaluation workflow: registrations that are bound once, runs told again, results published.

A registration is a JSON file that appears whole or not at all; a second one must say the
same. What a run reports is never trusted: winners come from the scores again.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.plans.config import write_once


def signature(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def table_signature(df: DataFrame) -> str:
    """A digest of a table's rows in any order, from two sums of row hashes and the count."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    other = F.xxhash64(F.lit(1), *[F.col(c) for c in sorted(df.columns)])
    got = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)"))).first()
    return signature([sorted(df.columns), *map(str, got)])


class Gate:
    """A folder in which a registration is made, an allocation opened and a winner frozen, each once and in this order."""

    ORDER = ("registered", "opened", "frozen")

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _file(self, step: str) -> Path:
        return self.folder / f"{step}.json"

    def said(self, step: str) -> dict | None:
        return json.loads(self._file(step).read_text()) if self._file(step).exists() else None

    def _say(self, step: str, record: dict) -> dict:
        for later in self.ORDER[self.ORDER.index(step) + 1 :]:
            if self._file(later).exists() and self.said(step) != record:
                raise ValueError(f"the allocation is already {later}")
        write_once(str(self._file(step)), json.dumps(record, sort_keys=True, indent=1))
        return record

    def register(self, candidates: dict[str, dict], baselines: dict[str, dict], items: DataFrame, most: int = 3, **fixed) -> dict:
        """Binds one to ``most`` different candidates, the baselines and the items before any score is seen."""
        if not 1 <= len(candidates) <= most or len({signature(c) for c in candidates.values()}) < len(candidates):
            raise ValueError(f"one to {most} different candidates are to be registered")
        if not baselines or set(candidates) & set(baselines):
            raise ValueError("candidates are held against baselines of other names")
        return self._say("registered", {"candidates": candidates, "baselines": baselines, "items": table_signature(items), "fixed": fixed})

    def open(self, items: DataFrame) -> dict:
        """Opens the allocation for the registered items; changed items are an error."""
        told = self.said("registered")
        if told is None:
            raise ValueError("nothing is registered")
        if told["items"] != table_signature(items):
            raise ValueError("the items are not those of the registration")
        return self._say("opened", {"registration": signature(told)})

    def freeze(self, scores: DataFrame, metric: str = "score") -> dict:
        """Freezes the winner that the scores (``id, method``, the metric) give: every method on every item, then the best mean."""
        told, opened = self.said("registered"), self.said("opened")
        if told is None or opened is None or opened["registration"] != signature(told):
            raise ValueError("the allocation was not opened for this registration")
        methods = {*told["candidates"], *told["baselines"]}
        found = {r[0] for r in scores.select("method").distinct().limit(len(methods) + 1).collect()}
        gaps = scores.groupBy("id").agg(F.count_distinct("method").alias("n"), F.count(F.lit(1)).alias("rows")).where((F.col("n") != len(methods)) | (F.col("rows") != len(methods)))
        if found != methods or not gaps.isEmpty():
            raise ValueError("not every registered method has one score on every item")
        best = winner(scores, list(told["candidates"]), metric)
        return self._say("frozen", {"winner": best["method"], "mean": round(best["mean"], 9), "scores": table_signature(scores), "registration": signature(told)})

    def verify(self, scores: DataFrame, metric: str = "score") -> bool:
        """Whether the frozen winner is the one that these scores give."""
        frozen, told = self.said("frozen"), self.said("registered")
        if frozen is None or told is None:
            return False
        best = winner(scores, list(told["candidates"]), metric)
        return frozen == {"winner": best["method"], "mean": round(best["mean"], 9), "scores": table_signature(scores), "registration": signature(told)}


def winner(scores: DataFrame, candidates: list[str], metric: str) -> dict:
    means = scores.where(F.col("method").isin(candidates)).groupBy("method").agg(F.avg(F.coalesce(metric, F.lit(0.0))).alias("mean"))
    return means.orderBy(F.desc(F.round("mean", 9)), "method").first().asDict()


def replay(given: DataFrame, again: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``keys, value, given, again`` where an archived number and the one made again differ by more than the tolerance, or one is missing."""
    long = lambda rows, name: rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias(name)) for v in values])).alias("x")).select(*keys, "x.*")
    a, b = long(given, "given").withColumn("has_given", F.lit(True)), long(again, "again").withColumn("has_again", F.lit(True))
    both = a.join(b, [*keys, "value"], "full")
    same = F.col("has_given").isNotNull() & F.col("has_again").isNotNull() & (F.col("given").eqNullSafe(F.col("again")) | F.coalesce(F.abs(F.col("given") - F.col("again")) <= tolerance, F.lit(False)))
    return both.where(~same).select(*keys, "value", "given", "again")


def published(runs: dict[str, DataFrame], names: dict[str, str], path: str, keys: tuple[str, ...] = ("id", "method")) -> DataFrame:
    """Writes the union of runs, methods under their public names, as gzip JSON lines; gives ``file, length, sha256`` of what was written.

    Every public method must have the same items, each once.
    """
    rows = None
    for df in runs.values():
        rows = df if rows is None else rows.unionByName(df)
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = rows.where(F.col("method").isin(list(names))).withColumn("method", F.element_at(labels, F.col("method")))
    per = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("m"))
    sizes = per.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("m"), F.max("m")).first()
    items = rows.select("id").distinct().count()
    if tuple(sizes) != (len(set(names.values())), items, items, items, items):
        raise ValueError("methods do not cover the same items")
    rows.repartitionByRange(max(1, len(names)), *keys).sortWithinPartitions(*keys).write.mode("errorifexists").option("compression", "gzip").json(path)
    files = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def shared_predictions(requests: DataFrame, parts: list[str], item: str = "id") -> tuple[DataFrame, DataFrame]:
    """``(asked, uses)``: requests with equal ``parts`` are asked once, by a key; every use keeps its own row."""
    uses = requests.withColumn("request_key", F.sha2(F.to_json(F.struct(*parts)), 256))
    first = Window.partitionBy("request_key").orderBy(item)
    asked = uses.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("request_key", *parts)
    return asked, uses
