"""Settings of the pipelines: strict, frozen, and the same on disk."""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segmentation:
    prior: float = 0.7
    cutoff: float = 0.5
    drop: float = 0.2
    sentence_budget: int | None = None
    sentence_stop: float | None = None

    def __post_init__(self) -> None:
        if not 0 < self.prior < 1:
            raise ValueError(f"prior is {self.prior}: it leaves no odds to shift, take a value inside (0, 1)")
        for name in ("cutoff", "drop", "sentence_stop"):
            v = getattr(self, name)
            if v is not None and not (math.isfinite(v) and 0 <= v <= 1):
                raise ValueError(f"{name} is {v}, which is no share")
        if self.sentence_budget is not None and self.sentence_budget < 2:
            raise ValueError(f"a sentence_budget of {self.sentence_budget} cannot see both ends of a paragraph")


@dataclass(frozen=True)
class Retrieval:
    candidates: int = 64
    top_k: int = 5
    beam: int = 2
    depth: int = 3
    fusion_k: int = 60
    budget_tokens: int = 2048

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if type(v) is not int or v < 1:
                raise ValueError(f"{f.name} is {v!r}, not a count of one or more")


@dataclass(frozen=True)
class Config:
    segmentation: Segmentation = Segmentation()
    retrieval: Retrieval = Retrieval()

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        parts = {"segmentation": Segmentation, "retrieval": Retrieval}
        for name, kind in [(k, parts.get(k)) for k in data]:
            if kind is None or not set(data[name]) <= {f.name for f in fields(kind)}:
                raise ValueError(f"unknown setting in {name!r}")
        return cls(**{k: parts[k](**v) for k, v in data.items()})

    def save(self, path: str) -> None:
        """Exclusive: a file that is there must hold the same settings."""
        write_once(path, json.dumps(asdict(self), indent=1, sort_keys=True))

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.from_dict(json.loads(Path(path).read_text()))


def write_once(path: str, text: str) -> None:
    """A JSON file that appears whole or not at all; one that is there must say the same."""
    at = Path(path)
    part = at.with_name(f".{at.name}.{os.getpid()}")
    part.write_text(text)
    try:
        os.link(part, at)
    except FileExistsError:
        if json.loads(at.read_text()) != json.loads(text):
            raise
    finally:
        part.unlink()


def grid_sample(spark: SparkSession, values: dict[str, list[int]], n: int, seed: str) -> DataFrame:
    """``n`` settings of the grid of all values, by the order of a digest, with their ``place``."""
    rows = spark.range(1)
    for name, options in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    rows = rows.drop("id").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws(",", *values)), 256))
    place = F.row_number().over(Window.orderBy("hash")).cast("bigint")  # as many rows as the grid has
    return rows.withColumn("place", place).where(F.col("place") <= n)
