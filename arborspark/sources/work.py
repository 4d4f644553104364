"""Work tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[2])


def importable(df: DataFrame) -> DataFrame:
    """``df``; Python workers of its session can import this package from where the driver has it."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return df


def checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder of ``spark.checkpoint.dir``; a local session without one gets a folder of the process.

    On a cluster the setting is needed, as executors do not share local folders.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    at, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not at and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set: checkpoints need a folder that all executors of {master} share")
    if not at:
        at = tempfile.mkdtemp(prefix="arborspark-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)


def written(df: DataFrame) -> DataFrame:
    """``df`` written down once, for plans that read it several times; a lost executor costs no recomputation of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
