"""What the operators of this subpackage share: work tables, worker paths, column picks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: The words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session, which has one machine only, may do without: it gets a folder of the
    process. Any other session without the setting is an error, as executors would not see
    each other's files.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set: work tables need a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="arborspark-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/arborspark-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs no recomputation of what ran before.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have: these, with as many underscores behind as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(names: list[str]) -> list[Column]:
    """Columns by their very names, dots and blanks in them included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def least_hashed(rows: DataFrame, n: int) -> DataFrame:
    """Of the distinct ``rows``, the n of the least hash of ``id`` (all, if there are fewer).

    A hash threshold is set first so that about 2n distinct rows pass, and only these are
    put in order: one task gets about 2n rows, whatever the table's size. Where repeated
    ids let too few pass, the threshold is raised.
    """
    total, share = rows.count(), 2.0 * n
    while total:
        part = rows if share >= total else rows.where(F.xxhash64("id") < int(-(2**63) + 2**64 * (share / total)))
        part = part.distinct()
        if share >= total or part.count() >= n:
            return part.orderBy(F.xxhash64("id"), *rows.columns).limit(n)
        share *= 4
    return rows


def texts_of(docs: DataFrame, sample: DataFrame, name: str) -> DataFrame:
    """``docs(id, text)`` with the columns of a bounded ``sample(id, label)``, one row for each row of it, written down.

    An id on several rows has the text of the least hash, so that the table is bounded by
    the sample; its rows are folded before the shuffle.
    """
    rows = docs.join(F.broadcast(sample.withColumnRenamed("id", "sample_id")), F.col("id") == F.col("sample_id"))
    least = F.min(F.struct(F.xxhash64("text").alias("mark"), F.col("text"))).alias("least")
    once = rows.groupBy("id", "label").agg(least).select("id", "least.text", "label")
    return table(once.repartition(partitions(docs.sparkSession), "id"), name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """A text column with null taken as the empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``: null ids belong to no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
