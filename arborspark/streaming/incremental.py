"""Units of documents that keep arriving: new files are parsed once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from arborspark.operators.parse import line_units, sentences


def index_new_documents(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files under ``source`` and appends ``units`` and ``sentences`` under ``out``.

    A batch overwrites its own folder, so one that is run again after a failure leaves no
    second copy. Ends when all that is there has been read.
    """

    def add(batch: DataFrame, number: int) -> None:
        units = line_units(batch)
        units.write.mode("overwrite").parquet(f"{out}/units/batch={number}")
        sentences(units, ["doc_id", "paragraph"]).write.mode("overwrite").parquet(f"{out}/sentences/batch={number}")

    arriving = spark.readStream.schema(schema).parquet(source)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
