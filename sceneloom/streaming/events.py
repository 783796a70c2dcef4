"""Event lines as a stream of rows: each file is taken once, runs resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sceneloom.sources.artifacts import event_of


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, event of the lines of text files, as they arrive; lines that are no event are left out."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return lines.select("file", event_of(F.col("value")).alias("event")).where("event.type IS NOT NULL")


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What has arrived is appended to a table, once; then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def handled(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
