"""Time windows over events, in batch and as a stream: an extension, nothing of the kind exists in what the engine replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total); with a watermark, windows close that long after their end."""
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def from_files(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends closed windows as Parquet, once each; ends when the input there is has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
