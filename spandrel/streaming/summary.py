"""Windowed counts of an event stream, with the same transformation for a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """``(start, event_type, n)`` per hour.  ``late``: how long a stream waits for rows that come late."""
    stamped = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    if late:
        stamped = stamped.withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events with no pause of ``gap`` or longer."""
    stamped = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    if late:
        stamped = stamped.withWatermark("_ts", late)
    return stamped.groupBy(F.session_window("_ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(result: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Writes a streaming result as Parquet, exactly once, until all that is there has been read."""
    return result.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
