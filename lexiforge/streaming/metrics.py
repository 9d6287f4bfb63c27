"""Running metrics of operations over a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events, sum and mean by operation and time window; events later than ``late`` are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.col("event_type").alias("operation"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
        .select(F.col("window.start").alias("start"), "operation", "n", "total", "mean")
    )


def start(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all available input to Parquet, once for each input row whatever fails in between."""
    return frame.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
