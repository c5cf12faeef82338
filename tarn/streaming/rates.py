"""Running rates over an event stream: windowed counts with a watermark, late rows dropped after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as files arrive in a folder of Parquet files."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def running_rates(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """``start, event_type, n, mean_value, error_rate`` per window; works on streams and on tables alike."""
    w = F.window("ts", window)
    return (
        events.withWatermark("ts", late)
        .groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg((F.col("value") > 50).cast("double")).alias("high_rate"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "mean_value", "high_rate")
    )


def write_rates(rates: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet; exactly once, by the checkpoint and the file sink."""
    return rates.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
