"""Token counts kept up to date over a stream of files (an extension of the batch operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(like.schema).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: Column, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n in tumbling windows; rows later than the watermark are dropped by the engine."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def run_once(counts: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> None:
    """Works off what is available into an in-memory table; for tests and small summaries."""
    counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
