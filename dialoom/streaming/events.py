"""Event-time operators of Structured Streaming; these extend what recorded streams need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts") -> DataFrame:
    """A file stream whose event time is a TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed(df: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding window; works on batches and, with a watermark, on streams."""
    own = df.withWatermark(time, late) if late else df
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return own.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    own = df.withWatermark(time, late) if late else df
    return own.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def without_repeats(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Pairs of one key whose right time is at most ``within`` after the left one's; bounded state on streams."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnRenamed(key, "_key")
    return a.join(b, F.expr(f"{key} = _key and {right_time} >= {left_time} and {right_time} <= {left_time} + interval {within}")).drop("_key")
