"""Telemetry over an event stream: the metric statistics as Structured Streaming aggregates.

An extension: batch statistics are in operators.metrics. Exact percentiles need all samples, so
the stream keeps count, sum, extremes and squares, and an approximate percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "*events*.parquet", schema=None) -> DataFrame:
    schema = schema or "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_statistics(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and event type, emitted once the watermark has passed the window."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("value").alias("samples"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.stddev_pop("value").alias("stdev"), F.percentile_approx("value", 0.95).alias("p95"))
        .select(F.col("w.start").alias("start"), "event_type", "samples", *[F.round(c, 4).alias(c) for c in ("total", "mean", "minimum", "maximum", "stdev", "p95")])
    )
