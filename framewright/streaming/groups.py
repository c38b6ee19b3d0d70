"""Grouped aggregation over a stream: the batch engine's aggregates in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import named


def windowed(stream: DataFrame, time: str, every: str, late: str, by: list[str], spec: dict[str, str]) -> DataFrame:
    """Per window and key, one named aggregate a column; rows later than `late` are dropped by the watermark."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    aggs = [named(how, F.col(c), stream.schema[c].dataType).alias(c) for c, how in spec.items()]
    out = marked.groupBy(F.window(time, every), *by).agg(*aggs)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *by, *spec)
