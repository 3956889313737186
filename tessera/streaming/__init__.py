"""Queries over streams (an extension): the same expressions on Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: tuple[str, ...] = (), **aggregates) -> DataFrame:
    """Aggregates of tumbling windows of ``width`` by ``keys``; rows later than ``late`` are left out and state is dropped.

    ``aggregates`` are Spark aggregate columns by name. Works on batches too.
    """
    at = F.window(time, width)
    grouped = stream.withWatermark(time, late).groupBy(at.alias("w"), *keys)
    out = grouped.agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)
