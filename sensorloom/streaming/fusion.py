"""Streaming fusion, an extension: bucketed means of several datasets with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed_fusion(stream: DataFrame, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Per key and time bucket: the mean of ``value`` over all datasets and the number of samples."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("ts"), value, "n")
