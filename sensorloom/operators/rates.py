"""Sampling rates, durations, overlap, continuity and profiles of streams in the long layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.columns import seconds


def with_gap(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``gap``: seconds since the stream's previous sample, from whole microseconds."""
    w = Window.partitionBy(*keys).orderBy(ts)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("gap", (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 1e6)


def rate_of_gaps(digits: int | None = 2, default: float = 1.0) -> Column:
    """An aggregate over rows with ``gap``: one over its median; ``default`` without a positive median."""
    median = F.percentile("gap", 0.5)
    rate = F.when(median > 0, 1 / median)
    return F.coalesce(rate if digits is None else F.round(rate, digits), F.lit(default))


def sampling_rate(df: DataFrame, keys: list[str], ts: str = "ts", digits: int | None = 2, default: float = 1.0) -> DataFrame:
    """Rate of each stream: one over the median gap; ``default`` without a positive median."""
    return with_gap(df, keys, ts).groupBy(*keys).agg(rate_of_gaps(digits, default).alias("rate_hz"), F.count(F.lit(1)).alias("n"))


def master_rate(rates: DataFrame, keys: list[str], fallback: float = 10.0) -> DataFrame:
    """The least positive rate of each group, else ``fallback``."""
    return rates.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("rate_hz") > 0, F.col("rate_hz"))), F.lit(fallback)).alias("master_rate_hz"))


def durations(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")).withColumn("duration_seconds", F.round(seconds(F.col("end_ts")) - seconds(F.col("start_ts")), 3))


def overlap(df: DataFrame, dataset: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Start and end common to all datasets of a group; null and 0 seconds if there is none."""
    ends = durations(df, [*keys, dataset], ts).groupBy(*keys).agg(F.max("start_ts").alias("lo"), F.min("end_ts").alias("hi"))
    some = F.col("lo") < F.col("hi")
    return ends.select(*keys, F.when(some, F.col("lo")).alias("overlap_start"), F.when(some, F.col("hi")).alias("overlap_end"), F.when(some, F.round(seconds(F.col("hi")) - seconds(F.col("lo")), 3)).otherwise(0.0).alias("duration_seconds"))


def continuity(df: DataFrame, keys: list[str], ts: str = "ts", tolerance: float = 0.2, unit: float = 1.0) -> DataFrame:
    """Whether all gaps of a stream are within ``tolerance`` of their median, and how regular they are.

    ``unit``: seconds in which gaps are measured. Nothing is rounded: times are not, and figures only by who shows them.
    """
    gaps = with_gap(df, keys, ts).where("gap is not null").withColumn("gap", F.col("gap") / unit)
    medians = gaps.groupBy(*keys).agg(F.percentile("gap", 0.5).alias("median_gap"))
    return gaps.join(medians, keys).groupBy(*keys).agg(
        F.bool_and(F.abs(F.col("gap") - F.col("median_gap")) < tolerance * F.col("median_gap")).alias("continuous"),
        (1 / (1 + F.var_pop("gap"))).alias("sampling_consistency"),
        (1 / (1 + F.stddev_samp("gap"))).alias("temporal_consistency"),
    )


def column_profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per group and column: missing share, mean, sample deviation, extremes."""
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select(*keys, "s.*")
    return rows.groupBy(*keys, "column_name").agg(
        F.round(F.avg(F.col("v").isNull().cast("double")), 6).alias("missing_ratio"), F.round(F.avg("v"), 6).alias("mean_value"),
        F.round(F.stddev_samp("v"), 6).alias("std_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
    )
