"""The test tables as sensor streams in the long layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, dataset_id, ts, value, event_id: one stream per user and event type."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("participant_id"), F.col("event_type").alias("dataset_id"), "ts", "value", "event_id")


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, label, and six channels of two datasets (a: acc_x1.., gyro_x1..; b: ..2) from embedding elements."""
    names = [f"{s}_{axis}{d}" for d in (1, 2) for s in ("acc", "gyro") for axis in "xyz"]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, pos, x, y: acceleration magnitudes of the two datasets (absent axes count as 0)."""
    from sensorloom.functions.columns import magnitude

    m = lambda d: magnitude(*(F.col(f"acc_{a}{d}") for a in "xyz"), nulls="skip")
    return imu(spark, sf_dir).select(F.lit("imu").alias("grp"), "pos", m(1).alias("x"), m(2).alias("y"))
