"""Cutting long plans: what several later plans read is written once, as Parquet, to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables that this process has written and not yet dropped, in order.
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is set, as in tests, a temporary one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The frame as a stored table: later plans read the columns that they need, also after an executor is lost."""
    spark, schema = df.sparkSession, df.schema
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(schema).parquet(path)


def mark() -> int:
    """A place in the list of stored tables, for ``drop``."""
    return len(_made)


def drop(spark: SparkSession, start: int, end: int | None = None) -> None:
    """Deletes the tables stored since a mark; nothing that is still to be computed may read them."""
    for path in _made[start:end]:
        if path:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    _made[start:end] = [""] * len(_made[start:end])
