"""Sinks: fused and corrected data, results and learning records as JSON, benchmark tables; and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ledger of jobs; ``learning`` is the JSON text of ``LEARNING``.
JOBS = {"job_id": "string", "status": "string", "created_at": "timestamp", "learning": "string"}
LEARNING = (
    "chosen_master_rate_hz double, hqscore double, modalities array<string>, sampling_rates_hz array<double>, duration_seconds double, task_type string, "
    "drift_classification string, drift_flag boolean, user_override_flag boolean"
)


def write_rows(df: DataFrame, path: str, kind: str = "csv", by: str | None = "participant_id") -> None:
    """Fused or corrected rows, in order of participant and time within each file; no file gathers all of them."""
    order = [c for c in ("participant_id", "ts") if c in df.columns]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        (writer.partitionBy(by) if by in df.columns else writer).parquet(path)


def write_results(report: DataFrame, path: str) -> None:
    """One JSON object per row of a report, nested columns as they are."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def learning_record(report: DataFrame, job_id: str) -> DataFrame:
    """What later recommendations learn from one job: a row with the JSON text of its mean rate, score, task and drift."""
    found = report.agg(
        F.avg("master_rate_hz").alias("chosen_master_rate_hz"), F.avg("hqscore").alias("hqscore"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("datasets", lambda d: d["sampling_rate_hz"]))))).alias("sampling_rates_hz"),
        F.avg(F.expr("aggregate(filter(datasets, d -> d.duration_seconds > 0), double(0), (a, d) -> a + d.duration_seconds) / nullif(size(filter(datasets, d -> d.duration_seconds > 0)), 0)")).alias("duration_seconds"),
        F.mode("task").alias("task_type"), F.max("drift_type").alias("drift_classification"), F.bool_or("drift_detected").alias("drift_flag"), F.bool_or("requested_applied").alias("user_override_flag"),
    )
    return found.select(F.lit(job_id).alias("job_id"), F.lit("completed").alias("status"), F.current_timestamp().alias("created_at"), F.to_json(F.struct("*")).alias("learning"))


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds jobs to the ledger; columns that are not of ``JOBS`` are left out, missing ones are null."""
    rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in JOBS.items())).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return valid_records(spark.read.parquet(path))


def valid_records(jobs: DataFrame) -> DataFrame:
    """Completed jobs whose learning text holds a positive rate and a score from 0 to 1, its fields as columns."""
    rows = jobs.where("status = 'completed' and learning is not null").withColumn("_r", F.from_json("learning", LEARNING))
    return rows.where("_r.chosen_master_rate_hz > 0 and _r.hqscore between 0 and 1").select(*(c for c in jobs.columns if c != "learning"), "_r.*")


def write_benchmark(rows: DataFrame, path: str) -> None:
    """Scenario scores as JSON lines and as CSV with a header, also when there are none."""
    rows.write.mode("overwrite").json(path + "/json")
    rows.write.mode("overwrite").option("header", True).csv(path + "/csv")


def write_validation(report: DataFrame, fused: DataFrame, path: str) -> None:
    """What a fusion came to, a JSON object and a Markdown text for each participant: score, rate, offsets, rows, columns."""
    sizes = fused.groupBy("participant_id").agg(F.count(F.lit(1)).alias("num_rows"))
    columns = F.array(*map(F.lit, fused.columns))
    offsets = F.transform("datasets", lambda d: F.struct(d["dataset_id"].alias("dataset_id"), (d["offset_seconds"] * 1000).alias("offset_ms")))
    rows = report.join(sizes, "participant_id").select(
        "participant_id", F.current_timestamp().alias("generated_at"), F.col("hqscore").alias("final_hq_score"), F.col("master_rate_hz").alias("chosen_sampling_rate_hz"), offsets.alias("estimated_time_offsets_ms"),
        "num_rows", F.size(columns).alias("num_columns"), columns.alias("columns"),
    )
    rows.select("participant_id", F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy("participant_id").text(path + "/json")
    moved = F.array_join(F.transform("estimated_time_offsets_ms", lambda o: F.format_string("%s: %.1f ms", o["dataset_id"], o["offset_ms"])), ", ")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Fusion of "), "participant_id"), F.lit(""), F.format_string("* Score: %.4f", "final_hq_score"), F.format_string("* Rate: %.4f Hz", "chosen_sampling_rate_hz"),
        F.concat(F.lit("* Offsets: "), moved), F.format_string("* Rows: %d", "num_rows"), F.format_string("* Columns (%d): %s", "num_columns", F.array_join("columns", ", ")), F.format_string("* Generated: %s", "generated_at"),
    )
    rows.select("participant_id", text.alias("value")).write.mode("overwrite").partitionBy("participant_id").text(path + "/markdown")
