"""The nested report of a fusion, a row a participant, for readers of JSON: names of fields are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.columns import magnitude, rounded
from sensorloom.operators import alignment, scoring
from sensorloom.plans import pipeline

KEY, STREAM = ["participant_id"], ["participant_id", "dataset_id"]
#: Refused actions and points of an overlay that are shown.
SHOWN_ACTIONS, SHOWN_POINTS = 20, 1000


def iso(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def renamed(**names: str) -> list[Column]:
    """Columns under the names of the report."""
    return [F.col(c).alias(n) for n, c in names.items()]


def trends(fusion: pipeline.Fusion) -> DataFrame:
    """participant_id, offset_trend: the windows of each participant's first pair; signals are thinned, so there are few."""
    first = fusion.trend.groupBy(*KEY).agg(F.min("dataset_id").alias("dataset_id"))
    point = F.struct("idx", F.struct(iso("mid").alias("timestamp"), "offset_seconds", F.col("strength").alias("correlation_strength")).alias("p"))
    return fusion.trend.join(first, STREAM).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]).alias("offset_trend"))


def actions(fusion: pipeline.Fusion) -> DataFrame:
    """participant_id, accepted_actions and the first ``SHOWN_ACTIONS`` rejected_actions, by round."""
    fields = ["iteration", "action_id", "dataset_id", "action_type", F.lit("planner").alias("source"), "rationale", "score_before", "score_after", "improvement", "observer_confidence"]
    place = F.row_number().over(Window.partitionBy(*KEY, "accepted").orderBy("iteration", "dataset_id", "action_id"))
    rows = fusion.actions.select(*KEY, "accepted", F.struct(*fields).alias("a"), place.alias("at")).where(F.col("accepted") | (F.col("at") <= SHOWN_ACTIONS))
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "a")))), lambda x: x["a"])
    return rows.groupBy(*KEY).agg(listed(F.col("accepted")).alias("accepted_actions"), listed(~F.col("accepted")).alias("rejected_actions"))


def overlays(fusion: pipeline.Fusion) -> DataFrame:
    """participant_id, acc_magnitude_overlay and gyro_magnitude_overlay: the first points of the grid, a value a dataset."""
    rows = fusion.resampled
    sensors = {s: axes for s, axes in scoring.SENSORS.items() if set(axes) <= set(rows.columns)}
    first = alignment.numbered(rows, STREAM).where(F.col("pos") < SHOWN_POINTS)
    values = first.groupBy(*KEY, "pos", "ts").agg(*(F.array_sort(F.collect_list(F.struct("dataset_id", rounded(magnitude(*(F.col(a) for a in axes)), 6).alias("v")))).alias(s) for s, axes in sensors.items()))
    shown = lambda s: F.transform(F.array_sort(F.collect_list(F.struct("pos", iso("ts").alias("at"), F.col(s).alias("v")))), lambda x: F.struct(x["at"].alias("timestamp"), F.map_from_entries(x["v"]).alias("values")))
    none = F.array().cast("array<struct<timestamp:string,values:map<string,double>>>")
    return values.groupBy(*KEY).agg(*((shown(s) if s in sensors else none).alias(f"{s}_magnitude_overlay") for s in scoring.SENSORS))


def nested(fusion: pipeline.Fusion, with_overlays: bool = True) -> DataFrame:
    """participant_id and ``fusion_report`` (a struct), and with overlays ``visual_data``."""
    rows = fusion.report.join(trends(fusion), KEY, "left")
    each = lambda f: F.transform("datasets", f)
    trend = F.coalesce("offset_trend", F.array().cast("array<struct<timestamp:string,offset_seconds:double,correlation_strength:double>>"))
    overlap = F.struct(iso("overlap_start").alias("start_timestamp"), iso("overlap_end").alias("end_timestamp"), F.col("overlap_seconds").alias("duration_seconds"))
    measured = each(lambda d: F.struct(d["dataset_id"].alias("dataset_id"), d["sampling_rate_hz"].alias("sampling_rate_hz"), d["duration_seconds"].alias("duration_seconds"), iso(d["start_ts"]).alias("start_timestamp"), iso(d["end_ts"]).alias("end_timestamp")))
    moved = each(lambda d: F.struct(d["dataset_id"].alias("dataset_id"), d["offset_seconds"].alias("offset_seconds")))
    said = F.format_string("Windows are off by %.4f s on average, slope %.6f, warping %.3f.", F.coalesce("mean_offset", F.lit(0.0)), F.coalesce("slope", F.lit(0.0)), F.coalesce("warp", F.lit(0.0)))
    parts = [
        F.struct(measured.alias("datasets"), overlap.alias("overlap_window")).alias("dataset_metadata"),
        F.struct(
            F.col("master_rate_hz").alias("master_sampling_rate_hz"), moved.alias("offset_corrections"), "drift_detected",
            F.map_from_entries(each(lambda d: F.struct(d["dataset_id"], d["resampling_strategy"]))).alias("resampling_strategy"), F.lit("classical").alias("alignment_mode"),
            F.col("requested_applied").alias("suggested_sampling_rate_applied"),
        ).alias("alignment_decisions"),
        F.struct(*renamed(missing_modalities="missing_modalities", missingness_percentage_by_modality="missing_percent", distribution_divergence_score="divergence")).alias("data_integrity"),
        F.col("hqscore"),
        F.struct(*renamed(predicted_task="task", confidence="task_confidence", hqscore_weight_profile="profile")).alias("task_inference"),
        F.struct(
            F.col("hqscore").alias("overall"),
            F.struct(*renamed(distribution_similarity="distribution", spectral_similarity="spectral", temporal_alignment_strength="temporal", missingness_penalty="missingness", sensor_coverage="coverage", stability_factor="stability_factor")).alias("components"),
            F.struct(*renamed(kl_divergence="kl", wasserstein_distance="wasserstein", spectral_coherence_score="coherence", dominant_frequency_similarity="frequency", cross_correlation_peak_strength="peak", snr_consistency="snr")).alias("advanced_metrics"),
        ).alias("hqscore_v4"),
        F.struct(
            "drift_detected", "drift_type", F.coalesce("mean_offset", F.lit(0.0)).alias("average_window_offset"), F.coalesce("warp", F.lit(0.0)).alias("dtw_score"), F.col("stability").alias("stability_score"),
            trend.alias("offset_trend"), said.alias("explanation"),
        ).alias("drift_analysis"),
        F.struct(F.col("confidence").alias("level"), "reason").alias("confidence"),
        F.slice("warnings", 1, pipeline.SHOWN).alias("warnings"),
    ]
    if fusion.actions is not None:
        rows = rows.join(actions(fusion), KEY, "left")
        no_action = rows.schema["accepted_actions"].dataType.simpleString()
        done = F.struct(
            F.lit(True).alias("enabled"), F.col("corrections.used").alias("used"), F.lit("greedy").alias("policy"), F.col("corrections.iterations").alias("iterations"),
            F.col("corrections.initial_score").alias("initial_quality_score"), F.col("corrections.final_score").alias("final_quality_score"), F.col("corrections.net_improvement").alias("net_improvement"),
            F.col("corrections.confidence").alias("confidence"), *(F.coalesce(c, F.array().cast(no_action)).alias(c) for c in ("accepted_actions", "rejected_actions")), F.col("corrections.stop_reason").alias("stop_reason"),
        )
        parts.append(done.alias("agentic_layer"))
    out = rows.select(*KEY, F.struct(*parts).alias("fusion_report"))
    if not with_overlays:
        return out
    shown = overlays(fusion).join(trends(fusion).withColumnRenamed("offset_trend", "drift_offset_trend"), KEY, "left")
    return out.join(shown.select(*KEY, F.struct(*(c for c in shown.columns if c not in KEY)).alias("visual_data")), KEY, "left")


def summaries(report: DataFrame) -> DataFrame:
    """participant_id, hqscore, sampling_rate, datasets_used of each participant."""
    return report.select(*KEY, "hqscore", F.col("master_rate_hz").alias("sampling_rate"), F.size("datasets").alias("datasets_used"))
