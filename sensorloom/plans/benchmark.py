"""Benchmark of fusion over scenarios: all scenarios are fused together, scored against what is known, and summed up."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions.columns import clip, magnitude, rounded
from sensorloom.lineage import cut
from sensorloom.operators import adaptive, alignment, benchmark, rates, scoring, signals
from sensorloom.plans import pipeline
from sensorloom.sources.scenarios import Scenarios

KEY, STREAM = ["participant_id"], ["participant_id", "dataset_id"]
#: Rows of the common grid that the overlay of two datasets shows, and the least that it is compared by.
OVERLAY, LEAST = 1000, 16
TABLE = (
    "scenario", "final_score", "signal_score", "agent_score", "alignment_mae", "wasserstein_similarity", "frequency_similarity", "drift_stability", "hqscore_improvement",
    "confidence_calibration_error", "strategy_selection_accuracy", "hqscore_classical", "hqscore_adaptive", "predicted_confidence", "agent_chosen_strategy", "agent_best_strategy",
)


@dataclass(frozen=True)
class Config:
    max_alignment_error_seconds: float = 1.0
    drift_variance_reference: float = 0.0025


def contexts(frame: DataFrame) -> DataFrame:
    """What recommendations are asked with, a row a scenario: modalities, rates, duration, task and flags."""
    streams = pipeline.streams_of(frame)
    there = {m: [f"has_{c}" for c in names if f"has_{c}" in streams.columns] for m, (names, _, _) in registry.MODALITIES.items()}
    found = F.array_compact(F.array(*(F.when(F.greatest(*(F.bool_or(c) for c in names), F.lit(False)), F.lit(m)) for m, names in sorted(there.items()) if names)))
    rows = streams.groupBy(*KEY).agg(
        found.alias("modalities"), F.array_sort(F.collect_list(F.when(F.col("rate_hz") > 0, F.col("rate_hz")))).alias("sampling_rates_hz"),  # at most four
        F.avg(F.when(F.col("n") > 1, F.col("duration_seconds"))).alias("duration_seconds"),
    )
    tasks = scoring.with_task(pipeline.context(streams)).select(*KEY, F.col("task").alias("task_type"))
    return rows.join(tasks, KEY).withColumns({"drift_flag": F.lit(False), "user_override_flag": F.lit(False)})


def strategy_confidence(frame: DataFrame) -> DataFrame:
    """participant_id, strategy_confidence: by the mean peak of raw correlations with the first dataset, and the spread of rates."""
    each = rates.sampling_rate(frame, STREAM, digits=None, default=0.0).where("rate_hz > 0").groupBy(*KEY).agg(F.when(F.count(F.lit(1)) > 1, F.stddev_pop("rate_hz")).otherwise(0.0).alias("spread"))
    axes = scoring.SENSORS["acc"]
    peaks = None
    if set(axes) <= set(frame.columns):
        m = magnitude(*(F.col(a) for a in axes), nulls="skip")
        whole = scoring.present(frame, STREAM).where(" and ".join("has_" + a for a in axes)).select(*STREAM)
        pairs = alignment.star_pairs(alignment.numbered(frame.join(whole, STREAM, "left_semi").select(*STREAM, "ts", m.alias("m")), STREAM), KEY)
        peak = signals.cross_correlation(pairs, STREAM, absolute=True).select(*KEY, F.when(F.col("n") < 32, 0.5).otherwise(clip(F.col("peak"))).alias("peak"))
        peaks = peak.groupBy(*KEY).agg(F.avg("peak").alias("peak"))
    rows = frame.select(*KEY).distinct().join(each, KEY, "left")
    rows = rows.join(peaks, KEY, "left") if peaks is not None else rows.withColumn("peak", F.lit(0.5))
    sure = 0.05 + F.coalesce("peak", F.lit(0.5)) + F.greatest(F.lit(0.0), 0.2 - F.coalesce("spread", F.lit(0.0)) / 30)
    return rows.select(*KEY, F.round(clip(sure, 0.55, 0.95), 4).alias("strategy_confidence"))


def overlay(fusion: pipeline.Fusion) -> DataFrame:
    """participant_id, pos, x, y: acceleration magnitudes of the first two datasets on the common grid, its first rows."""
    rows, axes = fusion.resampled, scoring.SENSORS["acc"]
    if not set(axes) <= set(rows.columns):
        return rows.select(*KEY, F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    m = magnitude(*(F.col(a) for a in axes))
    first = alignment.numbered(rows.select(*STREAM, "ts", m.alias("m")), STREAM).where(F.col("pos") < OVERLAY)
    two = first.groupBy(*KEY, "pos").agg(F.array_sort(F.collect_list(F.struct("dataset_id", "m"))).alias("d"))  # at most four
    return two.select(*KEY, "pos", F.get("d", F.lit(0))["m"].alias("x"), F.get("d", F.lit(1))["m"].alias("y")).where("x is not null and y is not null")


def dominant(x: np.ndarray, rate: float) -> float:
    """Without a taper, as the benchmark has it."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    return float(np.fft.rfftfreq(len(x), 1 / rate)[1 + int(np.argmax(power[1:]))]) if len(power) > 1 and rate > 0 else 0.0


def signal_scores(fusion: pipeline.Fusion, truth: DataFrame, config: Config) -> DataFrame:
    """participant_id, alignment_mae, wasserstein_similarity, frequency_similarity, drift_stability."""
    report = fusion.report
    shown = overlay(fusion)
    enough = shown.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select(*KEY)
    pairs = shown.join(enough, KEY, "left_semi")
    distance = signals.wasserstein(pairs, KEY).select(*KEY, clip(F.exp(-F.col("distance") / (3 * (F.col("sigma") + 1e-9)))).alias("wasserstein_similarity"))
    kind = shown.schema["participant_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # at most ``OVERLAY`` rows
        rows = rows.sort_values("pos")
        rate = float(rows["rate"].iloc[0])
        return pd.DataFrame([[rows["participant_id"].iloc[0], dominant(rows["x"].to_numpy(float), rate), dominant(rows["y"].to_numpy(float), rate), rate]], columns=["participant_id", "fx", "fy", "rate"])

    tones = pairs.join(report.select(*KEY, F.col("master_rate_hz").alias("rate")), KEY).groupBy(*KEY).applyInPandas(run, f"participant_id {kind}, fx double, fy double, rate double")
    tones = tones.select(*KEY, benchmark.frequency_similarity(F.col("fx"), F.col("fy"), F.col("rate")).alias("frequency_similarity"))
    known = truth.withColumnRenamed("scenario", "participant_id")
    found = report.join(known, KEY, "left").select(*KEY, "ground_truth_offsets_seconds", F.coalesce("ground_truth_offset_seconds", F.lit(0.0)).alias("one"), F.explode("datasets").alias("d"))
    told = F.when(F.col("ground_truth_offsets_seconds").isNotNull(), F.col("ground_truth_offsets_seconds")[F.col("d.dataset_id")]).when(F.col("d.dataset_id") != "dataset1", F.col("one"))
    errors = found.groupBy(*KEY).agg(F.round(F.coalesce(F.avg(F.abs(F.col("d.offset_seconds") - told)), F.lit(0.0)), 6).alias("alignment_mae"))
    first = fusion.trend.groupBy(*KEY).agg(F.min("dataset_id").alias("dataset_id"))
    spread = fusion.trend.join(first, STREAM).groupBy(*KEY).agg(F.var_pop("offset_seconds").alias("variance"), F.count(F.lit(1)).alias("windows"))
    rows = report.select(*KEY, "drift_type").join(spread, KEY, "left").join(errors, KEY).join(distance, KEY, "left").join(tones, KEY, "left")
    steady = benchmark.drift_stability(F.col("variance"), F.coalesce("windows", F.lit(0)), F.col("drift_type"), config.drift_variance_reference)
    return rows.select(*KEY, "alignment_mae", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("wasserstein_similarity", "frequency_similarity")), steady.alias("drift_stability"))


def evaluate(scenarios: Scenarios, store: adaptive.Store | None = None, config: Config = Config()) -> DataFrame:
    """A row a scenario, columns as ``TABLE``: fused as it is, and with the recommended rate where one is trusted."""
    frame = cut(scenarios.frame, "scenarios")
    slots = [s for s in Scenarios(frame, scenarios.truth).slots() if not s.isEmpty()]
    plain = tuned = pipeline.fuse(slots)
    advice = None
    if store:
        advice = cut(store.recommend(contexts(frame)).select(*KEY, "predicted_sampling_rate_hz", "used", F.col("confidence").alias("adaptive_confidence")), "advice")
        if not advice.where("used").isEmpty():
            tuned = pipeline.fuse(slots, target_rate=advice.where("used").select(*KEY, F.col("predicted_sampling_rate_hz").alias("target_rate_hz")))
    scores = signal_scores(tuned, scenarios.truth, config)
    rows = scores.join(plain.report.select(*KEY, F.col("hqscore").alias("hqscore_without")), KEY).join(tuned.report.select(*KEY, F.col("hqscore").alias("hqscore_with")), KEY).join(strategy_confidence(frame), KEY)
    rows = rows.join(advice.select(*KEY, "adaptive_confidence"), KEY, "left") if advice is not None else rows.withColumn("adaptive_confidence", F.lit(0.0))
    a, b = F.coalesce("adaptive_confidence", F.lit(0.0)), F.col("strategy_confidence")
    sure = F.when((a > 0) & (b > 0), (a + b) / 2).otherwise(F.greatest(a, b))
    rows = rows.withColumns({"predicted_confidence": rounded(sure, 6), "chosen": F.lit("classical"), "best": F.lit("classical")})
    done = benchmark.with_final_scores(rows, config.max_alignment_error_seconds)
    names = {"scenario": "participant_id", "hqscore_classical": "hqscore_without", "hqscore_adaptive": "hqscore_with", "agent_chosen_strategy": "chosen", "agent_best_strategy": "best"}
    return done.select(*(F.col(names.get(c, c)).alias(c) for c in TABLE))


def payload(rows: DataFrame, store: adaptive.Store | None = None, config: Config = Config()) -> dict:
    """What a run of the benchmark says of itself: when, with which models and settings, and the means over scenarios."""
    found = benchmark.summary(rows).head().asDict()
    return {
        "generated_at_utc": datetime.now(UTC).isoformat(),
        "model_versions": {"adaptive_model_version": store.state().model_version if store else "untrained", "alignment_mode": "classical"},
        "benchmark_config": asdict(config),
        "aggregate": {"scenarios_evaluated": found["scenarios"], **{f"mean_{k}": found[k] or 0.0 for k in ("signal_score", "agent_score", "final_score")}},
    }


def write_payload(rows: DataFrame, path: str, store: adaptive.Store | None = None, config: Config = Config()) -> None:
    """``payload`` as one JSON object; the rows themselves go through ``sinks.write_benchmark``."""
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(payload(rows, store, config)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
