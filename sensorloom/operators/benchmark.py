"""Benchmark scores of fusion scenarios: alignment error, signal similarity, agent quality and the final mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import clip, rounded


def alignment_error(offsets: DataFrame, truth: DataFrame, keys: list[str] = ["scenario"]) -> DataFrame:
    """keys and alignment_mae: mean absolute gap of offset_seconds to the truth of the same dataset_id."""
    both = offsets.join(truth.select(*keys, "dataset_id", F.col("offset_seconds").alias("true_seconds")), [*keys, "dataset_id"])
    return both.groupBy(*keys).agg(F.round(F.avg(F.abs(F.col("offset_seconds") - F.col("true_seconds"))), 6).alias("alignment_mae"))


def drift_stability(offset_variance: Column, n: Column, drift_type: Column, reference: float = 0.0025) -> Column:
    """From the spread of window offsets; with fewer than two, by the drift class."""
    return F.when(n < 2, F.when(drift_type == "none", 1.0).otherwise(0.5)).otherwise(clip(1 / (1 + offset_variance / max(1e-9, reference))))


def frequency_similarity(left_hz: Column, right_hz: Column, rate_hz: Column) -> Column:
    return clip(F.exp(-F.abs(left_hz - right_hz) / (rate_hz / 10.0 + 1e-9)))


def with_final_scores(rows: DataFrame, worst_error_seconds: float = 1.0) -> DataFrame:
    """``hqscore_improvement``, ``signal_score``, ``agent_score`` and ``final_score``.

    Of rows with alignment_mae, wasserstein_similarity, frequency_similarity, drift_stability, hqscore_with,
    hqscore_without, predicted_confidence, chosen and best (strategies).
    """
    improvement = rounded(F.col("hqscore_with") - F.col("hqscore_without"), 6)
    error = rounded(clip(F.abs(F.col("predicted_confidence") - F.col("hqscore_with"))), 6)
    right = (F.col("chosen") == F.col("best")).cast("double")
    signal = clip((1 - clip(F.col("alignment_mae") / max(1e-9, worst_error_seconds)) + F.col("wasserstein_similarity") + F.col("frequency_similarity") + F.col("drift_stability")) / 4)
    agent = clip((clip((F.col("hqscore_improvement") + 1) / 2) + 1 - clip(F.col("confidence_calibration_error")) + F.col("strategy_selection_accuracy")) / 3)
    rows = rows.withColumns({"hqscore_improvement": improvement, "confidence_calibration_error": error, "strategy_selection_accuracy": right})
    return rows.withColumns({"signal_score": rounded(signal, 6), "agent_score": rounded(agent, 6), "final_score": rounded(clip(0.6 * signal + 0.4 * agent), 6)})


def summary(rows: DataFrame) -> DataFrame:
    """Means over all scenarios."""
    names = ("alignment_mae", "wasserstein_similarity", "frequency_similarity", "drift_stability", "hqscore_improvement", "signal_score", "agent_score", "final_score")
    return rows.agg(F.count(F.lit(1)).alias("scenarios"), *(F.round(F.avg(c), 6).alias(c) for c in names))
