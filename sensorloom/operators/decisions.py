"""Corrective actions, suggestions and learned recommendations over aggregated scores.

Candidates are lazy expression variants of one frame; all are scored in a single aggregation, and the driver compares
a handful of numbers. The learned model is Spark's own gradient-boosted trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions.columns import clip
from sensorloom.operators.resample import rolling_median


@dataclass
class Decision:
    """What the loop tried and took: (action, column, score before, score after)."""

    frame: DataFrame
    accepted: list[tuple[str, str, float, float]] = field(default_factory=list)
    rejected: list[tuple[str, str]] = field(default_factory=list)
    stop: str = "no_new_actions"


def completeness(frame: DataFrame, columns: dict[str, Column], weight: float = 0.15, cover: float = 0.10) -> dict[str, float]:
    """Score of each variant by missingness and coverage, the two components that one dataset alone can change."""
    total = sum(w for _, w, _ in registry.MODALITIES.values())

    def score(changed: str | None) -> Column:
        missing, covered = F.lit(0.0), 0.0
        for names, w, _ in registry.MODALITIES.values():
            used = [c for c in names if c in frame.columns]
            value = lambda c: columns[c] if c == changed else F.col(c)  # noqa: B023, E731
            share = sum((F.avg(value(c).isNull().cast("double")) for c in used), F.lit(0.0)) / len(used) if used else F.lit(1.0)
            missing, covered = missing + w * share, covered + w * bool(used)
        return weight * (1 - missing / total) + cover * covered / total

    # Window expressions cannot stand inside aggregates, so variants become columns first.
    named = frame.select("*", *(v.alias(f"_v_{c}") for c, v in columns.items()))
    columns = {c: F.col(f"_v_{c}") for c in columns}
    row = named.agg(score(None).alias("now"), *(score(c).alias(c) for c in columns)).head()
    return row.asDict()


def smooth_until_no_gain(frame: DataFrame, keys: list[str], order: str, channels: list[str], most: int = 3, least_gain: float = 0.002, width: int = 5) -> Decision:
    """Greedy: smooths the channel that gains most, as long as one gains ``least_gain``; at most ``most`` rounds."""
    out = Decision(frame)
    for _ in range(most):
        left = [c for c in channels if c not in {a[1] for a in out.accepted}]
        if not left:
            return out
        variants = {c: F.coalesce(F.col(c), rolling_median(c, keys, order, width)) for c in left}
        scores = completeness(out.frame, variants)
        best = max(left, key=lambda c: scores[c])
        if scores[best] - scores["now"] < least_gain:
            out.rejected += [("smooth", c) for c in left]
            out.stop = "no_improvement"
            return out
        out.accepted.append(("smooth", best, scores["now"], scores[best]))
        out.frame = out.frame.withColumn(best, variants[best])
    out.stop = "max_iterations"
    return out


def observer_confidence(gain: Column) -> Column:
    return F.when(gain <= 0, 0.3).when(gain < 0.01, 0.6).when(gain < 0.05, 0.8).otherwise(0.95)


def top_papers(papers: DataFrame, key: list[str], citations: str, most: int = 5) -> DataFrame:
    """One row per key, that with most citations; of these the most cited ``most``."""
    rows = papers.groupBy(*key).agg(F.max(citations).alias(citations))
    return rows.orderBy(F.desc(citations), *key).limit(most)


def accepted_change(before: Column, after: Column) -> Column:
    """A change is kept if the score does not fall."""
    return F.when(after - before >= 0, "accepted").otherwise("rejected")


def adaptive_confidence(rate_fit: Column, score_fit: Column, samples: Column, enough: int = 100) -> Column:
    return clip(0.4 * rate_fit + 0.3 * score_fit + 0.3 * F.least(F.lit(1.0), samples / enough))


def train_rate_model(records: DataFrame, features: list[str], label: str, least: int = 20) -> PipelineModel | None:
    """Gradient-boosted trees for the best rate; None with fewer than ``least`` valid records."""
    valid = records.where(f"{label} > 0").na.drop(subset=[*features, label])
    if valid.count() < least:
        return None
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(labelCol=label, maxIter=20, maxDepth=3, seed=7)]).fit(valid)
