"""Recommendations learned from the ledger of finished jobs: a rate to ask for, and the score to expect from it.

Two boosted-tree regressors of Spark ML over the same features (modalities, task, rates, duration, flags), with held-out
records that end the boosting. A target that never varies is a constant, not a model. Every training writes a new
version folder (models and a JSON state) below the store's path, on whatever file system the session has; the latest
complete version counts and the earlier ones stay as backups, so a job that dies while writing changes nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions.columns import clip, rounded
from sensorloom.operators.decisions import adaptive_confidence

TASKS = (*registry.TASKS, "Unknown")
TARGETS = ("chosen_master_rate_hz", "hqscore")
# Errors that count as worthless, records that count as enough, rounds of boosting by target, and limits.
WORST_ERROR, ENOUGH = {"chosen_master_rate_hz": 20.0, "hqscore": 0.25}, 120
ROUNDS = {"chosen_master_rate_hz": 140, "hqscore": 120}
LEAST_RECORDS, RETRAIN_AFTER, USE_FROM = 20, 20, 0.7


def name_of(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text.lower())


def features() -> dict[str, Column]:
    """What the models look at, from modalities, task_type, sampling_rates_hz, duration_seconds and the two flags."""
    used = F.filter(F.coalesce("sampling_rates_hz", F.array().cast("array<double>")), lambda r: r.isNotNull() & (r > 0) & (r < float("inf")))
    n = F.size(used)
    mean = F.aggregate(used, F.lit(0.0), lambda a, r: a + r) / n
    spread = F.sqrt(F.aggregate(used, F.lit(0.0), lambda a, r: a + (r - mean) * (r - mean)) / n)
    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = {"has_" + m: flag(F.array_contains("modalities", m)) for m in sorted(registry.MODALITIES)}
    out |= {"task_" + name_of(t): flag(F.coalesce("task_type", F.lit("Unknown")) == t) for t in TASKS}
    length = F.col("duration_seconds").cast("double")
    return out | {
        "rate_mean": some(mean), "rate_min": some(F.array_min(used)), "rate_max": some(F.array_max(used)), "rate_std": some(spread),
        "duration": F.when(length.isNotNull() & ~F.isnan(length) & (F.abs(length) < float("inf")), length).otherwise(0.0),
        "drift": flag(F.col("drift_flag")), "override": flag(F.col("user_override_flag")),
    }


def with_features(rows: DataFrame) -> DataFrame:
    """The rows, and the features of each as the columns ``x_<name>`` and the vector ``features``."""
    rows = rows.withColumns({"x_" + k: v for k, v in features().items()})
    return VectorAssembler(inputCols=["x_" + k for k in features()], outputCol="features").transform(rows)


@dataclass
class State:
    """What is known of the latest version; errors are mean absolute ones over trained-on and held-out records."""

    model_version: str = "untrained"
    last_train_sample_count: int = 0
    train_mae_rate: float | None = None
    train_mae_hqscore: float | None = None
    holdout_mae_rate: float | None = None
    holdout_mae_hqscore: float | None = None
    constant_rate: float | None = None
    constant_hqscore: float | None = None
    trained_at: str | None = None


SHORT = {"chosen_master_rate_hz": "rate", "hqscore": "hqscore"}
STATE = "model_version string, last_train_sample_count long, train_mae_rate double, train_mae_hqscore double, holdout_mae_rate double, holdout_mae_hqscore double, constant_rate double, constant_hqscore double, trained_at string"


@dataclass
class Trained:
    trained: bool
    reason: str
    state: State


class Store:
    """Versions of the models below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(there):
            return []
        names = sorted(f.getPath().getName() for f in files.listStatus(there))
        done = lambda v: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v}/state/_SUCCESS"))
        return [v for v in names if v.startswith("adaptive-") and done(v)]

    def state(self) -> State:
        """Of the latest complete version; the defaults without one."""
        versions = self._versions()
        if not versions:
            return State()
        row = self.spark.read.schema(STATE).json(f"{self.path}/{versions[-1]}/state").head()
        return State(**row.asDict())

    def train(self, records: DataFrame, least: int = LEAST_RECORDS, every: int = RETRAIN_AFTER, rounds: dict[str, int] = ROUNDS, seed: int = 42) -> Trained:
        """Trains a new version from valid ledger records, if there are ``least`` and ``every`` more than last time."""
        old = self.state()
        bounds = [F.count(F.lit(1)).alias("n"), *(f(t).alias(f"{k}_{t}") for t in TARGETS for k, f in (("lo", F.min), ("hi", F.max)))]
        found = records.agg(*bounds).head()
        if found.n < least:
            return Trained(False, f"not_enough_samples:{found.n}", old)
        if found.n - old.last_train_sample_count < every:
            return Trained(False, f"waiting_for_more_samples:{found.n - old.last_train_sample_count}", old)
        # A fifth is held out, told by the record itself, so that reruns agree.
        rows = with_features(records).withColumn("held_out", F.pmod(F.xxhash64(*(c for c in records.columns)), F.lit(5)) == 0).select("features", *TARGETS, "held_out").persist()
        when = datetime.now(UTC)
        state = State(f"adaptive-{when:%Y%m%d%H%M%S%f}", found.n, trained_at=when.isoformat())
        try:
            sides = {r.held_out for r in rows.select("held_out").distinct().collect()}
            for target in TARGETS:
                short = SHORT[target]
                if found[f"lo_{target}"] == found[f"hi_{target}"]:
                    setattr(state, f"constant_{short}", float(found[f"lo_{target}"]))
                    guess = rows.withColumn("prediction", F.lit(float(found[f"lo_{target}"])))
                else:
                    trees = GBTRegressor(labelCol=target, maxIter=rounds[target], maxDepth=3, seed=seed)
                    if sides == {True, False}:
                        trees = trees.setValidationIndicatorCol("held_out")
                    model = PipelineModel([trees.fit(rows)])
                    model.write().overwrite().save(f"{self.path}/{state.model_version}/{short}")
                    guess = model.transform(rows)
                gap = F.abs(F.col("prediction") - F.col(target))
                errors = guess.agg(F.avg(F.when(~F.col("held_out"), gap)), F.avg(F.when(F.col("held_out"), gap))).head()
                for kind, value in zip(("train", "holdout"), errors, strict=True):
                    setattr(state, f"{kind}_mae_{short}", None if value is None else round(value, 6))
        finally:
            rows.unpersist()
        self.spark.createDataFrame([tuple(asdict(state).values())], STATE).coalesce(1).write.json(f"{self.path}/{state.model_version}/state")
        return Trained(True, "trained", state)

    def recommend(self, contexts: DataFrame, threshold: float = USE_FROM) -> DataFrame:
        """The contexts with predicted_sampling_rate_hz, expected_hqscore, confidence, used and model_version.

        Without a trained version: nulls, confidence 0 and not used.
        """
        state, rows = self.state(), contexts
        if state.model_version == "untrained":
            nothing = {c: F.lit(None).cast("double") for c in ("predicted_sampling_rate_hz", "expected_hqscore")}
            return rows.withColumns(nothing | {"confidence": F.lit(0.0), "used": F.lit(False), "model_version": F.lit(state.model_version)})
        rows = with_features(rows)
        for target in TARGETS:
            constant = getattr(state, f"constant_{SHORT[target]}")
            if constant is None:
                rows = PipelineModel.load(f"{self.path}/{state.model_version}/{SHORT[target]}").transform(rows).withColumnRenamed("prediction", "p_" + target)
            else:
                rows = rows.withColumn("p_" + target, F.lit(constant))
        sure = confidence(state)
        rate, score = F.col("p_chosen_master_rate_hz"), F.col("p_hqscore")
        return rows.select(
            *contexts.columns, F.when(rate > 0, rounded(rate, 4)).alias("predicted_sampling_rate_hz"), rounded(clip(score), 4).alias("expected_hqscore"), F.lit(round(sure, 4)).alias("confidence"),
            (F.lit(sure >= threshold) & (rate > 0)).alias("used"), F.lit(state.model_version).alias("model_version"),
        )


def confidence(state: State) -> float:
    """0.4 of the rate's fit, 0.3 of the score's, 0.3 of the number of records; an unknown error is worthless."""
    fit = {t: 0.0 if (e := getattr(state, f"train_mae_{SHORT[t]}")) is None else max(0.0, 1 - min(1.0, e / WORST_ERROR[t])) for t in TARGETS}
    return min(1.0, max(0.0, 0.4 * fit["chosen_master_rate_hz"] + 0.3 * fit["hqscore"] + 0.3 * min(1.0, state.last_train_sample_count / ENOUGH)))


def confidence_column(rate_error: Column, score_error: Column, samples: Column) -> Column:
    """The same over columns."""
    fit = lambda e, t: F.coalesce(1 - F.least(F.lit(1.0), e / WORST_ERROR[t]), F.lit(0.0))
    return adaptive_confidence(fit(rate_error, "chosen_master_rate_hz"), fit(score_error, "hqscore"), samples, ENOUGH)


def trend(records: DataFrame, order: list[str], last: int = 30, width: int = 5) -> DataFrame:
    """job_index (from 1 over all records), hqscore and moving_avg of the latest ``last`` records.

    Only those and the ``width`` - 1 before them leave the tasks; the number of all records is a count.
    """
    latest = records.orderBy(*(F.desc(c) for c in order)).limit(last + width - 1).select("hqscore", *order)
    by = Window.orderBy(*(F.desc(c) for c in order))  # at most last + width - 1 rows
    rows = latest.select("*", F.row_number().over(by).alias("back"), F.avg("hqscore").over(by.rowsBetween(0, width - 1)).alias("moving"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    placed = rows.where(F.col("back") <= last).join(F.broadcast(total))  # one row
    return placed.select((F.col("total") - F.col("back") + 1).alias("job_index"), rounded(F.col("hqscore"), 4).alias("hqscore"), rounded(F.col("moving"), 4).alias("moving_avg"))
