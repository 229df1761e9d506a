"""Fusion of two to four datasets per participant: rates, offsets, grid, resampling, mean, drift, score, report.

Plans over the long layout keyed by (participant, dataset); a participant is a partition key, not a loop. Frames that
several steps read are stored as Parquet in the shared folder, and ``Fusion.close`` deletes them. What reaches the driver is one report row per participant, if it is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.lineage import cut, drop, mark
from sensorloom.functions.columns import confidence, magnitude, seconds
from sensorloom.operators import agent, alignment, rates, resample, scoring
from sensorloom.registry import HarmonizeError

STREAM = ["participant_id", "dataset_id"]
KEY = ["participant_id"]


@dataclass
class Fusion:
    """``fused``: participant_id, ts, channels. ``report``: a row per participant. ``trend``: lags of sliding windows.
    ``actions``: corrections that were tried and taken before, None without a policy."""

    fused: DataFrame
    report: DataFrame
    trend: DataFrame
    resampled: DataFrame
    actions: DataFrame | None = None
    _stored: tuple[SparkSession, int, int] | None = None
    _first: Row | None = None

    def close(self) -> None:
        """Deletes what the fusion has stored; its frames cannot be read after that."""
        if self._stored:
            drop(*self._stored)

    @property
    def first(self) -> Row:
        """The report of the least participant."""
        if self._first is None:
            self._first = self.report.orderBy("participant_id").limit(1).head()
        return self._first

    @property
    def rates(self) -> dict[str, float]:
        return {d.dataset_id: d.sampling_rate_hz for d in self.first.datasets}

    @property
    def master_rate(self) -> float:
        return self.first.master_rate_hz

    @property
    def missingness(self) -> float:
        return round(self.first.missingness, 6)

    @property
    def coverage(self) -> float:
        return round(self.first.coverage, 6)

    @property
    def score(self) -> float:
        return self.first.hqscore

    @property
    def warnings(self) -> list[str]:
        return list(self.first.warnings)


def matched(slots: list[DataFrame]) -> DataFrame:
    """All slots as one frame, with the participants that are in two slots or more.

    If no participant is in two slots, all are one, ``global``: of its rows with equal times, the first known values.
    """
    frame = slots[0]
    for other in slots[1:]:
        frame = frame.unionByName(other, allowMissingColumns=True)
    shared = frame.select(*STREAM).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
    if not shared.isEmpty():
        return frame.join(shared, KEY, "left_semi")
    channels = [c for c in frame.columns if c in registry.CHANNELS]
    return resample.first_known(frame, ["dataset_id", "ts"], channels, ["participant_id"]).withColumn("participant_id", F.lit("global"))


def streams_of(frame: DataFrame) -> DataFrame:
    """One row a stream, in one pass: rate, ends, duration, variance, and ``has_<channel>`` of every channel."""
    channels = [c for c in frame.columns if c in registry.CHANNELS]
    rows = rates.with_gap(frame, STREAM).groupBy(*STREAM).agg(
        rates.rate_of_gaps().alias("rate_hz"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        scoring.variance_score(channels).alias("variance"), *((F.count(c) > 0).alias("has_" + c) for c in channels),
    )
    return rows.withColumn("duration_seconds", F.round(seconds(F.col("last_ts")) - seconds(F.col("first_ts")), 3))


def master_of(streams: DataFrame, target_rate: float | DataFrame | None) -> DataFrame:
    """By participant the master rate, the spread flag and whether a requested rate was taken."""
    positive = F.when(F.col("rate_hz") > 0, F.col("rate_hz"))
    found = streams.groupBy(*KEY).agg(F.coalesce(F.min(positive), F.lit(10.0)).alias("auto"), F.min(positive).alias("least"), F.max(positive).alias("most"), F.stddev_pop("rate_hz").alias("spread"))
    if isinstance(target_rate, DataFrame):
        found = found.join(target_rate.select(*KEY, "target_rate_hz"), KEY, "left")
    else:
        found = found.withColumn("target_rate_hz", F.lit(target_rate).cast("double"))
    chosen = found.withColumn("rate_hz", scoring.gated_rate(F.col("target_rate_hz"), F.col("least"), F.col("most"), F.col("auto")))
    applied = F.coalesce(F.col("rate_hz") == F.col("target_rate_hz"), F.lit(False))
    return chosen.select(*KEY, "rate_hz", (F.col("spread") > F.greatest(F.lit(0.05), 0.15 * F.col("rate_hz"))).alias("rate_drift"), applied.alias("requested_applied"))


def together(frames: list[DataFrame]) -> DataFrame:
    """Frames of at most one row a participant side by side: one shuffle for all of them, not one join each."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy(*KEY).agg(*(F.any_value(c, F.lit(True)).alias(c) for c in rows.columns if c not in KEY))


def fuse(slots: list[DataFrame], target_rate: float | DataFrame | None = None, task: str | None = None, policy: agent.Policy | None = agent.Policy()) -> Fusion:
    """``slots``: frames with participant_id, dataset_id, ts and channels, one per dataset; the base is the least dataset_id.

    ``target_rate``: taken as the common rate if it is sane for a participant's streams; a frame (participant_id,
    target_rate_hz) has one for each. ``task``: sets the weights of
    the score; else each participant's inferred task does. ``policy``: of the corrections before fusion, none for None.
    Raises if no participant's datasets overlap in time.
    """
    if not 2 <= len(slots) <= 4:
        raise HarmonizeError("invalid_dataset_count", f"{len(slots)} datasets, 2 to 4 can be fused")
    began = mark()
    frame = cut(matched(slots).withColumn("ts", F.col("ts").cast("timestamp")), "fuse-rows")
    corrected = agent.correct(frame, policy) if policy else None
    frame = corrected.frame if corrected else frame
    channels = [c for c in frame.columns if c in registry.CHANNELS]
    streams = cut(streams_of(frame), "fuse-streams")
    master = master_of(streams, target_rate)
    moves = alignment.offsets(frame, master, keep=lambda pairs: cut(pairs, "fuse-pairs")).select(*STREAM, "offset_seconds")
    # A stream moves as a whole, and so do its ends.
    shift = F.round(F.coalesce("offset_seconds", F.lit(0.0)) * 1e6).cast("long")
    moved = lambda c: F.timestamp_micros(F.unix_micros(c) + shift)
    streams = cut(streams.join(moves, STREAM, "left").withColumns({"start_ts": moved("first_ts"), "end_ts": moved("last_ts")}), "fuse-streams")
    spans = streams.groupBy(*KEY).agg(F.max("start_ts").alias("overlap_start"), F.min("end_ts").alias("overlap_end"), F.count(F.lit(1)).alias("n"))
    spans = cut(spans.where((F.col("n") > 1) & (F.col("overlap_start") <= F.col("overlap_end"))).join(master, KEY), "fuse-spans")
    if spans.isEmpty():
        raise HarmonizeError("no_time_overlap", "the datasets have no time in common")
    step = F.greatest(F.lit(1), F.floor(1000 / F.col("rate_hz"))) * 1000
    points = resample.blocked_grid(spans.select(*KEY, "overlap_start", "overlap_end", "rate_hz"), KEY, step).join(streams.select(*STREAM), KEY)
    aligned = alignment.shifted(frame.select(*STREAM, "ts", *channels), streams)
    rows = resample.on_grid(points, aligned, STREAM)
    rows = cut(resample.filled(rows, STREAM, {c: registry.INTERPOLATION[c] for c in channels}), "fuse-rows")
    has = streams.select(*STREAM, *(c for c in streams.columns if c.startswith("has_")))
    fused = resample.fused(rows, KEY, channels)
    trend = cut(lags(rows, has, master), "fuse-trend")
    done = reported(rows, fused, has, streams, spans, trend, task)
    if corrected:
        told = corrected.summary.select(*KEY, F.struct("used", "iterations", "initial_score", "final_score", "net_improvement", "confidence", "stop_reason").alias("corrections"))
        said = F.when(F.col("corrections.used"), F.array(F.format_string("Corrections applied %d action(s).", "corrections.iterations"))).otherwise(F.array().cast("array<string>"))
        done = done.join(told, KEY, "left").withColumn("warnings", F.concat("warnings", F.coalesce(said, F.array().cast("array<string>"))))
    return Fusion(fused, cut(done, "fuse-report"), trend, rows, corrected.actions if corrected else None, (frame.sparkSession, began, mark()))


def lags(rows: DataFrame, has: DataFrame, master: DataFrame) -> DataFrame:
    """Windows of each dataset against its participant's base, by acceleration."""
    axes = scoring.SENSORS["acc"]
    schema = f"participant_id {rows.schema['participant_id'].dataType.simpleString()}, dataset_id {rows.schema['dataset_id'].dataType.simpleString()}, idx long, mid timestamp, offset_seconds double, strength double, warp double"
    if not set(axes) <= set(rows.columns):
        return rows.sparkSession.createDataFrame([], schema)
    whole = has.where(" and ".join("has_" + c for c in axes)).select(*STREAM)
    m = magnitude(*(F.col(a) for a in axes), nulls="skip")
    signal = alignment.numbered(rows.join(whole, STREAM, "left_semi").select(*STREAM, "ts", m.alias("m")), STREAM)
    # Without acceleration in a participant's first dataset there is nothing to compare with.
    base = has.groupBy(*KEY).agg(F.min("dataset_id").alias("_base"))
    pairs = alignment.star_pairs(signal, KEY, base=base)
    return alignment.window_lags(pairs.join(master.select(*KEY, "rate_hz"), KEY), STREAM, keep=lambda frame: cut(frame, "fuse-pairs"))


def context(streams: DataFrame) -> DataFrame:
    """What task inference asks for: means over a participant's datasets of rate, duration and variance."""
    there = {c.removeprefix("has_") for c in streams.columns if c.startswith("has_")}
    flags = {"acc": ["accelerometer"], "gyro": ["gyroscope"], "gps": ["gps"], "hr": ["heart_rate"], "env": ["barometer", "light", "proximity"]}
    used = {k: [c for m in modalities for c in registry.MODALITIES[m][0] if c in there] for k, modalities in flags.items()}
    any_of = lambda names: F.greatest(*(F.bool_or("has_" + c) for c in names), F.lit(False)) if names else F.lit(False)
    return streams.groupBy(*KEY).agg(F.avg("rate_hz").alias("rate_hz"), F.avg("duration_seconds").alias("duration_seconds"), F.avg("variance").alias("variance"), *(any_of(names).alias("has_" + k) for k, names in used.items()))


def reported(rows, fused, has, streams, spans, trend, task: str | None) -> DataFrame:
    """One row per participant: rates, offsets, integrity, components, drift, score, confidence, warnings."""
    flags = [c for c in has.columns if c.startswith("has_")]
    has_any = has.groupBy(*KEY).agg(*(F.bool_or(c).alias(c) for c in flags))
    n_modalities = scoring.integrity(fused, has_any, KEY)
    pairs = scoring.pair_signals(rows, has, KEY).join(spans.select(*KEY, "rate_hz"), KEY)
    # With one modality only acceleration is compared: rotation counts where its participant has any other.
    sensors = {m: [f"has_{c}" for c in names if f"has_{c}" in flags] for m, (names, _, _) in registry.MODALITIES.items()}
    kinds = reduce(add, [F.greatest(*(F.bool_or(c).cast("int") for c in names), F.lit(0)) for names in sensors.values() if names], F.lit(0))
    several = has.groupBy(*KEY).agg(kinds.alias("kinds")).where("kinds > 1").select(*KEY, F.lit("gyro").alias("sensor"))
    allowed = several.unionByName(has.select(*KEY, F.lit("acc").alias("sensor")).distinct())
    # Stored by parts, of a row a participant: what is left of a plan is planned anew after each of its stages.
    part = lambda frame: cut(frame, "fuse-parts")
    scores = part(scoring.components(cut(pairs.join(allowed, [*KEY, "sensor"], "left_semi"), "fuse-pairs"), KEY, keep=part))
    gaps = part(scoring.divergence(rows, KEY).join(n_modalities, KEY, "full"))
    axes = [c for c in scoring.SENSORS["acc"] if "has_" + c in flags]
    base_acc = F.min_by(F.expr(" and ".join("has_" + c for c in axes)) if len(axes) == 3 else F.lit(False), "dataset_id")
    sizes = spans.select(*KEY, "overlap_start", "overlap_end", (F.col("overlap_start") == F.col("overlap_end")).alias("short"), "rate_hz", "rate_drift", "requested_applied")
    tasks = scoring.with_task(context(streams)).select(*KEY, "task", "task_confidence", "task_profile")
    datasets = streams.join(spans.select(*KEY, F.col("rate_hz").alias("master_rate_hz")), KEY).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(  # at most four
        "dataset_id", F.col("rate_hz").alias("sampling_rate_hz"), "duration_seconds", "start_ts", "end_ts", F.round(F.coalesce("offset_seconds", F.lit(0.0)), 4).alias("offset_seconds"),
        scoring.resampling_strategy(F.col("rate_hz"), F.col("master_rate_hz")).alias("resampling_strategy"),
    ))).alias("datasets"), base_acc.alias("base_acc"))
    out = together([sizes, datasets, tasks, scores, gaps, alignment.drift_summary(trend, KEY).drop("strength")]).where("overlap_start is not null")
    out = part(out)
    # Stability where drift cannot be told.
    unknown = F.when(F.col("short"), 0.7).when(~F.col("base_acc"), 0.6).otherwise(0.7)
    out = out.withColumns({
        "stability": F.when(F.col("short"), 0.7).otherwise(F.coalesce("stability", unknown)),
        "drift": F.when(F.col("short"), "none").otherwise(F.coalesce("drift", F.lit("none"))),
        "limited": F.col("n_modalities") <= 1,
        "divergence": F.coalesce("divergence", F.lit(0.0)),
        "task": F.lit(task) if task else F.col("task"),
    })
    out = scoring.with_score(out.withColumn("profile", scoring.profile_of(F.col("task"), F.lit("") if task else F.col("task_profile"))))
    return out.select(
        *KEY, F.col("rate_hz").alias("master_rate_hz"), "requested_applied", "datasets", "overlap_start", "overlap_end",
        F.round(seconds(F.col("overlap_end")) - seconds(F.col("overlap_start")), 3).alias("overlap_seconds"),
        (F.col("rate_drift") | (F.col("drift") != "none")).alias("drift_detected"), F.col("drift").alias("drift_type"), "mean_offset", "slope", "warp", "stability",
        *scoring.DEFAULTS, "missingness", "coverage", "stability_factor", "missing_modalities", "missing_percent", "divergence", "task", "task_confidence", "profile", "hqscore",
        confidence(F.col("hqscore")).alias("confidence"),
        scoring.confidence_reason(F.col("hqscore"), F.size("missing_modalities"), F.col("divergence"), F.col("drift")).alias("reason"),
        F.array_compact(F.array(F.when(F.col("limited"), F.lit("Limited modality available.")))).alias("warnings"),
    )


#: Warnings that a roll-up shows.
SHOWN = 25


def rolled_up(report: DataFrame) -> DataFrame:
    """All participants as one row: mean scores and rates, the worst drift, whether any drifts, accepted corrections.

    Warnings are told once each, in the order in which the participants first have them, ``SHOWN`` at most.
    """
    worst = F.when(F.col("drift_type") == "significant", 2).when(F.col("drift_type") == "minor", 1).otherwise(0)
    accepted = F.col("corrections.iterations") if "corrections" in report.columns else F.lit(None).cast("long")
    sums = report.agg(
        F.count(F.lit(1)).alias("participants"), F.round(F.avg("hqscore"), 4).alias("hqscore"), F.round(F.avg("master_rate_hz"), 4).alias("master_rate_hz"),
        *(F.round(F.avg(c), 4).alias(c) for c in ("distribution", "spectral", "temporal", "missingness", "coverage", "stability_factor")),
        *(F.round(F.avg(c), 6).alias(c) for c in ("kl", "wasserstein", "coherence", "frequency", "peak", "snr")),
        F.max_by("drift_type", worst).alias("drift_type"), F.bool_or("drift_detected").alias("drift_detected"), F.coalesce(F.sum(accepted), F.lit(0)).alias("iterations"),
    )
    each = report.select(*KEY, F.posexplode("warnings").alias("_at", "warning")).groupBy("warning").agg(F.min(F.struct(*KEY, "_at")).alias("first"))  # a row a text
    told = each.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "warning"))), lambda x: x["warning"]), 1, SHOWN).alias("warnings"))
    one = F.lit(1).alias("_one")
    return sums.select("*", one).join(told.select("*", one), "_one").drop("_one")  # a row each


def hqscore(distribution: float, spectral: float, temporal: float, missingness: float, coverage: float, stability: float, profile: str = "default") -> float:
    """The weighted score; ``missingness`` is the penalty."""
    parts = (distribution, spectral, temporal, 1 - missingness, coverage, stability)
    return min(1.0, max(0.0, sum(w * p for w, p in zip(registry.WEIGHTS[profile], parts, strict=True))))
