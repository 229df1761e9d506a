"""Quality scores: missingness, similarity components of dataset pairs, the weighted score, tasks, confidence.

Scores are expressions over small aggregated frames, one row per participant; only the spectral, correlation and noise
kernels run in numpy, on blocks of a pair's whole signals.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions.columns import clip, confidence, magnitude
from sensorloom.operators import alignment, rates, signals

SENSORS = {"acc": ("acc_x", "acc_y", "acc_z"), "gyro": ("gyro_x", "gyro_y", "gyro_z")}
TOTAL_WEIGHT = sum(w for _, w, _ in registry.MODALITIES.values()) + 1e-9


def present(raw: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``has_<channel>`` of every channel of the frame: whether the group has any value of it."""
    return raw.groupBy(*keys).agg(*((F.count(c) > 0).alias("has_" + c) for c in raw.columns if c in registry.CHANNELS))


def modality_share(names, channels: set[str]) -> tuple[Column, Column]:
    """Missing share of a modality over the channels that the group has, 1 without any; and whether it has one.

    For aggregates over rows that carry ``has_<channel>``.
    """
    used = [c for c in names if c in channels]
    if not used:
        return F.lit(1.0), F.lit(False)
    has = {c: F.bool_or("has_" + c) for c in used}
    n = reduce(add, [has[c].cast("double") for c in used])
    missing = reduce(add, [F.when(has[c], F.avg(F.col(c).isNull().cast("double"))).otherwise(0.0) for c in used])
    return F.when(n > 0, missing / n).otherwise(1.0), n > 0


def integrity(fused: DataFrame, has: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missingness, coverage, n_modalities, missing_modalities and missing_percent (a map) of fused rows."""
    channels = {c for c in fused.columns if c in registry.CHANNELS}
    parts = {m: modality_share(names, channels) for m, (names, _, _) in registry.MODALITIES.items()}
    flat = fused.join(has, keys).groupBy(*keys).agg(*(x.alias(f"{kind}_{m}") for m, p in parts.items() for kind, x in zip(("miss", "there"), p, strict=True)))
    weights = {m: w for m, (_, w, _) in registry.MODALITIES.items()}
    total = lambda f: reduce(add, [f(m) for m in weights])
    return flat.select(
        *keys,
        (total(lambda m: weights[m] * F.col("miss_" + m)) / TOTAL_WEIGHT).alias("missingness"),
        (total(lambda m: weights[m] * F.col("there_" + m).cast("double")) / TOTAL_WEIGHT).alias("coverage"),
        total(lambda m: F.col("there_" + m).cast("int")).alias("n_modalities"),
        F.filter(F.array(*(F.when(~F.col("there_" + m), F.lit(m)) for m in weights)), lambda x: x.isNotNull()).alias("missing_modalities"),
        F.create_map(*(x for m in weights for x in (F.lit(m), F.round(100 * F.col("miss_" + m), 2)))).alias("missing_percent"),
    )


def pair_signals(rows: DataFrame, has: DataFrame, group: list[str], dataset: str = "dataset_id") -> DataFrame:
    """group, sensor, a, b, pos, x, y: magnitudes of every two datasets (a < b) that have all axes of a sensor.

    ``rows``: on a common grid, every time of which is taken. Absent axes count as 0.
    """
    stream = [*group, dataset]
    there = {s: axes for s, axes in SENSORS.items() if set(axes) <= set(rows.columns)}
    one = lambda s, axes: F.when(reduce(lambda p, q: p & q, [F.col("has_" + c) for c in axes]), F.struct(F.lit(s).alias("sensor"), magnitude(*(F.col(c) for c in axes), nulls="skip").alias("m")))
    found = F.filter(F.array(*(one(s, axes) for s, axes in there.items())), lambda x: x.isNotNull()) if there else F.array().cast("array<struct<sensor:string,m:double>>")
    long = rows.join(has, stream).select(*stream, "ts", F.explode(found).alias("s")).select(*stream, "ts", "s.sensor", "s.m")
    left = long.select(*group, "sensor", "ts", F.col(dataset).alias("a"), F.col("m").alias("x"))
    right = long.select(*group, "sensor", "ts", F.col(dataset).alias("b"), F.col("m").alias("y"))
    both = left.join(right, [*group, "sensor", "ts"]).where("a < b")
    return alignment.numbered(both, [*group, "sensor", "a", "b"]).select(*group, "sensor", "a", "b", "pos", "x", "y")


def kernel_scores(pairs: DataFrame, keys: list[str], keep: alignment.Keep = lambda frame: frame) -> DataFrame:
    """keys, n, spectral, coherence, frequency (similarity of the dominant ones), temporal, peak and snr of each pair.

    ``pairs`` carry rate_hz, one a pair, besides keys, x, y and pos from 0 to n - 1; all of a signal counts, whatever its length.
    """
    peaks = keep(signals.cross_correlation(pairs.select(*keys, "pos", "x", "y"), keys, absolute=True).select(*keys, "lag", clip(F.col("peak")).alias("peak")))
    found = keep(signals.waves(pairs, [*keys, "rate_hz"])).join(peaks, keys)
    n, rate = F.col("n"), F.col("rate_hz")
    known = (n >= 32) & (rate > 0)
    similar = F.exp(-F.abs(F.col("bin_x") - F.col("bin_y")) * rate / n / (rate / 12 + 1e-6))
    found = found.withColumns({"frequency": F.when(known, similar).otherwise(0.0), "coherence": F.when(known, clip(F.col("coherence"))).otherwise(0.5)})
    lag = F.when(F.col("peak") > 0, F.abs("lag")).otherwise(0)
    noise = 1 - F.least(F.lit(1.0), F.abs(F.log10(F.col("snr_x") + 1) - F.log10(F.col("snr_y") + 1)) / 2)
    return found.select(
        *keys, "n", F.when(known, 0.5 * F.col("frequency") + 0.5 * F.col("coherence")).otherwise(0.5).alias("spectral"), "coherence", "frequency",
        (0.75 * F.col("peak") + 0.25 / (1 + lag / F.greatest(F.lit(1.0), 0.05 * n))).alias("temporal"), "peak", noise.alias("snr"),
    )


RESULTS = ("n", "spectral", "coherence", "frequency", "temporal", "peak", "snr")


def components(pairs: DataFrame, group: list[str], least: int = 16, keep: alignment.Keep = lambda frame: frame) -> DataFrame:
    """group and the means over its pairs of at least ``least`` samples: distribution, kl, wasserstein, spectral, ...

    ``keep`` stores what each measure has found, a row a pair, so that no plan holds them all.
    """
    keys = [*group, "sensor", "a", "b"]
    shape = keep(signals.histogram_similarity(pairs, keys))
    distance = keep(signals.wasserstein(pairs, keys).select(*keys, "distance", "similarity"))
    each = kernel_scores(pairs, keys, keep).where(F.col("n") >= least).join(distance, keys).join(shape, keys, "left")
    each = each.withColumns({"kl": F.coalesce("kl", F.lit(0.0)), "kl_similarity": F.coalesce("kl_similarity", F.lit(1.0))})
    return each.groupBy(*group).agg(
        F.avg(0.5 * F.col("kl_similarity") + 0.5 * F.col("similarity")).alias("distribution"), F.avg("kl").alias("kl"), F.avg("distance").alias("wasserstein"),
        *(F.avg(c).alias(c) for c in RESULTS[1:]),
    )


#: Components of a group without pairs, and their limits where a dataset is too short.
DEFAULTS = {"distribution": 0.55, "spectral": 0.5, "temporal": 0.5, "snr": 0.5, "kl": 0.0, "wasserstein": 0.0, "coherence": 0.0, "frequency": 0.0, "peak": 0.0}
SHORT_LIMITS = {"spectral": 0.5, "temporal": 0.55, "snr": 0.5}


def profile_of(task: Column, profile: Column) -> Column:
    """The weight profile by words of the task, or by its name."""
    task, profile = F.lower(F.coalesce(task, F.lit(""))), F.lower(F.coalesce(profile, F.lit("")))
    return (
        F.when(task.contains("human activity") | task.contains("gait") | (profile == "temporal_spectral"), "temporal_spectral")
        .when(task.contains("driving") | (profile == "stability_temporal"), "stability_temporal")
        .when(task.contains("health") | (profile == "missingness_stability"), "missingness_stability")
        .when(task.contains("environment") | (profile == "distribution_coverage"), "distribution_coverage")
        .otherwise("default")
    )


def with_score(rows: DataFrame) -> DataFrame:
    """``stability_factor`` and ``hqscore`` of rows with the components, missingness, coverage, stability, profile, limited and short."""
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    filled = filled.withColumns({c: F.when(F.col("short"), F.least(F.col(c), F.lit(v))).otherwise(F.col(c)) for c, v in SHORT_LIMITS.items()})
    filled = filled.withColumn("stability_factor", clip(0.7 * F.col("stability") + 0.3 * F.col("snr"))).withColumn("profile", F.when(F.col("limited"), "limited_modality").otherwise(F.col("profile")))
    parts = [F.col("distribution"), F.col("spectral"), F.col("temporal"), 1 - F.col("missingness"), F.col("coverage"), F.col("stability_factor")]
    score = lambda w: reduce(add, [x * p for x, p in zip(w, parts, strict=True)])
    by_profile = reduce(lambda c, kv: c.when(F.col("profile") == kv[0], score(kv[1])), registry.WEIGHTS.items(), F)
    return filled.withColumn("hqscore", F.round(clip(by_profile.otherwise(score(registry.WEIGHTS["default"]))), 4))


def divergence(rows: DataFrame, group: list[str], dataset: str = "dataset_id") -> DataFrame:
    """group and divergence: over dataset pairs and channels with three common rows, the mean gap of means in spreads."""
    channels = [c for c in rows.columns if c in registry.CHANNELS]
    side = lambda name, v: rows.select(*group, "ts", F.col(dataset).alias(name), *(F.col(c).cast("double").alias(f"{v}_{c}") for c in channels))
    both = side("a", "x").join(side("b", "y"), [*group, "ts"]).where("a < b")

    def gap(c: str) -> Column:
        """How far apart the channel's values are where both datasets have one; nothing for less than three."""
        there = F.col(f"x_{c}").isNotNull() & F.col(f"y_{c}").isNotNull()
        x, y = (F.when(there, F.col(f"{v}_{c}")) for v in "xy")
        size = F.abs(F.avg(x) - F.avg(y)) / (F.stddev_pop(x) + F.stddev_pop(y) + 1e-9)
        return F.when(F.count(x) >= 3, F.least(F.lit(1.0), size / 3))

    each = both.groupBy(*group, "a", "b").agg(F.array_compact(F.array(*map(gap, channels))).alias("gaps")).select(*group, F.explode("gaps").alias("gap"))
    return each.groupBy(*group).agg(F.round(F.avg("gap"), 4).alias("divergence"))


def confidence_reason(score: Column, missing: Column, gap: Column, drift: Column) -> Column:
    return F.format_string("HQScore=%.3f, missing modalities=%d, distribution divergence=%.3f, drift=%s.", score, missing, gap, drift)


def resampling_strategy(rate: Column, master: Column) -> Column:
    kind = F.when(rate > master + 1e-6, "downsample").when(rate < master - 1e-6, "upsample").otherwise("native-rate alignment")
    return F.concat(kind, F.lit(" + modality interpolation"))


def gated_rate(requested: float | None | Column, least: Column, most: Column, master: Column) -> Column:
    """The requested rate if it is sane against those found, else the master rate; null: none is requested."""
    if requested is None:
        return master
    rate = requested if isinstance(requested, Column) else F.lit(float(requested))
    return F.when((rate > 0) & rate.between(F.greatest(F.lit(0.5), 0.5 * least), 2 * most), rate).otherwise(master)


def task_scores() -> dict[str, Column]:
    """Points of each task from has_acc, has_gyro, has_gps, has_hr, has_env, rate_hz, duration_seconds, variance. Fixed values."""
    acc, gyro, gps, hr, env = (F.col("has_" + x) for x in ("acc", "gyro", "gps", "hr", "env"))
    rate, long, variance = F.col("rate_hz"), F.col("duration_seconds"), F.col("variance")
    p = lambda condition, points: F.when(condition, points).otherwise(0.0)
    both = acc & gyro
    points = {
        "Human Activity Recognition": [p(both, 0.35), p(both & rate.between(20, 120), 0.25), p(both & (long <= 4 * 3600), 0.08)],
        "Gait Analysis": [p(acc & rate.between(40, 200), 0.30), p(acc & rate.between(40, 200) & (variance >= 0.2), 0.12)],
        "Free-living Monitoring": [p(both & (long >= 3 * 3600), 0.26), p(long >= 8 * 3600, 0.15)],
        "Driving Behavior": [p(gps, 0.22), p(gps & rate.between(5, 30), 0.14), p(gps & both, 0.12)],
        "Health Monitoring": [p(hr, 0.28), p(hr & (long >= 30 * 60), 0.16), p(hr & acc, 0.10)],
        "Environmental Sensing": [p(env, 0.30), p(env & (rate <= 5), 0.18), p(env & ~(acc | gyro), 0.12)],
    }
    return {task: reduce(add, parts, F.lit(0.05)) for task, parts in points.items()}


def with_task(rows: DataFrame) -> DataFrame:
    """``task``, ``task_confidence``, ``window_seconds``, ``task_rate_hz`` and ``task_profile`` of rows with what ``task_scores`` asks for."""
    ranked = F.sort_array(F.array(*(F.struct(F.round(s, 9).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("task")) for i, (t, s) in enumerate(task_scores().items()))), asc=False)
    rows = rows.withColumn("_ranked", ranked)
    best, second = F.col("_ranked")[0], F.col("_ranked")[1]["score"]
    known = best["score"] >= 0.2
    rows = rows.withColumn("task", F.when(known, best["task"]).otherwise("Unknown"))
    sure = F.least(F.lit(0.97), 0.45 + 0.35 * best["score"] + 0.3 * (best["score"] - second))
    rows = rows.withColumn("task_confidence", F.when(known, F.round(sure, 4)).otherwise(0.3)).drop("_ranked")
    pick = lambda k: reduce(lambda c, kv: c.when(F.col("task") == kv[0], F.lit(kv[1][k])), registry.TASKS.items(), F)
    return rows.withColumns({"window_seconds": pick(0), "task_rate_hz": pick(1), "task_profile": pick(2).otherwise("balanced")})


def variance_score(columns: list[str]) -> Column:
    """An aggregate: tanh of a fifth of the median population variance of the columns."""
    spread = F.array_compact(F.array(*(F.var_pop(c) for c in columns)))
    ordered, n = F.sort_array(spread), F.size(spread)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.coalesce(clip(F.tanh(middle / 5)), F.lit(0.0))


def role_missingness(columns: list[str]) -> Column:
    """An aggregate: completeness of core sensors (acceleration, gyroscope) and of all other columns, 0.7 to 0.3."""
    core = [c for c in columns if c.startswith(("acc", "gyro"))]
    other = [c for c in columns if c not in core]
    full = lambda names: reduce(add, [F.avg(F.col(c).isNotNull().cast("double")) for c in names]) / len(names)
    return 0.7 * full(core) + 0.3 * (full(other) if other else F.lit(1.0)) if core else F.lit(1.0)


def physics(mean_magnitude: Column, sensor: str) -> Column:
    """How plausible a mean magnitude is. Fixed values."""
    if sensor == "acc":
        return F.when(mean_magnitude.between(8.5, 11.5), 1.0).when(mean_magnitude.between(0.8, 1.2), 0.7).otherwise(0.3)
    return F.when(mean_magnitude < 5, 1.0).when(mean_magnitude < 20, 0.7).otherwise(0.3)


def hq_score(missingness: Column, sampling: Column, distribution: Column, acc: Column, gyro: Column) -> Column:
    """The observer's score of one dataset. Fixed values."""
    return F.round(0.30 * missingness + 0.20 * sampling + 0.20 * distribution + 0.20 * acc + 0.10 * gyro, 4)


def observed(frame: DataFrame, keys: list[str], ts: str = "ts", distribution: float | Column = 1.0) -> DataFrame:
    """keys and hq_score of each dataset by itself: completeness by role, regularity of its gaps, the given similarity of
    its distributions (1 for its own), plausibility of acceleration and rotation; 1 for what it does not have."""
    channels = [c for c in frame.columns if c in registry.CHANNELS]

    def plausible(sensor: str) -> Column:
        axes = SENSORS[sensor]
        if not set(axes) <= set(channels):
            return F.lit(1.0)
        mean = F.avg(magnitude(*(F.col(a) for a in axes)))
        return F.coalesce(F.when(mean.isNotNull(), physics(mean, sensor)), F.lit(0.3))

    gaps = rates.with_gap(frame, keys, ts)
    regular = F.when(F.count(ts) < 3, 1.0).otherwise(1 / (1 + F.var_pop("gap")))
    similar = F.lit(distribution) if isinstance(distribution, float) else distribution
    return gaps.groupBy(*keys).agg(role_missingness(channels).alias("_full"), regular.alias("_regular"), plausible("acc").alias("_acc"), plausible("gyro").alias("_gyro")).select(
        *keys, hq_score(F.col("_full"), F.col("_regular"), similar, F.col("_acc"), F.col("_gyro")).alias("hq_score")
    )


def v3_score(columns: list[str]) -> Column:
    """An aggregate: completeness and mean sample variance of all columns, 0.6 to 0.4; 0 without rows."""
    full = reduce(add, [F.avg(F.col(c).isNotNull().cast("double")) for c in columns]) / len(columns)
    spread = F.array_compact(F.array(*(F.var_samp(c) for c in columns)))
    mean = F.aggregate(spread, F.lit(0.0), add) / F.size(spread)
    return F.coalesce(F.round(0.6 * full + 0.4 * F.coalesce(F.least(F.lit(1.0), mean / 100), F.lit(0.5)), 4), F.lit(0.0))


__all__ = ["components", "confidence", "confidence_reason", "divergence", "gated_rate", "hq_score", "integrity", "pair_signals", "physics", "present", "profile_of", "resampling_strategy", "role_missingness", "v3_score", "variance_score", "with_score", "with_task"]
