"""Greedy correction of datasets before they are fused: propose, score every proposal, take the best, at most three times.

All participants are corrected together. A round is one pass over the rows, which gives for each stream (participant,
dataset) what proposals need (means, spreads, noise) and, for every channel, how much would be missing with and without
smoothing. Proposals and their scores are then expressions over one row a stream; the best one of each participant is
kept if the score rises by ``least_gain``. Rows are written again only in rounds that keep a proposal.

The score of a stream is the fusion's score of that dataset alone: without a second one, the similarities are constants,
and what counts is what is missing. So scaling and inverting are proposed and never taken; smoothing is, if it fills gaps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions.columns import clip, magnitude, unit_of
from sensorloom.lineage import cut
from sensorloom.operators import decisions, resample, scoring

STREAM, KEY = ["participant_id", "dataset_id"], ["participant_id"]
# Channels that are looked at for noise; factor from g to m/s2; least values for a mean and for a noise ratio.
NOISY = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z", "heart_rate", "pressure", "light_lux", "gps_speed")
GRAVITY, LEAST_FOR_MEAN, LEAST_FOR_NOISE = 9.81, 10, 50
CANDIDATE = "struct<kind:string,columns:array<string>,factor:double,action_id:string,rationale:string>"


@dataclass(frozen=True)
class Policy:
    """Rounds, least gain, rows that a score looks at, noise from which smoothing is proposed, its width."""

    rounds: int = 3
    least_gain: float = 0.002
    score_rows: int = 50_000
    noise_ratio: float = 1.35
    width: int = 5
    most_columns: int = 6


@dataclass
class Corrected:
    """``frame``: the rows after all accepted actions. ``actions``: every proposal with its gain and whether it was
    taken. ``summary``: a row a participant."""

    frame: DataFrame
    actions: DataFrame
    summary: DataFrame


def statistics(frame: DataFrame, policy: Policy = Policy(), order: str = "ts") -> DataFrame:
    """One row a stream: for each channel n, mean, noise, and the missing share of scored rows now and once smoothed."""
    channels = [c for c in frame.columns if c in registry.CHANNELS]
    noisy = [c for c in NOISY if c in channels]
    by = Window.partitionBy(*STREAM).orderBy(order)
    near = by.rowsBetween(-(policy.width // 2), policy.width // 2)
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = frame.select(
        *STREAM, *channels, (F.row_number().over(by) - 1).alias("_pos"), F.count(F.lit(1)).over(Window.partitionBy(*STREAM)).alias("_size"),
        *((F.col(c) - F.last(c, ignorenulls=True).over(earlier)).alias(f"_step_{c}") for c in noisy), *((F.count(c).over(near) == 0).alias(f"_gap_{c}") for c in noisy),
    )
    scored = F.col("_pos") % F.greatest(F.lit(1), F.ceil(F.col("_size") / policy.score_rows)) == 0
    share = lambda missing: F.avg(F.when(scored, missing.cast("double")))
    axes = scoring.SENSORS["acc"]
    length = F.avg(magnitude(*(F.col(a) for a in axes))) if set(axes) <= set(channels) else F.lit(None).cast("double")
    return rows.groupBy(*STREAM).agg(
        length.alias("length"), *(F.count(c).alias(f"n_{c}") for c in channels), *(F.avg(c).alias(f"mean_{c}") for c in channels), *(share(F.col(c).isNull()).alias(f"miss_{c}") for c in channels),
        *(share(F.col(f"_gap_{c}")).alias(f"smooth_{c}") for c in noisy), *(F.stddev_pop(c).alias(f"spread_{c}") for c in noisy),
        *((F.stddev_pop(f"_step_{c}") / (F.stddev_pop(c) + 1e-9)).alias(f"noise_{c}") for c in noisy),
    )


def proposals(stats: DataFrame, policy: Policy = Policy()) -> Column:
    """The proposals for a stream, an array of ``CANDIDATE`` in the order in which equal gains are preferred."""
    channels = {c.removeprefix("miss_") for c in stats.columns if c.startswith("miss_")}
    made = lambda kind, columns, factor, tag, why: F.struct(
        F.lit(kind).alias("kind"), columns.alias("columns"), F.lit(factor).cast("double").alias("factor"), F.concat_ws(":", F.lit(kind), "dataset_id", tag).alias("action_id"), why.alias("rationale")
    )
    out = []
    axes = scoring.SENSORS["acc"]
    if set(axes) <= channels:
        why = F.format_string("mean acceleration %.3f looks like g", "length")
        out.append(F.when(unit_of(F.col("length")) == "g", made("scale", F.array(*map(F.lit, axes)), GRAVITY, F.lit(str(GRAVITY)), why)))
    for sensor, limit in registry.AXIS_LIMITS.items():
        axes = [f"{sensor}_{a}" for a in "xyz"]
        if set(axes) <= channels:
            top = F.array_max(F.array(*(F.struct(F.abs(f"mean_{c}").alias("size"), F.lit(-i).alias("order"), F.lit(c).alias("axis"), F.col(f"mean_{c}").alias("mean")) for i, c in enumerate(axes))))
            fits = (F.least(*(F.col(f"n_{c}") for c in axes)) >= LEAST_FOR_MEAN) & (top["mean"] < 0) & (top["size"] >= limit)
            out.append(F.when(fits, made("invert", F.array(top["axis"]), -1.0, top["axis"], F.format_string("mean of %s is %.3f", top["axis"], top["mean"]))))
    noisy = [c for c in NOISY if c in channels]
    if noisy:
        loud = lambda c: (F.col(f"n_{c}") >= LEAST_FOR_NOISE) & (F.col(f"spread_{c}") > 1e-9) & (F.col(f"noise_{c}") >= policy.noise_ratio)
        ranked = F.sort_array(F.array_compact(F.array(*(F.when(loud(c), F.struct(F.col(f"noise_{c}").alias("noise"), F.lit(c).alias("c"))) for c in noisy))), asc=False)
        chosen = F.slice(ranked, 1, policy.most_columns)["c"]
        tag = F.concat_ws("_", F.slice(chosen, 1, 2), F.lit(str(policy.width)))
        out.append(F.when(F.size(ranked) > 0, made("smooth", chosen, policy.width, tag, F.concat(F.size(chosen).cast("string"), F.lit(" noisy channels")))))
    return F.array_compact(F.array(*(x.cast(CANDIDATE) for x in out))) if out else F.array().cast(f"array<{CANDIDATE}>")


def score_of(stats: DataFrame, smoothed: Column) -> Column:
    """The score of one stream alone, with the channels of the array ``smoothed`` as if they were smoothed."""
    weights, default = dict(zip(registry.COMPONENTS, registry.WEIGHTS["default"], strict=True)), scoring.DEFAULTS
    missing, covered = [], []
    for names, weight, _ in registry.MODALITIES.values():
        used = [c for c in names if f"miss_{c}" in stats.columns]
        if not used:
            missing.append(F.lit(weight))
            continue
        share = lambda c: F.when(F.array_contains(smoothed, c), F.col(f"smooth_{c}")).otherwise(F.col(f"miss_{c}")) if f"smooth_{c}" in stats.columns else F.col(f"miss_{c}")
        has = {c: F.col(f"n_{c}") > 0 for c in used}
        n = reduce(add, [x.cast("double") for x in has.values()])
        total = reduce(add, [F.when(has[c], share(c)).otherwise(0.0) for c in used])
        missing.append(weight * F.when(n > 0, total / n).otherwise(1.0))
        covered.append(weight * (n > 0).cast("double"))
    stable = 0.7 + 0.3 * default["snr"]
    alone = sum(weights[c] * default[c] for c in ("distribution", "spectral", "temporal")) + weights["stability"] * stable
    whole = weights["missingness"] * (1 - reduce(add, missing) / scoring.TOTAL_WEIGHT) + weights["coverage"] * reduce(add, covered, F.lit(0.0)) / scoring.TOTAL_WEIGHT
    return F.round(clip(F.lit(alone) + whole), 4)


def scored(stats: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """participant_id, dataset_id, place, the proposal's fields, score_before, score_after and gain of its participant.

    Streams without proposals have one row without place, so that every participant is there.
    """
    rows = stats.withColumns({"own": score_of(stats, F.array().cast("array<string>")), "found": proposals(stats, policy)})
    whole = Window.partitionBy(*KEY)
    rows = rows.withColumns({"score_before": F.avg("own").over(whole), "streams": F.count(F.lit(1)).over(whole)})
    each = rows.select("*", F.posexplode_outer("found").alias("place", "p"))
    smoothed = F.when(F.col("p.kind") == "smooth", F.col("p.columns")).otherwise(F.array().cast("array<string>"))
    after = F.col("score_before") + (score_of(stats, smoothed) - F.col("own")) / F.col("streams")
    return each.select(*STREAM, "place", "p.*", "score_before", after.alias("score_after")).withColumn("gain", F.round(F.col("score_after") - F.col("score_before"), 9))


def best_of(candidates: DataFrame) -> DataFrame:
    """``taken`` on the candidates: whether each is its participant's best; of equal gains the first."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("gain"), "dataset_id", "place"))
    return candidates.withColumn("rank", first)


def changed(frame: DataFrame, accepted: DataFrame, policy: Policy = Policy(), order: str = "ts") -> DataFrame:
    """The frame with one accepted action a participant applied: scaled, inverted or smoothed channels."""
    channels = [c for c in frame.columns if c in registry.CHANNELS]
    act = accepted.select(*STREAM, F.col("kind").alias("_kind"), F.col("columns").alias("_columns"), F.col("factor").alias("_factor"))
    rows = frame.join(act, STREAM, "left")
    smoothed = {r[0] for r in accepted.where("kind = 'smooth'").select(F.explode("columns")).distinct().collect()}  # names of channels
    noisy = [c for c in NOISY if c in channels and c in smoothed]
    rows = rows.select("*", *(resample.rolling_median(c, STREAM, order, policy.width).alias(f"_m_{c}") for c in noisy))

    def new(c: str) -> Column:
        other = F.when(F.col("_kind") == "smooth", F.col(f"_m_{c}")) if c in noisy else F
        value = other.when(F.col("_kind").isin("scale", "invert"), F.col(c) * F.col("_factor")).otherwise(F.col(c))
        return F.when(F.array_contains("_columns", c), value).otherwise(F.col(c))

    return rows.withColumns({c: new(c) for c in channels}).select(*frame.columns)


def correct(frame: DataFrame, policy: Policy = Policy(), order: str = "ts") -> Corrected:
    """``frame``: participant_id, dataset_id, time and channels; streams are windows, participants are independent."""
    rounds, current, left = [], frame, None
    for n in range(1, policy.rounds + 1):
        rows = current if left is None else current.join(left, KEY, "left_semi")
        found = scored(statistics(rows, policy, order), policy)
        if rounds:
            tried = reduce(DataFrame.unionByName, [r.select(*KEY, "action_id") for r in rounds]).where("action_id is not null")
            seen = found.join(tried.withColumn("_seen", F.lit(True)), [*KEY, "action_id"], "left")
            # A stream all of whose proposals were tried keeps a row without one.
            found = seen.withColumns({c: F.when(F.col("_seen"), None).otherwise(F.col(c)) for c in ("place", "action_id", "kind", "gain")}).drop("_seen").select(*found.columns)
        ranked = best_of(found).withColumn("iteration", F.lit(n))
        taken = (F.col("rank") == 1) & (F.col("gain") > 0) & (F.col("gain") >= policy.least_gain)
        ranked = cut(ranked.withColumn("accepted", F.coalesce(taken, F.lit(False))), "agent-round")
        rounds.append(ranked)
        accepted = ranked.where("accepted")
        if accepted.isEmpty():
            break
        left = accepted.select(*KEY)
        current = cut(changed(current, accepted, policy, order), "agent-rows")
    every = reduce(DataFrame.unionByName, rounds)
    actions = every.where("action_id is not null").select(
        *KEY, "iteration", "dataset_id", "action_id", F.col("kind").alias("action_type"), "columns", "factor", "rationale", F.round("score_before", 4).alias("score_before"), F.round("score_after", 4).alias("score_after"),
        F.round("gain", 4).alias("improvement"), "accepted", F.when(F.col("accepted"), decisions.observer_confidence(F.col("gain"))).alias("observer_confidence"),
    )
    return Corrected(current, actions, summarised(every, policy))


def summarised(rounds: DataFrame, policy: Policy) -> DataFrame:
    """A row a participant: scores before and after, confidence, number of accepted actions and why it ended."""
    last = F.max_by(F.struct("gain", "accepted", "action_id", "score_before", "score_after"), F.struct("iteration", -F.col("rank")))
    rows = rounds.groupBy(*KEY).agg(
        F.min_by("score_before", "iteration").alias("initial"), F.sum(F.col("accepted").cast("long")).alias("iterations"), F.max("iteration").alias("rounds"), last.alias("last")
    )
    final = F.when(F.col("last.accepted"), F.col("last.score_after")).otherwise(F.col("last.score_before"))
    why = (
        F.when(F.col("last.action_id").isNull(), "no_new_actions").when(F.col("last.accepted"), "max_iterations_reached")
        .when(F.col("last.gain") > 0, "no_action_above_improvement_threshold").otherwise("no_viable_candidates")
    )
    gain = final - F.col("initial")
    return rows.select(
        *KEY, (F.col("iterations") > 0).alias("used"), "iterations", F.round("initial", 4).alias("initial_score"), F.round(final, 4).alias("final_score"), F.round(gain, 4).alias("net_improvement"),
        decisions.observer_confidence(F.round(gain, 9)).alias("confidence"), why.alias("stop_reason"),
    )
