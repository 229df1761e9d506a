"""Named queries of the correcting loop, named transforms, distribution and completeness scores, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions import columns as C
from sensorloom.operators import agent, transforms
from sensorloom.plans.queries import IMU, query
from sensorloom.sources import tables as S

AXES = [f"{s}_{a}" for s in ("acc", "gyro") for a in "xyz"]
# Two datasets of three participants: dataset1 has gaps in two axes and accelerations in g, dataset2 has rotation and a
# barometer that misses every second value.
TWO = (
    IMU
    + ", two as (select label % 3 participant_id, 'dataset1' dataset_id, pos, case when pos % 3 <> 0 then acc_x1 * 4.6 end acc_x, acc_y1 * 4.6 acc_y, acc_z1 * 4.6 acc_z,"
    + " case when pos % 4 <> 0 then gyro_x1 end gyro_x, gyro_y1 gyro_y, gyro_z1 gyro_z, null::double pressure from imu"
    + " union all select label % 3, 'dataset2', pos, null, null, null, gyro_x2, gyro_y2, gyro_z2, case when pos % 2 = 0 then acc_x2 end from imu)"
)


def two_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, dataset_id, pos and channels, as ``TWO``."""
    rows, key = S.imu(spark, sf_dir), (F.col("label") % 3).alias("participant_id")
    pos, none = F.col("pos"), F.lit(None).cast("double")
    one = rows.select(
        key, F.lit("dataset1").alias("dataset_id"), pos, F.when(pos % 3 != 0, F.col("acc_x1") * 4.6).alias("acc_x"), (F.col("acc_y1") * 4.6).alias("acc_y"), (F.col("acc_z1") * 4.6).alias("acc_z"),
        F.when(pos % 4 != 0, F.col("gyro_x1")).alias("gyro_x"), F.col("gyro_y1").alias("gyro_y"), F.col("gyro_z1").alias("gyro_z"), none.alias("pressure"),
    )
    two = rows.select(key, F.lit("dataset2").alias("dataset_id"), pos, *(none.alias(f"acc_{a}") for a in "xyz"), *(F.col(f"gyro_{a}2").alias(f"gyro_{a}") for a in "xyz"), F.when(pos % 2 == 0, F.col("acc_x2")).alias("pressure"))
    return one.unionByName(two)


WEIGHT = " ".join(f"when '{m}' then {w}::double" for m, (_, w, _) in registry.MODALITIES.items())
OTHERS = sum(w for m, (_, w, _) in registry.MODALITIES.items() if m not in ("accelerometer", "gyroscope", "barometer"))
MODALITY = "case when c like 'acc%' then 'accelerometer' when c like 'gyro%' then 'gyroscope' else 'barometer' end"
CHANNELS = ", ".join([*AXES, "pressure"])


@query(f"""with {TWO}, u as (from two unpivot include nulls (v for c in ({CHANNELS}))),
 d as (select *, v - last_value(v ignore nulls) over (partition by participant_id, dataset_id, c order by pos rows between unbounded preceding and 1 preceding) step,
  count(v) over (partition by participant_id, dataset_id, c order by pos rows between 2 preceding and 2 following) = 0 gap from u),
 s as (select participant_id, dataset_id, c, {MODALITY} modality, count(v) n, avg((v is null)::int) miss, avg(gap::int) smooth, avg(v) mean, stddev_pop(v) spread, stddev_pop(step) / (stddev_pop(v) + 1e-9) noise from d group by all),
 loud as (select *, row_number() over (partition by participant_id, dataset_id order by noise desc, c desc) rn from s where n >= 50 and spread > 1e-9 and noise >= 1.35),
 act as (
  select participant_id, dataset_id, 'smooth' action_type, string_agg(c, ',' order by c) cols from loud where rn <= 6 group by all
  union all select participant_id, dataset_id, 'scale', 'acc_x,acc_y,acc_z' from two group by all having avg(sqrt(acc_x*acc_x+acc_y*acc_y+acc_z*acc_z)) between 0.7 and 1.3
  union all select participant_id, dataset_id, 'invert', c from (select *, min(n) over (partition by participant_id, dataset_id, modality) least, row_number() over (partition by participant_id, dataset_id, modality order by abs(mean) desc, c) rn from s where c <> 'pressure')
   where rn = 1 and least >= 10 and mean < 0 and abs(mean) >= case modality when 'accelerometer' then 0.5 else 0.05 end),
 v as (select participant_id, dataset_id, action_type, cols from act union all select distinct participant_id, dataset_id, '', '' from two),
 p as (select v.*, modality, avg(case when action_type = 'smooth' and list_contains(string_split(cols, ','), c) then smooth else miss end) filter (n > 0) share, count(*) filter (n > 0) there from v join s using (participant_id, dataset_id) group by all),
 q as (select participant_id, dataset_id, action_type, cols, round(0.4225 + 0.15 * (1 - ({OTHERS} + sum(case modality {WEIGHT} end * coalesce(share, 1.0))) / (1 + 1e-9)) + 0.10 * sum(case when there > 0 then case modality {WEIGHT} end else 0.0 end) / (1 + 1e-9), 4) score from p group by all),
 b as (select participant_id, avg(score) before, count(*) streams from q where action_type = '' group by 1), o as (select participant_id, dataset_id, score own from q where action_type = ''),
 g as (select participant_id, dataset_id, action_type, cols, before, before + (score - own) / streams after from q join b using (participant_id) join o using (participant_id, dataset_id) where action_type <> ''),
 r as (select *, round(after - before, 9) gain, row_number() over (partition by participant_id order by round(after - before, 9) desc, dataset_id, case action_type when 'scale' then 0 when 'invert' then 1 else 2 end, cols) rn from g)
 select participant_id, dataset_id, action_type, cols, round(before, 4) score_before, round(after, 4) score_after, round(gain, 4) improvement, rn = 1 and gain >= 0.002 accepted from r""")
def agent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First round of the correcting loop: every proposal of each participant with its gain, and the one that is taken."""
    found = agent.scored(agent.statistics(two_datasets(spark, sf_dir), order="pos"))
    rows = agent.best_of(found).where("action_id is not null")
    cols = F.array_join(F.array_sort("columns"), ",").alias("cols")
    numbers = [C.rounded(F.col(c), 4).alias(n) for c, n in (("score_before", "score_before"), ("score_after", "score_after"), ("gain", "improvement"))]
    return rows.select("participant_id", "dataset_id", F.col("kind").alias("action_type"), cols, *numbers, ((F.col("rank") == 1) & (F.col("gain") >= 0.002)).alias("accepted"))


@query()
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rounds of the correcting loop: scores before and after, and why it ended; held against a plain version in the tests."""
    return agent.correct(two_datasets(spark, sf_dir), order="pos").summary


@query(f"""with {TWO} select participant_id, dataset_id, pos, round(coalesce(acc_x, 0.0) * 9.81, 6) ax, round(-acc_y, 6) ay,
 round(median(gyro_x) over (partition by participant_id, dataset_id order by pos rows between 2 preceding and 2 following), 6) gyro_x,
 round(avg(gyro_y) over (partition by participant_id, dataset_id order by pos rows between 4 preceding and current row), 6) gyro_y from two""")
def apply_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling, inverting, merging a duplicate, renaming, smoothing and a low pass by name."""
    keys = ["participant_id", "dataset_id"]
    rows = two_datasets(spark, sf_dir).select(*keys, "pos", "acc_x", "acc_y", "gyro_x", "gyro_y", F.lit(0.0).alias("acc_x_dup"))
    steps = [
        transforms.Step("coalesce_duplicates", {}),
        transforms.Step("scale", {"names": ["acc_x"], "factor": 9.81}),
        transforms.Step("invert", {"names": ["acc_y"]}),
        transforms.Step("rename", {"mapping": {"acc_x": "ax", "acc_y": "ay"}}),
        transforms.Step("smooth", {"names": ["gyro_x"], "keys": keys, "order": "pos"}),
        transforms.Step("low_pass", {"names": ["gyro_y"], "keys": keys, "order": "pos"}),
    ]
    out = transforms.apply(rows, steps).frame
    return out.withColumns({c: F.round(c, 6) for c in ("ax", "ay", "gyro_x", "gyro_y")})


V3 = "round(0.6 * avg(((acc_y is not null)::int + (gyro_x is not null)::int) / 2) + 0.4 * coalesce(least(1.0, coalesce((var_samp(acc_y) + var_samp(gyro_x)) / 2, var_samp(acc_y), var_samp(gyro_x)) / 100), 0.5), 4)"


@query(f"""with {TWO}, f as (select participant_id, dataset_id, acc_y, gyro_x, case when pos % 2 = 0 then gyro_x end half from two),
 b as (select participant_id, dataset_id, {V3} before from f group by all), a as (select participant_id, dataset_id, {V3.replace("gyro_x", "half")} after from f group by all)
 select participant_id, dataset_id, before, after, round(after - before, 4) gain, case when after - before >= 0 then 'accepted' else 'rejected' end status from b join a using (participant_id, dataset_id)""")
def validate_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change that loses values is rejected by the score before and after."""
    rows = two_datasets(spark, sf_dir)
    after = rows.withColumn("gyro_x", F.when(F.col("pos") % 2 == 0, F.col("gyro_x")))
    return transforms.validated(rows, after, ["participant_id", "dataset_id"], ["acc_y", "gyro_x"])
