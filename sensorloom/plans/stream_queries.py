"""The stream operators keyed by (participant, dataset), as the fusion keys them, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators import rates, resample, scoring
from sensorloom.plans.queries import EVENTS, IMU, query, rounded
from sensorloom.sources import tables as S

STREAM = ["participant_id", "dataset_id"]
GAPS = EVENTS + ", g as (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by participant_id, dataset_id order by ts))) / 1e6 gap from ev)"
# Gaps of the test streams are hours long: rates are per day.
DAY = 86400


@query(f"""with {GAPS}, r as (select participant_id, dataset_id, coalesce(round({DAY} / nullif(median(gap), 0), 2), 1.0) rate from g group by all)
 select participant_id, coalesce(min(rate) filter (rate > 0), 10.0) master_rate, stddev_pop(rate) > greatest(0.05, 0.15 * coalesce(min(rate) filter (rate > 0), 10.0)) rate_drift, count(*) streams from r group by 1""")
def participant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all streams (in samples a day), the least as a participant's master rate, and whether they spread."""
    rate = F.coalesce(F.round(DAY / F.nullif(F.percentile("gap", 0.5), F.lit(0.0)), 2), F.lit(1.0))
    each = rates.with_gap(S.events(spark, sf_dir), STREAM).groupBy(*STREAM).agg(rate.alias("rate_hz"))
    master = rates.master_rate(each, ["participant_id"])
    spread = each.groupBy("participant_id").agg(F.stddev_pop("rate_hz").alias("spread"), F.count(F.lit(1)).alias("streams"))
    return master.join(spread, "participant_id").select("participant_id", F.col("master_rate_hz").alias("master_rate"), (F.col("spread") > F.greatest(F.lit(0.05), 0.15 * F.col("master_rate_hz"))).alias("rate_drift"), "streams")


@query(f"""with {GAPS}, h as (select participant_id, dataset_id, gap / {DAY} gap from g where gap is not null), m as (select participant_id, dataset_id, median(gap) m from h group by all)
 select participant_id, dataset_id, bool_and(abs(gap - m) < 0.2 * m) continuous, round(1 / (1 + var_pop(gap)), 6) sampling_consistency from h join m using (participant_id, dataset_id) group by all""")
def stream_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularity of each stream, with time in days."""
    found = rates.continuity(S.events(spark, sf_dir), STREAM, unit=DAY)
    return rounded(found.select(*STREAM, "continuous", "sampling_consistency"), 6, "sampling_consistency")


@query(f"""with {EVENTS} select event_id, round(median(value) over (partition by participant_id, dataset_id order by ts, event_id rows between 2 preceding and 2 following), 6) smooth,
 round(avg(value) over (partition by participant_id, dataset_id order by ts, event_id rows between 4 preceding and current row), 6) low_pass from ev""")
def stream_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling median and running mean within each stream."""
    rows = S.events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return rows.select("event_id", F.round(resample.rolling_median("value", STREAM, "at", 5), 6).alias("smooth"), F.round(resample.rolling_mean("value", STREAM, "at", 5), 6).alias("low_pass"))


@query(f"""with {EVENTS}, d as (select *, value - lag(value) over (partition by participant_id, dataset_id order by ts, event_id) step from ev)
 select participant_id, dataset_id, round(stddev_pop(step) / (stddev_pop(value) + 1e-9), 6) noise_ratio, round(tanh(var_pop(value) / 5), 6) variance_score from d group by all having count(*) >= 10""")
def stream_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise and variance of each stream of ten values or more."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy(*STREAM).orderBy("ts", "event_id"))
    found = S.events(spark, sf_dir).withColumn("step", step).groupBy(*STREAM).agg((F.stddev_pop("step") / (F.stddev_pop("value") + 1e-9)).alias("noise_ratio"), scoring.variance_score(["value"]).alias("variance_score"), F.count(F.lit(1)).alias("n"))
    return rounded(found.where("n >= 10").drop("n"), 6, "noise_ratio", "variance_score")


@query(f"with {EVENTS}, r as (select *, row_number() over (partition by participant_id, dataset_id order by event_id) rn, count(*) over (partition by participant_id, dataset_id) n from ev) select event_id, participant_id, dataset_id from r where (rn - 1) % greatest(1, ceil(n / 4.0)::bigint) = 0")
def stream_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream thinned to about four values."""
    return resample.stride(S.events(spark, sf_dir), STREAM, "event_id", 4).select("event_id", *STREAM)


@query(f"""with {IMU}, v as (select label, pos, case when pos % 3 <> 0 then acc_x1 * 46 end acc_x, acc_y1 * 46 acc_y, acc_z1 * 46 acc_z, gyro_x1 * 9 gyro_x, gyro_y1 * 9 gyro_y, gyro_z1 * 9 gyro_z, case when pos % 2 = 0 then acc_x2 end pressure, pos - lag(pos) over (partition by label order by pos) gap from imu),
 a as (select label, 0.7 * (5 + avg((acc_x is not null)::int)) / 6 + 0.3 * avg((pressure is not null)::int) complete, 1 / (1 + var_pop(gap / 100.0)) regular, avg(sqrt(acc_x*acc_x+acc_y*acc_y+acc_z*acc_z)) a, avg(sqrt(gyro_x*gyro_x+gyro_y*gyro_y+gyro_z*gyro_z)) g from v group by 1)
 select label, round(0.30 * complete + 0.20 * regular + 0.20 + 0.20 * case when a between 8.5 and 11.5 then 1.0 when a between 0.8 and 1.2 then 0.7 else 0.3 end + 0.10 * case when g < 5 then 1.0 when g < 20 then 0.7 else 0.3 end, 4)::double hq_score from a""")
def observer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observer's score of one dataset a label: completeness by role, regularity, distribution and plausibility."""
    on = lambda c, by: (F.col(c + "1") * by).alias(c)
    v = S.imu(spark, sf_dir).select(
        "label", F.timestamp_millis(F.col("pos") * 10).alias("ts"), F.when(F.col("pos") % 3 != 0, F.col("acc_x1") * 46).alias("acc_x"), on("acc_y", 46), on("acc_z", 46), *(on(f"gyro_{a}", 9) for a in "xyz"), F.when(F.col("pos") % 2 == 0, F.col("acc_x2")).alias("pressure")
    )
    return scoring.observed(v, ["label"]).select("label", "hq_score")


