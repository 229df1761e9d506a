"""Named queries of learning from the ledger, with their oracles; finished orders stand for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.lineage import folder
from sensorloom.operators import adaptive
from sensorloom.plans.queries import query, rounded
from sensorloom.sources import sinks
from sensorloom.sources import tables as S

LEDGER = """j as (select o_orderkey job_id, o_orderdate created_at, o_orderstatus = 'F' done, (o_custkey % 5) * 10.0 + 5 chosen_master_rate_hz, o_totalprice / 500000.0 hqscore,
 case o_custkey % 3 when 0 then ['accelerometer'] when 1 then ['accelerometer', 'gyroscope'] else ['gps'] end modalities, [(o_custkey % 5) * 10.0 + 5, o_custkey % 4 * 10.0] rates, o_totalprice / 100 duration_seconds,
 case o_orderpriority when '1-URGENT' then 'Gait Analysis' when '2-HIGH' then 'Driving Behavior' end task_type, o_orderkey % 2 = 0 drift_flag from orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, status, created_at and learning, as ``LEDGER``."""
    k = F.col("o_custkey")
    rate = ((k % 5) * 10.0 + 5).alias("chosen_master_rate_hz")
    learning = F.to_json(F.struct(
        rate, (F.col("o_totalprice") / 500000.0).alias("hqscore"),
        F.when(k % 3 == 0, F.array(F.lit("accelerometer"))).when(k % 3 == 1, F.array(F.lit("accelerometer"), F.lit("gyroscope"))).otherwise(F.array(F.lit("gps"))).alias("modalities"),
        F.array(rate, (k % 4) * 10.0).alias("sampling_rates_hz"), (F.col("o_totalprice") / 100).alias("duration_seconds"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Gait Analysis").when(F.col("o_orderpriority") == "2-HIGH", "Driving Behavior").alias("task_type"), (F.col("o_orderkey") % 2 == 0).alias("drift_flag"),
    ))
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    return S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), learning.alias("learning"))


TASK = " + ".join(f"{n} * (coalesce(task_type, 'Unknown') = '{t}')::int" for n, t in enumerate(adaptive.TASKS, 1))


@query(f"""with {LEDGER}, f as (select *, list_filter(rates, lambda r: r > 0) used from j where done and hqscore between 0 and 1)
 select job_id, list_contains(modalities, 'accelerometer')::int::double has_accelerometer, list_contains(modalities, 'gyroscope')::int::double has_gyroscope, list_contains(modalities, 'gps')::int::double has_gps, ({TASK})::double task_number,
 round(list_avg(used), 6) rate_mean, round(list_min(used), 6)::double rate_min, round(list_max(used), 6)::double rate_max, round(list_stddev_pop(used), 6) rate_std, round(duration_seconds, 6) duration, drift_flag::int::double drift, 0.0::double override from f""")
def adaptive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the models look at, from the JSON text of finished jobs."""
    x = adaptive.features()
    number = sum((n * x["task_" + adaptive.name_of(t)] for n, t in enumerate(adaptive.TASKS, 1)), F.lit(0.0))
    shown = {c: x[c] for c in ("has_accelerometer", "has_gyroscope", "has_gps")} | {"task_number": number} | {c: x[c] for c in ("rate_mean", "rate_min", "rate_max", "rate_std", "duration", "drift", "override")}
    rows = sinks.valid_records(ledger(spark, sf_dir)).select("job_id", *(v.alias(k) for k, v in shown.items()))
    return rounded(rows, 6, "rate_mean", "rate_min", "rate_max", "rate_std", "duration")


@query(f"""with {LEDGER}, f as (select *, row_number() over (order by created_at, job_id) job_index from j where done and hqscore between 0 and 1), m as (select job_index, hqscore, avg(hqscore) over (order by job_index rows between 4 preceding and current row) moving from f)
 select job_index, round(hqscore, 4) hqscore, round(moving, 4) moving_avg from m order by job_index desc limit 30""")
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 finished jobs' scores with the mean of five; everything before is only counted."""
    return adaptive.trend(sinks.valid_records(ledger(spark, sf_dir)), ["created_at", "job_id"])


@query()
def adaptive_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models trained on the finished jobs recommend for all open ones; errors are bounded in the tests."""
    jobs = ledger(spark, sf_dir)
    store = adaptive.Store(spark, f"{folder(spark)}/adaptive-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}")
    store.train(sinks.valid_records(jobs), every=1, rounds=dict.fromkeys(adaptive.TARGETS, 10))
    open_jobs = jobs.where("status <> 'completed'").select("job_id", F.from_json("learning", sinks.LEARNING).alias("_r")).select("job_id", "_r.*")
    return store.recommend(open_jobs).select("job_id", "predicted_sampling_rate_hz", "expected_hqscore", "confidence", "used")


@query(f"""with {LEDGER}, e as (select job_id, abs(hqscore - 0.3) * 10 rate_error, abs(hqscore - 0.3) / 2 score_error, job_id % 200 samples from j)
 select job_id, round(0.4 * (1 - least(1.0, rate_error / 20)) + 0.3 * (1 - least(1.0, score_error / 0.25)) + 0.3 * least(1.0, samples / 120), 6) confidence from e""")
def adaptive_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from errors and the number of records."""
    score = F.from_json("learning", sinks.LEARNING)["hqscore"]
    gap = F.abs(score - 0.3)
    return ledger(spark, sf_dir).select("job_id", F.round(adaptive.confidence_column(gap * 10, gap / 2, F.col("job_id") % 200), 6).alias("confidence"))


