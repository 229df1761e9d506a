"""Learning from the ledger: when it trains, what it keeps, what it recommends."""

import pytest
from pyspark.sql import functions as F
from sensorloom.operators import adaptive
from sensorloom.sources import sinks

FEW = dict.fromkeys(adaptive.TARGETS, 8)


def job(i, rate, score, **more):
    record = {"chosen_master_rate_hz": rate, "hqscore": score, "modalities": ["accelerometer"], "sampling_rates_hz": [rate, rate and 2 * rate], "duration_seconds": 60.0 + i, "task_type": "Gait Analysis", "drift_flag": i % 2 == 0}
    return (f"job{i:04d}", "completed", i, *((record | more).get(c) for c in ("chosen_master_rate_hz", "hqscore", "modalities", "sampling_rates_hz", "duration_seconds", "task_type", "drift_flag")))


def jobs(spark, rows):
    flat = spark.createDataFrame(rows, "job_id string, status string, at long, chosen_master_rate_hz double, hqscore double, modalities array<string>, sampling_rates_hz array<double>, duration_seconds double, task_type string, drift_flag boolean")
    return flat.select("job_id", "status", F.timestamp_seconds("at").alias("created_at"), F.to_json(F.struct(*flat.columns[3:])).alias("learning"))


def contexts(spark):
    return sinks.valid_records(jobs(spark, [job(5000, 10.0, 0.5), job(5001, 40.0, 0.5)])).drop("status", "created_at", "chosen_master_rate_hz", "hqscore")


def test_train_save_load_recommend(spark, tmp_path):
    ledger, store = str(tmp_path / "ledger"), adaptive.Store(spark, str(tmp_path / "models"))
    assert store.state() == adaptive.State()
    nothing = store.recommend(contexts(spark)).collect()
    assert all((r.used, r.confidence, r.predicted_sampling_rate_hz, r.model_version) == (False, 0.0, None, "untrained") for r in nothing)
    sinks.append_ledger(jobs(spark, [job(i, 10.0 + 30 * (i % 2), 0.3 + 0.4 * (i % 2)) for i in range(19)]), ledger)
    sinks.append_ledger(jobs(spark, [job(900, -1.0, 0.5), job(901, 10.0, 1.5), job(902, None, 0.5)]).unionByName(jobs(spark, [job(903, 10.0, 0.5)]).withColumn("status", F.lit("failed"))), ledger)
    assert store.train(sinks.read_ledger(spark, ledger)).reason == "not_enough_samples:19"
    sinks.append_ledger(jobs(spark, [job(i, 10.0 + 30 * (i % 2), 0.3 + 0.4 * (i % 2)) for i in range(19, 60)]), ledger)
    first = store.train(sinks.read_ledger(spark, ledger), rounds=FEW)
    assert first.trained and first.state.last_train_sample_count == 60 and first.state.train_mae_rate < 1 and first.state.holdout_mae_rate < 1
    again = adaptive.Store(spark, str(tmp_path / "models"))  # another process would see the same
    assert again.state() == first.state
    got = [r.predicted_sampling_rate_hz for r in again.recommend(contexts(spark)).orderBy("job_id").collect()]
    assert got == [pytest.approx(10, abs=1), pytest.approx(40, abs=1)]
    assert again.train(sinks.read_ledger(spark, ledger)).reason == "waiting_for_more_samples:0"
    sinks.append_ledger(jobs(spark, [job(i, 80.0, 0.9, sampling_rates_hz=[10.0, 20.0]) for i in range(100, 300)]), ledger)
    second = again.train(sinks.read_ledger(spark, ledger), rounds=FEW)
    assert second.trained and second.state.model_version > first.state.model_version
    new = again.recommend(contexts(spark)).orderBy("job_id").collect()
    assert new[0].predicted_sampling_rate_hz > 60 and new[0].model_version == second.state.model_version  # the ledger has changed
    assert new[0].confidence == round(adaptive.confidence(second.state), 4) and new[0].used == (adaptive.confidence(second.state) >= 0.7)
    assert len(again._versions()) == 2  # the first one stays


def test_targets_that_never_vary(spark, tmp_path):
    store = adaptive.Store(spark, str(tmp_path))
    records = sinks.valid_records(jobs(spark, [job(i, 25.0, 0.5) for i in range(30)]))
    done = store.train(records)
    assert (done.state.constant_rate, done.state.constant_hqscore, done.state.train_mae_rate) == (25.0, 0.5, 0.0)
    got = store.recommend(contexts(spark)).collect()
    assert {(r.predicted_sampling_rate_hz, r.expected_hqscore, r.confidence, r.used) for r in got} == {(25.0, 0.5, round(0.7 + 0.3 * 30 / 120, 4), True)}


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    store = adaptive.Store(spark, str(tmp_path))
    done = store.train(sinks.valid_records(jobs(spark, [job(i, 25.0, 0.5) for i in range(30)])))
    (tmp_path / "adaptive-99999999999999999999" / "rate").mkdir(parents=True)
    assert store.state() == done.state


def test_features_of_odd_records(spark):
    rows = [job(1, 10.0, 0.5, modalities=None, sampling_rates_hz=None, duration_seconds=None, task_type=None, drift_flag=None), job(2, 10.0, 0.5, sampling_rates_hz=[0.0, -3.0], duration_seconds=float("nan"), task_type="Other")]
    flat = spark.createDataFrame([r[3:] for r in rows], "chosen_master_rate_hz double, hqscore double, modalities array<string>, sampling_rates_hz array<double>, duration_seconds double, task_type string, drift_flag boolean").withColumn("user_override_flag", F.lit(None).cast("boolean"))
    for r, unknown, rest in zip(adaptive.with_features(flat).collect(), (1.0, 0.0), (0.0, 2.0)):  # a modality and drift
        x = {k: r["x_" + k] for k in adaptive.features()}
        assert x["task_unknown"] == unknown and sum(x.values()) == unknown + rest and len(r.features) == len(x) == 8 + 7 + 7


def test_trend_of_a_short_ledger(spark):
    records = sinks.valid_records(jobs(spark, [job(i, 10.0, i / 10) for i in range(7)]))
    got = sorted(map(tuple, adaptive.trend(records, ["created_at"], last=4, width=3).collect()))
    assert got == [(i + 1, i / 10, pytest.approx((3 * i - 3) / 30)) for i in range(3, 7)]
    assert adaptive.trend(records.limit(0), ["created_at"]).count() == 0
