"""Fusion of small CSV slots against values worked out by hand, and drift against a direct computation."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from sensorloom.operators import alignment, benchmark, scoring, signals
from sensorloom.plans import fusion_queries
from sensorloom.plans.pipeline import fuse, rolled_up
from sensorloom.sources import ingest, sinks

START = datetime(2024, 1, 1)
SCHEMA = "participant_id string, dataset_id string, ts timestamp, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double"


def rows(participant, dataset, n, step, start=0.0, f=None):
    f = f or (lambda i: (i % 7 * 1.0, 1.0, 9.8, 0.1, 0.2, 0.3))
    return [(participant, dataset, START + timedelta(seconds=start + i * step), *f(i)) for i in range(n)]


def test_two_participants_at_one_hertz(spark):
    """Streams of two participants, a quarter of a second apart, keep their own rate and grid."""
    a, b = (rows("p1", d, 60, 1.0) + rows("p2", d, 60, 1.0, 0.25) for d in ("d1", "d2"))
    out = fuse([spark.createDataFrame(x, SCHEMA) for x in (a, b)])
    report = {r.participant_id: r for r in out.report.collect()}
    assert {p: r.master_rate_hz for p, r in report.items()} == {"p1": 1.0, "p2": 1.0}
    assert out.fused.count() == 120 and out.fused.where("acc_x is null").count() == 0
    one = rolled_up(out.report).head()
    assert one.participants == 2 and one.drift_type == "none" and one.warnings == []
    # The rotation is constant: no peak of its own, so half of the acceleration's.
    assert all(r.peak == pytest.approx(0.5) and r.distribution == pytest.approx(1) for r in report.values())


def test_offset_is_found_and_applied(spark):
    rng = np.random.default_rng(1)
    signal = 10 + rng.normal(size=260)
    at = lambda k: lambda i: (float(signal[i + k]), 0.0, 0.0, 0.0, 0.0, 0.0)
    slots = [spark.createDataFrame(rows("p", d, 200, 0.1, 0.0, at(k)), SCHEMA) for d, k in (("d1", 0), ("d2", 20))]
    out = fuse(slots)
    mag = lambda k: np.abs(signal[k : k + 200]) - np.abs(signal[k : k + 200]).mean()
    lag = int(np.argmax(np.correlate(mag(0), mag(20), "full"))) - 199
    got = {d.dataset_id: d.offset_seconds for d in out.first.datasets}
    assert got == {"d1": 0.0, "d2": pytest.approx(max(-5.0, min(5.0, lag / 10)))} and lag == 20


def test_no_shared_participant_falls_back_to_all(spark):
    out = fuse([spark.createDataFrame(rows("a", "d1", 30, 0.1), SCHEMA), spark.createDataFrame(rows("b", "d2", 30, 0.1), SCHEMA)], target_rate=5.0)
    assert out.first.participant_id == "global" and out.fused.count() == 15
    assert out.first.requested_applied and out.master_rate == 5.0


def test_rate_gate(spark):
    row = spark.createDataFrame([(8.0, 10.0, 8.0)], "least double, most double, auto double")
    got = [row.select(scoring.gated_rate(x, F.col("least"), F.col("most"), F.col("auto"))).head()[0] for x in (None, 5.0, 20.0, 3.9, 20.5, -1.0)]
    assert got == [8.0, 5.0, 20.0, 8.0, 8.0, 8.0]


def test_single_modality_scores_by_hand(spark, tmp_path):
    frames = []
    for name, value in (("d1", 1.0), ("d2", 1.2)):
        (tmp_path / name).mkdir()
        text = "\n".join(["timestamp,acc_x", *(f"{(START + timedelta(milliseconds=100 * i)).isoformat(timespec='milliseconds')},{value}" for i in range(120))])
        (tmp_path / name / "a.csv").write_text(text + "\n")
        frames.append(ingest.read_slot(spark, str(tmp_path / name), name).frame)
    out = fuse(frames)
    assert (out.score, out.first.stability_factor, out.first.confidence) == (0.4226, pytest.approx(0.57), "Low")
    assert out.warnings == ["Limited modality available."] and out.first.profile == "limited_modality"
    sinks.write_rows(out.fused, str(tmp_path / "fused"))
    assert spark.read.csv(str(tmp_path / "fused"), header=True).count() == 120
    sinks.write_results(out.report, str(tmp_path / "result"))
    assert spark.read.json(str(tmp_path / "result")).head().hqscore == 0.4226
    sinks.append_ledger(sinks.learning_record(out.report, "job1"), str(tmp_path / "ledger"))
    assert [(r.job_id, r.chosen_master_rate_hz, r.hqscore) for r in sinks.read_ledger(spark, str(tmp_path / "ledger")).collect()] == [("job1", 10.0, 0.4226)]


def test_drift_equals_direct_computation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=90).cumsum()
    y = np.r_[x[3:], rng.normal(size=3)]
    frame = spark.createDataFrame([("p", i, START + timedelta(seconds=i / 4), 4.0, float(x[i]), float(y[i])) for i in range(90)], "k string, pos long, ts timestamp, rate_hz double, x double, y double")
    windows = alignment.window_lags(frame, ["k"]).orderBy("idx").collect()
    lags = []
    for start in range(0, 71, 10):
        a, b = x[start : start + 20], y[start : start + 20]
        corr = np.abs(np.correlate(a - a.mean(), b - b.mean(), "full"))
        lags.append((int(np.argmax(corr)) - 19) / 4)
    assert [r.offset_seconds for r in windows] == pytest.approx(lags)
    got = alignment.drift_summary(alignment.window_lags(frame, ["k"]).withColumn("dataset_id", F.lit("d")), ["k"]).head()
    warp = signals.dtw(x, y) / (180 * (x.std() + y.std() + 1e-6))
    assert got.mean_offset == pytest.approx(np.mean(np.abs(lags))) and got.slope == pytest.approx(np.polyfit(range(8), lags, 1)[0]) and got.warp == pytest.approx(warp)
    assert got.drift == "significant"


def test_fusion_query(spark):
    rows = fusion_queries.fuse_by_label(spark, "/root/testdata/sf0.001").collect()
    assert len({r.participant_id for r in rows}) == len(rows) > 1
    assert all(0 <= r.hqscore <= 1 and r.master_rate_hz == 20.0 and r.coverage == pytest.approx(0.45, abs=1e-4) for r in rows)


def test_drift_query_and_alignment_error(spark):
    assert fusion_queries.drift_by_label(spark, "/root/testdata/sf0.001").count() > 0
    offsets = spark.createDataFrame([("s", "d2", 0.5), ("s", "d3", 1.0)], "scenario string, dataset_id string, offset_seconds double")
    truth = spark.createDataFrame([("s", "d2", 0.4), ("s", "d3", 1.3)], "scenario string, dataset_id string, offset_seconds double")
    assert benchmark.alignment_error(offsets, truth).head().alignment_mae == pytest.approx(0.2)


def test_score_components_of_equal_and_constant_signals(spark):
    frame = spark.createDataFrame([("p", "acc", "a", "b", i, 20.0, float(i % 9), float(i % 9)) for i in range(64)] + [("q", "acc", "a", "b", i, 20.0, 1.0, 1.0) for i in range(20)], "participant_id string, sensor string, a string, b string, pos long, rate_hz double, x double, y double")
    got = {r.participant_id: r for r in scoring.components(frame, ["participant_id"]).collect()}
    assert got["p"].distribution == pytest.approx(1) and got["p"].temporal == pytest.approx(1) and got["p"].spectral == pytest.approx(1) and got["p"].snr == pytest.approx(1)
    assert (got["q"].kl, got["q"].peak, got["q"].spectral) == (0.0, 0.0, 0.5)


def test_names_of_columns():
    for name, channel in {"ax": "acc_x", "A_Y": "acc_y", "wx": "gyro_x", "g_z": "gyro_z", "m_x": "mag_x", "velocity": "gps_speed", "pulse": "heart_rate", "illuminance": "light_lux", "baro": "pressure", "gps_latitude": "gps_lat", "Accelerometer X": "acc_x", "lng": "gps_lon"}.items():
        assert ingest.canonical(name) == channel, name
    assert all(ingest.canonical(x) is None for x in ("bpm", "rotation_x", "linacc_x", "acc", "notes"))


def test_ambiguous_times_and_empty_channels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,time,acc_x,acc_y\n" + "".join(f"2024-01-01T00:00:0{i},2024-01-01T00:00:0{i},{i},\n" for i in range(5)))
    slot = ingest.read_slot(spark, str(tmp_path), "d")
    assert len(slot.warnings) == 2 and "acc_y" not in slot.frame.columns and slot.frame.count() == 5


def test_rolled_up_warnings_keep_their_order(spark):
    """Once each, by the first participant that has them; accepted corrections are summed."""
    one = fuse([spark.createDataFrame(rows("p", d, 60, 1.0), SCHEMA) for d in ("d1", "d2")]).report
    many = spark.createDataFrame([("a", ["z", "b"]), ("b", ["b", "a"]), ("c", [])], "participant_id string, w array<string>")
    report = one.drop("participant_id").join(F.broadcast(many)).withColumn("warnings", F.col("w")).withColumn("corrections", F.col("corrections").withField("iterations", F.lit(2)))
    got = rolled_up(report).head()
    assert (got.participants, got.warnings, got.iterations) == (3, ["z", "b", "a"], 6)


def test_long_streams_are_filled_in_blocks(spark, monkeypatch):
    """A grid of many blocks gives the same fusion as one block."""
    from sensorloom.operators import resample

    f = lambda i: (float(i % 11), 1.0, 9.8, 0.1, float(i % 5), 0.3)
    slots = [spark.createDataFrame(rows("p", "d1", 400, 0.1, 0.0, f), SCHEMA), spark.createDataFrame(rows("p", "d2", 80, 0.5, 0.0, f), SCHEMA)]
    whole = fuse(slots, target_rate=4.0)
    made = resample.blocked_grid
    monkeypatch.setattr(resample, "blocked_grid", lambda *a, **k: made(*a, **k, block=17))
    cut_up = fuse(slots, target_rate=4.0)
    same = lambda out: sorted(map(tuple, out.fused.collect()))
    assert same(whole) == same(cut_up) and len(same(whole)) == 159
    assert whole.first.hqscore == cut_up.first.hqscore
