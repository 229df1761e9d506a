"""Scenario folders to benchmark tables, with offsets and scores worked out directly."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from sensorloom.operators import adaptive
from sensorloom.plans import benchmark, fusion_queries
from sensorloom.sources import scenarios, sinks

RNG = np.random.default_rng(7)
BASE = 10 + RNG.normal(size=400)


def dataset(path, x, step=0.1, head="timestamp,acc_x,acc_y,acc_z"):
    path.parent.mkdir(parents=True, exist_ok=True)
    at = lambda i: f"2024-01-01T00:{int(i * step // 60):02d}:{i * step % 60:06.3f}"
    path.write_text("\n".join([head, *(f"{at(i)},{v},0.5,0.25" for i, v in enumerate(x))]) + "\n")


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "scenarios"
    dataset(top / "b" / "dataset1.csv", BASE[:300])
    dataset(top / "b" / "dataset2.csv", BASE[10:310])
    (top / "b" / "metadata.json").write_text('// exported\n{"ground_truth_offsets_seconds": {"dataset2": 1.25, "dataset9": 4}, "best_alignment_strategy": "classical"}')
    dataset(top / "a" / "dataset_left.csv", BASE[:200])
    dataset(top / "a" / "dataset_right.csv", BASE[:200], head="time,ax,ay,az")
    (top / "a" / "metadata.json").write_text("no json")
    dataset(top / "c" / "dataset1.csv", BASE[:100])  # alone
    dataset(top / "d" / "other.csv", BASE[:100])
    return top


def test_folders_become_one_frame(spark, root):
    found = scenarios.load_scenarios(spark, str(root))
    sizes = {(r.participant_id, r.dataset_id): r.n for r in found.frame.groupBy("participant_id", "dataset_id").agg(F.count("acc_y").alias("n")).collect()}
    assert sizes == {("a", "dataset1"): 200, ("a", "dataset2"): 200, ("b", "dataset1"): 300, ("b", "dataset2"): 300}
    truth = {r.scenario: r for r in found.truth.collect()}
    assert truth["b"].ground_truth_offsets_seconds == {"dataset2": 1.25, "dataset9": 4.0} and truth["b"].best_alignment_strategy == "classical"
    assert truth["a"].ground_truth_offsets_seconds is None
    assert scenarios.load_scenarios(spark, str(root / "c")) is None and scenarios.load_scenarios(spark, str(root / "none")) is None


def test_scores_by_hand(spark, root, tmp_path):
    rows = benchmark.evaluate(scenarios.load_scenarios(spark, str(root))).persist()
    got = {r.scenario: r for r in rows.collect()}
    m = np.sqrt(BASE**2 + 0.3125)
    lag = lambda x, y: int(np.argmax(np.correlate(x - x.mean(), y - y.mean(), "full"))) - (len(x) - 1)
    assert lag(m[:300], m[10:310]) == 10
    assert got["b"].alignment_mae == pytest.approx(0.25) and got["a"].alignment_mae == 0.0  # 1.0 found, 1.25 told; nothing told is 0
    assert got["a"].wasserstein_similarity == pytest.approx(1) and got["a"].frequency_similarity == 1.0 and got["a"].drift_stability == 1.0
    assert got["a"].signal_score == pytest.approx(1.0) and 0.5 < got["b"].signal_score < 1
    assert all(r.hqscore_classical == r.hqscore_adaptive and r.hqscore_improvement == 0 and r.strategy_selection_accuracy == 1 for r in got.values())
    assert got["a"].predicted_confidence == 0.95
    for r in got.values():
        agent = (0.5 + 1 - r.confidence_calibration_error + 1) / 3
        assert r.agent_score == pytest.approx(agent, abs=1e-5) and r.final_score == pytest.approx(0.6 * r.signal_score + 0.4 * agent, abs=1e-5)
    sinks.write_benchmark(rows, str(tmp_path / "out"))
    benchmark.write_payload(rows, str(tmp_path / "payload"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).columns == list(benchmark.TABLE)
    told = json.loads(spark.read.text(str(tmp_path / "payload")).head()[0])
    assert told["aggregate"]["scenarios_evaluated"] == 2 and told["aggregate"]["mean_final_score"] == pytest.approx(np.mean([r.final_score for r in got.values()]), abs=1e-5)
    assert told["model_versions"]["adaptive_model_version"] == "untrained" and told["benchmark_config"]["max_alignment_error_seconds"] == 1.0


def test_trusted_recommendations_change_the_rate(spark, root, tmp_path):
    """A store that has learned 5 Hz from many jobs is asked; 5 Hz lies within half of the 10 Hz that are there."""
    store = adaptive.Store(spark, str(tmp_path / "models"))
    records = spark.range(150).selectExpr("cast(id as string) job_id", "5.0D chosen_master_rate_hz", "0.5D hqscore", "array('accelerometer') modalities", "array(10.0D) sampling_rates_hz", "60.0D duration_seconds", "'Unknown' task_type", "false drift_flag", "false user_override_flag")
    assert store.train(records).trained
    found = scenarios.load_scenarios(spark, str(root))
    asked = {r.participant_id: r for r in benchmark.contexts(found.frame).collect()}
    assert asked["a"].modalities == ["accelerometer"] and asked["a"].sampling_rates_hz == [10.0, 10.0] and asked["b"].duration_seconds == pytest.approx(29.9)
    got = {r.scenario: r for r in benchmark.evaluate(found, store).collect()}
    assert any(r.hqscore_adaptive != r.hqscore_classical for r in got.values())
    assert got["a"].predicted_confidence == pytest.approx((1.0 + 0.95) / 2)


def test_query(spark):
    rows = fusion_queries.scenario_benchmark(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 1 and all(0 <= r.final_score <= 1 and 0.55 <= r.predicted_confidence <= 0.95 for r in rows)
