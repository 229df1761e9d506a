"""Similarity of whole signals, longer ones too, against direct computations in numpy over all of their rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sensorloom.operators import scoring, signals
from sensorloom.plans import fusion_queries
from test_fusion_report import NAMES, WEIGHTS, coherence, components, correlations, frequency, noise, report

SIZES = [16, 31, 40, 257, 700, 2600, 5003]


def waves_like(n):
    """A tone in noise and what is like it only up to position 2000."""
    rng = np.random.default_rng(n)
    x = np.sin(np.arange(n) * 0.7) + 0.5 * rng.normal(size=n) + 9.8
    y = np.r_[x[:2000] + 0.3 * rng.normal(size=min(n, 2000)), 3 * np.sin(np.arange(max(0, n - 2000)) * 1.9) + 4]
    return x, y


def pairs(spark, data):
    rows = [(k, "acc", "a", "b", i, 20.0, float(a), float(b)) for k, (x, y) in data.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k string, sensor string, a string, b string, pos long, rate_hz double, x double, y double").repartition(5)


@pytest.mark.parametrize("block", [64, 1000, 1 << 17])
def test_blocks_give_what_whole_signals_give(spark, block):
    data = {str(n): waves_like(n) for n in SIZES}
    got = {r.k: r for r in signals.waves(pairs(spark, data), ["k"], block).collect()}
    assert set(got) == set(data)
    for k, (x, y) in data.items():
        one, n = got[k], len(x)
        assert one.n == n and [one.bin_x * 20 / n, one.bin_y * 20 / n] == pytest.approx([frequency(x, 20.0), frequency(y, 20.0)])
        assert one.coherence == pytest.approx(coherence(x, y)) and [np.log10(v + 1) for v in (one.snr_x, one.snr_y)] == pytest.approx([noise(x), noise(y)])


def test_components_see_every_position(spark):
    data = {str(n): waves_like(n) for n in SIZES if n >= 32}
    got = {r.k: r for r in scoring.components(pairs(spark, data), ["k"]).collect()}
    for k, (x, y) in data.items():
        assert [got[k][c] for c in ("distribution", "spectral", "temporal", "snr")] == pytest.approx(components(x, y, 20.0)), k


def test_constant_signals_have_no_frequency_and_no_lag(spark):
    """Whatever their mean is rounded by."""
    got = scoring.components(pairs(spark, {"q": (np.full(3001, 0.1), np.full(3001, 0.7))}), ["k"]).head()
    assert (got.frequency, got.peak, got.temporal) == (1.0, 0.0, 0.25)


def test_pairs_have_every_position(spark):
    axes = [f"acc_{a}" for a in "xyz"]
    rows = spark.range(2500).select(F.lit("p").alias("participant_id"), F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("dataset_id"), F.timestamp_millis(F.col("id") * 50).alias("ts"), *(F.col("id").cast("double").alias(c) for c in axes))
    has = rows.select("participant_id", "dataset_id").distinct().select("*", *(F.lit(True).alias("has_" + c) for c in axes))
    found = scoring.pair_signals(rows, has, ["participant_id"])
    assert [r.pos for r in found.orderBy("pos").collect()] == list(range(2500))


def whole_score(values, stability):
    """The score of n rows of twelve channels whose drift has the given stability."""
    a, b, n = values[:, :6], values[:, 6:12], len(values)
    length = lambda v: np.sqrt((v**2).sum(1))
    shift = int(np.clip(np.argmax(np.round(correlations(length(a[:, :3]), length(b[:, :3])), 9)) - n + 1, -100, 100)) if n >= 50 else 0
    a, b = a[max(0, shift) : n + min(0, shift)], b[max(0, -shift) : n - max(0, shift)]
    parts = np.mean([components(length(a[:, k]), length(b[:, k]), 20.0) for k in (slice(0, 3), slice(3, 6))], axis=0)
    return float(np.dot(WEIGHTS, [*parts[:3], 0.45, 0.45, 0.7 * stability + 0.3 * parts[3]]))


def assert_whole(rows, table):
    """Every column of the query's rows, with the score of whole signals."""
    found = {r.participant_id: [r[c] for c in NAMES] for r in rows}
    assert len(rows) == len(found) and set(found) == {str(k) for k in table["label"].unique()}
    for label, own in table.sort_values("vec_id").groupby("label"):
        values = np.stack(own["embedding"].to_list())[:, :12].astype(float)
        want = report(values)
        score = whole_score(values, want[NAMES.index("stability")])
        want[NAMES.index("hqscore")], want[NAMES.index("confidence")] = score, "High" if score >= 0.8 else "Medium" if score >= 0.55 else "Low"
        assert found[str(label)] == [pytest.approx(w, abs=6e-5) if isinstance(w, float) else w for w in want], label


def test_score_of_signals_that_change_late(spark, tmp_path):
    """Two datasets that are like each other in their first 2000 rows and not after them; and a short one."""
    rng, made, at = np.random.default_rng(8), [], 0
    for label, n in enumerate([3100, 2049, 300]):
        first = np.cumsum(rng.normal(size=(n, 6)), axis=0) * 0.05 + rng.normal(size=(n, 6)) + 1
        second = first + 0.1 * rng.normal(size=(n, 6))
        second[2000:] = 4 + 3 * rng.normal(size=(max(0, n - 2000), 6))
        made.append(pd.DataFrame({"vec_id": range(at, at + n), "embedding": np.hstack([first, second]).astype(np.float32).tolist(), "label": label}))
        at += n
    table = pd.concat(made)
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_whole(fusion_queries.fuse_by_label(spark, str(tmp_path)).collect(), table)
