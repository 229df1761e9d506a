import numpy as np
import pytest
from sensorloom.operators import signals


def slow_dtw(x, y):
    cost = np.full((len(x) + 1, len(y) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            cost[i, j] = abs(x[i - 1] - y[j - 1]) + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    return cost[-1, -1]


@pytest.mark.parametrize(("n", "m"), [(1, 1), (5, 9), (30, 17), (40, 40)])
def test_dtw(n, m):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.normal(size=m)
    assert signals.dtw(x, y) == pytest.approx(slow_dtw(x, y))


def test_dominant_frequency():
    t = np.arange(400) / 50
    assert signals.dominant_frequency(np.sin(2 * np.pi * 5 * t) + 3, 50) == pytest.approx(5, abs=0.2)


def test_coherence():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=2000), rng.normal(size=2000)
    assert signals.coherence(x, 2 * x + 1) == pytest.approx(1, abs=1e-6)
    assert signals.coherence(x, y) < 0.3
    assert signals.coherence(x[:200], y[:200]) == pytest.approx(1)  # one segment says nothing


def test_cross_correlation_shift(spark):
    base = np.zeros(40)
    base[10] = 1
    rows = [("a", i, float(base[(i - 3) % 40]), float(base[i])) for i in range(40)]
    got = signals.cross_correlation(spark.createDataFrame(rows, "k string, pos long, x double, y double"), ["k"]).head()
    # A centred unit pulse, shifted by 3 of 40: its own correlation less what falls off the ends.
    assert got.lag == 3 and got.peak == pytest.approx((0.975 - 3 / 1600) / 0.975, abs=1e-6)


def test_cross_correlation_reads_all_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=2000)
    x, y = base[:1300], base[650:1950]
    rows = [(k, i, float(a), float(b)) for k, s in (("a", 1), ("b", -1)) for i, (a, b) in enumerate(zip(x[::s], y[::s], strict=True))]
    frame = spark.createDataFrame(rows, "k string, pos long, x double, y double")
    for r in signals.cross_correlation(frame, ["k"], 256).collect():
        a, b = (s[:: 1 if r.k == "a" else -1] - s.mean() for s in (x, y))
        full = np.correlate(a, b, "full")
        assert r.lag == int(full.argmax()) - 1299 and abs(r.lag) == 650
        assert r.peak == pytest.approx(full.max() / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-6)


def test_signal_queries_read_all_rows(spark, tmp_path):
    """Rows from 2000 on count: all signals there are of another size."""
    from sensorloom.plans import queries as plans

    rng = np.random.default_rng(3)
    rows = [(i, i % 5, [float(v) for v in rng.normal(size=12) * (1 if i < 2000 else 50)]) for i in range(2600)]
    for name, n in (("all", 2600), ("part", 2000)):
        spark.createDataFrame(rows[:n], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / name / "embeddings.parquet"))
    for name in ("hist_symmetric_kl", "wasserstein_1d", "snr_consistency", "windowed_offsets", "drift_slope_class", "signal_pair_kernels"):
        a, b = (sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path / x)).collect())) for x in ("all", "part"))
        assert a != b, name
    assert plans.QUERIES["magnitude_overlay_whole"](spark, str(tmp_path / "all")).count() == 2600
    e = np.array([r[2] for r in rows], np.float32).astype(float)
    x, y = (np.sqrt((e[:, k : k + 3] ** 2).sum(axis=1)) for k in (0, 6))
    full = np.correlate(x - x.mean(), y - y.mean(), "full")
    assert plans.QUERIES["xcorr_offset_whole"](spark, str(tmp_path / "all")).head().lag == int(full.argmax()) - 2599
