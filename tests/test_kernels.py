"""Kernels that work by window and by segment, against direct numpy over whole signals."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from sensorloom.operators import alignment, signals

START = datetime(2024, 1, 1)


def pairs(spark, signals_by_key, rate=4.0):
    rows = [(k, i, START + timedelta(seconds=i / rate), rate, float(a), float(b)) for k, (x, y) in signals_by_key.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k string, pos long, ts timestamp, rate_hz double, x double, y double").repartition(5)


def walk(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).cumsum()
    return x, np.r_[x[3:], rng.normal(size=3)][:n] + rng.normal(size=n) / 9


def thin(x, m):
    return x if len(x) <= m else np.interp(np.linspace(0, len(x) - 1, m), np.arange(len(x)), x)


@pytest.mark.parametrize("most", [2, 7, 100])
def test_thinning_equals_interpolation(spark, most):
    data = {str(n): walk(n, n) for n in (1, 2, 7, 8, 13, 99, 100, 101, 350)}
    got = alignment.thinned(pairs(spark, data), ["k"], most).toPandas().sort_values(["k", "pos"])
    for k, (x, y) in data.items():
        mine = got[got.k == k]
        want = thin(x, most)
        assert mine.pos.tolist() == list(range(len(want))) and set(mine.n) == {len(want)}
        assert np.allclose(mine.x, want, atol=1e-9) and np.allclose(mine.y, thin(y, most), atol=1e-9)


def test_windows_of_long_signals(spark):
    """Signals longer than the limit are thinned first; each window is a group of its own."""
    data = {"long": walk(5003, 1), "short": walk(15, 2), "few": walk(11, 3), "mid": walk(90, 4)}
    frame = pairs(spark, data)
    got = alignment.window_lags(frame, ["k"]).orderBy("k", "idx").toPandas()
    assert set(got.k) == {"long", "short", "mid"}
    for k, (x, y) in data.items():
        if k == "few":
            continue
        mine, (a, b) = got[got.k == k], (thin(x, 2000), thin(y, 2000))
        size = 20 if len(a) > 20 else len(a)
        starts = list(range(0, len(a) - size + 1, 10))
        lags = [alignment.peak(a[i : i + size], b[i : i + size], 8) for i in starts]
        assert mine.idx.tolist() == list(range(len(starts)))
        assert np.allclose(mine.offset_seconds, [round(p[0] / 4, 6) for p in lags]) and np.allclose(mine.strength, [p[1] for p in lags], atol=1e-6)
        middles = [START + timedelta(seconds=(i + (size // 2 if size < len(a) else len(a) // 2)) / 4) for i in starts]
        assert [t.to_pydatetime() for t in mine.mid] == middles
        warp = signals.dtw(thin(a, 600), thin(b, 600)) / (2 * len(a) * (a.std() + b.std() + 1e-6))
        assert np.allclose(mine.warp, min(1.0, warp))


@pytest.mark.parametrize("n", [40, 256, 700, 5003])
def test_spectra_of_whole_signals(spark, n):
    x, y = walk(n, n)
    y = np.sin(np.arange(n) / 3) + y / 50
    frame = pairs(spark, {"a": (x, y), "b": (y, x)})
    got = {r.k: r.coherence for r in signals.mean_coherence(frame, ["k"]).collect()}
    assert got["a"] == pytest.approx(signals.coherence(x, y)) and got["b"] == pytest.approx(signals.coherence(y, x))
    tops = {r.k: r for r in signals.dominant_frequencies(frame, ["k"], 20.0).collect()}
    if n <= 2000:
        assert tops["a"].freq_x == pytest.approx(signals.dominant_frequency(x, 20.0)) and tops["a"].freq_y == pytest.approx(signals.dominant_frequency(y, 20.0))
    assert tops["b"].freq_x == pytest.approx(20 / (6 * np.pi), abs=2 * 20 / min(n, 2000)) and tops["b"].freq_x == tops["a"].freq_y


def test_no_group_is_larger_than_a_segment(spark):
    frame = pairs(spark, {"a": walk(5003, 1)})
    parts = signals.segments(frame, ["k"], 256).groupBy("k", "segment").agg(F.count(F.lit(1)).alias("n"))
    assert {r.n for r in parts.collect()} == {256} and parts.count() == (5003 - 256) // 128 + 1
