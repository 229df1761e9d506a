"""The whole report of ``fuse_by_label`` against a direct computation in numpy, one label after the other."""

import numpy as np
import pandas as pd
import pytest
from sensorloom.plans import fusion_queries

WEIGHTS = (0.22, 0.24, 0.24, 0.13, 0.07, 0.10)  # of temporal_spectral
NAMES = "master_rate_hz overlap_seconds drift_detected drift_type stability missingness coverage divergence task profile hqscore confidence".split()


def correlations(x, y):
    """Sums of the centred products at the lags 1 - n to n - 1."""
    n, size = len(x), 1 << (2 * len(x)).bit_length()
    all_lags = np.fft.irfft(np.fft.rfft(x - x.mean(), size) * np.conj(np.fft.rfft(y - y.mean(), size)), size)
    return np.concatenate([all_lags[size - n + 1 :], all_lags[:n]])


def peak(x, y):
    """Lag and height of the greatest absolute correlation."""
    corr, norm = np.abs(correlations(x, y)), np.sqrt(((x - x.mean()) ** 2).sum() * ((y - y.mean()) ** 2).sum()) + 1e-9
    at = int(np.argmax(np.round(corr, 9)))
    return at - len(x) + 1, min(1.0, corr[at] / norm)


def warping_cost(x, y):
    above = [0.0] + [np.inf] * len(y)
    for a in x:
        row = [np.inf]
        for j, d in enumerate(np.abs(y - a).tolist()):
            row.append(d + min(above[j], above[j + 1], row[j]))
        above = row
    return above[-1]


def thinned(v, most):
    return v if len(v) <= most else np.interp(np.arange(most) * (len(v) - 1) / (most - 1), np.arange(len(v)), v)


def histogram_distance(x, y, bins=47):
    low, high = min(x.min(), y.min()), max(x.max(), y.max())
    places = [np.minimum(np.floor((v - low) / (high - low) * bins), bins - 1).astype(int) for v in (x, y)]
    p, q = (np.bincount(k, minlength=bins) / len(x) / ((high - low) / bins) + 1e-9 for k in places)
    p, q = p / p.sum(), q / q.sum()
    return 0.5 * float(((p - q) * np.log(p / q)).sum())


def frequency(v, rate):
    power = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v)))) ** 2
    return (1 + int(np.argmax(power[1:]))) * rate / len(v)


def coherence(x, y):
    n = min(256, len(x))
    starts, taper = range(0, len(x) - n + 1, n - n // 2), np.hanning(n + 1)[:n]
    fx, fy = (np.array([np.fft.rfft((v[k : k + n] - v[k : k + n].mean()) * taper) for k in starts]) for v in (x, y))
    cross, px, py = (fx * fy.conj()).mean(0), (np.abs(fx) ** 2).mean(0), (np.abs(fy) ** 2).mean(0)
    return float((np.abs(cross) ** 2 / np.maximum(px * py, 1e-300)).mean())


def noise(v):
    width = min(31, max(5, len(v) // 20)) | 1
    smooth = np.convolve(v, np.ones(width) / width, mode="same")
    return np.log10(smooth.var() / ((v - smooth).var() + 1e-9) + 1)


def components(x, y, rate):
    """distribution, spectral, temporal, snr of two signals of 32 samples or more."""
    both = np.concatenate([x, y])
    near = np.exp(-np.abs(np.sort(x) - np.sort(y)).mean() / (3 * (both.std() + 1e-6)))
    spectral = 0.5 * np.exp(-abs(frequency(x, rate) - frequency(y, rate)) / (rate / 12 + 1e-6)) + 0.5 * coherence(x, y)
    lag, height = peak(x, y)
    return 0.5 * np.exp(-histogram_distance(x, y)) + 0.5 * near, spectral, 0.75 * height + 0.25 / (1 + abs(lag) / max(1.0, 0.05 * len(x))), 1 - min(1.0, abs(noise(x) - noise(y)) / 2)


def report(values, rate=20.0):
    """``values``: n rows of twelve channels, two datasets of acceleration and rotation at 20 Hz, nothing missing."""
    a, b, n = values[:, :6], values[:, 6:12], len(values)
    length = lambda v: np.sqrt((v**2).sum(1))
    shift = 0
    if n >= 50:  # the first of equal peaks, at most five seconds
        shift = int(np.clip(np.argmax(np.round(correlations(length(a[:, :3]), length(b[:, :3])), 9)) - n + 1, -100, 100))
    a, b = a[max(0, shift) : n + min(0, shift)], b[max(0, -shift) : n - max(0, shift)]
    gaps = np.minimum(1.0, np.abs(a.mean(0) - b.mean(0)) / (a.std(0) + b.std(0) + 1e-9) / 3)
    parts = np.mean([components(length(a[:2000, k]), length(b[:2000, k]), rate) for k in (slice(0, 3), slice(3, 6))], axis=0)

    x, y = (thinned(length(v[:, :3]), 2000) for v in (a, b))
    size = min(100, len(x))
    lags = np.array([round(peak(x[k : k + size], y[k : k + size])[0] / rate, 6) for k in range(0, len(x) - size + 1, 50)])
    offset, slope = np.abs(lags).mean(), np.polyfit(np.arange(len(lags)), lags, 1)[0] if len(lags) > 1 else 0.0
    warp = min(1.0, warping_cost(thinned(x, 600), thinned(y, 600)) / (2 * len(x) * (x.std() + y.std() + 1e-6)))
    drift = "none" if offset < 0.01 and abs(slope) < 0.0005 and warp < 0.12 else "minor" if offset < 0.05 and abs(slope) < 0.002 and warp < 0.35 else "significant"
    stability = max(0.0, 1 - 0.5 * min(1.0, offset / 0.1) - 0.3 * min(1.0, abs(slope) / 0.005) - 0.2 * warp)

    score = float(np.dot(WEIGHTS, [*parts[:3], 0.45, 0.45, 0.7 * stability + 0.3 * parts[3]]))
    level = "High" if score >= 0.8 else "Medium" if score >= 0.55 else "Low"
    return [rate, round((len(a) - 1) / rate, 3), drift != "none", drift, stability, 0.55, 0.45, gaps.mean(), "Human Activity Recognition", "temporal_spectral", score, level]


def assert_same(rows, table):
    """Rows of the query against the table of vec_id, label and embedding, figures but for what they are rounded by."""
    found = {r.participant_id: [r[c] for c in NAMES] for r in rows}
    assert len(rows) == len(found) and set(found) == {str(k) for k in table["label"].unique()}
    for label, own in table.sort_values("vec_id").groupby("label"):
        assert found[str(label)] == [pytest.approx(w, abs=6e-5) if isinstance(w, float) else w for w in report(np.stack(own["embedding"].to_list())[:, :12].astype(float))], label


def test_report_of_long_and_short_labels(spark, tmp_path):
    """Longer and shorter than what drift and similarity look at (2000 places), and too short for an offset (50)."""
    rng, sizes = np.random.default_rng(5), [2600, 900, 70, 45]
    ids, made = np.split(3 * rng.permutation(sum(sizes)), np.cumsum(sizes)[:-1]), []  # labels mixed, ids with gaps
    for label, n in enumerate(sizes):
        first = np.cumsum(rng.normal(size=(n + 40, 6)), axis=0) * 0.05 + rng.normal(size=(n + 40, 6)) + 1
        second = first[:n] + 0.3 * rng.normal(size=(n, 6))  # what the first has at i is at i + 7 * label here
        values = np.hstack([first[7 * label : n + 7 * label], second]).astype(np.float32)
        made.append(pd.DataFrame({"vec_id": np.sort(ids[label]), "embedding": values.tolist(), "label": label}))
    table = pd.concat(made)
    table = table.sample(frac=1, random_state=1)
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(fusion_queries.fuse_by_label(spark, str(tmp_path)).collect(), table)
