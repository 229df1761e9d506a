"""Similarity of two signals: distributions, cross-correlation, noise; and small grouped kernels in numpy.

Pairs are positional: rows carry (keys, pos, x, y). The numpy kernels get one segment of a signal pair per group; what
they give for each frequency is averaged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.columns import clip

BINS = 47


def histogram_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric Kullback-Leibler divergence of two histograms over the joint range, and exp(-kl)."""
    ends = pairs.groupBy(*keys).agg(F.min(F.least("x", "y")).alias("lo"), F.max(F.greatest("x", "y")).alias("hi"), F.count(F.lit(1)).alias("n"))
    long = pairs.select(*keys, F.explode(F.array(F.struct(F.lit("x").alias("s"), F.col("x").alias("v")), F.struct(F.lit("y").alias("s"), F.col("y").alias("v")))).alias("p")).select(*keys, "p.*")
    placed = long.join(ends, keys).where("hi > lo")
    bins = placed.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)))
    counts = bins.groupBy(*keys, "bin").agg(F.sum((F.col("s") == "x").cast("double")).alias("cx"), F.sum((F.col("s") == "y").cast("double")).alias("cy"))
    every = ends.where("hi > lo").select(*keys, "lo", "hi", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))).alias("bin"))
    filled = every.join(counts, [*keys, "bin"], "left")
    density = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("n") / ((F.col("hi") - F.col("lo")) / BINS) + 1e-9
    w = Window.partitionBy(*keys)
    shares = filled.withColumn("px", density("cx")).withColumn("py", density("cy")).withColumn("p", F.col("px") / F.sum("px").over(w)).withColumn("q", F.col("py") / F.sum("py").over(w))
    kl = 0.5 * F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q")))
    return shares.groupBy(*keys).agg(kl.alias("kl")).withColumn("kl_similarity", clip(F.exp(-F.col("kl"))))


def wasserstein(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of equally ranked values, and its similarity exp(-w / 3 sigma)."""
    ranked = lambda c: pairs.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("rank"), F.col(c).alias(c + "v"))
    both = ranked("x").join(ranked("y"), [*keys, "rank"])
    total, squares, n = F.sum(F.col("xv") + F.col("yv")), F.sum(F.col("xv") * F.col("xv") + F.col("yv") * F.col("yv")), 2 * F.count(F.lit(1))
    out = both.groupBy(*keys).agg(F.avg(F.abs(F.col("xv") - F.col("yv"))).alias("distance"), F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))).alias("sigma"))
    return out.withColumn("similarity", clip(F.exp(-F.col("distance") / (3 * (F.col("sigma") + 1e-6)))))


def cross_correlation(pairs: DataFrame, keys: list[str], block: int = 1 << 17, absolute: bool = False) -> DataFrame:
    """keys, n, lag, peak: of the mean-centred signed (or ``absolute``) cross-correlation over all lags of the whole signals.

    Signals are cut into blocks of positions; each pair of blocks gives its sums per lag by FFT, as long as the two need,
    which are added up. A signal within a block takes n log n; of b blocks every two meet.
    """
    root = lambda c: F.sqrt(F.var_pop(c) * F.count(F.lit(1)))
    stats = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (root("x") * root("y")).alias("norm"))
    place = F.floor(F.col("pos") / block).cast("long")
    rows = F.collect_list(F.struct((F.col("pos") - place * block).cast("long").alias("at"), F.coalesce("x", F.lit(float("nan"))).alias("x"), F.coalesce("y", F.lit(float("nan"))).alias("y")))
    blocks = pairs.groupBy(*keys, place.alias("i")).agg(rows.alias("v"))
    left = blocks.join(stats.select(*keys, "mx", "my"), keys).select(*keys, "i", "mx", "my", F.col("v.at").alias("at"), F.col("v.x").alias("x"))
    right = blocks.select(*keys, F.col("i").alias("j"), F.col("v.at").alias("bt"), F.col("v.y").alias("y"))
    both = left.join(right, keys).withColumn("shift", (F.col("i") - F.col("j")) * block).drop("i", "j")

    def spread(at: np.ndarray, values: np.ndarray, mean: float, size: int) -> np.ndarray:
        """Spectra of the centred values and of their number at each place of a block."""
        out, some = np.zeros((2, size)), ~np.isnan(values)
        np.add.at(out, (0, at[some]), values[some] - mean)
        np.add.at(out, (1, at), 1)
        return np.fft.rfft(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                at, x, bt, y = (row.column(c).flatten().to_numpy() for c in ("at", "x", "bt", "y"))
                mx, my = (row.column(c)[0].as_py() or 0.0 for c in ("mx", "my"))
                size = 1 << int(at.max() + bt.max() + 1).bit_length()  # of lags -max(bt) to max(at) no two meet
                sums, counts = np.fft.irfft(spread(at, x, mx, size) * spread(bt, y, my, size).conj(), size)
                some = np.flatnonzero(counts > 0.5)
                lags = row.column("shift")[0].as_py() + np.where(some <= at.max(), some, some - size)
                columns = [pa.repeat(row.column(c)[0], len(some)) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lags, pa.int64()), pa.array(sums[some])], [*keys, "lag", "corr"])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)
    sums = both.mapInArrow(run, f"{kinds}, lag long, corr double").groupBy(*keys, "lag").agg(F.sum("corr").alias("corr"))
    best = sums.groupBy(*keys).agg(F.max(F.struct((F.round(F.abs("corr") if absolute else "corr", 9) + 0.0).alias("corr"), (-F.col("lag")).alias("minus"))).alias("m"))
    return best.join(stats, keys).select(*keys, "n", (-F.col("m.minus")).alias("lag"), (F.col("m.corr") / (F.col("norm") + 1e-9)).alias("peak"))


def snr(signal: DataFrame, keys: list[str], value: str = "x", window: int = 31) -> DataFrame:
    """Variance of the zero-padded moving average over that of the rest."""
    half = window // 2
    smooth = F.sum(value).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(-half, half)) / window
    rows = signal.withColumn("smooth", smooth).withColumn("noise", F.col(value) - F.col("smooth"))
    return rows.groupBy(*keys).agg((F.var_pop("smooth") / (F.var_pop("noise") + 1e-9)).alias("snr"))


def dominant_frequency(x: np.ndarray, rate: float) -> float:
    if len(x) < 2:
        return 0.0
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
    power[0] = 0
    return float(np.fft.rfftfreq(len(x), 1 / rate)[int(np.argmax(power))])


def coherence(x: np.ndarray, y: np.ndarray, segment: int = 256) -> float:
    """Mean magnitude-squared coherence by Welch's method: periodic Hann windows, half overlap, means removed."""
    n = min(segment, len(x))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    cut = lambda s: np.fft.rfft(np.stack([(p - p.mean()) * taper for p in (s[k : k + n] for k in range(0, len(s) - n + 1, n - n // 2))]), axis=1)
    a, b = cut(x), cut(y)
    cross, pa, pb = (a * b.conj()).mean(0), (abs(a) ** 2).mean(0), (abs(b) ** 2).mean(0)
    return float(np.mean(np.abs(cross) ** 2 / np.maximum(pa * pb, 1e-300)))


def dtw(x: np.ndarray, y: np.ndarray) -> float:
    """Dynamic time warping cost by anti-diagonals, absolute distance, no band."""
    n, m = len(x), len(y)
    if not n or not m:
        return 0.0
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    last[0] = 0.0  # diagonal 0 holds cell (0, 0); index i is the place in x
    for d in range(1, n + m + 1):
        now = np.full(n + 1, np.inf)
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if len(i):
            now[i] = np.abs(x[i - 1] - y[d - i - 1]) + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
        before, last = last, now
    return float(last[n])


def partial_spectrum(v: np.ndarray, first: int, n: int, start: int, stop: int) -> np.ndarray:
    """What a signal's places from ``first`` on, the last axis of ``v``, add to bins ``start`` to ``stop`` of the spectrum of all its n places.

    By a chirp transform, as n need not be a product; the integers in its phases stay exact up to n = 2**31.
    """
    if v.shape[-1] == n:
        return np.fft.rfft(v)[..., start:stop]
    at, bins = np.arange(v.shape[-1]), np.arange(stop - start)
    turn, half = lambda z: np.exp(-2j * np.pi * (z % n) / n), lambda z: np.exp(-1j * np.pi * (z * z % (2 * n)) / n)
    size = 1 << (len(at) + len(bins)).bit_length()
    chirp = np.zeros(size, complex)
    chirp[: len(bins)], chirp[size - len(at) + 1 :] = half(bins).conj(), half(at[:0:-1]).conj()
    both = np.fft.ifft(np.fft.fft(v * turn(at * start) * half(at), size) * np.fft.fft(chirp))
    return both[..., : len(bins)] * half(bins) * turn(first * (start + bins))


def waves(pairs: DataFrame, keys: list[str], block: int = 1 << 17, segment: int = 256) -> DataFrame:
    """keys, n, bin_x, bin_y, coherence, snr_x, snr_y: of whole signals at positions 0 to n - 1, whatever n is.

    The number of the dominant frequency (0 without one) in one spectrum of all rows under a Hann taper, Hertz being its number times
    rate / n; coherence as the function ``coherence``; variance of the zero-padded moving average, of a twentieth of the rows but 5 to
    31, over that of the rest. A task holds a block of positions and some rows beyond its ends, and gives its sums, which are added up. A
    signal within a block takes n log n; of longer ones each block of positions meets each of frequencies.
    """
    # Of a constant nothing is left, not what its mean was rounded by.
    mean = lambda c: F.when(F.min(c) < F.max(c), F.avg(c)).otherwise(F.min(c))
    stats = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), mean("x").alias("mx"), mean("y").alias("my"))
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - segment) / block)).cast("long"), F.floor((F.col("pos") + 15) / block).cast("long"))
    blocks = pairs.select(*keys, "pos", "x", "y", F.explode(near).alias("i")).groupBy(*keys, "i").agg(F.collect_list(F.struct("pos", "x", "y")).alias("v"))
    blocks = blocks.join(stats, keys).where(F.col("i") * block < F.col("n"))
    bins = F.sequence(F.lit(0).cast("long"), F.floor(F.floor(F.col("n") / 2) / block).cast("long"))
    rows = blocks.select(*keys, "n", "mx", "my", "i", F.explode(bins).alias("j"), F.col("v.pos").alias("pos"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))

    four = ["_a", "_b", "_c", "_d"]

    def sums(pos: np.ndarray, values: np.ndarray, means: np.ndarray, n: int, first: int, start: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Kind of the sums, first bin, and four sums for each bin."""
        low, stop = int(pos.min()), min(first + block, n)
        v = np.zeros((2, int(pos.max()) - low + 1))
        v[:, pos - low] = values
        own = v[:, first - low : stop - low]
        fx, fy = partial_spectrum((own - means) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(first, stop) / max(1, n - 1))), first, n, start, min(start + block, n // 2 + 1))
        yield 0, start, np.stack([fx.real, fx.imag, fy.real, fy.imag])
        if start:
            return
        size = min(segment, n)
        step = size - size // 2
        begins = np.arange(-(-first // step) * step, min(stop, n - size + 1), step)
        parts = v[:, begins[:, None] + np.arange(size) - low]
        fx, fy = np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)))
        cross = (fx * fy.conj()).sum(0)
        yield 1, 0, np.stack([(abs(fx) ** 2).sum(0), (abs(fy) ** 2).sum(0), cross.real, cross.imag])
        width = min(31, max(5, n // 20)) | 1
        left, right = first - width // 2, stop + width // 2
        padded = np.zeros((2, right - left))
        padded[:, max(0, left) - left : min(n, right) - left] = v[:, max(0, left) - low : min(n, right) - low]
        smooth = np.stack([np.convolve(p, np.full(width, 1 / width), "valid") for p in padded])
        rest, smooth = own - smooth, smooth - means
        yield 2, 0, np.stack([smooth.sum(1), (smooth**2).sum(1), rest.sum(1), (rest**2).sum(1)]) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                pos, x, y = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pos", "x", "y"))
                mx, my, n, i, j = (row.column(c)[0].as_py() for c in ("mx", "my", "n", "i", "j"))
                for kind, start, found in sums(pos, np.stack([x, y]), np.array([[mx], [my]]), n, i * block, j * block):
                    size = found.shape[1]
                    own = [pa.repeat(row.column(c)[0], size) for c in [*keys, "n"]]
                    yield pa.RecordBatch.from_arrays([*own, pa.repeat(pa.scalar(kind, pa.int32()), size), pa.array(np.arange(start, start + size)), *map(pa.array, found)], [*keys, "n", "kind", "bin", *four])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)
    total = rows.mapInArrow(run, f"{kinds}, n long, kind int, bin long, " + ", ".join(f"{c} double" for c in four)).groupBy(*keys, "n", "kind", "bin").agg(*(F.sum(c).alias(c) for c in four))
    a, b, c, d, number = (F.col(name) for name in (*four, "bin"))
    of = lambda kind, value, which=F.lit(True): F.when((F.col("kind") == kind) & which, value)
    top = lambda re, im: F.max(of(0, F.struct((re * re + im * im).alias("p"), (-number).alias("minus")), number > 0))
    share, noise = (c * c + d * d) / F.greatest(a * b, F.lit(1e-300)), (b - a * a) / (d - c * c + 1e-9)
    best = total.groupBy(*keys, "n").agg(top(a, b).alias("_x"), top(c, d).alias("_y"), F.avg(of(1, share)).alias("coherence"), *(F.max(of(2, noise, number == k)).alias(f"snr_{v}") for k, v in enumerate("xy")))
    return best.select(*keys, "n", *(F.when(F.col(f"_{v}.p") > 0, -F.col(f"_{v}.minus")).otherwise(0).alias(f"bin_{v}") for v in "xy"), "coherence", "snr_x", "snr_y")


def segments(pairs: DataFrame, keys: list[str], size: int, overlap: bool = True) -> DataFrame:
    """keys, segment, n (rows of a segment), pos, x, y: each row once for every segment of its pair that holds it.

    Segments of ``size`` rows, or of all rows of a shorter pair, half overlapping; rows after the last whole one are left out.
    """
    rows = pairs.join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")), keys).withColumn("n", F.least(F.col("_all"), F.lit(size)).cast("long"))
    step = F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") / 2)) if overlap else F.col("n")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("n") + 1) / step)).cast("long")
    last = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_all") - F.col("n")) / step)).cast("long")
    return rows.where(first <= last).select(*keys, "n", "pos", "x", "y", F.explode(F.sequence(first, last)).alias("segment"))


def spectra(pairs: DataFrame, keys: list[str], size: int, periodic: bool = True) -> DataFrame:
    """keys, bin (number of the frequency), n, px, py, re, im: power and cross spectra by Welch's method, means over the segments.

    ``periodic``: kind of the Hann taper. A task holds a segment; sums over segments combine on the map side.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = len(rows)
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if periodic else np.hanning(n)
        fx, fy = (np.fft.rfft((rows[c].to_numpy(float) - rows[c].mean()) * taper) for c in "xy")
        cross = fx * fy.conj()
        out = pd.DataFrame({"bin": np.arange(len(fx)), "n": n, "px": abs(fx) ** 2, "py": abs(fy) ** 2, "re": cross.real, "im": cross.imag})
        for c in reversed(keys):
            out.insert(0, c, rows[c].iloc[0])
        return out

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)
    each = segments(pairs.select(*keys, "pos", "x", "y"), keys, size).groupBy(*keys, "segment").applyInPandas(run, f"{kinds}, bin long, n long, px double, py double, re double, im double")
    return each.groupBy(*keys, "bin").agg(F.max("n").alias("n"), *(F.avg(c).alias(c) for c in ("px", "py", "re", "im")))


def mean_coherence(pairs: DataFrame, keys: list[str], segment: int = 256) -> DataFrame:
    """keys, coherence: as the function ``coherence``, of signals of any length."""
    share = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.greatest(F.col("px") * F.col("py"), F.lit(1e-300))
    return spectra(pairs, keys, segment).groupBy(*keys).agg(F.avg(share).alias("coherence"))


def dominant_frequencies(pairs: DataFrame, keys: list[str], rate: float, segment: int = 2000) -> DataFrame:
    """keys, freq_x, freq_y: where the mean power over segments is greatest, the mean left out; of equals the least."""
    top = lambda c: F.max(F.when(F.col("bin") > 0, F.struct(F.col(c).alias("p"), (-F.col("bin")).alias("minus"))))
    best = spectra(pairs, keys, segment, periodic=False).groupBy(*keys).agg(top("px").alias("_x"), top("py").alias("_y"), F.max("n").alias("n"))
    return best.select(*keys, *(F.coalesce(-F.col(f"_{c}.minus") * rate / F.col("n"), F.lit(0.0)).alias(f"freq_{c}") for c in "xy"))


def pair_kernels(pairs: DataFrame, key: str, rate: float, dtw_points: int = 600) -> DataFrame:
    """key, dominant frequencies, coherence and normalised warping cost of each signal pair, all rows of it."""
    from sensorloom.operators import alignment

    rows = pairs.select(key, "pos", "x", "y")
    warps = alignment.warping(alignment.thinned(rows, [key], alignment.POINTS), [key], dtw_points)
    return dominant_frequencies(rows, [key], rate).join(mean_coherence(rows, [key]), key).join(warps.withColumnRenamed("warp", "dtw"), key)
