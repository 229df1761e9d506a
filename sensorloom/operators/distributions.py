"""Distributions of columns as histograms, their Jensen-Shannon divergence, and completeness scores by modality."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.operators import rates

#: Added to densities and to their sums before they become shares. Fixed value.
TINY = 1e-8


def histograms(frame: DataFrame, keys: list[str], columns: list[str], bins: int, least: int, edges: DataFrame | None = None) -> DataFrame:
    """keys, column_name, n, lo, hi, counts (an array, a number for each of ``bins``) of columns with ``least`` values.

    The bins lie evenly between the column's extremes, half a unit around a column that never varies, or between
    ``edges`` (column_name, lo, hi). Values are counted by (keys, column, bin) before anything is gathered.
    """
    long = frame.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select(*keys, "s.*").where("v is not null")
    if edges is None:
        ends = long.groupBy(*keys, "column_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        flat = F.col("lo") == F.col("hi")
        placed = long.join(ends.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))}), [*keys, "column_name"])
    else:
        placed = long.join(edges.select("column_name", "lo", "hi"), "column_name")
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = placed.groupBy(*keys, "column_name", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy(*keys, "column_name", "lo", "hi").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))  # at most ``bins`` entries
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("_m")[b], F.lit(0)))
    return found.where(F.col("n") >= least).select(*keys, "column_name", "n", "lo", "hi", counts.alias("counts"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def shares(counts: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Densities of a histogram with something tiny in each bin, as shares."""
    density = F.transform(counts, lambda c: c / (total(counts) * (hi - lo) / bins) + TINY)
    return F.transform(density, lambda d: d / total(density))


def jensen_shannon(p: Column, q: Column, base: float | None = None) -> Column:
    """Divergence of two arrays of shares, in units of ``base`` (natural ones without): 0 for equal, log 2 at most."""
    side = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * F.ln(2 * x / (x + y))))
    out = F.greatest(F.lit(0.0), (side(p, q) + side(q, p)) / 2)
    return out if base is None else out / F.ln(F.lit(base))


def against_uniform(frame: DataFrame, keys: list[str], columns: list[str], bins: int = 50, least: int = 50) -> DataFrame:
    """keys, column_name, similarity: 1 less the divergence from a distribution that has every bin alike."""
    rows = histograms(frame, keys, columns, bins, least)
    p = rows.select(*keys, "column_name", shares(F.col("counts"), F.col("lo"), F.col("hi"), bins).alias("p"))
    even = F.array_repeat(F.lit(1.0 / bins), bins)
    return p.select(*keys, "column_name", (1 - jensen_shannon(F.col("p"), even)).alias("similarity"))


def against_all(frame: DataFrame, keys: list[str], columns: list[str], bins: int = 30, least: int = 30) -> DataFrame:
    """keys, column_name, similarity: 1 less the distance (root of the divergence) from the column's values in all groups.

    With one group this is a column against itself, and 1.
    """
    whole = histograms(frame, [], columns, bins, least)
    each = histograms(frame, keys, columns, bins, least, whole)
    q = whole.select("column_name", shares(F.col("counts"), F.col("lo"), F.col("hi"), bins).alias("q"))
    p = each.select(*keys, "column_name", shares(F.col("counts"), F.col("lo"), F.col("hi"), bins).alias("p"))
    return p.join(q, "column_name").select(*keys, "column_name", (1 - F.sqrt(jensen_shannon(F.col("p"), F.col("q")))).alias("similarity"))


def mean_similarity(rows: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """keys, similarity: the mean over columns; 1 for a group without any column that is long enough."""
    return groups.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.avg("similarity").alias("similarity")), keys, "left").select(*keys, F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def by_modality(frame: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """keys, completeness (weighted over modalities; absent ones count as none missing), regularity, score.

    Regularity is 1 / (1 + the sample deviation of the gaps), a half with fewer than two gaps.
    """
    parts = []
    for names, weight, _ in registry.MODALITIES.values():
        used = [c for c in names if c in frame.columns]
        parts.append(weight * (1 - reduce(add, [F.avg(F.col(c).isNull().cast("double")) for c in used]) / len(used)) if used else F.lit(weight))
    rows = rates.with_gap(frame, keys, ts).groupBy(*keys).agg(reduce(add, parts).alias("completeness"), F.coalesce(1 / (1 + F.stddev_samp("gap")), F.lit(0.5)).alias("regularity"))
    return rows.withColumn("score", F.round(0.8 * F.col("completeness") + 0.2 * F.col("regularity"), 4))
