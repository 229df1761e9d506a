"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """Rounds the scaled double, half away from zero, as SQL engines do; ``F.round`` would round its decimal text."""
    return F.round(x * 10.0**digits) / 10.0**digits


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def normal_label(x: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def magnitude(*axes: Column, nulls: str = "propagate") -> Column:
    """Length of a vector. ``nulls``: 'propagate' (null), 'zero' (null becomes 0), or 'skip' (axes left out)."""
    if nulls == "skip":
        return F.sqrt(reduce(add, [F.coalesce(a * a, F.lit(0.0)) for a in axes]))
    out = F.sqrt(reduce(add, [a * a for a in axes]))
    return F.coalesce(out, F.lit(0.0)) if nulls == "zero" else out


def unit_of(mean_magnitude: Column) -> Column:
    return F.when(mean_magnitude.between(0.7, 1.3), "g").when(mean_magnitude.between(8.0, 11.0), "ms2").otherwise("unknown")


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.55, "Medium").otherwise("Low")


def weighted(weights, components: list[Column]) -> Column:
    return clip(reduce(add, [F.lit(w) * c for w, c in zip(weights, components, strict=True)]))
