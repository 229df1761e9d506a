"""Buckets, grids, interpolation, smoothing and fusion. Windows are always partitioned by stream.

What comes next is the last of the rows before in descending order: a frame that ends at the last row is summed up anew
for every row, so that its time would grow with the square of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.columns import seconds


def bucket_mean(df: DataFrame, keys: list[str], value: str, width: str, ts: str = "ts") -> DataFrame:
    """Mean per time bucket; combines on the map side."""
    return df.groupBy(*keys, F.window(ts, width).start.alias("ts")).agg(F.avg(value).alias(value))


def grid(overlaps: DataFrame, keys: list[str], step: str) -> DataFrame:
    """One row per group and step from overlap_start to overlap_end; groups without overlap have none."""
    points = F.explode(F.sequence("overlap_start", "overlap_end", F.expr(f"interval {step}")))
    return overlaps.where("overlap_start is not null").select(*keys, points.alias("ts"))


#: Points of a grid that one task makes and fills at once.
BLOCK = 100_000


def blocked_grid(spans: DataFrame, keys: list[str], step_us: Column, ts: str = "ts", block: int = BLOCK) -> DataFrame:
    """keys, ``ts`` and ``_block``: a row each ``step_us`` microseconds from overlap_start to overlap_end.

    Blocks are made first and dealt out, points then: no array is longer than a block, and a long grid has many tasks.
    """
    first = F.unix_micros(F.col("overlap_start").cast("timestamp"))
    n = F.floor((F.unix_micros(F.col("overlap_end").cast("timestamp")) - first) / step_us).cast("long") + 1
    rows = spans.where("overlap_start <= overlap_end").select(*keys, first.alias("_first"), n.alias("_n"), step_us.cast("long").alias("_step"))
    last = F.floor((F.col("_n") - 1) / block).cast("long")
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block")).repartition(*keys, "_block")
    begin = F.col("_block") * block
    points = blocks.select(*keys, "_first", "_step", "_block", F.explode(F.sequence(begin, F.least(F.col("_n"), begin + block) - 1)).alias("_i"))
    return points.select(*keys, F.timestamp_micros(F.col("_first") + F.col("_i") * F.col("_step")).alias(ts), "_block")


def on_grid(points: DataFrame, samples: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Samples at the grid's exact times; others are left out, times without sample are null."""
    return points.join(samples, [*keys, ts], "left")


def filled(rows: DataFrame, keys: list[str], how: dict[str, str], ts: str = "ts", block: str = "_block") -> DataFrame:
    """Channels filled over time, ``linear`` or ``ffill``, as ``interpolated`` and ``forward_filled`` do, block by block.

    The last known value before a block and the first one after it come from one row a block, so that no window holds
    more than a block of a stream.
    """
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(seconds(F.col(ts)).alias("t"), F.col(c).alias("v")))
    ends = rows.groupBy(*keys, block).agg(*(F.min(known(c)).alias(f"_f_{c}") for c in how), *(F.max(known(c)).alias(f"_l_{c}") for c in how))
    earlier, later = (Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.asc(block), F.desc(block)))
    carried = ends.select(*keys, block, *(F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_b_{c}") for c in how), *(F.last(f"_f_{c}", ignorenulls=True).over(later).alias(f"_a_{c}") for c in how))
    back, ahead = (Window.partitionBy(*keys, block).orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.asc(ts), F.desc(ts)))

    def value(c: str) -> Column:
        before = F.coalesce(F.last(known(c), ignorenulls=True).over(back), F.col(f"_b_{c}"))
        if how[c] == "ffill":
            return before["v"]
        after = F.coalesce(F.last(known(c), ignorenulls=True).over(ahead), F.col(f"_a_{c}"))
        slope = F.try_divide(after["v"] - before["v"], after["t"] - before["t"])
        return F.coalesce(F.col(c), before["v"] + slope * (seconds(F.col(ts)) - before["t"]), before["v"])

    return rows.join(carried, [*keys, block]).withColumns({c: value(c) for c in how}).select(*(c for c in rows.columns if c != block))


def filled_linear(rows: DataFrame, keys: list[str], names: list[str], ts: str = "ts") -> DataFrame:
    return filled(rows, keys, dict.fromkeys(names, "linear"), ts)


def interpolated(value: str, keys: list[str], ts: str = "ts") -> Column:
    """Linear in time between known neighbours; nothing before the first, the last value after the last."""
    back, ahead = (Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.asc(ts), F.desc(ts)))
    known = F.when(F.col(value).isNotNull(), F.struct(seconds(F.col(ts)).alias("t"), F.col(value).alias("v")))
    before, after = (F.last(known, ignorenulls=True).over(w) for w in (back, ahead))
    slope = F.try_divide(after["v"] - before["v"], after["t"] - before["t"])
    return F.coalesce(F.col(value), before["v"] + slope * (seconds(F.col(ts)) - before["t"]), before["v"])


def forward_filled(value: str, keys: list[str], ts: str = "ts") -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))


def rolling_median(value: str, keys: list[str], order: str, width: int) -> Column:
    """Centred; an even width grows by one, at least three."""
    half = (max(3, width) | 1) // 2
    return F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def known_in_group(value: str, keys: list[str]) -> Column:
    return F.count(value).over(Window.partitionBy(*keys))


def rolling_mean(value: str, keys: list[str], order: str, width: int = 5) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0))


def fused(df: DataFrame, keys: list[str], values: list[str], dataset: str = "dataset_id") -> DataFrame:
    """Mean over datasets at each time, nulls left out; one aggregation on the long layout, no join."""
    return df.groupBy(*keys, "ts").agg(*(F.avg(v).alias(v) for v in values), F.count(dataset).alias("n_datasets"))


def first_known(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Rows with equal keys as one: for each value the first that is not null, in the given order."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), place)).alias(v) for v in values))


def stride(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Every k-th row of each group so that at most about ``most`` remain."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where((F.col("rn") - 1) % F.greatest(F.lit(1), F.ceil(F.col("n") / most)) == 0).drop("rn", "n")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance_seconds: float, ts: str = "ts") -> DataFrame:
    """The nearest right row within the tolerance (inclusive; of two equally near, the earlier).

    A union and two running windows: one shuffle on the keys, linear in the rows.
    """
    l = left.select(*keys, ts, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value), *(c for c in left.columns if c not in (*keys, ts)))
    r = right.select(*keys, ts, F.lit(0).alias("side"), value)
    both = l.unionByName(r, allowMissingColumns=True)
    back, ahead = (Window.partitionBy(*keys).orderBy(*x).rowsBetween(Window.unboundedPreceding, 0) for x in ((F.asc(ts), F.asc("side")), (F.desc(ts), F.desc("side"))))
    there = F.when(F.col("side") == 0, F.struct(seconds(F.col(ts)).alias("t"), F.col(value).alias("v"), F.col(ts).alias("at")))
    both = both.withColumns({"b": F.last(there, ignorenulls=True).over(back), "a": F.last(there, ignorenulls=True).over(ahead)})
    t = seconds(F.col(ts))
    near = F.when(F.col("a").isNull() | (t - F.col("b.t") <= F.col("a.t") - t), F.col("b")).otherwise(F.col("a"))
    out = both.where("side = 1").withColumn("near", near).withColumn("gap", F.abs(t - F.col("near.t")))
    fits = F.col("gap") <= tolerance_seconds
    return out.select(*left.columns, F.when(fits, F.col("near.v")).alias(value), F.when(fits, F.col("near.at")).alias("matched_ts"))
