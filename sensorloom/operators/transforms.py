"""Named changes of a frame's columns, put together into as few projections as possible, with undo and validation.

A step is a name and its parameters. Steps that change a row by itself (rename, scale, invert, numeric, coalesce) are
folded into the projection that is being built; those that look at neighbours (smooth, low_pass) or make other rows
(resample) start from the projection so far. Nothing runs until the frame is used, so a pipeline of twenty scalings is
one projection for Catalyst.

Other steps can be added with ``step``: a function of (frame, columns so far, parameters) that returns new columns, or,
for ``whole=True``, of (frame, parameters) that returns a frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators import decisions, resample, scoring
from sensorloom.registry import HarmonizeError

#: What stands behind the name of a column that a merge could not place.
DUPLICATE = "_dup"


@dataclass(frozen=True)
class Step:
    kind: str
    parameters: dict


@dataclass
class Applied:
    """The changed frame, the frame before, and what was done: (number, kind, parameters)."""

    frame: DataFrame
    before: DataFrame
    history: list[tuple[int, str, dict]] = field(default_factory=list)

    def rolled_back(self) -> DataFrame:
        return self.before


Columns = dict[str, Column]
STEPS: dict[str, tuple[Callable, bool]] = {}


def step(kind: str, whole: bool = False) -> Callable:
    def add(f: Callable) -> Callable:
        STEPS[kind] = (f, whole)
        return f

    return add


def known(columns: Columns, names: list[str]) -> list[str]:
    """The names that the frame has; others are passed over."""
    return [c for c in names if c in columns]


@step("rename")
def rename(frame: DataFrame, columns: Columns, mapping: dict[str, str]) -> Columns:
    return {mapping.get(c, c): x for c, x in columns.items()}


@step("scale")
def scale(frame: DataFrame, columns: Columns, names: list[str], factor: float) -> Columns:
    return columns | {c: columns[c].try_cast("double") * factor for c in known(columns, names)}


@step("invert")
def invert(frame: DataFrame, columns: Columns, names: list[str]) -> Columns:
    return columns | {c: -columns[c].try_cast("double") for c in known(columns, names)}


@step("numeric")
def numeric(frame: DataFrame, columns: Columns, names: list[str]) -> Columns:
    return columns | {c: columns[c].try_cast("double") for c in known(columns, names)}


@step("drop_keys")
def drop_keys(frame: DataFrame, columns: Columns, prefix: str = "participant_id") -> Columns:
    return {c: x for c, x in columns.items() if not c.startswith(prefix)}


@step("coalesce_duplicates")
def coalesce_duplicates(frame: DataFrame, columns: Columns) -> Columns:
    """``c_dup`` goes into ``c`` where that is null: as numbers if either is one, as text else; without ``c`` it takes its name."""
    kinds = {f.name: f.dataType for f in frame.schema}
    out = {c: x for c, x in columns.items() if not c.endswith(DUPLICATE)}
    for c in (c for c in columns if c.endswith(DUPLICATE)):
        base = c.removesuffix(DUPLICATE)
        if base not in out:
            out[base] = columns[c]
        elif kinds.get(base) == kinds.get(c):
            out[base] = F.coalesce(out[base], columns[c])
        elif any(isinstance(kinds.get(x), T.NumericType) for x in (base, c)):
            out[base] = F.coalesce(out[base].try_cast("double"), columns[c].try_cast("double"))
        else:
            out[base] = F.coalesce(out[base].cast("string"), columns[c].cast("string"))
    return out


@step("smooth", whole=True)
def smooth(frame: DataFrame, names: list[str], keys: list[str], order: str, window: int = 5) -> DataFrame:
    """Centred rolling median of each stream's values; a stream with fewer values than the window keeps its own."""
    names, width = [c for c in names if c in frame.columns], max(3, window) | 1
    if not names:
        return frame
    marked = frame.select("*", *(resample.known_in_group(c, keys).alias(f"_n_{c}") for c in names), *(resample.rolling_median(c, keys, order, window).alias(f"_m_{c}") for c in names))
    return marked.withColumns({c: F.when(F.col(f"_n_{c}") >= width, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in names}).select(*frame.columns)


@step("low_pass", whole=True)
def low_pass(frame: DataFrame, keys: list[str], order: str, names: list[str] | None = None, window: int = 5) -> DataFrame:
    """Running mean over the last ``window`` rows of the numeric columns, by default of all but keys and order."""
    kinds = {f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)}
    names = [c for c in names or frame.columns if c in kinds and c not in (*keys, order)]
    return frame.withColumns({c: resample.rolling_mean(c, keys, order, window) for c in names}) if names else frame


@step("resample", whole=True)
def to_rate(frame: DataFrame, rate_hz: float, keys: list[str], ts: str = "ts") -> DataFrame:
    """Mean of each stream's numeric columns in buckets of whole milliseconds, gaps filled linearly."""
    step_ms = max(1, int(1000 / rate_hz))
    names = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    rows = frame.where(F.col(ts).isNotNull())
    bucket = F.timestamp_millis(F.floor(F.unix_millis(F.col(ts).cast("timestamp")) / step_ms) * step_ms)
    means = rows.groupBy(*keys, bucket.alias(ts)).agg(*(F.avg(c).alias(c) for c in names))
    ends = means.groupBy(*keys).agg(F.min(ts).alias("overlap_start"), F.max(ts).alias("overlap_end"))
    points = resample.blocked_grid(ends, keys, F.lit(step_ms * 1000), ts)
    placed = resample.on_grid(points, means, keys, ts)
    return resample.filled_linear(placed, keys, names, ts).select(*keys, ts, *names)


def apply(frame: DataFrame, steps: list[Step]) -> Applied:
    """All steps in order. An unknown kind raises."""
    out, columns, history = frame, None, []
    for n, s in enumerate(steps, 1):
        if s.kind not in STEPS:
            raise HarmonizeError("unknown_transform", f"no step is called {s.kind!r}", known=sorted(STEPS))
        run, whole = STEPS[s.kind]
        if columns is None and not whole:
            columns = {c: F.col(f"`{c}`") for c in out.columns}
        if whole:
            if columns is not None:
                out, columns = out.select(*(x.alias(c) for c, x in columns.items())), None
            out = run(out, **s.parameters)
        else:
            columns = run(out, columns, **s.parameters)
        history.append((n, s.kind, s.parameters))
    if columns is not None:
        out = out.select(*(x.alias(c) for c, x in columns.items()))
    return Applied(out, frame, history)


def suggested_steps(suggestion: dict, keys: list[str], ts: str = "ts") -> list[Step]:
    """The steps that a suggestion asks for: ``recommended_sampling_rate`` and, if it names a low pass, ``filtering``."""
    steps = []
    if (rate := suggestion.get("recommended_sampling_rate")) is not None and rate > 0:
        steps.append(Step("resample", {"rate_hz": rate, "keys": keys, "ts": ts}))
    if "low-pass" in str(suggestion.get("filtering", "")).lower():
        steps.append(Step("low_pass", {"keys": keys, "order": ts}))
    return steps


def validated(before: DataFrame, after: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, before, after, gain and status (accepted if the score does not fall) of each group in either frame."""
    score = lambda frame, name: frame.groupBy(*keys).agg(scoring.v3_score([c for c in names if c in frame.columns]).alias(name))
    both = score(before, "before").join(score(after, "after"), keys, "full")
    b, a = (F.coalesce(c, F.lit(0.0)) for c in ("before", "after"))
    return both.select(*keys, b.alias("before"), a.alias("after"), F.round(a - b, 4).alias("gain"), decisions.accepted_change(b, a).alias("status"))
