"""The correcting loop and the named transforms against plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from sensorloom import registry
from sensorloom.operators import agent, resample, transforms
from sensorloom.operators.transforms import Step
from sensorloom.registry import HarmonizeError

CHANNELS = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "heart_rate", "pressure"]
SCHEMA = "participant_id string, dataset_id string, ts timestamp, " + ", ".join(f"{c} double" for c in CHANNELS)


def stream(p, d, n, seed, **f):
    """A stream of n rows; f gives a channel's value by row, other channels are null."""
    rng = random.Random(seed)
    return [(p, d, None if i < 0 else 1_700_000_000 + i, *(f[c](i, rng) if c in f else None for c in CHANNELS)) for i in range(n)]


def frame_of(spark, rows):
    plain = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long"))
    return plain.withColumn("ts", F.timestamp_seconds("ts"))


def gaps(share):
    return lambda i, rng: None if rng.random() < share else rng.gauss(0, 1)


def plain_score(columns):
    """The single-dataset score of lists of values by channel."""
    missing = covered = 0.0
    for names, w, _ in registry.MODALITIES.values():
        used = [c for c in names if any(v is not None for v in columns.get(c, []))]
        missing += w * (statistics.fmean(sum(v is None for v in columns[c]) / len(columns[c]) for c in used) if used else 1.0)
        covered += w * bool(used)
    return round(0.4225 + 0.15 * (1 - missing) + 0.10 * covered, 4)


def smoothed(values, width=5):
    out = []
    for i in range(len(values)):
        near = [v for v in values[max(0, i - width // 2) : i + width // 2 + 1] if v is not None]
        out.append(statistics.median(near) if near else None)
    return out


def noise(values):
    known = [v for v in values if v is not None]
    if len(known) < 50 or statistics.pstdev(known) <= 1e-9:
        return 0.0
    return statistics.pstdev([b - a for a, b in zip(known, known[1:])]) / (statistics.pstdev(known) + 1e-9)


def test_filling_is_taken_scaling_and_inverting_are_not(spark):
    """One participant gains most from smoothing one dataset; what lost to it is not tried again. The other one gains nothing."""
    g = lambda i, rng: -0.57 + 0.05 * (-1) ** i  # noqa: E731  # as loud as can be, without gaps
    rows = stream("p", "d1", 200, 1, acc_x=gaps(0.4), acc_y=gaps(0.4), acc_z=gaps(0.4)) + stream("p", "d2", 200, 2, heart_rate=gaps(0.5), pressure=gaps(0.3))
    rows += stream("q", "d1", 120, 3, acc_x=g, acc_y=g, acc_z=g) + stream("q", "d2", 120, 4, gyro_x=lambda i, rng: math.sin(i / 9))
    frame = frame_of(spark, rows)
    out = agent.correct(frame)
    before = {d: {c: [r[3 + k] for r in rows if r[0] == "p" and r[1] == d] for k, c in enumerate(CHANNELS)} for d in ("d1", "d2")}
    loud = {d: {c for c in CHANNELS if noise(x[c]) >= 1.35} for d, x in before.items()}
    done = {d: {c: smoothed(v) if c in loud[d] else v for c, v in x.items()} for d, x in before.items()}
    best = max(before, key=lambda d: plain_score(done[d]) - plain_score(before[d]))
    after = before | {best: done[best]}
    assert all(loud.values())
    summary = {r.participant_id: r for r in out.summary.collect()}
    assert (summary["p"].iterations, summary["p"].used, summary["p"].stop_reason) == (1, True, "no_new_actions")
    assert summary["p"].initial_score == pytest.approx(statistics.fmean(map(plain_score, before.values())), abs=1e-4)
    assert summary["p"].final_score == pytest.approx(statistics.fmean(map(plain_score, after.values())), abs=1e-4)
    assert (summary["q"].iterations, summary["q"].stop_reason, summary["q"].confidence) == (0, "no_viable_candidates", 0.3)
    actions = out.actions.collect()
    assert {(a.participant_id, a.action_type) for a in actions} == {("p", "smooth"), ("q", "scale"), ("q", "invert"), ("q", "smooth")}
    taken = sorted((a.iteration, a.dataset_id, tuple(a.columns)) for a in actions if a.accepted)
    assert [t[:2] for t in taken] == [(1, best)] and set(taken[0][2]) == loud[best]
    assert {a.dataset_id for a in actions if a.participant_id == "p" and not a.accepted and a.iteration == 1} == {"d1", "d2"} - {best}
    assert all((a.observer_confidence is not None) == a.accepted and (a.improvement >= 0.002) >= a.accepted for a in actions)
    got = {(r.participant_id, r.dataset_id, int(r.at)): r for r in out.frame.withColumn("at", F.unix_seconds("ts")).collect()}
    assert len(got) == len(rows)
    for p, d, ts, *values in rows:
        want = {c: after[d][c][ts - 1_700_000_000] if p == "p" else v for c, v in zip(CHANNELS, values)}
        assert all(got[p, d, ts][c] == (pytest.approx(v) if v is not None else None) for c, v in want.items())


def test_small_gain_and_nothing_to_do(spark):
    few = lambda i, rng: None if i == 7 else rng.gauss(0, 1)
    flat = lambda i, rng: 1.0
    rows = stream("a", "d1", 100, 5, pressure=few) + stream("a", "d2", 100, 6, pressure=flat) + stream("b", "d1", 30, 7, pressure=flat) + stream("b", "d2", 30, 7, pressure=gaps(0.5))
    out = agent.correct(frame_of(spark, rows))
    assert {r.participant_id: (r.stop_reason, r.iterations) for r in out.summary.collect()} == {"a": ("no_action_above_improvement_threshold", 0), "b": ("no_new_actions", 0)}
    assert [(a.participant_id, a.accepted) for a in out.actions.collect()] == [("a", False)]


def test_score_looks_at_a_stride_of_long_streams(spark):
    rows = stream("a", "d1", 100, 8, pressure=lambda i, rng: None if i % 2 else rng.gauss(0, 1)) + stream("a", "d2", 60, 9, pressure=gaps(0.0))
    stats = {r.dataset_id: r for r in agent.statistics(frame_of(spark, rows), agent.Policy(score_rows=50)).collect()}
    assert stats["d1"].miss_pressure == 0.0 and stats["d1"].n_pressure == 50 and stats["d2"].miss_pressure == 0.0


def test_row_by_row_steps_are_one_projection(spark):
    frame = spark.createDataFrame([(1, 2.0, "3", None, 4.0)], "k int, a double, b string, c_dup double, c double")
    steps = [Step("scale", {"names": ["a", "b", "x"], "factor": 10.0}), Step("invert", {"names": ["a"]}), Step("coalesce_duplicates", {}), Step("rename", {"mapping": {"b": "d"}})]
    done = transforms.apply(frame, steps)
    assert done.frame.head().asDict() == {"k": 1, "a": -20.0, "d": 30.0, "c": 4.0}
    assert [h[:2] for h in done.history] == [(1, "scale"), (2, "invert"), (3, "coalesce_duplicates"), (4, "rename")] and done.rolled_back() is frame
    assert done.frame._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 1
    with pytest.raises(HarmonizeError, match="unknown_transform"):
        transforms.apply(frame, [Step("fly", {})])


def test_duplicates(spark):
    """Numbers first, text else; a duplicate without its column takes the name; participant columns go."""
    rows = [("p", "1.5", None, None, "t", None), ("p", None, 2.5, "s", None, 7.0), ("p", "x", 3.5, None, None, None)]
    frame = spark.createDataFrame(rows, "participant_id_dup string, a string, a_dup double, b string, b_dup string, n_dup double")
    done = transforms.apply(frame, [Step("drop_keys", {}), Step("coalesce_duplicates", {})]).frame
    assert sorted(done.columns) == ["a", "b", "n"]
    assert [(r.a, r.b, r.n) for r in done.collect()] == [(1.5, "t", None), (2.5, "s", 7.0), (3.5, None, None)]


def test_steps_over_neighbours(spark):
    rng = random.Random(3)
    rows = [(k, i, None if rng.random() < 0.3 else float(rng.randrange(9)), float(i)) for k in (1, 2) for i in range(20)] + [(3, i, 1.0 if i < 3 else None, 0.0) for i in range(9)]
    frame = spark.createDataFrame(rows, "k int, i int, v double, w double")
    done = transforms.apply(frame, [Step("smooth", {"names": ["v", "none"], "keys": ["k"], "order": "i", "window": 4}), Step("scale", {"names": ["v"], "factor": 2.0}), Step("low_pass", {"keys": ["k"], "order": "i", "names": ["w"]})]).frame
    got = {(r.k, r.i): (r.v, r.w) for r in done.collect()}
    for k in (1, 2, 3):
        v, w = ([r[c] for r in rows if r[0] == k] for c in (2, 3))
        v = smoothed(v) if k < 3 else v
        for i in range(len(v)):
            assert got[k, i] == (v[i] if v[i] is None else 2 * v[i], pytest.approx(statistics.fmean(w[max(0, i - 4) : i + 1])))


def test_suggestions_are_applied_and_validated(spark):
    frame = spark.createDataFrame([("s", i * 1000, float(i), None if i == 2 else 1.0) for i in range(5)], "k string, ms long, v double, u double").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    steps = transforms.suggested_steps({"recommended_sampling_rate": 2.0, "filtering": "Low-pass at 5 Hz"}, ["k"])
    assert [s.kind for s in steps] == ["resample", "low_pass"] and transforms.suggested_steps({}, ["k"]) == []
    fine = transforms.apply(frame, steps[:1])
    got = [(r.v, r.u) for r in fine.frame.orderBy("ts").collect()]
    assert got == [(i / 2, 1.0) for i in range(9)]
    row = transforms.validated(fine.before, fine.frame, ["k"], ["v", "u"]).head()
    assert row.status == "accepted" and row.gain == pytest.approx(row.after - row.before, abs=1e-9) and row.gain > 0
    worse = transforms.apply(frame, [Step("scale", {"names": ["v"], "factor": 0.0})])
    assert transforms.validated(frame, worse.frame, ["k"], ["v", "u"]).head().status == "rejected"


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_grids_and_filling_by_blocks(spark, block):
    """Filling with values carried over blocks equals filling by one window; blocks without any value between others."""
    rng = random.Random(block)
    spans = spark.sql("select 'a' k, timestamp'2024-01-01' overlap_start, timestamp'2024-01-01 00:00:30' overlap_end union all select 'b', timestamp'2024-01-01', timestamp'2024-01-01' union all select 'c', timestamp'2024-01-02', timestamp'2024-01-01'")
    points = resample.blocked_grid(spans, ["k"], F.lit(1_500_000), block=block)
    assert sorted((r.k, r.n) for r in points.groupBy("k").agg(F.countDistinct("ts").alias("n")).collect()) == [("a", 21), ("b", 1)]
    rows = [("a", i, float(rng.randrange(100)) if i in (4, 5, 15) else None, float(i) if i > 12 and i % 3 == 0 else None) for i in range(21)]
    samples = spark.createDataFrame(rows, "k string, i long, v double, w double").withColumn("ts", F.timestamp_millis(1704067200000 + F.col("i") * 1500)).drop("i")
    placed = resample.on_grid(points, samples, ["k"])
    got = resample.filled(placed, ["k"], {"v": "linear", "w": "ffill"}).orderBy("k", "ts").collect()
    want = placed.withColumns({"v": resample.interpolated("v", ["k"]), "w": resample.forward_filled("w", ["k"])}).drop("_block").orderBy("k", "ts").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and sum(r.v is not None for r in got) == 17


def test_long_grids_are_made_in_blocks(spark):
    """Two years at 1 Hz: the arrays of the plan hold blocks, not the whole grid."""
    spans = spark.sql("select 'a' k, timestamp'2024-01-01' overlap_start, timestamp'2025-12-31' overlap_end")
    points = resample.blocked_grid(spans, ["k"], F.lit(1_000_000))
    row = points.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).head()
    assert tuple(row) == (100_000, 730 * 86400 + 1, 631)
