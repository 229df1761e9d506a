import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import differences, duck
from pyspark.sql import functions as F
from sensorloom.operators import agent, resample
from sensorloom.plans import queries as plans
from sensorloom.plans import fusion_queries, pipeline, stream_queries  # noqa: F401


def test_continuity_takes_times_whole(spark, tmp_path):
    # Gaps of 50 ms and, for the second user, of some hours with odd microseconds.
    rows = [(i, 1, "click", i * 50_000, 1.0) for i in range(30)] + [(100 + i, 2, "view", i * 40_123_456_789 + i * i * 7_654_321_987, 1.0) for i in range(40)]
    ids, users, kinds, times, values = zip(*rows, strict=True)
    table = pa.table({"event_id": ids, "user_id": users, "event_type": kinds, "ts": pa.array(times, pa.timestamp("us")), "value": values})
    pq.write_table(table, f"{tmp_path}/events.parquet")
    query = plans.QUERIES["stream_continuity"](spark, str(tmp_path))
    assert differences(query, duck(str(tmp_path)), plans.ORACLES["stream_continuity"]) == ""
    assert [r.continuous for r in query.orderBy("participant_id").collect()] == [True, False]


@pytest.fixture(scope="module")
def embeddings(tmp_path_factory):
    """One label longer than the drift's limit of points, one of a window's length, one of less, one without variance."""
    sizes, rng = {0: 2600, 1: 20, 2: 13, 3: 11, 4: 45}, np.random.default_rng(3)
    labels = np.repeat(list(sizes), list(sizes.values()))
    values = np.where(labels[:, None] == 4, 1.0, rng.normal(size=(len(labels), 12))).astype(np.float32)
    folder = tmp_path_factory.mktemp("embeddings")
    pq.write_table(pa.table({"vec_id": np.arange(len(labels)), "label": labels.astype(np.int32), "embedding": pa.array(list(values), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["window_lags_by_label", "drift_slope_by_label"])
def test_windows_take_whole_signals(spark, embeddings, name):
    assert differences(plans.QUERIES[name](spark, embeddings), duck(embeddings), plans.ORACLES[name]) == ""


def test_no_window_is_summed_up_anew_for_every_row(spark):
    rows = spark.range(40).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 7 == 3, F.col("id") * 2.0).alias("v"), F.floor(F.col("id") / 16).alias("_block"))
    filled = resample.filled(rows, ["k"], {"v": "linear"})
    line = rows.select("ts", resample.interpolated("v", ["k"]).alias("v"))
    near = resample.asof_nearest(rows.select("k", "ts"), rows.where("v is not null").select("k", "ts", "v"), ["k"], "v", 3.0)
    for frame in (filled, line, near):
        assert "unboundedfollowing" not in frame._jdf.queryExecution().optimizedPlan().toString()
    want = [None if i < 3 else 2.0 * min(i, 38) for i in range(40)]  # nothing before the first
    assert [r.v for r in filled.orderBy("ts").collect()] == pytest.approx(want) and [r.v for r in line.orderBy("ts").collect()] == pytest.approx(want)
    known = range(3, 40, 7)
    assert [r.v for r in near.orderBy("ts").collect()] == [2.0 * min(known, key=lambda t: (abs(t - i), t)) for i in range(40)]


@pytest.mark.parametrize("name", ["fusion_parts_by_label", "fuse_by_label"])
def test_fusion_has_no_frame_that_grows_towards_the_last_row(spark, monkeypatch, name):
    """In none of the tables that the fusion stores, nor in its report; frames of whole groups are summed up once."""
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().lower()
    seen = []
    for module in (agent, pipeline):
        monkeypatch.setattr(module, "cut", lambda df, *a, made=module.cut: (seen.append(plan(df)), made(df, *a))[1])
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        seen.append(plan(plans.QUERIES[name](spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    frames = [f for text in seen for f in re.findall(r"specifiedwindowframe\((\w+), ([^,]*), ([^,]*?\(\)|[^,)]*)\)", text)]
    assert len(seen) > 6 and frames and not any("unboundedfollowing" in last and "unboundedpreceding" not in first for _, first, last in frames)


@pytest.mark.parametrize("name", ["fusion_parts_by_label", "fuse_by_label"])
def test_fusion_stores_what_several_steps_read(spark, monkeypatch, name):
    """What is left of a plan is planned anew after each of its stages, so that the driver's memory grows with the square of its size."""
    sizes = []
    size = lambda frame: len(re.findall(r"(?m)^[ :+-]*(Join|Aggregate|Window|Sort|Generate)\b", frame._jdf.queryExecution().optimizedPlan().toString()))
    for module in (agent, pipeline):
        monkeypatch.setattr(module, "cut", lambda df, *a, made=module.cut: (sizes.append(size(df)), made(df, *a))[1])
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 10
    assert len(sizes) > 6 and 10 < max(sizes) <= 40, sizes
