import pytest
from sensorloom.operators import decisions


def test_only_filling_is_accepted(spark):
    rows = [(1, i, None if i % 3 == 0 else float(i), float(i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "p long, i long, heart_rate double, pressure double")
    out = decisions.smooth_until_no_gain(frame, ["p"], "i", ["heart_rate", "pressure"])
    assert [a[:2] for a in out.accepted] == [("smooth", "heart_rate")] and out.stop == "no_improvement"
    assert out.accepted[0][3] - out.accepted[0][2] == pytest.approx(0.15 * 0.1 / 3)
    assert out.frame.where("heart_rate is null").count() == 0


def test_rate_model(spark):
    rows = [(float(i % 7), float(i % 3), 10.0 + 5 * (i % 3)) for i in range(60)]
    records = spark.createDataFrame(rows, "a double, b double, rate double")
    assert decisions.train_rate_model(records.limit(5), ["a", "b"], "rate") is None
    model = decisions.train_rate_model(records, ["a", "b"], "rate")
    got = [r.prediction for r in model.transform(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).collect()]
    assert got == [pytest.approx(20, abs=1)]
