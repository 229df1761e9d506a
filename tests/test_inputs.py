"""From folders to a fusion: the structure report, the mapping hook and the written validation."""

import json

import pytest
from sensorloom.plans import inputs
from sensorloom.plans.pipeline import fuse
from sensorloom.sources import ingest, sinks
from test_ingest import samples, write


@pytest.fixture
def folders(tmp_path):
    for d in ("d1", "d2"):
        for k in (1, 2):
            write(tmp_path / d / f"participant_{k}" / "imu.csv", samples(60, 0.1))
    write(tmp_path / "d2" / "participant_2" / "more.csv", [f"2024-01-01T00:00:0{i},{i},1" for i in range(5)], "timestamp,hr,noise")
    return tmp_path


def test_structure_report_and_fusion(spark, folders):
    got = inputs.fusion_inputs(spark, [("d1", str(folders / "d1")), ("d2", str(folders / "d2"))])
    assert got.structure == {
        "participants_detected": 2, "files_detected": 5, "grouping_strategy": "folder_based", "schema_inference_confidence": 1.0,
        "detected_modalities": ["accelerometer", "heart_rate"], "timestamp_ambiguous": False, "warnings": [],
    }
    assert got.schema["method"] == "rules" and [f.count() for f in got.research] == [120, 120] and got.task.task == "Health Monitoring"
    out = fuse(got.frames)
    assert {r.participant_id: len(r.datasets) for r in out.report.collect()} == {"participant_1": 2, "participant_2": 2}
    sinks.write_validation(out.report, out.fused, str(folders / "check"))
    told = [json.loads(r.value) for r in spark.read.text(str(folders / "check" / "json")).collect()]
    assert sorted(t["num_rows"] for t in told) == [60, 60] and all(t["chosen_sampling_rate_hz"] == 10.0 and "acc_x" in t["columns"] for t in told)
    text = "\n".join(r.value for r in spark.read.text(str(folders / "check" / "markdown")).collect())
    assert "# Fusion of participant_1" in text and "* Rate: 10.0000 Hz" in text and "d2: 0.0 ms" in text
    out.close()


def ask(answer, seen=None):
    def mapper(names, profiles, rows):
        if seen is not None:
            seen.append((names, profiles, rows))
        return answer

    return mapper


def test_mapper_is_asked_and_judged(spark, tmp_path):
    """It is asked where the rules recognise too little, with profiles and first rows; unsound answers are refused."""
    rows = [f"2024-01-01T00:00:{i:02d},{i},{2 * i},{-i},x" for i in range(8)]
    root = write(tmp_path / "a.csv", rows, "timestamp,accelerationX,accelerationY,lightness,name")
    seen: list = []
    good = ingest.Mapping({"accelerationX": "acc_x", "accelerationY": "acc_y", "lightness": "light_lux", "name": "unknown"}, 0.9, "by their names")
    slot = ingest.read_slot(spark, str(root), "d", mapper=ask(good, seen))
    assert (slot.method, slot.confidence, slot.reasons, slot.modalities) == ("mapper", 0.9, ["by their names"], ["accelerometer", "light"])
    assert slot.frame.where("acc_y = 14 and light_lux = -7").count() == 1
    names, profiles, first = seen[0]
    assert {p["column_name"]: (p["mean"], p["min"], p["max"]) for p in profiles}["accelerationY"] == (7.0, 0.0, 14.0) and len(first) == 5 and first[0]["name"] == "x"
    assert {p["column_name"] for p in profiles} == {"accelerationX", "accelerationY", "lightness"}
    bad = {
        "a channel is named twice": ingest.Mapping({"accelerationX": "acc_x", "accelerationY": "acc_x"}, 0.9),
        "latitude and longitude go together": ingest.Mapping({"accelerationX": "gps_lat"}, 0.9),
        "not surer than the rules": ingest.Mapping({"accelerationX": "acc_x"}, 0.5),
    }
    for why, answer in bad.items():
        with_it = ingest.read_slot(spark, str(root), "d", mapper=ask(answer))
        assert (with_it.method, with_it.reasons, with_it.modalities) == ("rules", [f"mapping refused: {why}"], [])
    plain = write(tmp_path / "b" / "b.csv", samples(5, 1))
    assert ingest.read_slot(spark, str(plain), "d", mapper=ask(good, seen)).method == "rules" and len(seen) == 1  # the rules are sure
