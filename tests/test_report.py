"""The nested report against the flat one."""

import json

from sensorloom.plans import report
from sensorloom.plans.pipeline import fuse
from test_fusion import SCHEMA, rows


def test_nested_report(spark):
    rough = lambda i: (float((-1) ** i) if i % 3 else None, 9.8, 0.1, 0.1, 0.2, 0.3)  # noqa: E731  # noisy and with gaps: smoothing fills them
    slots = [spark.createDataFrame(rows("p", d, 240, 0.1, 0.0, rough) + rows("q", d, 60, 0.1), SCHEMA) for d in ("d1", "d2")]
    out = fuse(slots)
    got = {r.participant_id: json.loads(r.j) for r in report.nested(out).selectExpr("participant_id", "to_json(struct(fusion_report, visual_data)) j").collect()}
    flat = {r.participant_id: r for r in out.report.collect()}
    for p, r in flat.items():
        told = got[p]["fusion_report"]
        assert told["hqscore"] == told["hqscore_v4"]["overall"] == r.hqscore and told["alignment_decisions"]["master_sampling_rate_hz"] == 10.0
        assert [d["dataset_id"] for d in told["dataset_metadata"]["datasets"]] == ["d1", "d2"] and told["dataset_metadata"]["datasets"][0]["start_timestamp"] == "2024-01-01T00:00:00.000000"
        assert told["drift_analysis"]["drift_type"] == r.drift_type and len(told["drift_analysis"]["offset_trend"]) == out.trend.where(f"participant_id = '{p}'").count() > 0
        assert told["confidence"] == {"level": r.confidence, "reason": r.reason}
        shown = got[p]["visual_data"]["acc_magnitude_overlay"]
        assert len(shown) == (240 if p == "p" else 60) and set(shown[0]["values"]) == {"d1", "d2"}
    layer = got["p"]["fusion_report"]["agentic_layer"]
    assert layer["used"] and [a["action_type"] for a in layer["accepted_actions"]] == ["smooth"] and {a["action_type"] for a in layer["rejected_actions"]} == {"smooth"}
    assert got["p"]["fusion_report"]["warnings"] == ["Corrections applied 1 action(s)."] and not got["q"]["fusion_report"]["agentic_layer"]["used"]
    assert sorted(tuple(r) for r in report.summaries(out.report).collect()) == sorted((p, r.hqscore, 10.0, 2) for p, r in flat.items())
    assert "visual_data" not in report.nested(fuse(slots, policy=None), with_overlays=False).columns
    out.close()
