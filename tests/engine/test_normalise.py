import json

from tidepool.operators import normalise


def test_names_types_and_rejects(spark):
    rows = [
        (1, json.dumps({"observed_decision": None, "final_decision": "BLOCK", "regime": "STABLE", "decision_score": 71.456, "confidence": 40, "dominance_state": "RUPTURE", "decision_reason": "  why ", "reliability": "high"})),
        (2, json.dumps({"observed_decision": "MAYBE", "final_decision": "BLOCK", "observed_horizon": 7, "decision_score": "71", "mci_allow_raw_score": 140, "allow_raw_score": 3, "observed_reason": " ", "analytical_version": "v8"})),
        (3, "[1, 2]"), (4, "not json"), (5, None), (6, "{}"),
    ]
    got = {r.id: r for r in normalise.normalised(spark.createDataFrame(rows, "id long, payload string"), "payload").collect()}
    a, b = got[1], got[2]
    assert (a.observed_decision, a.observed_regime, a.mci_decision_score, a.confidence_score, a.dominance_state, a.observed_reason, a.observed_reliability, a.rejects) == ("BLOCK", "STABLE", 71.46, 40.0, "rupture_dominant", "why", "high", [])
    assert (b.observed_decision, b.observed_horizon, b.mci_decision_score, b.mci_allow_raw_score, b.observed_reason, b.observed_analytical_version) == ("WATCH", "7D", 0.0, 100.0, "unknown", "v8")
    assert b.rejects == ["observed_decision:value", "observed_horizon:type", "observed_reason:value", "mci_decision_score:type", "mci_allow_raw_score:value"]
    assert all(got[i].rejects == ["payload"] and got[i].observed_decision == "WATCH" for i in (3, 4, 5)) and got[6].rejects == []
