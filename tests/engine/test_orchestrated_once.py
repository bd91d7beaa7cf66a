from tidepool.plans import queries


def test_structures_are_worked_out_once(spark, monkeypatch):
    """The decisions and the samples that set their thresholds read the same gated rows."""
    calls, rfs = [], queries._rfs
    monkeypatch.setattr(queries, "_rfs", lambda *a: calls.append(1) or rfs(*a))
    got = queries.QUERIES["e12_orchestrator_market"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and got.columns[:3] == ["asset_id", "n_prior", "maturity"]
