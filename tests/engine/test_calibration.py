"""Calibration reports, listings and stores against rows worked out by hand."""

import hashlib
import hmac

from pyspark.sql import functions as F

from tidepool.operators import calibration, listing


def test_impulse_policy_and_labels(spark):
    rows = [(i, "RELEASE" if i % 2 else "NEUTRAL", 60.0 + i % 10, 50.0, 55.0, 40.0) for i in range(50)]
    df = spark.createDataFrame(rows, "asset_id long, state string, pressure double, instability double, saturation double, exhaustion double")
    policy = calibration.impulse_policy(df).first()
    assert (policy["n"], policy["source"], policy["n_release"], policy["n_exhaustion"]) == (50, "adaptive", 25, 0)
    # pressures of RELEASE are 61, 63 ... 69, five of each: P58 of 25 lies at 13.92, in the run of 65; no decay: exhaustion's P70 is 40, held to 52
    assert (policy["release_pressure_min"], policy["release_instability_min"], policy["release_decay_max"], policy["exhaustion_exhaustion_min"]) == (65.0, 50.0, 52.0, 48.0)
    assert policy["warnings"] == "impulse_adaptive_thresholds_insufficient_compression_sample,impulse_adaptive_thresholds_insufficient_pressure_building_sample,impulse_adaptive_thresholds_insufficient_exhaustion_sample"
    label = lambda d: {r["asset_id"]: r["adaptive_state"] for r in calibration.relabelled(d, calibration.impulse_policy(df)).collect()}
    assert set(label(df).values()) == {"NEUTRAL"}  # growth and core of 50 are under what pressure stands in for
    full = label(df.withColumns({"growth": F.lit(70.0), "core": F.lit(70.0), "decay": F.lit(45.0)}))
    assert full[5] == "RELEASE" and full[0] == "COMPRESSION"  # pressures 65 and 60; a compression needs P45 of all, held to 58
    governed = calibration.impulse_governance(calibration.impulse_policy(df)).first()
    assert (governed["dominant_state"], governed["release_ratio"], governed["dominance"], governed["validity"]) == ("RELEASE", 0.5, "release_overactive", "degraded")
    few = calibration.impulse_policy(df.limit(39)).first()
    assert (few["source"], few["release_pressure_min"]) == ("fallback", 52.0)
    none = calibration.impulse_governance(calibration.impulse_policy(df.limit(0))).first()
    assert (none["dominance"], none["validity"]) == ("unknown", "invalid")


def test_zone_decisions(spark):
    df = spark.createDataFrame([(1, "VOLATILE", 85.0), (2, "VOLATILE", 79.0), (3, "STABLE", 80.0), (4, "TRANSITION", 59.0), (5, "STABLE", None)], "asset_id long, regime string, zone_score double")
    got = {r["asset_id"]: (r["action"], r["reason_codes"], r["execution_mode"]) for r in calibration.zone_decision(df).collect()}
    assert got == {1: ("WATCH", "REGIME_VOLATILE,ZONE_HIGH", "reduced"), 2: ("BLOCK", "REGIME_VOLATILE,ZONE_NOT_STRONG", "none"), 3: ("ALLOW", "REGIME_STABLE,ZONE_HIGH", "progressive"), 4: ("WATCH", "REGIME_TRANSITION,ZONE_LOW", "reduced"), 5: ("WATCH", "NO_ZONE", "none")}


def test_chains_equal_the_library(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (2, 1, "z")]
    got = {r["key"]: r for r in calibration.integrity_chain(spark.createDataFrame(rows, "key long, at long, p string"), "key", F.col("at"), F.col("p"), "secret" * 20).collect()}
    first = hashlib.sha256(b"a").hexdigest()
    last = hashlib.sha256(("b" + first).encode()).hexdigest()
    assert (got[1]["hash"], got[1]["n"]) == (last, 2) and got[2]["hash"] == hashlib.sha256(b"z").hexdigest()
    assert got[1]["signature"] == hmac.new(b"secret" * 20, last.encode(), "sha256").hexdigest()


def test_identity_falls_back(spark):
    df = spark.createDataFrame([(" Bit ", "btc", "Bit Coin"), (None, "eth", None), ("", " ", "Some Coin!"), (None, None, " ")], "id string, symbol string, name string")
    got = [tuple(r) for r in listing.mapped_identity(df, "p").orderBy("canonical_id").collect()]
    assert got == [("bit", "BTC", "Bit Coin", "bit", "provider_id", "p|bit|BTC|bit coin", "p|bit|BTC|usd"), (None, "ETH", "ETH", "eth", "symbol_fallback", "p||ETH|", "p||ETH|usd"), (None, None, "Some Coin!", "some-coin", "name_fallback", "p|||some coin!", None)]


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "decision string, regime string, stability double, opportunity double, rupture double, continuity double, market_confidence double, market_convergence double, chg_24h_pct double, chg_7d_pct double, seq long")
    assert calibration.threshold_report(empty).first()["stability_p50"] == 0.0
    assert calibration.opportunity_report(empty).first()["warnings"] == "LOW_SAMPLE_SIZE,LOW_SCORE_SPREAD"
    assert calibration.decision_report(empty).first()["allow_min"] == 0
    assert calibration.assets_summary(empty).first()["decision"] == "BLOCK" and calibration.store_stats(empty).first()["n"] == 0


def test_current_state_and_order(spark):
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 3, False)], "id long, version long, deleted boolean")
    assert [(r["id"], r["version"]) for r in listing.latest_per_id(log).collect()] == [(2, 3)]
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], "asset_id long, stability double")
    assert [r["asset_id"] for r in df.orderBy(*listing.by_score("stability", "asc")).collect()] == [2, 3, 1]
