"""Decision, history and matching engines against rows worked out by hand, and edge cases."""

import random

import pytest

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.operators import decisions, history, matching, series

RFS = dict(asset_id=1, sample_size=120, pattern_count=12, direction_changes=3, rupture_events=1, stable_run_length=8, dominant_direction_ratio=72.0, liquidity=64.0, alignment="ALIGNED", occurrence=62.0, convergence=58.0, duration=61.0, frequency=57.0, correlation=52.0, structure=76.0, rupture=24.0, stability=80.0, mid_term=63.0, continuity=73.0, confidence=69.0, regime="STABLE", status="VALID", mid_term_state="FAVORABLE")
SCHEMA = "asset_id long, sample_size long, pattern_count long, direction_changes long, rupture_events long, stable_run_length long, dominant_direction_ratio double, liquidity double, alignment string, occurrence double, convergence double, duration double, frequency double, correlation double, structure double, rupture double, stability double, mid_term double, continuity double, confidence double, regime string, status string, mid_term_state string"


@pytest.fixture(scope="module")
def rfs(spark):
    return spark.createDataFrame([tuple(RFS.values())], SCHEMA)


def near(row, **want):
    for name, value in want.items():
        assert row[name] == (pytest.approx(value, abs=0.011) if isinstance(value, float) else value), (name, row[name])


def test_gate_by_hand(rfs):
    # convergence (58 + 52) / 2; opportunity 40 + 16.5 + 15.2; reliability 22.4 + 13.2 + 9.12 + 8.54 + 6.24 + 85.42 * .06, less 24 * .38
    near(decisions.market_gate(rfs).first(), market_convergence=55.0, opportunity=71.7, market_confidence=55.51, support_probability=67.84, recovery_probability=68.9, temporal_coherence=56.1, temporal_support=65.95, core_decision="WATCH", neutralized=False, neutralization_severity="none", rupture_state="improving", governance="unavailable")


def test_funnel_by_hand(rfs):
    gated = decisions.market_gate(rfs)
    near(decisions.funnel(gated).first(), decision_score=56.17, recovery_rupture_dominance=44.9, decision="WATCH", reason="allow_score_below_threshold", temporal_gate=True, support_gate=True)
    near(decisions.funnel(gated, {"allow": 50, "risk": 68, "support": 64}).first(), decision="ALLOW", reason="allow_score_passed")
    near(decisions.funnel(gated, {"allow": 50, "risk": 24, "support": 64}).first(), decision="BLOCK", reason="rupture_kill_switch")
    near(decisions.funnel(gated, {"allow": 50, "risk": 68, "support": 68}).first(), decision="WATCH", reason="support_gate_failed")
    near(decisions.funnel(gated, dominance=F.lit("RUPTURE")).first(), decision="BLOCK")
    shaky = decisions.market_gate(rfs.withColumn("regime", F.lit("TRANSITION")))
    near(decisions.funnel(shaky, {"allow": 50, "risk": 30, "support": 64}).first(), reason="transition_safety_gate_failed")
    near(decisions.funnel(decisions.market_gate(rfs.withColumn("regime", F.lit("VOLATILE"))), {"allow": 50, "risk": 68, "support": 64}).first(), reason="transition_safety_gate_failed")


def test_comparator_by_hand(rfs):
    # pressure 13.2 + 5 + 3.9 + 4.3; strength 17.4 + 11.4 + 12.2 + 7.8 + 11.4
    near(decisions.comparator(rfs).first(), rupture_pressure=26.4, recovery_strength=60.2, dominance_score=83.8, dominance_state="RECOVERY_DOMINANT", confidence=40.84, warnings=[])


def test_analyses_by_hand(rfs):
    x = decisions.recovery_analysis(decisions.rupture_analysis(decisions.temporal_analysis(rfs))).first()
    # occurrence 43.4 + 28.8; frequency 39.9 + 22.8; convergence 43.5 + 18; evolution 23.4 + 21.9 + 11.4 + 6.1; growth 31.5 + 15.2 + 9.15 + 2.85 + 8.5
    near(x, t_occurrence=72.2, t_frequency=62.7, t_convergence=61.5, t_evolution=62.8, t_growth=67.2)
    near(x, t_occurrence_calibrated=70.42, t_occurrence_probability=66.9, t_growth_probability=60.61)
    # density 1 / 120, turning 3 / 120; growth 12 + 6.88 + 5.46 + 2; occurrence .4565 + 7.2 + 1.8; frequency .332 + .5 + 12.9; convergence 8.4 + 10.5 + 4 + 5.6
    near(x, r_density=0.83, r_turning=2.5, r_anti_continuity=27.0, r_growth=26.34, r_occurrence=9.46, r_frequency=13.73, r_convergence=28.5, r_evolution=32.68)
    assert x["recovery_warnings"] == [] and 0 < x["recovery_score"] < 100 and x["anti_rupture_pressure"] == pytest.approx(100 - x["risk_rupture"])


def test_live_hints_enter_all_axes_but_occurrence(spark, rfs):
    live = spark.createDataFrame([(1, 90.0, 80.0, 10.0, 100.0, 0.0, 50.0, 80.0)], "asset_id long, " + ", ".join(f"{c} double" for c in decisions.LIVE))
    x = decisions.temporal_analysis(rfs, live).first()
    # frequency 62.7 * .88 + (20 * .4 + 90 * .2 + 90 * .4) * .12; convergence 61.5 * .82; growth 67.2 * .78 + 22
    near(x, t_occurrence=72.2, t_frequency=62.62, t_convergence=50.43, t_growth=74.42)
    assert x["t_warnings"] == ["temporal_analysis_live_noise_high", "temporal_analysis_live_micro_rupture_pressure_high"]


def test_impulse_governance_neutralises(rfs):
    hot = rfs.withColumns({"impulse_state": F.lit("RELEASE"), "impulse_instability": F.lit(70.0), "impulse_saturation": F.lit(0.0), "rupture": F.lit(66.0)})
    near(decisions.market_gate(hot).first(), governance="restrictive", neutralized=True, neutralization_reason="excessive_rupture", neutralization_severity="medium")
    near(decisions.market_gate(rfs.withColumn("rupture", F.lit(92.0)).withColumn("frequency", F.lit(100.0)).withColumn("duration", F.lit(100.0)).withColumn("stability", F.lit(100.0))).first(), neutralization_reason="excessive_rupture", neutralization_severity="critical", rupture_state="explosive")


def samples(spark, n, confidence=50.0):
    rows = [(i, i, "v8", "7D", "STABLE", "ALLOW" if i % 4 == 0 else "WATCH", "r", float(i % 50), float(i % 50), 10.0, 60.0 + i % 3, 10.0, 80.0, 50.0, 60.0, confidence, 70.0, 60.0, 0.0, "balanced", False, 10.0, "stable", False, "none", "none") for i in range(n)]
    return spark.createDataFrame(rows, "seq long, asset_id long, version string, horizon string, regime string, decision string, reason string, decision_score double, allow_raw_score double, block_raw_score double, support_probability double, risk_probability double, stability double, opportunity double, market_convergence double, market_confidence double, recovery_probability double, recovery_rupture_dominance double, rupture_score double, dominance_state string, rupture_detected boolean, rupture_evolution double, rupture_state string, neutralized boolean, neutralization_reason string, neutralization_severity string")


def test_thresholds_come_from_the_samples_before(spark):
    got = {r["seq"]: r for r in decisions.prior_thresholds(samples(spark, 120), most=100).collect()}
    assert (got[29]["n_prior"], got[29]["allow_threshold"], got[29]["maturity"]) == (29, 76.0, "INSUFFICIENT_SAMPLES")
    for i in (30, 79, 80, 119):
        past = sorted(float(k % 50) for k in range(max(0, i - 100), i))
        assert got[i]["allow_threshold"] == past[int(0.75 * (len(past) - 1))] and got[i]["block_threshold"] == 10.0
    assert (got[80]["maturity"], got[119]["n_prior"]) == ("CALIBRATED_ACTIVE", 100)
    assert {r["n_prior"] for r in decisions.prior_thresholds(samples(spark, 50, 39.0)).collect()} == {0}


def test_policy_and_summary(spark):
    whole = samples(spark, 100)
    assert tuple(decisions.calibration_policy(whole).first()) == (100, 37.0, 10.0, 10.0, 61.0, "calibrated")
    assert tuple(decisions.calibration_policy(whole.limit(0)).first()) == (0, 76.0, 72.0, 70.0, 50.0, "fallback")
    s = decisions.calibration_summary(whole).first()
    near(s, n=100, allow_pct=25.0, watch_pct=75.0, convergence=60.0, correlation=62.5, allow_pressure=40.0, allow_pressure_state="NORMAL", recovery_pressure=65.0, dominant_side="recovery_dominant", occurrence=100.0, frequency=90.75, duration=99.9, maturity="CALIBRATED_ACTIVE")
    assert decisions.calibration_summary(whole.limit(0)).first()["maturity"] == "INSUFFICIENT_SAMPLES"


def test_sample_issues(spark):
    bad = samples(spark, 2).withColumns({"decision": F.when(F.col("seq") == 1, "MAYBE").otherwise(F.col("decision")), "market_confidence": F.when(F.col("seq") == 1, float("nan")).otherwise(101.0)})
    got = {r["seq"]: r["issues"] for r in decisions.sample_issues(bad).collect()}
    assert got == {0: ["INVALID_SAMPLE_CONTRACT:market_confidence"], 1: ["INVALID_SAMPLE_CONTRACT:decision", "INVALID_SAMPLE_REQUIRED_NUMERIC:market_confidence"]}


def test_adaptive_thresholds_fall_back(spark):
    few = samples(spark, 39).withColumn("rupture", F.lit(20.0))
    row = decisions.adaptive_thresholds(few).first()
    assert (row["source"], row["block_stability_max"], row["warnings"]) == ("fallback", 35.0, "adaptive_thresholds_insufficient_global_sample")
    row = decisions.adaptive_thresholds(samples(spark, 60).withColumn("rupture", F.lit(20.0))).first()
    assert (row["source"], row["block_stability_max"], row["allow_stable_rupture_max"], row["warnings"]) == ("adaptive", 42.0, 20.0, "adaptive_thresholds_insufficient_transition_sample,adaptive_thresholds_insufficient_volatile_sample")


def context(spark, rows):
    return spark.createDataFrame(rows, "asset_id long, regime string, stability double, behavior string, occurrence double, convergence double, duration double, frequency double, correlation double")


def test_contexts_by_hand(spark):
    a = context(spark, [(1, "STABLE", 70.0, "PUMA", 60.0, 60.0, 60.0, 60.0, None)])
    b = context(spark, [(2, "STABLE", 70.0, "PUMA", 60.0, 60.0, 60.0, 60.0, 60.0), (3, "TRANSITION", 60.0, "KANGAROO", 70.0, 60.0, 60.0, 60.0, 60.0), (4, "VOLATILE", 53.0, "SERPENT", 60.0, 60.0, 60.0, 60.0, 60.0), (5, "STABLE", 52.0, "PUMA", 60.0, 60.0, 60.0, 60.0, 60.0)])
    got = {r["b_asset_id"]: r for r in matching.compared(matching.band_pairs(a, b, "stability", matching.GAP)).collect()}
    assert set(got) == {2, 3, 4}  # a gap of 18 is too wide
    near(got[2], axes_score=92.5, similarity=97.75, weighted_similarity=98.05, comparable=True, reasons=[])
    near(got[3], regime_score=35.0, behavior_score=50.0, stability_score=50.0, axes_score=84.5, similarity=55.55, comparable=False, reasons=["regime_mismatch", "behavior_mismatch", "context_not_comparable"])
    near(got[4], regime_score=10.0, behavior_score=20.0)


def test_outcome_statistics_by_hand(spark):
    rows = [(9, True, 80.0, "CONTINUATION", 0.0, 50.0, 50.0, 50.0, 50.0, 50.0), (9, True, 60.0, "CORRECTION", None, None, None, None, None, None), (9, False, 90.0, "CORRECTION", 0.0, 50.0, 50.0, 50.0, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "a_asset_id long, comparable boolean, weighted_similarity double, outcome string, recency double, b_occurrence double, b_convergence double, b_duration double, b_frequency double, b_correlation double")
    # weights 52 + 17.5 and 39 + 17.5
    near(matching.outcome_statistics(df).first(), sample_size=3, valid_matches=2, continuation_weight=69.5, correction_weight=56.5, continuation_probability=55.16, correction_probability=44.84, confidence=round(70 * 0.35 + 63 * 0.25 + 66.67 * 0.15 + 24 * 0.25, 2), warnings="statistics_low_match_count")
    near(matching.outcome_statistics(df.where("not comparable")).first(), valid_matches=0, confidence=0.0, warnings="statistics_no_valid_matches")


def dated(spark, prices, start=dt.datetime(2024, 1, 1)):
    return spark.createDataFrame([(1, start + dt.timedelta(days=i), float(p)) for i, p in enumerate(prices)], "asset_id long, ts timestamp_ntz, price double")


def test_history_edges(spark):
    assert history.history(dated(spark, [100] * 7)).count() == 0  # fewer than eight prices
    flat = history.history(dated(spark, [100] * 8)).first()
    near(flat, mode="INSUFFICIENT_HISTORY", n=0, crash_status="baseline_missing", correlation=50.0, rupture_probability=50.0 * 0.8 + flat["rupture_duration"] * 0.2)
    long = history.history(dated(spark, [100 + i % 7 for i in range(800)])).first()
    near(long, mode="YEAR_PHASE_COMPARISON")
    months = history.compare_with_history(dated(spark, [100 + i % 7 for i in range(90)])).collect()
    assert {(r["year"], r["month"], r["mode"]) for r in months} == {(2024, 1, "MONTH_TO_MONTH"), (2024, 2, "MONTH_TO_MONTH")}
    assert all(0 <= r["similarity"] <= 100 and 0 <= r["rupture_gap"] <= 100 for r in months)


def test_equal_months_are_alike(spark):
    # the same 20 days in two years' January
    year = [(1, dt.datetime(y, 1, 1) + dt.timedelta(days=i), 100.0 + i) for y in (2022, 2024) for i in range(20)]
    df = spark.createDataFrame(year, "asset_id long, ts timestamp_ntz, price double")
    (row,) = history.compare_with_history(df).collect()
    fragile = row["rupture_gap"]
    near(row, similarity=100.0, continuity=100.0, duration_similarity=100.0, reference_kind="UPTREND")
    assert fragile == 0.0


def test_blocks_and_impulse(spark):
    hist = dated(spark, [100.0] * 20 + [100, 90, 80, 70, 60, 50, 40, 30])
    b = history.temporal_blocks(hist).first()
    near(b, r7_change_pct=-70.0, r7_price_score=0.0, r7_status="computed", i7_change_pct=0.0, i7_price_score=50.0, r24_status="partial", r24_change_pct=-25.0)
    x = history.impulse_state(history.history(hist)).first()
    near(x, impulse_bias="DOWN")
    assert x["impulse_exhaustion"] > 50


def test_occurrences_by_hand(spark):
    rows = [(1, i, float(p)) for i, p in enumerate([10, 11, 12, 13, 12, 0, 12])]
    got = {(r["start"], r["size"]): r for r in series.occurrences(spark.createDataFrame(rows, "asset_id long, idx long, price double")).collect()}
    assert set(got) == {(0, 3), (1, 3), (2, 3), (0, 4), (1, 4), (0, 5)}  # the price of 0 is passed over
    near(got[0, 4], kind="UP_STREAK", continued=False, similarity=0.0)
    near(got[2, 3], kind="MIXED", continued=True, similarity=round(100 - abs(12 - 37 / 3) / (37 / 3) * 800, 2))
    assert series.occurrences(spark.createDataFrame(rows[:4], "asset_id long, idx long, price double")).count() == 0


def test_structure_uses_the_mean_return(spark):
    rows = [(1, i, float(p)) for i, p in enumerate([100, 110, 99, 108.9])]
    x = series.structure_7d(spark.createDataFrame(rows, "asset_id long, idx long, price double")).first()
    # returns 10, -10, 10: bias 1 / 3, deviation 9.43 over a mean of 3.33 is 2.83; two turns of three;
    # convergence 58.9 * .45 + 33 * .4 - 28.3 + 15; total 19.04 * .35 + 26.4 * .4 + 36.86 * .25
    near(x, consistency=round(33 - 2.83 * 12 + 20, 2), rupture_penalty=round((2 / 3 * 0.65 + 2.83 / 5 * 0.35) * 100, 2), convergence=26.4, validation_score=26.44, validation_state="BREAK", pattern_state="UNSTABLE", status="partial")


@pytest.mark.parametrize("span", [7, 64, 10_000])
def test_ranges_of_the_log_give_what_one_pass_gives(spark, span):
    """Two logs, seqs with gaps, low confidence between: thresholds by ranges equal those from a plain list of the samples before."""
    rnd = random.Random(span)
    rows = [(7 * i, f"a{i}", version, "7D", rnd.choice([10.0, 39.99, 40.0, 80.0, None]), *[round(rnd.random() * 100, 2) for _ in range(4)]) for version in ("v8", "v9") for i in rnd.sample(range(400), 300)]
    shape = "seq long, asset_id string, version string, horizon string, market_confidence double, allow_raw_score double, block_raw_score double, risk_probability double, support_probability double"
    got = {(r.version, r.seq): r for r in decisions.prior_thresholds(spark.createDataFrame(rows, shape), most=90, least=20, span=span).collect()}
    assert len(got) == 600
    for version in ("v8", "v9"):
        log = sorted(r for r in rows if r[2] == version)
        for i, r in enumerate(log):
            before = [x for x in log[max(0, i - 90) : i] if (x[4] or 0) >= 40]
            mine = got[version, r[0]]
            assert mine.n_prior == len(before)
            for at, (k, (_, p)) in enumerate(decisions.LEARNT.items()):
                scores = sorted(x[5 + at] for x in before)
                assert mine[f"{k}_threshold"] == (decisions.FALLBACK[k] if len(before) < 20 else scores[int((len(before) - 1) * p)])


def test_the_market_reaches_every_branch(spark):
    """All regimes, decisions and maturities, and most reasons, occur over the market's series."""
    from tidepool.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["e12_orchestrator_market"](spark, sf_dir).collect()
    assert {r.maturity for r in rows} == {"INSUFFICIENT_SAMPLES", "BOOTSTRAP_ACTIVE", "CALIBRATED_ACTIVE"}
    assert {r.decision for r in rows} == {"ALLOW", "WATCH", "BLOCK"} and len({r.reason for r in rows}) >= 5
    assert {r.regime for r in QUERIES["e1_rfs_market_market"](spark, sf_dir).collect()} == {"STABLE", "TRANSITION", "VOLATILE"}
