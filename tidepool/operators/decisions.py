"""Decision engines over a market-structure row: analyses, comparator, gate, funnel, calibrated thresholds.

Each analysis adds columns to the row it reads, so that the whole chain is one projection over rfs_market's result: no join,
no shuffle. Inner terms are rounded one by one, as their definitions are; weights aren't merged.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp_score, count_if, percentile_of_counts, round2
from tidepool.sources.stage import staged

# By axis, slope and offset of its calibration, the factor to its probability, its weight in the aggregate.
TEMPORAL_AXES = {"occurrence": (0.92, 4, 0.95, 0.2), "frequency": (0.9, 5, 0.93, 0.18), "convergence": (0.94, 3, 0.96, 0.24), "evolution": (0.96, 2, 0.97, 0.24), "growth": (0.9, 4, 0.94, 0.14)}
RUPTURE_AXES = {"occurrence": (0.95, 2, 0.97, 0.18), "frequency": (0.96, 2, 0.97, 0.18), "convergence": (0.94, 3, 0.98, 0.2), "evolution": (0.97, 1.5, 0.99, 0.26), "growth": (0.95, 2.5, 0.98, 0.18)}
# Share of the live hint in an axis.
LIVE_SHARE = {"frequency": 0.12, "convergence": 0.18, "evolution": 0.18, "growth": 0.22}
# Support that a confirmation gives to growth, and its penalty in rupture.
GROWTH_SUPPORT = {"ALIGNED": 85, "NEUTRAL": 55, "UNAVAILABLE": 40}
RUPTURE_PENALTY = {"OPPOSED": 100, "NEUTRAL": 55, "UNAVAILABLE": 45}
# Thresholds that hold while too few samples are stored.
FALLBACK = {"allow": 76.0, "block": 72.0, "risk": 68.0, "support": 64.0}
LIVE = ("quality_score", "noise_score", "micro_volatility", "temporal_growth_hint", "temporal_convergence_hint", "temporal_evolution_hint", "micro_rupture_pressure")


def _inverse(column: str) -> Column:
    return 100 - F.col(column)


def _of(column: str, table: dict[str, int], other: int) -> Column:
    out = F.lit(float(other))
    for key, value in table.items():
        out = F.when(F.col(column) == key, float(value)).otherwise(out)
    return out


def _warnings(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in found]))


def _calibrated(df: DataFrame, axes: dict[str, tuple], prefix: str, spread: float) -> DataFrame:
    """Of raw axes prefix_axis: calibrated scores and probabilities, their coherence and weighted sum."""
    df = df.withColumns({f"{prefix}_{a}_calibrated": clamp_score(F.col(f"{prefix}_{a}") * slope + offset) for a, (slope, offset, *_) in axes.items()})
    df = df.withColumns({f"{prefix}_{a}_probability": clamp_score(F.col(f"{prefix}_{a}_calibrated") * p) for a, (_, _, p, _) in axes.items()})
    each = [F.col(f"{prefix}_{a}_probability") for a in axes]
    mean = clamp_score((each[0] + each[1] + each[2] + each[3] + each[4]) / 5)
    squares = [(x - mean) * (x - mean) for x in each]
    coherence = clamp_score(100 - F.sqrt((squares[0] + squares[1] + squares[2] + squares[3] + squares[4]) / 5) * spread)
    return df.withColumns({f"{prefix}_coherence": coherence, f"{prefix}_structural": clamp_score(blend(*[(w, F.col(f"{prefix}_{a}_probability")) for a, (*_, w) in axes.items()]))})


def with_live(rfs: DataFrame, live: DataFrame | None) -> DataFrame:
    """rfs with the live columns of its asset; null where there are none."""
    if live is None:
        return rfs.withColumns({c: F.lit(None).cast("double") for c in LIVE})
    return rfs.join(live.select("asset_id", *[clamp_score(F.col(c)).alias(c) for c in LIVE]), "asset_id", "left")


def temporal_analysis(rfs: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Occurrence, frequency, convergence, evolution and growth: raw, calibrated and as probabilities; coherence and support.

    live: asset_id and LIVE; its hints enter all axes but occurrence.
    """
    x = with_live(rfs, live)
    base = {
        "occurrence": clamp_score(F.col("occurrence") * 0.7 + F.least(F.lit(100.0), F.col("pattern_count") * 8.0) * 0.3),
        "frequency": clamp_score(F.col("frequency") * 0.7 + (100 - clamp_score(F.col("direction_changes") * 8.0)) * 0.3),
        "convergence": clamp_score(F.col("convergence") * 0.75 + F.col("dominant_direction_ratio") * 0.25),
        "evolution": clamp_score(blend((0.45, F.col("correlation")), (0.3, F.col("continuity")), (0.15, clamp_score(_inverse("rupture"))), (0.1, F.col("duration")))),
        "growth": clamp_score(blend((0.5, F.col("mid_term")), (0.2, clamp_score(_inverse("rupture"))), (0.15, F.col("duration")), (0.05, F.col("frequency")), (0.1, _of("alignment", GROWTH_SUPPORT, 15)))),
    }
    hints = {"frequency": clamp_score((100 - F.col("noise_score")) * 0.4 + (100 - F.col("micro_volatility")) * 0.2 + F.col("quality_score") * 0.4), "convergence": F.col("temporal_convergence_hint"), "evolution": F.col("temporal_evolution_hint"), "growth": F.col("temporal_growth_hint")}
    x = x.withColumns({f"t_{a}": v for a, v in base.items()})
    for a, share in LIVE_SHARE.items():
        hint = F.coalesce(F.when(F.col("quality_score").isNotNull(), hints[a]), F.col(f"t_{a}"))
        x = x.withColumn(f"t_{a}", clamp_score(F.col(f"t_{a}") * (1 - share if a != "frequency" else 0.88) + hint * share))
    x = _calibrated(x, TEMPORAL_AXES, "t", 2.2)
    x = x.withColumn("t_support", clamp_score(F.col("t_structural") * 0.72 + F.col("t_coherence") * 0.28))
    p = lambda a: F.col(f"t_{a}_probability")
    return x.withColumn(
        "t_warnings",
        _warnings(
            (F.col("t_coherence") < 45, "temporal_analysis_low_coherence"), ((p("growth") < 35) & (p("convergence") >= 60), "temporal_analysis_direction_without_growth"), ((p("evolution") < 40) & (p("occurrence") >= 60), "temporal_analysis_repetition_without_clean_evolution"),
            (F.col("noise_score") >= 75, "temporal_analysis_live_noise_high"), (F.col("quality_score") < 35, "temporal_analysis_live_quality_low"), (F.col("micro_rupture_pressure") >= 75, "temporal_analysis_live_micro_rupture_pressure_high"),
        ),
    )


def rupture_analysis(x: DataFrame) -> DataFrame:
    """The same five axes of breaking, the probability of a break and the risk that it dominates. x: temporal_analysis' result."""
    n = F.greatest(F.lit(1), F.col("sample_size"))
    live = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    x = x.withColumns({
        "r_density": clamp_score(F.col("rupture_events") / n * 100), "r_turning": clamp_score(F.col("direction_changes") / n * 100), "r_anti_continuity": clamp_score(_inverse("continuity")),
        "r_growth": clamp_score(blend((0.5, F.col("rupture")), (0.16, _inverse("frequency")), (0.14, _inverse("duration")), (0.1, _inverse("stability")), (0.1, live("micro_rupture_pressure")))),
    })
    x = x.withColumns({
        "r_occurrence": clamp_score(blend((0.55, F.col("r_density")), (0.3, F.col("rupture")), (0.15, F.least(F.lit(100.0), F.col("rupture_events") * 12.0)))),
        "r_frequency": clamp_score(blend((0.4, F.col("r_density")), (0.2, F.col("r_turning")), (0.3, _inverse("frequency")), (0.1, live("noise_score")))),
        "r_convergence": clamp_score(blend((0.35, F.col("rupture")), (0.25, _inverse("convergence")), (0.2, _of("alignment", RUPTURE_PENALTY, 20)), (0.2, _inverse("dominant_direction_ratio")))),
        "r_evolution": clamp_score(blend((0.32, F.col("rupture")), (0.28, F.col("r_anti_continuity")), (0.16, _inverse("correlation")), (0.14, _inverse("duration")), (0.1, _inverse("frequency")))),
    })
    x = _calibrated(x, RUPTURE_AXES, "r", 2.1)
    raw = clamp_score(blend((0.56, F.col("r_structural")), (0.16, F.col("r_coherence")), (0.28, F.col("r_anti_continuity"))))
    x = x.withColumn("rupture_probability", clamp_score(clamp_score(raw * 0.98 + 1) * 0.99))
    risk = clamp_score(blend((0.5, F.col("rupture_probability")), (0.2, F.col("r_coherence")), (0.2, F.col("r_anti_continuity")), (0.1, F.col("r_growth"))))
    x = x.withColumn("risk_rupture", clamp_score(risk * 0.99 + 0.5))
    return x.withColumn("r_warnings", _warnings((F.col("rupture_probability") >= 75, "rupture_analysis_high_probability"), ((F.col("r_coherence") >= 70) & (F.col("rupture_probability") >= 65), "rupture_analysis_coherent_break_risk"), (F.col("risk_rupture") >= 70, "risk_rupture_score_high"), (live("noise_score") >= 80, "rupture_analysis_live_noise_high")))


def recovery_analysis(x: DataFrame) -> DataFrame:
    """Whether a reconstruction becomes exploitable. x: rupture_analysis' result."""
    p = lambda a: F.col(f"t_{a}_probability")
    x = x.withColumns({"restart_support": clamp_score(blend((0.35, p("growth")), (0.25, p("convergence")), (0.12, p("frequency")), (0.18, p("evolution")), (0.1, F.coalesce("temporal_growth_hint", F.lit(50.0))))), "anti_rupture_pressure": clamp_score(_inverse("risk_rupture"))})
    x = x.withColumn("reconstruction_quality", clamp_score(blend((0.45, F.col("restart_support")), (0.25, F.col("anti_rupture_pressure")), (0.15, F.col("t_coherence")), (0.15, F.col("stability")))))
    raw = clamp_score(blend((0.42, F.col("restart_support")), (0.28, F.col("anti_rupture_pressure")), (0.2, F.col("reconstruction_quality")), (0.1, F.col("t_support"))))
    x = x.withColumn("recovery_score", clamp_score(raw * 0.97 + 1.5))
    own = _warnings((F.col("recovery_score") >= 70, "recovery_analysis_high_probability"), ((F.col("risk_rupture") >= 70) & (F.col("recovery_score") >= 60), "recovery_analysis_conflict_with_rupture"))
    return x.withColumn("recovery_warnings", F.array_distinct(F.concat("t_warnings", "r_warnings", own)))


def comparator(rfs: DataFrame) -> DataFrame:
    """Recovery against rupture: which of them dominates, and how surely."""
    x = rfs.select(
        "asset_id", "confidence",
        clamp_score(blend((0.55, F.col("rupture")), (0.25, _inverse("stability")), (0.1, _inverse("duration")), (0.1, _inverse("frequency")))).alias("rupture_pressure"),
        clamp_score(blend((0.3, F.col("convergence")), (0.2, F.col("frequency")), (0.2, F.col("duration")), (0.15, F.col("correlation")), (0.15, _inverse("rupture")))).alias("recovery_strength"),
    )
    pressure, strength = F.col("rupture_pressure"), F.col("recovery_strength")
    x = x.withColumn("dominance_score", clamp_score(strength - pressure + 50))
    x = x.withColumn("dominance_state", F.when(F.col("dominance_score") >= 60, "RECOVERY_DOMINANT").when(F.col("dominance_score") <= 40, "RUPTURE_DOMINANT").otherwise("BALANCED"))
    sure = clamp_score(F.abs(strength - pressure) * 0.8 + F.col("confidence") * 0.2)
    warnings = _warnings(((pressure > 70) & (strength < 40), "strong_structural_break_risk"), ((strength > 65) & (pressure < 45), "clean_recovery_structure"), (F.col("dominance_state") == "BALANCED", "indecisive_structure"))
    return x.select("asset_id", "rupture_pressure", "recovery_strength", "dominance_score", "dominance_state", sure.alias("confidence"), warnings.alias("warnings"))


def impulse_governance(x: DataFrame) -> Column:
    """What an impulse does to a decision: columns impulse_state, impulse_instability, impulse_saturation; unavailable without them."""
    if "impulse_state" not in x.columns:
        return F.lit("unavailable")
    state = F.col("impulse_state")
    known = (
        F.when(state == "EXHAUSTION", "defensive")
        .when((state == "RELEASE") & ((F.col("rupture") >= 65) | (F.coalesce("impulse_instability", F.lit(0.0)) >= 65)), "restrictive")
        .when((state == "PRESSURE_BUILDING") & (F.coalesce("impulse_saturation", F.lit(0.0)) >= 70), "defensive")
        .when((state == "COMPRESSION") & (F.col("stability") >= 65) & (F.col("rupture") <= 45), "supportive")
        .otherwise("neutral")
    )
    return F.when(state.isNull(), "unavailable").otherwise(known)


def market_gate(rfs: DataFrame) -> DataFrame:
    """Scores, probabilities, decision, neutralisation and rupture evolution of a market, beside the row's own columns."""
    s, r, c, o = F.col("stability"), F.col("rupture"), F.col("market_convergence"), F.col("opportunity")
    x = rfs.withColumn("market_convergence", clamp_score(F.col("convergence") * 0.5 + F.col("correlation") * 0.5))
    x = x.withColumn("opportunity", clamp_score(blend((0.5, s), (0.3, c), (0.2, 100 - r))))
    inner = clamp_score(100 - F.abs(s - c) * 0.35 - F.abs(c - o) * 0.25 - F.abs(s - o) * 0.2)
    reliable = clamp_score(blend((0.28, s), (0.24, c), (0.16, F.col("frequency")), (0.14, F.col("duration")), (0.12, F.col("correlation")), (0.06, inner)))
    x = x.withColumn("market_confidence", clamp_score(reliable - clamp_score(r * 0.38)))
    sure = F.col("market_confidence")
    x = x.withColumns({
        "support_probability": clamp_score(blend((0.28, s), (0.28, c), (0.22, o), (0.12, sure), (0.1, 100 - r))),
        "recovery_probability": clamp_score(blend((0.35, 100 - r), (0.25, s), (0.2, c), (0.1, F.col("duration")), (0.1, F.col("correlation")))),
        "temporal_coherence": clamp_score(blend((0.4, sure), (0.3, c), (0.2, F.col("duration")), (0.1, F.col("correlation")))),
        "temporal_support": clamp_score(blend((0.35, o), (0.25, c), (0.2, s), (0.2, sure))),
        "core_decision": F.when((s < 40) | (r > 70), "BLOCK").when((s > 80) & (r < 30) & (o > 75), "ALLOW").otherwise("WATCH"),
        "governance": impulse_governance(rfs),
        "rupture_evolution": clamp_score(clamp_score(r) * 0.6 + clamp_score(r) * 0.4),
    })
    grade = lambda bad, high, other: F.when(bad, high).otherwise(other)
    neutral = (
        F.when((F.col("governance") == "restrictive") & (r >= 65), F.struct(F.lit("excessive_rupture").alias("reason"), grade(r >= 80, "high", "medium").alias("severity")))
        .when((F.col("governance") == "defensive") & (sure < 50), F.struct(F.lit("low_confidence").alias("reason"), grade(sure < 30, "high", "medium").alias("severity")))
        .when(sure < 40, F.struct(F.lit("low_confidence").alias("reason"), grade(sure < 25, "high", "medium").alias("severity")))
        .when(r >= 80, F.struct(F.lit("excessive_rupture").alias("reason"), grade(r >= 90, "critical", "high").alias("severity")))
        .when(c < 35, F.struct(F.lit("contradictory_structure").alias("reason"), F.lit("medium").alias("severity")))
        .otherwise(F.struct(F.lit("none").alias("reason"), F.lit("none").alias("severity")))
    )
    e = F.col("rupture_evolution")
    x = x.withColumn("_n", neutral).withColumn("rupture_state", F.when(e >= 85, "explosive").when(e >= 65, "worsening").when(e <= 25, "improving").otherwise("stable"))
    return x.withColumns({"neutralized": F.col("_n.reason") != "none", "neutralization_reason": F.col("_n.reason"), "neutralization_severity": F.col("_n.severity")}).drop("_n")


GATE = ("asset_id", "regime", "status", "stability", "rupture", "market_convergence", "opportunity", "market_confidence", "support_probability", "recovery_probability", "temporal_coherence", "temporal_support", "core_decision", "governance", "neutralized", "neutralization_reason", "neutralization_severity", "rupture_evolution", "rupture_state")


def funnel(gated: DataFrame, thresholds: dict[str, float | Column] = FALLBACK, dominance: Column | None = None) -> DataFrame:
    """Final decision with its reason: the first gate that speaks wins. thresholds: allow, risk and support, numbers or columns."""
    t = {k: clamp_score(v if isinstance(v, Column) else F.lit(float(v))) for k, v in thresholds.items()}
    side = F.lit("NEUTRAL") if dominance is None else dominance
    risk, recovery = F.col("rupture"), F.col("recovery_probability")
    score = clamp_score(blend((0.24, F.col("stability")), (0.18, F.col("market_convergence")), (0.18, F.col("support_probability")), (0.14, F.col("opportunity")), (0.1, F.col("market_confidence")), (0.08, recovery)) - risk * 0.26)
    x = gated.withColumns({
        "decision_score": score, "recovery_rupture_dominance": clamp_score(recovery - risk), "rupture_dominant": (risk >= t["risk"]) | (side == "RUPTURE"),
        "temporal_gate": (F.col("temporal_coherence") >= 55) & (F.col("temporal_support") >= 50), "support_gate": F.col("support_probability") >= t["support"], "safety_gate": (F.col("regime") != "TRANSITION") | (risk < t["risk"] - 8),
    })
    x = x.withColumn("dominance_gate", (F.col("regime") != "TRANSITION") | (side == "RECOVERY") | (F.col("recovery_rupture_dominance") >= 8))
    reason = (
        F.when(F.col("rupture_dominant"), "rupture_kill_switch")
        .when(~F.col("temporal_gate"), "temporal_gate_failed")
        .when(~F.col("support_gate") | (F.col("market_confidence") < 40), "support_gate_failed")
        .when(~F.col("safety_gate") | (F.col("regime") == "VOLATILE"), "transition_safety_gate_failed")
        .when(~F.col("dominance_gate"), "transition_dominance_gate_failed")
        .when(F.col("decision_score") >= t["allow"], "allow_score_passed")
        .otherwise("allow_score_below_threshold")
    )
    x = x.withColumn("reason", reason)
    return x.withColumn("decision", F.when(F.col("reason") == "rupture_kill_switch", "BLOCK").when(F.col("reason") == "allow_score_passed", "ALLOW").otherwise("WATCH"))


FUNNEL = ("asset_id", "regime", "decision_score", "recovery_rupture_dominance", "decision", "reason", "rupture_dominant", "temporal_gate", "support_gate", "safety_gate", "dominance_gate", "stability", "rupture", "market_confidence", "support_probability", "recovery_probability", "opportunity", "market_convergence", "neutralized", "neutralization_reason", "neutralization_severity", "rupture_evolution", "rupture_state")
SCORES = ("decision_score", "allow_raw_score", "block_raw_score", "support_probability", "risk_probability", "market_confidence")


def decision_samples(decided: DataFrame, seq: Column, version: str = "v8", horizon: str = "7D") -> DataFrame:
    """What is stored of a decision. seq: its place in the order of decisions."""
    return decided.select(
        seq.cast("long").alias("seq"), "asset_id", F.lit(version).alias("version"), F.lit(horizon).alias("horizon"), "regime", "decision", "reason", "decision_score", F.col("decision_score").alias("allow_raw_score"), F.col("rupture").alias("block_raw_score"), "support_probability", F.col("rupture").alias("risk_probability"),
        "stability", "opportunity", "market_convergence", "market_confidence", "recovery_probability", "recovery_rupture_dominance", F.lit(0.0).alias("rupture_score"), F.lit("balanced").alias("dominance_state"), F.lit(False).alias("rupture_detected"), "rupture_evolution", "rupture_state", "neutralized", "neutralization_reason", "neutralization_severity",
    )


# Words that a stored decision's fields may hold.
DECISIONS, REGIMES = ("ALLOW", "WATCH", "BLOCK"), ("STABLE", "TRANSITION", "VOLATILE")
NEUTRAL_REASONS = ("insufficient_data", "contradictory_structure", "unstable_distribution", "excessive_decay", "excessive_rupture", "invalid_temporal_alignment", "low_confidence", "degraded_snapshot", "corrupted_distribution", "none")
SEVERITIES, EVOLUTIONS = ("none", "low", "medium", "high", "critical"), ("improving", "stable", "worsening", "explosive", "unknown")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def sample_issues(samples: DataFrame) -> DataFrame:
    """seq and the reasons why a stored decision is no valid sample, in the order of its fields; empty for valid ones."""
    contract, number, text, governed = "INVALID_SAMPLE_CONTRACT", "INVALID_SAMPLE_REQUIRED_NUMERIC", "INVALID_SAMPLE_REQUIRED_FIELD", "INVALID_GOVERNANCE_CONTRACT"
    among = lambda c, words: F.coalesce(F.col(c).isin(*words), F.lit(False))
    score = lambda c: F.when(~_finite(c), f"{number}:{c}").when((F.col(c) < 0) | (F.col(c) > 100), f"{contract}:{c}")
    found = [
        F.when(F.col("seq").isNull(), f"{number}:seq"), F.when(F.coalesce(F.trim("version"), F.lit("")) == "", f"{text}:version"), F.when(~among("decision", DECISIONS), f"{contract}:decision"), F.when(~among("regime", REGIMES), f"{contract}:regime"), *[score(c) for c in SCORES],
        F.when(F.col("neutralized").isNull(), f"{governed}:neutralized"), F.when(~among("neutralization_reason", NEUTRAL_REASONS), f"{governed}:neutralization_reason"), F.when(~among("neutralization_severity", SEVERITIES), f"{governed}:neutralization_severity"),
        score("recovery_probability"), score("recovery_rupture_dominance"), score("rupture_evolution"), F.when(~among("rupture_state", EVOLUTIONS), f"{governed}:rupture_state"),
    ]
    return samples.select("seq", F.array_compact(F.array(*found)).alias("issues"))


def policy_samples(samples: DataFrame, version: str = "v8", horizon: str = "7D") -> DataFrame:
    """Samples that thresholds may be learnt from."""
    ok = (F.col("version") == version) & (F.col("horizon") == horizon) & F.col("decision").isin(*DECISIONS) & F.col("regime").isin(*REGIMES)
    for c in SCORES[:5]:
        ok = ok & _finite(c)
    # counted as they pass by (and no filter is pushed past the counters, into the expressions that made the samples)
    seen = samples.observe("policy_samples", F.count(F.lit(1)).alias("seen"))
    return seen.where(ok)


def calibration_policy(samples: DataFrame) -> DataFrame:
    """Floor-index percentiles of stored scores: allow, block and risk P75, support P50, and how sure they are.

    Scores have two decimals, so that counts by score (10,001 values at most) tell every percentile whatever the number of
    samples: one grouping with partial counts, then a window over these few rows. Fixed thresholds for no samples.
    """
    rules = {"allow": ("allow_raw_score", 0.75, 76.0), "block": ("block_raw_score", 0.75, 72.0), "risk": ("risk_probability", 0.75, 70.0), "support": ("support_probability", 0.5, 50.0)}
    long = samples.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), clamp_score(F.col(c)).alias("x")) for k, (c, *_) in rules.items()])).alias("e")).select("e.k", "e.x")
    points = percentile_of_counts(long.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")), {k: p for k, (_, p, _) in rules.items()})
    each = points.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), *[F.coalesce(F.max(F.when(F.col("k") == k, F.col("x"))), F.lit(d)).alias(k) for k, (_, _, d) in rules.items()])
    return each.withColumn("source", F.when(F.col("n") == 0, "fallback").otherwise("calibrated"))


# By threshold, the stored score and the percentile it is taken at.
LEARNT = {"allow": ("allow_raw_score", 0.75), "block": ("block_raw_score", 0.75), "risk": ("risk_probability", 0.75), "support": ("support_probability", 0.5)}
#: Samples of a range of the log that one task goes through.
RANGE = 8192


def numbered(samples: DataFrame) -> DataFrame:
    """samples with place: their number from 0 in the log of their version and horizon, by seq. Ranges of the log are sorted apart; only their sizes are summed in one row of order."""
    log = ["version", "horizon"]
    ranged = staged(samples.repartitionByRange(*log, "seq").sortWithinPartitions(*log, "seq").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(*log, "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*log).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*log, "part").orderBy("seq"))
    return ranged.withColumn("own", own).join(F.broadcast(sizes.select(*log, "part", before.alias("before"))), [*log, "part"]).withColumn("place", F.col("before") + F.col("own") - 1).drop("own", "before", "part")


def sliding_percentiles(rows: pd.DataFrame, most: int, least: int) -> pd.DataFrame:
    """Thresholds of the rows of a range that are its own (not carried), in order of place: each from the ``most`` rows before it that are confident.

    Sorted lists lose the row that leaves and gain the one that enters; a percentile is read off at its place.
    """
    rows = rows.sort_values("place", kind="stable")
    sure, carried = (rows["market_confidence"] >= 40).to_numpy(), rows["carried"].to_numpy()
    scores = {k: rows[c].to_numpy() for k, (c, _) in LEARNT.items()}
    held: dict[str, list[float]] = {k: [] for k in LEARNT}
    out: list[list] = []
    first = 0
    for i in range(len(rows)):
        while first < i - most:
            if sure[first]:
                for k, v in held.items():
                    v.pop(bisect_left(v, scores[k][first]))
            first += 1
        n = len(held["allow"])
        if not carried[i]:
            out.append([n, *[FALLBACK[k] if n < least else v[floor((n - 1) * LEARNT[k][1])] for k, v in held.items()]])
        if sure[i]:
            for k, v in held.items():
                insort(v, scores[k][i])
    kept = rows[~carried]
    learnt = pd.DataFrame(out, columns=["n_prior", *[f"{k}_threshold" for k in LEARNT]], index=kept.index)
    return pd.concat([kept[["version", "horizon", "seq", "asset_id"]], learnt], axis=1)


def prior_thresholds(samples: DataFrame, most: int = 1000, least: int = 30, span: int = RANGE) -> DataFrame:
    """Each decision's thresholds from the ``most`` samples stored before it whose confidence is 40 or more.

    Fewer than ``least`` of them leave the fixed thresholds. The frame is the last ``most`` samples stored, those of low
    confidence included, and the percentile is over those that are left. Samples of one (version, horizon) are one log: it is
    cut into ranges of ``span`` samples, each with a copy of the ``most`` samples before it, so that no task has more than both.
    Returns version, horizon, seq, asset_id, n_prior, a threshold for each of LEARNT, maturity. Null scores count as 0.
    """
    scores = [clamp_score(F.col(c)).alias(c) for c, _ in LEARNT.values()]
    x = numbered(samples.select("version", "horizon", "seq", "asset_id", F.coalesce("market_confidence", F.lit(0.0)).alias("market_confidence"), *scores))
    own, last = F.floor(F.col("place") / span), F.floor((F.col("place") + most) / span)
    x = x.select("*", F.explode(F.sequence(own, last)).alias("range")).withColumn("carried", F.col("range") != own)
    shape = f"version string, horizon string, seq long, asset_id {samples.schema['asset_id'].dataType.simpleString()}, n_prior long, " + ", ".join(f"{k}_threshold double" for k in LEARNT)
    learnt = x.groupBy("version", "horizon", "range").applyInPandas(lambda rows: sliding_percentiles(rows, most, least), shape)
    maturity = F.when(F.col("n_prior") < least, "INSUFFICIENT_SAMPLES").when(F.col("n_prior") < 80, "BOOTSTRAP_ACTIVE").otherwise("CALIBRATED_ACTIVE")
    return learnt.withColumn("maturity", maturity)


def pressure_state(x: Column) -> Column:
    return F.when(x < 20, "LOW").when(x < 45, "NORMAL").when(x < 70, "ELEVATED").otherwise("EXCESSIVE")


def calibration_summary(samples: DataFrame, least: int = 80) -> DataFrame:
    """Structural scores, pressures, comparator, maturity and aggregated score of stored decisions, in one aggregation."""
    valid = policy_samples(samples)
    kept = valid.where(_finite("market_confidence") & (F.col("market_confidence") >= 40))
    right = F.when(((F.col("decision") == "ALLOW") & (F.col("support_probability") >= 60) & (F.col("risk_probability") < 55)) | ((F.col("decision") == "BLOCK") & (F.col("risk_probability") >= 60)), 100.0).otherwise(50.0)
    share = lambda d: clamp_score(F.avg(F.when(F.col("decision") == d, 1.0).otherwise(0.0)) * 100)
    g = kept.agg(
        F.count(F.lit(1)).alias("n"), *[share(d).alias(f"{d.lower()}_pct") for d in DECISIONS], clamp_score(F.avg(F.coalesce("market_convergence", F.lit(50.0)))).alias("convergence"), clamp_score(F.avg(right)).alias("correlation"),
        clamp_score(F.avg(clamp_score(F.col("rupture_score")))).alias("rupture_pressure"), count_if(F.col("rupture_detected")).alias("n_rupture"), clamp_score(F.avg(clamp_score((F.col("recovery_probability") + F.col("recovery_rupture_dominance")) / 2))).alias("recovery_pressure"), count_if(F.col("dominance_state") == "recovery_dominant").alias("n_recovery"),
        F.coalesce(F.bool_or("neutralized"), F.lit(False)).alias("any_neutralized"), F.coalesce(F.bool_or(F.col("rupture_state") == "worsening"), F.lit(False)).alias("any_worsening"), F.coalesce(F.bool_or(F.col("rupture_state") == "explosive"), F.lit(False)).alias("any_explosive"),
    )
    over = lambda c, target, factor: clamp_score(F.greatest(F.lit(0.0), F.col(c) - target) * factor)
    g = g.withColumns({
        "occurrence": clamp_score(F.col("n") / least * 100), "frequency": clamp_score(100 - (F.abs(F.col("allow_pct") - 15) * 0.35 + F.abs(F.col("watch_pct") - 70) * 0.4 + F.abs(F.col("block_pct") - 15) * 0.25)), "duration": clamp_score(F.least(F.col("n"), F.lit(30)) * 3.33),
        "allow_pressure": over("allow_pct", 15, 4), "watch_pressure": over("watch_pct", 70, 3), "block_pressure": over("block_pct", 15, 4),
        "maturity": F.when(F.col("n") < 30, "INSUFFICIENT_SAMPLES").when(F.col("n") < least, "BOOTSTRAP_ACTIVE").otherwise("CALIBRATED_ACTIVE"),
    })
    gap = F.col("recovery_pressure") - F.col("rupture_pressure")
    return g.withColumns({
        **{f"{c}_state": pressure_state(F.col(c)) for c in ("allow_pressure", "watch_pressure", "block_pressure", "rupture_pressure", "recovery_pressure")},
        "dominant_side": F.when(gap > 10, "recovery_dominant").when(gap < -10, "rupture_dominant").otherwise("balanced"),
        "aggregated": clamp_score(blend((0.2, F.col("occurrence")), (0.2, F.col("frequency")), (0.25, F.col("convergence")), (0.2, F.col("correlation")), (0.15, F.col("duration"))) - F.col("rupture_pressure") * 0.25),
    })


# By policy group, threshold, column, regime (none: all), percentile, band, fallback.
ADAPTIVE = (
    ("block", "stability_max", "stability", None, 0.12, 25, 42, 35), ("block", "rupture_min", "rupture", None, 0.88, 65, 90, 78), ("block", "confidence_max", "market_confidence", None, 0.1, 15, 35, 25), ("block", "support_max", "support_probability", None, 0.12, 15, 35, 22),
    ("allow_stable", "stability_min", "stability", "STABLE", 0.72, 68, 86, 72), ("allow_stable", "opportunity_min", "opportunity", "STABLE", 0.72, 58, 82, 62), ("allow_stable", "convergence_min", "market_convergence", "STABLE", 0.68, 55, 80, 60), ("allow_stable", "rupture_max", "rupture", "STABLE", 0.35, 18, 50, 42), ("allow_stable", "support_min", "support_probability", "STABLE", 0.72, 60, 82, 66),
    ("allow_transition", "stability_min", "stability", "TRANSITION", 0.82, 68, 84, 74), ("allow_transition", "opportunity_min", "opportunity", "TRANSITION", 0.84, 60, 85, 68), ("allow_transition", "convergence_min", "market_convergence", "TRANSITION", 0.8, 58, 82, 65), ("allow_transition", "rupture_max", "rupture", "TRANSITION", 0.28, 20, 48, 40), ("allow_transition", "confidence_min", "market_confidence", "TRANSITION", 0.7, 42, 75, 55), ("allow_transition", "support_min", "support_probability", "TRANSITION", 0.84, 62, 86, 72),
    ("soft_transition", "stability_min", "stability", "TRANSITION", 0.68, 62, 78, 70), ("soft_transition", "opportunity_min", "opportunity", "TRANSITION", 0.7, 55, 76, 65), ("soft_transition", "convergence_min", "market_convergence", "TRANSITION", 0.66, 54, 76, 62), ("soft_transition", "rupture_max", "rupture", "TRANSITION", 0.45, 24, 58, 48), ("soft_transition", "support_min", "support_probability", "TRANSITION", 0.7, 58, 78, 65),
)


def adaptive_thresholds(decided: DataFrame, least: int = 40, least_regime: int = 12) -> DataFrame:
    """Linear percentiles of scores held to bands, for all and by regime; the fixed fallback below ``least`` rows; warnings."""
    few = F.count(F.lit(1)) < least
    cols = []
    for group, name, column, regime, p, low, high, fixed in ADAPTIVE:
        x = F.percentile(round2(F.col(column)) if regime is None else F.when(F.col("regime") == regime, round2(F.col(column))), p)
        cols.append(F.when(few, float(fixed)).otherwise(round2(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(x, F.lit(0.0)))))).alias(f"{group}_{name}"))
    counts = {r: count_if(F.col("regime") == r) for r in REGIMES}
    warnings = F.when(few, F.array(F.lit("adaptive_thresholds_insufficient_global_sample"))).otherwise(_warnings(*[(counts[r] < least_regime, f"adaptive_thresholds_insufficient_{r.lower()}_sample") for r in REGIMES]))
    return decided.agg(F.count(F.lit(1)).alias("n"), F.when(few, "fallback").otherwise("adaptive").alias("source"), *[counts[r].alias(f"n_{r.lower()}") for r in REGIMES], *cols, F.array_join(warnings, ",").alias("warnings"))
