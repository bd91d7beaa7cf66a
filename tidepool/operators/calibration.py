"""Learnt impulse thresholds, calibration reports, the calibration layer, pattern-driven decisions, integrity chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp, clamp_score, count_if, finite, mean_score, round2

STATES = ("COMPRESSION", "PRESSURE_BUILDING", "RELEASE", "EXHAUSTION", "NEUTRAL")
REGIMES = ("STABLE", "TRANSITION", "VOLATILE")
DECISIONS = ("ALLOW", "WATCH", "BLOCK")
# By state and threshold, its score, percentile, band, fallback. Scores that few assets have fall back to another one.
IMPULSE_RULES = {
    "compression": (("pressure_min", "pressure", 0.45, 30, 58, 35), ("instability_max", "instability", 0.62, 42, 68, 58), ("exhaustion_max", "exhaustion", 0.62, 38, 66, 55), ("core_min", "core", 0.45, 35, 62, 45)),
    "pressure_building": (("pressure_min", "pressure", 0.55, 38, 68, 45), ("saturation_min", "saturation", 0.52, 35, 65, 42), ("instability_min", "instability", 0.42, 28, 62, 35), ("growth_min", "growth", 0.42, 30, 62, 38)),
    "release": (("pressure_min", "pressure", 0.58, 42, 72, 52), ("instability_min", "instability", 0.55, 38, 70, 48), ("saturation_min", "saturation", 0.52, 36, 68, 45), ("growth_min", "growth", 0.48, 34, 66, 42), ("decay_max", "decay", 0.7, 52, 82, 72)),
    "exhaustion": (("exhaustion_min", "exhaustion", 0.58, 48, 78, 62), ("instability_min", "instability", 0.52, 35, 72, 45), ("saturation_min", "saturation", 0.52, 36, 72, 48), ("decay_min", "decay", 0.5, 35, 72, 45)),
    "neutral": (("pressure_max", "pressure", 0.65, 25, 52, 34), ("instability_max", "instability", 0.65, 25, 56, 34), ("saturation_max", "saturation", 0.65, 25, 56, 34), ("exhaustion_max", "exhaustion", 0.65, 25, 56, 34)),
}
_INSTEAD = {"core": "pressure", "growth": "pressure", "decay": "exhaustion"}
_SCORES = ("pressure", "instability", "saturation", "exhaustion", "growth", "core", "decay")


def impulse_samples(impulses: DataFrame) -> DataFrame:
    """Rows with the four required scores, all clamped. impulses: _SCORES (growth, core and decay may be missing) and state."""
    kept = [F.when(finite(F.col(c)).isNotNull(), clamp_score(F.col(c))).alias(c) if c in impulses.columns else F.lit(None).cast("double").alias(c) for c in _SCORES]
    return impulses.select("state", *kept).dropna(subset=list(_SCORES[:4]))


def impulse_policy(impulses: DataFrame, least: int = 40, least_state: int = 8) -> DataFrame:
    """Thresholds of each state: linear percentiles over its rows, or over all where it has none, held to bands; one aggregation."""
    x = impulse_samples(impulses)
    few = F.count(F.lit(1)) < least
    out = []
    for state, rules in IMPULSE_RULES.items():
        for name, score, p, low, high, fixed in rules:
            own = F.percentile(F.when(F.col("state") == state.upper(), F.col(score)), p)
            value = F.coalesce(own, F.percentile(_INSTEAD.get(score, score), p), F.lit(0.0))
            out.append(F.when(few, float(fixed)).otherwise(round2(clamp(value, low, high))).alias(f"{state}_{name}"))
    counts = {s: count_if(F.col("state") == s) for s in STATES}
    lacking = F.array_compact(F.array(*[F.when(counts[s] < least_state, F.lit(f"impulse_adaptive_thresholds_insufficient_{s.lower()}_sample")) for s in STATES[:4]]))
    warnings = F.when(few, F.array(F.lit("impulse_adaptive_thresholds_insufficient_global_sample"))).otherwise(lacking)
    return x.agg(F.count(F.lit(1)).alias("n"), F.when(few, "fallback").otherwise("adaptive").alias("source"), *[F.coalesce(counts[s], F.lit(0)).alias(f"n_{s.lower()}") for s in STATES], *out, F.array_join(warnings, ",").alias("warnings"))


def relabelled(impulses: DataFrame, policy: DataFrame) -> DataFrame:
    """impulses with adaptive_state, by the one row of policy, which goes to all tasks. Missing growth, core and decay count as 50."""
    x = impulses.join(F.broadcast(policy.select(*[f"{s}_{r[0]}" for s, rules in IMPULSE_RULES.items() for r in rules])))
    score = lambda c: F.coalesce(F.when(finite(F.col(c)).isNotNull(), clamp_score(F.col(c))), F.lit(0.0 if c in _SCORES[:4] else 50.0)) if c in impulses.columns else F.lit(0.0 if c in _SCORES[:4] else 50.0)

    def fits(state: str) -> Column:
        ok = F.lit(True)
        for name, c, *_ in IMPULSE_RULES[state]:
            limit = F.col(f"{state}_{name}")
            ok = ok & (score(c) >= limit if name.endswith("_min") else score(c) <= limit)
        return ok

    state = F.when(fits("exhaustion"), "EXHAUSTION").when(fits("release"), "RELEASE").when(fits("pressure_building"), "PRESSURE_BUILDING").when(fits("compression"), "COMPRESSION").otherwise("NEUTRAL")
    return x.select(*impulses.columns, state.alias("adaptive_state"))


def impulse_governance(policy: DataFrame) -> DataFrame:
    """Dominance, validity and ratios of the distribution of states that a policy was learnt from."""
    n, share = F.col("n"), lambda s: F.when(F.col("n") > 0, round2(F.col(f"n_{s}") / F.col("n"))).otherwise(0.0)
    most = F.greatest(*[F.col(f"n_{s.lower()}") for s in STATES])
    dominant = F.coalesce(*[F.when(F.col(f"n_{s.lower()}") == most, s) for s in STATES])
    x = policy.withColumns({"dominant_state": dominant, "release_ratio": share("release"), "exhaustion_ratio": share("exhaustion"), "compression_ratio": share("compression"), "most": most})
    state = F.when(n <= 0, "unknown").when(F.col("n_neutral") / n >= 0.85, "neutral_dominant").when(F.col("release_ratio") >= 0.35, "release_overactive").when(F.col("exhaustion_ratio") >= 0.35, "exhaustion_overactive").when(F.col("most") / n <= 0.32, "fragmented").otherwise("balanced")
    x = x.withColumn("dominance", state)
    validity = F.when(n <= 0, "invalid").when(F.col("source") == "fallback", "fallback").when((n < 40) | F.col("dominance").isin("neutral_dominant", "release_overactive", "exhaustion_overactive"), "degraded").otherwise("computed")
    return x.withColumn("validity", validity).select("n", "source", "dominant_state", "release_ratio", "exhaustion_ratio", "compression_ratio", "dominance", "validity")


def calibration_layer(rfs: DataFrame) -> DataFrame:
    """Base mixes, logistic probabilities against fixed distributions, and the final one by regime and confidence."""
    inverse = 100 - F.col("rupture")
    x = rfs.select(
        "asset_id", "regime", "confidence",
        clamp_score(blend((0.2, F.col("occurrence")), (0.25, F.col("convergence")), (0.2, F.col("duration")), (0.2, F.col("frequency")), (0.15, F.col("correlation")))).alias("structure"),
        clamp_score(blend((0.4, F.col("convergence")), (0.3, F.col("duration")), (0.3, inverse))).alias("continuity"),
        clamp_score(blend((0.3, F.col("stability")), (0.2, F.col("mid_term")), (0.2, F.col("convergence")), (0.15, F.col("correlation")), (0.15, inverse))).alias("context"),
    )
    chance = lambda c, p90: clamp_score(100 / (F.exp(clamp((F.col(c) - 50) / (p90 - 50), -3, 3) * -4) + 1))
    x = x.withColumns({"p_structure": chance("structure", 85), "p_continuity": chance("continuity", 82), "p_context": chance("context", 85)})
    factor = F.when(F.col("regime") == "STABLE", 1.08).when(F.col("regime") == "TRANSITION", 0.96).otherwise(0.72)
    final = clamp_score(blend((0.45, F.col("p_structure")), (0.3, F.col("p_continuity")), (0.25, F.col("p_context"))) * factor * (F.col("confidence") / 100))
    return x.select("asset_id", "structure", "continuity", clamp_score(100 - F.col("continuity")).alias("rupture"), "context", "p_structure", "p_continuity", clamp_score(100 - F.col("p_continuity")).alias("p_rupture"), "p_context", final.alias("adjusted_final"))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def _percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, _whole(part / total * 100)).otherwise(0)


def opportunity_report(decided: DataFrame) -> DataFrame:
    """Quantiles of opportunity, thresholds at P40 and P75, count and mean by regime, warnings."""
    o = clamp_score(F.col("opportunity"))
    q = {f"p{int(p * 100)}": clamp_score(F.percentile(o, p)) for p in (0.25, 0.4, 0.5, 0.75, 0.9)}
    by = [c for r in REGIMES for c in (count_if(F.col("regime") == r).alias(f"n_{r.lower()}"), F.coalesce(_whole(mean_score(F.when(F.col("regime") == r, o))), F.lit(0)).alias(f"avg_{r.lower()}"))]
    g = decided.agg(F.count(F.lit(1)).alias("n"), clamp_score(F.min(o)).alias("least"), clamp_score(F.max(o)).alias("largest"), *[v.alias(k) for k, v in q.items()], *by)
    warnings = F.array_compact(F.array(F.when(F.col("n") < 20, F.lit("LOW_SAMPLE_SIZE")), F.when(F.col("p75") - F.col("p40") < 5, F.lit("LOW_SCORE_SPREAD"))))
    return g.withColumns({"medium_min": _whole(F.col("p40")), "high_min": _whole(F.col("p75")), "warnings": F.array_join(warnings, ",")})


def decision_report(decided: DataFrame) -> DataFrame:
    """Composite scores' quantiles, thresholds, and decisions in percent for all and by regime, with warnings.

    decided: decision, regime, stability, opportunity and the changes chg_24h_pct and chg_7d_pct.
    """
    day, week = F.coalesce(finite(F.col("chg_24h_pct")), F.lit(0.0)), F.coalesce(finite(F.col("chg_7d_pct")), F.lit(0.0))
    momentum = F.when((day > 0) & (week > 0), 100.0).when((day < 0) & (week < 0), 20.0).otherwise(60.0)
    regime = F.when(F.col("regime") == "STABLE", 100.0).when(F.col("regime") == "VOLATILE", 20.0).otherwise(60.0)
    x = decided.withColumn("score", F.floor(blend((0.4, clamp_score(F.col("stability"))), (0.3, clamp_score(F.col("opportunity"))), (0.2, regime), (0.1, momentum)) + 0.5).cast("double"))
    total = {"": F.count(F.lit(1)), **{f"{r.lower()}_": count_if(F.col("regime") == r) for r in REGIMES}}
    where = {"": F.lit(True), **{f"{r.lower()}_": F.col("regime") == r for r in REGIMES}}
    shares = [_percent(count_if(where[k] & (F.col("decision") == d)), total[k]).alias(f"{k}{d.lower()}_pct") for k in total for d in DECISIONS]
    g = x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("score"), F.lit(0.0)).alias("least"), F.coalesce(F.max("score"), F.lit(0.0)).alias("largest"), *[F.coalesce(F.percentile("score", p), F.lit(0.0)).alias(f"p{int(p * 100)}") for p in (0.25, 0.4, 0.5, 0.75, 0.9)], *shares)
    found = {"ALLOW too rare: possible over-filtering": F.col("allow_pct") < 2, "BLOCK too dominant: thresholds too strict": F.col("block_pct") > 80, "WATCH too rare: watch zone likely too narrow": F.col("watch_pct") < 20, "TRANSITION over-blocked: WATCH zone likely too narrow": F.col("transition_block_pct") > 70, "STABLE over-blocked: MCI may be too restrictive": F.col("stable_block_pct") > 60}
    return g.withColumns({"allow_min": _whole(F.col("p75")), "watch_min": _whole(F.col("p40")), "warnings": F.array_join(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in found.items()])), ",")})


def threshold_report(decided: DataFrame) -> DataFrame:
    """Value with index floor(p n) of stability and opportunity at four percentiles, shares of regimes and decisions, recommendations.

    Scores have two decimals: counts by value tell the percentiles, so that no task holds them all.
    """
    from pyspark.sql import Window

    long = decided.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), clamp_score(F.col(c)).alias("x")) for c in ("stability", "opportunity")])).alias("e")).select("e.k", "e.x")
    counts = long.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("k")
    ranked = counts.withColumns({"upto": F.sum("n").over(w.orderBy("x")), "total": F.sum("n").over(w)})
    at = lambda k, p: F.coalesce(F.max(F.when((F.col("k") == k) & (F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * p))) & (F.col("upto") - F.col("n") <= F.least(F.col("total") - 1, F.floor(F.col("total") * p))), F.col("x"))), F.lit(0.0))
    stats = ranked.agg(*[at(k, p).alias(f"{k}_p{int(p * 100)}") for k in ("stability", "opportunity") for p in (0.25, 0.5, 0.75, 0.9)])
    total = F.count(F.lit(1))
    shares = decided.agg(total.alias("n"), *[_percent(count_if(F.col("regime") == r), total).alias(f"{r.lower()}_pct") for r in REGIMES], *[_percent(count_if(F.col("decision") == d), total).alias(f"{d.lower()}_pct") for d in DECISIONS])
    advice = {f"{k}_{name}": _whole(F.col(f"{k}_{p}")) for k in ("stability", "opportunity") for name, p in (("high_min", "p75"), ("medium_min", "p50"))}
    return shares.join(F.broadcast(stats)).withColumns(advice)


def assets_summary(decided: DataFrame) -> DataFrame:
    """Means over all assets and the decision that they stand for. decided: continuity beside the funnel's columns."""
    means = {"stability": "stability", "opportunity": "opportunity", "confidence": "market_confidence", "convergence": "market_convergence", "rupture": "rupture", "continuity": "continuity"}
    g = decided.agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col("regime") == r).alias(f"n_{r.lower()}") for r in REGIMES], *[round2(mean_score(F.col(c))).alias(f"avg_{k}") for k, c in means.items()])
    a = lambda k: clamp(F.col(f"avg_{k}"), 0, 100)
    allow = (a("stability") >= 75) & (a("opportunity") >= 70) & (a("convergence") >= 65) & (a("confidence") >= 60) & (a("continuity") >= 60) & (a("rupture") < 40)
    return g.withColumn("decision", F.when((a("stability") < 40) | (a("rupture") >= 70), "BLOCK").when(allow, "ALLOW").otherwise("WATCH"))


def store_stats(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), *[count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in DECISIONS], *[count_if(F.col("regime") == r).alias(f"n_{r.lower()}") for r in REGIMES])


def zone_decision(zones: DataFrame) -> DataFrame:
    """Action, reasons and execution mode from a regime and the score of the best zone. zones: asset_id, regime, zone_score (null: none)."""
    s, regime = F.col("zone_score"), F.col("regime")
    rule = lambda action, codes, mode: F.struct(F.lit(action).alias("action"), F.lit(codes).alias("reason_codes"), F.lit(mode).alias("execution_mode"))
    found = (
        F.when(s.isNull(), rule("WATCH", "NO_ZONE", "none"))
        .when((regime == "VOLATILE") & (s >= 80), rule("WATCH", "REGIME_VOLATILE,ZONE_HIGH", "reduced"))
        .when(regime == "VOLATILE", rule("BLOCK", "REGIME_VOLATILE,ZONE_NOT_STRONG", "none"))
        .when((regime == "STABLE") & (s >= 80), rule("ALLOW", "REGIME_STABLE,ZONE_HIGH", "progressive"))
        .when((regime == "STABLE") & (s >= 60), rule("WATCH", "REGIME_STABLE,ZONE_MID", "confirmation"))
        .when(regime == "STABLE", rule("WATCH", "REGIME_STABLE,ZONE_LOW", "none"))
        .when(s >= 80, rule("ALLOW", "REGIME_TRANSITION,ZONE_HIGH", "confirmation"))
        .when(s >= 60, rule("WATCH", "REGIME_TRANSITION,ZONE_MID", "confirmation"))
        .otherwise(rule("WATCH", "REGIME_TRANSITION,ZONE_LOW", "reduced"))
    )
    return zones.withColumn("_d", found).select("asset_id", "regime", "zone_score", "_d.*")


def live_hints(live: DataFrame) -> DataFrame:
    """What live metrics hint for the axes of growth, convergence and evolution, and the pressure of small ruptures.

    live: asset_id, quality_score, noise_score, micro_volatility, price_velocity, micro_rupture (boolean), trend (UP, DOWN, FLAT).
    """
    quality, noise, wild, speed = (clamp_score(F.col(c)) for c in ("quality_score", "noise_score", "micro_volatility", "price_velocity"))
    velocity = F.abs("price_velocity")
    fast = lambda k: clamp_score(F.least(F.lit(100.0), velocity * k))
    direction = F.when(F.col("trend") == "FLAT", 35.0).when(velocity >= 0.2, 80.0).otherwise(55.0)
    torn = F.col("micro_rupture")
    return live.select(
        "asset_id", quality.alias("quality_score"), noise.alias("noise_score"), wild.alias("micro_volatility"), "price_velocity",
        clamp_score(blend((0.45, fast(18)), (0.35, quality), (0.2, 100 - noise))).alias("temporal_growth_hint"), clamp_score(blend((0.45, direction), (0.35, quality), (0.2, 100 - noise))).alias("temporal_convergence_hint"),
        clamp_score(blend((0.4, quality), (0.25, 100 - wild), (0.25, 100 - noise), (0.1, 100 - F.when(torn, 25.0).otherwise(0.0)))).alias("temporal_evolution_hint"),
        clamp_score(blend((0.4, F.when(torn, 85.0).otherwise(25.0)), (0.25, wild), (0.2, noise), (0.15, fast(20)))).alias("micro_rupture_pressure"),
    )


def pattern_class(x: DataFrame) -> DataFrame:
    """x with kind, pattern_similarity and off (percent between last price and mean), from up and down (longest streaks), ups, downs, mean, sd, first and last price."""
    change = F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.col("first") * 100)
    x = x.withColumns({"change": change, "off": F.when(F.col("mean") > 0, F.abs((F.col("last") - F.col("mean")) / F.col("mean") * 100)).otherwise(0.0)})
    kind = (
        F.when((F.col("up") >= 3) & (F.col("change") > 0), "UP_STREAK").when((F.col("down") >= 3) & (F.col("change") < 0), "DOWN_STREAK").when(F.col("sd") < F.col("mean") * 0.01, "COMPRESSION")
        .when((F.col("change") > 4) & (F.col("ups") > F.col("downs") * 1.5), "BREAKOUT").when((F.col("change") < -4) & (F.col("downs") > F.col("ups") * 1.5), "BREAKDOWN").when(F.col("off") < 1.5, "MEAN_REVERTING").when(F.col("sd") > F.col("mean") * 0.04, "CHAOTIC").otherwise("MIXED")
    )
    moves = F.col("ups") + F.col("downs")
    alike = blend((0.45, clamp(F.greatest("up", "down") * 12.0, 0, 100)), (0.25, 100 - clamp(F.col("sd") / F.col("mean") * 100, 0, 100)), (0.3, F.when(moves > 0, F.abs(F.col("ups") - F.col("downs")) / moves).otherwise(0.0) * 100))
    return x.withColumns({"kind": kind, "pattern_similarity": round2(clamp(alike, 0, 100))}).drop("change")


def pattern_verdict(x: DataFrame) -> DataFrame:
    """x with convergence, correction_probability, continuation_probability, opportunity and decision, from pattern_class, outcome rates and a history row's scores."""
    torn = F.col("rupture_probability") >= 60
    points = F.when(torn, 30).otherwise(0) + F.when(F.col("stability") >= 60, 20).when(F.col("stability") >= 45, 10).otherwise(0) + F.when(F.col("regime") == "STABLE", 20).when(F.col("regime") == "TRANSITION", 12).otherwise(0) + F.when(F.col("kind") != "CHAOTIC", 10).otherwise(0) + F.when(F.col("off") <= 4, 20).when(F.col("off") <= 8, 10).otherwise(0)
    x = x.withColumn("convergence", points.cast("double"))
    x = x.withColumns({"correction_probability": clamp_score(blend((0.45, F.col("correction_rate")), (0.3, F.col("convergence")), (0.15, F.col("rupture_probability")), (0.1, F.col("avg_similarity")))), "continuation_probability": clamp_score(blend((0.45, F.col("continuation_rate")), (0.35, F.col("continuity_probability")), (0.2, F.col("pattern_similarity"))))})
    x = x.withColumn("opportunity", clamp_score(blend((0.55, F.col("correction_probability")), (0.25, F.col("convergence")), (0.2, F.col("stability")))))
    decision = F.when(torn & (F.col("correction_probability") >= 60) & (F.col("convergence") >= 55) & (F.col("stability") >= 55), "ALLOW").when((torn & (F.col("correction_probability") >= 40)) | (F.col("opportunity") >= 45), "WATCH").otherwise("BLOCK")
    return x.withColumn("decision", decision)


PATTERN_DECISION = ("asset_id", "kind", "n", "pattern_similarity", "convergence", "correction_probability", "continuation_probability", "opportunity", "decision", "reason")


def pattern_decision(shapes: DataFrame, rates: DataFrame, history: DataFrame) -> DataFrame:
    """Decision by what usually followed the class that a series has now.

    shapes: asset_id, prices in order (p); rates: outcome_rates; history: rows with stability, regime, rupture_probability and
    continuity_probability. Under three prices the decision is BLOCK for insufficient_prices; without history, for
    insufficient_history.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    few, none = F.coalesce(F.size("p"), F.lit(0)) < 3, F.col("stability").isNull()
    x = shapes.withColumns({"mean": F.try_divide(total(F.col("p")), F.size("p")), "first": F.get("p", F.lit(0)), "last": F.element_at(F.when(~few, F.col("p")), -1), "d": F.when(~few, F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda v, i: F.signum(v - F.get("p", i))))})
    streak = lambda s: F.aggregate("d", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, v: F.struct(F.when(v == s, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["most"], F.when(v == s, a["now"] + 1).otherwise(0)).alias("most")), lambda a: a["most"])
    count = lambda s: F.size(F.filter("d", lambda v: v == s))
    x = x.withColumns({"sd": F.sqrt(total(F.transform("p", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.greatest(F.size("p"), F.lit(1))), "up": streak(1.0), "down": streak(-1.0), "ups": count(1.0), "downs": count(-1.0)})
    x = pattern_class(x).withColumn("kind", F.when(few, "MIXED").otherwise(F.col("kind")))
    x = x.join(history.select("asset_id", "stability", "regime", "rupture_probability", "continuity_probability"), "asset_id", "left").join(rates, ["asset_id", "kind"], "left").fillna(0, ["n", "correction_rate", "continuation_rate", "avg_similarity"])
    x = pattern_verdict(x).withColumn("reason", F.when(few, "insufficient_prices").when(none, "insufficient_history").otherwise("pattern"))
    scores = ("pattern_similarity", "convergence", "correction_probability", "continuation_probability", "opportunity")
    void = few | none
    return x.withColumns({**{c: F.when(void, 0.0).otherwise(F.col(c)) for c in scores}, "n": F.when(few, F.lit(0)).otherwise(F.col("n")), "decision": F.when(void, "BLOCK").otherwise(F.col("decision"))}).select(*PATTERN_DECISION)


def hmac_sha256(message: Column, secret: str) -> Column:
    """Lower-case hex HMAC of a string column under one key, whose two padded forms are made here."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def integrity_chain(records: DataFrame, key: str, order: Column, payload: Column, secret: str) -> DataFrame:
    """Per key, the hash of its last record, where each is hashed with the hash before it, and that hash's signature.

    A chain is sequential by its nature: the payloads of one key come together in order. Chains are independent of each other.
    """
    g = records.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), payload.alias("p")))).alias("chain"))
    last = F.aggregate("chain", F.lit(""), lambda a, x: F.sha2(F.concat(x["p"], a).cast("binary"), 256))
    return g.select(key, F.size("chain").cast("long").alias("n"), last.alias("hash")).withColumn("signature", hmac_sha256(F.col("hash"), secret))
