"""Market structure of a series, and public labels of an asset: row functions. Inner terms are rounded one by one; weights aren't merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp, clamp_score, finite, round2
from tidepool.operators.series import profile

# Support that a confirmation gives to convergence and to correlation.
CONVERGENCE_SUPPORT = {"ALIGNED": 100, "NEUTRAL": 55, "UNAVAILABLE": 40, "OPPOSED": 15}
CORRELATION_SUPPORT = {"ALIGNED": 100, "NEUTRAL": 55, "UNAVAILABLE": 35, "OPPOSED": 10}


def _by(column: str, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for key, value in table.items():
        out = F.when(F.col(column) == key, float(value)).otherwise(out)
    return out


def rfs_market(ticks: DataFrame, facts: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Market structure of each series: axes, stability, structure, rupture, regime and status.

    facts: asset_id, chg_24h_pct, chg_7d_pct, market_cap, volume_24h; where there is none they are taken from the series
    (changes) or missing (liquidity). Series under ``least`` prices have too little data and confidence 15.
    """
    base = profile(ticks)
    if facts is None:
        base = base.withColumns({"chg_24h_pct": F.col("slope_pct"), "chg_7d_pct": F.col("slope_pct"), "market_cap": F.lit(None).cast("double"), "volume_24h": F.lit(None).cast("double")})
    else:
        base = base.join(facts, "asset_id", "left")
    n = F.coalesce("n_returns", F.lit(0))
    net = F.when(F.col("first_price") == 0, 0.0).otherwise((F.col("last_price") - F.col("first_price")) / F.abs("first_price") * 100)
    day = finite(F.col("chg_24h_pct"))
    ratio = lambda c: F.when(n > 0, F.col(c) / n).otherwise(1.0)
    a = base.select(
        "asset_id", "n_prices", n.alias("n"), net.alias("net"), day.alias("day"), finite(F.col("chg_7d_pct")).alias("week"), F.coalesce("direction_changes", F.lit(0)).alias("direction_changes"), F.coalesce("rupture_events", F.lit(0)).alias("rupture_events"),
        F.coalesce("stable_run_length", F.lit(0)).alias("stable_run_length"), F.coalesce("avg_abs_return", F.lit(0.0)).alias("avg_abs"), F.coalesce("volatility", F.lit(0.0)).alias("vol"),
        F.when(n > 0, F.greatest("ups", "downs") / n).otherwise(0.0).alias("dominant"), ratio("direction_changes").alias("turn_ratio"), ratio("rupture_events").alias("rupture_ratio"),
        F.when(F.col("market_cap").isNull() | F.col("volume_24h").isNull() | (F.col("market_cap") <= 0), 20.0).otherwise(clamp_score(F.least(F.lit(100.0), F.col("volume_24h") / F.col("market_cap") * 1000))).alias("liquidity"),
    )
    opposite = (F.signum("net") * F.signum("day")) < 0
    b = a.withColumn("alignment", F.when(F.col("day").isNull(), "UNAVAILABLE").when((F.col("day") == 0) | (F.col("net") == 0), "NEUTRAL").when(opposite, "OPPOSED").otherwise("ALIGNED"))
    b = b.withColumns({"bonus": F.when(F.col("alignment") == "ALIGNED", clamp_score(F.least(F.lit(12.0), F.abs("day") * 1.5))).otherwise(0.0), "penalty": F.when(F.col("alignment") == "OPPOSED", clamp_score(F.least(F.lit(18.0), F.abs("day") * 2))).otherwise(0.0)})
    run = F.when(F.col("n") > 0, clamp_score(F.col("stable_run_length") / F.col("n") * 100)).otherwise(0.0)
    presence = F.when(F.col("rupture_events") > 0, F.least(F.lit(100.0), (F.col("rupture_events") + 1) * 12.0)).otherwise(35.0)
    week_fit = F.when(F.col("week").isNotNull(), clamp_score(100 - F.least(F.lit(100.0), F.abs(F.col("week") - F.col("net")) * 8))).otherwise(35.0)
    same = F.when(F.col("week").isNull() | F.col("day").isNull(), 35.0).when((F.col("week") == 0) | (F.col("day") == 0), 55.0).when(F.signum("week") == F.signum("day"), 85.0).otherwise(20.0)
    c = b.withColumns({
        "duration": run,
        "occurrence": F.when(F.col("n") > 0, clamp_score(presence * 0.45 + run * 0.55)).otherwise(0.0),
        "convergence": clamp_score(blend((0.4, clamp_score(F.col("dominant") * 100)), (0.25, _by("alignment", CONVERGENCE_SUPPORT)), (0.2, clamp_score(F.least(F.lit(100.0), F.abs("net") * 8))), (0.15, 100 - clamp_score(F.col("turn_ratio") * 100)))),
        "frequency": clamp_score(100 - F.col("rupture_ratio") * 55 - F.col("turn_ratio") * 35 - F.col("avg_abs") * 6),
        "correlation": clamp_score(blend((0.3, _by("alignment", CORRELATION_SUPPORT)), (0.3, week_fit), (0.2, same), (0.2, F.col("liquidity")))),
    })
    axes = [F.col(x) for x in ("occurrence", "convergence", "duration", "frequency", "correlation")]
    d = c.withColumns({
        "structure": clamp_score(blend(*zip((0.18, 0.24, 0.2, 0.22, 0.16), axes, strict=True))),
        "rupture": clamp_score(F.col("rupture_ratio") * 55 + F.col("turn_ratio") * 20 + F.col("avg_abs") * 6 + F.col("vol") * 8 + F.col("penalty")),
        "stability": clamp_score(blend(*zip((0.18, 0.24, 0.22, 0.2, 0.16), axes, strict=True)) + F.col("bonus")),
        "mid_term": clamp_score(F.col("net") * 4 + 50),
    })
    short = F.col("n_prices") < least
    confidence = clamp_score(blend((0.25, F.col("stability")), (0.2, F.col("structure")), (0.15, F.col("correlation")), (0.15, F.col("duration")), (0.1, F.col("liquidity")), (0.15, 100 - F.col("rupture"))))
    regime = F.when((F.col("stability") >= 70) & (F.col("rupture") <= 30) & (F.col("frequency") >= 60) & (F.col("convergence") >= 60), "STABLE").when((F.col("stability") < 40) | (F.col("rupture") >= 65) | (F.col("frequency") < 35), "VOLATILE").otherwise("TRANSITION")
    return d.select(
        "asset_id", F.col("n_prices").alias("sample_size"), F.greatest(F.lit(1), F.when(F.col("rupture_events") > 0, F.col("rupture_events") + 1).otherwise(1)).cast("long").alias("pattern_count"), "direction_changes", "rupture_events", "stable_run_length",
        clamp_score(F.col("dominant") * 100).alias("dominant_direction_ratio"), "liquidity", "alignment", "occurrence", "convergence", "duration", "frequency", "correlation", "structure", "rupture", "stability", "mid_term",
        clamp_score(100 - F.col("rupture") + F.col("bonus")).alias("continuity"), F.when(short, 15.0).otherwise(confidence).alias("confidence"), regime.alias("regime"),
        F.when(short, "INSUFFICIENT_DATA").when((F.col("structure") < 40) | (F.col("stability") < 40), "WEAK_STRUCTURE").otherwise("VALID").alias("status"),
        F.when(F.col("week") >= 4, "FAVORABLE").when(F.col("week") <= -4, "UNFAVORABLE").otherwise("NEUTRAL").alias("mid_term_state"),
    )


def simple_decision(rfs: DataFrame) -> DataFrame:
    s = F.col("stability")
    return rfs.select("asset_id", F.when(s < 40, "BLOCK").when((s > 70) & (F.col("convergence") > 65) & (F.col("continuity") > 0.6), "ALLOW").otherwise("WATCH").alias("decision"))


# Weights of calm, capitalisation and volume by time frame.
STABILITY_WEIGHTS = {"24H": (0.6, 0.25, 0.15), "7D": (0.65, 0.22, 0.13), "30D": (0.55, 0.3, 0.15)}


def stability_index(snapshot: DataFrame, timeframe: str = "24H") -> DataFrame:
    """Index of 0 to 100 from the day's change, capitalisation and volume; regime by the change's size."""
    a, b, c = STABILITY_WEIGHTS[timeframe]
    log_norm = lambda x, lo, hi: F.when(x.isNull() | (x <= 0), 0.5).otherwise(clamp((F.log10(x) - lo) / (hi - lo), 0, 1))
    calm = clamp(1 - F.abs("chg_24h_pct") / 10, 0, 1)
    index = round2((calm * a + log_norm(F.col("market_cap"), 8, 12) * b + log_norm(F.col("volume_24h"), 7, 11) * c) * 100)
    size = F.abs("chg_24h_pct")
    return snapshot.where("chg_24h_pct is not null").select("id", index.alias("stability_index"), F.when(size <= 3, "STABLE").when(size <= 8, "TRANSITION").otherwise("VOLATILE").alias("regime"))


def public_structure(snapshot: DataFrame) -> DataFrame:
    """Public labels of an asset: activity, direction and structure transition."""
    if "low" not in snapshot.columns:
        snapshot = snapshot.withColumns({"low": F.array_min("sparkline_7d"), "high": F.array_max("sparkline_7d")})
    amplitude = F.when(F.col("price") > 0, round2((F.col("high") - F.col("low")) / F.col("price") * 100)).otherwise(0.0)
    activity = F.when(F.col("market_cap").isNull() | (F.col("market_cap") <= 0), "Unknown").when(F.col("volume_24h") / F.col("market_cap") >= 0.08, "High").when(F.col("volume_24h") / F.col("market_cap") >= 0.025, "Normal").otherwise("Low")
    x = snapshot.select("id", "symbol", "volume_24h", F.coalesce("chg_24h_pct", F.lit(0.0)).alias("d"), F.coalesce("chg_7d_pct", F.lit(0.0)).alias("w"), amplitude.alias("amplitude"), activity.alias("activity"))
    x = x.withColumn("direction", F.when(F.col("w") >= 1, "up").when(F.col("w") <= -1, "down").otherwise("flat"))
    d, w, amp = F.col("d"), F.col("w"), F.col("amplitude")
    transition = (
        F.when((F.abs(d) >= 7) | (F.abs(w) >= 18) | (amp >= 18), "Fragmented")
        .when((d > 0.4) & (w > 1.5) & (F.col("direction") == "up") & (F.col("activity") == "High"), "Active Expansion")
        .when((d > 0.2) & (w > 1) & (F.col("direction") == "up"), "Expansion")
        .when((d > 0.2) & (w < -1) & (F.col("direction") != "down"), "Recovery")
        .when((F.abs(d) <= 0.2) & (F.abs(w) <= 0.8) & (amp <= 1.5) & (F.col("direction") == "flat"), "Compression")
        .when((F.abs(d) <= 1.5) & (F.abs(w) <= 5) & (amp <= 8), "Stable")
        .otherwise("Neutral")
    )
    return x.withColumn("transition", transition).select("id", "symbol", "volume_24h", "amplitude", "activity", "direction", "transition")


def zones(snapshot: DataFrame) -> DataFrame:
    """Three price bands around each asset's price."""
    bands = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, lo, hi in (("below", 0.965, 0.98), ("near", 0.99, 1.01), ("above", 1.02, 1.04))])
    x = snapshot.where("price > 0").select("id", "symbol", "price", F.explode(bands).alias("b"))
    low, high = F.col("price") * F.col("b.lo"), F.col("price") * F.col("b.hi")
    return x.select("id", F.col("b.position").alias("position"), round2(low).alias("low"), round2(high).alias("high"), round2(F.abs((low + high) / 2 - F.col("price")) / F.col("price") * 100).alias("distance_pct"), round2((high - low) / F.col("price") * 100).alias("width_pct"))
