"""Flow regulator: how far the decisions of a window are from their target shares, which state that is, and what it does to the thresholds of the next window.

What a window decides depends on the thresholds that the window before it has set, and so on back to the first. But a window
leaves one of eight states only. So each window is worked out for the eight states that may come before it, all windows at
once, and becomes a map from the state before to its own. Maps compose: those of a block of windows make one map, the blocks'
maps are followed from the first block on, and within each block the windows from the state that it begins with. No decision
waits for the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp_score
from tidepool.operators.decisions import FALLBACK
from tidepool.sources.stage import staged

# Shares that decisions should have.
TARGET = {"allow": 0.1, "watch": 0.7, "block": 0.2}
# By state and opening level, what is added to the thresholds of allow, support and risk.
VALVES = (
    ("BALANCED_FLOW", 0, 0, 0, 0), ("STRUCTURE_TOO_WEAK", 0, 2, 1, 0), ("OVER_OPEN", 0, 4, 2, 1), ("RISK_UNDER_BLOCKED", 0, 1, 1, -3),
    ("HARD_DEFENSIVE_LOCK", 4, -8, -5, -1), ("MINIMUM_FLOW_LOCK", 3, -6, -3, -1), ("OPENING_BIAS", 2, -4, -2, 0), ("OPENING_BIAS", 1, -2, -1, 0),
)
# Weights of the mean scores in how near samples are to passing, and of the axes in structural quality.
NEARNESS = {"decision_score": 0.25, "support_probability": 0.2, "recovery_probability": 0.15, "stability": 0.15, "market_convergence": 0.15, "market_confidence": 0.1}
QUALITY = {"occurrence": 0.2, "frequency": 0.18, "convergence": 0.24, "correlation": 0.2, "duration": 0.18}
#: Windows of a block.
BLOCK = 512


def _ratio(x: Column) -> Column:
    """Four decimals, half towards positive infinity."""
    return F.floor(x * 10_000 + 0.5) / 10_000


def decision_at(allow: float, support: float, risk: float) -> Column:
    """ALLOW, WATCH or BLOCK of a funnel row under other thresholds."""
    calm = (F.col("regime") != "TRANSITION") | (F.col("rupture") < risk - 8)
    passed = F.col("temporal_gate") & (F.col("support_probability") >= support) & (F.col("market_confidence") >= 40) & calm & (F.col("regime") != "VOLATILE") & F.col("dominance_gate") & (F.col("decision_score") >= allow)
    return F.when(F.col("rupture") >= risk, "BLOCK").when(passed, "ALLOW").otherwise("WATCH")


def window_scores(rows: DataFrame) -> DataFrame:
    """window, n, structural_quality, score_proximity, and by number of the state before (from 0) the counts allow_k and block_k. rows: funnel rows with axes and window."""
    named = {k: (FALLBACK["allow"] + v[2], FALLBACK["support"] + v[3], FALLBACK["risk"] + v[4]) for k, v in enumerate(VALVES)}
    whole = lambda c: F.sum(F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100).cast("long"))  # noqa: E731  scores have two decimals
    sums = {c: whole(c).alias(f"s_{c}") for c in (*NEARNESS, *QUALITY, "rupture")}
    counts = [F.count_if(decision_at(*t) == d).alias(f"{d.lower()}_{k}") for k, t in named.items() for d in ("ALLOW", "BLOCK")]
    g = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), *sums.values(), *counts)
    mean = lambda c: clamp_score(F.col(f"s_{c}") / (F.col("n") * 100))
    near = clamp_score(clamp_score(blend(*[(w, mean(c)) for c, w in NEARNESS.items()])) - clamp_score(mean("rupture") * 0.25))
    return g.withColumns({"structural_quality": clamp_score(blend(*[(w, mean(c)) for c, w in QUALITY.items()])), "score_proximity": near}).drop(*[f"s_{c}" for c in sums])


def _state(allow: Column, watch: Column, block: Column) -> Column:
    """Number of the state of a window with these shares."""
    quality, near = F.col("structural_quality"), F.col("score_proximity")
    return (
        F.when(quality < 42, 1).when(allow >= 0.22, 2).when((block <= 0.08) & (allow >= 0.1), 3)
        .when((allow <= 0.01) & (watch >= 0.82) & (quality >= 62) & (near >= 58), 4).when((allow < 0.04) & (watch >= 0.75) & (near >= 48), 5)
        .when((allow <= 0.06) & (watch >= 0.72) & (near >= 48), 6).when((allow < 0.1) & (watch >= 0.65) & (near >= 48), 7).otherwise(0)
    )


def _follow(maps: Column, start: Column) -> Column:
    """States after each of the maps, from a state on."""
    return F.aggregate(maps, F.struct(start.alias("now"), F.array().cast("array<int>").alias("all")), lambda a, m: F.struct(F.get(m["map"], a["now"]).alias("now"), F.concat(a["all"], F.array(F.get(m["map"], a["now"]))).alias("all")), lambda a: a["all"])


def regulated(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each window's shares, gaps, scores and pressures under the thresholds that the window before has left, its state and level, and the valves that it sets for the next.

    rows: funnel rows with the axes of QUALITY, and window: their window's number from 0, without gaps. The first window has
    the fixed thresholds. Empty tables give no rows.
    """
    x = window_scores(rows)
    share = lambda d, k: _ratio(F.col(f"{d}_{k}") / F.col("n"))
    watch = lambda k: _ratio((F.col("n") - F.col(f"allow_{k}") - F.col(f"block_{k}")) / F.col("n"))
    every = range(len(VALVES))
    x = staged(x.withColumns({"map": F.array(*[_state(share("allow", k), watch(k), share("block", k)) for k in every]), "shares": F.array(*[F.struct(share("allow", k).alias("allow"), watch(k).alias("watch"), share("block", k).alias("block")) for k in every]), "block": F.floor(F.col("window") / block)}))
    inner = x.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("window", "map"))).alias("maps"))
    ends = inner.withColumn("map", F.array(*[F.element_at(_follow(F.col("maps"), F.lit(k)), -1) for k in every]))
    # one row a block of windows: their maps are followed in order
    whole = ends.groupBy().agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("maps"))
    starts = whole.select(F.explode(F.arrays_zip(F.transform("maps", lambda m: m["block"]).alias("block"), F.concat(F.array(F.lit(0)), _follow(F.col("maps"), F.lit(0))).alias("start"))).alias("z")).select("z.block", "z.start").where("block is not null")
    within = inner.join(starts, "block").select("block", F.explode(F.arrays_zip(F.transform("maps", lambda m: m["window"]).alias("window"), F.concat(F.array("start"), F.slice(_follow(F.col("maps"), F.col("start")), F.lit(1), F.size("maps") - 1)).alias("before"))).alias("z")).select("z.window", "z.before")
    y = x.drop("block").join(within, "window").withColumns({"state": F.get("map", F.col("before")), "s": F.get("shares", F.col("before"))}).select("*", "s.allow", "s.watch", "s.block")
    gap = {d: _ratio(F.col(d) - t) for d, t in TARGET.items()}
    y = y.withColumns({f"{d}_gap": g for d, g in gap.items()}).withColumn("minimum_flow_gap", _ratio(F.col("allow") - 0.04))
    up, quality, near = lambda v: F.greatest(F.lit(0.0), v), F.col("structural_quality"), F.col("score_proximity")
    y = y.withColumns({
        "flow_imbalance": clamp_score((F.abs("allow_gap") + F.abs("watch_gap") + F.abs("block_gap")) * 100),
        "opening_pressure": clamp_score(up(-F.col("allow_gap")) * 100 * 0.35 + up(F.col("watch_gap")) * 100 * 0.25 + quality * 0.25 + near * 0.15),
        "closing_pressure": clamp_score(up(F.col("allow_gap")) * 100 * 0.35 + up(-F.col("block_gap")) * 100 * 0.25 + (100 - quality) * 0.2 + up(48 - near) * 0.2),
    })
    of = lambda at: F.get(F.array(*[F.lit(v[at]) for v in VALVES]), F.col("state"))
    return y.select(
        "window", "n", "allow", "watch", "block", "allow_gap", "watch_gap", "block_gap", "minimum_flow_gap", "flow_imbalance", "structural_quality", "score_proximity", "opening_pressure", "closing_pressure", clamp_score(50 + F.col("opening_pressure") - F.col("closing_pressure")).alias("net_pressure"),
        of(0).alias("pressure_state"), of(1).alias("opening_level"), of(2).alias("allow_valve"), of(3).alias("support_valve"), of(4).alias("risk_valve"),
    )
