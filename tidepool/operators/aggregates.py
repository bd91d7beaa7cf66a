"""Market-level, memory, calibration and usage aggregates. Each is one grouping with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernel import clamp_score, count_if, mean_score, round2

ACTIONS = ("ALLOW", "WATCH", "BLOCK")
REGIMES = ("STABLE", "TRANSITION", "VOLATILE")


def market_summary(snapshot: DataFrame) -> DataFrame:
    """Mean price and changes, total capitalisation and volume, how many assets have each."""
    return snapshot.agg(F.count("*").alias("n_assets"), round2(F.avg("price")).alias("avg_price"), round2(F.avg("chg_24h_pct")).alias("avg_24h"), round2(F.avg("chg_7d_pct")).alias("avg_7d"), round2(F.sum("market_cap")).alias("total_market_cap"), round2(F.sum("volume_24h")).alias("total_volume"))


def market_state(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("price").alias("n_price"), F.count("chg_24h_pct").alias("n_24h"), F.count("chg_7d_pct").alias("n_7d"), round2(F.avg("chg_24h_pct")).alias("avg_24h"), round2(F.avg(F.abs("chg_24h_pct"))).alias("avg_abs_24h"), round2(F.avg("chg_7d_pct")).alias("avg_7d"), round2(F.avg(F.abs("chg_7d_pct"))).alias("avg_abs_7d"))


def market_context(rfs: DataFrame) -> DataFrame:
    """Regime shares, mean and median stability, their mix, risk and the market's regime."""
    share = lambda r: F.avg(F.when(F.col("regime") == r, 100.0).otherwise(0.0))
    g = rfs.agg(F.count("*").alias("n_assets"), *[round2(share(r)).alias(f"{r.lower()}_pct") for r in REGIMES], round2(F.avg("stability")).alias("avg_stability"), round2(F.median("stability")).alias("median_stability"))
    g = g.withColumn("global_score", clamp_score(F.col("avg_stability") * 0.6 + F.col("median_stability") * 0.4))
    risk = clamp_score(F.col("volatile_pct") * 0.42 + F.col("transition_pct") * 0.2 + (100 - F.col("global_score")) * 0.1)
    regime = F.when((F.col("volatile_pct") >= 45) | (F.col("global_score") < 35), "VOLATILE").when((F.col("stable_pct") >= 55) & (F.col("global_score") >= 60), "STABLE").otherwise("TRANSITION")
    return g.withColumn("risk", risk).withColumn("global_regime", regime)


def decision_summary(decided: DataFrame) -> DataFrame:
    """Counts by decision and regime, and the dominant ones (ties: STABLE, VOLATILE, TRANSITION; ALLOW, BLOCK, WATCH)."""
    g = decided.agg(F.count("*").alias("n"), *[count_if(F.col("decision") == a).alias(f"n_{a.lower()}") for a in ACTIONS], *[count_if(F.col("regime") == r).alias(f"n_{r.lower()}") for r in REGIMES])
    top_r = F.greatest("n_stable", "n_volatile", "n_transition")
    top_d = F.greatest("n_allow", "n_block", "n_watch")
    return g.withColumn("dominant_regime", F.when(F.col("n_stable") == top_r, "STABLE").when(F.col("n_volatile") == top_r, "VOLATILE").otherwise("TRANSITION")).withColumn("dominant_decision", F.when(top_d == 0, None).when(F.col("n_allow") == top_d, "ALLOW").when(F.col("n_block") == top_d, "BLOCK").otherwise("WATCH"))


def structure_summary(labelled: DataFrame) -> DataFrame:
    """How many assets are in each transition, and the market's climate."""
    share = lambda *names: F.avg(F.when(F.col("transition").isin(*names), 1.0).otherwise(0.0))
    g = labelled.agg(F.count("*").alias("n_assets"), round2(share("Fragmented") * 100).alias("fragmented_pct"), round2(share("Expansion", "Active Expansion") * 100).alias("expanding_pct"), round2(F.avg(F.when(F.col("activity") == "High", 100.0).otherwise(0.0))).alias("active_pct"), round2(share("Compression") * 100).alias("compressed_pct"))
    return g.withColumn("climate", F.when(F.col("fragmented_pct") >= 30, "Fragmented").when(F.col("expanding_pct") >= 35, "Expanding").when(F.col("active_pct") >= 35, "Active").when(F.col("compressed_pct") >= 45, "Compressed").otherwise("Transitioning"))


def memory_stats(records: DataFrame) -> DataFrame:
    """Open and resolved records, positive, negative and neutral results, win rate."""
    result = F.col("observed_result_pct")
    g = records.agg(F.count("*").alias("total"), count_if(F.col("status") == "open").alias("n_open"), count_if(F.col("status") == "resolved").alias("n_resolved"), count_if(result > 0).alias("positive"), count_if(result < 0).alias("negative"), count_if(result == 0).alias("neutral"), round2(F.avg("observed_result_pct")).alias("avg_result"), round2(F.avg(F.when(result > 0, result))).alias("avg_positive"), round2(F.avg(F.when(result < 0, result))).alias("avg_negative"))
    return g.withColumn("winrate", F.when(F.col("n_resolved") > 0, round2(F.col("positive") / F.col("n_resolved") * 100)))


def by_action(records: DataFrame) -> DataFrame:
    """Results by action over the fixed domain, zero-filled."""
    domain = records.sparkSession.createDataFrame([(a, i) for i, a in enumerate(ACTIONS)], "action string, place int")
    g = records.groupBy("action").agg(F.count("*").alias("total"), count_if(F.col("observed_result_pct") > 0).alias("positive"))
    return domain.join(g, "action", "left").select("action", "place", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("positive", F.lit(0)).alias("positive"))


def by_regime(records: DataFrame) -> DataFrame:
    g = records.groupBy("market_regime").agg(F.count("*").alias("total"), count_if(F.col("status") == "resolved").alias("n_resolved"), count_if(F.col("observed_result_pct") > 0).alias("positive"), round2(F.avg("observed_result_pct")).alias("avg_result"))
    return g


def decision_distribution(decided: DataFrame) -> DataFrame:
    """Percent of each decision, for all and by regime: grouping sets over one pass."""
    pct = lambda a: round2(F.avg(F.when(F.col("decision") == a, 100.0).otherwise(0.0)))
    return decided.rollup("regime").agg(F.count("*").alias("n"), *[pct(a).alias(f"{a.lower()}_pct") for a in ACTIONS], F.grouping("regime").alias("g")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("regime")).alias("regime"), "n", *[f"{a.lower()}_pct" for a in ACTIONS])


def reason_histogram(decided: DataFrame) -> DataFrame:
    return decided.groupBy("reason").agg(F.count("*").alias("n"))


def score_stats(decided: DataFrame, columns: tuple[str, ...] = ("stability", "rupture", "market_confidence")) -> DataFrame:
    """Least, largest, mean, median and quartiles of each score, one row each."""
    long = decided.unpivot([], list(columns), "metric", "x")
    return long.groupBy("metric").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("largest"), round2(F.avg("x")).alias("mean"), round2(F.percentile("x", 0.25)).alias("p25"), round2(F.median("x")).alias("median"), round2(F.percentile("x", 0.75)).alias("p75"))


def outcome_rates(occurrences: DataFrame) -> DataFrame:
    """Correction and continuation rates and mean similarity of the windows of each class in a series."""
    rate = lambda x: round2(F.avg(F.when(x, 100.0).otherwise(0.0)))
    return occurrences.groupBy("asset_id", "kind").agg(F.count(F.lit(1)).alias("n"), rate(~F.col("continued")).alias("correction_rate"), rate(F.col("continued")).alias("continuation_rate"), round2(mean_score(F.col("similarity"))).alias("avg_similarity"))


def backtest_summary(signals: DataFrame, steps: tuple[int, ...] = (24, 48, 72)) -> DataFrame:
    """Counts by decision and mean later returns of all signals, of ALLOW and BLOCK ones, and of those with opportunity 60 or more."""
    groups = {"": F.lit(True), "allow_": F.col("decision") == "ALLOW", "block_": F.col("decision") == "BLOCK", "high_opportunity_": F.col("opportunity") >= 60}
    means = [round2(mean_score(F.when(when, F.col(f"return_{k}")))).alias(f"{name}avg_return_{k}") for name, when in groups.items() for k in steps]
    counts = [count_if(F.col("decision") == d).alias(f"{d.lower()}_count") for d in ACTIONS]
    return signals.agg(F.count(F.lit(1)).alias("total_signals"), *counts, count_if(groups["high_opportunity_"]).alias("high_opportunity_count"), *means)


def usage_totals(events: DataFrame) -> DataFrame:
    """Calls per key, its last endpoint and plan."""
    when = F.struct("ts", "event_id")
    return events.groupBy("key").agg(F.count("*").alias("calls"), F.max_by("endpoint", when).alias("last_endpoint"), F.max_by("plan", when).alias("plan"))


def usage_by_endpoint(events: DataFrame) -> DataFrame:
    """Calls and keys by endpoint: all calls of a key go to the endpoint that it called last."""
    return usage_totals(events).groupBy(F.col("last_endpoint").alias("endpoint")).agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("keys"))
