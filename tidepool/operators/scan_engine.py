"""Scan engine on series without dates: their history on a calendar of its own, the impulse of the whole series, and its state by thresholds that all series set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.kernel import clamp
from tidepool.operators import calibration, history
from tidepool.operators.series import moves
from tidepool.sources.stage import staged

#: Day of the first price of a series without dates; the others follow day by day.
FIRST_DAY = "2026-01-01"


def dated(ticks: DataFrame) -> DataFrame:
    """asset_id, ts, price: positive prices in their order, one a day from FIRST_DAY on. ticks: asset_id, idx, price."""
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy("idx")) - 1
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), place).cast("timestamp_ntz")
    return ticks.where("price > 0").select("asset_id", day.alias("ts"), "price")


def whole_signature(prices: DataFrame) -> DataFrame:
    """Slope, amplitude (of the last price), instability and break rate of each series as a whole."""
    x = moves(prices, ("asset_id",), "ts")
    breaks = (F.col("r") * F.col("before") < 0) | (F.abs("r") >= 7)
    g = x.groupBy("asset_id").agg(F.count("r").alias("n_r"), F.min_by("price", "ts").alias("first"), F.max_by("price", "ts").alias("last"), F.min("price").alias("low"), F.max("price").alias("high"), F.stddev_pop("r").alias("sd"), F.sum(F.when(F.col("r").isNotNull() & F.col("before").isNotNull() & breaks, 1).otherwise(0)).alias("breaks"))
    return g.select(
        "asset_id", ((F.col("last") - F.col("first")) / F.col("first") * 100).alias("slope_pct"), ((F.col("high") - F.col("low")) / F.col("last") * 100).alias("amplitude_pct"),
        F.when(F.col("n_r") == 0, 0.0).otherwise(clamp(F.col("sd") * 12, 0, 100)).alias("instability"), F.when(F.col("n_r") < 2, 0.0).otherwise(F.try_divide(F.col("breaks"), F.col("n_r") - 1)).alias("break_rate"),
    )


SCORES = ("stability", "structure", "market", "coherence", "rupture_probability", "penalty", "continuity_probability", "confidence", "crash")
IMPULSE = ("impulse_pressure", "impulse_instability", "impulse_saturation", "impulse_exhaustion")


def scanned(ticks: DataFrame, facts: DataFrame) -> DataFrame:
    """Scores, regime and impulse of each asset, its state by the thresholds that all computed assets set, and warnings.

    ticks: asset_id, idx, price; facts: asset_id, chg_24h_pct, chg_7d_pct, where missing they count as 0. An asset with fewer
    than 8 positive prices is partial: TRANSITION and NEUTRAL, without scores.
    """
    prices = dated(ticks)
    own = ["slope_pct", "amplitude_pct", "instability", "break_rate"]
    h = history.history(prices).drop(*own).join(whole_signature(prices), "asset_id").join(facts.select("asset_id", "chg_24h_pct", "chg_7d_pct"), "asset_id", "left")
    change = {"r7": F.coalesce("chg_7d_pct", F.lit(0.0)), "r24": F.coalesce("chg_24h_pct", F.lit(0.0))}
    h = h.withColumns({f"{p}_{k}": v for p, c in change.items() for k, v in (("change_pct", c), ("slope_pct", c), ("stability", F.col("stability")), ("rupture", F.col("rupture_probability")))})
    x = staged(history.impulse_state(h).select("asset_id", "regime", "crash_state", *SCORES, *IMPULSE, "impulse_bias", F.col("impulse_state").alias("state")))
    impulses = x.select("asset_id", "state", *[F.col(c).alias(c.removeprefix("impulse_")) for c in IMPULSE])
    policy = calibration.impulse_policy(impulses)
    told = calibration.relabelled(impulses, policy).select("asset_id", "adaptive_state").crossJoin(F.broadcast(policy.select("warnings")))  # one row
    every = ticks.select("asset_id").distinct().join(x, "asset_id", "left").join(told, "asset_id", "left")
    few = F.col("stability").isNull()
    return every.select(
        "asset_id", F.when(few, "partial").otherwise("computed").alias("status"), F.coalesce("regime", F.lit("TRANSITION")).alias("regime"), "crash_state", *SCORES, *IMPULSE, F.coalesce("impulse_bias", F.lit("NEUTRAL")).alias("impulse_bias"), F.coalesce("adaptive_state", F.lit("NEUTRAL")).alias("impulse_state"),
        F.when(few, "scan_engine_insufficient_rfs_prices").otherwise(F.col("warnings")).alias("warnings"),
    )
