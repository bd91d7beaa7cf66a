"""Streams: usage counters, live tick windows and stateful observation updates. Each works on streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.functions.kernel import round2
from tidepool.sources.tables import SCHEMAS


def event_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events arriving as Parquet files, with event time as a timestamp and a watermark."""
    return spark.readStream.schema(SCHEMAS["events"]).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


# Calls a minute and a day by plan.
QUOTAS = {"demo": (20, 100), "trader": (300, 5_000), "pro": (2_000, 50_000), "internal": (1_000_000_000, 1_000_000_000), "enterprise": (1_000_000_000, 1_000_000_000)}


def usage_windows(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Calls per key and tumbling window. events: key, plan, ts (timestamp)."""
    return events.groupBy(F.window("ts", width).alias("w"), "key", "plan").agg(F.count("*").alias("calls")).select("key", "plan", F.col("w.start").alias("window_start"), "calls")


def with_quota(windows: DataFrame, per: str = "minute") -> DataFrame:
    """Remaining calls and whether the quota is kept, by a lookup of the plan's limits."""
    k = 0 if per == "minute" else 1
    dim = windows.sparkSession.createDataFrame([(p, q[k]) for p, q in QUOTAS.items()], "plan string, quota long")
    return windows.join(F.broadcast(dim), "plan", "left").withColumn("remaining", F.greatest(F.lit(0), F.col("quota") - F.col("calls"))).withColumn("allowed", F.col("calls") <= F.col("quota"))


def live_windows(ticks: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean, median, range and density of prices per asset and window. ticks: asset_id, ts (timestamp), price, and idx for a series that is numbered.

    Prices are added in their order in time, as a mean that falls between two hundredths is rounded by the last bit of its sum.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ts", *[c for c in ("idx",) if c in ticks.columns], "price")))
    total = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + F.coalesce(x["price"], F.lit(0.0)))
    mean = F.when(F.count("price") > 0, total / F.count("price"))
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = ticks.groupBy(w.alias("w"), "asset_id").agg(F.count("*").alias("n"), round2(mean).alias("avg_price"), round2(F.percentile("price", 0.5)).alias("median_price"), F.min("price").alias("least"), F.max("price").alias("largest"))
    noise = F.when(F.col("avg_price") > 0, round2((F.col("largest") - F.col("least")) / F.col("avg_price") * 100)).otherwise(0.0)
    return g.withColumn("noise", noise).withColumn("rupture", F.col("noise") >= 75).select("asset_id", F.col("w.start").alias("window_start"), "n", "avg_price", "median_price", "noise", "rupture")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions per key: calls with less than ``gap`` between them."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("calls")).select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "calls")


def resolve_observations(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Records with the newest update of each id: open ones become resolved. updates: id, ts, observed_result_pct."""
    newest = updates.groupBy("id").agg(F.max_by("observed_result_pct", "ts").alias("new_result"))
    return records.join(newest, "id", "left").withColumn("status", F.when(F.col("new_result").isNotNull(), "resolved").otherwise(F.col("status"))).withColumn("observed_result_pct", F.coalesce("new_result", "observed_result_pct")).drop("new_result")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has arrived and stops; output as Parquet."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
