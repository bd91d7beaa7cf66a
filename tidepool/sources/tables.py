"""Readers with explicit schemas, and the domain relations derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions.kernel import pct_change, round2
from tidepool.plans.order import global_row_number

SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


#: Lines or events of which a task holds the series.
ROWS = 200_000


def spread(series: DataFrame, rows: DataFrame) -> DataFrame:
    """Series dealt by asset over as many tasks as there are ROWS of the table (a file, whose rows its footers count) that they come from, so that a task holds no more of a larger table. What follows by asset needs no further shuffle."""
    return series.repartition(max(1, -(-rows.count() // ROWS)), "asset_id")


def price_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, idx (from 0), ts, price: one series per user of events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "ts", F.col("value").alias("price"))


def price_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ts, price: mean unit price per supplier and shipping day."""
    line = table(spark, sf_dir, "lineitem")
    return spread(line.groupBy(F.col("l_suppkey").alias("asset_id"), F.col("l_shipdate").alias("ts")).agg(round2(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("price")), line)


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ts, price: mean of a supplier's daily prices to date, which calms down as days go by."""
    upto = Window.partitionBy("asset_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cents, n = F.sum(F.round(F.col("price") * 100).cast("long")).over(upto), F.count(F.lit(1)).over(upto)
    return price_hist(spark, sf_dir).withColumn("price", round2(cents / (n * 100)))


def market_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, idx, ts, price: price_index cut into years, an asset for each supplier and year: restless ones first, calm ones later."""
    year = F.year("ts")
    x = spread(price_index(spark, sf_dir).select((year.cast("long") * 1_000_000 + F.col("asset_id")).alias("asset_id"), "ts", "price"), table(spark, sf_dir, "lineitem"))
    return x.withColumn("idx", (F.row_number().over(Window.partitionBy("asset_id").orderBy("ts")) - 1).cast("long")).select("asset_id", "idx", "ts", "price")


def market_facts(spark: SparkSession, sf_dir: str, week: int = 7, ticks: DataFrame | None = None) -> DataFrame:
    """asset_id, chg_24h_pct, chg_7d_pct, market_cap, volume_24h of market_ticks' assets: changes of the last step and the last ``week`` steps, sales of the year and of its last day.

    Assets of suppliers divisible by 10 have none. ticks: market_ticks, where a query has them already.
    """
    sold = table(spark, sf_dir, "lineitem").groupBy((F.year("l_shipdate").cast("long") * 1_000_000 + F.col("l_suppkey")).alias("asset_id"), F.col("l_shipdate").alias("ts")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    sales = sold.groupBy("asset_id").agg((F.sum("cents") / 100.0).alias("market_cap"), (F.max_by("cents", "ts") / 100.0).alias("volume_24h"))
    newest = Window.partitionBy("asset_id").orderBy(F.desc("idx"))
    back = (market_ticks(spark, sf_dir) if ticks is None else ticks).withColumn("back", F.row_number().over(newest) - 1).where(F.col("back").isin(0, 1, week))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("price")))
    p = back.groupBy("asset_id").agg(at(0).alias("now"), at(1).alias("day"), at(week).alias("week"))
    x = p.select("asset_id", pct_change(F.col("day"), F.col("now")).alias("chg_24h_pct"), pct_change(F.col("week"), F.col("now")).alias("chg_7d_pct")).join(sales, "asset_id")
    return x.where(F.col("asset_id") % 10 != 0)


def asset_snapshot(spark: SparkSession, sf_dir: str, last: int = 5) -> DataFrame:
    """One row per part: price, changes, capitalisation, volume, number of prices, lowest and highest price.

    The newest ``last`` lines of a part come from a ranked window that is limited before the shuffle, all else from a grouping
    with partial results, so that a part with very many lines is no burden on one task.
    """
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "price", "volume")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("volume"))
    whole = line.groupBy("id").agg(F.count(F.lit(1)).alias("n_prices"), F.min_by("price", F.struct(*order)).alias("first"), round2(F.sum("volume")).alias("market_cap"), F.min("price").alias("low"), F.max("price").alias("high"))
    newest = line.withColumn("back", F.row_number().over(Window.partitionBy("id").orderBy(*[F.desc(c) for c in order]))).where(F.col("back") <= last)
    recent = newest.groupBy("id").agg(F.max(F.when(F.col("back") == 1, F.col("price"))).alias("price"), F.max(F.when(F.col("back") == 2, F.col("price"))).alias("before"), round2(F.sum("volume")).alias("volume_24h"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", F.upper("p_brand"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"))
    some = F.col("n_prices") > 1
    changes = {"chg_24h_pct": F.when(some, pct_change(F.col("before"), F.col("price"))), "chg_7d_pct": F.when(some, pct_change(F.col("first"), F.col("price")))}
    return part.join(whole, "id").join(recent, "id").withColumns(changes).drop("before", "first")


def ranked_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_snapshot with the rank by capitalisation."""
    return global_row_number(asset_snapshot(spark, sf_dir), "market_cap", "id", "rank")


def memory_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal memory records from orders."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("symbol"),
        F.when(status == "F", "ALLOW").when(status == "O", "WATCH").otherwise("BLOCK").alias("action"),
        F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), "VOLATILE").when(F.col("o_orderpriority").startswith("3"), "TRANSITION").otherwise("STABLE").alias("market_regime"),
        F.when(status == "F", "resolved").otherwise("open").alias("status"),
        F.when(status != "P", round2(F.col("o_totalprice") / 1000 - 100)).alias("observed_result_pct"),
    )


def usage_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API usage events from events."""
    plans = F.array(*[F.lit(p) for p in ("internal", "demo", "trader", "pro", "enterprise")])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("endpoint"), F.get(plans, (F.col("user_id") % 5).cast("int")).alias("plan"), "ts", "event_id")
