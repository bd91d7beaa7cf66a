"""Sources and sinks: provider payloads, snapshots and records as JSON, CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.kernel import finite

PROVIDER = "id string, symbol string, name string, image string, market_cap_rank int, current_price double, price_change_percentage_24h double, price_change_percentage_7d_in_currency double, market_cap double, total_volume double, sparkline_in_7d struct<price:array<double>>"
TICKER = "symbol string, lastPrice string, priceChangePercent string, quoteVolume string"


def provider_rows(spark: SparkSession, path: str) -> DataFrame:
    """Market rows of a provider, one JSON object a line, under an explicit schema."""
    return spark.read.schema(PROVIDER).json(path)


def from_provider(rows: DataFrame) -> DataFrame:
    """Public asset rows: trimmed identity, finite numbers, usable rows only."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = rows.select(
        F.lower(text("id")).alias("id"), F.upper(text("symbol")).alias("symbol"), text("name").alias("name"), finite(F.col("current_price")).alias("price"), finite(F.col("price_change_percentage_24h")).alias("chg_24h_pct"), finite(F.col("price_change_percentage_7d_in_currency")).alias("chg_7d_pct"),
        finite(F.col("market_cap")).alias("market_cap"), finite(F.col("total_volume")).alias("volume_24h"), F.filter("sparkline_in_7d.price", lambda x: x.isNotNull() & ~F.isnan(x)).alias("sparkline_7d"), F.when(F.col("market_cap_rank") > 0, F.col("market_cap_rank")).cast("long").alias("rank"),
        F.when(F.col("image").startswith("http://") | F.col("image").startswith("https://"), F.col("image")).alias("logo_url"),
    )
    return out.where("id is not null and symbol is not null and name is not null")


def from_tickers(rows: DataFrame, most: int = 100) -> DataFrame:
    """Ticker rows with parsed numbers and a stepwise stability score; the first ``most`` by quote volume."""
    size = F.abs(F.expr("try_cast(priceChangePercent as double)"))
    score = F.when(size < 0.5, 90).when(size < 1, 75).when(size < 2, 60).when(size < 4, 40).otherwise(20)
    out = rows.select("symbol", F.expr("try_cast(lastPrice as double)").alias("price"), F.expr("try_cast(priceChangePercent as double)").alias("chg_24h_pct"), F.expr("try_cast(quoteVolume as double)").alias("volume_24h"), score.alias("stability"))
    return out.orderBy(F.col("volume_24h").desc_nulls_last(), "symbol").limit(most)


def write_snapshot(snapshot: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    snapshot.write.format(form).mode(mode).save(path)


def read_snapshot(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).schema(schema).load(path)


def append_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """Append-only log of records, partitioned by a column if one is named."""
    writer = records.write.mode("append").format("parquet")
    (writer.partitionBy(by) if by else writer).save(path)
