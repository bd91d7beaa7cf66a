"""Lists and lookups over assets and decisions: identity mapping, access, priorities, counts, market history, bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.kernel import count_if, finite, round2, slug
from tidepool.operators.series import moves

# Ranks of regimes and decisions.
REGIME_RANK = {"STABLE": 3, "TRANSITION": 2, "VOLATILE": 1}
DECISION_RANK = {"ALLOW": 3, "WATCH": 2, "BLOCK": 1}


def _rank(x: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for key, value in ranks.items():
        out = F.when(x == key, value).otherwise(out)
    return out


def mapped_identity(rows: DataFrame, provider: str, quote: str = "usd") -> DataFrame:
    """Provider rows (id, symbol, name) with one identity: by id, else by symbol, else by the name's slug; and two fingerprints.

    Rows without any of the three are left out.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    x = rows.withColumns({"provider_id": F.lower(text("id")), "canonical_symbol": F.upper(text("symbol")), "provider_name": text("name")})
    some = F.coalesce("provider_id", "canonical_symbol", "provider_name")
    own = F.coalesce("provider_id", F.lower("canonical_symbol"), F.nullif(slug(F.col("provider_name")), F.lit("")))
    by = F.when(F.col("provider_id").isNotNull(), "provider_id").when(F.col("canonical_symbol").isNotNull(), "symbol_fallback").otherwise("name_fallback")
    or_blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda *parts: F.concat_ws("|", F.lit(provider), *parts)
    market = F.when(F.coalesce("provider_id", "canonical_symbol").isNotNull(), joined(or_blank("provider_id"), or_blank("canonical_symbol"), F.lit(quote)))
    return x.where(some.isNotNull()).select(
        "provider_id", "canonical_symbol", F.coalesce("provider_name", "canonical_symbol").alias("canonical_name"), own.alias("canonical_id"), by.alias("identity_source"),
        joined(or_blank("provider_id"), or_blank("canonical_symbol"), F.lower(or_blank("provider_name"))).alias("identity_fingerprint"), market.alias("market_fingerprint"),
    )


def access_policy(assets: DataFrame) -> DataFrame:
    """What may be done with an asset, and the reason. assets: asset_id, symbol, name, decision, regime, stability, opportunity."""
    s, o, d = F.coalesce("stability", F.lit(0.0)), F.coalesce("opportunity", F.lit(0.0)), F.coalesce("decision", F.lit(""))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    x = assets.select(
        "asset_id", (filled("symbol") & filled("name")).alias("is_visible"), (s >= 50).alias("is_stable_enough"), (d.isin("ALLOW", "WATCH") | ((o >= 50) & (s >= 55))).alias("is_actionable"),
        ((d == "ALLOW") | ((F.coalesce("regime", F.lit("")) != "VOLATILE") & (s >= 60) & (o >= 55))).alias("can_trade"),
    )
    reason = F.when(~F.col("is_visible"), "hidden").when(F.col("can_trade"), "tradable").when(F.col("is_actionable"), "watch").when(F.col("is_stable_enough"), "stable_but_not_actionable").otherwise("unstable")
    return x.withColumn("reason", reason)


def by_priority(decided: DataFrame) -> list[Column]:
    """Order of evaluations: stability, regime, opportunity, decision, capitalisation, then id."""
    zero = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0)).desc()
    return [zero("stability"), _rank(F.col("regime"), REGIME_RANK).desc(), zero("opportunity"), _rank(F.col("decision"), DECISION_RANK).desc(), *([zero("market_cap")] if "market_cap" in decided.columns else []), F.col("asset_id").asc()]


def top_opportunities(decided: DataFrame, n: int = 3) -> DataFrame:
    """The n highest by decision, then opportunity, then stability, in one number; a rank counts against a row."""
    score = _rank(F.col("decision"), DECISION_RANK) * 1e5 + F.coalesce("opportunity", F.lit(0.0)) * 1e3 + F.coalesce("stability", F.lit(0.0)) * 100 - F.coalesce("rank", F.lit(0))
    return decided.withColumn("score", round2(score)).orderBy(F.desc("score"), "asset_id").limit(n)


def by_score(column: str, order: str = "desc", tie: str = "asset_id") -> list[Column]:
    """Nulls last whatever the order; ties by name."""
    c = F.col(column)
    return [c.desc_nulls_last() if order == "desc" else c.asc_nulls_last(), F.col(tie).asc()]


def availability(snapshot: DataFrame) -> DataFrame:
    known = lambda c: F.count(finite(F.col(c)))
    return snapshot.agg(F.count(F.lit(1)).alias("asset_count"), known("price").alias("priced_asset_count"), known("market_cap").alias("market_cap_available_count"), known("volume_24h").alias("volume_available_count"))


def summary_view(assets: DataFrame) -> DataFrame:
    """Stable assets and their share in whole percent."""
    g = assets.agg(F.count(F.lit(1)).alias("total"), count_if(F.upper("regime") == "STABLE").alias("stable"))
    return g.withColumn("confidence", F.when(F.col("total") > 0, F.floor(F.col("stable") / F.col("total") * 100 + 0.5)).otherwise(0).cast("long"))


def simple_distribution(distribution: DataFrame) -> DataFrame:
    """Shares in whole percent; shares of 1 or less are taken for fractions."""
    whole = lambda c: F.floor(F.when(F.col(c) <= 1, F.col(c) * 100).otherwise(F.col(c)) + 0.5).cast("long")
    return distribution.select("regime", *[whole(f"{d}_pct").alias(d.upper()) for d in ("allow", "watch", "block")])


def market_history(ticks: DataFrame) -> DataFrame:
    """Changes of the last step and of the whole, number of points, months they stand for, and which mode that allows."""
    g = moves(ticks).groupBy("asset_id").agg(F.count(F.lit(1)).alias("history_days"), F.min_by("price", "idx").alias("first"), F.max_by("price", "idx").alias("price_now"), F.max_by(F.coalesce("r", F.lit(0.0)), "idx").alias("step"))
    whole = F.when(F.col("first") == 0, 0.0).otherwise((F.col("price_now") - F.col("first")) / F.abs("first") * 100)
    return g.select("asset_id", "price_now", round2(F.col("step")).alias("chg_24h_pct"), round2(whole).alias("chg_7d_pct"), "history_days", F.floor(F.col("history_days") / 30).cast("long").alias("history_months"), F.when(F.col("history_days") < 365, "SHORT").otherwise("LONG_READY").alias("history_mode"))


def first_match(snapshot: DataFrame, symbol: str, order: str) -> DataFrame:
    """The first row, in the order of a column, whose symbol is the given one whatever the case."""
    return snapshot.where(F.upper("symbol") == symbol.upper()).orderBy(order).limit(1)


def bounded_log(records: DataFrame, most: int, order: str = "seq") -> DataFrame:
    """The newest ``most`` records: a top-k by tasks, then of their results."""
    return records.orderBy(F.desc(order)).limit(most)


def latest_per_id(log: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """The current state of an append-only log: the newest version of each key; versions that are marked as deleted end it."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1 and not deleted").drop("_k")
