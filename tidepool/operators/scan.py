"""Query surface over snapshots: search, sort, limit, pages, top lists, lookups and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sort keys and their aliases.
SORT_KEYS = {"rank": "rank", "price": "price", "market_cap": "market_cap", "marketcap": "market_cap", "volume_24h": "volume_24h", "volume": "volume_24h", "chg_24h_pct": "chg_24h_pct", "chg_24h": "chg_24h_pct", "chg_7d_pct": "chg_7d_pct", "chg_7d": "chg_7d_pct"}
MAX_LIMIT = 250
PLAN_LIMITS = {"demo": 10, "trader": 25, "pro": 100, "internal": 250, "enterprise": 250}


def search(snapshot: DataFrame, q: str | None) -> DataFrame:
    """Rows whose id, symbol or name contains q, whatever the case; all for a blank q."""
    needle = (q or "").strip().lower()
    if not needle:
        return snapshot
    hit = lambda c: F.lower(F.col(c).cast("string")).contains(needle)
    return snapshot.where(hit("id") | hit("symbol") | hit("name"))


def sort_order(key: str = "rank", order: str = "asc") -> list[Column]:
    """Sort columns: a missing number counts as -1, a missing rank as infinite; ties go by rank, capitalisation, volume, symbol."""
    column = SORT_KEYS.get(key.strip().lower(), "rank")
    first = F.coalesce(F.col(column).cast("double"), F.lit(float("inf") if column == "rank" else -1.0))
    return [first.desc() if order == "desc" else first.asc(), F.coalesce(F.col("rank").cast("double"), F.lit(float("inf"))).asc(), F.coalesce("market_cap", F.lit(-1.0)).desc(), F.coalesce("volume_24h", F.lit(-1.0)).desc(), F.col("symbol").asc()]


def scan(snapshot: DataFrame, q: str | None = None, sort: str = "rank", order: str = "asc", limit: int = MAX_LIMIT, cursor: int = 0, plan: str | None = None) -> DataFrame:
    """One page: a top-k with an offset, never a full sort of the result in one place."""
    most = min(max(1, limit), PLAN_LIMITS.get(plan or "internal", MAX_LIMIT))
    return search(snapshot, q).orderBy(*sort_order(sort, order)).offset(max(0, cursor)).limit(most)


def page_info(snapshot: DataFrame, q: str | None, limit: int, cursor: int) -> DataFrame:
    """total and next cursor of a page (null at the end)."""
    total = search(snapshot, q).agg(F.count("*").alias("total"))
    return total.select("total", F.when(F.col("total") > cursor + limit, F.lit(cursor + limit).cast("long")).alias("next_cursor"))


def top_by(snapshot: DataFrame, key: str, n: int = 5, order: str = "desc") -> DataFrame:
    return snapshot.orderBy(*sort_order(key, order)).limit(n)


def top_movers(snapshot: DataFrame, n: int = 8) -> DataFrame:
    return snapshot.where("chg_24h_pct is not null").orderBy(F.abs("chg_24h_pct").desc(), F.col("symbol")).limit(n)


# Transitions from the most to the least remarkable.
TRANSITION_ORDER = ("Active Expansion", "Expansion", "Recovery", "Fragmented", "Compression", "Stable", "Neutral")


def highlights(labelled: DataFrame, n: int = 3) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(t) for t in TRANSITION_ORDER]), F.col("transition"))
    return labelled.orderBy(place, F.col("volume_24h").desc(), "symbol").limit(n)


def newest_per_key(records: DataFrame, key: str, n: int) -> DataFrame:
    """The n newest records of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id"))
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def last_wins_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join with the last row of each key of right."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return left.join(right.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), key)


def collisions(df: DataFrame, fingerprint: Column) -> DataFrame:
    """Rows whose fingerprint others share, by counting and joining back."""
    own = df.withColumn("fingerprint", fingerprint)
    counts = own.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    return own.join(counts, "fingerprint")


def asset_issues(snapshot: DataFrame) -> DataFrame:
    """Reasons why a row is no valid public asset, in order; empty for valid ones."""
    reason = lambda bad, name: F.when(bad, F.lit(name))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    found = F.array_compact(F.array(*[reason(blank(c), f"{c}_missing") for c in ("id", "symbol", "name")], *[reason(odd(c), f"{c}_not_finite") for c in ("price", "chg_24h_pct", "chg_7d_pct", "market_cap", "volume_24h")]))
    return snapshot.select("id", found.alias("issues"))


def union_distinct(*groups: Column) -> Column:
    """Ordered union of arrays without repeats, nulls or blanks."""
    return F.array_distinct(F.filter(F.flatten(F.array(*groups)), lambda x: x.isNotNull() & (F.trim(x) != "")))


def preferred(records: DataFrame, key: str, *order: Column) -> DataFrame:
    """One record per key: the first in the given order."""
    return records.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def rejected_count(all_rows: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return all_rows.join(valid.select(key), key, "left_anti").agg(F.count("*").alias("rejected"))
