"""Numeric kernel: rounding, clamping and percentiles that every operator shares. All are Column functions.

Scores are rounded half up on the binary product (floor(x * 100 + 0.5) / 100), never by the engine's decimal round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The remainder by it is the number itself, or NaN for an infinite one. So one mention of x tells both, and expressions that
#: nest these functions don't grow with the power of their depth.
_HUGE = 1e300


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.nanvl(x.cast("double") % _HUGE, F.lit(None).cast("double"))


def _known(x: Column) -> Column:
    return F.nanvl(F.coalesce(x.cast("double") % _HUGE, F.lit(0.0)), F.lit(0.0))


def round2(x: Column) -> Column:
    """Two decimals, half towards positive infinity; null and non-finite become 0."""
    return F.floor(_known(x) * 100 + 0.5) / 100


def clamp_score(x: Column) -> Column:
    """0 to 100 with two decimals; null and non-finite become 0."""
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), _known(x))) * 100 + 0.5) / 100


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pct_change(before: Column, after: Column) -> Column:
    """Percent of |before|; 0 if before is 0."""
    return F.when(before == 0, 0.0).otherwise((after - before) / F.abs(before) * 100)


def count_if(x: Column) -> Column:
    return F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")


def mean_score(x: Column) -> Column:
    """Mean of values with two decimals, null for none. Sums are of whole hundredths, so that the order of rows can't tip a rounding."""
    return F.sum(F.round(x * 100).cast("long")) / (F.count(x) * 100)


def deviation_score(x: Column) -> Column:
    """Population deviation of values with two decimals, null for none; likewise from whole sums."""
    whole, n = F.round(x * 100).cast("long"), F.count(x)
    return F.sqrt((n * F.sum(whole * whole) - F.sum(whole) * F.sum(whole)).cast("double")) / (n * 100)


def percentile_of_counts(counts: DataFrame, at: dict[str, float]) -> DataFrame:
    """k, x, total: the value with index floor(at[k] * (n - 1)) of the n values of each k, from how often each occurs (k, x, n)."""
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("x"))
    total = F.sum("n").over(Window.partitionBy("k"))
    place = F.lit(0)
    for k, p in at.items():
        place = F.when(F.col("k") == k, F.floor((F.col("total") - 1) * p)).otherwise(place)
    ranked = counts.withColumns({"upto": upto, "total": total}).withColumn("place", place)
    return ranked.where("upto > place and upto - n <= place").select("k", "x", "total")


def blend(*terms: tuple[float, Column]) -> Column:
    """Sum of weight * term, added from left to right."""
    total = terms[0][1] * terms[0][0]
    for weight, x in terms[1:]:
        total = total + x * weight
    return total


def parse_bool(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "on")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_symbol(x: Column, most: int = 20) -> Column:
    return F.substring(F.regexp_replace(F.upper(x), r"[^A-Z0-9]", ""), 1, most)


def key_fingerprint(x: Column) -> Column:
    """Polynomial hash (factor 31, modulo 2**32) of the characters, in base 36."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    return F.lower(F.conv(total.cast("string"), 10, 36))
