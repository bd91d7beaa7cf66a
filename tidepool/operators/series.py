"""Series operators: everything that reads a price series in order. Long form: asset_id, idx, price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp, clamp_score, round2

def by_asset() -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy("idx")


def moves(points: DataFrame, keys: tuple[str, ...] = ("asset_id",), order: str = "idx") -> DataFrame:
    """points with r (percent return; none from a price of 0), before (the return before it) and k (its number, from 1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag("price").over(w)
    x = points.withColumn("r", F.when(prev.isNotNull() & (prev != 0), (F.col("price") - prev) / F.abs(prev) * 100))
    return x.withColumns({"before": F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "k": F.count("r").over(w)})


def returns(ticks: DataFrame) -> DataFrame:
    """Percent returns; a pair whose first price is 0 has none."""
    return moves(ticks).where("r is not null").select("asset_id", "idx", "price", "r")


def profile(ticks: DataFrame, rupture: float = 2.5, calm: float = 1.4) -> DataFrame:
    """Shape and return statistics of each series: one window and two groupings on its key.

    Of returns: their number, direction changes, ruptures, longest calm run, ups and downs, mean size, deviation.
    """
    loud = F.sum(F.when(F.col("r").isNull() | (F.abs("r") < calm), 0).otherwise(1)).over(by_asset())
    marked = moves(ticks).withColumn("island", loud)
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    runs = marked.groupBy("asset_id", "island").agg(
        one(F.abs("r") < calm).alias("run"), F.count("r").alias("n"), one(F.col("r") * F.col("before") < 0).alias("turns"), one(F.abs("r") >= rupture).alias("ruptures"), one(F.col("r") > 0).alias("ups"), one(F.col("r") < 0).alias("downs"), F.sum(F.abs("r")).alias("abs_r"), F.sum("r").alias("sum_r"), F.sum(F.col("r") * F.col("r")).alias("sum_rr"),
        F.count(F.lit(1)).alias("n_prices"), F.min_by("price", "idx").alias("first_price"), F.min("idx").alias("first_idx"), F.max_by("price", "idx").alias("last_price"), F.max("idx").alias("last_idx"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )
    n = F.sum("n")
    g = runs.groupBy("asset_id").agg(
        F.sum("n_prices").alias("n_prices"), F.min_by("first_price", "first_idx").alias("first_price"), F.max_by("last_price", "last_idx").alias("last_price"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        n.alias("n_returns"), F.sum("turns").alias("direction_changes"), F.sum("ruptures").alias("rupture_events"), F.max("run").alias("stable_run_length"), F.sum("ups").alias("ups"), F.sum("downs").alias("downs"),
        round2(F.sum("abs_r") / n).alias("avg_abs_return"), round2(F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(F.sum("sum_rr") / n - (F.sum("sum_r") / n) * (F.sum("sum_r") / n), F.lit(0.0))))).alias("volatility"),
        (F.sum("sum_r") / n).alias("mean_return"), F.sqrt(F.greatest(F.sum("sum_rr") / n - (F.sum("sum_r") / n) * (F.sum("sum_r") / n), F.lit(0.0))).alias("sd_return"),
    )
    return g.withColumns({"slope_pct": round2(slope("first_price", "last_price")), "amplitude_pct": round2(amplitude("min_price", "max_price"))})


def slope(first: str, last: str) -> Column:
    return F.when(F.col(first) == 0, 0.0).otherwise((F.col(last) - F.col(first)) / F.abs(first) * 100)


def amplitude(low: str, high: str) -> Column:
    return F.when(F.col(low) <= 0, 0.0).otherwise((F.col(high) - F.col(low)) / F.col(low) * 100)


STATS = ("n_returns", "direction_changes", "rupture_events", "stable_run_length", "ups", "downs", "avg_abs_return", "volatility")
SHAPE = ("n_prices", "first_price", "last_price", "min_price", "max_price", "slope_pct", "amplitude_pct")


def return_stats(ticks: DataFrame) -> DataFrame:
    return profile(ticks).where("n_returns > 0").select("asset_id", *STATS)


def shape(ticks: DataFrame) -> DataFrame:
    """First, last, least and largest price, slope and amplitude in percent."""
    return profile(ticks).select("asset_id", *SHAPE)


def streaks(ticks: DataFrame) -> DataFrame:
    """Up and down moves and their longest streaks; a flat move ends both."""
    step = ticks.withColumn("d", F.signum(F.col("price") - F.lag("price").over(by_asset()))).where("d is not null")
    new = step.withColumn("start", F.when(F.col("d") == F.lag("d").over(by_asset()), 0).otherwise(1)).withColumn("island", F.sum("start").over(by_asset()))
    runs = new.groupBy("asset_id", "island", "d").count()
    one = lambda s: F.when(F.col("d") == s, F.col("count")).otherwise(0)
    return runs.groupBy("asset_id").agg(F.sum(one(1)).alias("up_moves"), F.sum(one(-1)).alias("down_moves"), F.max(one(1)).alias("up_streak"), F.max(one(-1)).alias("down_streak"))


def signatures(points: DataFrame, keys: tuple[str, ...] = ("asset_id",), order: str = "idx", jump: float = 4.0) -> DataFrame:
    """Of each series (keys): size, slope, amplitude, instability, break rate, reversal, kind, quality and bias.

    The break rate is the share of returns after the first that flip sign or jump by ``jump`` points; a reversal is a change of
    sign between the mean returns of the halves (4 returns or more; the first half has floor(n / 2)).
    """
    own = Window.partitionBy(*keys)
    x = moves(points, keys, order).withColumn("n_r", F.count("r").over(own))
    half = F.col("k") <= F.floor(F.col("n_r") / 2)
    broken = (F.col("r") * F.col("before") < 0) | (F.abs(F.col("r") - F.col("before")) >= jump)
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_prices"), F.max("n_r").alias("n_r"), F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min(order).alias("begin"), F.max(order).alias("end"), F.stddev_pop("r").alias("sd"),
        F.avg(F.when(F.col("r").isNotNull() & F.col("before").isNotNull(), F.when(broken, 1.0).otherwise(0.0))).alias("broken"), F.avg(F.when(half & F.col("r").isNotNull(), F.col("r"))).alias("first_mean"), F.avg(F.when(~half & F.col("r").isNotNull(), F.col("r"))).alias("second_mean"),
    )
    return judged(g)


def judged(g: DataFrame) -> DataFrame:
    """The rest of a signature from what is summed of a series: n_prices, n_r, first, last, least and largest price, sd and broken (share), means of the halves."""
    g = g.withColumns({"slope_pct": round2(slope("first_price", "last_price")), "amplitude_pct": round2(amplitude("min_price", "max_price")), "break_rate": round2(F.col("broken")), "reversal": F.coalesce((F.col("n_r") >= 4) & (F.signum("first_mean") * F.signum("second_mean") < 0), F.lit(False))})
    unstable = F.when(F.col("n_r") == 0, 0.0).otherwise(clamp(F.col("sd") / 12 * 100, 0, 100) * 0.7 + clamp(F.col("amplitude_pct") / 40 * 100, 0, 100) * 0.3)
    g = g.withColumn("instability", round2(unstable))
    quality = blend((0.26, clamp(F.abs("slope_pct") * 8, 0, 100)), (0.32, 100 - clamp(F.col("break_rate") * 100, 0, 100)), (0.28, 100 - clamp(F.col("instability"), 0, 100)), (0.14, 100 - clamp(F.col("amplitude_pct") / 45 * 100, 0, 100)))
    return g.withColumns({
        "kind": pattern_kind(F.col("n_prices"), F.col("reversal"), F.col("amplitude_pct"), F.col("slope_pct"), F.col("instability"), F.col("break_rate")),
        "quality": F.when(F.col("n_prices") < 3, 0.0).otherwise(clamp_score(quality)), "bias": clamp_score(F.abs("slope_pct") * 2 - F.col("break_rate") * 40),
    }).drop("broken", "sd")


def break_rate(ticks: DataFrame) -> DataFrame:
    return signatures(ticks).where("n_r > 1").select("asset_id", "break_rate")


def reversal(ticks: DataFrame) -> DataFrame:
    return signatures(ticks).where("n_r > 0").select("asset_id", round2(F.col("first_mean")).alias("first_mean"), round2(F.col("second_mean")).alias("second_mean"), "reversal")


def pattern_kind(n: Column, is_reversal: Column, amplitude: Column, slope: Column, unstable: Column, breaks: Column) -> Column:
    return (
        F.when(n < 3, "RANGE")
        .when(is_reversal & (amplitude >= 4), "REVERSAL")
        .when((amplitude <= 6) & (F.abs(slope) <= 2) & (unstable <= 35), "COMPRESSION")
        .when((F.abs(slope) <= 3) & (amplitude <= 12) & (breaks <= 0.45), "RANGE")
        .when(slope >= 3, "UPTREND")
        .when(slope <= -3, "DOWNTREND")
        .otherwise("RANGE")
    )


# Classes of the older eight-class scheme for each kind, and back.
LEGACY_OF_KIND = {"UPTREND": "UP_STREAK", "DOWNTREND": "DOWN_STREAK", "COMPRESSION": "COMPRESSION", "REVERSAL": "MEAN_REVERTING", "RANGE": "MIXED"}
KIND_OF_LEGACY = {"UP_STREAK": "UPTREND", "BREAKOUT": "UPTREND", "DOWN_STREAK": "DOWNTREND", "BREAKDOWN": "DOWNTREND", "COMPRESSION": "COMPRESSION", "MEAN_REVERTING": "REVERSAL"}


def recode(x: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(x == key, value).otherwise(out)
    return out


def kind_similarity(a: Column, b: Column) -> Column:
    both = lambda *of: a.isin(*of) & b.isin(*of)
    return F.when(a == b, 100.0).when(both("UPTREND", "DOWNTREND"), 60.0).when(both("RANGE", "COMPRESSION"), 78.0).when(both("REVERSAL", "RANGE"), 42.0).when(both("REVERSAL", "COMPRESSION"), 38.0).otherwise(25.0)


def pattern(ticks: DataFrame) -> DataFrame:
    """Metrics, class, quality and directional bias of each series."""
    x = signatures(ticks)
    return x.select("asset_id", "n_prices", "slope_pct", "amplitude_pct", "break_rate", "reversal", "instability", "kind", "quality", "bias", recode(F.col("kind"), LEGACY_OF_KIND, "MIXED").alias("legacy_kind"))


def lead_returns(ticks: DataFrame, steps: tuple[int, ...] = (24, 48, 72)) -> DataFrame:
    """Percent return to the price so many places ahead; null past the end or from 0."""
    ahead = {f"return_{k}": F.lead("price", k).over(by_asset()) for k in steps}
    return ticks.withColumns({name: F.when(x.isNotNull() & (F.col("price") != 0), round2((x - F.col("price")) / F.col("price") * 100)) for name, x in ahead.items()})


OUTCOME_KINDS = ("UP_STREAK", "DOWN_STREAK", "COMPRESSION", "BREAKOUT", "BREAKDOWN", "MEAN_REVERTING", "CHAOTIC", "MIXED")


def outcome_kind(rises: Column, falls: Column, mean: Column, sd: Column, change: Column, off: Column, ups: Column, downs: Column) -> Column:
    """Class of a window of prices: whether it has three moves up or down in a row, its prices' mean and deviation, change and distance of the last price from the mean in percent, moves."""
    return (
        F.when(rises & (change > 0), "UP_STREAK")
        .when(falls & (change < 0), "DOWN_STREAK")
        .when(sd < mean * 0.01, "COMPRESSION")
        .when((change > 4) & (ups > downs * 1.5), "BREAKOUT")
        .when((change < -4) & (downs > ups * 1.5), "BREAKDOWN")
        .when(off < 1.5, "MEAN_REVERTING")
        .when(sd > mean * 0.04, "CHAOTIC")
        .otherwise("MIXED")
    )


def ended_windows(points: DataFrame, w: WindowSpec, least: int = 3, most: int = 6) -> DataFrame:
    """points with w<size>: kind and similarity of the window of that size that ends at each (null where the series, w, has fewer places up to it).

    For those who need a point's windows side by side; occurrences has them as rows.
    """
    added = [f"w{k}" for k in range(least, most + 1)]
    x = points.withColumns({"_at": F.row_number().over(w), **{f"_p{k}": F.lag("price", k).over(w) if k else F.col("price") for k in range(most)}})
    x = x.withColumns({f"_d{k}": F.signum(F.col(f"_p{k}") - F.col(f"_p{k + 1}")) for k in range(most - 1)})
    of = lambda size: [F.col(f"_p{k}") for k in reversed(range(size))]
    x = x.withColumns({f"_mean{n}": sum(of(n)[1:], of(n)[0]) / n for n in range(least, most + 1)})
    x = x.withColumns({f"_sq{n}_{k}": (F.col(f"_p{k}") - F.col(f"_mean{n}")) * (F.col(f"_p{k}") - F.col(f"_mean{n}")) for n in range(least, most + 1) for k in range(n)})
    change = lambda n: (F.col("_p0") - F.col(f"_p{n - 1}")) / F.col(f"_p{n - 1}") * 100
    x = x.withColumns({
        **{f"_sd{n}": F.sqrt(sum([F.col(f"_sq{n}_{k}") for k in reversed(range(n - 1))], F.col(f"_sq{n}_{n - 1}")) / n) for n in range(least, most + 1)}, **{f"_change{n}": change(n) for n in range(least, most + 1)},
        **{f"_off{n}": F.abs((F.col("_p0") - F.col(f"_mean{n}")) / F.col(f"_mean{n}") * 100) for n in range(least, most + 1)}, **{f"_{name}{n}": sum([F.when(F.col(f"_d{k}") == s, 1).otherwise(0) for k in range(n - 1)], F.lit(0)) for name, s in (("ups", 1.0), ("downs", -1.0)) for n in range(least, most + 1)},
    })

    def kind(n: int) -> Column:
        streak = lambda s: F.coalesce(F.greatest(F.lit(False), *[(F.col(f"_d{k}") == s) & (F.col(f"_d{k + 1}") == s) & (F.col(f"_d{k + 2}") == s) for k in range(n - 3)]) if n > 3 else F.lit(False), F.lit(False))
        mean, sd, moved, off, ups, downs = (F.col(f"_{c}{n}") for c in ("mean", "sd", "change", "off", "ups", "downs"))
        return outcome_kind(streak(1.0), streak(-1.0), mean, sd, moved, off, ups, downs)

    found = {f"w{n}": F.when(F.col("_at") >= n, F.struct(kind(n).alias("kind"), round2(clamp(100 - F.col(f"_off{n}") * 8, 0, 100)).alias("similarity"))) for n in range(least, most + 1)}
    return x.withColumns(found).select(*points.columns, *added)


def occurrences(ticks: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """Windows of ``least`` to ``most`` positive prices that a further price follows, in series of five prices or more.

    Each has its class, how near its last price is to its mean, and whether the next price is at least the last one. One window
    takes the ``most`` newest prices and the next one of each row. The sizes are exploded from it first, so that one expression
    (prices beyond a window's size are null) classes all sizes: code for each size apart is too long for the JVM to compile.
    """
    w = by_asset()
    own = ticks.where("price > 0").select("asset_id", "idx", "price")
    x = own.withColumns({"place": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("asset_id")), "after": F.lead("price").over(w), **{f"l{k}": F.lag("price", k).over(w) for k in range(1, most)}})
    x = x.where("n >= 5 and after is not null").select("*", F.explode(F.array(*[F.lit(k) for k in range(least, most + 1)])).alias("size")).where("size <= place + 1")
    x = x.select("asset_id", "place", "size", "after", F.col("price").alias("p0"), *[F.col(f"l{k}").alias(f"p{k}") if k < least else F.when(F.col("size") > k, F.col(f"l{k}")).alias(f"p{k}") for k in range(1, most)])
    p = [F.col(f"p{k}") for k in range(most)]
    total = lambda of: sum([F.coalesce(v, F.lit(0.0)) for v in reversed(of[:-1])], F.coalesce(of[-1], F.lit(0.0)))
    x = x.withColumns({"mean": total(p) / F.col("size"), "first": F.coalesce(*reversed(p)), **{f"d{k}": F.signum(p[k] - p[k + 1]) for k in range(most - 1)}})
    count = lambda s: sum([F.when(F.col(f"d{k}") == s, 1).otherwise(0) for k in range(most - 1)], F.lit(0))
    x = x.withColumns({"sd": F.sqrt(total([(v - F.col("mean")) * (v - F.col("mean")) for v in p]) / F.col("size")), "change": (F.col("p0") - F.col("first")) / F.col("first") * 100, "off": F.abs((F.col("p0") - F.col("mean")) / F.col("mean") * 100), "ups": count(1.0), "downs": count(-1.0)})
    streak = lambda s: F.greatest(F.lit(False), F.lit(False), *[(F.col(f"d{k}") == s) & (F.col(f"d{k + 1}") == s) & (F.col(f"d{k + 2}") == s) for k in range(most - 3)])
    kind = outcome_kind(streak(1.0), streak(-1.0), *[F.col(c) for c in ("mean", "sd", "change", "off", "ups", "downs")])
    return x.select("asset_id", (F.col("place") - F.col("size") + 1).cast("long").alias("start"), "size", kind.alias("kind"), round2(clamp(100 - F.col("off") * 8, 0, 100)).alias("similarity"), (F.col("after") >= F.col("p0")).alias("continued"))


def month_segments(hist: DataFrame, least: int = 4) -> DataFrame:
    """Signatures of the calendar months of a dated series (asset_id, ts, price) with ``least`` points or more."""
    x = hist.where("price > 0").withColumns({"year": F.year("ts"), "month": F.month("ts")})
    return signatures(x, ("asset_id", "year", "month"), "ts").where(F.col("n_prices") >= least).withColumn("duration", duration(F.col("begin"), F.col("end")))


def duration(begin: Column, end: Column) -> Column:
    """Share of 120 days that a span covers."""
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / 86_400_000_000.0
    return F.when(days <= 0, 0.0).otherwise(clamp_score(F.least(days, F.lit(120.0)) / 120 * 100))


def quarters(months: DataFrame) -> DataFrame:
    """Quarters made of the months that were kept."""
    q = F.ceil(F.col("month") / 3).cast("int")
    return months.groupBy("asset_id", "year", q.alias("quarter")).agg(F.count("*").alias("n_months"), F.sum("n_prices").alias("n"), F.min_by("first_price", "month").alias("first_price"), F.max_by("last_price", "month").alias("last_price"))


def structure_7d(ticks: DataFrame) -> DataFrame:
    """Directional consistency, convergence and rupture penalty of a series, with its validation and pattern states."""
    s = profile(ticks)
    active = F.col("ups") + F.col("downs")
    bias = F.when(F.col("n_returns") == 0, F.lit(None)).otherwise(F.when(active == 0, 0.0).otherwise(round2(F.abs(F.col("ups") - F.col("downs")) / active)))
    noise = F.when(F.col("n_returns") >= 2, round2(clamp(F.col("sd_return") / F.greatest(F.abs("mean_return"), F.lit(1.0)), 0, 10)))
    x = s.withColumns({"bias": bias, "noise": noise}).where("n_prices >= 2")
    consistency = F.when(F.col("n_returns") >= 1, round2(clamp(clamp(F.col("bias") * 100, 0, 100) - F.coalesce(clamp(F.col("noise") * 12, 0, 70), F.lit(20.0)) + 20, 0, 100)))
    convergence = F.when(F.col("first_price") != 0, round2(clamp(clamp(50 + F.col("slope_pct"), 0, 100) * 0.45 + F.coalesce(clamp(F.col("bias") * 100, 0, 100), F.lit(50.0)) * 0.4 - F.coalesce(clamp(F.col("noise") * 10, 0, 60), F.lit(15.0)) + 15, 0, 100)))
    ratio = F.when(F.col("n_returns") < 2, 0.0).otherwise(clamp(F.col("direction_changes") / F.greatest(F.col("n_returns"), F.lit(1)), 0, 1))
    penalty = F.when(F.col("n_returns") >= 1, round2(clamp((ratio * 0.65 + F.coalesce(clamp(F.col("noise") / 5, 0, 1), F.lit(0.0)) * 0.35) * 100, 0, 100)))
    x = x.select("asset_id", "n_prices", consistency.alias("consistency"), convergence.alias("convergence"), penalty.alias("rupture_penalty"))
    total = F.when(F.col("consistency").isNotNull() & F.col("convergence").isNotNull() & F.col("rupture_penalty").isNotNull(), clamp_score(blend((0.35, F.col("consistency")), (0.4, F.col("convergence")), (0.25, 100 - F.col("rupture_penalty")))))
    x = x.withColumn("validation_score", total)
    none, broken, score = F.col("validation_score").isNull(), F.col("rupture_penalty") >= 65, F.col("validation_score")
    return x.withColumns({
        "validation_state": F.when(none, "UNAVAILABLE").when(broken, "BREAK").when(score >= 60, "CONFIRM").when(score >= 40, "WEAKEN").otherwise("BREAK"), "pattern_state": F.when(none, "UNAVAILABLE").when(broken, "UNSTABLE").when(score >= 60, "COHERENT").when(score >= 40, "MIXED").otherwise("UNSTABLE"),
        "status": F.when(none, "partial").when(F.col("n_prices") >= 7, "computed").otherwise("partial"),
    })


def behavior_7d(ticks: DataFrame) -> DataFrame:
    """PUMA, KANGAROO or SERPENT by trend, volatility and amplitude."""
    s = profile(ticks)
    trend, vol, amp = F.col("slope_pct") / 100, F.coalesce("volatility", F.lit(0.0)) / 100, F.col("amplitude_pct") / 100
    raw = trend * 120 - vol * 80 + amp * 40
    damped = F.when(F.abs(trend) < 0.01, raw * 0.6).otherwise(raw)
    score = F.when(F.col("n_prices") < 5, 50.0).otherwise(F.floor((clamp(damped, -100, 100) + 100) / 200 * 100 + 0.5))
    return s.select("asset_id", score.cast("double").alias("score")).withColumn("behavior", F.when(F.col("score") >= 65, "PUMA").when(F.col("score") <= 35, "SERPENT").otherwise("KANGAROO"))
