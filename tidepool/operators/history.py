"""History engine: a dated series' newest month against its past, calendar blocks, regime and impulse.

A series' points are labelled with the segments they belong to (each kept month, the newest quarter, the whole, and the first
and last 7 days and 24 hours), and every segment's signature comes from one window and one grouping. All windows and groupings
are by asset, so that the points are shuffled once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp, clamp_score, deviation_score, mean_score, round2
from tidepool.operators.series import duration, kind_similarity, signatures, slope

LEAST_PRICES, LEAST_SEGMENT = 8, 4
NEUTRAL = 50.0
BLOCKS = {"i7": ("initial", "7 days"), "r7": ("rolling", "7 days"), "i24": ("initial", "24 hours"), "r24": ("rolling", "24 hours")}
_KEYS = ("asset_id", "segment", "year", "month")


def segments(hist: DataFrame) -> DataFrame:
    """Signatures of all segments of series with 8 positive prices or more. hist: asset_id, ts, price."""
    own, month = Window.partitionBy("asset_id"), Window.partitionBy("asset_id", "year", "month")
    x = hist.where("price > 0").withColumns({"year": F.year("ts"), "month": F.month("ts")})
    x = x.withColumns({"n_all": F.count(F.lit(1)).over(own), "n_month": F.count(F.lit(1)).over(month), "t0": F.min("ts").over(own), "t1": F.max("ts").over(own)}).where(F.col("n_all") >= LEAST_PRICES)
    kept = F.col("n_month") >= LEAST_SEGMENT
    quarter = F.struct("year", F.quarter("ts").alias("q"))
    x = x.withColumn("newest", F.max(F.when(kept, quarter)).over(own))
    label = lambda name, when, year=F.lit(0), month=F.lit(0): F.when(when, F.struct(F.lit(name).alias("segment"), year.alias("year"), month.alias("month")))
    span = {k: F.expr(f"interval {v}") for k, (_, v) in BLOCKS.items()}
    inside = {k: F.col("ts") <= F.col("t0") + span[k] if kind == "initial" else F.col("ts") >= F.col("t1") - span[k] for k, (kind, _) in BLOCKS.items()}
    of = F.array_compact(F.array(label("month", kept, F.col("year"), F.col("month")), label("quarter", kept & (quarter == F.col("newest"))), label("all", F.lit(True)), *[label(k, v) for k, v in inside.items()]))
    long = x.select("asset_id", "ts", "price", F.explode(of).alias("s")).select("asset_id", "ts", "price", "s.*")
    return signatures(long, _KEYS, "ts").withColumn("duration", duration(F.col("begin"), F.col("end")))


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return clamp(100 - F.abs(a - b) / tolerance * 100, 0, 100)


def compared(signed: DataFrame, mode: str | None = None) -> DataFrame:
    """Kept months with the newest one's signature (now) and, where it is a reference of it, how alike the two are.

    References are the months of the same quarter in earlier years where a series spans twelve months of 30 days or more, else
    all earlier months; ``mode`` sets one of the two for all series.
    """
    own = Window.partitionBy("asset_id")
    newest = own.orderBy(F.desc("year"), F.desc("month"))
    spans = F.max(F.when(F.col("segment") == "all", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 86_400_000_000.0)).over(own) / 30
    by_span = F.when(spans < 2, "INSUFFICIENT_HISTORY").when(spans < 12, "MONTH_TO_MONTH").otherwise("YEAR_PHASE_COMPARISON")
    x = signed.withColumn("mode", F.lit(mode) if mode else by_span).where("segment = 'month'")
    fields = ["kind", "slope_pct", "amplitude_pct", "instability", "break_rate", "quality", "duration", "year", "month"]
    x = x.withColumns({"back": F.row_number().over(newest), "now": F.first(F.struct(*fields)).over(newest)})
    q = lambda m: F.ceil(m / 3)
    same_phase = (q(F.col("month")) == q(F.col("now.month"))) & (F.col("year") < F.col("now.year"))
    x = x.withColumn("reference", (F.col("back") > 1) & F.when(F.col("mode") == "YEAR_PHASE_COMPARISON", same_phase).otherwise(True))
    ref = lambda v: F.when(F.col("reference"), round2(v))
    return x.withColumn("alike", likeness()).withColumns({k: ref(v) for k, v in comparisons().items()})


def likeness() -> Column:
    """How alike the signature now.* and the row's own are."""
    c = lambda f: F.col(f"now.{f}")
    return clamp(blend((0.14, kind_similarity(c("kind"), F.col("kind"))), (0.22, _near(c("slope_pct"), F.col("slope_pct"), 20)), (0.16, _near(c("amplitude_pct"), F.col("amplitude_pct"), 30)), (0.22, _near(c("instability"), F.col("instability"), 50)), (0.14, _near(c("break_rate"), F.col("break_rate"), 0.6)), (0.12, _near(c("duration"), F.col("duration"), 40))), 0, 100)


def comparisons() -> dict[str, Column]:
    """Similarity, rupture gap, continuity and likeness of durations of now.* and the row's own signature, whose likeness is in alike."""
    c = lambda f: F.col(f"now.{f}")
    fragile = lambda p: F.col(f"{p}instability") * 0.38 + F.col(f"{p}break_rate") * 100 * 0.38 + (100 - F.col(f"{p}duration")) * 0.24
    gap = clamp(F.greatest(F.lit(0.0), fragile("now.") - fragile("")) * 0.62 + (100 - F.col("alike")) * 0.38, 0, 100)
    aligned = F.when(F.signum(c("slope_pct")) * F.signum("slope_pct") > 0, 100.0).otherwise(35.0)
    going_on = clamp(blend((0.54, F.col("alike")), (0.2, aligned), (0.16, _near(c("duration"), F.col("duration"), 40)), (0.1, 100 - clamp(F.abs(c("break_rate") - F.col("break_rate")) * 100, 0, 100))), 0, 100)
    return {"similarity": F.col("alike"), "rupture_gap": gap, "continuity": going_on, "duration_similarity": _near(c("duration"), F.col("duration"), 40)}


#: Kinds of a signature, and how alike two of them are: kind_similarity.
KINDS = ("UPTREND", "DOWNTREND", "RANGE", "COMPRESSION", "REVERSAL")
_ALIKE = np.array([[100, 60, 25, 25, 25], [60, 100, 25, 25, 25], [25, 25, 100, 78, 42], [25, 25, 78, 100, 38], [25, 25, 42, 38, 100]], float)


def met(now: dict[str, np.ndarray], own: dict[str, np.ndarray], of: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """summed() over comparisons() of signatures that are arrays (kind as its place in KINDS), by ``of``, a number below n; NaN for null."""
    within = lambda x: np.maximum(0.0, np.minimum(100.0, x))
    near = lambda f, tolerance: within(100 - np.abs(now[f] - own[f]) / tolerance * 100)
    lasting = near("duration", 40)
    alike = within(_ALIKE[now["kind"], own["kind"]] * 0.14 + near("slope_pct", 20) * 0.22 + near("amplitude_pct", 30) * 0.16 + near("instability", 50) * 0.22 + near("break_rate", 0.6) * 0.14 + lasting * 0.12)
    fragile = lambda x: x["instability"] * 0.38 + x["break_rate"] * 100 * 0.38 + (100 - x["duration"]) * 0.24
    gap = within(np.maximum(0.0, fragile(now) - fragile(own)) * 0.62 + (100 - alike) * 0.38)
    aligned = np.where(np.sign(now["slope_pct"]) * np.sign(own["slope_pct"]) > 0, 100.0, 35.0)
    going_on = within(alike * 0.54 + aligned * 0.2 + lasting * 0.16 + (100 - within(np.abs(now["break_rate"] - own["break_rate"]) * 100)) * 0.1)
    similarity, gap, going_on, lasting = (np.floor(x * 100 + 0.5) for x in (alike, gap, going_on, lasting))  # whole hundredths, so that sums are exact
    total = lambda x: np.bincount(of, x, n)
    k = np.bincount(of, minlength=n).astype(float)
    some = np.where(k > 0, k, np.nan)
    mean = lambda x: total(x) / (some * 100)
    over = lambda x: np.sqrt(some * total(x * x) - total(x) * total(x)) / (some * 100)
    return {"n": k, "strong": total(similarity >= 7000), "m_continuity": mean(going_on), "sd_similarity": over(similarity), "m_duration": mean(lasting), "broken": total(gap >= 5000), "m_gap": mean(gap), "sd_gap": over(gap)}


def compare_with_history(hist: DataFrame, mode: str | None = None) -> DataFrame:
    """The newest month of each asset against each of its references."""
    x = compared(segments(hist), mode).where("reference")
    return x.select("asset_id", "year", "month", "mode", "similarity", "rupture_gap", "continuity", "duration_similarity", F.col("kind").alias("reference_kind"))


def block(p: str) -> dict[str, Column]:
    """Scores of a calendar block from its signature's columns p_*; neutral ones for fewer than two prices."""
    c = lambda f: F.col(f"{p}.{f}")
    few = F.coalesce(c("n_prices"), F.lit(0)) < 2
    rupture = clamp_score(blend((0.36, c("instability")), (0.36, c("break_rate") * 100), (0.28, 100 - c("duration"))))
    stability = clamp_score(blend((0.42, c("quality")), (0.22, c("duration")), (0.2, 100 - c("instability")), (0.16, 100 - c("break_rate") * 100)))
    change = slope(f"{p}.first_price", f"{p}.last_price")
    status = F.when(c("n_prices").isNull(), "unavailable").when(few, "insufficient_data").when(c("n_prices") < LEAST_SEGMENT, "partial").otherwise("computed")
    return {
        f"{p}_price_score": F.when(few, NEUTRAL).otherwise(clamp_score(50 + clamp(change, -50, 50))), f"{p}_change_pct": F.when(few, 0.0).otherwise(round2(change)), f"{p}_slope_pct": F.when(few, 0.0).otherwise(c("slope_pct")),
        f"{p}_stability": F.when(few, NEUTRAL).otherwise(stability), f"{p}_rupture": F.when(few, NEUTRAL).otherwise(rupture), f"{p}_status": status,
    }


SIGNED = ["n_prices", "first_price", "last_price", "slope_pct", "amplitude_pct", "instability", "break_rate", "quality", "duration"]


def temporal_blocks(hist: DataFrame) -> DataFrame:
    """Scores of the first and last 7 days and 24 hours of each series, both ends included."""
    return _blocks(segments(hist)).select("asset_id", *[c for p in BLOCKS for c in block(p)])


def _blocks(signed: DataFrame) -> DataFrame:
    one = lambda s: F.max(F.when(F.col("segment") == s, F.struct(*SIGNED)))
    g = signed.groupBy("asset_id").agg(*[one(p).alias(p) for p in BLOCKS], one("quarter").alias("quarter"), one("all").alias("whole"))
    return g.withColumns({k: v for p in BLOCKS for k, v in block(p).items()})


def history(hist: DataFrame) -> DataFrame:
    """Axes, rupture, crash, coherence, regime, timing and market scores of each series over its calendar history."""
    signed = segments(hist)
    x = compared(signed)
    past = mean_score(F.when(F.col("back") > 1, F.col("quality")))
    g = x.groupBy("asset_id").agg(*summed(), past.alias("past_quality"), F.first("now").alias("now"), F.first("mode").alias("mode"))
    d = _blocks(signed).join(g, "asset_id", "left")
    own = lambda f: F.coalesce(F.col(f"now.{f}"), F.col(f"whole.{f}"))
    d = d.withColumns({"n": F.coalesce("n", F.lit(0)), "mode": F.coalesce("mode", F.lit("INSUFFICIENT_HISTORY")), **{f: own(f) for f in ("slope_pct", "amplitude_pct", "instability", "break_rate", "quality", "duration")}})
    d = scored(d.withColumns({"quarter_score": F.coalesce("quarter.quality", "quality"), "baseline": F.coalesce("past_quality", "quality")}))
    apart = lambda a, b: clamp_score(100 - F.abs(F.col(a) - F.col(b)))
    d = d.withColumns({
        "crash_state": F.when((F.col("n") == 0) | (F.col("crash") < 45), "NONE").when(F.col("crash") >= 75, "CRASH").otherwise("RISING"),
        "coherence": clamp_score(blend((0.28, apart("stability", "quarter_score")), (0.24, apart("quarter_score", "quality")), (0.24, apart("quality", "r7_stability")), (0.08, apart("r7_stability", "r24_stability")), (0.16, 100 - F.col("penalty")))),
        "structure": clamp_score(blend((0.34, F.col("quality")), (0.34, F.col("quarter_score")), (0.18, F.col("baseline")), (0.14, F.col("duration_axis")))),
        "confidence": clamp_score(blend((0.2, F.col("occurrence")), (0.14, F.col("frequency")), (0.22, F.col("convergence")), (0.16, F.col("correlation")), (0.14, F.col("duration_axis")), (0.14, F.least(F.col("n") * 4, F.lit(100))))),
    })
    bad = (F.col("crash_state") == "CRASH") | (F.col("r24_rupture") >= 70) | (F.col("r24_stability") <= 35)
    return d.withColumns({
        "market": clamp_score(blend((0.36, F.col("stability")), (0.24, F.col("mid_term")), (0.16, F.col("coherence")), (0.14, F.col("continuity_probability")), (0.1, 100 - F.col("penalty")))),
        "regime": regime(), "timing": F.when(bad, "BAD").when((F.col("r24_stability") >= 60) & (F.col("r24_rupture") <= 40), "GOOD").otherwise("NEUTRAL"),
    })


def summed() -> list[Column]:
    """What the scores need of a series' comparisons: their number, how many are strong or broken, means and deviations."""
    mean, over = lambda c: mean_score(F.col(c)), lambda c: deviation_score(F.col(c))
    return [
        F.count("similarity").alias("n"), F.sum(F.when(F.col("similarity") >= 70, 1).otherwise(0)).alias("strong"), mean("continuity").alias("m_continuity"), over("similarity").alias("sd_similarity"), mean("duration_similarity").alias("m_duration"),
        F.sum(F.when(F.col("rupture_gap") >= 50, 1).otherwise(0)).alias("broken"), mean("rupture_gap").alias("m_gap"), over("rupture_gap").alias("sd_gap"),
    ]


def regime() -> Column:
    volatile = (F.col("crash") >= 75) | (F.col("rupture_probability") >= 78) | (F.col("r7_rupture") >= 80)
    stable = (F.col("stability") >= 70) & (F.col("rupture_probability") <= 35) & (F.col("quality") >= 60) & (F.col("quarter_score") >= 60) & (F.col("r7_stability") >= 50)
    return F.when(volatile, "VOLATILE").when(stable, "STABLE").otherwise("TRANSITION")


def scored(d: DataFrame) -> DataFrame:
    """Axes, rupture, penalty, continuity, stability, mid term and crash from summed() comparisons, the newest signature, quarter_score and baseline."""
    none = F.col("n") == 0
    d = d.withColumns({
        "occurrence": F.when(none, 0.0).otherwise(clamp_score(F.least(F.col("n"), F.lit(24)) / 24 * 100)), "frequency": F.when(none, 0.0).otherwise(clamp_score(F.col("strong") / F.col("n") * 100)), "convergence": F.when(none, 0.0).otherwise(clamp_score(F.col("m_continuity"))),
        "correlation": F.when(F.col("n") < 2, NEUTRAL).otherwise(clamp_score(100 - clamp(F.col("sd_similarity"), 0, 100))), "duration_axis": F.when(none, 0.0).otherwise(clamp_score(F.col("m_duration"))),
        "rupture_occurrence": F.when(none, NEUTRAL).otherwise(clamp_score(F.least(F.col("broken"), F.lit(24)) / 24 * 100)), "rupture_frequency": F.when(none, NEUTRAL).otherwise(clamp_score(F.col("broken") / F.col("n") * 100)), "rupture_convergence": F.when(none, NEUTRAL).otherwise(clamp_score(F.col("m_gap"))),
        "rupture_correlation": F.when(none, NEUTRAL).otherwise(clamp_score(100 - clamp(F.col("sd_gap"), 0, 100))), "rupture_duration": F.when(none, NEUTRAL).otherwise(clamp_score((100 - F.col("duration")) * 0.55 + F.col("break_rate") * 100 * 0.45)),
    })
    d = d.withColumn("rupture_probability", clamp_score(blend((0.18, F.col("rupture_occurrence")), (0.22, F.col("rupture_frequency")), (0.26, F.col("rupture_convergence")), (0.14, F.col("rupture_correlation")), (0.2, F.col("rupture_duration")))))
    d = d.withColumn("penalty", clamp_score(F.col("rupture_probability") * 0.7 + F.col("rupture_frequency") * 0.3))
    axes = clamp_score(blend((0.22, F.col("occurrence")), (0.18, F.col("frequency")), (0.26, F.col("convergence")), (0.16, F.col("correlation")), (0.18, F.col("duration_axis"))))
    excess = clamp_score(F.greatest(F.lit(0.0), F.col("rupture_probability") - F.col("m_gap")) / F.greatest(F.col("sd_gap"), F.lit(1.0)) * 20)
    d = d.withColumns({
        "continuity_probability": clamp_score(blend((0.18, F.col("occurrence")), (0.16, F.col("frequency")), (0.24, F.col("convergence")), (0.16, F.col("correlation")), (0.16, F.col("duration_axis")), (0.1, 100 - F.col("penalty")))),
        "stability": clamp_score(blend((0.72, axes), (0.18, 100 - F.col("penalty")), (0.1, F.col("baseline")))),
        "mid_term": clamp_score(blend((0.46, F.col("quarter_score")), (0.22, F.col("convergence")), (0.2, F.col("baseline")), (0.12, 100 - F.col("penalty")))),
        "crash": F.when(none, NEUTRAL).otherwise(excess), "crash_status": F.when(none, "baseline_missing").otherwise("computed"),
    })
    return d


HISTORY = ("asset_id", "mode", "n", "occurrence", "frequency", "convergence", "correlation", "duration_axis", "rupture_occurrence", "rupture_frequency", "rupture_convergence", "rupture_correlation", "rupture_duration", "rupture_probability", "penalty", "continuity_probability", "quality", "quarter_score", "baseline", "stability", "mid_term", "crash", "crash_status", "crash_state", "coherence", "structure", "confidence", "market", "regime", "timing")


def impulse_state(d: DataFrame) -> DataFrame:
    """Compression, pressure, instability, saturation and exhaustion of a history row, the state they stand for, and its bias."""
    amp, unstable = clamp(F.col("amplitude_pct"), 0, 100), clamp(F.col("instability"), 0, 100)
    d = d.withColumn("impulse_compression", clamp_score(blend((0.28, 100 - F.least(F.abs("slope_pct"), F.lit(100.0))), (0.22, 100 - amp), (0.2, F.col("duration_axis")), (0.18, F.col("convergence")), (0.12, F.col("correlation")))))
    d = d.withColumns({
        "impulse_pressure": clamp_score(blend((0.34, F.col("impulse_compression")), (0.18, F.col("convergence")), (0.14, F.col("frequency")), (0.14, F.col("duration_axis")), (0.12, F.col("rupture_probability")), (0.08, 100 - F.col("coherence")))),
        "impulse_instability": clamp_score(blend((0.28, unstable), (0.22, clamp(F.col("break_rate"), 0, 1) * 100), (0.22, F.col("rupture_probability")), (0.16, F.col("r7_rupture")), (0.12, F.col("r24_rupture")))),
        "impulse_exhaustion": clamp_score(blend((0.22, clamp(F.abs("r7_change_pct") * 4, 0, 100)), (0.18, clamp(F.abs("r24_change_pct") * 8, 0, 100)), (0.2, F.col("r7_rupture")), (0.16, F.col("r24_rupture")), (0.14, 100 - F.col("r7_stability")), (0.1, 100 - F.col("r24_stability")))),
    })
    d = d.withColumn("impulse_saturation", clamp_score(blend((0.34, F.col("impulse_pressure")), (0.22, F.col("penalty")), (0.18, 100 - F.col("stability")), (0.16, 100 - F.col("coherence")), (0.1, unstable))))
    slopes = F.array("slope_pct", "r7_slope_pct", "r24_slope_pct")
    up, down = F.size(F.filter(slopes, lambda s: s > 1)), F.size(F.filter(slopes, lambda s: s < -1))
    pressure, instability = F.col("impulse_pressure"), F.col("impulse_instability")
    state = (
        F.when(F.col("impulse_exhaustion") >= 70, "EXHAUSTION")
        .when((pressure >= 68) & (instability >= 62) & (F.abs("r24_change_pct") >= 3), "RELEASE")
        .when((pressure >= 60) & (F.col("impulse_saturation") >= 55), "PRESSURE_BUILDING")
        .when((pressure >= 45) & (instability <= 55) & (F.abs("r7_change_pct") <= 4), "COMPRESSION")
        .otherwise("NEUTRAL")
    )
    bias = F.when((up >= 2) & (down == 0), "UP").when((down >= 2) & (up == 0), "DOWN").when((up > 0) & (down > 0), "MIXED").otherwise("NEUTRAL")
    return d.withColumns({"impulse_state": state, "impulse_bias": bias})


IMPULSE = ("asset_id", "impulse_compression", "impulse_pressure", "impulse_instability", "impulse_saturation", "impulse_exhaustion", "impulse_state", "impulse_bias")
