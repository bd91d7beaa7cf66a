"""Back-test by replay: at every point of a dated series, the decision that its past alone gives.

Nothing is worked out anew for each point, and a series is dealt once: all that a point needs comes from windows over its asset's
points, which run up to it. Within a month or quarter they give the signature so far, over the series sums, extremes, streaks and
outcomes; what a month leaves to later ones (its signature, the state of the calendar) is the last value that a window has seen.
So there is no join and no table between the steps, and a point's cost doesn't grow with the number before it, but for the
months that it is compared with: an asset's are taken once, and its points meet them as arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidepool.functions.kernel import round2
from tidepool.operators import calibration, history
from tidepool.operators.series import OUTCOME_KINDS, duration, ended_windows, judged, lead_returns

#: All windows but the week's sort by asset, year, quarter, month and time, so that one sort serves them.
QUARTER = ("asset_id", "year", "quarter")
MONTH = (*QUARTER, "month")
ORDER = ("year", "quarter", "month", "ts")
#: Places before the first decision, and behind the last one.
LEAST, AHEAD = 120, 72
SIGNATURE = ("kind", "slope_pct", "amplitude_pct", "instability", "break_rate", "quality", "duration")
#: Sizes of the windows whose outcomes are known later.
SIZES = range(3, 7)
_WEEK = 7 * 86_400_000_000
_UPTO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def prefixes(points: DataFrame, keys: tuple[str, ...], name: str, fields: tuple[str, ...] = SIGNATURE, counts: Column | None = None) -> DataFrame:
    """points with the signature (``fields`` of it, in a struct ``name``) of their segment (keys) up to each of them, and its step.

    Points for which ``counts`` is false are left out, and theirs is not to be read. The step, ``name``_step, orders a segment's
    points, and is 1 higher where there are twice as many returns: all returns of the first half of k lie 1 or more below k's.
    """
    own = Window.partitionBy(*keys).orderBy(*[c for c in ORDER if c not in keys])
    upto, before = own.rowsBetween(*_UPTO), own.rowsBetween(*_BEFORE)
    x = points.withColumn("_p", F.col("price") if counts is None else F.when(counts, F.col("price")))
    prev = F.last("_p", True).over(before)
    x = x.withColumn("_r", F.when(prev.isNotNull() & (prev != 0), (F.col("_p") - prev) / F.abs(prev) * 100))
    x = x.withColumns({"_b": F.last("_r", True).over(before), "k": F.count("_r").over(upto)})
    broken = (F.col("_r") * F.col("_b") < 0) | (F.abs(F.col("_r") - F.col("_b")) >= 4.0)
    x = x.withColumns({
        "n_prices": F.count("_p").over(upto), "n_r": F.col("k"), "first_price": F.first("_p", True).over(upto), "last_price": F.col("_p"), "min_price": F.min("_p").over(upto), "max_price": F.max("_p").over(upto), "begin": F.first(F.when(F.col("_p").isNotNull(), F.col("ts")), True).over(upto), "end": F.col("ts"),
        "sum_r": F.sum("_r").over(upto), "sd": F.stddev_pop("_r").over(upto), "broken": F.avg(F.when(F.col("_r").isNotNull() & F.col("_b").isNotNull(), F.when(broken, 1.0).otherwise(0.0))).over(upto), "half": F.floor(F.col("k") / 2),
    })
    octave = F.length(F.bin("k")) - 1
    x = x.withColumn(f"{name}_step", F.when(F.col("k") == 0, -1.0).otherwise(octave + F.col("k") / F.pow(F.lit(2.0), octave) - 1))
    x = x.withColumn("half_r", F.sum("_r").over(Window.partitionBy(*keys).orderBy(f"{name}_step").rangeBetween(Window.unboundedPreceding, -1)))
    x = x.withColumns({"first_mean": F.when(F.col("half") > 0, F.col("half_r") / F.col("half")), "second_mean": F.when(F.col("half") > 0, (F.col("sum_r") - F.col("half_r")) / (F.col("k") - F.col("half")))})
    return judged(x).withColumn("duration", duration(F.col("begin"), F.col("end"))).select(*points.columns, f"{name}_step", F.struct("n_prices", *fields).alias(name))


def rolling_week(points: DataFrame) -> DataFrame:
    """points with the block r7 of the seven days up to each (``at``: microseconds): its columns as temporal_blocks names them."""
    week = Window.partitionBy("asset_id").orderBy("at").rangeBetween(-_WEEK, 0)
    x = points.withColumns({"p": F.collect_list("price").over(week), "begin": F.min("ts").over(week), "end": F.col("ts")})
    x = x.withColumn("rs", F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda v, i: (v - F.get("p", i)) / F.abs(F.get("p", i)) * 100))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    flag = lambda v, i: F.when((v * F.get("rs", i) < 0) | (F.abs(v - F.get("rs", i)) >= 4.0), 1.0).otherwise(0.0)
    x = x.withColumns({"n_prices": F.size("p").cast("long"), "n_r": F.size("rs"), "mean_r": F.try_divide(total(F.col("rs")), F.size("rs")), "flags": F.transform(F.slice("rs", F.lit(2), F.greatest(F.size("rs") - 1, F.lit(0))), flag)})
    x = x.withColumns({
        "sd": F.sqrt(F.try_divide(total(F.transform("rs", lambda v: (v - F.col("mean_r")) * (v - F.col("mean_r")))), F.size("rs"))), "broken": F.try_divide(total(F.col("flags")), F.size("flags")), "first_price": F.get("p", F.lit(0)), "last_price": F.element_at("p", -1), "min_price": F.array_min("p"), "max_price": F.array_max("p"),
        "first_mean": F.lit(None).cast("double"), "second_mean": F.lit(None).cast("double"),
    })
    x = judged(x).withColumn("duration", duration(F.col("begin"), F.col("end")))
    block = history.block("r7")
    return x.withColumn("r7", F.struct(*history.SIGNED)).withColumns({k: block[k] for k in ("r7_stability", "r7_rupture")}).select(*points.columns, "r7_stability", "r7_rupture")


def runs(points: DataFrame) -> DataFrame:
    """points (with d, the sign of the move to each) and what has run up to each: number, mean and deviation of prices, first price, moves and longest streaks up and down."""
    own = Window.partitionBy("asset_id").orderBy(*[c for c in ORDER if c in points.columns])
    upto = own.rowsBetween(*_UPTO)
    so_far = lambda e: F.coalesce(e.over(upto), F.lit(0))
    one = lambda s: so_far(F.sum(F.when(F.col("d") == s, 1).otherwise(0)))
    x = points.withColumns({"n": F.row_number().over(own), "turned": F.coalesce(F.col("d") != F.lag("d").over(own), F.lit(True))})
    x = x.withColumn("run", F.col("n") - F.max(F.when(F.col("turned"), F.col("n"))).over(upto) + 1)
    x = x.withColumns({
        "mean": F.sum("price").over(upto) / F.col("n"), "squares": F.sum(F.col("price") * F.col("price")).over(upto) / F.col("n"), "first": F.first("price").over(upto), "last": F.col("price"),
        "ups": one(1), "downs": one(-1), "up": so_far(F.max(F.when(F.col("d") == 1, F.col("run")))), "down": so_far(F.max(F.when(F.col("d") == -1, F.col("run")))),
    })
    x = x.withColumn("sd", F.sqrt(F.greatest(F.col("squares") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return x.select(*points.columns, "mean", "sd", "first", "last", "ups", "downs", "up", "down")


def past_rates(points: DataFrame) -> DataFrame:
    """points with the outcome rates of the windows of their kind that were known there: those that end before them."""
    own = Window.partitionBy("asset_id").orderBy(*ORDER)
    before = own.rowsBetween(*_BEFORE)
    x = ended_windows(points, own, SIZES[0], SIZES[-1]).withColumn("_falls", F.when(F.lead("price").over(own) < F.col("price"), 1).otherwise(0))
    of = lambda kind, value: sum([F.when(F.col(f"w{n}.kind") == kind, value(F.col(f"w{n}"))).otherwise(0) for n in SIZES], F.lit(0).cast("long"))
    sums = {"n": lambda w: F.lit(1), "corrected": lambda w: F.col("_falls"), "alike": lambda w: F.round(w["similarity"] * 100).cast("long")}
    x = x.withColumns({f"_{c}_{kind}": F.sum(of(kind, value)).over(before) for c, value in sums.items() for kind in OUTCOME_KINDS})

    def own_kind(c: str) -> Column:
        out = F.lit(0)
        for kind in OUTCOME_KINDS:
            out = F.when(F.col("kind") == kind, F.col(f"_{c}_{kind}")).otherwise(out)
        return F.coalesce(out, F.lit(0))

    x = x.withColumns({f"_{c}": own_kind(c) for c in sums})
    known = F.col("_n") > 0
    share = lambda c: F.when(known, round2(c * 100.0 / F.col("_n"))).otherwise(0.0)
    return x.select(*points.columns, share(F.col("_corrected")).alias("correction_rate"), share(F.col("_n") - F.col("_corrected")).alias("continuation_rate"), F.when(known, round2(F.col("_alike") / (F.col("_n") * 100))).otherwise(0.0).alias("avg_similarity"))


def calendar_state(points: DataFrame) -> DataFrame:
    """points with state (the newest kept month's signature so far, the quarter's and past months' quality), own (their month's signature so far), closes (whether a kept month ends there, so that own is what it leaves) and whole.

    A month counts from its fourth point on; until then the kept month before stands. A series of which no month has four points
    yet is judged by all of it (whole): such a series has few points a month.
    """
    month = Window.partitionBy(*MONTH)
    x = points.withColumns({"n_month": F.count(F.lit(1)).over(month), "_nth": F.row_number().over(month.orderBy("ts"))})
    x = x.withColumn("_bare", F.max("_nth").over(Window.partitionBy("asset_id").orderBy(*ORDER).rowsBetween(*_UPTO)) < history.LEAST_SEGMENT)
    x = prefixes(x, ("asset_id",), "whole", ("quality", "duration", "break_rate"), F.col("_bare")).drop("whole_step")
    x = prefixes(x, QUARTER, "so_far", ("quality",), F.col("n_month") >= history.LEAST_SEGMENT).drop("so_far_step")
    x = prefixes(x, MONTH, "own")
    series = Window.partitionBy("asset_id").orderBy("year", "quarter", "month", "own_step")  # in time; a month's halves are sorted so
    upto, before = series.rowsBetween(*_UPTO), series.rowsBetween(*_BEFORE)
    counts, ends = F.col("own.n_prices") >= history.LEAST_SEGMENT, F.col("own.n_prices") == F.col("n_month")
    signature = F.struct(*[F.col(f"own.{f}").alias(f) for f in SIGNATURE], "year", "month")
    x = x.withColumns({"past_sum": F.coalesce(F.sum(F.when(counts & ends, F.round(F.col("own.quality") * 100).cast("long"))).over(before), F.lit(0)), "past_n": F.count(F.when(counts & ends, 1)).over(before)})
    state = F.struct(signature.alias("now"), F.col("so_far.quality").alias("quarter_quality"), "past_sum", "past_n")
    x = x.withColumns({"state": F.last(F.when(counts, state), True).over(upto), "closes": counts & ends})
    return x.select(*points.columns, "state", "own", "closes", "whole")


SIGNALS = ("asset_id", "place", "ts", "price", "regime", "stability", "opportunity", "decision", "correction_probability", "continuation_probability", "return_24", "return_48", "return_72")
#: What is known of a signal's point before it is compared with earlier months.
POINT = ("asset_id", "place", "ts", "price", "return_24", "return_48", "return_72", "r7_stability", "r7_rupture", "pattern", "pattern_similarity", "off", "correction_rate", "continuation_rate", "avg_similarity", "own_quality", "own_duration", "own_break_rate", "quarter_quality", "past_sum", "past_n")


#: What of a signature is compared, and what is summed of a point's comparisons: history.summed().
COMPARED = ("kind", "slope_pct", "amplitude_pct", "instability", "break_rate", "duration")
MET = {"n": LongType, "strong": LongType, "m_continuity": DoubleType, "sd_similarity": DoubleType, "m_duration": DoubleType, "broken": LongType, "m_gap": DoubleType, "sd_gap": DoubleType}
#: Points and months of an asset that are looked at together.
AT_ONCE = 1 << 22


def _met(points: pa.Table) -> pa.Table:
    """An asset's asked points with the sums of their comparisons with the months that have closed before theirs."""
    closed, asked = points.filter(points["closes"]), points.filter(points["asked"])
    side = lambda t, p: {f: (pc.index_in(t[f"{p}_{f}"], pa.array(history.KINDS)).fill_null(-1) if f == "kind" else t[f"{p}_{f}"].fill_null(-1)).to_numpy() for f in (*COMPARED, "year", "month")}
    month, now, phase = side(closed, "m"), side(asked, "now"), asked["phase"].to_numpy()
    step, out = max(1, AT_ONCE // max(1, len(closed))), []
    for at in range(0, len(asked), step):
        mine = {f: v[at : at + step, None] for f, v in now.items()}
        earlier = mine["year"] * 12 + mine["month"] > month["year"] * 12 + month["month"]
        same = ((mine["month"] + 2) // 3 == (month["month"] + 2) // 3) & (month["year"] < mine["year"])
        q, r = np.nonzero(earlier & (same | ~phase[at : at + step, None]))
        out.append(history.met({f: v[q, 0] for f, v in mine.items()}, {f: v[r] for f, v in month.items()}, q, len(mine["year"])))
    sums = {c: np.concatenate([x[c] for x in out]) if out else np.empty(0) for c in MET}
    kinds = {LongType: pa.int64(), DoubleType: pa.float64()}
    return pa.table([*[asked[c] for c in POINT], *[pa.array(sums[c], mask=np.isnan(sums[c])).cast(kinds[k]) for c, k in MET.items()]], names=[*POINT, *MET])


def replay(hist: DataFrame, least: int = LEAST, ahead: int = AHEAD) -> DataFrame:
    """A signal for each place from ``least`` on that has more than ``ahead`` places behind it. hist: asset_id, ts, price; prices that aren't positive don't count.

    return_24, return_48 and return_72 look ahead, to judge the decisions by; all else is from points up to the signal's own.
    """
    own = Window.partitionBy("asset_id")
    series = own.orderBy("at")
    base = hist.where("price > 0").select("asset_id", "ts", "price").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    base = lead_returns(base.withColumnRenamed("at", "idx")).withColumnRenamed("idx", "at").withColumns({
        "place": F.row_number().over(series).cast("long") - 1, "n_all": F.count(F.lit(1)).over(own), "begun": F.min("at").over(own), "d": F.coalesce(F.signum(F.col("price") - F.lag("price").over(series)), F.lit(0.0)),
    })
    base = rolling_week(base.where(F.col("n_all") >= least + ahead)).withColumns({"year": F.year("ts"), "month": F.month("ts"), "quarter": F.quarter("ts")})
    x = calibration.pattern_class(runs(base)).drop("mean", "sd", "first", "last", "ups", "downs", "up", "down")
    x = calendar_state(past_rates(x).withColumnRenamed("kind", "pattern"))
    spans = (F.col("at") - F.col("begun")) / 86_400_000_000.0 / 30
    phase = F.col("state").isNotNull() & (spans >= 12)  # then a month is compared with the same quarter's of earlier years, before with all earlier ones
    asked = (F.col("place") >= least) & (F.col("place") < F.col("n_all") - ahead)
    x = x.select("*", phase.alias("phase"), asked.alias("asked"), "state.*").withColumns({f"own_{f}": F.coalesce(f"now.{f}", f"whole.{f}") for f in ("quality", "duration", "break_rate")})
    x = x.select(*POINT, "phase", "asked", "closes", *[F.col(f"own.{f}").alias(f"m_{f}") for f in COMPARED], F.col("year").alias("m_year"), F.col("month").alias("m_month"), *[F.col(f"now.{f}").alias(f"now_{f}") for f in (*COMPARED, "year", "month")])
    x = x.groupBy("asset_id").applyInArrow(_met, StructType([*x.select(*POINT).schema, *[StructField(c, kind()) for c, kind in MET.items()]]))
    x = x.withColumnsRenamed({f"own_{f}": f for f in ("quality", "duration", "break_rate")})
    x = x.withColumns({"quarter_score": F.coalesce("quarter_quality", "quality"), "baseline": F.when(F.col("past_n") > 0, F.col("past_sum") / (F.col("past_n") * 100)).otherwise(F.col("quality"))})
    x = history.scored(x).withColumn("regime", history.regime())
    return calibration.pattern_verdict(x.withColumnRenamed("pattern", "kind")).select(*SIGNALS)
