import datetime as dt

from tidepool.operators import scan_engine


def ticks(spark, series):
    return spark.createDataFrame([(a, i, float(p)) for a, ps in series.items() for i, p in enumerate(ps)], "asset_id long, idx long, price double")


def test_calendar_and_signature(spark):
    t = ticks(spark, {1: [100, -5, 110, 104.5, 125.4, 125.4]})
    days = [r.ts for r in scan_engine.dated(t).orderBy("ts").collect()]
    assert days == [dt.datetime(2026, 1, 1) + dt.timedelta(days=d) for d in range(5)]
    s = scan_engine.whole_signature(scan_engine.dated(t)).first()
    returns = [10.0, -5.0, 20.0, 0.0]
    mean = sum(returns) / 4
    assert abs(s.slope_pct - 25.4) < 1e-9 and abs(s.amplitude_pct - 25.4 / 125.4 * 100) < 1e-9
    assert abs(s.instability - min(100, 12 * (sum((r - mean) ** 2 for r in returns) / 4) ** 0.5)) < 1e-9
    assert abs(s.break_rate - 2 / 3) < 1e-9  # two turns, the second a jump as well; standing still is no break


def test_short_series_are_partial(spark):
    facts = spark.createDataFrame([(1, 2.0, -3.0)], "asset_id long, chg_24h_pct double, chg_7d_pct double")
    got = {r.asset_id: r for r in scan_engine.scanned(ticks(spark, {1: [100 + (i * 7) % 5 for i in range(40)], 2: [5] * 7, 3: [1, -1, 2, 3, 4, 5, 6, 7]}), facts).collect()}
    assert got[1].status == "computed" and got[1].stability is not None and "insufficient_global_sample" in got[1].warnings
    for few in (got[2], got[3]):
        assert (few.status, few.regime, few.impulse_state, few.impulse_bias, few.stability, few.warnings) == ("partial", "TRANSITION", "NEUTRAL", "NEUTRAL", None, "scan_engine_insufficient_rfs_prices")
