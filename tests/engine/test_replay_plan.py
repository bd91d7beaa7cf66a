from pyspark.sql import functions as F

from tests.engine.test_replay import table, walk
from tidepool.operators import replay
from tidepool.operators.series import ended_windows, by_asset


def test_a_series_is_dealt_once(spark):
    """What a back-test moves between tasks is the points, once: no join, no table between the steps."""
    hist = table(spark, {1: walk(1, 330), 2: walk(2, 300, 3)}).repartition(3, "asset_id")
    signals = replay.replay(hist)
    plan = signals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Scan parquet" not in plan
    assert signals.count() == 330 + 300 - 2 * 192


def test_signatures_so_far_by_hand(spark):
    """The halves of the returns up to each point, by a plain loop; points that don't count are left out."""
    prices = [100, 103, 101, 104, 108, 102, 99, 97, 103, 105, 101, 95, 96, 97]
    base = table(spark, {7: list(enumerate(prices))}).withColumns({"year": F.lit(2023), "quarter": F.lit(1), "month": F.lit(1), "kept": F.day("ts") != 23})
    got = [r.s for r in replay.prefixes(base, replay.MONTH, "s", replay.SIGNATURE, F.col("kept")).where("kept").orderBy("ts").collect()]
    seen = []
    for r, p in zip(got, [float(p) for d, p in enumerate(prices) if d != 3], strict=True):
        seen.append(p)
        rs = [(b - a) / a * 100 for a, b in zip(seen, seen[1:])]
        half = len(rs) // 2
        amplitude = (max(seen) - min(seen)) / min(seen) * 100
        turned = len(rs) >= 4 and sum(rs[:half]) / half * sum(rs[half:]) < 0
        assert r.n_prices == len(seen) and abs(r.amplitude_pct - amplitude) < 0.006 and (r.kind == "REVERSAL") == (turned and r.amplitude_pct >= 4)
        if len(rs) > 1:
            broken = [b * a < 0 or abs(b - a) >= 4 for a, b in zip(rs, rs[1:])]
            assert abs(r.break_rate - sum(broken) / len(broken)) < 0.006
    assert {r.kind for r in got} >= {"REVERSAL", "RANGE"}


def test_windows_that_a_series_has_not_filled_are_missing(spark):
    rows = [(1, i, float(p)) for i, p in enumerate([10, 11, 12, 13, 12])]
    got = ended_windows(spark.createDataFrame(rows, "asset_id long, idx long, price double"), by_asset()).orderBy("idx").collect()
    assert [[r[f"w{k}"] is not None for k in range(3, 7)] for r in got] == [[i >= k - 1 for k in range(3, 7)] for i in range(5)]
    assert [r.w4 and r.w4.kind for r in got] == [None, None, None, "UP_STREAK", "BREAKOUT"]
