import math
import random
from datetime import datetime, timedelta

from tidepool.streaming import live


def test_means_add_prices_in_their_order_in_time(spark):
    rnd = random.Random(3)
    rows = [(a, datetime(2024, 1, 1) + timedelta(minutes=i * 9), round(rnd.uniform(0, 300), 2)) for a in range(400) for i in range(4)]
    mixed = rows[:]
    rnd.shuffle(mixed)
    got = {r["asset_id"]: r["avg_price"] for r in live.live_windows(spark.createDataFrame(mixed, "asset_id long, ts timestamp, price double").repartition(7), "1 day").collect()}
    mean = lambda prices: math.floor(sum_of(prices) / len(prices) * 100 + 0.5) / 100

    def sum_of(prices):
        total = 0.0
        for p in prices:
            total += p
        return total

    of = lambda a: [p for x, _, p in rows if x == a]
    assert got == {a: mean(of(a)) for a in range(400)}
    assert any(mean(of(a)) != mean(sorted(of(a))) for a in range(400))  # the order matters


def test_missing_prices(spark):
    rows = [(1, datetime(2024, 1, 1), None), (1, datetime(2024, 1, 1, 1), 2.0), (2, datetime(2024, 1, 1), None)]
    got = {r["asset_id"]: (r["n"], r["avg_price"]) for r in live.live_windows(spark.createDataFrame(rows, "asset_id long, ts timestamp, price double"), "1 day").collect()}
    assert got == {1: (2, 2.0), 2: (1, 0.0)}
