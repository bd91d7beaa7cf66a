import datetime as dt
import random

from tidepool.operators import replay


def table(spark, series):
    start = dt.datetime(2023, 1, 20)
    rows = [(a, start + dt.timedelta(days=d), float(p)) for a, points in series.items() for d, p in points]
    return spark.createDataFrame(rows, "asset_id long, ts timestamp_ntz, price double")


def walk(seed, n, gaps=1):
    rnd, price, day, out = random.Random(seed), 100.0, 0, []
    for _ in range(n):
        price = round(max(1.0, price * (1 + rnd.choice([-1, 1, 1]) * rnd.random() * 0.04)), 2)
        out.append((day, price))
        day += rnd.randint(1, gaps)
    return out


def test_what_comes_later_moves_no_decision(spark):
    """Series that agree up to a point have the same signals up to it, whatever comes behind; returns look ahead and may differ."""
    whole = {1: walk(1, 330), 2: walk(2, 300, 3)}
    changed = {a: p[:230] + [(d, q * 7) for d, q in p[230:]] for a, p in whole.items()}
    seen = [x for x in replay.SIGNALS if not x.startswith("return")]
    first, second = ({(r.asset_id, r.place): r for r in replay.replay(table(spark, s)).select(*seen).collect()} for s in (whole, changed))
    early = [k for k in first if k[1] < 230]
    assert len(early) == 110 + 108 and all(first[k] == second[k] for k in early)
    assert any(first[k] != second[k] for k in first if k[1] >= 230)


def test_streaks_go_on_between_months(spark):
    """Rising for more than two months, then falling; flat days end a streak."""
    prices = [(d, 100 + d) for d in range(75)] + [(75, 174), (76, 170), (77, 169)] + [(d, 160 - d / 10) for d in range(78, 140)]
    base = table(spark, {5: prices})
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("asset_id").orderBy("ts")
    base = base.withColumns({"d": F.coalesce(F.signum(F.col("price") - F.lag("price").over(w)), F.lit(0.0)), "year": F.year("ts"), "month": F.month("ts")})
    got = [(r.up, r.down, r.ups, r.downs, round(r.mean, 6)) for r in replay.runs(base).orderBy("ts").collect()]
    up = down = ups = downs = run = 0
    last, total = None, 0.0
    for i, (_, p) in enumerate(prices):
        d = 0 if last is None else (p > last) - (p < last)
        run = run + 1 if i and d == way and d else 1 if d else 0  # noqa: F821
        way, last, total = d, p, total + p  # noqa: F841
        up, down, ups, downs = max(up, run if d > 0 else 0), max(down, run if d < 0 else 0), ups + (d > 0), downs + (d < 0)
        assert got[i] == (up, down, ups, downs, round(total / (i + 1), 6)), i


def test_short_series_and_empty_tables_have_no_signals(spark):
    assert replay.replay(table(spark, {1: walk(1, 191)})).count() == 0
    assert replay.replay(table(spark, {1: walk(1, 1)}).where("false")).count() == 0


def test_months_with_few_points(spark):
    """A series without a month of four points is judged by all of it; prices that aren't positive don't count."""
    sparse = [(30 * i, 100 + (i * 37) % 11) for i in range(200)]
    got = replay.replay(table(spark, {3: sparse + [(1, -5.0), (2, 0.0)]})).collect()
    assert [r.place for r in sorted(got)] == list(range(120, 128)) and all(r.regime in ("VOLATILE", "TRANSITION") for r in got)
