import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.operators import matching, scan, scores, series
from tidepool.plans.order import global_row_number
from tidepool.sources import io
from tidepool.streaming import live


def ticks(spark, **series_of):
    rows = [(int(k[1:]), i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), float(p)) for k, ps in series_of.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "asset_id long, idx long, ts timestamp, price double")


def by_id(df):
    return {r["asset_id"]: r for r in df.collect()}


def test_zero_prices_are_skipped(spark):
    r = series.returns(ticks(spark, a1=[0, 10, 20, 0, 5])).orderBy("idx").collect()
    assert [(x["idx"], x["r"]) for x in r] == [(2, 100.0), (3, -100.0)]


def test_streaks_and_flat_series(spark):
    got = by_id(series.streaks(ticks(spark, a1=[1, 2, 3, 3, 4, 2, 1, 0.5], a2=[5, 5, 5])))
    assert tuple(got[1])[1:] == (3, 3, 2, 3) and tuple(got[2])[1:] == (0, 0, 0, 0)
    assert by_id(series.pattern(ticks(spark, a2=[5] * 8)))[2]["kind"] == "COMPRESSION"


def test_pattern_classes(spark):
    got = by_id(series.pattern(ticks(spark, a1=[100 * 1.02**i for i in range(20)], a2=[100 * 0.98**i for i in range(20)])))
    assert (got[1]["kind"], got[2]["kind"]) == ("UPTREND", "DOWNTREND")


def test_short_series_have_too_little_data(spark):
    got = by_id(scores.rfs_market(ticks(spark, a1=[1, 2, 3], a2=[100 + i * 0.1 for i in range(30)])))
    assert (got[1]["status"], got[1]["confidence"]) == ("INSUFFICIENT_DATA", 15.0)
    assert (got[2]["regime"], got[2]["status"]) == ("STABLE", "VALID")


def test_lead_returns_end_with_nulls(spark):
    got = series.lead_returns(ticks(spark, a1=[100, 110, 121]), (1, 2)).orderBy("idx").collect()
    assert [(r["return_1"], r["return_2"]) for r in got] == [(10.0, 21.0), (10.0, None), (None, None)]


@pytest.fixture(scope="module")
def snapshot(spark):
    rows = [(1, "AAA", "alpha", 1, 5.0, -5.0, 10.0, 3.0), (2, "BBB", "beta", 2, 6.0, None, 20.0, 2.0), (3, "CCC", "al%ha", None, 7.0, 1.0, None, 1.0)]
    return spark.createDataFrame(rows, "id long, symbol string, name string, rank long, price double, chg_24h_pct double, market_cap double, volume_24h double")


def test_search_is_literal_and_blank_takes_all(snapshot):
    assert [r["id"] for r in scan.search(snapshot, "L%H").collect()] == [3]
    assert scan.search(snapshot, "  ").count() == 3


def test_missing_numbers_sort_as_minus_one(snapshot):
    assert [r["id"] for r in scan.scan(snapshot, sort="chg_24h", order="desc").collect()] == [3, 2, 1]
    assert [r["id"] for r in scan.scan(snapshot).collect()] == [1, 2, 3]
    assert [r["id"] for r in scan.scan(snapshot, limit=1, cursor=1).collect()] == [2]
    assert tuple(scan.page_info(snapshot, None, 2, 2).first()) == (3, None)


def test_band_pairs_equal_nested_loop(spark):
    values = [0.0, 0.5, 1.9, 2.0, 4.1, -0.1, -1.9]
    df = spark.createDataFrame(list(enumerate(values)), "asset_id long, v double")
    pairs = [(r["a_asset_id"], r["b_asset_id"]) for r in matching.band_pairs(df, df, "v", 2.0).collect()]
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if abs(a - b) < 2}
    assert set(pairs) == want and len(pairs) == len(want)


def test_global_row_number(spark):
    df = spark.range(1000).select("id", (F.col("id") % 97).cast("double").alias("v"))
    got = {r["id"]: r["n"] for r in global_row_number(df, "v", "id", "n", 8).collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 97), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_provider_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id":" Bit ","symbol":"btc","name":"Bit","current_price":5.5,"market_cap_rank":1,"image":"ftp://x","sparkline_in_7d":{"price":[1.0,null,2.0]}}\n{"id":"","symbol":"x","name":"y"}\n')
    got = io.from_provider(io.provider_rows(spark, str(tmp_path / "m.json"))).collect()
    assert len(got) == 1 and (got[0]["id"], got[0]["symbol"], got[0]["sparkline_7d"], got[0]["logo_url"]) == ("bit", "BTC", [1.0, 2.0], None)


def test_stream_equals_table(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    whole = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    shaped = lambda e: e.select(F.col("user_id").alias("key"), F.lit("demo").alias("plan"), "ts")
    (tmp_path / "in").mkdir()
    whole.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("overwrite").parquet(str(tmp_path / "in"))
    live.run_once(live.usage_windows(shaped(live.event_stream(spark, str(tmp_path / "in"))), "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in live.usage_windows(shaped(whole), "1 hour").collect()}
    assert got <= want and len(want) - len(got) <= 20  # windows after the last watermark stay open


def test_observations_are_resolved(spark):
    records = spark.createDataFrame([(1, "open", None), (2, "open", None)], "id long, status string, observed_result_pct double")
    updates = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0)], "id long, ts long, observed_result_pct double")
    got = {r["id"]: (r["status"], r["observed_result_pct"]) for r in live.resolve_observations(records, updates).collect()}
    assert got == {1: ("resolved", 7.0), 2: ("open", None)}
