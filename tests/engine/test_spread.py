from tidepool.sources import tables


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A task's share of the series stays the same as the table grows."""
    monkeypatch.setattr(tables, "ROWS", 50)
    spark.range(230).selectExpr("id AS l_orderkey", "id AS l_partkey", "id % 40 AS l_suppkey", "1 AS l_linenumber", "1D AS l_quantity", "2D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    hist = tables.price_hist(spark, str(tmp_path))
    assert hist.rdd.getNumPartitions() == 5 and hist.count() == 230
    assert tables.market_ticks(spark, str(tmp_path)).rdd.getNumPartitions() == 5
