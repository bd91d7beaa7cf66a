from tidepool.plans import queries
from tidepool.sources import stage, tables


def test_the_markets_series_are_worked_out_once(spark, monkeypatch):
    """Structure, behaviour and facts of the contexts read one table of the series."""
    made, ticks = [], tables.market_ticks
    monkeypatch.setattr(tables, "market_ticks", lambda *a: made.append(1) or ticks(*a))
    assert queries._on_market(queries._contexts)(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1


def test_shuffles_go_when_their_table_is_written(spark):
    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, cleans = kept(), spark.conf.get(stage._CLEAN, None) if hasattr(stage, "_CLEAN") else None
    table = stage.staged(spark.range(100).repartition(3))
    assert kept() <= before and table.count() == 100
    assert (spark.conf.get(stage._CLEAN, None)) == cleans  # for this write alone
