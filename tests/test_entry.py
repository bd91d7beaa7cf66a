import __spark_entry__ as entry


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 55


def test_smoke(spark):
    assert entry.entry(spark).count() > 0
