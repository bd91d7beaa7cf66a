import re

from tidepool.operators import series


def found_code(spark, df):
    return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")


def test_windows_are_classed_by_code_that_the_jvm_compiles(spark):
    """Methods of more than 8,000 bytes stay interpreted; windows of all sizes share one expression, which is shorter."""
    ticks = spark.createDataFrame([(1, i, float(10 + i * 7 % 5)) for i in range(9)], "asset_id long, idx long, price double")
    found = series.occurrences(ticks)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans that may change show no code
    try:
        code = found_code(spark, series.occurrences(ticks))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000 and "explode" in code
    assert found.count() == 6 + 5 + 4 + 3


def test_windows_of_one_size(spark):
    """Windows of three prices alone: too short for three moves in a row."""
    ticks = spark.createDataFrame([(1, i, float(10 + i)) for i in range(6)], "asset_id long, idx long, price double")
    assert [r.kind for r in series.occurrences(ticks, 3, 3).orderBy("start").collect()] == ["BREAKOUT"] * 3
