from pyspark.sql import functions as F

from tidepool.functions import kernel


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x double").select(expr(F.col("x")).alias("y")).first()["y"]


def test_rounding_is_half_up_on_the_binary_product(spark):
    for x, y in ((1.005, 1.0), (2.675, 2.68), (-0.125, -0.12), (0.145, 0.14), (None, 0.0), (float("nan"), 0.0), (float("inf"), 0.0)):
        assert one(spark, kernel.round2, x) == y


def test_clamp_score(spark):
    for x, y in ((-3.0, 0.0), (250.0, 100.0), (float("inf"), 0.0), (None, 0.0), (33.335, 33.34)):
        assert one(spark, kernel.clamp_score, x) == y


def test_finite(spark):
    for x, y in ((float("inf"), None), (float("-inf"), None), (float("nan"), None), (None, None), (-12.25, -12.25), (0.1, 0.1)):
        assert one(spark, kernel.finite, x) == y


def test_percentiles_of_counts(spark):
    df = spark.createDataFrame([("a", 4.0, 1), ("a", 1.0, 1), ("a", 3.0, 1), ("a", 2.0, 1), ("b", 7.0, 3)], "k string, x double, n long")
    assert sorted(tuple(r) for r in kernel.percentile_of_counts(df, {"a": 0.75, "b": 0.5}).collect()) == [("a", 3.0, 4), ("b", 7.0, 3)]
    assert kernel.percentile_of_counts(df.limit(0), {"a": 0.75}).count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([(" Ab--C d! ", "a-b.9", " YES ")], "a string, b string, c string")
    assert tuple(df.select(kernel.slug(F.col("a")), kernel.clean_symbol(F.col("b")), kernel.parse_bool(F.col("c"))).first()) == ("ab-c-d", "AB9", True)
