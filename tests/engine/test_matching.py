import random

from tidepool.operators import matching
from tidepool.plans import queries

PAIRS = "asset_id long, match_id long, regime_score double, behavior_score double, stability_score double, axes_score double, similarity double, weighted_similarity double, comparable boolean, reasons string"


def contexts(spark, n):
    rnd = random.Random(5)
    axis = lambda: rnd.choice([None, float("nan"), float("inf"), -7.0, 130.0, *[round(rnd.uniform(0, 100), 2) for _ in range(20)]])
    rows = [(i, rnd.choice(["STABLE", "TRANSITION", "VOLATILE", "OTHER", None]), rnd.choice([None, *[round(rnd.uniform(0, 60), 2) for _ in range(20)]]), rnd.choice(["PUMA", "KANGAROO", "SERPENT"]), *[axis() for _ in range(5)]) for i in range(n)]
    return spark.createDataFrame(rows, "asset_id long, regime string, stability double, behavior string, " + ", ".join(f"{f} double" for f in matching.AXES))


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    df = contexts(spark, 120)
    some = df.where("asset_id % 10 = 0")
    monkeypatch.setattr(matching, "ROWS", 5)
    monkeypatch.setattr(matching, "PAIRS", 100)
    monkeypatch.setattr(matching, "AT_ONCE", 32)
    got = matching.context_pairs(some, df, PAIRS)
    assert got.rdd.getNumPartitions() == 3 * 5  # blocks grow with the pairs
    names = [c.split(" ")[0] for c in PAIRS.split(", ")]
    whole = matching.compared(matching.band_pairs(some, df, "stability", matching.GAP)).selectExpr("a_asset_id AS asset_id", "b_asset_id AS match_id", *names[2:-1], "array_join(reasons, ',') AS reasons")
    table = lambda d: sorted(tuple(r) for r in d.select(names).collect())
    assert table(got) == table(whole) and len(table(got)) > 300
    assert table(matching.context_pairs(some, df, PAIRS, only_comparable=True)) == table(whole.where("comparable"))
    kept = matching.context_pairs(some, df, "asset_id long, match_id long, b_duration double").where("match_id = 3").first()
    assert kept["b_duration"] == df.where("asset_id = 3").first()["duration"] or kept["b_duration"] is None


def test_what_is_moved_grows_with_the_contexts(spark, monkeypatch):
    """No row is repeated for the blocks it meets; of many blocks a task takes several."""
    df = contexts(spark, 120)
    table = lambda d: sorted(map(tuple, d.collect()))
    whole = table(matching.context_pairs(df, df, PAIRS))
    monkeypatch.setattr(matching, "ROWS", 5)
    monkeypatch.setattr(matching, "PAIRS", 50)
    monkeypatch.setattr(matching, "PARTS", (3, 2), raising=False)
    got = matching.context_pairs(df, df, PAIRS)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() == 3 * 2
    assert table(got) == whole and len(whole) > 3000


def test_none_match_nothing(spark):
    df = contexts(spark, 20)
    assert matching.context_pairs(df.limit(0), df, PAIRS).count() == 0 and matching.context_pairs(df, df.limit(0), PAIRS).count() == 0


def test_the_market_compares_all_contexts_with_all(spark):
    sf_dir = "/root/testdata/sf0.001"
    ids = {r["asset_id"] for r in queries._on_market(queries._contexts)(spark, sf_dir).select("asset_id").collect()}
    got = queries.QUERIES["e14_context_comparison_market"](spark, sf_dir).select("asset_id", "match_id").collect()  # of some columns, too
    pairs = {(r["asset_id"], r["match_id"]) for r in got}
    assert any(i % 100 for i in ids) and {(i, i) for i in ids} <= pairs and len(pairs) == len(got)
    assert {(b, a) for a, b in pairs} == pairs
