"""All queries of the decision engine by name. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import kernel
from tidepool.operators import aggregates, calibration, decisions, history, listing, matching, normalise, regulator, replay, scan, scan_engine, scores, series
from tidepool.plans.oracles_decisions import ON_MARKET, PAYLOAD
from tidepool.sources import tables
from tidepool.sources.stage import shared_dir, staged
from tidepool.sources.versions import Versions
from tidepool.streaming import live, stores

Query = Callable[[SparkSession, str], DataFrame]


def _on(source: Callable[[SparkSession, str], DataFrame], *steps: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        for step in steps:
            df = step(df)
        return df

    return query


#: Whether the query that is being built reads the market's series instead of the events'.
_MARKET: ContextVar[bool] = ContextVar("market", default=False)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (tables.market_ticks if _MARKET.get() else tables.price_tick)(spark, sf_dir)


def _on_market(query: Query) -> Query:
    def built(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _MARKET.set(True)
        try:
            return query(spark, sf_dir)
        finally:
            _MARKET.reset(before)

    return built


def _rfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.rfs_market(_ticks(spark, sf_dir), tables.market_facts(spark, sf_dir) if _MARKET.get() else None)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.market_gate(_rfs(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.funnel(_gated(spark, sf_dir)).select(*decisions.FUNNEL)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_samples(_decided(spark, sf_dir), F.col("asset_id"))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of which some break the contract, by rules on their number."""
    every = lambda k: F.col("seq") % k == 0
    return _samples(spark, sf_dir).withColumns({
        "decision": F.when(every(5), "MAYBE").otherwise(F.col("decision")), "version": F.when(every(7), " ").otherwise(F.col("version")), "support_probability": F.when(every(3), F.lit(None)).when(every(4), F.col("support_probability") + 100).otherwise(F.col("support_probability")),
        "neutralization_severity": F.when(every(6), "extreme").otherwise(F.col("neutralization_severity")),
    })


def _orchestrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in order of asset_id, each by thresholds that the samples before it set.

    What is stored of a decision's scores doesn't depend on its thresholds, so the thresholds of all come from one window.
    """
    gates = staged(_gated(spark, sf_dir))  # a row for each asset; read for the samples and for the decisions
    samples = decisions.decision_samples(decisions.funnel(gates).select(*decisions.FUNNEL), F.col("asset_id"))
    learnt = decisions.prior_thresholds(samples).select("asset_id", "n_prior", "maturity", *[f"{k}_threshold" for k in decisions.FALLBACK])
    gated = gates.join(learnt, "asset_id")
    return decisions.funnel(gated, {k: F.col(f"{k}_threshold") for k in decisions.FALLBACK}).select("asset_id", "n_prior", "maturity", *[f"{k}_threshold" for k in decisions.FALLBACK], "decision_score", "decision", "reason")


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.recovery_analysis(decisions.rupture_analysis(decisions.temporal_analysis(_rfs(spark, sf_dir))))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir)
    facts = None
    if _MARKET.get():  # the series take three shuffles of all points, which are gone when their facts and structure are worked out
        ticks = tables.spread(staged(ticks), tables.table(spark, sf_dir, "lineitem"))
        facts = tables.market_facts(spark, sf_dir, ticks=ticks)
    return staged(scores.rfs_market(ticks, facts).join(series.behavior_7d(ticks).select("asset_id", "behavior"), "asset_id").select(*matching.CONTEXT))  # read as queries and as contexts


def _queries(contexts: DataFrame) -> DataFrame:
    """The stated set of queries: contexts whose id is divisible by 100."""
    return contexts.where(F.col("asset_id") % 100 == 0)


COMPARED = "asset_id long, match_id long, regime_score double, behavior_score double, stability_score double, axes_score double, similarity double, weighted_similarity double, comparable boolean, reasons string"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = _contexts(spark, sf_dir)
    return matching.context_pairs(_queries(contexts), contexts, "asset_id long, match_id long, similarity double, weighted_similarity double, reasons string", only_comparable=True).where("asset_id <> match_id")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the contexts within reach of each query: a context's outcome is that of its newest window of three prices."""
    contexts, ticks = _contexts(spark, sf_dir), _ticks(spark, sf_dir)
    newest = series.occurrences(ticks, 3, 3).groupBy("asset_id").agg(F.max_by("continued", "start").alias("continued"), F.max("start").alias("start"))
    past = newest.select("asset_id", F.when(F.col("continued"), "CONTINUATION").otherwise("CORRECTION").alias("outcome"), (F.col("start") % 7).cast("double").alias("recency"))
    known = staged(contexts.join(past, "asset_id"))
    pairs = matching.context_pairs(_queries(contexts), known, f"asset_id long, match_id long, comparable boolean, weighted_similarity double, b_outcome string, b_recency double, {', '.join(f'b_{f} double' for f in matching.AXES)}")
    pairs = pairs.where("asset_id <> match_id").withColumnsRenamed({"b_outcome": "outcome", "b_recency": "recency"})
    return matching.outcome_statistics(pairs, "asset_id")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(tables.price_hist(spark, sf_dir))


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.month_segments(tables.price_hist(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.public_structure(tables.asset_snapshot(spark, sf_dir))


PUBLIC = ["id", "symbol", "name", "rank", "chg_24h_pct", "market_cap", "volume_24h"]


def _public(df: DataFrame) -> DataFrame:
    return df.select(*PUBLIC)


def _last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return scan.last_wins_join(tables.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", "o_orderkey")


def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return scan.collisions(part, F.concat_ws("|", F.lower("p_brand"), F.lower("p_type"), F.col("p_size").cast("string")))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = tables.asset_snapshot(spark, sf_dir)
    return scan.rejected_count(snap, snap.where("n_prices >= 25"), "id")


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("registry").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = tables.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("env").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return scan.preferred(c.unionByName(s), "key", F.desc("balance"), F.col("source"), F.col("id"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return tables.table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    return part.select("p_partkey", kernel.slug(F.col("p_name")).alias("slug"), kernel.clean_symbol(F.col("p_brand")).alias("symbol"), F.initcap(F.regexp_replace("p_type", "[-_]+", " ")).alias("title"), kernel.key_fingerprint(F.col("p_brand")).alias("fingerprint"), kernel.round2(F.col("p_retailprice") / 7).alias("share"))


def _usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.usage_event(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.with_quota(live.usage_windows(events, "1 day"), "day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.price_tick(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.live_windows(ticks, "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(scan.union_distinct(F.array("event_type", F.lit(None).cast("string")), F.array(F.lit("base"), F.lit(" ")), F.array("event_type")), ",").alias("warnings"))


def _impulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impulse scores of each history. Nothing here measures growth, core or decay: they are missing, and what stands in for them is the operators' to say."""
    x = history.impulse_state(_history(spark, sf_dir))
    return x.select("asset_id", *[F.col(f"impulse_{c}").alias(c) for c in ("pressure", "instability", "saturation", "exhaustion")], *[F.lit(None).cast("double").alias(c) for c in ("growth", "core", "decay")], F.col("impulse_state").alias("state"))


def _relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    impulses = staged(_impulses(spark, sf_dir))  # read for the policy and for the labels
    return calibration.relabelled(impulses, calibration.impulse_policy(impulses)).select("asset_id", "state", "adaptive_state")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with what else the reports read: continuity and the changes of a series' price."""
    facts = _rfs(spark, sf_dir).select("asset_id", "continuity")
    changes = listing.market_history(tables.price_tick(spark, sf_dir)).select("asset_id", "chg_24h_pct", "chg_7d_pct")
    return _decided(spark, sf_dir).join(facts, "asset_id").join(changes, "asset_id")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = tables.price_hist(spark, sf_dir).where("price > 0")
    shapes = hist.groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "price"))), lambda x: x["price"]).alias("p"))
    rates = aggregates.outcome_rates(series.occurrences(hist.withColumnRenamed("ts", "idx")))
    return calibration.pattern_decision(shapes, rates, _history(spark, sf_dir))


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints from each asset's newest day: noise as measured, quality as its complement, volatility and velocity from the day's prices."""
    day = _live(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("window_start")))).where("k = 1")
    trend = F.when(F.col("avg_price") > F.col("median_price"), "UP").when(F.col("avg_price") < F.col("median_price"), "DOWN").otherwise("FLAT")
    return calibration.live_hints(day.select("asset_id", (100 - F.col("noise") / 2).alias("quality_score"), F.col("noise").alias("noise_score"), (F.col("noise") / 3).alias("micro_volatility"), kernel.round2((F.col("avg_price") - F.col("median_price")) / 10).alias("price_velocity"), F.col("rupture").alias("micro_rupture"), trend.alias("trend")))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat_ws("|", F.col("id").cast("string"), "action", "market_regime", "status")
    return calibration.integrity_chain(tables.memory_record(spark, sf_dir), "symbol", F.struct("ts", "id"), payload, "secret")


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as provider rows of which some lack an id, a symbol or a name."""
    gone = lambda k, x: F.when(F.col("p_partkey") % k != 0, x)
    return listing.mapped_identity(tables.table(spark, sf_dir, "part").select(gone(3, F.concat(F.lit(" P-"), F.col("p_partkey").cast("string"))).alias("id"), gone(2, F.lower("p_brand")).alias("symbol"), gone(5, F.col("p_name")).alias("name")), "market")


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.access_policy(_decided(spark, sf_dir).withColumns({"symbol": F.when(F.col("asset_id") % 11 != 0, F.col("asset_id").cast("string")), "name": F.lit("series")}))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as versions of their order; a returned line deletes it."""
    line = tables.table(spark, sf_dir, "lineitem")
    return listing.latest_per_id(line.select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("version"), (F.col("l_returnflag") == "R").alias("deleted"), "l_quantity")).select("id", F.col("version.l_linenumber").alias("version"), "deleted", "l_quantity")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(tables.price_index(spark, sf_dir))


def _learnt_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds of e12, from samples that arrive as a stream."""
    return stores.played(_samples(spark, sf_dir), "seq", stores.online_thresholds, stores.THRESHOLDS)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan engine over the market's series without their dates; of every seventeenth only six prices are known."""
    ticks = tables.market_ticks(spark, sf_dir).where("asset_id % 17 <> 0 or idx < 6").select("asset_id", "idx", "price")
    return scan_engine.scanned(ticks, tables.market_facts(spark, sf_dir))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored decisions as JSON objects of the newer and the older names, some of them faulty, by rules on their number."""
    told = _samples(spark, sf_dir).selectExpr("seq", f"{PAYLOAD} AS payload")
    return normalise.normalised(told, "payload").withColumn("rejects", F.array_join("rejects", ","))


#: Decisions of a window of the flow regulator.
FLOW_WINDOW = 25


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regulator over the log of decisions, window by window."""
    axes = _rfs(spark, sf_dir).select("asset_id", *regulator.QUALITY)
    rows = _decided(spark, sf_dir).join(axes, "asset_id").withColumns({"version": F.lit("v8"), "horizon": F.lit("7D"), "seq": F.col("asset_id")})
    return regulator.regulated(decisions.numbered(rows).withColumn("window", F.floor(F.col("place") / FLOW_WINDOW)))


#: Records that the memory holds at most, and how many of the oldest go at a time.
MEMORY_MOST, MEMORY_BATCH = 10_000, 250
_FAR = 10_000_000_000


def _memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a versioned table: orders make them, in two writes; returned first lines resolve them; pending ones are deleted; then the oldest go."""
    store = Versions(spark, f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}", "id long, action string, status string, result double")
    store.create()
    record = tables.memory_record(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    made = record.select(F.lit("create").alias("op"), F.col("id").alias("seq"), "id", "action", F.lit("open").alias("status"), none("double").alias("result"))
    line = tables.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    seen = line.select(F.lit("observe").alias("op"), (F.col("l_orderkey") + 2 * _FAR).alias("seq"), F.col("l_orderkey").alias("id"), none("string").alias("action"), F.lit("resolved").alias("status"), kernel.round2(F.col("l_extendedprice") / 1000 - 30).alias("result"))
    gone = record.where("action = 'BLOCK'").select(F.lit("delete").alias("op"), (F.col("id") + 3 * _FAR).alias("seq"), "id", none("string").alias("action"), none("string").alias("status"), none("double").alias("result"))
    store.write(made.where("id % 3 <> 0"))
    store.write(made.where("id % 3 = 0").withColumn("seq", F.col("seq") + _FAR).unionByName(seen))
    store.write(gone)
    store.shed(MEMORY_MOST, MEMORY_BATCH)
    return store.read()


#: Time to live and places a shard of the store that the events write and read.
STORE_TTL, STORE_PLACES = 36 * 3_600_000_000, 20


def _store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases put, sign-ups delete and all other events read their user's entry."""
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "put").when(kind == "signup", "delete").otherwise("get")
    return tables.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("shard"), F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), "value")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.played(_store_events(spark, sf_dir), "ts", lambda s: stores.stored_reads(s, STORE_PLACES, STORE_TTL), stores.READS, late="1 hour", most=4 * stores.SLICE)


QUERIES: dict[str, Query] = {
    "w1_returns": _on(tables.price_tick, series.returns, lambda d: d.select("asset_id", "idx", kernel.round2(F.col("r")).alias("return_pct"))),
    "w2_w3_return_stats": _on(tables.price_tick, series.return_stats),
    "w4_streaks": _on(tables.price_tick, series.streaks),
    "w5_break_rate": _on(tables.price_tick, series.break_rate),
    "w6_shape": _on(tables.price_tick, series.shape),
    "w7_reversal": _on(tables.price_tick, series.reversal),
    "w8_w9_pattern": _on(tables.price_tick, series.pattern),
    "w11_month_segments": _on(_months, lambda d: d.select("asset_id", "year", "month", "n_prices", "first_price", "last_price", "min_price", "max_price", "slope_pct", "amplitude_pct", "instability", "break_rate", "kind", "quality", "duration")),
    "w12_quarters": _on(_months, series.quarters),
    "w13_temporal_blocks": _on(tables.price_hist, history.temporal_blocks),
    "w14_occurrences": _on(tables.price_tick, series.occurrences),
    "w16_lead_returns": _on(tables.price_tick, series.lead_returns, lambda d: d.select("asset_id", "idx", "return_24", "return_48", "return_72")),
    "w15_backtest_signals": _signals,
    "w18_market_history": _on(tables.price_tick, listing.market_history),
    "w21_priority": _on(_decided, lambda d: d.orderBy(*listing.by_priority(d)).limit(20).select("asset_id", "stability", "regime", "opportunity", "decision")),
    "p1_identity": _identities,
    "p10_normalised_samples": _on_market(_normalised),
    "f10_access_policy": _access,
    "j3_first_match": _on(tables.asset_snapshot, lambda d: listing.first_match(d, "brand#11-12", "id").select("id", "symbol", "name")),
    "o2_engine_sort": _on(_rfs, lambda d: d.orderBy(*listing.by_score("stability")).limit(30).select("asset_id", "stability")),
    "o7_top_opportunities": _on(_decided, lambda d: listing.top_opportunities(d.withColumn("rank", F.col("asset_id"))).select("asset_id", "score", "decision")),
    "a4_availability": _on(tables.asset_snapshot, listing.availability),
    "a31_summary_view": _on(_rfs, listing.summary_view),
    "a32_simple_distribution": _on(_decided, aggregates.decision_distribution, listing.simple_distribution),
    "k1_versioned_memory": _memory_store,
    "k3_bounded_log": _on(_samples, lambda d: listing.bounded_log(d, 50).select("seq", "decision", "decision_score")),
    "k7_current_state": _log,
    "w19_structure_7d": _on(_ticks, series.structure_7d),
    "w20_behavior_7d": _on(_ticks, series.behavior_7d),
    "w22_newest_per_key": _on(tables.memory_record, lambda d: scan.newest_per_key(d, "symbol", 3).select("id", "symbol", "action", "place")),
    "j1_last_wins_join": _last_wins,
    "j2_collisions": _collisions,
    "j4_compare_with_history": _on(tables.price_hist, history.compare_with_history),
    "j4_compare_month_to_month": _on(tables.price_hist, lambda d: history.compare_with_history(d, "MONTH_TO_MONTH")),
    "j5_context_matches": _matched,
    "j10_preferred_record": _preferred,
    "e1_rfs_market": _rfs,
    "e2_history": _on(_history, lambda d: d.select(*history.HISTORY)),
    "e3_impulse_state": _on(_history, history.impulse_state, lambda d: d.select(*history.IMPULSE)),
    "e6_temporal_analysis": _on(_rfs, decisions.temporal_analysis, lambda d: d.select("asset_id", *[f"t_{a}{x}" for a in decisions.TEMPORAL_AXES for x in ("", "_calibrated", "_probability")], "t_coherence", "t_structural", "t_support", F.array_join("t_warnings", ",").alias("t_warnings"))),
    "e7_rupture_analysis": _on(_analysed, lambda d: d.select("asset_id", "r_density", "r_turning", "r_anti_continuity", *[f"r_{a}{x}" for a in decisions.RUPTURE_AXES for x in ("", "_probability")], "r_coherence", "r_structural", "rupture_probability", "risk_rupture", F.array_join("r_warnings", ",").alias("r_warnings"))),
    "e8_recovery_analysis": _on(_analysed, lambda d: d.select("asset_id", "restart_support", "anti_rupture_pressure", "reconstruction_quality", "recovery_score", F.array_join("recovery_warnings", ",").alias("recovery_warnings"))),
    "e9_comparator": _on(_rfs, decisions.comparator, lambda d: d.withColumn("warnings", F.array_join("warnings", ","))),
    "e10_market_gate": _on(_gated, lambda d: d.select(*decisions.GATE)),
    "e11_decision_funnel": _decided,
    "e12_orchestrator": _orchestrated,
    "e4_adaptive_impulse": _relabelled,
    "e13_pattern_decision": _patterns,
    "e15_calibration_layer": _on(_rfs, calibration.calibration_layer),
    "e23_zone_decision": _on(_rfs, lambda d: calibration.zone_decision(d.select("asset_id", "regime", F.when(F.col("asset_id") % 9 != 0, F.col("structure")).alias("zone_score")))),
    "e26_live_hints": _hints,
    "k11_integrity_chain": _chains,
    "a7_assets_summary": _on(_reported, calibration.assets_summary),
    "a18_impulse_policy": _on(_impulses, staged, calibration.impulse_policy),
    "a20_impulse_governance": _on(_impulses, staged, calibration.impulse_policy, calibration.impulse_governance),
    "a21_decision_report": _on(_reported, calibration.decision_report),
    "a22_opportunity_report": _on(_decided, calibration.opportunity_report),
    "a23_threshold_report": _on(_decided, calibration.threshold_report),
    "a27_backtest_summary": _on(_signals, aggregates.backtest_summary),
    "a28_store_stats": _on(_samples, calibration.store_stats),
    "e14_context_comparison": _on(_contexts, lambda d: matching.context_pairs(_queries(d), d, COMPARED)),
    "e22_public_structure": _labelled,
    "e24_simple_decision": _on(_rfs, scores.simple_decision),
    "e25_stability_index": _on(tables.asset_snapshot, scores.stability_index),
    "p17_zones": _on(tables.asset_snapshot, scores.zones),
    "a1_market_summary": _on(tables.asset_snapshot, aggregates.market_summary),
    "a2_decision_summary": _on(_decided, aggregates.decision_summary),
    "a3_market_state": _on(tables.asset_snapshot, aggregates.market_state),
    "a5_market_context": _on(_rfs, aggregates.market_context),
    "a6_structure_summary": _on(_labelled, aggregates.structure_summary),
    "a8_memory_stats": _on(tables.memory_record, aggregates.memory_stats),
    "a9_by_action": _on(tables.memory_record, aggregates.by_action),
    "a10_by_regime": _on(tables.memory_record, aggregates.by_regime),
    "a11_decision_distribution": _on(_decided, aggregates.decision_distribution),
    "a12_reason_histogram": _on(_decided, aggregates.reason_histogram),
    "a13_calibration_policy": _on(_samples, decisions.policy_samples, decisions.calibration_policy),
    "a15_calibration_summary": _on(_samples, decisions.calibration_summary),
    "a17_adaptive_thresholds": _on(_decided, decisions.adaptive_thresholds),
    "a19_score_stats": _on(_decided, aggregates.score_stats),
    "a24_outcome_statistics": _outcomes,
    "a25_outcome_rates": _on(tables.price_tick, series.occurrences, aggregates.outcome_rates),
    "a29_usage_totals": _on(tables.usage_event, aggregates.usage_totals),
    "a29_usage_by_endpoint": _on(tables.usage_event, aggregates.usage_by_endpoint),
    "f1_search": _on(tables.ranked_snapshot, lambda d: scan.search(d, "Brand#1"), _public),
    "f2_asset_issues": _on(tables.asset_snapshot, scan.asset_issues, lambda d: d.select("id", F.array_join("issues", ",").alias("issues"))),
    "f4_sample_issues": _on(_faulty, decisions.sample_issues, lambda d: d.select("seq", F.array_join("issues", ",").alias("issues"))),
    "f5_policy_samples": _on(_faulty, decisions.policy_samples, lambda d: d.select("seq", "regime", "decision", "decision_score")),
    "o1_scan_page": _on(tables.ranked_snapshot, lambda d: scan.scan(d, sort="chg_24h", order="desc", limit=50, cursor=25), _public),
    "o4_page_info": _on(tables.asset_snapshot, lambda d: scan.page_info(d, None, 50, 25)),
    "o5_top_volume": _on(tables.ranked_snapshot, lambda d: scan.top_by(d, "volume"), _public),
    "o6_highlights": _on(_labelled, scan.highlights, lambda d: d.select("id", "symbol", "transition")),
    "o8_top_movers": _on(tables.ranked_snapshot, scan.top_movers, _public),
    "u1_union_distinct": _warnings,
    "u3_rejected_count": _rejected,
    "x_json": _json,
    "x_scalars": _scalars,
    "t1_usage_windows": _usage_windows,
    "t2_live_windows": _live,
    "e5_scan_engine": _scanned,
    "e16_flow_regulator": _on_market(_flow),
    "t4_expiring_store": _stored,
    "t4_expiring_store_table": _on(_store_events, lambda d: stores.stored_reads(d, STORE_PLACES, STORE_TTL)),
    "t8_online_thresholds": _on_market(_learnt_online),
}

QUERIES |= {f"{name}_market": _on_market(QUERIES[name]) for name in ON_MARKET}
#: Of the market all contexts are compared with all.
QUERIES["e14_context_comparison_market"] = _on_market(_on(_contexts, lambda d: matching.context_pairs(d, d, COMPARED)))
