"""DuckDB SQL that the engine's queries must agree with, row for row. Written from the definitions, not from the plans."""

from __future__ import annotations


def r2(x: str) -> str:
    return f"floor(coalesce({x}, 0e0) * 100 + 0.5e0) / 100"


def cl(x: str) -> str:
    return f"floor(least(100e0, greatest(0e0, coalesce({x}, 0e0))) * 100 + 0.5e0) / 100"


def within(x: str, low: float, high: float) -> str:
    return f"greatest({low}e0, least({high}e0, {x}))"


TICK = "tick AS (SELECT user_id AS asset_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts, value AS price FROM events)"
RET = "ret AS (SELECT asset_id, idx, price, (price - prev) / abs(prev) * 100 AS r FROM (SELECT *, lag(price) OVER (PARTITION BY asset_id ORDER BY idx) AS prev FROM tick) WHERE prev IS NOT NULL AND prev <> 0)"
STATS = f"""turns AS (SELECT *, lag(r) OVER (PARTITION BY asset_id ORDER BY idx) AS b, sum(CASE WHEN abs(r) < 1.4e0 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY idx) AS island FROM ret),
islands AS (SELECT asset_id, island, sum(CASE WHEN abs(r) < 1.4e0 THEN 1 ELSE 0 END) AS run FROM turns GROUP BY ALL),
stats AS (SELECT t.asset_id, count(*) AS n_returns, CAST(sum(CASE WHEN r * b < 0 THEN 1 ELSE 0 END) AS BIGINT) AS direction_changes, CAST(sum(CASE WHEN abs(r) >= 2.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS rupture_events,
 CAST((SELECT max(run) FROM islands i WHERE i.asset_id = t.asset_id) AS BIGINT) AS stable_run_length, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ups, CAST(sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) AS BIGINT) AS downs,
 {r2("avg(abs(r))")} AS avg_abs_return, CASE WHEN count(*) < 2 THEN 0e0 ELSE {r2("stddev_pop(r)")} END AS volatility FROM turns t GROUP BY t.asset_id)"""
SHAPE = f"""shape0 AS (SELECT asset_id, count(*) AS n_prices, arg_min(price, idx) AS first_price, arg_max(price, idx) AS last_price, min(price) AS min_price, max(price) AS max_price FROM tick GROUP BY asset_id),
shape AS (SELECT *, {r2("CASE WHEN first_price = 0 THEN 0e0 ELSE (last_price - first_price) / abs(first_price) * 100 END")} AS slope_pct, {r2("CASE WHEN min_price <= 0 THEN 0e0 ELSE (max_price - min_price) / min_price * 100 END")} AS amplitude_pct FROM shape0)"""
def signed(source: str, keys: str, order: str, name: str) -> str:
    """Signatures of the series of a relation (keys, price, order)."""
    k = f"PARTITION BY {keys}"
    return f"""{name}_r AS (SELECT *, CASE WHEN lag(price) OVER ({k} ORDER BY {order}) <> 0 THEN (price - lag(price) OVER ({k} ORDER BY {order})) / abs(lag(price) OVER ({k} ORDER BY {order})) * 100 END AS r FROM {source}),
{name}_b AS (SELECT *, last_value(r IGNORE NULLS) OVER ({k} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, count(r) OVER ({k} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS k, count(r) OVER ({k}) AS n_r FROM {name}_r),
{name}_g AS (SELECT {keys}, count(*) AS n_prices, max(n_r) AS n_r, arg_min(price, {order}) AS first_price, arg_max(price, {order}) AS last_price, min(price) AS min_price, max(price) AS max_price, min({order}) AS t0, max({order}) AS t1, stddev_pop(r) AS sd, {r2("avg(CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN CASE WHEN r * b < 0 OR abs(r - b) >= 4 THEN 1e0 ELSE 0e0 END END)")} AS break_rate, avg(CASE WHEN k <= floor(n_r / 2) THEN r END) AS m1, avg(CASE WHEN k > floor(n_r / 2) THEN r END) AS m2 FROM {name}_b GROUP BY {keys}),
{name}_m AS (SELECT *, {r2("CASE WHEN first_price = 0 THEN 0e0 ELSE (last_price - first_price) / abs(first_price) * 100 END")} AS slope_pct, {r2("CASE WHEN min_price <= 0 THEN 0e0 ELSE (max_price - min_price) / min_price * 100 END")} AS amplitude_pct, coalesce(n_r >= 4 AND sign(m1) * sign(m2) < 0, false) AS reversal FROM {name}_g),
{name}_i AS (SELECT *, CASE WHEN n_r = 0 THEN 0e0 ELSE {r2(within("sd / 12 * 100", 0, 100) + " * 0.7e0 + " + within("amplitude_pct / 40 * 100", 0, 100) + " * 0.3e0")} END AS instability FROM {name}_m),
{name} AS (SELECT *, CASE WHEN n_prices < 3 THEN 'RANGE' WHEN reversal AND amplitude_pct >= 4 THEN 'REVERSAL' WHEN amplitude_pct <= 6 AND abs(slope_pct) <= 2 AND instability <= 35 THEN 'COMPRESSION' WHEN abs(slope_pct) <= 3 AND amplitude_pct <= 12 AND break_rate <= 0.45e0 THEN 'RANGE' WHEN slope_pct >= 3 THEN 'UPTREND' WHEN slope_pct <= -3 THEN 'DOWNTREND' ELSE 'RANGE' END AS kind,
 CASE WHEN n_prices < 3 THEN 0e0 ELSE {cl(within("abs(slope_pct) * 8", 0, 100) + " * 0.26e0 + (100 - " + within("break_rate * 100", 0, 100) + ") * 0.32e0 + (100 - " + within("instability", 0, 100) + ") * 0.28e0 + (100 - " + within("amplitude_pct / 45 * 100", 0, 100) + ") * 0.14e0")} END AS quality, {cl("abs(slope_pct) * 2 - break_rate * 40")} AS bias FROM {name}_i)"""


PATTERN = signed("tick", "asset_id", "idx", "pat")


def _window(k: int) -> str:
    """Windows of k prices: p1 to pk are the prices, nx the next one."""
    p = [f"p{i}" for i in range(1, k + 1)]
    lags = ", ".join([f"lag(price, {k - i}) OVER o AS p{i}" for i in range(1, k)] + [f"price AS p{k}"])
    ups, downs = (" + ".join(f"CASE WHEN {b} {op} {a} THEN 1 ELSE 0 END" for a, b in zip(p, p[1:])) for op in (">", "<"))
    streak = lambda op: " OR ".join([f"({p[i + 1]} {op} {p[i]} AND {p[i + 2]} {op} {p[i + 1]} AND {p[i + 3]} {op} {p[i + 2]})" for i in range(k - 3)] or ["false"])
    mean = f"(({' + '.join(p)}) / {k})"
    sd = f"sqrt(({' + '.join(f'({x} - mean) * ({x} - mean)' for x in p)}) / {k})"
    return f"""SELECT asset_id, start, {k} AS size, CASE WHEN ({streak('>')}) AND change > 0 THEN 'UP_STREAK' WHEN ({streak('<')}) AND change < 0 THEN 'DOWN_STREAK' WHEN {sd} < mean * 0.01e0 THEN 'COMPRESSION' WHEN change > 4 AND ({ups}) > ({downs}) * 1.5e0 THEN 'BREAKOUT' WHEN change < -4 AND ({downs}) > ({ups}) * 1.5e0 THEN 'BREAKDOWN' WHEN off < 1.5e0 THEN 'MEAN_REVERTING' WHEN {sd} > mean * 0.04e0 THEN 'CHAOTIC' ELSE 'MIXED' END AS kind, {r2(within('100 - off * 8', 0, 100))} AS similarity, nx >= p{k} AS continued
 FROM (SELECT *, (p{k} - p1) / p1 * 100 AS change, abs((p{k} - mean) / mean * 100) AS off FROM (SELECT *, {mean} AS mean FROM (SELECT asset_id, place - {k - 1} AS start, n, {lags}, lead(price) OVER o AS nx FROM priced WINDOW o AS (PARTITION BY asset_id ORDER BY idx)) WHERE p1 IS NOT NULL AND nx IS NOT NULL AND n >= 5))"""


OCC = "priced AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY asset_id) AS n FROM tick WHERE price > 0), occ AS (" + " UNION ALL ".join(_window(k) for k in range(3, 7)) + ")"
HIST = f"hist AS (SELECT l_suppkey AS asset_id, l_shipdate AS ts, {r2('avg(l_extendedprice / l_quantity)')} AS price FROM lineitem GROUP BY ALL)"
_DURATION = "CASE WHEN t1 <= t0 THEN 0e0 ELSE " + cl("least(date_diff('microsecond', t0, t1) / 86400000000e0, 120e0) / 120 * 100") + " END AS duration"
MONTHS = f"{HIST}, dated AS (SELECT *, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month FROM hist WHERE price > 0), {signed('dated', 'asset_id, year, month', 'ts', 'mon')}, months AS (SELECT *, {_DURATION} FROM mon WHERE n_prices >= 4)"
SNAP = f"""line AS (SELECT l_partkey AS id, l_extendedprice / l_quantity AS price, l_extendedprice AS volume, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity, l_extendedprice)),
shaped AS (SELECT id, max(n) AS n, max(CASE WHEN k = n THEN price END) AS price, max(CASE WHEN k = n - 1 THEN price END) AS prev, max(CASE WHEN k = 1 THEN price END) AS first, min(price) AS low, max(price) AS high, {r2("sum(volume)")} AS market_cap, {r2("sum(CASE WHEN k > n - 5 THEN volume END)")} AS volume_24h FROM line GROUP BY id),
snap AS (SELECT s.id, upper(p_brand) || '-' || CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name, price, CASE WHEN n > 1 THEN CASE WHEN prev = 0 THEN 0e0 ELSE (price - prev) / abs(prev) * 100 END END AS chg_24h_pct, CASE WHEN n > 1 THEN CASE WHEN first = 0 THEN 0e0 ELSE (price - first) / abs(first) * 100 END END AS chg_7d_pct, market_cap, volume_24h, n AS n_prices, low, high, row_number() OVER (ORDER BY market_cap DESC, s.id) AS rank FROM shaped s JOIN part ON p_partkey = s.id)"""
PUBLIC = "id, symbol, name, rank, chg_24h_pct, market_cap, volume_24h"
LABEL = f"""lab0 AS (SELECT id, symbol, volume_24h, coalesce(chg_24h_pct, 0e0) AS d, coalesce(chg_7d_pct, 0e0) AS w, CASE WHEN price > 0 THEN {r2("(high - low) / price * 100")} ELSE 0e0 END AS amplitude, CASE WHEN market_cap IS NULL OR market_cap <= 0 THEN 'Unknown' WHEN volume_24h / market_cap >= 0.08e0 THEN 'High' WHEN volume_24h / market_cap >= 0.025e0 THEN 'Normal' ELSE 'Low' END AS activity FROM snap),
lab1 AS (SELECT *, CASE WHEN w >= 1 THEN 'up' WHEN w <= -1 THEN 'down' ELSE 'flat' END AS direction FROM lab0),
lab AS (SELECT id, symbol, volume_24h, amplitude, activity, direction, CASE WHEN abs(d) >= 7 OR abs(w) >= 18 OR amplitude >= 18 THEN 'Fragmented' WHEN d > 0.4e0 AND w > 1.5e0 AND direction = 'up' AND activity = 'High' THEN 'Active Expansion' WHEN d > 0.2e0 AND w > 1 AND direction = 'up' THEN 'Expansion' WHEN d > 0.2e0 AND w < -1 AND direction <> 'down' THEN 'Recovery' WHEN abs(d) <= 0.2e0 AND abs(w) <= 0.8e0 AND amplitude <= 1.5e0 AND direction = 'flat' THEN 'Compression' WHEN abs(d) <= 1.5e0 AND abs(w) <= 5 AND amplitude <= 8 THEN 'Stable' ELSE 'Neutral' END AS transition FROM lab1)"""
MEMORY = f"""mem AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey AS symbol, CASE o_orderstatus WHEN 'F' THEN 'ALLOW' WHEN 'O' THEN 'WATCH' ELSE 'BLOCK' END AS action, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'VOLATILE' WHEN left(o_orderpriority, 1) = '3' THEN 'TRANSITION' ELSE 'STABLE' END AS market_regime, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END AS status, CASE WHEN o_orderstatus <> 'P' THEN {r2("o_totalprice / 1000 - 100")} END AS res FROM orders)"""
USAGE = "use AS (SELECT user_id AS key, event_type AS endpoint, ['internal', 'demo', 'trader', 'pro', 'enterprise'][CAST(user_id % 5 AS INT) + 1] AS plan, ts, event_id FROM events)"

# Market structure by layers: each rounds its own terms.
RFS = f"""f0 AS (SELECT s.asset_id, n_prices, coalesce(n_returns, 0) AS n, CASE WHEN first_price = 0 THEN 0e0 ELSE (last_price - first_price) / abs(first_price) * 100 END AS net, slope_pct AS day, slope_pct AS week, coalesce(direction_changes, 0) AS direction_changes, coalesce(rupture_events, 0) AS rupture_events, coalesce(stable_run_length, 0) AS stable_run_length, coalesce(avg_abs_return, 0e0) AS avg_abs, coalesce(volatility, 0e0) AS vol, CASE WHEN coalesce(n_returns, 0) > 0 THEN greatest(ups, downs) / n_returns ELSE 0e0 END AS dominant, CASE WHEN coalesce(n_returns, 0) > 0 THEN direction_changes / n_returns ELSE 1e0 END AS turn_ratio, CASE WHEN coalesce(n_returns, 0) > 0 THEN rupture_events / n_returns ELSE 1e0 END AS rupture_ratio, 20e0 AS liquidity FROM shape s LEFT JOIN stats USING (asset_id)),
f1 AS (SELECT *, CASE WHEN day = 0 OR net = 0 THEN 'NEUTRAL' WHEN sign(net) * sign(day) < 0 THEN 'OPPOSED' ELSE 'ALIGNED' END AS alignment FROM f0),
f2 AS (SELECT *, CASE WHEN alignment = 'ALIGNED' THEN {cl("least(12e0, abs(day) * 1.5e0)")} ELSE 0e0 END AS bonus, CASE WHEN alignment = 'OPPOSED' THEN {cl("least(18e0, abs(day) * 2)")} ELSE 0e0 END AS penalty, CASE WHEN n > 0 THEN {cl("stable_run_length / n * 100")} ELSE 0e0 END AS duration, CASE WHEN rupture_events > 0 THEN least(100e0, (rupture_events + 1) * 12e0) ELSE 35e0 END AS presence, {cl("dominant * 100")} AS dom_s, {cl("turn_ratio * 100")} AS turn_s, {cl("least(100e0, abs(net) * 8)")} AS trend_s, {cl("100 - least(100e0, abs(week - net) * 8)")} AS week_fit, CASE WHEN week = 0 OR day = 0 THEN 55e0 WHEN sign(week) = sign(day) THEN 85e0 ELSE 20e0 END AS same FROM f1),
f3 AS (SELECT *, CASE WHEN n > 0 THEN {cl("presence * 0.45e0 + duration * 0.55e0")} ELSE 0e0 END AS occurrence, {cl("dom_s * 0.4e0 + CASE alignment WHEN 'ALIGNED' THEN 100e0 WHEN 'NEUTRAL' THEN 55e0 ELSE 15e0 END * 0.25e0 + trend_s * 0.2e0 + (100 - turn_s) * 0.15e0")} AS convergence, {cl("100 - rupture_ratio * 55 - turn_ratio * 35 - avg_abs * 6")} AS frequency, {cl("CASE alignment WHEN 'ALIGNED' THEN 100e0 WHEN 'NEUTRAL' THEN 55e0 ELSE 10e0 END * 0.3e0 + week_fit * 0.3e0 + same * 0.2e0 + liquidity * 0.2e0")} AS correlation FROM f2),
f4 AS (SELECT *, {cl("occurrence * 0.18e0 + convergence * 0.24e0 + duration * 0.2e0 + frequency * 0.22e0 + correlation * 0.16e0")} AS structure, {cl("rupture_ratio * 55 + turn_ratio * 20 + avg_abs * 6 + vol * 8 + penalty")} AS rupture, {cl("occurrence * 0.18e0 + convergence * 0.24e0 + duration * 0.22e0 + frequency * 0.2e0 + correlation * 0.16e0 + bonus")} AS stability, {cl("net * 4 + 50")} AS mid_term FROM f3),
rfs AS (SELECT asset_id, n_prices AS sample_size, CAST(greatest(1, CASE WHEN rupture_events > 0 THEN rupture_events + 1 ELSE 1 END) AS BIGINT) AS pattern_count, direction_changes, rupture_events, stable_run_length, dom_s AS dominant_direction_ratio, liquidity, alignment, occurrence, convergence, duration, frequency, correlation, structure, rupture, stability, mid_term, {cl("100 - rupture + bonus")} AS continuity, CASE WHEN n_prices < 5 THEN 15e0 ELSE {cl("stability * 0.25e0 + structure * 0.2e0 + correlation * 0.15e0 + duration * 0.15e0 + liquidity * 0.1e0 + (100 - rupture) * 0.15e0")} END AS confidence,
 CASE WHEN stability >= 70 AND rupture <= 30 AND frequency >= 60 AND convergence >= 60 THEN 'STABLE' WHEN stability < 40 OR rupture >= 65 OR frequency < 35 THEN 'VOLATILE' ELSE 'TRANSITION' END AS regime, CASE WHEN n_prices < 5 THEN 'INSUFFICIENT_DATA' WHEN structure < 40 OR stability < 40 THEN 'WEAK_STRUCTURE' ELSE 'VALID' END AS status, CASE WHEN week >= 4 THEN 'FAVORABLE' WHEN week <= -4 THEN 'UNFAVORABLE' ELSE 'NEUTRAL' END AS mid_term_state FROM f4)"""
#: The same with the changes and the liquidity that facts tell, where there are any.
_FACTS = {
    "slope_pct AS day, slope_pct AS week": "f.day, f.week",
    "20e0 AS liquidity FROM shape s LEFT JOIN stats USING (asset_id))": f"CASE WHEN cap IS NULL OR vol24 IS NULL OR cap <= 0 THEN 20e0 ELSE {cl('least(100e0, vol24 / cap * 1000)')} END AS liquidity FROM shape s LEFT JOIN stats USING (asset_id) LEFT JOIN facts f USING (asset_id))",
    "CASE WHEN day = 0 OR net = 0 THEN 'NEUTRAL'": "CASE WHEN day IS NULL THEN 'UNAVAILABLE' WHEN day = 0 OR net = 0 THEN 'NEUTRAL'",
    "WHEN 'NEUTRAL' THEN 55e0 ELSE 15e0 END": "WHEN 'NEUTRAL' THEN 55e0 WHEN 'UNAVAILABLE' THEN 40e0 ELSE 15e0 END",
    "WHEN 'NEUTRAL' THEN 55e0 ELSE 10e0 END": "WHEN 'NEUTRAL' THEN 55e0 WHEN 'UNAVAILABLE' THEN 35e0 ELSE 10e0 END",
    f"{cl('100 - least(100e0, abs(week - net) * 8)')} AS week_fit, CASE WHEN week = 0": f"CASE WHEN week IS NULL THEN 35e0 ELSE {cl('100 - least(100e0, abs(week - net) * 8)')} END AS week_fit, CASE WHEN week IS NULL OR day IS NULL THEN 35e0 WHEN week = 0",
}
MARKET_RFS = RFS
for _old, _new in _FACTS.items():
    assert _old in MARKET_RFS, _old
    MARKET_RFS = MARKET_RFS.replace(_old, _new)
_CENTS = "CAST(sum(CAST(round(price * 100) AS BIGINT)) OVER w AS DOUBLE) / (count(*) OVER w * 100)"
MARKET_TICK = f"""daily AS (SELECT l_suppkey AS asset_id, l_shipdate AS ts, {r2('avg(l_extendedprice / l_quantity)')} AS price FROM lineitem GROUP BY ALL),
indexed AS (SELECT asset_id, ts, {r2(_CENTS)} AS price FROM daily WINDOW w AS (PARTITION BY asset_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
tick AS (SELECT year(ts) * 1000000 + asset_id AS asset_id, row_number() OVER (PARTITION BY asset_id, year(ts) ORDER BY ts) - 1 AS idx, ts, price FROM indexed),
sold AS (SELECT year(l_shipdate) * 1000000 + l_suppkey AS asset_id, l_shipdate AS ts, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL),
lately AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY idx DESC) - 1 AS back FROM tick),
facts AS (SELECT asset_id, (max(price) FILTER (back = 0) - max(price) FILTER (back = 1)) / abs(max(price) FILTER (back = 1)) * 100 AS day, (max(price) FILTER (back = 0) - max(price) FILTER (back = 7)) / abs(max(price) FILTER (back = 7)) * 100 AS week, any_value(cap) AS cap, any_value(vol24) AS vol24 FROM lately JOIN (SELECT asset_id, sum(cents) / 100e0 AS cap, arg_max(cents, ts) / 100e0 AS vol24 FROM sold GROUP BY asset_id) USING (asset_id) WHERE asset_id % 10 <> 0 GROUP BY asset_id)"""


def on_market(sql: str) -> str:
    """A query over the events' series, over the market's."""
    assert TICK in sql
    return sql.replace(TICK, MARKET_TICK).replace(RFS, MARKET_RFS)


GATE = f"""g0 AS (SELECT *, {cl("convergence * 0.5e0 + correlation * 0.5e0")} AS market_convergence FROM rfs),
g1 AS (SELECT *, {cl("stability * 0.5e0 + market_convergence * 0.3e0 + (100 - rupture) * 0.2e0")} AS opportunity, {cl("rupture * 0.38e0")} AS toll FROM g0),
g2 AS (SELECT *, {cl("100 - abs(stability - market_convergence) * 0.35e0 - abs(market_convergence - opportunity) * 0.25e0 - abs(stability - opportunity) * 0.2e0")} AS agreement FROM g1),
g3 AS (SELECT *, {cl("stability * 0.28e0 + market_convergence * 0.24e0 + frequency * 0.16e0 + duration * 0.14e0 + correlation * 0.12e0 + agreement * 0.06e0")} AS reliable FROM g2),
g4 AS (SELECT *, {cl("reliable - toll")} AS market_confidence FROM g3),
g5 AS (SELECT *, {cl("stability * 0.28e0 + market_convergence * 0.28e0 + opportunity * 0.22e0 + market_confidence * 0.12e0 + (100 - rupture) * 0.1e0")} AS support_probability, {cl("(100 - rupture) * 0.35e0 + stability * 0.25e0 + market_convergence * 0.2e0 + duration * 0.1e0 + correlation * 0.1e0")} AS recovery_probability, {cl("market_confidence * 0.4e0 + market_convergence * 0.3e0 + duration * 0.2e0 + correlation * 0.1e0")} AS temporal_coherence, {cl("opportunity * 0.35e0 + market_convergence * 0.25e0 + stability * 0.2e0 + market_confidence * 0.2e0")} AS temporal_support, {cl("rupture * 0.6e0 + rupture * 0.4e0")} AS rupture_evolution FROM g4),
gate AS (SELECT asset_id, regime, status, stability, rupture, market_convergence, opportunity, market_confidence, support_probability, recovery_probability, temporal_coherence, temporal_support, CASE WHEN stability < 40 OR rupture > 70 THEN 'BLOCK' WHEN stability > 80 AND rupture < 30 AND opportunity > 75 THEN 'ALLOW' ELSE 'WATCH' END AS core_decision, 'unavailable' AS governance, market_confidence < 40 OR rupture >= 80 OR market_convergence < 35 AS neutralized,
 CASE WHEN market_confidence < 40 THEN 'low_confidence' WHEN rupture >= 80 THEN 'excessive_rupture' WHEN market_convergence < 35 THEN 'contradictory_structure' ELSE 'none' END AS neutralization_reason, CASE WHEN market_confidence < 25 THEN 'high' WHEN market_confidence < 40 THEN 'medium' WHEN rupture >= 90 THEN 'critical' WHEN rupture >= 80 THEN 'high' WHEN market_convergence < 35 THEN 'medium' ELSE 'none' END AS neutralization_severity,
 rupture_evolution, CASE WHEN rupture_evolution >= 85 THEN 'explosive' WHEN rupture_evolution >= 65 THEN 'worsening' WHEN rupture_evolution <= 25 THEN 'improving' ELSE 'stable' END AS rupture_state FROM g5)"""


def funnel(source: str, allow: str, risk: str, support: str, name: str) -> str:
    return f"""{name}_0 AS (SELECT *, {cl("stability * 0.24e0 + market_convergence * 0.18e0 + support_probability * 0.18e0 + opportunity * 0.14e0 + market_confidence * 0.1e0 + recovery_probability * 0.08e0 - rupture * 0.26e0")} AS decision_score, {cl("recovery_probability - rupture")} AS recovery_rupture_dominance, rupture >= {risk} AS rupture_dominant, temporal_coherence >= 55 AND temporal_support >= 50 AS temporal_gate, support_probability >= {support} AS support_gate, regime <> 'TRANSITION' OR rupture < {risk} - 8 AS safety_gate FROM {source}),
{name}_1 AS (SELECT *, regime <> 'TRANSITION' OR recovery_rupture_dominance >= 8 AS dominance_gate FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN rupture_dominant THEN 'rupture_kill_switch' WHEN NOT temporal_gate THEN 'temporal_gate_failed' WHEN NOT support_gate THEN 'support_gate_failed' WHEN market_confidence < 40 THEN 'support_gate_failed' WHEN NOT safety_gate OR regime = 'VOLATILE' THEN 'transition_safety_gate_failed' WHEN NOT dominance_gate THEN 'transition_dominance_gate_failed' WHEN decision_score >= {allow} THEN 'allow_score_passed' ELSE 'allow_score_below_threshold' END AS reason FROM {name}_1),
{name} AS (SELECT *, CASE reason WHEN 'rupture_kill_switch' THEN 'BLOCK' WHEN 'allow_score_passed' THEN 'ALLOW' ELSE 'WATCH' END AS decision FROM {name}_2)"""


FUNNEL = funnel("gate", "76", "68", "64", "dec")
DECIDED = "asset_id, regime, decision_score, recovery_rupture_dominance, decision, reason, rupture_dominant, temporal_gate, support_gate, safety_gate, dominance_gate, stability, rupture, market_confidence, support_probability, recovery_probability, opportunity, market_convergence, neutralized, neutralization_reason, neutralization_severity, rupture_evolution, rupture_state"
_T = f"WITH {TICK}, {RET}, {STATS}, {SHAPE}, {PATTERN}, {RFS}, {GATE}, {FUNNEL}"
_S = f"WITH {SNAP}, {LABEL}"


def pct_of(column: str, value: str) -> str:
    return r2(f"avg(CASE WHEN {column} = '{value}' THEN 100e0 ELSE 0e0 END)")


_change = lambda a, b: f"CASE WHEN {a} = 0 THEN 0e0 ELSE ({b} - {a}) / abs({a}) * 100 END"
_ORDER = "rank ASC, coalesce(market_cap, -1) DESC, coalesce(volume_24h, -1) DESC, symbol ASC"

ORACLE_SQL: dict[str, str] = {
    "w1_returns": f"WITH {TICK}, {RET} SELECT asset_id, idx, {r2('r')} AS return_pct FROM ret",
    "w2_w3_return_stats": f"{_T} SELECT * FROM stats",
    "w4_streaks": f"WITH {TICK}, st AS (SELECT asset_id, idx, sign(price - lag(price) OVER (PARTITION BY asset_id ORDER BY idx)) AS d FROM tick), s2 AS (SELECT *, lag(d) OVER (PARTITION BY asset_id ORDER BY idx) AS b FROM st WHERE d IS NOT NULL), s3 AS (SELECT *, sum(CASE WHEN d = b THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY idx) AS island FROM s2), s4 AS (SELECT asset_id, island, d, count(*) AS c FROM s3 GROUP BY ALL) SELECT asset_id, CAST(sum(CASE WHEN d = 1 THEN c ELSE 0 END) AS BIGINT) AS up_moves, CAST(sum(CASE WHEN d = -1 THEN c ELSE 0 END) AS BIGINT) AS down_moves, CAST(max(CASE WHEN d = 1 THEN c ELSE 0 END) AS BIGINT) AS up_streak, CAST(max(CASE WHEN d = -1 THEN c ELSE 0 END) AS BIGINT) AS down_streak FROM s4 GROUP BY asset_id",
    "w6_shape": f"{_T} SELECT * FROM shape",
    "w16_lead_returns": f"WITH {TICK} SELECT asset_id, idx, " + ", ".join(f"CASE WHEN lead(price, {k}) OVER p IS NOT NULL AND price <> 0 THEN {r2(f'(lead(price, {k}) OVER p - price) / price * 100')} END AS return_{k}" for k in (24, 48, 72)) + " FROM tick WINDOW p AS (PARTITION BY asset_id ORDER BY idx)",
    "w20_behavior_7d": f"{_T}, a AS (SELECT asset_id, n_prices, slope_pct / 100 AS t, coalesce(volatility, 0e0) / 100 AS v, amplitude_pct / 100 AS m FROM shape LEFT JOIN stats USING (asset_id)), b AS (SELECT *, CASE WHEN abs(t) < 0.01e0 THEN (t * 120 - v * 80 + m * 40) * 0.6e0 ELSE t * 120 - v * 80 + m * 40 END AS raw FROM a), c AS (SELECT asset_id, CASE WHEN n_prices < 5 THEN 50e0 ELSE floor((greatest(-100e0, least(100e0, raw)) + 100) / 200 * 100 + 0.5e0) END AS score FROM b) SELECT asset_id, score, CASE WHEN score >= 65 THEN 'PUMA' WHEN score <= 35 THEN 'SERPENT' ELSE 'KANGAROO' END AS behavior FROM c",
    "w22_newest_per_key": f"WITH {MEMORY} SELECT id, symbol, action, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS place FROM mem) WHERE place <= 3",
    "j1_last_wins_join": "SELECT c_custkey, c_mktsegment, o_orderkey, o_orderpriority FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "j2_collisions": "SELECT * FROM (SELECT lower(p_brand) || '|' || lower(p_type) || '|' || CAST(p_size AS VARCHAR) AS fingerprint, p_partkey, p_brand, p_type, p_size, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part) WHERE n > 1",
    "j10_preferred_record": "SELECT key, source, id, balance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY balance DESC, source, id) AS k FROM (SELECT c_nationkey AS key, 'registry' AS source, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, 'env', s_suppkey, s_acctbal FROM supplier)) WHERE k = 1",
    "e1_rfs_market": f"{_T} SELECT * FROM rfs",
    "e10_market_gate": f"{_T} SELECT * FROM gate",
    "e22_public_structure": f"{_S} SELECT * FROM lab",
    "e24_simple_decision": f"{_T} SELECT asset_id, CASE WHEN stability < 40 THEN 'BLOCK' WHEN stability > 70 AND convergence > 65 AND continuity > 0.6e0 THEN 'ALLOW' ELSE 'WATCH' END AS decision FROM rfs",
    "e25_stability_index": f"{_S} SELECT id, {r2('(' + within('1 - abs(chg_24h_pct) / 10', 0, 1) + ' * 0.6e0 + ' + within('(log10(market_cap) - 8) / 4', 0, 1) + ' * 0.25e0 + ' + within('(log10(volume_24h) - 7) / 4', 0, 1) + ' * 0.15e0) * 100')} AS stability_index, CASE WHEN abs(chg_24h_pct) <= 3 THEN 'STABLE' WHEN abs(chg_24h_pct) <= 8 THEN 'TRANSITION' ELSE 'VOLATILE' END AS regime FROM snap WHERE chg_24h_pct IS NOT NULL",
    "p17_zones": f"{_S} SELECT id, position, {r2('price * lo')} AS low, {r2('price * hi')} AS high, {r2('abs((price * lo + price * hi) / 2 - price) / price * 100')} AS distance_pct, {r2('(price * hi - price * lo) / price * 100')} AS width_pct FROM snap, (VALUES ('below', 0.965e0, 0.98e0), ('near', 0.99e0, 1.01e0), ('above', 1.02e0, 1.04e0)) b(position, lo, hi) WHERE price > 0",
    "a1_market_summary": f"{_S} SELECT count(*) AS n_assets, {r2('avg(price)')} AS avg_price, {r2('avg(chg_24h_pct)')} AS avg_24h, {r2('avg(chg_7d_pct)')} AS avg_7d, {r2('sum(market_cap)')} AS total_market_cap, {r2('sum(volume_24h)')} AS total_volume FROM snap",
    "a2_decision_summary": f"{_T}, c AS (SELECT count(*) AS n, " + ", ".join(f"CAST(count(*) FILTER (decision = '{a}') AS BIGINT) AS n_{a.lower()}" for a in ("ALLOW", "WATCH", "BLOCK")) + ", " + ", ".join(f"CAST(count(*) FILTER (regime = '{a}') AS BIGINT) AS n_{a.lower()}" for a in ("STABLE", "TRANSITION", "VOLATILE")) + " FROM dec) SELECT *, CASE WHEN n_stable >= greatest(n_volatile, n_transition) THEN 'STABLE' WHEN n_volatile >= n_transition THEN 'VOLATILE' ELSE 'TRANSITION' END AS dominant_regime, CASE WHEN n_allow + n_block + n_watch = 0 THEN NULL WHEN n_allow >= greatest(n_block, n_watch) THEN 'ALLOW' WHEN n_block >= n_watch THEN 'BLOCK' ELSE 'WATCH' END AS dominant_decision FROM c",
    "a3_market_state": f"{_S} SELECT count(price) AS n_price, count(chg_24h_pct) AS n_24h, count(chg_7d_pct) AS n_7d, {r2('avg(chg_24h_pct)')} AS avg_24h, {r2('avg(abs(chg_24h_pct))')} AS avg_abs_24h, {r2('avg(chg_7d_pct)')} AS avg_7d, {r2('avg(abs(chg_7d_pct))')} AS avg_abs_7d FROM snap",
    "a5_market_context": f"{_T}, c AS (SELECT count(*) AS n_assets, {pct_of('regime', 'STABLE')} AS stable_pct, {pct_of('regime', 'TRANSITION')} AS transition_pct, {pct_of('regime', 'VOLATILE')} AS volatile_pct, {r2('avg(stability)')} AS avg_stability, {r2('median(stability)')} AS median_stability FROM rfs), g AS (SELECT *, {cl('avg_stability * 0.6e0 + median_stability * 0.4e0')} AS global_score FROM c) SELECT *, {cl('volatile_pct * 0.42e0 + transition_pct * 0.2e0 + (100 - global_score) * 0.1e0')} AS risk, CASE WHEN volatile_pct >= 45 OR global_score < 35 THEN 'VOLATILE' WHEN stable_pct >= 55 AND global_score >= 60 THEN 'STABLE' ELSE 'TRANSITION' END AS global_regime FROM g",
    "a6_structure_summary": f"{_S}, c AS (SELECT count(*) AS n_assets, {r2('avg(CASE WHEN transition = ' + chr(39) + 'Fragmented' + chr(39) + ' THEN 1e0 ELSE 0e0 END) * 100')} AS fragmented_pct, {r2('avg(CASE WHEN transition IN (' + chr(39) + 'Expansion' + chr(39) + ', ' + chr(39) + 'Active Expansion' + chr(39) + ') THEN 1e0 ELSE 0e0 END) * 100')} AS expanding_pct, {pct_of('activity', 'High')} AS active_pct, {r2('avg(CASE WHEN transition = ' + chr(39) + 'Compression' + chr(39) + ' THEN 1e0 ELSE 0e0 END) * 100')} AS compressed_pct FROM lab) SELECT *, CASE WHEN fragmented_pct >= 30 THEN 'Fragmented' WHEN expanding_pct >= 35 THEN 'Expanding' WHEN active_pct >= 35 THEN 'Active' WHEN compressed_pct >= 45 THEN 'Compressed' ELSE 'Transitioning' END AS climate FROM c",
    "a8_memory_stats": f"WITH {MEMORY}, c AS (SELECT count(*) AS total, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (res > 0) AS positive, count(*) FILTER (res < 0) AS negative, count(*) FILTER (res = 0) AS neutral, {r2('avg(res)')} AS avg_result, {r2('avg(res) FILTER (res > 0)')} AS avg_positive, {r2('avg(res) FILTER (res < 0)')} AS avg_negative FROM mem) SELECT *, CASE WHEN n_resolved > 0 THEN {r2('positive / n_resolved * 100')} END AS winrate FROM c",
    "a9_by_action": f"WITH {MEMORY} SELECT a.action, CAST(a.place AS INT) AS place, count(id) AS total, count(*) FILTER (res > 0) AS positive FROM (VALUES ('ALLOW', 0), ('WATCH', 1), ('BLOCK', 2)) a(action, place) LEFT JOIN mem ON mem.action = a.action GROUP BY ALL",
    "a10_by_regime": f"WITH {MEMORY} SELECT market_regime, count(*) AS total, count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (res > 0) AS positive, {r2('avg(res)')} AS avg_result FROM mem GROUP BY market_regime",
    "a11_decision_distribution": f"{_T} SELECT CASE WHEN grouping(regime) = 1 THEN 'ALL' ELSE regime END AS regime, count(*) AS n, {pct_of('decision', 'ALLOW')} AS allow_pct, {pct_of('decision', 'WATCH')} AS watch_pct, {pct_of('decision', 'BLOCK')} AS block_pct FROM dec GROUP BY GROUPING SETS ((), (regime))",
    "a12_reason_histogram": f"{_T} SELECT reason, count(*) AS n FROM dec GROUP BY reason",
    "a19_score_stats": f"{_T} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, min({c}) AS least, max({c}) AS largest, {r2(f'avg({c})')} AS mean, {r2(f'quantile_cont({c}, 0.25)')} AS p25, {r2(f'median({c})')} AS median, {r2(f'quantile_cont({c}, 0.75)')} AS p75 FROM dec" for c in ("stability", "rupture", "market_confidence")),
    "a29_usage_totals": f"WITH {USAGE} SELECT key, count(*) AS calls, arg_max(endpoint, (ts, event_id)) AS last_endpoint, max(plan) AS plan FROM use GROUP BY key",
    "a29_usage_by_endpoint": f"WITH {USAGE}, k AS (SELECT key, count(*) AS calls, arg_max(endpoint, (ts, event_id)) AS endpoint FROM use GROUP BY key) SELECT endpoint, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS keys FROM k GROUP BY endpoint",
    "f1_search": f"{_S} SELECT {PUBLIC} FROM snap WHERE contains(lower(CAST(id AS VARCHAR)), 'brand#1') OR contains(lower(symbol), 'brand#1') OR contains(lower(name), 'brand#1')",
    "o1_scan_page": f"{_S} SELECT {PUBLIC} FROM snap ORDER BY coalesce(chg_24h_pct, -1) DESC, {_ORDER} LIMIT 50 OFFSET 25",
    "o4_page_info": f"{_S} SELECT count(*) AS total, CASE WHEN count(*) > 75 THEN CAST(75 AS BIGINT) END AS next_cursor FROM snap",
    "o5_top_volume": f"{_S} SELECT {PUBLIC} FROM snap ORDER BY coalesce(volume_24h, -1) DESC, {_ORDER} LIMIT 5",
    "o6_highlights": f"{_S} SELECT id, symbol, transition FROM lab ORDER BY list_position(['Active Expansion', 'Expansion', 'Recovery', 'Fragmented', 'Compression', 'Stable', 'Neutral'], transition), volume_24h DESC, symbol LIMIT 3",
    "o8_top_movers": f"{_S} SELECT {PUBLIC} FROM snap WHERE chg_24h_pct IS NOT NULL ORDER BY abs(chg_24h_pct) DESC, symbol LIMIT 8",
    "u1_union_distinct": "SELECT event_id, event_type || ',base' AS warnings FROM events",
    "u3_rejected_count": f"{_S} SELECT count(*) AS rejected FROM snap WHERE n_prices < 25",
    "x_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "t1_usage_windows": f"WITH {USAGE}, w AS (SELECT plan, key, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS calls FROM use GROUP BY ALL), q AS (SELECT * FROM (VALUES ('demo', 100), ('trader', 5000), ('pro', 50000), ('internal', 1000000000), ('enterprise', 1000000000)) q(plan, quota)) SELECT plan, key, window_start, calls, CAST(quota AS BIGINT) AS quota, CAST(greatest(0, quota - calls) AS BIGINT) AS remaining, calls <= quota AS allowed FROM w JOIN q USING (plan)",
    "t2_live_windows": f"WITH {TICK}, g AS (SELECT asset_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS n, {r2('avg(price)')} AS avg_price, {r2('quantile_cont(price, 0.5)')} AS median_price, min(price) AS least, max(price) AS largest FROM tick GROUP BY ALL), h AS (SELECT *, CASE WHEN avg_price > 0 THEN {r2('(largest - least) / avg_price * 100')} ELSE 0e0 END AS noise FROM g) SELECT asset_id, window_start, n, avg_price, median_price, noise, noise >= 75 AS rupture FROM h",
    "w5_break_rate": f"{_T} SELECT asset_id, break_rate FROM pat WHERE n_r > 1",
    "w7_reversal": f"{_T} SELECT asset_id, {r2('m1')} AS first_mean, {r2('m2')} AS second_mean, reversal FROM pat WHERE n_r > 0",
    "w8_w9_pattern": f"{_T} SELECT asset_id, n_prices, slope_pct, amplitude_pct, break_rate, reversal, instability, kind, quality, bias, CASE kind WHEN 'UPTREND' THEN 'UP_STREAK' WHEN 'DOWNTREND' THEN 'DOWN_STREAK' WHEN 'COMPRESSION' THEN 'COMPRESSION' WHEN 'REVERSAL' THEN 'MEAN_REVERTING' ELSE 'MIXED' END AS legacy_kind FROM pat",
    "w11_month_segments": f"WITH {MONTHS} SELECT asset_id, year, month, n_prices, first_price, last_price, min_price, max_price, slope_pct, amplitude_pct, instability, break_rate, kind, quality, duration FROM months",
    "w12_quarters": f"WITH {MONTHS} SELECT asset_id, year, CAST(ceil(month / 3) AS INT) AS quarter, count(*) AS n_months, CAST(sum(n_prices) AS BIGINT) AS n, arg_min(first_price, month) AS first_price, arg_max(last_price, month) AS last_price FROM months GROUP BY asset_id, year, ceil(month / 3)",
    "w14_occurrences": f"WITH {TICK}, {OCC} SELECT * FROM occ",
    "a25_outcome_rates": f"WITH {TICK}, {OCC} SELECT asset_id, kind, count(*) AS n, {r2('avg(CASE WHEN continued THEN 0e0 ELSE 100e0 END)')} AS correction_rate, {r2('avg(CASE WHEN continued THEN 100e0 ELSE 0e0 END)')} AS continuation_rate, {r2('sum(CAST(round(similarity * 100) AS BIGINT)) / (count(similarity) * 100)')} AS avg_similarity FROM occ GROUP BY asset_id, kind",
    "e11_decision_funnel": f"{_T} SELECT {DECIDED} FROM dec",
    "f2_asset_issues": f"{_S} SELECT id, CASE WHEN trim(name) = '' THEN 'name_missing' ELSE '' END AS issues FROM snap",
}
