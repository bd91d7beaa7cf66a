"""DuckDB SQL of the history, decision, calibration and matching engines. Written from the definitions, not from the plans."""

from __future__ import annotations

from tidepool.plans.oracles import _DURATION, _S, _T, HIST, MARKET_TICK, OCC, RET, RFS, SHAPE, STATS, TICK, cl, funnel, on_market, r2, signed, within
from tidepool.plans.oracles import ORACLE_SQL as _FIRST

_CHAIN = f"{TICK}, {RET}, {STATS}, {SHAPE}, {RFS}"


def mean2(x: str, when: str = "") -> str:
    """Mean of values with two decimals, by whole hundredths."""
    return f"sum(CAST(round({x} * 100) AS BIGINT)){when} / (count({x}){when} * 100)"


def sd2(x: str) -> str:
    w = f"CAST(round({x} * 100) AS BIGINT)"
    return f"sqrt(CAST(count({x}) * sum({w} * {w}) - sum({w}) * sum({w}) AS DOUBLE)) / (count({x}) * 100)"


def dot(*terms: tuple[float, str]) -> str:
    """Weighted sum, from left to right."""
    return " + ".join(f"({x}) * {w}e0" for w, x in terms)


# ---- history: segments of each series, then the newest month against its references
_SEG = f"""pts AS (SELECT *, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, count(*) OVER (PARTITION BY asset_id) AS n_all, count(*) OVER (PARTITION BY asset_id, year(ts), month(ts)) AS n_month, min(ts) OVER (PARTITION BY asset_id) AS a0, max(ts) OVER (PARTITION BY asset_id) AS a1 FROM hist WHERE price > 0),
kept AS (SELECT *, year(ts) * 4 + quarter(ts) AS q, max(CASE WHEN n_month >= 4 THEN year(ts) * 4 + quarter(ts) END) OVER (PARTITION BY asset_id) AS newest FROM pts WHERE n_all >= 8),
labelled AS (SELECT asset_id, 'month' AS segment, y AS year, m AS month, ts, price FROM kept WHERE n_month >= 4
 UNION ALL SELECT asset_id, 'quarter', 0, 0, ts, price FROM kept WHERE n_month >= 4 AND q = newest
 UNION ALL SELECT asset_id, 'all', 0, 0, ts, price FROM kept
 UNION ALL SELECT asset_id, 'i7', 0, 0, ts, price FROM kept WHERE ts <= a0 + INTERVAL 7 DAY
 UNION ALL SELECT asset_id, 'r7', 0, 0, ts, price FROM kept WHERE ts >= a1 - INTERVAL 7 DAY
 UNION ALL SELECT asset_id, 'i24', 0, 0, ts, price FROM kept WHERE ts <= a0 + INTERVAL 24 HOUR
 UNION ALL SELECT asset_id, 'r24', 0, 0, ts, price FROM kept WHERE ts >= a1 - INTERVAL 24 HOUR),
{signed('labelled', 'asset_id, segment, year, month', 'ts', 'seg0')},
seg AS (SELECT *, {_DURATION} FROM seg0)"""


def _compared(mode: str) -> str:
    near = lambda f, tol: within(f"100 - abs(c.{f} - p.{f}) / {tol} * 100", 0, 100)
    pair = lambda a, b: f"(c.kind IN ('{a}', '{b}') AND p.kind IN ('{a}', '{b}'))"
    kinds = f"CASE WHEN c.kind = p.kind THEN 100e0 WHEN {pair('UPTREND', 'DOWNTREND')} THEN 60e0 WHEN {pair('RANGE', 'COMPRESSION')} THEN 78e0 WHEN {pair('REVERSAL', 'RANGE')} THEN 42e0 WHEN {pair('REVERSAL', 'COMPRESSION')} THEN 38e0 ELSE 25e0 END"
    alike = within(dot((0.14, kinds), (0.22, near("slope_pct", 20)), (0.16, near("amplitude_pct", 30)), (0.22, near("instability", 50)), (0.14, near("break_rate", "0.6e0")), (0.12, near("duration", 40))), 0, 100)
    fragile = lambda t: f"({t}.instability * 0.38e0 + {t}.break_rate * 100 * 0.38e0 + (100 - {t}.duration) * 0.24e0)"
    gap = within(f"greatest(0e0, {fragile('c')} - {fragile('p')}) * 0.62e0 + (100 - alike) * 0.38e0", 0, 100).replace("c.", "c_").replace("p.", "p_")
    return f"""spans AS (SELECT asset_id, date_diff('microsecond', t0, t1) / 86400000000e0 / 30 AS months FROM seg WHERE segment = 'all'),
modes AS (SELECT asset_id, {mode} AS mode FROM spans),
nth AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY year DESC, month DESC) AS back FROM seg WHERE segment = 'month'),
al AS (SELECT p.asset_id, p.year, p.month, mode, p.kind AS reference_kind, {alike} AS alike, c.instability AS c_instability, c.break_rate AS c_break_rate, c.duration AS c_duration, p.instability AS p_instability, p.break_rate AS p_break_rate, p.duration AS p_duration, c.slope_pct AS c_slope, p.slope_pct AS p_slope, {near('duration', 40)} AS dur FROM nth p JOIN nth c ON c.asset_id = p.asset_id AND c.back = 1 AND p.back > 1 JOIN modes ON modes.asset_id = p.asset_id WHERE mode <> 'YEAR_PHASE_COMPARISON' OR (ceil(p.month / 3) = ceil(c.month / 3) AND p.year < c.year)),
cmp AS (SELECT asset_id, year, month, mode, {r2('alike')} AS similarity, {r2(gap)} AS rupture_gap, {r2(within(dot((0.54, 'alike'), (0.2, 'CASE WHEN sign(c_slope) * sign(p_slope) > 0 THEN 100e0 ELSE 35e0 END'), (0.16, 'dur'), (0.1, '100 - ' + within('abs(c_break_rate - p_break_rate) * 100', 0, 100))), 0, 100))} AS continuity, {r2('dur')} AS duration_similarity, reference_kind FROM al)"""


_BY_SPAN = "CASE WHEN months < 2 THEN 'INSUFFICIENT_HISTORY' WHEN months < 12 THEN 'MONTH_TO_MONTH' ELSE 'YEAR_PHASE_COMPARISON' END"


def _block(p: str) -> str:
    change = "CASE WHEN first_price = 0 THEN 0e0 ELSE (last_price - first_price) / abs(first_price) * 100 END"
    few = "n_prices < 2"
    return f"""b_{p} AS (SELECT asset_id, CASE WHEN {few} THEN 50e0 ELSE {cl('50 + ' + within(change, -50, 50))} END AS {p}_price_score, CASE WHEN {few} THEN 0e0 ELSE {r2(change)} END AS {p}_change_pct, CASE WHEN {few} THEN 0e0 ELSE slope_pct END AS {p}_slope_pct,
 CASE WHEN {few} THEN 50e0 ELSE {cl(dot((0.42, 'quality'), (0.22, 'duration'), (0.2, '100 - instability'), (0.16, '100 - break_rate * 100')))} END AS {p}_stability, CASE WHEN {few} THEN 50e0 ELSE {cl(dot((0.36, 'instability'), (0.36, 'break_rate * 100'), (0.28, '100 - duration')))} END AS {p}_rupture, CASE WHEN {few} THEN 'insufficient_data' WHEN n_prices < 4 THEN 'partial' ELSE 'computed' END AS {p}_status FROM seg WHERE segment = '{p}')"""


_BLOCKS = ", ".join(_block(p) for p in ("i7", "r7", "i24", "r24")) + ", blocks AS (SELECT * FROM b_i7 JOIN b_r7 USING (asset_id) JOIN b_i24 USING (asset_id) JOIN b_r24 USING (asset_id))"
_H = f"WITH {HIST}, {_SEG}, {_BLOCKS}, {_compared(_BY_SPAN)}"
_HISTORY = f"""st AS (SELECT asset_id, count(*) AS n, count(*) FILTER (similarity >= 70) AS strong, {mean2('continuity')} AS m_continuity, {sd2('similarity')} AS sd_similarity, {mean2('duration_similarity')} AS m_duration, count(*) FILTER (rupture_gap >= 50) AS broken, {mean2('rupture_gap')} AS m_gap, {sd2('rupture_gap')} AS sd_gap FROM cmp GROUP BY asset_id),
base AS (SELECT asset_id, {mean2('quality', ' FILTER (back > 1)')} AS past FROM nth GROUP BY asset_id),
cur AS (SELECT w.asset_id, coalesce(m.slope_pct, w.slope_pct) AS slope_pct, coalesce(m.amplitude_pct, w.amplitude_pct) AS amplitude_pct, coalesce(m.instability, w.instability) AS instability, coalesce(m.break_rate, w.break_rate) AS break_rate, coalesce(m.quality, w.quality) AS quality, coalesce(m.duration, w.duration) AS duration, q.quality AS qq, m.asset_id IS NOT NULL AS has_month FROM seg w LEFT JOIN nth m ON m.asset_id = w.asset_id AND m.back = 1 LEFT JOIN seg q ON q.asset_id = w.asset_id AND q.segment = 'quarter' WHERE w.segment = 'all'),
h0 AS (SELECT cur.* EXCLUDE (qq), blocks.* EXCLUDE (asset_id), CASE WHEN has_month THEN mode ELSE 'INSUFFICIENT_HISTORY' END AS mode, coalesce(n, 0) AS n, m_gap, sd_gap, coalesce(qq, quality) AS quarter_score, coalesce(past, quality) AS baseline,
 CASE WHEN n IS NULL THEN 0e0 ELSE {cl('least(n, 24) / 24 * 100')} END AS occurrence, CASE WHEN n IS NULL THEN 0e0 ELSE {cl('strong / n * 100')} END AS frequency, CASE WHEN n IS NULL THEN 0e0 ELSE {cl('m_continuity')} END AS convergence, CASE WHEN coalesce(n, 0) < 2 THEN 50e0 ELSE {cl('100 - sd_similarity')} END AS correlation, CASE WHEN n IS NULL THEN 0e0 ELSE {cl('m_duration')} END AS duration_axis,
 CASE WHEN n IS NULL THEN 50e0 ELSE {cl('least(broken, 24) / 24 * 100')} END AS rupture_occurrence, CASE WHEN n IS NULL THEN 50e0 ELSE {cl('broken / n * 100')} END AS rupture_frequency, CASE WHEN n IS NULL THEN 50e0 ELSE {cl('m_gap')} END AS rupture_convergence, CASE WHEN n IS NULL THEN 50e0 ELSE {cl('100 - sd_gap')} END AS rupture_correlation, CASE WHEN n IS NULL THEN 50e0 ELSE {cl('(100 - duration) * 0.55e0 + break_rate * 100 * 0.45e0')} END AS rupture_duration
 FROM cur JOIN blocks USING (asset_id) JOIN modes USING (asset_id) LEFT JOIN st USING (asset_id) LEFT JOIN base USING (asset_id)),
h1 AS (SELECT *, {cl(dot((0.18, 'rupture_occurrence'), (0.22, 'rupture_frequency'), (0.26, 'rupture_convergence'), (0.14, 'rupture_correlation'), (0.2, 'rupture_duration')))} AS rupture_probability, {cl(dot((0.22, 'occurrence'), (0.18, 'frequency'), (0.26, 'convergence'), (0.16, 'correlation'), (0.18, 'duration_axis')))} AS structural FROM h0),
h2 AS (SELECT *, {cl('rupture_probability * 0.7e0 + rupture_frequency * 0.3e0')} AS penalty FROM h1),
h3 AS (SELECT *, {cl(dot((0.18, 'occurrence'), (0.16, 'frequency'), (0.24, 'convergence'), (0.16, 'correlation'), (0.16, 'duration_axis'), (0.1, '100 - penalty')))} AS continuity_probability, {cl(dot((0.72, 'structural'), (0.18, '100 - penalty'), (0.1, 'baseline')))} AS stability, {cl(dot((0.46, 'quarter_score'), (0.22, 'convergence'), (0.2, 'baseline'), (0.12, '100 - penalty')))} AS mid_term, CASE WHEN n = 0 THEN 50e0 ELSE {cl('greatest(0e0, rupture_probability - m_gap) / greatest(sd_gap, 1e0) * 20')} END AS crash, CASE WHEN n = 0 THEN 'baseline_missing' ELSE 'computed' END AS crash_status FROM h2),
h4 AS (SELECT *, CASE WHEN n = 0 THEN 'NONE' WHEN crash >= 75 THEN 'CRASH' WHEN crash >= 45 THEN 'RISING' ELSE 'NONE' END AS crash_state, {cl('100 - abs(stability - quarter_score)')} AS a1, {cl('100 - abs(quarter_score - quality)')} AS a2, {cl('100 - abs(quality - r7_stability)')} AS a3, {cl('100 - abs(r7_stability - r24_stability)')} AS a4 FROM h3),
h5 AS (SELECT *, {cl(dot((0.28, 'a1'), (0.24, 'a2'), (0.24, 'a3'), (0.08, 'a4'), (0.16, '100 - penalty')))} AS coherence, {cl(dot((0.34, 'quality'), (0.34, 'quarter_score'), (0.18, 'baseline'), (0.14, 'duration_axis')))} AS structure, {cl(dot((0.2, 'occurrence'), (0.14, 'frequency'), (0.22, 'convergence'), (0.16, 'correlation'), (0.14, 'duration_axis'), (0.14, 'least(n * 4, 100)')))} AS confidence FROM h4),
hh AS (SELECT *, {cl(dot((0.36, 'stability'), (0.24, 'mid_term'), (0.16, 'coherence'), (0.14, 'continuity_probability'), (0.1, '100 - penalty')))} AS market, CASE WHEN crash >= 75 OR rupture_probability >= 78 OR r7_rupture >= 80 THEN 'VOLATILE' WHEN stability >= 70 AND rupture_probability <= 35 AND quality >= 60 AND quarter_score >= 60 AND r7_stability >= 50 THEN 'STABLE' ELSE 'TRANSITION' END AS regime, CASE WHEN crash_state = 'CRASH' OR r24_rupture >= 70 OR r24_stability <= 35 THEN 'BAD' WHEN r24_stability >= 60 AND r24_rupture <= 40 THEN 'GOOD' ELSE 'NEUTRAL' END AS timing FROM h5)"""
_IMPULSE = f"""i0 AS (SELECT *, {cl(dot((0.28, '100 - least(abs(slope_pct), 100e0)'), (0.22, '100 - ' + within('amplitude_pct', 0, 100)), (0.2, 'duration_axis'), (0.18, 'convergence'), (0.12, 'correlation')))} AS impulse_compression FROM hh),
i1 AS (SELECT *, {cl(dot((0.34, 'impulse_compression'), (0.18, 'convergence'), (0.14, 'frequency'), (0.14, 'duration_axis'), (0.12, 'rupture_probability'), (0.08, '100 - coherence')))} AS impulse_pressure, {cl(dot((0.28, within('instability', 0, 100)), (0.22, within('break_rate', 0, 1) + ' * 100'), (0.22, 'rupture_probability'), (0.16, 'r7_rupture'), (0.12, 'r24_rupture')))} AS impulse_instability, {cl(dot((0.22, within('abs(r7_change_pct) * 4', 0, 100)), (0.18, within('abs(r24_change_pct) * 8', 0, 100)), (0.2, 'r7_rupture'), (0.16, 'r24_rupture'), (0.14, '100 - r7_stability'), (0.1, '100 - r24_stability')))} AS impulse_exhaustion FROM i0),
i2 AS (SELECT *, {cl(dot((0.34, 'impulse_pressure'), (0.22, 'penalty'), (0.18, '100 - stability'), (0.16, '100 - coherence'), (0.1, within('instability', 0, 100))))} AS impulse_saturation, CAST(slope_pct > 1 AS INT) + CAST(r7_slope_pct > 1 AS INT) + CAST(r24_slope_pct > 1 AS INT) AS up, CAST(slope_pct < -1 AS INT) + CAST(r7_slope_pct < -1 AS INT) + CAST(r24_slope_pct < -1 AS INT) AS down FROM i1)"""

# ---- analyses of a market row
_TA = {"occurrence": (0.92, 4, 0.95, 0.2), "frequency": (0.9, 5, 0.93, 0.18), "convergence": (0.94, 3, 0.96, 0.24), "evolution": (0.96, 2, 0.97, 0.24), "growth": (0.9, 4, 0.94, 0.14)}
_RA = {"occurrence": (0.95, 2, 0.97, 0.18), "frequency": (0.96, 2, 0.97, 0.18), "convergence": (0.94, 3, 0.98, 0.2), "evolution": (0.97, 1.5, 0.99, 0.26), "growth": (0.95, 2.5, 0.98, 0.18)}


def _axes(source: str, name: str, p: str, axes: dict, spread: float) -> str:
    each = [f"{p}_{a}_probability" for a in axes]
    return f"""{name}_c AS (SELECT *, {', '.join(f"{cl(f'{p}_{a} * {x}e0 + {y}e0')} AS {p}_{a}_calibrated" for a, (x, y, *_) in axes.items())} FROM {source}),
{name}_p AS (SELECT *, {', '.join(f"{cl(f'{p}_{a}_calibrated * {f}e0')} AS {p}_{a}_probability" for a, (_, _, f, _) in axes.items())} FROM {name}_c),
{name}_m AS (SELECT *, {cl('(' + ' + '.join(each) + ') / 5')} AS {p}_mean FROM {name}_p),
{name} AS (SELECT *, {cl(f"100 - sqrt(({' + '.join(f'({e} - {p}_mean) * ({e} - {p}_mean)' for e in each)}) / 5) * {spread}e0")} AS {p}_coherence, {cl(dot(*[(w, f'{p}_{a}_probability') for a, (*_, w) in axes.items()]))} AS {p}_structural FROM {name}_m)"""


def _listed(*found: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for bad, name in found) + "], lambda x: x IS NOT NULL)"


_inv = cl("100 - rupture")
_ANALYSES = f"""ta0 AS (SELECT *, {cl('occurrence * 0.7e0 + least(100, pattern_count * 8) * 0.3e0')} AS t_occurrence, {cl('frequency * 0.7e0 + (100 - ' + cl('direction_changes * 8') + ') * 0.3e0')} AS f0, {cl('convergence * 0.75e0 + dominant_direction_ratio * 0.25e0')} AS c0, {cl(dot((0.45, 'correlation'), (0.3, 'continuity'), (0.15, _inv), (0.1, 'duration')))} AS e0, {cl(dot((0.5, 'mid_term'), (0.2, _inv), (0.15, 'duration'), (0.05, 'frequency'), (0.1, "CASE alignment WHEN 'ALIGNED' THEN 85 WHEN 'NEUTRAL' THEN 55 WHEN 'UNAVAILABLE' THEN 40 ELSE 15 END")))} AS w0 FROM rfs),
ta1 AS (SELECT *, {cl('f0 * 0.88e0 + f0 * 0.12e0')} AS t_frequency, {cl('c0 * 0.82e0 + c0 * 0.18e0')} AS t_convergence, {cl('e0 * 0.82e0 + e0 * 0.18e0')} AS t_evolution, {cl('w0 * 0.78e0 + w0 * 0.22e0')} AS t_growth FROM ta0),
{_axes('ta1', 'ta2', 't', _TA, 2.2)},
ta AS (SELECT *, {cl('t_structural * 0.72e0 + t_coherence * 0.28e0')} AS t_support, {_listed(('t_coherence < 45', 'temporal_analysis_low_coherence'), ('t_growth_probability < 35 AND t_convergence_probability >= 60', 'temporal_analysis_direction_without_growth'), ('t_evolution_probability < 40 AND t_occurrence_probability >= 60', 'temporal_analysis_repetition_without_clean_evolution'))} AS t_list FROM ta2),
ra0 AS (SELECT *, {cl('rupture_events / greatest(1, sample_size) * 100')} AS r_density, {cl('direction_changes / greatest(1, sample_size) * 100')} AS r_turning, {cl('100 - continuity')} AS r_anti_continuity, {cl(dot((0.5, 'rupture'), (0.16, '100 - frequency'), (0.14, '100 - duration'), (0.1, '100 - stability')))} AS r_growth FROM ta),
ra1 AS (SELECT *, {cl(dot((0.55, 'r_density'), (0.3, 'rupture'), (0.15, 'least(100, rupture_events * 12)')))} AS r_occurrence, {cl(dot((0.4, 'r_density'), (0.2, 'r_turning'), (0.3, '100 - frequency')))} AS r_frequency, {cl(dot((0.35, 'rupture'), (0.25, '100 - convergence'), (0.2, "CASE alignment WHEN 'OPPOSED' THEN 100 WHEN 'NEUTRAL' THEN 55 WHEN 'UNAVAILABLE' THEN 45 ELSE 20 END"), (0.2, '100 - dominant_direction_ratio')))} AS r_convergence, {cl(dot((0.32, 'rupture'), (0.28, 'r_anti_continuity'), (0.16, '100 - correlation'), (0.14, '100 - duration'), (0.1, '100 - frequency')))} AS r_evolution FROM ra0),
{_axes('ra1', 'ra2', 'r', _RA, 2.1)},
ra3 AS (SELECT *, {cl(dot((0.56, 'r_structural'), (0.16, 'r_coherence'), (0.28, 'r_anti_continuity')))} AS raw1 FROM ra2),
ra4 AS (SELECT *, {cl(cl('raw1 * 0.98e0 + 1') + ' * 0.99e0')} AS rupture_probability FROM ra3),
ra5 AS (SELECT *, {cl(dot((0.5, 'rupture_probability'), (0.2, 'r_coherence'), (0.2, 'r_anti_continuity'), (0.1, 'r_growth')))} AS raw2 FROM ra4),
ra6 AS (SELECT *, {cl('raw2 * 0.99e0 + 0.5e0')} AS risk_rupture FROM ra5),
ra AS (SELECT *, {_listed(('rupture_probability >= 75', 'rupture_analysis_high_probability'), ('r_coherence >= 70 AND rupture_probability >= 65', 'rupture_analysis_coherent_break_risk'), ('risk_rupture >= 70', 'risk_rupture_score_high'))} AS r_list FROM ra6),
rec0 AS (SELECT *, {cl(dot((0.35, 't_growth_probability'), (0.25, 't_convergence_probability'), (0.12, 't_frequency_probability'), (0.18, 't_evolution_probability'), (0.1, '50')))} AS restart_support, {cl('100 - risk_rupture')} AS anti_rupture_pressure FROM ra),
rec1 AS (SELECT *, {cl(dot((0.45, 'restart_support'), (0.25, 'anti_rupture_pressure'), (0.15, 't_coherence'), (0.15, 'stability')))} AS reconstruction_quality FROM rec0),
rec2 AS (SELECT *, {cl(cl(dot((0.42, 'restart_support'), (0.28, 'anti_rupture_pressure'), (0.2, 'reconstruction_quality'), (0.1, 't_support'))) + ' * 0.97e0 + 1.5e0')} AS recovery_score FROM rec1)"""
_A = f"WITH {_CHAIN}, {_ANALYSES}"

# ---- stored decisions
_SAMPLES = "smp AS (SELECT asset_id AS seq, asset_id, 'v8' AS version, '7D' AS horizon, regime, decision, reason, decision_score, decision_score AS allow_raw_score, rupture AS block_raw_score, support_probability, rupture AS risk_probability, market_convergence, market_confidence, recovery_probability, recovery_rupture_dominance, rupture_evolution, rupture_state, neutralized, neutralization_reason, neutralization_severity FROM dec)"
_FAULTY = "bad AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN 'MAYBE' ELSE decision END AS decision, CASE WHEN seq % 7 = 0 THEN ' ' ELSE version END AS version, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 4 = 0 THEN support_probability + 100 ELSE support_probability END AS support_probability, CASE WHEN seq % 6 = 0 THEN 'extreme' ELSE neutralization_severity END AS neutralization_severity) FROM smp)"


def _score_issue(c: str) -> tuple[tuple[str, str], ...]:
    return (f"{c} IS NULL", f"INVALID_SAMPLE_REQUIRED_NUMERIC:{c}"), (f"{c} < 0 OR {c} > 100", f"INVALID_SAMPLE_CONTRACT:{c}")


def _floor_p(x: str, p: float, default: int) -> str:
    return f"coalesce(list_sort(list({cl(x)}))[CAST(floor({p}e0 * (count(*) - 1)) AS INT) + 1], {default}e0)"


def _prior(x: str, p: float, fixed: int) -> str:
    return f"CASE WHEN n_prior < 30 THEN {fixed}e0 ELSE list_sort(list_filter({x}s, lambda v: v IS NOT NULL))[CAST(floor({p}e0 * (n_prior - 1)) AS INT) + 1] END"


_PRIOR = f"""pw AS (SELECT *, {', '.join(f'list(CASE WHEN market_confidence >= 40 THEN {c} END) OVER w AS {c}s' for c in ('allow_raw_score', 'block_raw_score', 'risk_probability', 'support_probability'))}, count(CASE WHEN market_confidence >= 40 THEN 1 END) OVER w AS n_prior FROM smp WINDOW w AS (PARTITION BY version, horizon ORDER BY seq ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)),
learnt AS (SELECT asset_id, n_prior, CASE WHEN n_prior < 30 THEN 'INSUFFICIENT_SAMPLES' WHEN n_prior < 80 THEN 'BOOTSTRAP_ACTIVE' ELSE 'CALIBRATED_ACTIVE' END AS maturity, {_prior('allow_raw_score', 0.75, 76)} AS allow_threshold, {_prior('block_raw_score', 0.75, 72)} AS block_threshold, {_prior('risk_probability', 0.75, 68)} AS risk_threshold, {_prior('support_probability', 0.5, 64)} AS support_threshold FROM pw),
gl AS (SELECT * FROM gate JOIN learnt USING (asset_id))"""
_state = lambda c: f"CASE WHEN {c} < 20 THEN 'LOW' WHEN {c} < 45 THEN 'NORMAL' WHEN {c} < 70 THEN 'ELEVATED' ELSE 'EXCESSIVE' END AS {c}_state"
_SUMMARY = f"""ks AS (SELECT count(*) AS n, {', '.join(f"{cl(f'count(*) FILTER (decision = {chr(39)}{d}{chr(39)}) / nullif(count(*), 0) * 100')} AS {d.lower()}_pct" for d in ('ALLOW', 'WATCH', 'BLOCK'))}, {cl('avg(market_convergence)')} AS convergence, {cl("avg(CASE WHEN (decision = 'ALLOW' AND support_probability >= 60 AND risk_probability < 55) OR (decision = 'BLOCK' AND risk_probability >= 60) THEN 100e0 ELSE 50e0 END)")} AS correlation, 0e0 AS rupture_pressure, CAST(0 AS BIGINT) AS n_rupture, {cl('avg(' + cl('(recovery_probability + recovery_rupture_dominance) / 2') + ')')} AS recovery_pressure, CAST(0 AS BIGINT) AS n_recovery,
 coalesce(bool_or(neutralized), false) AS any_neutralized, coalesce(bool_or(rupture_state = 'worsening'), false) AS any_worsening, coalesce(bool_or(rupture_state = 'explosive'), false) AS any_explosive FROM smp WHERE market_confidence >= 40),
k1 AS (SELECT *, {cl('n / 80 * 100')} AS occurrence, {cl('100 - (abs(allow_pct - 15) * 0.35e0 + abs(watch_pct - 70) * 0.4e0 + abs(block_pct - 15) * 0.25e0)')} AS frequency, {cl('least(n, 30) * 3.33e0')} AS duration, {cl('greatest(0e0, allow_pct - 15) * 4')} AS allow_pressure, {cl('greatest(0e0, watch_pct - 70) * 3')} AS watch_pressure, {cl('greatest(0e0, block_pct - 15) * 4')} AS block_pressure, CASE WHEN n < 30 THEN 'INSUFFICIENT_SAMPLES' WHEN n < 80 THEN 'BOOTSTRAP_ACTIVE' ELSE 'CALIBRATED_ACTIVE' END AS maturity FROM ks)"""
_ADAPTIVE = """block stability_max stability all 0.12 25 42 35
block rupture_min rupture all 0.88 65 90 78
block confidence_max market_confidence all 0.1 15 35 25
block support_max support_probability all 0.12 15 35 22
allow_stable stability_min stability STABLE 0.72 68 86 72
allow_stable opportunity_min opportunity STABLE 0.72 58 82 62
allow_stable convergence_min market_convergence STABLE 0.68 55 80 60
allow_stable rupture_max rupture STABLE 0.35 18 50 42
allow_stable support_min support_probability STABLE 0.72 60 82 66
allow_transition stability_min stability TRANSITION 0.82 68 84 74
allow_transition opportunity_min opportunity TRANSITION 0.84 60 85 68
allow_transition convergence_min market_convergence TRANSITION 0.8 58 82 65
allow_transition rupture_max rupture TRANSITION 0.28 20 48 40
allow_transition confidence_min market_confidence TRANSITION 0.7 42 75 55
allow_transition support_min support_probability TRANSITION 0.84 62 86 72
soft_transition stability_min stability TRANSITION 0.68 62 78 70
soft_transition opportunity_min opportunity TRANSITION 0.7 55 76 65
soft_transition convergence_min market_convergence TRANSITION 0.66 54 76 62
soft_transition rupture_max rupture TRANSITION 0.45 24 58 48
soft_transition support_min support_probability TRANSITION 0.7 58 78 65"""


def _adaptive(line: str) -> str:
    group, name, column, regime, p, low, high, fixed = line.split()
    x = f"quantile_cont({column}, {p})" + ("" if regime == "all" else f" FILTER (regime = '{regime}')")
    return f"CASE WHEN count(*) < 40 THEN {fixed}e0 ELSE {r2(f'greatest({low}e0, least({high}e0, coalesce({x}, 0e0)))')} END AS {group}_{name}"


# ---- contexts
def _contexts(queries: str) -> str:
    """Contexts, and each of those that queries chooses with all within reach of it."""
    return f"""bh AS (SELECT asset_id, n_prices, slope_pct / 100 AS t, coalesce(volatility, 0e0) / 100 AS v, amplitude_pct / 100 AS a FROM shape LEFT JOIN stats USING (asset_id)), bs AS (SELECT asset_id, CASE WHEN n_prices < 5 THEN 50e0 ELSE floor((greatest(-100e0, least(100e0, (t * 120 - v * 80 + a * 40) * CASE WHEN abs(t) < 0.01e0 THEN 0.6e0 ELSE 1e0 END)) + 100) / 200 * 100 + 0.5e0) END AS s FROM bh),
ctx AS (SELECT asset_id, regime, stability, CASE WHEN s >= 65 THEN 'PUMA' WHEN s <= 35 THEN 'SERPENT' ELSE 'KANGAROO' END AS behavior, occurrence, convergence, duration, frequency, correlation FROM rfs JOIN bs USING (asset_id)),
pr AS (SELECT a.asset_id, b.asset_id AS match_id, a.regime AS ar, b.regime AS br, a.behavior AS ab, b.behavior AS bb, abs(a.stability - b.stability) AS gap, {', '.join(f"{cl(f'100 - abs(a.{x} - b.{x}) * 4')} AS s_{x}, b.{x} AS b_{x}" for x in ('occurrence', 'convergence', 'duration', 'frequency', 'correlation'))} FROM ctx a JOIN ctx b ON {queries}abs(a.stability - b.stability) < 18),
m0 AS (SELECT *, CASE WHEN ar = br THEN 100e0 WHEN 'TRANSITION' IN (ar, br) THEN 35e0 ELSE 10e0 END AS regime_score, CASE WHEN ab = bb THEN 100e0 WHEN 'KANGAROO' IN (ab, bb) THEN 50e0 ELSE 20e0 END AS behavior_score, {cl('100 - gap * 5')} AS stability_score, {cl(dot((0.2, 's_occurrence'), (0.25, 's_convergence'), (0.2, 's_duration'), (0.2, 's_frequency'), (0.15, 's_correlation')))} AS axes_score FROM pr),
m1 AS (SELECT *, {cl(dot((0.32, 'regime_score'), (0.24, 'stability_score'), (0.14, 'behavior_score'), (0.3, 'axes_score')))} AS similarity FROM m0),
m2 AS (SELECT *, {cl(dot((0.7, 'similarity'), (0.15, 'regime_score'), (0.1, 'stability_score'), (0.05, 'axes_score')))} AS weighted_similarity FROM m1),
m3 AS (SELECT *, regime_score >= 35 AND similarity >= 60 AND weighted_similarity >= 58 AS comparable FROM m2),
mt AS (SELECT *, array_to_string({_listed(('regime_score < 100', 'regime_mismatch'), ('behavior_score < 100', 'behavior_mismatch'), ('NOT comparable', 'context_not_comparable'))}, ',') AS reasons FROM m3)"""


_CTX = _contexts("a.asset_id % 100 = 0 AND ")
_C = f"WITH {_CHAIN}, {_CTX}"
_COMPARED = "SELECT asset_id, match_id, regime_score, behavior_score, stability_score, axes_score, similarity, weighted_similarity, comparable, reasons FROM mt"
_OUT = f"""lastw AS (SELECT asset_id, max(start) AS start, arg_max(continued, start) AS continued FROM occ WHERE size = 3 GROUP BY asset_id),
wp AS (SELECT m.*, continued, CASE WHEN comparable THEN {cl(cl('weighted_similarity * 0.65e0 + ' + cl(dot((0.2, 'b_occurrence'), (0.25, 'b_convergence'), (0.2, 'b_duration'), (0.2, 'b_frequency'), (0.15, 'b_correlation'))) + ' * 0.35e0') + ' * exp(-0.1e0 * (start % 7))')} END AS w FROM mt m JOIN lastw l ON l.asset_id = m.match_id WHERE m.asset_id <> m.match_id),
og AS (SELECT asset_id, count(*) AS sample_size, count(*) FILTER (comparable) AS valid_matches, coalesce(sum(w) FILTER (continued), 0e0) AS c_on, coalesce(sum(w) FILTER (NOT continued), 0e0) AS c_off, avg(weighted_similarity) FILTER (comparable) AS ms, avg(w) AS mw FROM wp GROUP BY asset_id),
oh AS (SELECT *, valid_matches = 0 OR c_on + c_off <= 0 AS none FROM og),
oi AS (SELECT *, CASE WHEN none THEN 0e0 ELSE {cl('c_on / (c_on + c_off) * 100')} END AS continuation_probability, CASE WHEN none THEN 0e0 ELSE {cl('c_off / (c_on + c_off) * 100')} END AS correction_probability, CASE WHEN none THEN 0e0 ELSE {cl(dot((0.35, 'ms'), (0.25, 'mw'), (0.15, cl('valid_matches / sample_size * 100')), (0.25, cl('least(100, valid_matches * 12)'))))} END AS confidence FROM oh)"""
_W19 = f"""w0 AS (SELECT s.*, n_returns, ups, downs, direction_changes, CASE WHEN n_returns IS NOT NULL THEN CASE WHEN ups + downs = 0 THEN 0e0 ELSE {r2('abs(ups - downs) / (ups + downs)')} END END AS bias, CASE WHEN n_returns >= 2 THEN {r2(within('sd / greatest(abs(mr), 1e0)', 0, 10))} END AS noise FROM shape s LEFT JOIN stats USING (asset_id) LEFT JOIN (SELECT asset_id, avg(r) AS mr, stddev_pop(r) AS sd FROM ret GROUP BY asset_id) USING (asset_id) WHERE n_prices >= 2),
w1 AS (SELECT asset_id, n_prices, CASE WHEN n_returns >= 1 THEN {r2(within(within('bias * 100', 0, 100) + ' - coalesce(' + within('noise * 12', 0, 70) + ', 20e0) + 20', 0, 100))} END AS c0, CASE WHEN first_price <> 0 THEN {r2(within(within('50 + slope_pct', 0, 100) + ' * 0.45e0 + coalesce(' + within('bias * 100', 0, 100) + ', 50e0) * 0.4e0 - coalesce(' + within('noise * 10', 0, 60) + ', 15e0) + 15', 0, 100))} END AS convergence, CASE WHEN n_returns >= 1 THEN {r2(within('(CASE WHEN n_returns < 2 THEN 0e0 ELSE direction_changes / n_returns END * 0.65e0 + coalesce(' + within('noise / 5', 0, 1) + ', 0e0) * 0.35e0) * 100', 0, 100))} END AS rupture_penalty, noise FROM w0),
w2 AS (SELECT asset_id, n_prices, c0 AS consistency, convergence, rupture_penalty, CASE WHEN c0 IS NOT NULL AND convergence IS NOT NULL AND rupture_penalty IS NOT NULL THEN {cl(dot((0.35, 'c0'), (0.4, 'convergence'), (0.25, '100 - rupture_penalty')))} END AS validation_score FROM w1)"""
_nums = ("allow_raw_score", "block_raw_score", "risk_probability", "support_probability")

_IMP = """compression pressure_min pressure 0.45 30 58 35
compression instability_max instability 0.62 42 68 58
compression exhaustion_max exhaustion 0.62 38 66 55
compression core_min core 0.45 35 62 45
pressure_building pressure_min pressure 0.55 38 68 45
pressure_building saturation_min saturation 0.52 35 65 42
pressure_building instability_min instability 0.42 28 62 35
pressure_building growth_min growth 0.42 30 62 38
release pressure_min pressure 0.58 42 72 52
release instability_min instability 0.55 38 70 48
release saturation_min saturation 0.52 36 68 45
release growth_min growth 0.48 34 66 42
release decay_max decay 0.7 52 82 72
exhaustion exhaustion_min exhaustion 0.58 48 78 62
exhaustion instability_min instability 0.52 35 72 45
exhaustion saturation_min saturation 0.52 36 72 48
exhaustion decay_min decay 0.5 35 72 45
neutral pressure_max pressure 0.65 25 52 34
neutral instability_max instability 0.65 25 56 34
neutral saturation_max saturation 0.65 25 56 34
neutral exhaustion_max exhaustion 0.65 25 56 34"""
_STATES = ("COMPRESSION", "PRESSURE_BUILDING", "RELEASE", "EXHAUSTION", "NEUTRAL")


def _impulse(line: str) -> str:
    state, name, score, p, low, high, fixed = line.split()
    other = {"core": "pressure", "growth": "pressure", "decay": "exhaustion"}.get(score, score)
    x = f"coalesce(quantile_cont({score}, {p}) FILTER (state = '{state.upper()}'), quantile_cont({other}, {p}), 0e0)"
    return f"CASE WHEN count(*) < 40 THEN {fixed}e0 ELSE {r2(within(x, int(low), int(high)))} END AS {state}_{name}"


def _fits(state: str) -> str:
    return " AND ".join(f"{f'coalesce({score}, 50e0)' if score in ('growth', 'core', 'decay') else score} {'>=' if name.endswith('_min') else '<='} {state}_{name}" for st, name, score, *_ in map(str.split, _IMP.splitlines()) if st == state)


_q = chr(39)
_STATE = "CASE WHEN impulse_exhaustion >= 70 THEN 'EXHAUSTION' WHEN impulse_pressure >= 68 AND impulse_instability >= 62 AND abs(r24_change_pct) >= 3 THEN 'RELEASE' WHEN impulse_pressure >= 60 AND impulse_saturation >= 55 THEN 'PRESSURE_BUILDING' WHEN impulse_pressure >= 45 AND impulse_instability <= 55 AND abs(r7_change_pct) <= 4 THEN 'COMPRESSION' ELSE 'NEUTRAL' END"
_IS = f"{_H}, {_HISTORY}, {_IMPULSE}, imp AS (SELECT asset_id, impulse_pressure AS pressure, impulse_instability AS instability, impulse_saturation AS saturation, impulse_exhaustion AS exhaustion, CAST(NULL AS DOUBLE) AS growth, CAST(NULL AS DOUBLE) AS core, CAST(NULL AS DOUBLE) AS decay, {_STATE} AS state FROM i2), pol AS (SELECT count(*) AS n, CASE WHEN count(*) < 40 THEN 'fallback' ELSE 'adaptive' END AS source, {', '.join(f'count(*) FILTER (state = {_q}{x}{_q}) AS n_{x.lower()}' for x in _STATES)}, {', '.join(_impulse(x) for x in _IMP.splitlines())}, CASE WHEN count(*) < 40 THEN 'impulse_adaptive_thresholds_insufficient_global_sample' ELSE array_to_string({_listed(*[(f'count(*) FILTER (state = {_q}{x}{_q}) < 8', f'impulse_adaptive_thresholds_insufficient_{x.lower()}_sample') for x in _STATES[:4]])}, ',') END AS warnings FROM imp)"
_pct = lambda part, whole="count(*)": f"CASE WHEN {whole} > 0 THEN CAST(floor({part} / {whole} * 100 + 0.5e0) AS BIGINT) ELSE 0 END"
_REPORTED = f"rep AS (SELECT dec.*, rfs.continuity, {r2('step')} AS day, {r2('slope')} AS week FROM dec JOIN rfs USING (asset_id) JOIN (SELECT asset_id, arg_max(coalesce(r, 0e0), idx) AS step FROM (SELECT *, CASE WHEN lag(price) OVER o <> 0 THEN (price - lag(price) OVER o) / abs(lag(price) OVER o) * 100 END AS r FROM tick WINDOW o AS (PARTITION BY asset_id ORDER BY idx)) GROUP BY asset_id) USING (asset_id) JOIN (SELECT asset_id, slope_pct AS slope FROM shape) USING (asset_id))"
_whole = lambda x: f"CAST(floor({x} + 0.5e0) AS BIGINT)"
_quart = {"p25": 0.25, "p40": 0.4, "p50": 0.5, "p75": 0.75, "p90": 0.9}
_REGIMES, _DECIDE = ("STABLE", "TRANSITION", "VOLATILE"), ("ALLOW", "WATCH", "BLOCK")
_shares = ", ".join(f"{_pct(f'count(*) FILTER ({w} decision = {_q}{d}{_q})', n)} AS {k}{d.lower()}_pct" for k, w, n in [("", "", "count(*)")] + [(f"{r.lower()}_", f"regime = '{r}' AND", f"count(*) FILTER (regime = '{r}')") for r in _REGIMES] for d in _DECIDE)
_fl = lambda c, p: f"coalesce(list_sort(list({c}))[CAST(least(count(*) - 1, floor(count(*) * {p}e0)) AS INT) + 1], 0e0)"
_PAT = f"""prc AS (SELECT asset_id, ts, price, row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS k, sign(price - lag(price) OVER (PARTITION BY asset_id ORDER BY ts)) AS d FROM hist WHERE price > 0),
isl AS (SELECT *, sum(CASE WHEN d = b THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY ts) AS island FROM (SELECT *, lag(d) OVER (PARTITION BY asset_id ORDER BY ts) AS b FROM prc WHERE d IS NOT NULL)),
strk AS (SELECT asset_id, max(CASE WHEN d = 1 THEN c ELSE 0 END) AS up, max(CASE WHEN d = -1 THEN c ELSE 0 END) AS down, sum(CASE WHEN d = 1 THEN c ELSE 0 END) AS ups, sum(CASE WHEN d = -1 THEN c ELSE 0 END) AS downs FROM (SELECT asset_id, island, d, count(*) AS c FROM isl GROUP BY ALL) GROUP BY asset_id),
shp AS (SELECT asset_id, count(*) AS np, avg(price) AS mean, stddev_pop(price) AS sd, arg_max(price, ts) AS last, (arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts) * 100 AS change FROM prc GROUP BY asset_id HAVING count(*) >= 3),
kn AS (SELECT *, abs((last - mean) / mean * 100) AS off FROM shp JOIN strk USING (asset_id)),
knd AS (SELECT *, CASE WHEN up >= 3 AND change > 0 THEN 'UP_STREAK' WHEN down >= 3 AND change < 0 THEN 'DOWN_STREAK' WHEN sd < mean * 0.01e0 THEN 'COMPRESSION' WHEN change > 4 AND ups > downs * 1.5e0 THEN 'BREAKOUT' WHEN change < -4 AND downs > ups * 1.5e0 THEN 'BREAKDOWN' WHEN off < 1.5e0 THEN 'MEAN_REVERTING' WHEN sd > mean * 0.04e0 THEN 'CHAOTIC' ELSE 'MIXED' END AS kind, {r2(within(dot((0.45, within('greatest(up, down) * 12', 0, 100)), (0.25, '100 - ' + within('sd / mean * 100', 0, 100)), (0.3, 'CASE WHEN ups + downs > 0 THEN abs(ups - downs) / (ups + downs) ELSE 0e0 END * 100')), 0, 100))} AS pattern_similarity FROM kn),
tick AS (SELECT asset_id, ts AS idx, ts, price FROM hist), {OCC},
rates AS (SELECT asset_id, kind, count(*) AS n, {r2('avg(CASE WHEN continued THEN 0e0 ELSE 100e0 END)')} AS correction_rate, {r2('avg(CASE WHEN continued THEN 100e0 ELSE 0e0 END)')} AS continuation_rate, {r2(mean2('similarity'))} AS avg_similarity FROM occ GROUP BY asset_id, kind),
pm0 AS (SELECT knd.asset_id, knd.kind, coalesce(r.n, 0) AS n, pattern_similarity, coalesce(correction_rate, 0e0) AS cr, coalesce(continuation_rate, 0e0) AS co, coalesce(avg_similarity, 0e0) AS si, hh.stability, rupture_probability, continuity_probability, CAST(CASE WHEN rupture_probability >= 60 THEN 30 ELSE 0 END + CASE WHEN hh.stability >= 60 THEN 20 WHEN hh.stability >= 45 THEN 10 ELSE 0 END + CASE hh.regime WHEN 'STABLE' THEN 20 WHEN 'TRANSITION' THEN 12 ELSE 0 END + CASE WHEN knd.kind <> 'CHAOTIC' THEN 10 ELSE 0 END + CASE WHEN off <= 4 THEN 20 WHEN off <= 8 THEN 10 ELSE 0 END AS DOUBLE) AS convergence FROM knd JOIN hh ON hh.asset_id = knd.asset_id LEFT JOIN rates r ON r.asset_id = knd.asset_id AND r.kind = knd.kind),
pm1 AS (SELECT *, {cl(dot((0.45, 'cr'), (0.3, 'convergence'), (0.15, 'rupture_probability'), (0.1, 'si')))} AS correction_probability, {cl(dot((0.45, 'co'), (0.35, 'continuity_probability'), (0.2, 'pattern_similarity')))} AS continuation_probability FROM pm0),
pm AS (SELECT *, {cl(dot((0.55, 'correction_probability'), (0.25, 'convergence'), (0.2, 'stability')))} AS opportunity FROM pm1)"""

# ---- back-test: each prefix of each series as a series of its own
_LATER = ", ".join(f"CASE WHEN lead(price, {k}) OVER o IS NOT NULL AND price <> 0 THEN {r2(f'(lead(price, {k}) OVER o - price) / price * 100')} END AS return_{k}" for k in (24, 48, 72))
_REPLAY = f"""WITH {HIST.replace('hist AS', 'daily AS', 1)},
idx AS (SELECT asset_id, ts, {r2('CAST(sum(CAST(round(price * 100) AS BIGINT)) OVER w AS DOUBLE) / (count(*) OVER w * 100)')} AS price FROM daily WINDOW w AS (PARTITION BY asset_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
pl AS (SELECT *, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY asset_id) AS n_all, {_LATER} FROM idx WHERE price > 0 WINDOW o AS (PARTITION BY asset_id ORDER BY ts)),
sg AS (SELECT *, asset_id * 100000 + place AS key FROM pl WHERE n_all >= 192 AND place >= 120 AND place < n_all - 72),
hist AS (SELECT sg.key AS asset_id, pl.ts, pl.price FROM sg JOIN pl ON pl.asset_id = sg.asset_id AND pl.place <= sg.place),
{_SEG}, {_BLOCKS}, {_compared(_BY_SPAN)}, {_HISTORY}, {_PAT},
back AS (SELECT sg.asset_id, sg.place, sg.ts, sg.price, hh.regime, hh.stability, pm.opportunity, CASE WHEN pm.rupture_probability >= 60 AND correction_probability >= 60 AND pm.convergence >= 55 AND hh.stability >= 55 THEN 'ALLOW' WHEN (pm.rupture_probability >= 60 AND correction_probability >= 40) OR opportunity >= 45 THEN 'WATCH' ELSE 'BLOCK' END AS decision, correction_probability, continuation_probability, return_24, return_48, return_72 FROM sg JOIN hh ON hh.asset_id = sg.key JOIN pm ON pm.asset_id = sg.key)"""
_pads = {x: "".join(f"{b ^ x:02X}" for b in b"secret".ljust(64, b"\0")) for x in (0x36, 0x5C)}

_BY_RANK = "CASE decision WHEN 'ALLOW' THEN 3 WHEN 'WATCH' THEN 2 ELSE 1 END"
_SHARE3 = "SELECT CASE WHEN grouping(regime) = 1 THEN 'ALL' ELSE regime END AS regime, " + ", ".join(f"CAST(floor(CASE WHEN {x} <= 1 THEN {x} * 100 ELSE {x} END + 0.5e0) AS BIGINT) AS {d.lower()}".replace(f"AS {d.lower()}", f'AS "{d}"') for d in ("ALLOW", "WATCH", "BLOCK") for x in [r2(f"avg(CASE WHEN decision = '{d}' THEN 100e0 ELSE 0e0 END)")]) + " FROM dec GROUP BY GROUPING SETS ((), (regime))"

ORACLE_SQL: dict[str, str] = {
    "w18_market_history": f"WITH {TICK}, o AS (SELECT *, lag(price) OVER (PARTITION BY asset_id ORDER BY idx) AS b FROM tick), g AS (SELECT asset_id, count(*) AS n, arg_min(price, idx) AS f, arg_max(price, idx) AS l, arg_max(CASE WHEN b IS NULL OR b = 0 THEN 0e0 ELSE (price - b) / abs(b) * 100 END, idx) AS step FROM o GROUP BY asset_id) SELECT asset_id, l AS price_now, {r2('step')} AS chg_24h_pct, {r2('CASE WHEN f = 0 THEN 0e0 ELSE (l - f) / abs(f) * 100 END')} AS chg_7d_pct, n AS history_days, CAST(floor(n / 30) AS BIGINT) AS history_months, CASE WHEN n < 365 THEN 'SHORT' ELSE 'LONG_READY' END AS history_mode FROM g",
    "w21_priority": f"{_T} SELECT asset_id, stability, regime, opportunity, decision FROM dec ORDER BY stability DESC, CASE regime WHEN 'STABLE' THEN 3 WHEN 'TRANSITION' THEN 2 ELSE 1 END DESC, opportunity DESC, {_BY_RANK} DESC, asset_id LIMIT 20",
    "p1_identity": "WITH q AS (SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'p-' || CAST(p_partkey AS VARCHAR) END AS i, CASE WHEN p_partkey % 2 <> 0 THEN upper(p_brand) END AS s, CASE WHEN p_partkey % 5 <> 0 THEN trim(p_name) END AS n FROM part) SELECT i AS provider_id, s AS canonical_symbol, coalesce(n, s) AS canonical_name, coalesce(i, lower(s), nullif(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')) AS canonical_id, CASE WHEN i IS NOT NULL THEN 'provider_id' WHEN s IS NOT NULL THEN 'symbol_fallback' ELSE 'name_fallback' END AS identity_source, 'market|' || coalesce(i, '') || '|' || coalesce(s, '') || '|' || lower(coalesce(n, '')) AS identity_fingerprint, CASE WHEN coalesce(i, s) IS NOT NULL THEN 'market|' || coalesce(i, '') || '|' || coalesce(s, '') || '|usd' END AS market_fingerprint FROM q WHERE coalesce(i, s, n) IS NOT NULL",
    "f10_access_policy": f"{_T}, f AS (SELECT asset_id, asset_id % 11 <> 0 AS is_visible, stability >= 50 AS is_stable_enough, decision IN ('ALLOW', 'WATCH') OR (opportunity >= 50 AND stability >= 55) AS is_actionable, decision = 'ALLOW' OR (regime <> 'VOLATILE' AND stability >= 60 AND opportunity >= 55) AS can_trade FROM dec) SELECT *, CASE WHEN NOT is_visible THEN 'hidden' WHEN can_trade THEN 'tradable' WHEN is_actionable THEN 'watch' WHEN is_stable_enough THEN 'stable_but_not_actionable' ELSE 'unstable' END AS reason FROM f",
    "j3_first_match": f"{_S} SELECT id, symbol, name FROM snap WHERE upper(symbol) = 'BRAND#11-12' ORDER BY id LIMIT 1",
    "o2_engine_sort": f"WITH {_CHAIN} SELECT asset_id, stability FROM rfs ORDER BY stability DESC NULLS LAST, asset_id LIMIT 30",
    "o7_top_opportunities": f"{_T}, s AS (SELECT asset_id, {r2(f'{_BY_RANK} * 100000 + opportunity * 1000 + stability * 100 - asset_id')} AS score, decision FROM dec) SELECT * FROM s ORDER BY score DESC, asset_id LIMIT 3",
    "a4_availability": f"{_S} SELECT count(*) AS asset_count, count(price) AS priced_asset_count, count(market_cap) AS market_cap_available_count, count(volume_24h) AS volume_available_count FROM snap",
    "a31_summary_view": f"WITH {_CHAIN} SELECT count(*) AS total, count(*) FILTER (regime = 'STABLE') AS stable, CAST(floor(count(*) FILTER (regime = 'STABLE') / count(*) * 100 + 0.5e0) AS BIGINT) AS confidence FROM rfs",
    "a32_simple_distribution": f"{_T} {_SHARE3}",
    "k3_bounded_log": f"{_T} SELECT asset_id AS seq, decision, decision_score FROM dec ORDER BY asset_id DESC LIMIT 50",
    "k7_current_state": "SELECT id, version, deleted, l_quantity FROM (SELECT l_orderkey AS id, l_linenumber AS version, l_returnflag = 'R' AS deleted, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC) AS k FROM lineitem) WHERE k = 1 AND NOT deleted",
    "e4_adaptive_impulse": f"{_IS} SELECT asset_id, state, CASE WHEN {_fits('exhaustion')} THEN 'EXHAUSTION' WHEN {_fits('release')} THEN 'RELEASE' WHEN {_fits('pressure_building')} THEN 'PRESSURE_BUILDING' WHEN {_fits('compression')} THEN 'COMPRESSION' ELSE 'NEUTRAL' END AS adaptive_state FROM imp, pol",
    "a18_impulse_policy": f"{_IS} SELECT * FROM pol",
    "a20_impulse_governance": f"{_IS}, gv AS (SELECT n, source, {', '.join(f'CASE WHEN n > 0 THEN {r2(f'n_{x} / n')} ELSE 0e0 END AS {x}_ratio' for x in ('release', 'exhaustion', 'compression'))}, n_neutral / n AS nr, greatest({', '.join('n_' + x.lower() for x in _STATES)}) AS most, CASE {' '.join(f'WHEN n_{x.lower()} = greatest({', '.join('n_' + y.lower() for y in _STATES)}) THEN {_q}{x}{_q}' for x in _STATES)} END AS dominant_state FROM pol), gw AS (SELECT *, CASE WHEN n <= 0 THEN 'unknown' WHEN nr >= 0.85e0 THEN 'neutral_dominant' WHEN release_ratio >= 0.35e0 THEN 'release_overactive' WHEN exhaustion_ratio >= 0.35e0 THEN 'exhaustion_overactive' WHEN most / n <= 0.32e0 THEN 'fragmented' ELSE 'balanced' END AS dominance FROM gv) SELECT n, source, dominant_state, release_ratio, exhaustion_ratio, compression_ratio, dominance, CASE WHEN n <= 0 THEN 'invalid' WHEN source = 'fallback' THEN 'fallback' WHEN dominance IN ('neutral_dominant', 'release_overactive', 'exhaustion_overactive') THEN 'degraded' ELSE 'computed' END AS validity FROM gw",
    "e13_pattern_decision": f"{_H}, {_HISTORY}, {_PAT} SELECT asset_id, kind, n, pattern_similarity, convergence, correction_probability, continuation_probability, opportunity, CASE WHEN rupture_probability >= 60 AND correction_probability >= 60 AND convergence >= 55 AND stability >= 55 THEN 'ALLOW' WHEN (rupture_probability >= 60 AND correction_probability >= 40) OR opportunity >= 45 THEN 'WATCH' ELSE 'BLOCK' END AS decision, 'pattern' AS reason FROM pm",
    "e15_calibration_layer": f"WITH {_CHAIN}, y0 AS (SELECT asset_id, regime, confidence, {cl(dot((0.2, 'occurrence'), (0.25, 'convergence'), (0.2, 'duration'), (0.2, 'frequency'), (0.15, 'correlation')))} AS structure, {cl(dot((0.4, 'convergence'), (0.3, 'duration'), (0.3, '100 - rupture')))} AS continuity, {cl(dot((0.3, 'stability'), (0.2, 'mid_term'), (0.2, 'convergence'), (0.15, 'correlation'), (0.15, '100 - rupture')))} AS context FROM rfs), y1 AS (SELECT *, {', '.join(f'{cl(f"100 / (1 + exp(-4 * {within(f'({c} - 50) / {w}', -3, 3)}))")} AS p_{c}' for c, w in (('structure', 35), ('continuity', 32), ('context', 35)))} FROM y0) SELECT asset_id, structure, continuity, {cl('100 - continuity')} AS rupture, context, p_structure, p_continuity, {cl('100 - p_continuity')} AS p_rupture, p_context, {cl('(' + dot((0.45, 'p_structure'), (0.3, 'p_continuity'), (0.25, 'p_context')) + ") * CASE regime WHEN 'STABLE' THEN 1.08e0 WHEN 'TRANSITION' THEN 0.96e0 ELSE 0.72e0 END * (confidence / 100)")} AS adjusted_final FROM y1",
    "e23_zone_decision": f"WITH {_CHAIN}, z AS (SELECT asset_id, regime, CASE WHEN asset_id % 9 <> 0 THEN structure END AS zone_score FROM rfs) SELECT *, CASE WHEN zone_score IS NULL THEN 'WATCH' WHEN regime = 'VOLATILE' THEN CASE WHEN zone_score >= 80 THEN 'WATCH' ELSE 'BLOCK' END WHEN zone_score >= 80 THEN 'ALLOW' ELSE 'WATCH' END AS action, CASE WHEN zone_score IS NULL THEN 'NO_ZONE' ELSE 'REGIME_' || regime || ',' || CASE WHEN zone_score >= 80 THEN 'ZONE_HIGH' WHEN regime = 'VOLATILE' THEN 'ZONE_NOT_STRONG' WHEN zone_score >= 60 THEN 'ZONE_MID' ELSE 'ZONE_LOW' END END AS reason_codes, CASE WHEN zone_score IS NULL THEN 'none' WHEN regime = 'VOLATILE' THEN CASE WHEN zone_score >= 80 THEN 'reduced' ELSE 'none' END WHEN regime = 'STABLE' THEN CASE WHEN zone_score >= 80 THEN 'progressive' WHEN zone_score >= 60 THEN 'confirmation' ELSE 'none' END WHEN zone_score >= 60 THEN 'confirmation' ELSE 'reduced' END AS execution_mode FROM z",
    "e26_live_hints": f"WITH {TICK}, g AS (SELECT asset_id, date_trunc('day', ts) AS ws, {r2('avg(price)')} AS a, {r2('quantile_cont(price, 0.5)')} AS m, min(price) AS lo, max(price) AS hi FROM tick GROUP BY ALL), h AS (SELECT *, CASE WHEN a > 0 THEN {r2('(hi - lo) / a * 100')} ELSE 0e0 END AS noise, row_number() OVER (PARTITION BY asset_id ORDER BY ws DESC) AS k FROM g), l AS (SELECT asset_id, {cl('100 - noise / 2')} AS quality_score, {cl('noise')} AS noise_score, {cl('noise / 3')} AS micro_volatility, {r2('(a - m) / 10')} AS price_velocity, noise >= 75 AS torn, CASE WHEN a > m THEN 'UP' WHEN a < m THEN 'DOWN' ELSE 'FLAT' END AS trend FROM h WHERE k = 1) SELECT asset_id, quality_score, noise_score, micro_volatility, price_velocity, {cl(dot((0.45, cl('least(100, abs(price_velocity) * 18)')), (0.35, 'quality_score'), (0.2, '100 - noise_score')))} AS temporal_growth_hint, {cl(dot((0.45, "CASE WHEN trend = 'FLAT' THEN 35 WHEN abs(price_velocity) >= 0.2e0 THEN 80 ELSE 55 END"), (0.35, 'quality_score'), (0.2, '100 - noise_score')))} AS temporal_convergence_hint, {cl(dot((0.4, 'quality_score'), (0.25, '100 - micro_volatility'), (0.25, '100 - noise_score'), (0.1, '100 - CASE WHEN torn THEN 25 ELSE 0 END')))} AS temporal_evolution_hint, {cl(dot((0.4, 'CASE WHEN torn THEN 85 ELSE 25 END'), (0.25, 'micro_volatility'), (0.2, 'noise_score'), (0.15, cl('least(100, abs(price_velocity) * 20)'))))} AS micro_rupture_pressure FROM l",
    "a7_assets_summary": f"{_T}, {_REPORTED}, sm AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (regime = {_q}{r}{_q}) AS n_{r.lower()}' for r in _REGIMES)}, {', '.join(f'{r2(mean2(c))} AS avg_{k}' for k, c in (('stability', 'stability'), ('opportunity', 'opportunity'), ('confidence', 'market_confidence'), ('convergence', 'market_convergence'), ('rupture', 'rupture'), ('continuity', 'continuity')))} FROM rep) SELECT *, CASE WHEN avg_stability < 40 OR avg_rupture >= 70 THEN 'BLOCK' WHEN avg_stability >= 75 AND avg_opportunity >= 70 AND avg_convergence >= 65 AND avg_confidence >= 60 AND avg_continuity >= 60 AND avg_rupture < 40 THEN 'ALLOW' ELSE 'WATCH' END AS decision FROM sm",
    "a21_decision_report": f"{_T}, {_REPORTED}, sc AS (SELECT *, floor(stability * 0.4e0 + opportunity * 0.3e0 + CASE regime WHEN 'STABLE' THEN 100 WHEN 'VOLATILE' THEN 20 ELSE 60 END * 0.2e0 + CASE WHEN day > 0 AND week > 0 THEN 100 WHEN day < 0 AND week < 0 THEN 20 ELSE 60 END * 0.1e0 + 0.5e0) AS score FROM rep), dr AS (SELECT count(*) AS n, min(score) AS least, max(score) AS largest, {', '.join(f'quantile_cont(score, {v}) AS {k}' for k, v in _quart.items())}, {_shares} FROM sc) SELECT *, {_whole('p75')} AS allow_min, {_whole('p40')} AS watch_min, array_to_string({_listed(('allow_pct < 2', 'ALLOW too rare: possible over-filtering'), ('block_pct > 80', 'BLOCK too dominant: thresholds too strict'), ('watch_pct < 20', 'WATCH too rare: watch zone likely too narrow'), ('transition_block_pct > 70', 'TRANSITION over-blocked: WATCH zone likely too narrow'), ('stable_block_pct > 60', 'STABLE over-blocked: MCI may be too restrictive'))}, ',') AS warnings FROM dr",
    "a22_opportunity_report": f"{_T}, orp AS (SELECT count(*) AS n, min(opportunity) AS least, max(opportunity) AS largest, {', '.join(f'{cl(f"quantile_cont(opportunity, {v})")} AS {k}' for k, v in _quart.items())}, {', '.join(f'count(*) FILTER (regime = {_q}{r}{_q}) AS n_{r.lower()}, coalesce({_whole(mean2("opportunity", f" FILTER (regime = {_q}{r}{_q})"))}, 0) AS avg_{r.lower()}' for r in _REGIMES)} FROM dec) SELECT *, {_whole('p40')} AS medium_min, {_whole('p75')} AS high_min, array_to_string({_listed(('n < 20', 'LOW_SAMPLE_SIZE'), ('p75 - p40 < 5', 'LOW_SCORE_SPREAD'))}, ',') AS warnings FROM orp",
    "a23_threshold_report": f"{_T}, tr AS (SELECT count(*) AS n, {', '.join(f'{_pct(f"count(*) FILTER ({c} = {_q}{v}{_q})")} AS {v.lower()}_pct' for c, vs in (('regime', _REGIMES), ('decision', _DECIDE)) for v in vs)}, {', '.join(f'{_fl(c, p)} AS {c}_p{int(p * 100)}' for c in ('stability', 'opportunity') for p in (0.25, 0.5, 0.75, 0.9))} FROM dec) SELECT *, {', '.join(f'{_whole(f"{c}_{p}")} AS {c}_{k}' for c in ('stability', 'opportunity') for k, p in (('high_min', 'p75'), ('medium_min', 'p50')))} FROM tr",
    "w15_backtest_signals": f"{_REPLAY} SELECT * FROM back",
    "a27_backtest_summary": f"{_REPLAY} SELECT count(*) AS total_signals, {', '.join(f'count(*) FILTER (decision = {_q}{d}{_q}) AS {d.lower()}_count' for d in _DECIDE)}, count(*) FILTER (opportunity >= 60) AS high_opportunity_count, {', '.join(f'{r2(mean2(f"return_{k}", w))} AS {n}avg_return_{k}' for n, w in (('', ''), ('allow_', f' FILTER (decision = {_q}ALLOW{_q})'), ('block_', f' FILTER (decision = {_q}BLOCK{_q})'), ('high_opportunity_', ' FILTER (opportunity >= 60)')) for k in (24, 48, 72))} FROM back",
    "a28_store_stats": f"{_T}, {_SAMPLES} SELECT count(*) AS n, max(seq) AS last_seq, {', '.join(f'count(*) FILTER ({c} = {_q}{v}{_q}) AS n_{v.lower()}' for c, vs in (('decision', _DECIDE), ('regime', _REGIMES)) for v in vs)} FROM smp",
    "k11_integrity_chain": f"WITH m AS (SELECT o_custkey AS symbol, o_orderdate AS ts, o_orderkey AS id, concat_ws('|', CAST(o_orderkey AS VARCHAR), CASE o_orderstatus WHEN 'F' THEN 'ALLOW' WHEN 'O' THEN 'WATCH' ELSE 'BLOCK' END, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'VOLATILE' WHEN left(o_orderpriority, 1) = '3' THEN 'TRANSITION' ELSE 'STABLE' END, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END) AS p FROM orders), c AS (SELECT symbol, count(*) AS n, list_reduce(list_prepend('', list(p ORDER BY ts, id)), lambda a, x: sha256(x || a)) AS hash FROM m GROUP BY symbol) SELECT *, sha256(unhex('{_pads[0x5C]}' || sha256(unhex('{_pads[0x36]}' || hex(hash))))) AS signature FROM c",
    "w13_temporal_blocks": f"WITH {HIST}, {_SEG}, {_BLOCKS} SELECT * FROM blocks",
    "w19_structure_7d": f"WITH {TICK}, {RET}, {STATS}, {SHAPE}, {_W19} SELECT *, CASE WHEN validation_score IS NULL THEN 'UNAVAILABLE' WHEN rupture_penalty >= 65 THEN 'BREAK' WHEN validation_score >= 60 THEN 'CONFIRM' WHEN validation_score >= 40 THEN 'WEAKEN' ELSE 'BREAK' END AS validation_state, CASE WHEN validation_score IS NULL THEN 'UNAVAILABLE' WHEN rupture_penalty >= 65 THEN 'UNSTABLE' WHEN validation_score >= 60 THEN 'COHERENT' WHEN validation_score >= 40 THEN 'MIXED' ELSE 'UNSTABLE' END AS pattern_state, CASE WHEN validation_score IS NULL THEN 'partial' WHEN n_prices >= 7 THEN 'computed' ELSE 'partial' END AS status FROM w2",
    "j4_compare_with_history": f"{_H} SELECT * FROM cmp",
    "j4_compare_month_to_month": f"WITH {HIST}, {_SEG}, {_compared(chr(39) + 'MONTH_TO_MONTH' + chr(39))} SELECT * FROM cmp",
    "j5_context_matches": f"{_C} SELECT asset_id, match_id, similarity, weighted_similarity, reasons FROM mt WHERE comparable AND asset_id <> match_id",
    "e2_history": f"{_H}, {_HISTORY} SELECT asset_id, mode, n, occurrence, frequency, convergence, correlation, duration_axis, rupture_occurrence, rupture_frequency, rupture_convergence, rupture_correlation, rupture_duration, rupture_probability, penalty, continuity_probability, quality, quarter_score, baseline, stability, mid_term, crash, crash_status, crash_state, coherence, structure, confidence, market, regime, timing FROM hh",
    "e3_impulse_state": f"{_H}, {_HISTORY}, {_IMPULSE} SELECT asset_id, impulse_compression, impulse_pressure, impulse_instability, impulse_saturation, impulse_exhaustion, CASE WHEN impulse_exhaustion >= 70 THEN 'EXHAUSTION' WHEN impulse_pressure >= 68 AND impulse_instability >= 62 AND abs(r24_change_pct) >= 3 THEN 'RELEASE' WHEN impulse_pressure >= 60 AND impulse_saturation >= 55 THEN 'PRESSURE_BUILDING' WHEN impulse_pressure >= 45 AND impulse_instability <= 55 AND abs(r7_change_pct) <= 4 THEN 'COMPRESSION' ELSE 'NEUTRAL' END AS impulse_state, CASE WHEN up >= 2 AND down = 0 THEN 'UP' WHEN down >= 2 AND up = 0 THEN 'DOWN' WHEN up > 0 AND down > 0 THEN 'MIXED' ELSE 'NEUTRAL' END AS impulse_bias FROM i2",
    "e6_temporal_analysis": f"{_A} SELECT asset_id, {', '.join(f't_{a}{x}' for a in _TA for x in ('', '_calibrated', '_probability'))}, t_coherence, t_structural, t_support, array_to_string(t_list, ',') AS t_warnings FROM ta",
    "e7_rupture_analysis": f"{_A} SELECT asset_id, r_density, r_turning, r_anti_continuity, {', '.join(f'r_{a}{x}' for a in _RA for x in ('', '_probability'))}, r_coherence, r_structural, rupture_probability, risk_rupture, array_to_string(r_list, ',') AS r_warnings FROM ra",
    "e8_recovery_analysis": f"{_A} SELECT asset_id, restart_support, anti_rupture_pressure, reconstruction_quality, recovery_score, array_to_string(list_concat(t_list, list_concat(r_list, {_listed(('recovery_score >= 70', 'recovery_analysis_high_probability'), ('risk_rupture >= 70 AND recovery_score >= 60', 'recovery_analysis_conflict_with_rupture'))})), ',') AS recovery_warnings FROM rec2",
    "e9_comparator": f"WITH {_CHAIN}, x AS (SELECT asset_id, confidence, {cl(dot((0.55, 'rupture'), (0.25, '100 - stability'), (0.1, '100 - duration'), (0.1, '100 - frequency')))} AS rupture_pressure, {cl(dot((0.3, 'convergence'), (0.2, 'frequency'), (0.2, 'duration'), (0.15, 'correlation'), (0.15, '100 - rupture')))} AS recovery_strength FROM rfs), y AS (SELECT *, {cl('recovery_strength - rupture_pressure + 50')} AS dominance_score FROM x), z AS (SELECT asset_id, rupture_pressure, recovery_strength, dominance_score, CASE WHEN dominance_score >= 60 THEN 'RECOVERY_DOMINANT' WHEN dominance_score <= 40 THEN 'RUPTURE_DOMINANT' ELSE 'BALANCED' END AS dominance_state, {cl('abs(recovery_strength - rupture_pressure) * 0.8e0 + confidence * 0.2e0')} AS confidence FROM y) SELECT *, array_to_string({_listed(('rupture_pressure > 70 AND recovery_strength < 40', 'strong_structural_break_risk'), ('recovery_strength > 65 AND rupture_pressure < 45', 'clean_recovery_structure'), ('dominance_score > 40 AND dominance_score < 60', 'indecisive_structure'))}, ',') AS warnings FROM z",
    "e12_orchestrator": f"{_T}, {_SAMPLES}, {_PRIOR}, {funnel('gl', 'allow_threshold', 'risk_threshold', 'support_threshold', 'orc')} SELECT asset_id, n_prior, maturity, allow_threshold, block_threshold, risk_threshold, support_threshold, decision_score, decision, reason FROM orc",
    "e14_context_comparison": f"{_C} {_COMPARED}",
    "a13_calibration_policy": f"{_T}, {_SAMPLES} SELECT count(*) AS n, {_floor_p('allow_raw_score', 0.75, 76)} AS allow, {_floor_p('block_raw_score', 0.75, 72)} AS block, {_floor_p('risk_probability', 0.75, 70)} AS risk, {_floor_p('support_probability', 0.5, 50)} AS support, CASE WHEN count(*) = 0 THEN 'fallback' ELSE 'calibrated' END AS source FROM smp",
    "a15_calibration_summary": f"{_T}, {_SAMPLES}, {_SUMMARY} SELECT *, {', '.join(_state(c) for c in ('allow_pressure', 'watch_pressure', 'block_pressure', 'rupture_pressure', 'recovery_pressure'))}, CASE WHEN recovery_pressure - rupture_pressure > 10 THEN 'recovery_dominant' WHEN recovery_pressure - rupture_pressure < -10 THEN 'rupture_dominant' ELSE 'balanced' END AS dominant_side, {cl(dot((0.2, 'occurrence'), (0.2, 'frequency'), (0.25, 'convergence'), (0.2, 'correlation'), (0.15, 'duration')) + ' - rupture_pressure * 0.25e0')} AS aggregated FROM k1",
    "a17_adaptive_thresholds": f"{_T} SELECT count(*) AS n, CASE WHEN count(*) < 40 THEN 'fallback' ELSE 'adaptive' END AS source, {', '.join(f'count(*) FILTER (regime = {chr(39)}{r}{chr(39)}) AS n_{r.lower()}' for r in ('STABLE', 'TRANSITION', 'VOLATILE'))}, {', '.join(_adaptive(x) for x in _ADAPTIVE.splitlines())}, CASE WHEN count(*) < 40 THEN 'adaptive_thresholds_insufficient_global_sample' ELSE array_to_string({_listed(*[(f'count(*) FILTER (regime = {chr(39)}{r}{chr(39)}) < 12', f'adaptive_thresholds_insufficient_{r.lower()}_sample') for r in ('STABLE', 'TRANSITION', 'VOLATILE')])}, ',') END AS warnings FROM dec",
    "a24_outcome_statistics": f"WITH {_CHAIN}, {_CTX}, {OCC}, {_OUT} SELECT asset_id, sample_size, valid_matches, continuation_probability, correction_probability, confidence, {', '.join(f'CASE WHEN none THEN 0e0 ELSE {cl(v)} END AS {n}_weight' for n, v in (('continuation', 'c_on'), ('correction', 'c_off'), ('total', 'c_on + c_off')))}, CASE WHEN valid_matches = 0 THEN 'statistics_no_valid_matches' WHEN none THEN 'statistics_weighted_total_zero' ELSE array_to_string({_listed(('valid_matches < 3', 'statistics_low_match_count'), ('continuation_probability < 55 AND correction_probability < 55', 'statistics_probabilities_not_decisive'))}, ',') END AS warnings FROM oi",
    "f4_sample_issues": f"{_T}, {_SAMPLES}, {_FAULTY} SELECT seq, array_to_string({_listed(('seq IS NULL', 'INVALID_SAMPLE_REQUIRED_NUMERIC:seq'), ('trim(version) = ' + chr(39) * 2, 'INVALID_SAMPLE_REQUIRED_FIELD:version'), ('decision NOT IN (' + chr(39) + 'ALLOW' + chr(39) + ', ' + chr(39) + 'WATCH' + chr(39) + ', ' + chr(39) + 'BLOCK' + chr(39) + ')', 'INVALID_SAMPLE_CONTRACT:decision'), *_score_issue('decision_score'), *_score_issue('allow_raw_score'), *_score_issue('block_raw_score'), *_score_issue('support_probability'), *_score_issue('risk_probability'), *_score_issue('market_confidence'), ('neutralization_severity = ' + chr(39) + 'extreme' + chr(39), 'INVALID_GOVERNANCE_CONTRACT:neutralization_severity'))}, ',') AS issues FROM bad",
    "f5_policy_samples": f"{_T}, {_SAMPLES}, {_FAULTY} SELECT seq, regime, decision, decision_score FROM bad WHERE version = 'v8' AND horizon = '7D' AND decision IN ('ALLOW', 'WATCH', 'BLOCK') AND regime IN ('STABLE', 'TRANSITION', 'VOLATILE') AND decision_score IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _nums)}",
}

#: Queries that are asked of the market's series as well, where all regimes, decisions and maturities occur.
ON_MARKET = ("e1_rfs_market", "e6_temporal_analysis", "e7_rupture_analysis", "e8_recovery_analysis", "e9_comparator", "e10_market_gate", "e11_decision_funnel", "e12_orchestrator", "e15_calibration_layer", "e23_zone_decision", "e24_simple_decision", "e14_context_comparison", "j5_context_matches", "f4_sample_issues", "f5_policy_samples", "f10_access_policy", "o2_engine_sort", "o7_top_opportunities", "w19_structure_7d", "w20_behavior_7d", "w21_priority", "a2_decision_summary", "a5_market_context", "a11_decision_distribution", "a12_reason_histogram", "a13_calibration_policy", "a15_calibration_summary", "a17_adaptive_thresholds", "a19_score_stats", "a22_opportunity_report", "a23_threshold_report", "a28_store_stats", "a31_summary_view", "a32_simple_distribution")

def _piece(new: str, old: str, value: str, text: bool = True) -> str:
    """A member of a JSON object under its newer or older name, by the sample's number; in the dialect that both engines read."""
    quoted = f"concat('\"', {value}, '\"')" if text else f"CAST({value} AS STRING)"
    return f"concat('\"', CASE WHEN seq % 2 = 0 THEN '{new}' ELSE '{old}' END, '\":', {quoted})"


#: A sample as JSON text: every thirteenth is none, others have words that aren't known, numbers as text, text as numbers, nulls.
PAYLOAD = f"""CASE WHEN seq % 13 = 0 THEN 'not json' ELSE concat('{{', concat_ws(',',
 CASE WHEN seq % 5 = 0 THEN '"final_decision":"ALLOW","observed_decision":null' ELSE {_piece('observed_decision', 'final_decision', "CASE WHEN seq % 7 = 0 THEN 'MAYBE' ELSE decision END")} END,
 CASE WHEN seq % 9 = 0 THEN '"regime":3' ELSE {_piece('observed_regime', 'regime', 'regime')} END, {_piece('observed_horizon', 'horizon', "CASE WHEN seq % 6 = 0 THEN '9D' ELSE horizon END")},
 CASE WHEN seq % 3 = 0 THEN '"reliability":"low","sample_reliability":"high"' WHEN seq % 3 = 1 THEN '"observed_reliability":"medium"' END, {_piece('dominance_state', 'mci_dominance_state', "CASE WHEN seq % 4 = 0 THEN 'RECOVERY' WHEN seq % 4 = 1 THEN 'RUPTURE' ELSE 'balanced' END")},
 {_piece('neutralization_reason', 'neutralization_reason', 'neutralization_reason')}, {_piece('neutralization_severity', 'neutralization_severity', 'neutralization_severity')}, {_piece('rupture_evolution_state', 'rupture_evolution_state', 'rupture_state')},
 {_piece('observed_analytical_version', 'analytical_version', "CASE WHEN seq % 8 = 0 THEN '  ' ELSE version END")}, {_piece('observed_reason', 'decision_reason', "concat(' ', reason)")},
 CASE WHEN seq % 11 = 0 THEN {_piece('mci_decision_score', 'decision_score', 'decision_score')} ELSE {_piece('mci_decision_score', 'decision_score', 'decision_score', False)} END, {_piece('mci_allow_raw_score', 'allow_raw_score', 'allow_raw_score', False)}, {_piece('mci_block_raw_score', 'block_raw_score', 'block_raw_score + 60', False)},
 CASE WHEN seq % 10 <> 0 THEN {_piece('mci_decision_support_probability', 'decision_support_probability', 'support_probability', False)} END, {_piece('mci_risk_rupture_probability', 'risk_rupture_probability', 'risk_probability', False)}, {_piece('confidence_score', 'confidence', 'market_confidence', False)}), '}}') END"""


def _normal() -> str:
    """Each field by its names, words and default."""
    words = {
        "observed_decision": ("observed_decision final_decision", "ALLOW BLOCK WATCH", "WATCH"), "observed_regime": ("observed_regime regime", "STABLE VOLATILE TRANSITION", "TRANSITION"), "observed_horizon": ("observed_horizon horizon", "24H 7D 14D 30D default", "7D"),
        "observed_reliability": ("reliability sample_reliability observed_reliability", "high medium low none", "none"), "dominance_state": ("dominance_state mci_dominance_state", "recovery_dominant rupture_dominant balanced RECOVERY RUPTURE NEUTRAL", "unknown"),
        "neutralization_reason": ("neutralization_reason", "insufficient_data contradictory_structure unstable_distribution excessive_decay excessive_rupture invalid_temporal_alignment low_confidence degraded_snapshot corrupted_distribution none", "none"),
        "neutralization_severity": ("neutralization_severity", "low medium high critical none", "none"), "rupture_evolution_state": ("rupture_evolution_state", "improving stable worsening explosive unknown", "unknown"),
    }
    texts = {"observed_analytical_version": "observed_analytical_version analytical_version", "observed_reason": "observed_reason mci_decision_reason decision_reason"}
    numbers = {k: f"{k} {k.removeprefix('mci_')}" for k in ("mci_decision_score", "mci_allow_raw_score", "mci_block_raw_score", "mci_decision_support_probability", "mci_risk_rupture_probability")} | {"confidence_score": "confidence_score confidence"}
    first = lambda names: "coalesce(" + ", ".join(f"CASE WHEN json_type(p, '$.{n}') <> 'NULL' THEN json_extract(p, '$.{n}') END" for n in [*names.split(), "none_at_all"]) + ")"
    raw = ", ".join(f"{first(names)} AS r_{k}" for k, names in ({k: v[0] for k, v in words.items()} | texts | numbers).items())
    said = lambda k: f"(r_{k} ->> '$')"
    is_text, is_number = (lambda k: f"json_type(r_{k}) = 'VARCHAR'"), (lambda k: f"json_type(r_{k}) IN ('BIGINT', 'UBIGINT', 'DOUBLE')")
    fits = lambda k, ws: f"({is_text(k)} AND {said(k)} IN ({', '.join(f'{_q}{w}{_q}' for w in ws.split())}))"
    old = lambda k: f"CASE {said(k)} WHEN 'RECOVERY' THEN 'recovery_dominant' WHEN 'RUPTURE' THEN 'rupture_dominant' WHEN 'NEUTRAL' THEN 'balanced' ELSE {said(k)} END" if k == "dominance_state" else said(k)
    value = lambda k: f"CASE WHEN {is_number(k)} THEN CAST(r_{k} AS DOUBLE) END"
    out = [f"CASE WHEN {fits(k, ws)} THEN {old(k)} ELSE '{other}' END AS {k}" for k, (_, ws, other) in words.items()] + [f"CASE WHEN {is_text(k)} AND trim({said(k)}) <> '' THEN trim({said(k)}) ELSE 'unknown' END AS {k}" for k in texts] + [f"{cl(value(k))} AS {k}" for k in numbers]
    why = [("p IS NULL", "payload")]
    for k, (_, ws, _) in words.items():
        why += [(f"r_{k} IS NOT NULL AND NOT {is_text(k)}", f"{k}:type"), (f"{is_text(k)} AND NOT {fits(k, ws)}", f"{k}:value")]
    for k in texts:
        why += [(f"r_{k} IS NOT NULL AND NOT {is_text(k)}", f"{k}:type"), (f"{is_text(k)} AND trim({said(k)}) = ''", f"{k}:value")]
    for k in numbers:
        why += [(f"r_{k} IS NOT NULL AND NOT {is_number(k)}", f"{k}:type"), (f"{is_number(k)} AND CAST(r_{k} AS DOUBLE) NOT BETWEEN 0 AND 100", f"{k}:value")]
    return f"{_T}, {_SAMPLES}, tx AS (SELECT seq, {PAYLOAD} AS payload FROM smp), ob AS (SELECT seq, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM tx), rw AS (SELECT seq, p, {raw} FROM ob) SELECT seq, {', '.join(out)}, array_to_string({_listed(*why)}, ',') AS rejects FROM rw"


def _regulator() -> str:
    """Windows of 25 decisions one after another, each under the thresholds that the one before has left."""
    valves = ((0, 0, 0), (2, 1, 0), (4, 2, 1), (1, 1, -3), (-8, -5, -1), (-6, -3, -1), (-4, -2, 0), (-2, -1, 0))
    risky = lambda k: f"rupture >= {68 + valves[k][2]}"
    allowed = lambda k: f"NOT ({risky(k)}) AND temporal_gate AND support_probability >= {64 + valves[k][1]} AND market_confidence >= 40 AND (regime <> 'TRANSITION' OR rupture < {60 + valves[k][2]}) AND regime <> 'VOLATILE' AND dominance_gate AND decision_score >= {76 + valves[k][0]}"
    r4 = lambda x: f"floor(({x}) * 10000 + 0.5e0) / 10000"
    mean = lambda c: cl(f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100)")
    near = dot((0.25, mean("decision_score")), (0.2, mean("support_probability")), (0.15, mean("recovery_probability")), (0.15, mean("stability")), (0.15, mean("market_convergence")), (0.1, mean("market_confidence")))
    quality = dot((0.2, mean("occurrence")), (0.18, mean("frequency")), (0.24, mean("convergence")), (0.2, mean("correlation")), (0.18, mean("duration")))
    pick = lambda at: f"CASE state {' '.join(f'WHEN {k} THEN {v[at]}' for k, v in enumerate(valves))} END"
    names = ("BALANCED_FLOW", "STRUCTURE_TOO_WEAK", "OVER_OPEN", "RISK_UNDER_BLOCKED", "HARD_DEFENSIVE_LOCK", "MINIMUM_FLOW_LOCK", "OPENING_BIAS", "OPENING_BIAS")
    state = "CASE WHEN quality < 42 THEN 1 WHEN allow >= 0.22e0 THEN 2 WHEN block <= 0.08e0 AND allow >= 0.1e0 THEN 3 WHEN allow <= 0.01e0 AND watch >= 0.82e0 AND quality >= 62 AND near >= 58 THEN 4 WHEN allow < 0.04e0 AND watch >= 0.75e0 AND near >= 48 THEN 5 WHEN allow <= 0.06e0 AND watch >= 0.72e0 AND near >= 48 THEN 6 WHEN allow < 0.1e0 AND watch >= 0.65e0 AND near >= 48 THEN 7 ELSE 0 END"
    return f"""{_T.replace('WITH', 'WITH RECURSIVE', 1)}, ord AS (SELECT dec.*, rfs.occurrence, rfs.frequency, rfs.convergence, rfs.correlation, rfs.duration, (row_number() OVER (ORDER BY dec.asset_id) - 1) // 25 AS win FROM dec JOIN rfs USING (asset_id)),
wn AS (SELECT win, count(*) AS n, {cl(quality)} AS quality, {cl(f"{cl(near)} - {cl(mean('rupture') + ' * 0.25e0')}")} AS near, [{', '.join(f'count(*) FILTER ({allowed(k)})' for k in range(8))}] AS al, [{', '.join(f'count(*) FILTER ({risky(k)})' for k in range(8))}] AS bl FROM ord GROUP BY win),
st AS (SELECT CAST(-1 AS BIGINT) AS win, 0 AS state, 0 AS prev UNION ALL SELECT g.win, {state}, g.prev FROM (SELECT wn.*, st.state AS prev, {r4('al[st.state + 1] / n')} AS allow, {r4('bl[st.state + 1] / n')} AS block, {r4('(n - al[st.state + 1] - bl[st.state + 1]) / n')} AS watch FROM st JOIN wn ON wn.win = st.win + 1) g),
fl AS (SELECT wn.win, n, quality, near, state, {r4('al[prev + 1] / n')} AS allow, {r4('(n - al[prev + 1] - bl[prev + 1]) / n')} AS watch, {r4('bl[prev + 1] / n')} AS block FROM wn JOIN st USING (win)),
gp AS (SELECT *, {r4('allow - 0.1e0')} AS ag, {r4('watch - 0.7e0')} AS wg, {r4('block - 0.2e0')} AS bg, {r4('allow - 0.04e0')} AS mg FROM fl),
pr AS (SELECT *, {cl('greatest(0e0, -ag) * 100 * 0.35e0 + greatest(0e0, wg) * 100 * 0.25e0 + quality * 0.25e0 + near * 0.15e0')} AS op, {cl('greatest(0e0, ag) * 100 * 0.35e0 + greatest(0e0, -bg) * 100 * 0.25e0 + (100 - quality) * 0.2e0 + greatest(0e0, 48 - near) * 0.2e0')} AS cp FROM gp)
SELECT win AS "window", n, allow, watch, block, ag AS allow_gap, wg AS watch_gap, bg AS block_gap, mg AS minimum_flow_gap, {cl('(abs(ag) + abs(wg) + abs(bg)) * 100')} AS flow_imbalance, quality AS structural_quality, near AS score_proximity, op AS opening_pressure, cp AS closing_pressure, {cl('50 + op - cp')} AS net_pressure,
 CASE state {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(names))} END AS pressure_state, CASE state WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS opening_level, {pick(0)} AS allow_valve, {pick(1)} AS support_valve, {pick(2)} AS risk_valve FROM pr"""


_capital = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
ORACLE_SQL["x_scalars"] = f"""WITH h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_brand, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, left(regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g'), 20) AS symbol, {_capital("regexp_replace(p_type, '[-_]+', ' ', 'g')")} AS title, lower(to_base(h, 36)) AS fingerprint, {r2('p_retailprice / 7')} AS share FROM h"""
_SCAN = f"""WITH {MARKET_TICK}, few AS (SELECT asset_id, idx, price FROM tick WHERE asset_id % 17 <> 0 OR idx < 6),
hist AS (SELECT asset_id, CAST(DATE '2026-01-01' AS TIMESTAMP) + to_days(CAST(row_number() OVER (PARTITION BY asset_id ORDER BY idx) - 1 AS INT)) AS ts, price FROM few WHERE price > 0), {_SEG}, {_BLOCKS}, {_compared(_BY_SPAN)}, {_HISTORY},
mv AS (SELECT *, lag(r) OVER (PARTITION BY asset_id ORDER BY ts) AS b FROM (SELECT *, (price - lag(price) OVER o) / lag(price) OVER o * 100 AS r FROM hist WINDOW o AS (PARTITION BY asset_id ORDER BY ts))),
sg AS (SELECT asset_id, (arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts) * 100 AS sl, (max(price) - min(price)) / arg_max(price, ts) * 100 AS am, CASE WHEN count(r) = 0 THEN 0e0 ELSE {within('stddev_pop(r) * 12', 0, 100)} END AS un, CASE WHEN count(r) < 2 THEN 0e0 ELSE count(*) FILTER (b IS NOT NULL AND (r * b < 0 OR abs(r) >= 7)) / (count(r) - 1) END AS br FROM mv GROUP BY asset_id),
hx AS (SELECT hh.* REPLACE (sl AS slope_pct, am AS amplitude_pct, un AS instability, br AS break_rate, coalesce(week, 0e0) AS r7_change_pct, coalesce(week, 0e0) AS r7_slope_pct, stability AS r7_stability, rupture_probability AS r7_rupture, coalesce(day, 0e0) AS r24_change_pct, coalesce(day, 0e0) AS r24_slope_pct, stability AS r24_stability, rupture_probability AS r24_rupture) FROM hh JOIN sg USING (asset_id) LEFT JOIN facts USING (asset_id)),
{_IMPULSE.replace('FROM hh)', 'FROM hx)')}, {_IS[_IS.index('imp AS ('):]},
ad AS (SELECT asset_id, CASE WHEN {_fits('exhaustion')} THEN 'EXHAUSTION' WHEN {_fits('release')} THEN 'RELEASE' WHEN {_fits('pressure_building')} THEN 'PRESSURE_BUILDING' WHEN {_fits('compression')} THEN 'COMPRESSION' ELSE 'NEUTRAL' END AS adaptive, warnings AS w FROM imp, pol),
sc AS (SELECT i2.*, adaptive, w FROM i2 JOIN ad USING (asset_id))
SELECT a.asset_id, CASE WHEN stability IS NULL THEN 'partial' ELSE 'computed' END AS status, coalesce(regime, 'TRANSITION') AS regime, crash_state, stability, structure, market, coherence, rupture_probability, penalty, continuity_probability, confidence, crash, impulse_pressure, impulse_instability, impulse_saturation, impulse_exhaustion,
 CASE WHEN up >= 2 AND down = 0 THEN 'UP' WHEN down >= 2 AND up = 0 THEN 'DOWN' WHEN up > 0 AND down > 0 THEN 'MIXED' ELSE 'NEUTRAL' END AS impulse_bias, coalesce(adaptive, 'NEUTRAL') AS impulse_state, CASE WHEN stability IS NULL THEN 'scan_engine_insufficient_rfs_prices' ELSE w END AS warnings FROM (SELECT DISTINCT asset_id FROM few) a LEFT JOIN sc USING (asset_id)"""
ORACLE_SQL["e5_scan_engine"] = _SCAN
ORACLE_SQL["p10_normalised_samples"] = on_market(_normal())
ORACLE_SQL["e16_flow_regulator"] = on_market(_regulator())
ORACLE_SQL["k1_versioned_memory"] = f"""WITH m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'ALLOW' WHEN 'O' THEN 'WATCH' ELSE 'BLOCK' END AS action, o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000000 ELSE 0 END AS created FROM orders),
s AS (SELECT l_orderkey AS id, {r2('max(l_extendedprice) / 1000 - 30')} AS result FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY l_orderkey),
k AS (SELECT id, action, CASE WHEN s.id IS NULL THEN 'open' ELSE 'resolved' END AS status, result, created FROM m LEFT JOIN s USING (id) WHERE action <> 'BLOCK'),
n AS (SELECT *, row_number() OVER (ORDER BY created, id) AS place, count(*) OVER () AS n FROM k)
SELECT id, action, status, result, created FROM n WHERE place > least(250, greatest(0, n - 10000))"""
_STORE = """WITH ev AS (SELECT user_id % 4 AS shard, user_id AS key, event_id, epoch_us(ts) AS ts_us, CASE event_type WHEN 'purchase' THEN 'put' WHEN 'signup' THEN 'delete' ELSE 'get' END AS action, value FROM events),
nu AS (SELECT *, count(*) FILTER (action = 'put') OVER (PARTITION BY shard ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM ev),
la AS (SELECT g.shard, g.event_id, g.key, g.ts_us, g.n, arg_max(p.action, (p.ts_us, p.event_id)) AS action, arg_max(p.ts_us, (p.ts_us, p.event_id)) AS put_at, arg_max(p.n, (p.ts_us, p.event_id)) AS put_n, arg_max(p.value, (p.ts_us, p.event_id)) AS v FROM nu g LEFT JOIN nu p ON p.key = g.key AND p.action <> 'get' AND (p.ts_us, p.event_id) < (g.ts_us, g.event_id) WHERE g.action = 'get' GROUP BY ALL),
oc AS (SELECT *, CASE WHEN action IS NULL OR action = 'delete' OR put_at + 2 * 129600000000 <= ts_us THEN 'miss' WHEN put_at + 129600000000 <= ts_us THEN 'expired' WHEN n - put_n >= 20 THEN 'evicted' ELSE 'hit' END AS outcome FROM la)
SELECT shard, event_id, key, ts_us, outcome, CASE WHEN outcome = 'hit' THEN v END AS value FROM oc"""
ORACLE_SQL |= {"t4_expiring_store": _STORE, "t4_expiring_store_table": _STORE}
ORACLE_SQL["t8_online_thresholds"] = on_market(f"{_T}, {_SAMPLES}, {_PRIOR} SELECT 'v8' AS version, '7D' AS horizon, asset_id AS seq, asset_id, n_prior, allow_threshold, block_threshold, risk_threshold, support_threshold FROM learnt")
ORACLE_SQL |= {f"{name}_market": on_market((_FIRST | ORACLE_SQL)[name]) for name in ON_MARKET}
#: Of the market all contexts are compared with all.
ORACLE_SQL["e14_context_comparison_market"] = on_market(f"WITH {_CHAIN}, {_contexts('')} {_COMPARED}")
