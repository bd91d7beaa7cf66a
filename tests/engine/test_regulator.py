import random

import pytest

from tidepool.operators import regulator

NAMES = ("regime", "rupture", "temporal_gate", "support_probability", "market_confidence", "dominance_gate", "decision_score", "recovery_probability", "stability", "market_convergence", "occurrence", "frequency", "convergence", "correlation", "duration", "window")


def log(seed, windows, size):
    rnd = random.Random(seed)
    rows = []
    for w in range(windows):
        good = rnd.choice([20, 45, 60, 75, 85])
        for _ in range(size):
            s = lambda: round(min(100.0, max(0.0, rnd.gauss(good, 12))), 2)
            rows.append((rnd.choice(["STABLE", "TRANSITION", "STABLE", "VOLATILE"]), round(max(0.0, rnd.gauss(75 - good / 2, 22)), 2), rnd.random() < 0.9, s(), s(), rnd.random() < 0.9, s(), s(), s(), s(), s(), s(), s(), s(), s(), w))
    return rows


def up2(x, k=100):
    from math import floor

    return floor(x * k + 0.5) / k


def score(x):
    return up2(min(100.0, max(0.0, x)))


def one_by_one(rows, windows):
    """The loop: each window decides under the thresholds that the one before has left."""
    valves, out = (0, 0, 0), []
    for w in range(windows):
        mine = [dict(zip(NAMES, r, strict=True)) for r in rows if r[-1] == w]
        allow, support, risk = 76 + valves[0], 64 + valves[1], 68 + valves[2]
        blocked = [x["rupture"] >= risk for x in mine]
        passed = [not b and x["temporal_gate"] and x["support_probability"] >= support and x["market_confidence"] >= 40 and (x["regime"] != "TRANSITION" or x["rupture"] < risk - 8) and x["regime"] != "VOLATILE" and x["dominance_gate"] and x["decision_score"] >= allow for x, b in zip(mine, blocked, strict=True)]
        n = len(mine)
        a, b, c = up2(sum(passed) / n, 10_000), up2(sum(blocked) / n, 10_000), up2((n - sum(passed) - sum(blocked)) / n, 10_000)
        mean = lambda k: score(sum(round(x[k] * 100) for x in mine) / (n * 100))  # noqa: B023, E731
        quality = score(sum(v * mean(k) for k, v in regulator.QUALITY.items()))
        near = score(score(sum(v * mean(k) for k, v in regulator.NEARNESS.items())) - score(mean("rupture") * 0.25))
        state = ("STRUCTURE_TOO_WEAK", 0) if quality < 42 else ("OVER_OPEN", 0) if a >= 0.22 else ("RISK_UNDER_BLOCKED", 0) if b <= 0.08 and a >= 0.1 else ("HARD_DEFENSIVE_LOCK", 4) if a <= 0.01 and c >= 0.82 and quality >= 62 and near >= 58 else ("MINIMUM_FLOW_LOCK", 3) if a < 0.04 and c >= 0.75 and near >= 48 else ("OPENING_BIAS", 2) if a <= 0.06 and c >= 0.72 and near >= 48 else ("OPENING_BIAS", 1) if a < 0.1 and c >= 0.65 and near >= 48 else ("BALANCED_FLOW", 0)
        valves = next(v[2:] for v in regulator.VALVES if v[:2] == state)
        out.append((w, a, c, b, *state, *valves))
    return out


@pytest.mark.parametrize("block", [1, 4, 512])
def test_blocks_of_windows_give_what_the_loop_gives(spark, block):
    rows = log(3, 23, 40)
    df = spark.createDataFrame(rows, "regime string, rupture double, temporal_gate boolean, support_probability double, market_confidence double, dominance_gate boolean, decision_score double, recovery_probability double, stability double, market_convergence double, occurrence double, frequency double, convergence double, correlation double, duration double, window long")
    got = [(r.window, r.allow, r.watch, r.block, r.pressure_state, r.opening_level, r.allow_valve, r.support_valve, r.risk_valve) for r in regulator.regulated(df, block).orderBy("window").collect()]
    want = one_by_one(rows, 23)
    assert len({x[4:6] for x in want}) >= 4 and got == want
    assert regulator.regulated(df.limit(0)).count() == 0
