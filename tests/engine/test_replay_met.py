import random

import numpy as np
from pyspark.sql import functions as F

from tests.engine.test_replay import table, walk
from tidepool.functions.kernel import round2
from tidepool.operators import history, replay


def test_months_are_met_as_arrays(spark):
    """Sums of comparisons as arrays are those of rows; a replay makes no row for each month that a point meets."""
    rnd = random.Random(4)
    one = lambda: (rnd.choice(history.KINDS), round(rnd.uniform(-30, 30), 2), round(rnd.uniform(0, 60), 2), round(rnd.uniform(0, 100), 2), round(rnd.random(), 2), round(rnd.uniform(0, 100), 2))
    rows = [(rnd.choice([0, 1, 3]), one(), *one()) for _ in range(200)]
    signature = ", ".join(f"{f} {'string' if f == 'kind' else 'double'}" for f in replay.COMPARED)
    df = spark.createDataFrame(rows, f"of int, now struct<{signature.replace(' ', ':').replace(',:', ', ')}>, {signature}").withColumn("alike", history.likeness())
    want = {r.of: r for r in df.select("of", *[round2(v).alias(k) for k, v in history.comparisons().items()]).groupBy("of").agg(*history.summed()).collect()}
    side = lambda rs: {f: np.array([history.KINDS.index(r[k]) if f == "kind" else r[k] for r in rs]) for k, f in enumerate(replay.COMPARED)}
    got = history.met(side([r[1] for r in rows]), side([r[2:] for r in rows]), np.array([r[0] for r in rows]), 4)
    assert all(got[c][k] == want[k][c] for c in replay.MET for k in (0, 1, 3)) and got["n"][2] == 0 and np.isnan(got["m_gap"][2])
    plan = replay.replay(table(spark, {1: walk(1, 330)}))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list(CASE" not in plan
