import datetime as dt
import random

from tidepool.operators import decisions
from tidepool.streaming import stores


def test_the_log_as_state_gives_what_ranges_give(spark):
    rnd = random.Random(1)
    rows = [(7 * i, i, v, "7D", rnd.choice([10.0, 40.0, 80.0, None]), *[round(rnd.random() * 100, 2) for _ in range(4)]) for v in ("v8", "v9") for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, asset_id long, version string, horizon string, market_confidence double, allow_raw_score double, block_raw_score double, risk_probability double, support_probability double")
    got = stores.played(df, "seq", lambda s: stores.online_thresholds(s, 60, 20), stores.THRESHOLDS, slices=3).collect()
    want = decisions.prior_thresholds(df, 60, 20).drop("maturity").collect()
    assert len(got) == 300 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_reads_of_the_store(spark):
    """A time to live of 10 minutes and two places: each outcome, with the stream and the table alike."""
    t0 = dt.datetime(2024, 5, 1)
    steps = [(0, 1, "get"), (1, 1, "put"), (2, 1, "get"), (3, 2, "put"), (4, 1, "get"), (5, 3, "put"), (6, 1, "get"), (7, 2, "get"), (8, 2, "put"), (9, 3, "delete"), (10, 3, "get"), (17, 2, "get"), (18, 2, "get"), (27, 2, "get"), (29, 2, "get"), (90, 9, "put"), (91, 9, "get")]
    rows = [(0, k, i, t0 + dt.timedelta(minutes=m), a, float(i)) for i, (m, k, a) in enumerate(steps)] + [(1, 5, 100, t0, "get", 1.0)]
    events = spark.createDataFrame(rows, "shard long, key long, event_id long, ts timestamp, action string, value double")
    ttl = 10 * 60 * 1_000_000
    table = {r.event_id: (r.outcome, r.value) for r in stores.stored_reads(events, 2, ttl).collect()}
    miss, gone = ("miss", None), ("expired", None)
    assert table == {0: miss, 2: ("hit", 1.0), 4: ("hit", 1.0), 6: ("evicted", None), 7: ("hit", 3.0), 10: miss, 11: ("hit", 8.0), 12: gone, 13: gone, 14: miss, 16: ("hit", 15.0), 100: miss}
    stream = stores.played(events, "ts", lambda s: stores.stored_reads(s, 2, ttl), stores.READS, late="1 minute", slices=3)
    assert {r.event_id: (r.outcome, r.value) for r in stream.collect()} == table


def test_slices_grow_with_the_table(spark):
    """However many rows there are, a micro-batch has about as many as are asked for."""
    df = spark.range(300).selectExpr("id AS seq", "id AS asset_id", "'v8' AS version", "'7D' AS horizon", "50D AS market_confidence", "1D AS allow_raw_score", "2D AS block_raw_score", "3D AS risk_probability", "4D AS support_probability")
    got = stores.played(df, "seq", lambda s: stores.online_thresholds(s, 60, 20), stores.THRESHOLDS, slices=2, most=40)
    assert got.count() == 300 and len(got.inputFiles()) >= 8


def test_a_shards_keys_share_cells(spark, monkeypatch):
    """Many keys in a few cells, over slices and times to live: the stream gives the table's reads, and keeps no more values than cells."""
    monkeypatch.setattr(stores, "_HOUR", 60_000)
    rnd, t0 = random.Random(3), dt.datetime(2024, 5, 1)
    rows = [(i % 2, rnd.choice([-3, *range(40)]), i, t0 + dt.timedelta(seconds=i * 7 // 2), rnd.choice(["put", "get", "get", "delete"]), rnd.choice([None, float(i)])) for i in range(900)]
    events = spark.createDataFrame(rows, "shard long, key long, event_id long, ts timestamp, action string, value double")
    ttl = 4 * 60 * 1_000_000
    want = sorted(map(tuple, stores.stored_reads(events, 4, ttl).collect()), key=lambda r: r[1])
    got = stores.played(events, "ts", lambda s: stores.stored_reads(s, 4, ttl), stores.READS, late="1 second", slices=7)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want and {r[4] for r in want} == {"hit", "miss", "expired", "evicted"}


class _State(dict):
    """A map state as a processor sees it; counts its calls."""

    calls = 0

    def containsKey(self, k):  # noqa: N802
        self.calls += 1
        return k in self

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self.calls += 1
        self[k] = v

    def exists(self):
        return False

    def update(self, v):
        self.n = v

    def iterator(self):
        return iter(self.items())


def test_state_is_asked_by_cells_not_by_keys():
    """What a batch asks of the state doesn't grow with its keys."""
    import pandas as pd

    store, n = stores.ExpiringStore(20, 10**9), 20_000
    state, puts = _State(), _State()
    store.init(type("Handle", (), {"getMapState": lambda *_: state, "getValueState": lambda *_: puts, "registerTimer": lambda *_: None})())
    rows = pd.DataFrame({"shard": 0, "key": [i // 2 for i in range(2 * n)], "event_id": range(2 * n), "ts_us": range(2 * n), "action": ["get", "put"] * n, "value": 1.0})
    assert len(pd.concat(list(store.handleInputRows((0,), iter([rows]), None)))) == n and state.calls < n // 4
