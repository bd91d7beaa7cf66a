"""Stores kept as keyed state: a log of decisions that thresholds are learnt from as it grows, and a bounded store whose entries expire.

Both take what arrives in the order of their sequence: within a micro-batch rows are sorted by it, and a batch holds nothing
that belongs before the one before. State is bounded: the log by its length, the store by its places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from tidepool.functions.kernel import clamp_score
from tidepool.operators.decisions import LEARNT, sliding_percentiles
from tidepool.sources.stage import shared_dir, staged

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SCORES = [c for c, _ in LEARNT.values()]
THRESHOLDS = "version string, horizon string, seq long, asset_id long, n_prior long, " + ", ".join(f"{k}_threshold double" for k in LEARNT)


class SampleLog(StatefulProcessor):
    """The last samples of one version and horizon. Each new one gets the thresholds of those before it, and then joins them."""

    def __init__(self, most: int, least: int) -> None:
        self.most, self.least = most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "seq long, market_confidence double, " + ", ".join(f"{c} double" for c in _SCORES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        columns = ["seq", "market_confidence", *_SCORES]
        past = pd.DataFrame(list(self.log.get()) if self.log.exists() else [], columns=columns)
        fresh = new[[*columns, "asset_id"]].assign(carried=False)
        both = pd.concat([past.assign(carried=True, asset_id=-1), fresh], ignore_index=True) if len(past) else fresh.reset_index(drop=True)
        both = both.assign(version=key[0], horizon=key[1], place=range(len(both)))
        both["carried"] = both["carried"].astype(bool)
        learnt = sliding_percentiles(both, self.most, self.least)
        self.log.put([tuple(r) for r in both[columns].tail(self.most).itertuples(index=False)])
        yield learnt.astype({"asset_id": "int64", "seq": "int64", "n_prior": "int64"})

    def close(self) -> None:
        pass


def online_thresholds(samples: DataFrame, most: int = 1000, least: int = 30) -> DataFrame:
    """Thresholds of each decision from the ``most`` samples that arrived before it: decisions.prior_thresholds, as a stream's state.

    samples: version, horizon, seq, asset_id, market_confidence and the scores of LEARNT, arriving by seq.
    """
    x = samples.select("version", "horizon", "seq", "asset_id", F.coalesce("market_confidence", F.lit(0.0)).alias("market_confidence"), *[clamp_score(F.col(c)).alias(c) for c in _SCORES])
    return x.groupBy("version", "horizon").transformWithStateInPandas(SampleLog(most, least), outputStructType=THRESHOLDS, outputMode="append", timeMode="none")


READS = "shard long, event_id long, key long, ts_us long, outcome string, value double"
_HOUR = 3_600_000
#: Cells that a shard's keys are dealt into; a cell's entries are one value of the state.
CELLS = 32
_ENTRY = np.dtype([("key", "<i8"), ("value", "<f8"), ("put", "<i8"), ("expires", "<i8")])


class ExpiringStore(StatefulProcessor):
    """One shard's entries: the newest of each key, the number of the put that made it, and when it expires (microseconds).

    A batch fetches and keeps the cells of its keys, one after the other, and works out a cell's rows at once.
    """

    def __init__(self, places: int, ttl: int) -> None:
        self.places, self.ttl = places, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell int", "entries binary")
        self.puts = handle.getValueState("puts", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self.puts.get()[0] if self.puts.exists() else 0
        new = pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")
        put = (new["action"] == "put").to_numpy()
        new = pd.DataFrame({"event_id": new["event_id"].to_numpy(), "key": new["key"].to_numpy(np.int64), "ts_us": new["ts_us"].to_numpy(np.int64), "value": new["value"].to_numpy(float), "put": put, "changes": put | (new["action"] == "delete").to_numpy(), "n": n + np.cumsum(put)})
        cell = ((new["key"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % CELLS
        order = np.lexsort((new["key"], cell))  # stable: a key's rows stay in their order
        new, cell = new.take(order), cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for start, end in zip(starts, [*starts[1:], len(new)], strict=True):
            yield self._cell(key[0], int(cell[start]), new.iloc[start:end])
        ends = new["ts_us"].to_numpy()[new["put"].to_numpy()] + 2 * self.ttl
        for end in np.unique(-(-ends // (1000 * self._step())) * self._step()):
            self.handle.registerTimer(int(end))
        self.puts.update((int(n + put.sum()),))

    def _step(self) -> int:
        """Milliseconds between timers: each of them looks through all cells, so that they are a quarter of the time to live apart."""
        return max(_HOUR, self.ttl // 4000)

    def _entries(self, cell: int) -> np.ndarray:
        return np.frombuffer(self.cells.getValue((cell,))[0], _ENTRY) if self.cells.containsKey((cell,)) else np.empty(0, _ENTRY)

    def _cell(self, shard: int, cell: int, x: pd.DataFrame) -> pd.DataFrame:
        """Reads of a cell's rows (by key, then in their order), and its entries after them."""
        known = self._entries(cell)  # by key
        key, ts, n, put, changes = (x[c].to_numpy() for c in ("key", "ts_us", "n", "put", "changes"))
        at, fresh = np.arange(len(x)), np.r_[True, key[1:] != key[:-1]]
        last = np.maximum.accumulate(np.where(changes, at, -1))  # the newest change up to each row,
        here = last >= np.maximum.accumulate(np.where(fresh, at, 0))  # where it is one of the row's key
        made = np.empty(len(x), _ENTRY)
        made["key"], made["value"], made["put"], made["expires"] = key, x["value"], n, ts + self.ttl
        place = np.searchsorted(known["key"], key)
        stored = np.append(known, np.zeros(1, _ENTRY))[place]
        kept = (place < len(known)) & (stored["key"] == key)
        entry, some = np.where(here, made[last], stored), np.where(here, put[last], kept)
        read = ~changes
        e, now, some = entry[read], ts[read], some[read]
        outcome = np.select([~some | (e["expires"] + self.ttl <= now), e["expires"] <= now, n[read] - e["put"] >= self.places], ["miss", "expired", "evicted"], "hit").astype(object)
        if changes.any():
            final = here & np.r_[fresh[1:], True]
            gone = np.isin(known["key"], key[final])
            left = np.sort(np.concatenate([known[~gone], made[last[final & put[last]]]]), order="key")
            self._keep(cell, left)
        return pd.DataFrame({"shard": shard, "event_id": x["event_id"].to_numpy()[read], "key": key[read], "ts_us": now, "outcome": outcome, "value": np.where(outcome == "hit", e["value"], np.nan)})

    def _keep(self, cell: int, entries: np.ndarray) -> None:
        if len(entries):
            self.cells.updateValue((cell,), (entries.tobytes(),))
        elif self.cells.containsKey((cell,)):
            self.cells.removeKey((cell,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Entries that no read can tell from missing ones go."""
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for cell in [k[0] for k in self.cells.keys()]:
            entries = self._entries(cell)
            left = entries[entries["expires"] + self.ttl > now]
            if len(left) < len(entries):
                self._keep(cell, left)
        yield _reads([])

    def close(self) -> None:
        pass


def _reads(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in READS.split(", ")]).astype({"shard": "int64", "event_id": "int64", "key": "int64", "ts_us": "int64", "outcome": "object", "value": "float64"})


def stored_reads(events: DataFrame, places: int, ttl: int) -> DataFrame:
    """Outcome of every read of a store with a time to live (microseconds) and ``places`` places a shard: hit, expired, evicted or miss.

    events: shard, key, event_id, ts (timestamp), action (put, get or delete), value; a stream (with a watermark on ts) or a
    table. The store holds the last ``places`` puts of a shard, first in first out; of two puts of a key the newer one counts.
    Expiry goes before eviction. For another time to live an expired entry is known as such, then it is missing.
    """
    x = events.select("shard", "key", "event_id", "ts", F.unix_micros("ts").alias("ts_us"), "action", "value")
    if x.isStreaming:
        return x.groupBy("shard").transformWithStateInPandas(ExpiringStore(places, ttl), outputStructType=READS, outputMode="append", timeMode="eventTime")
    w = Window.partitionBy("shard").orderBy("ts_us", "event_id")
    of_key = Window.partitionBy("shard", "key").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumn("n", F.sum(F.when(F.col("action") == "put", 1).otherwise(0)).over(w))
    kept = F.when(F.col("action") == "put", F.col("ts_us") + ttl).when(F.col("action") == "delete", F.lit(-ttl))
    y = y.withColumn("entry", F.last(F.when(F.col("action") != "get", F.struct("value", F.col("n").alias("put"), kept.alias("expires"))), True).over(of_key)).where("action = 'get'")
    e, at = F.col("entry"), F.col("ts_us")
    outcome = F.when(e.isNull() | (e["expires"] + ttl <= at), "miss").when(e["expires"] <= at, "expired").when(F.col("n") - e["put"] >= places, "evicted").otherwise("hit")
    return y.withColumn("outcome", outcome).select("shard", "event_id", "key", "ts_us", "outcome", F.when(F.col("outcome") == "hit", F.col("entry.value")).alias("value"))


#: Rows of a slice of played(): what one group's task takes at a time.
SLICE = 100_000


def played(table: DataFrame, order: str, stream, schema: str, late: str | None = None, slices: int = 4, most: int = SLICE) -> DataFrame:
    """What a stream makes of a table that arrives slice by slice in an order: each slice is a file, read as a micro-batch of its own.

    stream: from the arriving DataFrame to the result. The result is written under the shared folder and read back. A slice has
    ``most`` rows or so; there are ``slices`` at least. The table is worked out once.
    """
    spark = table.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = staged(table)
    slices = max(slices, -(-table.count() // most))
    place = F.unix_micros(order) if dict(table.dtypes)[order] == "timestamp" else F.col(order)
    bounds = table.select(F.percentile_approx(place, [i / slices for i in range(1, slices)]).alias("b")).first()["b"] or [0] * (slices - 1)
    before = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < place))
    table.where(place.isNotNull()).withColumn("_slice", before).write.partitionBy("_slice").parquet(f"{top}/slices")
    cuts = spark.read.schema(StructType([*table.schema, StructField("_slice", IntegerType())])).parquet(f"{top}/slices")
    for i in range(slices):
        cuts.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(f"{top}/in")
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    if late:
        arriving = arriving.withWatermark(order, late)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        query = stream(arriving).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema).parquet(f"{top}/out")
