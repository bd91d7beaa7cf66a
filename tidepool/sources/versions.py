"""A table of records by id that keeps its versions: each change writes the buckets it touches anew, and a manifest of them.

Layout: data/<write>/bucket=<n>/ holds the rows of a bucket, manifest/version=<v>/ one row a bucket with the write that has it.
A version is there once its manifest has a row for each bucket: a write that stops before leaves the version before, and its
files are never read. Rows carry created, the number of the change that made them, for the oldest to go first. One writer at a
time; readers take the newest version, or one they name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "bucket int, write string, buckets int"


@dataclass(frozen=True)
class Versions:
    """A versioned table at a path. schema: DDL of its columns, of which ``key`` names a row; buckets: in which rows lie by key."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "id"
    buckets: int = 16

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(f"{_MANIFEST}, version int").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")

    def newest(self) -> int:
        """Number of the newest whole version."""
        whole = self._manifests().groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.max("buckets").alias("all")).where("n = all")
        return whole.agg(F.max("version")).first()[0]

    def _writes(self, version: int) -> dict[int, str | None]:
        """The write that holds each bucket: as many rows as buckets."""
        return {r["bucket"]: r["write"] for r in self._manifests().where(F.col("version") == version).collect()}

    def _commit(self, version: int, writes: dict[int, str | None]) -> None:
        rows = [(b, writes.get(b), self.buckets) for b in range(self.buckets)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def create(self) -> None:
        self._commit(0, {})

    def _rows(self, writes: dict[int, str | None]) -> DataFrame:
        paths = [f"{self.path}/data/{w}/bucket={b}" for b, w in sorted(writes.items()) if w]
        shape = f"{self.schema}, created long"
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._writes(self.newest() if version is None else version))

    def write(self, changes: DataFrame, stop: bool = False) -> int:
        """A new version with changes: the table's columns, op (create, observe or delete) and seq, their order.

        Of several changes of a key the last create or delete counts, and the observations behind it. create makes a row, or
        puts another in its place, which keeps its age; observe sets those columns of a row that it gives, and makes none.
        ``stop`` leaves it before the manifest is written, as a lost driver would.
        """
        before = self.newest()
        writes = self._writes(before)
        x = changes.withColumn("bucket", self._bucket())
        touched = {r["bucket"] for r in x.select("bucket").distinct().collect()}  # buckets at most
        columns = [c for c in self._rows({}).columns if c not in (self.key, "created")]
        of_key = Window.partitionBy(self.key)
        x = x.withColumn("base", F.max(F.when(F.col("op") != "observe", F.col("seq"))).over(of_key))
        x = x.where(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
        full = F.struct("op", *columns)
        one = x.groupBy("bucket", self.key).agg(
            F.max(F.when(F.col("seq") == F.col("base"), full)).alias("whole"), F.max("base").alias("base"),
            *[F.max_by(F.when(F.col("op") == "observe", F.col(c)), F.when((F.col("op") == "observe") & F.col(c).isNotNull(), F.col("seq"))).alias(f"seen_{c}") for c in columns],
        )
        old = self._rows({b: w for b, w in writes.items() if b in touched}).withColumn("bucket", self._bucket()).withColumn("known", F.lit(True))
        both = old.join(one, ["bucket", self.key], "full")
        value = lambda c: F.coalesce(F.col(f"seen_{c}"), F.when(F.col("whole").isNotNull(), F.col(f"whole.{c}")).otherwise(F.col(c)))
        stays = F.when(F.col("whole").isNotNull(), F.col("whole.op") == "create").otherwise(F.coalesce("known", F.lit(False)))
        new = both.where(stays).select("bucket", self.key, *[value(c).alias(c) for c in columns], F.coalesce("created", "base").alias("created"))
        return self._put(new, writes, touched, before + 1, stop)

    def _put(self, rows: DataFrame, writes: dict[int, str | None], touched: set[int], version: int, stop: bool = False) -> int:
        name = uuid.uuid4().hex
        order = [c for c in self._rows({}).columns]
        rows.select("bucket", *order).repartition(max(len(touched), 1), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        held = {r["bucket"] for r in self.spark.read.schema(f"{self.schema}, created long, bucket int").parquet(f"{self.path}/data/{name}").select("bucket").distinct().collect()} if touched else set()
        if not stop:
            self._commit(version, {**writes, **{b: name if b in held else None for b in touched}})
        return version

    def shed(self, most: int, batch: int) -> int:
        """Where there are more than ``most`` rows, a version without the oldest of them, ``batch`` at most: only their buckets are written anew."""
        before = self.newest()
        writes = self._writes(before)
        rows = self._rows(writes)
        over = min(rows.count() - most, batch)
        if over <= 0:
            return before
        gone = rows.orderBy("created", self.key).limit(over).select(self.key).withColumn("bucket", self._bucket())
        touched = {r["bucket"] for r in gone.select("bucket").distinct().collect()}
        kept = self._rows({b: w for b, w in writes.items() if b in touched}).join(gone.select(self.key), self.key, "left_anti").withColumn("bucket", self._bucket())
        return self._put(kept, writes, touched, before + 1)
