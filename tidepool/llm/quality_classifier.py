"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Fitting reads a bounded sample of the labelled rows (``max_rows``, the documented bound: rows are chosen by a hash of
doc_id, so every labelled row is as likely as any other). Features of the sample are made where the texts are; one task
then runs PASSES passes of sequential updates over at most that many sparse rows. Scoring is a sparse dot product per text against
one weight vector of 2**20 floats, whatever the size of the corpus.

Nulls and empty texts have no features and score the bias. Rows whose label is null don't train. A doc_id that has
several labels trains with their maximum. An untrainable table (no labels, or one class) scores the base rate, 0.5
where nothing is known. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, doc_text, documents, held_out
from .hashed_text import BITS, Runs, slots

#: Bound of the training sample.
MAX_ROWS = 20_000
PASSES = 8
SCALE = 20.0


def features(text: str, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their share of all n-grams, scaled."""
    at = slots(runs(text))
    if not len(at):
        return at, np.zeros(0)
    own, count = np.unique(at, return_counts=True)
    return own, np.sqrt(count / len(at)) * SCALE ** 0.5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, label of at most about max_rows rows that may train: crc32 of doc_id mod 4 is not 2."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * max_rows / n))
        own = F.broadcast(own)  # max_rows pairs of numbers
    one = doc_text(docs).where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    return one.join(own, "doc_id")


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int = 1 << BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias after ``passes`` passes over the rows, each in a fixed shuffled order."""
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    share = sum(y for *_, y in rows) / max(1, len(rows))
    if not rows or share in (0.0, 1.0):
        return w, 0.0 if not rows else float(np.log((share + 1e-2) / (1 - share + 1e-2)))
    bias = float(np.log(share / (1 - share)))
    bias_n = 1.0
    order = np.random.default_rng(17)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            x = x.astype(float)  # rows are kept as they came, in half the room
            own_z, own_n = z[at], n[at]
            own_w = np.where(np.abs(own_z) <= l1, 0.0, -(own_z - np.sign(own_z) * l1) / ((beta + np.sqrt(own_n)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(own_w @ x + bias, -35, 35)))
            error = p - y
            g = error * x
            more = own_n + g * g
            z[at] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / alpha * own_w
            n[at] = more
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, bias


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = Runs()
    for b in batches:
        got = [features(t, runs) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "slot": [a.astype("<i4").tobytes() for a, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got], "label": b["label"]})


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes, bytes, int]] = []
    for b in batches:
        rows += zip(*[b.column(k).to_pylist() for k in range(4)], strict=True)
    rows.sort(key=lambda r: r[0])
    w, bias = ftrl([(np.frombuffer(slot, "<i4"), np.frombuffer(x, "<f4"), label) for _, slot, x, label in rows])
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["w", "bias"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    sample = labelled_sample(docs, labels, label, max_rows)
    made = sample.mapInPandas(_featurise, "doc_id long, slot binary, x binary, label int").repartition(1)
    got = made.mapInArrow(_fit, "w binary, bias double").collect()
    if not got:
        return np.zeros(1 << BITS), 0.0
    return np.frombuffer(got[0]["w"], "<f4").astype(float), got[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], into: str = "score") -> DataFrame:
    """docs with a column ``into``, in place of one of that name if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def make():
        w, bias = shared.value
        runs = Runs()

        def one(texts: list[str | None]) -> list[pa.Array]:
            z = np.empty(len(texts))
            for i, t in enumerate(texts):
                at, x = features(t or "", runs)
                z[i] = w[at] @ x + bias
            return [pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))]

        return one

    return add_columns(docs.drop(into), ["text"], f"`{into}` double", make)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(doc_text(docs), model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
