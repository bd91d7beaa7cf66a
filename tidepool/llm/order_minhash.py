"""Order MinHash fingerprints: sketches that feel edits and moved passages.

A text's k-mers are runs of K words; equal k-mers are told apart by their occurrence number. For each of SKETCHES orders
of the numbered k-mers the TAKEN smallest are put back in text order and hashed together. Two texts agree on a sketch if
the same k-mers come out smallest and stand in the same order, the chance of which falls with edit distance; likeness is
the share of sketches that agree.

A text of fewer than K words has its words together as its only k-mer; one of fewer than TAKEN k-mers uses all of them;
an empty text (or null) has the fingerprint of no k-mers, equal to that of any other text without words. Rows with equal
doc_id follow each other by text. A table of one row is its own next document. A null doc_id
comes before all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, doc_text, documents, id_type

K, TAKEN, SKETCHES = 2, 2, 64
_CACHE_WORDS = 300_000
_BLOCK = 1 << 20


class OrderMinHash:
    def __init__(self, k: int = K, taken: int = TAKEN, sketches: int = SKETCHES) -> None:
        self.k, self.taken = k, taken
        odd = np.random.default_rng(2019).integers(1, 1 << 63, size=sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.orders = odd
        self.of: dict[str, int] = {}

    def _words(self, text: str) -> np.ndarray:
        of, words = self.of, text.split()
        try:
            return np.array([of[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(of) > _CACHE_WORDS:
                of.clear()
            out = []
            for w in words:
                h = of.get(w)
                if h is None:
                    h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                    if len(w) <= 64:
                        of[w] = h
                out.append(h)
            return np.array(out, dtype=np.uint64)

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the k-mers, each mixed with its occurrence number."""
        if not len(words):
            return words
        k = min(self.k, len(words))
        n = len(words) - k + 1
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        order = np.argsort(h, kind="stable")
        own = h[order]
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        first = np.flatnonzero(new)
        number = np.empty(n, dtype=np.uint64)
        number[order] = np.arange(n, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64)
        h = (h + number * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))

    def __call__(self, text: str) -> np.ndarray:
        """16 bits a sketch."""
        h = self.numbered(self._words(text))
        m = len(self.orders)
        if not len(h):
            return np.zeros(m, dtype=np.uint16)
        t = min(self.taken, len(h))
        at = np.empty((m, t), dtype=np.int64)
        step = max(1, _BLOCK // len(h))
        for a in range(0, m, step):
            ranked = h[None, :] * self.orders[a : a + step, None]
            rows = np.arange(len(ranked))
            for j in range(t):
                best = ranked.argmin(axis=1)
                at[a : a + step, j] = best
                ranked[rows, best] = np.iinfo(np.uint64).max
        at.sort(axis=1)
        out = np.full(m, 0x51ED270B, dtype=np.uint64)
        for j in range(t):
            out = (out ^ h[at[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return ((out >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(v: np.ndarray) -> str:
    return v.astype("<u2").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, taken: int = TAKEN, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, fingerprint (hex)."""

    def make():
        omh = OrderMinHash(k, taken, sketches)
        return lambda texts: [pa.array([_hex(omh(t)) for t in texts], pa.string())]

    return add_columns(doc_text(docs), ["text"], "fingerprint string", make).drop("text")


def _last_at_most(marks: list[int], x: Column) -> Column:
    """Place of the last of the ascending marks that is at most x, -1 if none is: bisection by steps of falling powers of two."""
    if not marks:
        return F.lit(-1)
    every, steps = F.array(*[F.lit(m) for m in marks]), F.array(*[F.lit(1 << k) for k in reversed(range(len(marks).bit_length()))])
    return F.aggregate(steps, F.lit(-1), lambda low, step: F.when(F.get(every, low + step) <= x, low + step).otherwise(low))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, spare: rows of one range lie in one partition of their own, in ascending doc_id, and each range ends
    with the spare rows of the id that the following one begins with.

    Ranges are cut at percentiles of doc_id (two light passes over that column; ``ranges`` numbers come to the driver), and
    only rows with these ids are dealt out twice, so that the text is shuffled once.
    """
    rows = doc_text(docs).withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    cuts = rows.agg(F.expr(f"percentile_approx(place, array({', '.join(str(i / ranges) for i in range(1, ranges))}), 10000)")).first()[0] if ranges > 1 else None
    # the percentiles may be no ids themselves: a range begins with the least id in it
    begin = sorted(r["b"] for r in rows.select("place", _last_at_most(sorted({*(cuts or ())}), F.col("place")).alias("r")).groupBy("r").agg(F.min("place").alias("b")).collect())
    if not begin:
        return rows.select("doc_id", "text", F.lit(0).alias("range"), F.lit(False).alias("spare"))
    at = _last_at_most(begin, F.col("place"))
    spare = F.when(F.col("place").isin(begin), F.pmod(F.col("range") - 1, F.lit(len(begin))))
    one = lambda r, s: F.struct(r.cast("int").alias("range"), F.lit(s).alias("spare"))
    placed = rows.withColumn("range", at)
    both = placed.withColumn("to", F.explode(F.when(spare.isNull(), F.array(one(F.col("range"), False))).otherwise(F.array(one(F.col("range"), False), one(spare, True)))))
    dealt = both.select("doc_id", "text", "to.range", "to.spare", "place").repartitionById(len(begin), F.col("range"))
    return dealt.sortWithinPartitions("range", "spare", "place", "doc_id", "text").drop("place")


def compare(docs: DataFrame, k: int = K, taken: int = TAKEN, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of each text, and likeness to its edited text and to the next document's."""
    spark = docs.sparkSession
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh = OrderMinHash(k, taken, sketches)
        last = None  # doc_id, text, range, fingerprint of the row whose next one is awaited

        def result(now, text: str, own: np.ndarray) -> tuple:
            half = len(now[1]) // 2
            edited = now[1][: len(now[1]) - half] + text[:half]
            other = omh(edited)
            return now[0], len(now[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(now[3]), _hex(other), likeness(now[3], other), likeness(now[3], own)

        for b in batches:
            out = []
            for name, text, at, spare in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if last is not None and last[2] != at:
                    raise ValueError("a range has no row that follows its last one")
                if spare and last is None:
                    continue  # a further row of the id that the next range begins with
                own = omh(text)
                if last is not None:
                    out.append(result(last, text, own))
                last = None if spare else (name, text, at, own)
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)
        if last is not None:
            raise ValueError("a range has no row that follows its last one")

    return with_next(docs, ranges).mapInArrow(run, f"{id_type(docs)}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(documents(spark, sf_dir, "doc_id", "text"))
