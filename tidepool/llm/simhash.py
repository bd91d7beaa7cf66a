"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Two distinct fingerprints within
``radius`` bits must, for parts of the 64 bits with thresholds that sum to radius - parts + 1, be within the threshold on
one part. How many parts, which bits are together and how the thresholds are spread is chosen from the data:

* correlated bits go to one part (a greedy pass over the correlation matrix, summed over all fingerprints), so that the
  parts' values are spread as widely as they can be;
* for each part and threshold the number of candidates is estimated from the part's exact collision count over all
  fingerprints, carried to higher thresholds by the bits' own frequencies;
* dynamic programming spreads the thresholds at the least cost of probes and candidates; the number of parts with the
  least total wins.

A part with threshold e is probed by its value with any e of its bits masked: equal probes, and only those, are within e.
Probes meet in buckets. A bucket of two is one comparison; a larger one, of up to BLOCK members, is compared by one
vectorised task that returns links along a spanning forest, never all pairs; members of a still larger one are linked by
the values of all 64 bits with ``radius`` of them masked, where a group has at most 2**radius members by construction.
No bucket is dropped and no link lost. Only distinct fingerprints are linked, so copies cost nothing; components come
from contraction.

Null or wordless texts have fingerprint zero and are linked like any other. Null doc_ids are kept as rows but name no
component unless all its documents have none. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, discard, doc_text, documents, unsigned_hex
from .graph import components

BITS = 64
#: Buckets of up to so many distinct fingerprints are compared within a task; larger ones by masked values.
BLOCK = 4096
#: Rows of a bucket table that cost as much as one comparison's worth of a candidate pair.
PROBE_COST = 20.0


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text, ASCII lower-cased; of all its words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([hash64(flat, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    return np.fromiter([hash64(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64, count=n)


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """Bits set in more than half of the hashes, as a signed long; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp long."""
    return add_columns(doc_text(docs), ["text"], "fp long", lambda: lambda texts: [pa.array([majority(shingle_hashes(t, k)) for t in texts], pa.int64())]).drop("text")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the 64 x 64 counts of bits set together, summed over partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            v = b["fp"].to_numpy(dtype="<i8")
            x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(v), both + x.T @ x
        if n:
            i, j = np.triu_indices(BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(both[i, j], n)})

    both, n = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInPandas(run, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # 2,081 rows at most
        if r["i"] < 0:
            n = int(r["c"])
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["c"]
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of near equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = list(range(BITS)), []
    for k in range(parts, 0, -1):
        size = len(left) // k
        group = [left.pop(0)]
        while len(group) < size:
            best = max(range(len(left)), key=lambda i: (near[left[i], group].mean(), -left[i]))
            group.append(left.pop(best))
        out.append(sorted(group))
    return out


def as_long(bits) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def collisions(fps: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs of fingerprints that agree on a part, for each part of each layout."""
    parts = [(m, i, as_long(bits)) for m, layout in layouts.items() for i, bits in enumerate(layout)]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, (*_, mask) in enumerate(parts)])).alias("x")).select("x.k", "x.v")
    got = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("k").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()
    found = {r["k"]: r["pairs"] for r in got}
    return {(m, i): found.get(k, 0.0) for k, (m, i, _) in enumerate(parts)}


def spread(weights: np.ndarray, bits: list[int]) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, 2, ... of the bits, if bits were independent."""
    out = np.array([1.0])
    for b in bits:
        q = 2 * weights[b] * (1 - weights[b])
        out = np.convolve(out, [1 - q, q])
    return out


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 (no probe) and up that sum to ``total`` at the least cost. cost[i][e]: of threshold e on part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (c, chosen) in best.items():
            for e in range(-1, len(options)):
                new = (c + (options[e] if e >= 0 else 0.0), [*chosen, e])
                if so_far + e not in step or new[0] < step[so_far + e][0]:
                    step[so_far + e] = new
        best = step
    return best[total]


def plan(fps: DataFrame, radius: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """Parts that are probed, with their thresholds."""
    n, both = bit_moments(fps)
    weights = np.diag(both) / max(n, 1)
    layouts = {m: group_bits(n, both, m) for m in range(2, most_parts + 1)}
    equal = collisions(fps, layouts)
    found = []
    for m, layout in layouts.items():
        cost = []
        for i, bits in enumerate(layout):
            chance = np.cumsum(spread(weights, bits))
            cost.append([PROBE_COST * n * comb(len(bits), e) + (equal[m, i] + 1) * chance[e] / max(chance[0], 1e-300) for e in range(radius + 1)])
        total, chosen = allocate(cost, radius - m + 1)
        found.append((total, [(bits, e) for bits, e in zip(layout, chosen, strict=True) if e >= 0]))
    return min(found, key=lambda x: x[0])[1]


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """fp with each probe number and masked value."""
    masks = [as_long(set(bits) - set(off)) for bits, e in parts for off in combinations(bits, e)]
    all_masks = F.array(*[F.lit(m) for m in masks])
    return fps.select("fp", F.posexplode(all_masks).alias("probe", "mask")).select("fp", "probe", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all values within radius of each other, directly or by way of others. values: unsigned, distinct."""
    values = np.sort(values)
    n = len(values)
    root = np.arange(n)
    for i in range(n - 1):  # one row of comparisons at a time
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1
        if len(near):
            met = np.unique(np.append(root[near], root[i]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return [(int(root[i]), i) for i in range(n) if root[i] != i]


def _bucket_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # the same members often meet under several probes
        for b in batches:
            a, c = [], []
            for members in b["members"]:
                v = np.sort(np.asarray(members, dtype=np.int64).view(np.uint64))
                if (key := v.tobytes()) in seen:
                    continue
                if len(seen) < 10_000:
                    seen.add(key)
                for i, j in forest(v, radius):
                    a.append(v[i])
                    c.append(v[j])
            yield pd.DataFrame({"a": np.array(a, dtype=np.uint64).view(np.int64), "b": np.array(c, dtype=np.uint64).view(np.int64)})

    return run


def links(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Edges a, b whose components are those of all pairs of fingerprints within radius, and the table they are made from.

    fps: distinct longs fp, in a table that is cheap to read again.
    """
    probed = probes(fps, plan(fps, radius))
    buckets = cut(probed.groupBy("probe", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
    two = buckets.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    some = probed.join(buckets.where(f"n > 2 and n <= {block}").select("probe", "key"), ["probe", "key"]).groupBy("probe", "key").agg(F.collect_list("fp").alias("members"))
    near = some.select("members").mapInPandas(_bucket_links(radius), "a long, b long")
    hot = probed.join(buckets.where(f"n > {block}").select("probe", "key"), ["probe", "key"]).select("fp").distinct()
    masks = [as_long(set(range(BITS)) - set(off)) for off in combinations(range(BITS), radius)]
    tight = hot.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("k", "mask")).groupBy("k", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    tied = tight.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return two.unionAll(near).unionAll(tied), buckets


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id among all documents that links reach."""
    own = cut(fingerprints(docs, k))
    first = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges, buckets = links(first.select("fp"), radius)
    roots = components(edges)
    discard(buckets)
    classed = first.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classed.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
