"""Near copies by the exact Jaccard similarity of word shingles, of at least 4/5.

A document is the set of the XXH64 of its five-word shingles, ASCII lower-cased. Under any one order of all shingles, two
sets of similarity t share a shingle among the first s - ceil(t s) + 1 of each (s: the set's size), so pairs are looked for
there and nowhere else, and each is verified on the whole sets. No pair is left to chance.

* The order is that of the hashes, with shingles that a sample shows to be common behind all others: a passage that many
  documents share is looked up only for those that hold little else. The order decides on cost, never on results.
* Equal sets are one vertex, so exact copies cost nothing.
* Each set has MARKS bits, the parities of its elements by their low bits. A bit that differs stands for at least one element
  that does, so a pair that differs in over a ninth of both sizes together is no near copy; the whole sets are read only for
  the pairs that are left.
* A shingle's documents are first compared with the least and the greatest of them; only those that this leaves in
  different components are then compared with each other: as rows of a join, those outside the largest component against
  all, if they are at most SOME or make at most FEW pairs for each of them, else within a task that holds their sets, returns links along a spanning forest, and takes up to 2 BLOCK
  of them; a larger group is dealt over one task for each two of its blocks.

Null or wordless texts are equal to each other and to nothing else. Null doc_ids name no component unless all its documents
have none. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, discard, doc_text, release
from .graph import components
from .simhash import shingle_hashes

WORDS = 5
#: One in so many documents is sampled for common shingles; those in at least LEAST of them, MOST shingles at most, go last.
SAMPLE, LEAST, MOST = 16, 4, 1 << 16
MARKS = 512
FEW, SOME, BLOCK = 4, 256, 4096


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, row (unique), set (a hash of the set), size, marks (parities, as longs), shingles (sorted unsigned 64-bit numbers)."""

    def make():
        from pyspark import TaskContext

        release()
        row = TaskContext.get().partitionId() << 40

        def one(texts: list[str]) -> list[pa.Array]:
            nonlocal row
            found = [np.unique(shingle_hashes(t, k)).astype("<u8") for t in texts]
            marks = [np.packbits((np.bincount((v % MARKS).astype(np.int64), minlength=MARKS) & 1).astype(np.uint8)).view("<i8") for v in found]
            own = [v.tobytes() for v in found]
            named = np.array([xxhash.xxh64_intdigest(s, 42) for s in own], dtype=np.uint64).view(np.int64)
            row += len(texts)
            return [pa.array(np.arange(row - len(texts), row), pa.int64()), pa.array(named, pa.int64()), pa.array([len(s) // 8 for s in own], pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(own, pa.binary())]

        return one

    return add_columns(doc_text(docs), ["text"], "row long, set long, size long, marks array<long>, shingles binary", make).drop("text")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles of many sampled sets, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame({"token": np.frombuffer(b"".join(b["shingles"]), "<i8")})

    sampled = sets.where(F.pmod("set", F.lit(SAMPLE)) == 0).select("shingles").mapInPandas(run, "token long")
    top = sampled.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(MOST).collect()
    return np.sort(np.array([r["token"] for r in top], dtype=np.int64).view(np.uint64))


def prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """row, set, size, marks, tokens: the shingles among which a similar set must have one of its own."""
    sent = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        last = sent.value
        for b in batches:
            out = []
            for s in b["shingles"]:
                v = np.frombuffer(s, "<u8")
                if len(last) and len(v):
                    late = last[np.minimum(np.searchsorted(last, v), len(last) - 1)] == v
                    v = np.concatenate([v[~late], v[late]])
                out.append(v[: len(v) - (4 * len(v) + 4) // 5 + 1].view(np.int64))
            yield b[["row", "set", "size", "marks"]].assign(tokens=out)

    return sets.select("row", "set", "size", "marks", "shingles").mapInPandas(run, "row long, set long, size long, marks array<long>, tokens array<long>")


def similar(pairs: DataFrame, probed: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b of sets whose similarity is at least 4/5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep[i] = 9 * both * 8 >= 4 * (len(x) + len(y))
            yield b.loc[keep, ["a", "b"]]

    of = lambda v: probed.select(F.col("set").alias(v), F.col("row").alias(f"row_{v}"), F.col("size").alias(f"size_{v}"), F.col("marks").alias(f"marks_{v}"))
    differ = F.aggregate(F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = cut(pairs.join(of("a"), "a").join(of("b"), "b").where(9 * differ <= F.col("size_a") + F.col("size_b")).select("a", "b", "row_a", "row_b"))
    rows = near.select(F.col("row_a").alias("row")).union(near.select("row_b")).distinct()
    whole = cut(sets.select("row", "shingles").join(rows, "row"))
    x, y = (whole.select(F.col("row").alias(f"row_{k}"), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    out = cut(near.join(y, "row_b").join(x, "row_a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long"))
    discard(near, whole)
    return out


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join, with the roots that are known, all members of similarity 4/5 and more."""
    group = group.sort_values(["size", "set"])
    size, names = group["size"].to_numpy(), group["set"].to_numpy()
    root = np.unique(group["root"], return_inverse=True)[1]
    n, links = len(group), []
    if n and root.max():
        word = np.unique(np.frombuffer(b"".join(group["shingles"]), "<u8"), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(word, kind="stable")
        holder = np.repeat(np.arange(n), size)[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(word))])
        for i in range(n - 1):
            if (root[i + 1 :] == root[i]).all():
                continue
            both = np.bincount(np.concatenate([holder[start[w] : start[w + 1]] for w in word[at[i] : at[i + 1]]]), minlength=n)
            near = np.flatnonzero((9 * both >= 4 * (size + size[i])) & (root != root[i]))
            for r in np.unique(root[near]):
                links.append((names[i], names[near[root[near] == r][0]]))
            root[np.isin(root, root[near])] = root[i]
    return pd.DataFrame(np.array(links, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])


def near_copies(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, component_id: the smallest doc_id among all documents that links of similarity 4/5 and more reach."""
    own = cut(shingle_sets(docs, k))
    first = cut(own.groupBy("set").agg(F.min("doc_id").alias("first")))
    probed = cut(prefixes(own, common_shingles(own)).dropDuplicates(["set"]))
    tokens = probed.select("row", "set", "size", F.explode("tokens").alias("token"))
    one = F.struct("set", "size")
    met = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("lo"), F.max(one).alias("hi")).where("n > 1"))
    members = cut(tokens.join(met, "token"))
    ends = [members.select(F.least("set", f"{e}.set").alias("a"), F.greatest("set", f"{e}.set").alias("b"), F.least("size", f"{e}.size").alias("s"), F.greatest("size", f"{e}.size").alias("l")) for e in ("lo", "hi")]
    star = cut(ends[0].union(ends[1]).where("a <> b and 5 * s >= 4 * l").select("a", "b").distinct())
    linked = similar(star, probed, own)
    many = members.where("n > 2").select("token", "row", "set", "size")
    rooted = many.join(components(linked).withColumnRenamed("v", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    by_root = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") ** 2).alias("alike"), F.max_by("root", "c").alias("main"))
    apart = by_root.withColumn("pairs", (F.col("n").cast("double") ** 2 - F.col("alike")) / 2).where("pairs > 0")
    rest = cut(rooted.join(apart, "token"))
    by_pairs = (F.col("n") <= SOME) | (F.col("pairs") <= FEW * F.col("n"))
    few = rest.where(by_pairs)
    out = few.where("root <> main").select("token", F.col("set").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))  # of two roots, one isn't the largest
    across = few.join(out, "token").where("root <> root_b and 5 * least(size, size_b) >= 4 * greatest(size, size_b)").select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b"))
    linked = linked.union(similar(across.distinct().join(star, ["a", "b"], "left_anti"), probed, own))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = rest.where(~by_pairs).withColumn("at", F.pmod(F.xxhash64("set"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = large.select("token", "row", "set", "root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "size").join(own.select("row", "shingles"), "row")
    linked = linked.union(cut(dealt.groupBy("token", "i", "j").applyInPandas(_joined, "a long, b long").distinct()))
    roots = components(linked)
    own_ids = cut(own.select("doc_id", "set"))
    discard(own, probed, met, members, star, rest)
    classed = first.join(roots.withColumnRenamed("v", "set"), "set", "left").select("set", "first", F.coalesce("root", "set").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    return own_ids.join(classed.join(least, "root").select("set", "component_id"), "set").select("doc_id", "component_id")
