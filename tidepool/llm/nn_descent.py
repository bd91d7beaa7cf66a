"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by joining neighbours of neighbours.

Equal vectors become one vertex with a number of copies. The graph begins with sorted passes: vertices in order of the sign bits
of random projections meet those that follow them. Then, round by round, the neighbours of each vertex, its own list and a
bounded draw of those that list it, meet each other, and each takes into its list what is nearer than its last. Only pairs of
which one is new to that place are compared. A list holds ``LIST`` neighbours; while as many of them are links (a cosine of
``COSINE`` or more) it is saturated and doubles, up to ``MOST``. After each round a bounded sample of vertices, compared with
all others, tells the recall; while it falls short, further sorted passes bring in new pairs.

Links are what the lists hold at or above the threshold, always worked out in double precision. Where a list is saturated at
its largest, its component is a dense group, and its links are counted without enumerating them: vectors within half the
threshold's angle of the group's mean are all linked with each other (angles obey the triangle inequality), so their number
tells; the group's other vectors are compared with all of it in blocks that return counts. Nothing is capped there: the list
size bounds what is stored, not what is counted. No task holds a group: lists, draws and blocks are bounded.

Vectors that are null or zero, or hold null or non-finite components, link with nothing; vectors of unlike lengths don't link.
Repeated rows of a vec_id are vectors of their own. A null vec_id counts as a link but names no component. Empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import acos

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .graph import components

COSINE = 0.95
#: Neighbours of a list at first and at most, and others drawn that list a vertex.
LIST, MOST, DRAWN = 12, 48, 12
#: Sorted passes at first, sign bits of each, and followers that a vertex meets.
PASSES, BITS, FOLLOWERS = 4, 32, 8
#: Rounds at most, share of new links at which they end, vertices audited, and the recall that the audit asks for.
ROUNDS, STILL, AUDITED, RECALL = 10, 0.001, 1024, 0.99
#: Vectors of a block that is compared with others of a dense group.
BLOCK = 1024


def unit(raw: list[bytes]) -> np.ndarray:
    """Vectors of equal lengths as unit vectors. Their largest component is made 1 first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v: the components as bytes of doubles; null where a vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                x = None if not x.is_valid or x.values.null_count else np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) + 0.0  # -0 is 0
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return table.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, v binary")


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cos", pa.float64()), ("k", pa.int32())])
EDGES = "a long, b long, cos double, k int"


def _edges(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), f.type) for c, f in zip(columns, EDGE, strict=True)], schema=EDGE)


def sorted_pass(points: DataFrame, seed: int) -> DataFrame:
    """Vertices in the order of sign bits, each with those that follow it. points: id, v."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw, code = b.column(1).to_pylist(), np.zeros(b.num_rows, dtype=np.int64)
            for size, at in groupby(sorted(range(len(raw)), key=lambda i: len(raw[i])), key=lambda i: len(raw[i])):
                at = list(at)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size // 8, BITS))
                code[at] = ((unit([raw[i] for i in at]) @ planes[size]) > 0) @ (1 << np.arange(BITS, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=["id", "v", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_raw = np.zeros(0, dtype=np.int64), []
        for b in batches:
            ids = np.concatenate([last_id, b.column(0).to_numpy()])
            raw = last_raw + b.column(1).to_pylist()
            sizes, new = np.array([len(r) for r in raw]), len(last_raw)
            a, c, cos = [], [], []
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit([raw[i] for i in at])
                for s in range(1, min(FOLLOWERS, len(at) - 1) + 1):
                    i, j = at[:-s], at[s:]
                    met = j >= new  # pairs within what is kept of the batch before have met
                    d = np.einsum("ij,ij->i", x[:-s], x[s:])[met]
                    i, j = ids[i[met]], ids[j[met]]
                    a += [i, j]
                    c += [j, i]
                    cos += [d, d]
            yield _edges(a, c, cos, [np.full(sum(map(len, a)), LIST)])
            last_id, last_raw = ids[-FOLLOWERS:], raw[-FOLLOWERS:]

    by_code = points.select("id", "v").mapInArrow(coded, "id long, v binary, code long")
    order = (F.length("v"), F.col("code"), F.col("id"))
    return by_code.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v").mapInArrow(meet, EDGES)


def lists(found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The nearest of each vertex. found: a, b, cos, k, fresh, pairs repeated; fresh stays where all that tell the pair are fresh, and returns where a list is enlarged."""
    one = found.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("k").alias("k"), F.bool_and("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    near = one.withColumn("place", place).where(F.col("place") <= MOST)
    own = Window.partitionBy("a")
    seen = near.withColumns({"links": F.sum((F.col("cos") >= cosine).cast("int")).over(own), "was": F.max("k").over(own)})
    grown = (F.col("links") >= F.col("was")) & (F.col("was") < MOST)
    sized = seen.withColumns({"k": F.when(grown, F.least(F.col("was") * 2, F.lit(MOST))).otherwise(F.col("was")).cast("int"), "fresh": F.col("fresh") | grown})
    return sized.where(F.col("place") <= F.col("k")).select("a", "b", "cos", "k", "fresh")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each place against each other: what is nearer than the last of a member's list, of pairs with a fresh member."""
    open_at, held = None, []

    def compared() -> Iterator[tuple]:
        ids, new, k, last, raw = (np.concatenate([h[i] for h in held]) if i < 4 else [r for h in held for r in h[4]] for i in range(5))
        if len(ids) > 1 and new.any():
            x = unit(raw)
            cos = x @ x.T
            ok = (new[:, None] | new[None, :]) & (cos > last[:, None]) & (ids[:, None] != ids[None, :])
            i, j = np.nonzero(ok)
            if len(i):
                yield ids[i], ids[j], cos[i, j], k[i]

    for b in batches:
        place, ids, new, k, last = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        raw = b.column(5).to_pylist()
        bounds = np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist() + [len(place)] if len(place) else []
        out: list[tuple] = []
        for i, j in zip(bounds, bounds[1:], strict=False):
            if place[i] != open_at:
                out += compared() if held else ()
                open_at, held = place[i], []
            held.append((ids[i:j], new[i:j], k[i:j], last[i:j], raw[i:j]))
        yield _edges(*[[x[i] for x in out] for i in range(4)])
    if held:
        out = list(compared())
        yield _edges(*[[x[i] for x in out] for i in range(4)])


def refined(points: DataFrame, graph: DataFrame, turn: int) -> DataFrame:
    """Pairs that one round proposes: a, b, cos, k."""
    ahead = graph.select(F.col("a").alias("place"), F.col("b").alias("id"), "fresh")
    draw = Window.partitionBy("place").orderBy(F.desc("fresh"), F.xxhash64("id", F.lit(turn)))
    behind = graph.select(F.col("b").alias("place"), F.col("a").alias("id"), "fresh").withColumn("n", F.row_number().over(draw)).where(F.col("n") <= DRAWN).drop("n")
    members = ahead.unionByName(behind).groupBy("place", "id").agg(F.bool_or("fresh").alias("fresh"))
    live = members.withColumn("live", F.max("fresh").over(Window.partitionBy("place"))).where("live").drop("live")
    own = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least"), F.max("k").alias("k"))
    state = points.select("id", "v").join(own.select(F.col("a").alias("id"), "k", F.when(F.col("n") < F.col("k"), -2.0).otherwise(F.col("least")).alias("last")), "id")
    met = live.join(state, "id").select("place", "id", "fresh", "k", "last", "v")
    return met.repartition("place").sortWithinPartitions("place").mapInArrow(_meetings, EDGES)


def true_links(points: DataFrame, sample: list, cosine: float) -> dict[int, int]:
    """Numbers of links of sampled vertices (rows id, v), by comparing each with all."""
    by_size = {size: list(rows) for size, rows in groupby(sorted(sample, key=lambda r: len(r["v"])), key=lambda r: len(r["v"]))}
    units = {size: (np.array([r["id"] for r in rows]), unit([bytes(r["v"]) for r in rows])) for size, rows in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {size: np.zeros(len(ids), dtype=np.int64) for size, (ids, _) in units.items()}
        for b in batches:
            ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            for size, (own, x) in units.items():
                at = [i for i, r in enumerate(raw) if len(r) == size]
                if at:
                    n[size] += ((x @ unit([raw[i] for i in at]).T >= cosine) & (own[:, None] != ids[at][None, :])).sum(axis=1)
        for size, (own, _) in units.items():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[size])], names=["id", "n"])

    return {r["id"]: r["n"] for r in points.select("id", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # AUDITED rows at most


def neighbour_graph(points: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, float]:
    """The refined lists, and their recall of links on the audited vertices whose lists aren't saturated. points: id, v, distinct."""
    sample = points.select("id", "v").orderBy(F.xxhash64("id")).limit(AUDITED).collect()
    truth = true_links(points, sample, cosine)
    named = F.col("a").isin(list(truth)) if truth else F.lit(False)
    link = F.col("cos") >= cosine
    found = None
    for seed in range(PASSES):
        one = sorted_pass(points, seed)
        found = one if found is None else found.unionAll(one)
    graph, recall = cut(lists(found.withColumn("fresh", F.lit(True)), cosine)), 0.0
    for turn in range(ROUNDS):
        more = refined(points, graph, turn)
        if turn and recall < RECALL:
            more = more.unionAll(sorted_pass(points, PASSES + turn))
        past, graph = graph, cut(lists(graph.withColumn("fresh", F.lit(False)).unionByName(more.withColumn("fresh", F.lit(True))), cosine))
        discard(past)
        n = graph.agg(F.count_if(link).alias("links"), F.count_if(link & F.col("fresh")).alias("new")).first()
        found = {r["a"]: (r["n"], r["n"] >= r["k"]) for r in graph.where(named & link).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).collect()}  # AUDITED rows at most
        open_ = {i: t for i, t in truth.items() if not found.get(i, (0, False))[1]}
        recall = sum(found.get(i, (0, False))[0] for i in open_) / sum(open_.values()) if any(open_.values()) else 1.0
        if recall >= RECALL and n["new"] <= STILL * n["links"]:
            break
    return graph, recall


def _means(members: DataFrame) -> DataFrame:
    """root, mean: the direction of each group's mean, summed by task first. members: root, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            order = np.argsort(root, kind="stable")
            keys, at = np.unique(root[order], return_index=True)
            sums = [unit([raw[i] for i in part]).sum(axis=0) for part in np.split(order, at[1:])] if len(root) else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["root", "s"])

    by_place = members.select("root", "v").mapInArrow(run, "root long, s array<double>").select("root", F.posexplode("s").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
    return by_place.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))  # one entry a component


def _within(angle: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, mean = b.column(b.schema.get_field_index("v")).to_pylist(), b.column(b.schema.get_field_index("mean")).to_pylist()
            near = [bool(np.any(m) and np.arccos(np.clip(unit([v])[0] @ unit([np.array(m).tobytes()])[0], -1, 1)) <= angle) for v, m in zip(raw, mean, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(near, pa.bool_())], names=["id", "root", "copies", "v", "ball"])

    return run


def dense_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """id, n: numbers of linked vectors, copies counted, of all vectors of dense groups. members: id, root, copies, v, in a table."""
    told = cut(members.join(_means(members), "root").select("id", "root", "copies", "v", "mean").mapInArrow(_within(acos(cosine) / 2 - 1e-9), "id long, root long, copies long, v binary, ball boolean"))
    sizes = told.groupBy("root").agg(F.sum(F.when(F.col("ball"), F.col("copies"))).alias("in_ball"), F.count_if(~F.col("ball")).alias("n_out"), F.count(F.lit(1)).alias("n"))
    sized = told.join(sizes, "root").withColumns({"outs": F.ceil(F.col("n_out") / BLOCK).cast("int"), "alls": F.ceil(F.col("n") / BLOCK).cast("int"), "h": F.xxhash64("id", F.lit(7))})
    one_of = lambda k: F.pmod("h", F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cols = ["root", "id", "copies", "v", "ball"]
    apart = sized.where("outs > 0")
    sides = apart.where(~F.col("ball")).select(*cols, one_of("outs").alias("o"), each("alls").alias("m"), F.lit(True).alias("asks")).unionByName(apart.select(*cols, one_of("alls").alias("m"), each("outs").alias("o"), F.lit(False).alias("asks")))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy()
        a, m = block[asks], block[~asks]
        if a.empty or m.empty:
            return pd.DataFrame({"id": [], "n": []})
        hit = (unit(a["v"].tolist()) @ unit(m["v"].tolist()).T >= cosine) & (a["id"].to_numpy()[:, None] != m["id"].to_numpy()[None, :])
        inner = m["ball"].to_numpy()  # outliers among the asked have their own turn as those that ask
        return pd.DataFrame({"id": np.append(a["id"], m["id"][inner]), "n": np.append(hit @ m["copies"].to_numpy(), hit[:, inner].T @ a["copies"].to_numpy())})

    met = sides.groupBy("root", "o", "m").applyInPandas(run, "id long, n long")
    ball = sized.select("id", F.when(F.col("ball"), F.col("in_ball") - F.col("copies")).otherwise(0).alias("n"))
    return ball.unionByName(met).groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept. table: vec_id, embedding."""
    own = cut(vectors(table))
    points = cut(own.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")).withColumn("id", F.monotonically_increasing_id()))
    graph, _ = neighbour_graph(points, cosine)
    links = cut(graph.where(F.col("cos") >= cosine).select("a", "b", "k"))
    roots = cut(components(links))
    saturated = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).where("n >= k").select(F.col("a").alias("v"))
    dense = cut(roots.join(saturated, "v", "left_semi").select("root").distinct())
    discard(graph)
    placed = cut(points.join(roots.withColumnRenamed("v", "id"), "id", "left").join(dense.withColumn("dense", F.lit(True)), "root", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("dense", F.lit(False)).alias("dense"), "copies", "first", "v"))
    pairs = links.select("a", "b").unionAll(links.select("b", "a")).distinct().join(placed.where(~F.col("dense")).select(F.col("id").alias("b"), "copies"), "b")
    counted = pairs.groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("n")).unionByName(dense_links(placed.where("dense").select("id", "root", "copies", "v"), cosine))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    told = placed.join(counted, "id", "left").join(named, "root").select("v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id")
    return own.join(told, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
