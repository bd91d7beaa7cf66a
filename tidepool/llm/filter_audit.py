"""Filter interaction audit: what each of five filters removes at each place of each order.

A document's failures are a mask of five bits, and all that an order of filters does to a part of the corpus follows from
how many of its documents have which mask: 32 cells a part, each with its documents, good ones and toxic ones. The 120
orders of a part are visited by plain changes: each is the one before with two neighbours swapped, so that only these two
steps are worked out anew, from the cells; all else of the order stands. A filter's Shapley sum gathers along the walk
whenever its step changes: what it removed since then, times the orders visited meanwhile.

Failures need one pass over the texts. Whether a text occurs with a smaller doc_id is told without bringing copies together:
copies fail alike in all else, so for each text and part three counts and the smallest doc_id are enough, combined before the
shuffle. A text that a third of all documents have costs one row for each of its parts and tasks.

Null texts are empty ones; null parts are the empty string. A null doc_id is smaller than none and larger than none: its
document is no copy, makes none, and has no label. Rows of one doc_id and one text are no copies of each other. Of several labels of a
doc_id a 1 counts; documents without label are neither good nor toxic. Empty tables give no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents

FILTERS = "ABCDE"
#: Conditions of the four filters that need nothing but the text.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT, MARKS = 200, 50, 2, "[#$%&*|]"
#: Parts whose orders are walked at a time.
PARTS = 64

SHAPE = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(texts: DataFrame) -> DataFrame:
    """texts, a table with column text, with the mask of A to D in place of it: bit 0 is A."""
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    counted = texts.withColumns({"bare": bare == "", "words": F.split(bare, SPACE)})
    n, distinct = [F.when(F.col("bare"), 0).otherwise(F.size(x)) for x in (F.col("words"), F.array_distinct("words"))]
    sizes = counted.withColumns({"n": n, "distinct": distinct, "chars": F.length("text"), "others": F.length(F.regexp_replace("text", "[A-Z]", "")), "marks": F.regexp_like("text", F.lit(MARKS))})
    failed = [F.col("n") < MIN_WORDS, F.col("distinct") * 100 < F.col("n") * MIN_DISTINCT_PCT, (F.col("chars") - F.col("others")) * 100 > F.col("chars") * MAX_CAPITAL_PCT, F.col("marks")]
    return sizes.withColumn("mask", sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))).drop("text", "bare", "words", "n", "distinct", "chars", "others", "marks")


def marked(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """doc_id, part, mask of A to D, hash of the text, and whether labels call the document good and toxic."""
    text = F.coalesce(docs["text"], F.lit(""))
    one = failures(docs.select("doc_id", F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text")))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return one.join(said, "doc_id", "left").fillna(0, ["good", "toxic"])


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask of A to E, and the numbers of documents, good and toxic ones: at most 32 rows a part."""
    sums = ("n", "good", "toxic")
    by_id = marked(docs, labels, part).groupBy("doc_id", "part", "mask", "same").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    has = F.col("doc_id").isNotNull()
    text = by_id.groupBy("same", "mask", "part").agg(
        F.min("doc_id").alias("first"),
        F.min_by(F.struct(*sums), F.when(has, F.col("doc_id"))).alias("at_first"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.when(has, F.lit(0)).otherwise(F.col(c))).alias(f"nameless_{c}") for c in sums],
    )
    least = F.min("first").over(Window.partitionBy("same"))  # a row for each part that has the text
    held = text.withColumn("leads", F.coalesce(F.col("first") == least, F.lit(False)))
    fine = {c: F.when(F.col("leads"), F.col(f"at_first.{c}")).otherwise(0) + F.col(f"nameless_{c}") for c in sums}
    split = held.select("part", F.explode(F.array(F.struct("mask", *[x.alias(c) for c, x in fine.items()]), F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - x).alias(c) for c, x in fine.items()]))).alias("x"))
    return split.select("part", "x.*").groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def plain_changes(n: int) -> Iterator[int]:
    """Places whose element swaps with the next, one after another, so that all orders of n are visited once."""
    at, way = list(range(n)), [-1] * n  # element by place, and where each element is heading
    while True:
        movable = [e for p, e in enumerate(at) if 0 <= p + way[e] < n and at[p + way[e]] < e]
        if not movable:
            return
        e = max(movable)
        p = at.index(e)
        q = p + way[e]
        at[p], at[q] = at[q], at[p]
        for bigger in range(e + 1, n):
            way[bigger] = -way[bigger]
        yield min(p, q)


def walk(cell: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of the filters over cells (parts, 32, counts): the orders; (orders, steps, parts, 2 counts): kept and removed; Shapley sums (parts, filters)."""
    n = len(FILTERS)
    masks = np.arange(1 << n)
    left = lambda gone: cell[:, (masks & gone) == 0].sum(axis=1)  # noqa: E731  what fails none of the filters in ``gone``
    order = list(range(n))
    prefix = [sum(1 << f for f in order[:i]) for i in range(n + 1)]
    kept = [left(p) for p in prefix]  # before the first step, and after each
    shapley, since = np.zeros((len(cell), n), dtype=np.int64), [0] * n
    orders, steps = [], []

    def settle(place: int, now: int) -> None:
        f = order[place]
        shapley[:, f] += (kept[place][:, 0] - kept[place + 1][:, 0]) * (now - since[f])
        since[f] = now

    def note() -> None:
        orders.append(tuple(order))
        steps.append(np.stack([np.stack([kept[i + 1], kept[i] - kept[i + 1]]) for i in range(n)]))

    note()
    for now, at in enumerate(plain_changes(n), 1):
        settle(at, now)
        settle(at + 1, now)
        order[at], order[at + 1] = order[at + 1], order[at]
        prefix[at + 1] = prefix[at] | 1 << order[at]
        kept[at + 1] = left(prefix[at + 1])  # both steps read it; what stands before and behind them is as it was
        note()
    for place in range(n):
        settle(place, len(orders))
    return orders, np.stack(steps), shapley


def _reports(parts: list[str], cell: np.ndarray) -> pa.RecordBatch:
    """Rows of all orders and steps of some parts."""
    orders, steps, shapley = walk(cell)
    names = np.array(["".join(FILTERS[f] for f in o) for o in orders])
    who = np.array(orders)  # orders, steps
    fails = np.stack([cell[:, (np.arange(32) >> f & 1) == 1, 0].sum(axis=1) for f in range(5)])
    alone = np.stack([cell[:, 1 << f, 0] for f in range(5)])
    kept, removed = steps[:, :, 0, :, 0], steps[:, :, 1, :, 0]  # orders, steps, parts
    by_filter = lambda x: x[who]
    n_orders, n_steps, n_parts = kept.shape
    flat = lambda x: pa.array(np.ascontiguousarray(x).reshape(-1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(parts) * (n_orders * n_steps), pa.string()), pa.array(np.repeat(names, n_steps * n_parts).tolist(), pa.string()), pa.array(np.tile(np.repeat(np.arange(1, n_steps + 1, dtype=np.int32), n_parts), n_orders)),
            flat(kept), flat(removed), flat(by_filter(fails) - removed), flat(by_filter(alone)), flat(steps[:, :, 1, :, 1]), flat(steps[:, :, 1, :, 2]), flat(by_filter(shapley.T)),
        ],
        names=[x.split(" ")[0] for x in SHAPE.split(", ")],
    )


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts, held = b.column(0).to_pylist(), b.column(1).to_pylist()
        for at in range(0, len(parts), PARTS):
            cell = np.zeros((len(parts[at : at + PARTS]), 1 << len(FILTERS), 3), dtype=np.int64)
            for i, some in enumerate(held[at : at + PARTS]):
                for x in some:
                    cell[i, x["mask"]] = x["n"], x["good"], x["toxic"]
            yield _reports(parts[at : at + PARTS], cell)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of filters and step: what is kept and removed there, and the filter's Shapley sum over all orders."""
    by_part = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 entries at most
    return by_part.mapInArrow(_walked, SHAPE)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir, "doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
