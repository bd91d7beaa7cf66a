"""Context matching: which stored contexts are comparable to a current one, and what usually followed them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernel import blend, clamp_score, count_if, finite

#: Contexts whose stability is this far apart are never comparable.
GAP = 18.0
# Weights of the five axes, in a match and in a pattern's weight.
AXES = {"occurrence": 0.2, "convergence": 0.25, "duration": 0.2, "frequency": 0.2, "correlation": 0.15}
CONTEXT = ("asset_id", "regime", "stability", "behavior", *AXES)
CHAINS = {"regime": (("STABLE", "TRANSITION", "VOLATILE"), 35.0, 10.0), "behavior": (("PUMA", "KANGAROO", "SERPENT"), 50.0, 20.0)}
#: Queries in a block of context_pairs, pairs of a block, and pairs that are worked out together.
ROWS, PAIRS, AT_ONCE = 1_000, 2_000_000, 1 << 16
#: Partitions of the queries' blocks and of the contexts', at most: a task takes the blocks of one of each.
PARTS = 200, 100


def band_pairs(a: DataFrame, b: DataFrame, column: str, width: float, salts: int = 8) -> DataFrame:
    """Pairs of rows (columns a_*, b_*) whose ``column`` differs by less than ``width``: an equi join on buckets and a residual.

    b's rows are dealt over ``salts`` sub-buckets and a's are repeated for each, so that a bucket that holds most rows is still
    shared out. a is the smaller side: a stated set of queries.
    """
    left = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(f"a_{column}") / width) + d))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).withColumns({"_bucket": F.floor(F.col(f"b_{column}") / width), "_salt": F.pmod(F.xxhash64("b_asset_id"), F.lit(salts)).cast("int")})
    return left.join(right, ["_bucket", "_salt"]).where(F.abs(F.col(f"a_{column}") - F.col(f"b_{column}")) < width).drop("_bucket", "_salt")


def _step(a: Column, b: Column, chain: tuple[str, str, str], near: float, far: float) -> Column:
    """100 for equal ones, ``near`` for neighbours in the chain, else ``far``."""
    first, middle, last = chain
    beside = (a == middle) & b.isin(first, last) | (b == middle) & a.isin(first, last)
    return F.when(a == b, 100.0).when(beside, near).otherwise(far)


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (a_*, b_* of CONTEXT) with similarity, weighted similarity, whether they are comparable, and why not."""
    c = lambda f: (F.col(f"a_{f}"), F.col(f"b_{f}"))
    gap = F.abs(F.col("a_stability") - F.col("b_stability"))
    axis = lambda f: F.when(finite(c(f)[0]).isNull() | finite(c(f)[1]).isNull(), 50.0).otherwise(clamp_score(100 - F.abs(clamp_score(c(f)[0]) - clamp_score(c(f)[1])) * 4))
    x = pairs.withColumns({
        "regime_score": _step(*c("regime"), *CHAINS["regime"]), "behavior_score": _step(*c("behavior"), *CHAINS["behavior"]),
        "stability_score": clamp_score(100 - gap * 5), "axes_score": clamp_score(blend(*[(w, axis(f)) for f, w in AXES.items()])),
    })
    x = x.withColumn("similarity", clamp_score(blend((0.32, F.col("regime_score")), (0.24, F.col("stability_score")), (0.14, F.col("behavior_score")), (0.3, F.col("axes_score")))))
    x = x.withColumn("weighted_similarity", clamp_score(blend((0.7, F.col("similarity")), (0.15, F.col("regime_score")), (0.1, F.col("stability_score")), (0.05, F.col("axes_score")))))
    x = x.withColumn("comparable", (F.col("regime_score") >= 35) & (gap < GAP) & (F.col("similarity") >= 60) & (F.col("weighted_similarity") >= 58))
    why = F.array_compact(F.array(F.when(F.col("regime_score") < 100, F.lit("regime_mismatch")), F.when(gap >= GAP, F.lit("stability_gap_high")), F.when(F.col("behavior_score") < 100, F.lit("behavior_mismatch")), F.when(~F.col("comparable"), F.lit("context_not_comparable"))))
    return x.withColumn("reasons", why)


_WHY = pa.array([",".join(w for k, w in enumerate(("regime_mismatch", "behavior_mismatch", "context_not_comparable")) if code >> k & 1) for code in range(8)])


def _hundredths(x: np.ndarray) -> np.ndarray:
    return np.floor(np.minimum(100.0, np.maximum(0.0, x)) * 100 + 0.5) / 100


def _steps(a: pa.ChunkedArray, b: pa.ChunkedArray, chain: tuple[str, str, str], near: float, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_step of all values of a and b as a table, and where in it each row of the two is."""
    (own, i), (other, j) = ((d.dictionary.to_pylist(), d.indices.to_numpy()) for d in (x.combine_chunks().dictionary_encode("encode") for x in (a, b)))
    known = lambda x, y: x is not None and y is not None
    table = [[100.0 if known(x, y) and x == y else near if chain[1] in (x, y) and {x, y} <= set(chain) else far for y in other] for x in own]
    return np.array(table), i, j


def _block(schema: str, only_comparable: bool):
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        number = lambda t, c: t[c].to_numpy().astype(float)
        steps = {c: _steps(left[c], right[c], *how) for c, how in CHAINS.items()}
        width = max(1, AT_ONCE // len(left))
        mine = {c: number(left, c)[:, None] for c in ("stability", *AXES)}
        theirs = {c: number(right, c) for c in ("stability", *AXES)}
        ids, others = left["asset_id"].to_numpy(), right["asset_id"].to_numpy()
        for at in range(0, len(right), width):
            of = slice(at, at + width)
            gap = np.abs(mine["stability"] - theirs["stability"][of])
            x = {f"{c}_score": t[i[:, None], j[of]] for c, (t, i, j) in steps.items()}
            x["stability_score"], axes = _hundredths(100 - gap * 5), 0.0
            for c, weight in AXES.items():
                one = 100 - np.abs(mine[c] - theirs[c][of]) * 4
                axes = axes + np.where(np.isnan(one), 50.0, _hundredths(one)) * weight
            x["axes_score"] = _hundredths(axes)
            x["similarity"] = _hundredths(x["regime_score"] * 0.32 + x["stability_score"] * 0.24 + x["behavior_score"] * 0.14 + x["axes_score"] * 0.3)
            x["weighted_similarity"] = _hundredths(x["similarity"] * 0.7 + x["regime_score"] * 0.15 + x["stability_score"] * 0.1 + x["axes_score"] * 0.05)
            x["comparable"] = (x["regime_score"] >= 35) & (gap < GAP) & (x["similarity"] >= 60) & (x["weighted_similarity"] >= 58)
            keep = x["comparable"] if only_comparable else gap < GAP
            q, r = np.nonzero(keep)
            if not len(q):
                continue
            row = {c: pa.array(x[c][keep]) for c in names if c in x}
            if "reasons" in names:
                why = (x["regime_score"] < 100) * 1 + (x["behavior_score"] < 100) * 2 + ~x["comparable"] * 4
                row["reasons"] = _WHY.take(pa.array(why[keep]))
            row |= {"asset_id": pa.array(ids[q]), "match_id": pa.array(others[at + r])}
            beside = [c for c in names if c not in row]
            taken = right.select([c.removeprefix("b_") for c in beside]).take(pa.array(at + r)).combine_chunks() if beside else None
            row |= {c: taken.column(k).chunk(0) for k, c in enumerate(beside)}
            yield pa.RecordBatch.from_arrays([row[c] for c in names], names=names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(k) for k in range(2)), strict=True):
                yield from run(*(pa.ipc.open_stream(x.as_buffer()).read_all() for x in (a, b)))

    return pairs


def _packed(rows: pa.Table) -> pa.Table:
    """A block's rows as one value."""
    sink, block = pa.BufferOutputStream(), rows.drop_columns("_block")
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_table(block)
    return pa.table({"_block": rows["_block"].slice(0, 1), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def context_pairs(queries: DataFrame, contexts: DataFrame, schema: str, only_comparable: bool = False) -> DataFrame:
    """compared() for all contexts within GAP of each query, itself included; or for the comparable ones alone.

    schema: which columns come out, of asset_id (the query's), match_id, what compared() tells (reasons joined by commas), and,
    as b_*, further columns of the contexts. Queries and contexts (staged tables, as both are counted first) are dealt into
    blocks, so that two of them make PAIRS pairs or so. A block is packed into one value, and the Cartesian product of the values
    is what tasks meet, one pair of blocks after the other: what is moved and written grows with the contexts, not with the
    pairs, and no table has to fit anywhere.
    """
    n, m = queries.count(), contexts.count()
    rows = max(1, -(-n // ROWS))
    columns = max(1, -(-m * -(-n // rows) // PAIRS))
    axes = {f: F.when(finite(F.col(f)).isNotNull(), clamp_score(F.col(f))) for f in AXES}

    def blocks(side: DataFrame, k: int, most: int, name: str) -> DataFrame:
        dealt = side.withColumns(axes).withColumn("_block", F.pmod(F.xxhash64("asset_id"), F.lit(k)).cast("int"))
        parts = min(k, most)
        return dealt.groupBy("_block").applyInArrow(_packed, "_block int, packed binary").repartitionById(parts, F.col("_block") % parts).select(F.col("packed").alias(name))

    left, right = blocks(queries.select(*CONTEXT), rows, PARTS[0], "a"), blocks(contexts, columns, PARTS[1], "b")
    return left.hint("SHUFFLE_REPLICATE_NL").crossJoin(right).mapInArrow(_block(schema, only_comparable), schema)


def outcome_statistics(matches: DataFrame, by: str = "a_asset_id") -> DataFrame:
    """Weighted chances of continuation and correction and their confidence, per query.

    matches: by, comparable, weighted_similarity, outcome, recency (null for none) and the axes b_*. All matched rows count
    for coverage; the comparable ones have weight.
    """
    known = [finite(F.col(f"b_{f}")) for f in AXES]
    some = known[0].isNotNull() | known[1].isNotNull() | known[2].isNotNull() | known[3].isNotNull() | known[4].isNotNull()
    axes = F.when(some, clamp_score(blend(*[(w, F.coalesce(F.when(k.isNotNull(), clamp_score(k)), F.lit(50.0))) for k, w in zip(known, AXES.values(), strict=True)]))).otherwise(50.0)
    fading = F.when(finite(F.col("recency")).isNull() | (F.col("recency") < 0), 1.0).otherwise(F.exp(F.col("recency") * -0.1))
    weight = F.when(F.col("comparable"), clamp_score(clamp_score(clamp_score(F.col("weighted_similarity")) * 0.65 + axes * 0.35) * fading))
    x = matches.withColumn("w", weight)
    g = x.groupBy(by).agg(F.count(F.lit(1)).alias("sample_size"), count_if(F.col("comparable")).alias("valid_matches"), F.coalesce(F.sum(F.when(F.col("outcome") == "CONTINUATION", F.col("w"))), F.lit(0.0)).alias("on"), F.coalesce(F.sum(F.when(F.col("outcome") != "CONTINUATION", F.col("w"))), F.lit(0.0)).alias("off"), F.avg(F.when(F.col("comparable"), F.col("weighted_similarity"))).alias("m_similarity"), F.avg("w").alias("m_weight"))
    total = F.col("on") + F.col("off")
    empty = (F.col("valid_matches") == 0) | (total <= 0)
    chance = lambda c: F.when(empty, 0.0).otherwise(clamp_score(F.col(c) / total * 100))
    sure = clamp_score(blend((0.35, F.col("m_similarity")), (0.25, F.col("m_weight")), (0.15, clamp_score(F.col("valid_matches") / F.col("sample_size") * 100)), (0.25, clamp_score(F.least(F.lit(100.0), F.col("valid_matches") * 12.0)))))
    g = g.withColumns({"continuation_probability": chance("on"), "correction_probability": chance("off"), "confidence": F.when(empty, 0.0).otherwise(sure)})
    few = F.array_compact(F.array(F.when(F.col("valid_matches") < 3, F.lit("statistics_low_match_count")), F.when((F.col("continuation_probability") < 55) & (F.col("correction_probability") < 55), F.lit("statistics_probabilities_not_decisive"))))
    warnings = F.when(F.col("valid_matches") == 0, F.array(F.lit("statistics_no_valid_matches"))).when(total <= 0, F.array(F.lit("statistics_weighted_total_zero"))).otherwise(few)
    weights = {f"{n}_weight": F.when(empty, 0.0).otherwise(clamp_score(v)) for n, v in (("continuation", F.col("on")), ("correction", F.col("off")), ("total", total))}
    return g.withColumns({**weights, "warnings": F.array_join(warnings, ",")}).drop("on", "off", "m_similarity", "m_weight")
