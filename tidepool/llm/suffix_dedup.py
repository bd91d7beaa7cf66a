"""Removal of passages that an earlier document has, by suffix arrays built in two stages.

A byte goes if it lies in a string of WIDTH bytes that also starts in a document with a smaller doc_id. To bring equal
strings together without moving every suffix, each string is filed under its minimiser, the least hash of the GRAM-byte
strings in it: equal strings have equal minimisers, and consecutive strings of a text mostly share one, so that a text
falls into runs (a run of n strings is n + WIDTH - 1 bytes).

1. Texts are dealt into parts by a hash. Minimisers go, with their documents and parts and packed by place, to tasks that
   keep those of two documents or more and tell each part which of its minimisers are; what is filed under others is unique.
2. Runs filed under kept minimisers, part by part; equal runs become one, with the least doc_id.
3. Suffix arrays over the distinct runs, in blocks of about BLOCK bytes that hold all runs of a minimiser: of the suffixes
   that a string starts at, and the few behind them that these are induced from, only those smaller than their successors are
   sorted directly, the others are induced from them by a scan over the buckets of first bytes; common prefixes of neighbours
   tell which strings are equal, and each class takes its least doc_id. A minimiser whose distinct runs are over HOT bytes is
   not held in one block: its strings are filed under themselves instead.
4. What lies in a class with a smaller doc_id is joined back to the runs' places, and the intervals of a document united.

Every string meets all its equals, whatever the skew; nothing is sampled or capped. Intermediate tables are cut in the
shared folder.

Null texts count as empty, and texts under WIDTH bytes lose nothing. Rows with equal doc_id don't remove from each other.
A row with a null doc_id neither removes nor loses. Extra columns are kept by ``deduplicate``. After removal a character
that was cut apart is dropped from ``deduplicate``'s text; the query's digest is of the bytes as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, discard, doc_text, documents, fresh

WIDTH = 50
GRAM = 16
BLOCK = 1 << 19
HOT = 1 << 21
#: Runs are split into ones of so many strings at most.
LONGEST = 1024
#: Bytes of texts that are hashed together, minimisers that a task holds before it deals them out, runs that are filed together, and bytes of texts of a part.
PIECE, HELD, AT_ONCE, PART = 1 << 15, 1 << 21, 1 << 12, 1 << 24


def runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, text's number, first string's place in data and number of strings of each run of the texts data[offsets[k]:offsets[k + 1]], offsets from 0."""
    if len(data) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,)).copy()
    m = len(data) - gram + 1
    h = (eight[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[gram - 8 : gram - 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    w, done = width - gram + 1, 1
    while done * 2 <= w:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    if done < w:
        h = np.minimum(h[: len(h) - (w - done)], h[w - done :])
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    edges = np.concatenate([offsets[1:-1], offsets[1:] - (width - 1)])  # of texts, and of what would reach beyond them
    new[edges[(edges > 0) & (edges < len(h))]] = True
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(h)))
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = start + width <= offsets[text + 1]
    text, start, n = text[inside], start[inside], n[inside]
    if len(n) and n.max() > LONGEST:
        parts = -(-n // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(np.repeat(n, parts) - inner * LONGEST, LONGEST)
        text, start = np.repeat(text, parts), np.repeat(start, parts) + inner * LONGEST
    return h[start].view(np.int64), text, start, n


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes and offsets of some texts after the other, about PIECE bytes at a time."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        upto = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1))
        yield at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """values, the first sizes[0] of them as bytes, then the next sizes[1], and so on."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(blobs: list[pa.Array], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for blob in blobs for x in blob.to_pylist()), dtype=kind)


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor: if the first byte that differs from its follower is; the last suffix is larger than the empty one."""
    out = np.append(t[:-1] < t[1:], False)
    alike = np.flatnonzero(t[:-1] == t[1:])
    if len(alike):  # as the first one behind them that differs
        ends = alike[np.append(alike[1:] != alike[:-1] + 1, True)]
        out[alike] = out[ends[np.searchsorted(ends, alike)] + 1]
    return out


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from each place on, and ``depth`` places beyond the end, as numbers in the order of the bytes."""
    padded = np.concatenate([t, np.zeros(depth + 8, dtype=np.uint8)])
    return np.ndarray((len(t) + depth,), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def suffix_array(t: np.ndarray, depth: int = WIDTH + 6, wanted: np.ndarray | None = None, smaller: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of bytes t in order of their first ``depth`` bytes at least (ties in any order, side by side).

    wanted: which suffixes, if not all; of a suffix larger than its successor the successor as well.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    smaller = _smaller(t) if smaller is None else smaller
    wanted = np.ones(n, dtype=bool) if wanted is None else wanted
    direct = _sorted_directly(t, np.flatnonzero(smaller & wanted), depth)
    # buckets of first bytes, each: larger ones as induced, then smaller ones as sorted
    first = t[direct]
    edges = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1]))
    byte_before = np.full(n, -1, dtype=np.int16)  # of wanted suffixes
    byte_before[1:][wanted[:-1]] = t[:-1][wanted[:-1]]
    out = []
    for c in range(256):
        own = induced[c]
        k = 0
        while k < len(own):  # runs of one byte induce within their bucket
            before = own[k][byte_before[own[k]] == c] - 1
            if len(before):
                own.append(before)
            k += 1
        bucket = np.concatenate([*own, direct[edges[c] : edges[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        byte = byte_before[bucket]
        later = byte > c
        before, byte = bucket[later] - 1, byte[later].astype(np.uint8)
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[t[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _sorted_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` by their first ``depth`` bytes, eight at a time, ties only being sorted further."""
    word = _words(t, depth)
    key = word[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    tied = np.arange(len(at))
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else tied
    for skip in range(8, depth, 8):
        again = np.zeros(len(group), dtype=bool)
        same = group[1:] == group[:-1]
        again[1:] |= same
        again[:-1] |= same
        tied, group = tied[again], group[again]
        if not len(tied):
            break
        key = word[at[tied] + skip]
        by_key = np.argsort(key)
        rank = np.empty(len(key), dtype=np.int64)
        rank[by_key] = np.cumsum(np.diff(key[by_key], prepend=key[by_key[:1]]) != 0)
        both = group * len(key) + rank  # ranks are less than that
        order = np.argsort(both)
        at[tied] = at[tied][order]
        both = both[order]
        group = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
    return at


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, up to ``most``; 0 for the first."""
    word = _words(t, most)
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for skip in range(0, most, 8):
        if not len(live):
            break
        apart = (word[order[live] + skip] ^ word[order[live - 1] + skip]).byteswap()
        low = apart & (~apart + np.uint64(1))
        same = np.where(apart == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        out[live] += same
        live = live[apart == 0]
    return np.minimum(out, most)


def _within(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the intervals, none of which overlap."""
    step = np.zeros(n + 1, dtype=np.int8)
    step[begins] += 1
    step[ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def least_owners(strings: list[bytes], owners: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of bytes with their least documents: per stretch of equal results run number, first and last-plus-one string, and the least owner of the strings."""
    t = np.frombuffer(b"\xff".join([*strings, b""]), dtype=np.uint8)
    length = np.array([len(s) for s in strings])
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    n = length - width + 1
    # suffixes at which a string starts, and those behind the last one of a run up to one that is sorted directly (as is the one before \xff)
    smaller = _smaller(t)
    directly = np.flatnonzero(smaller)
    wanted, is_string = _within(begin, directly[np.searchsorted(directly, begin + n - 1)] + 1, len(t)), _within(begin, begin + n, len(t))
    order = suffix_array(t, width + 6, wanted, smaller)
    order = order[is_string[order]]
    heads = np.flatnonzero(common_prefixes(t, order, width) < width)
    run = np.repeat(np.arange(len(strings)), n)
    string = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    number = np.cumsum(is_string, dtype=np.int32)[order] - 1  # of a string among all of them
    value = np.empty(len(run), dtype=owners.dtype)
    value[number] = np.repeat(np.minimum.reduceat(owners[run[number]], heads), np.diff(np.append(heads, len(order))))
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    upto = string[np.append(at[1:] - 1, len(run) - 1)] + 1
    return run[at], string[at], upto, value[at]


def _least_by_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        owners = rows["least"].to_numpy()
        run, a, b, least = least_owners(rows["run"].tolist(), owners)
        keep = rows["shared"].to_numpy()[run] | (least < owners[run])  # the others lose nothing
        run = run[keep]
        return pd.DataFrame({"h": rows["h"].to_numpy()[run], "k": rows["k"].to_numpy()[run], "a": a[keep], "b": b[keep], "least": least[keep]})

    for batch in batches:
        sizes = batch["run"].map(len).to_numpy()
        h = batch["h"].to_numpy()
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))  # the last minimiser may go on in the next batch
        start = 0
        totals = np.cumsum(sizes)
        for end in ends[:-1]:
            if size + totals[end - 1] - (totals[start - 1] if start else 0) >= BLOCK:
                yield solved(pd.concat([*held, batch[start:end]], ignore_index=True))
                held, size, start = [], 0, end
        # what is held may end with the minimiser that this batch begins with, so it is only cut between minimisers
        held.append(batch[start:])
        size += totals[-1] - (totals[start - 1] if start else 0)
    if held:
        yield solved(pd.concat(held, ignore_index=True))


def _owned(docs: DataFrame) -> DataFrame:
    return doc_text(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH)).withColumn("doc_id", F.col("doc_id").cast("long"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), and arrays at, upto of removed byte intervals, which may overlap."""
    own, spark = _owned(docs), docs.sparkSession
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 20))), 1)
    keyed = own.select("doc_id", F.xxhash64("text").alias("tkey"), "text").withColumn("part", F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(parts)).cast("int"))

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def dealt() -> pa.RecordBatch:
            h, doc, part = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            place = (h & 0xFFFFFFFF) % parts
            order = np.argsort(place.astype(np.uint16) if parts < 1 << 16 else place, kind="stable")
            sizes = np.bincount(place, minlength=parts)
            some = np.flatnonzero(sizes)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[_blobs(x[order], sizes[some]) for x in (h, doc, part)]], names=["place", "h", "doc", "part"])

        for b in batches:
            docs, part = b["doc_id"].to_numpy(), b["part"].to_numpy()
            for first, data, offsets in _pieces(b["text"]):
                h, text, _, _ = runs(data, offsets)
                held.append((h, docs[first + text], part[first + text]))
                count += len(h)
                if count >= HELD:
                    yield dealt()
                    count = 0
        if held:
            yield dealt()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [(b["h"], b["doc"], b["part"]) for b in batches]
        if not blobs:
            return
        h, doc, part = (_values(list(x), kind) for x, kind in zip(zip(*blobs, strict=True), (np.int64, np.int64, np.int32), strict=True))
        blobs.clear()
        if not len(h):
            return
        order = np.argsort(h)
        h, doc, part = h[order], doc[order], part[order]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        apart = np.append(False, (doc[1:] != doc[:-1]) & (h[1:] == h[:-1]))
        several = np.repeat(np.logical_or.reduceat(apart, heads), np.diff(np.append(heads, len(h))))
        h, part = h[several], part[several]
        order = np.lexsort((h, part))
        h, part = h[order], part[order]
        once = np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))[: len(h)]
        h, part = h[once], part[once]
        of, sizes = np.unique(part, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(of), _blobs(h, sizes)], names=["part", "hs"])

    found = keyed.select("doc_id", "part", "text").mapInArrow(minimisers, "place int, h binary, doc binary, part binary")
    kept_of = cut(found.repartitionById(parts, "place").mapInArrow(kept, "part int, hs binary"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.Array] = []
        out: list[tuple] = []
        known = None
        size = 0

        def filed() -> pa.RecordBatch:
            h, doc, key, start, n, raw = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), _blobs(raw, n), pa.array(doc), pa.array(key), pa.array(start)], names=["h", "run", "doc_id", "tkey", "start"])

        for b in batches:
            texts = b.filter(b["hs"].is_null())
            if len(texts) < len(b):  # they come first
                some.append(b["hs"].drop_null())
            if not len(texts):
                continue
            if known is None:
                known = np.unique(_values(some, np.int64))
                some.clear()
            if not len(known):
                continue
            doc, key = texts["doc_id"].to_numpy(), texts["tkey"].to_numpy()
            for first, data, offsets in _pieces(texts["text"]):
                h, text, start, n = runs(data, offsets)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                h, text, start, n = h[hit], text[hit], start[hit], n[hit] + (WIDTH - 1)
                for at in range(0, len(h), AT_ONCE):  # of a long text some at a time
                    own = slice(at, at + AT_ONCE)
                    upto = np.cumsum(n[own])
                    raw = data[np.arange(upto[-1]) + np.repeat(start[own] - (upto - n[own]), n[own])]
                    out.append((h[own], doc[first + text[own]], key[first + text[own]], (start - offsets[text])[own].astype(np.int32), n[own], raw))
                    size += len(raw)
                    if size >= BLOCK:
                        yield filed()
                        size = 0
        if out:
            yield filed()

    both = kept_of.selectExpr("part", "hs", "CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS bigint) AS tkey", "CAST(NULL AS string) AS text").unionByName(keyed.withColumn("hs", F.lit(None).cast("binary")))
    filed = cut(both.repartitionById(parts, "part").sortWithinPartitions(F.col("hs").isNull()).mapInArrow(split, "h long, run binary, doc_id long, tkey long, start int"))
    discard(kept_of)
    unique = cut(filed.groupBy("h", "run").agg(F.min("doc_id").alias("least"), (F.max("doc_id") > F.min("doc_id")).alias("shared")))
    distinct = unique.select("h", F.xxhash64("run").alias("k"), "run", "least", "shared")
    hot = cut(distinct.groupBy("h").agg(F.sum(F.octet_length("run")).alias("bytes")).where(F.col("bytes") > HOT).select("h"))
    places = filed.select("h", "doc_id", "tkey", "start", F.xxhash64("run").alias("k"))
    if not hot.isEmpty():
        strings = lambda: F.explode(F.transform(F.sequence(F.lit(0), F.octet_length("run") - WIDTH), lambda i: F.struct(i.alias("i"), F.substring(F.col("run"), i + 1, F.lit(WIDTH)).alias("s"))))
        alone = distinct.join(hot, "h").select(strings().alias("x"), "least", "shared").select(F.xxhash64("x.s", F.lit(1)).alias("h"), F.xxhash64("x.s").alias("k"), F.col("x.s").alias("run"), "least", "shared")
        alone = alone.groupBy("h", "k", "run").agg(F.min("least").alias("least"), ((F.max("least") > F.min("least")) | F.max("shared")).alias("shared"))
        distinct = distinct.join(hot, "h", "left_anti").unionByName(alone)
        moved = filed.join(hot, "h").select(strings().alias("x"), "doc_id", "tkey", "start").select(F.xxhash64("x.s", F.lit(1)).alias("h"), "doc_id", "tkey", (F.col("start") + F.col("x.i")).alias("start"), F.xxhash64("x.s").alias("k"))
        places = places.join(hot, "h", "left_anti").unionByName(moved)
    places = cut(places)  # without the bytes, which are the most of it
    discard(filed)
    blocks = distinct.repartition("h").sortWithinPartitions("h")
    least = cut(blocks.mapInPandas(_least_by_run, "h long, k long, a int, b int, least long"))
    discard(unique)
    gone = places.join(least.hint("shuffle_hash"), ["h", "k"]).where("doc_id > least").select("doc_id", "tkey", (F.col("start") + F.col("a")).alias("at"), (F.col("start") + F.col("b") + (WIDTH - 1)).alias("upto"))
    return gone.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("at", "upto")).alias("spans")).select("doc_id", "tkey", F.col("spans.at").alias("at"), F.col("spans.upto").alias("upto"))


def unite(at, upto) -> list[tuple[int, int]]:
    """Disjoint ascending intervals that cover the same bytes; touching ones become one."""
    if at is None or not len(at):
        return []
    at, upto = np.asarray(at), np.asarray(upto)
    order = np.argsort(at, kind="stable")
    at, reach = at[order], np.maximum.accumulate(upto[order])
    first = np.append(True, at[1:] > reach[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)
    return list(zip(at[first].tolist(), reach[last].tolist(), strict=True))


def _with_removals(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the begins and ends of what goes, and the names of these two columns, which docs doesn't have."""
    key, at, upto = (fresh(docs.columns, name) for name in ("_tkey", "_at", "_upto"))
    gone = removals(docs).withColumnsRenamed({"tkey": key, "at": at, "upto": upto})
    return docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(gone.hint("shuffle_hash"), ["doc_id", key], "left").drop(key), at, upto


def rest_of(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    return b"".join([*out, text[last:]])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    found, begin, end = _with_removals(doc_text(docs))

    def one(texts: list[str], ats: list, uptos: list) -> list[pa.Array]:
        out = []
        for text, at, upto in zip(texts, ats, uptos, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = unite(at, upto)
            rest = rest_of(raw, spans)
            out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
        return [pa.array([x[k] for x in out], pa.string() if k == 3 else pa.int64()) for k in range(4)]

    return add_columns(found, ["text", begin, end], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda: one).drop("text", begin, end)


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs whose texts lack the removed bytes."""
    found, begin, end = _with_removals(docs)
    rest = fresh([*docs.columns, begin, end], "_rest")

    def one(texts: list[str | None], ats: list, uptos: list) -> list[pa.Array]:
        return [pa.array([None if not at else rest_of(t.encode("utf-8", "surrogatepass"), unite(at, upto)).decode("utf-8", "ignore") for t, at, upto in zip(texts, ats, uptos, strict=True)], pa.string())]

    changed = add_columns(found, ["text", begin, end], f"`{rest}` string", lambda: one)
    return changed.withColumn("text", F.coalesce(rest, "text")).select(docs.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
