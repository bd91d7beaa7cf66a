"""Packing tokenised documents into sequences: hierarchical residual best-fit.

Documents are tokenised where they lie (a word's tokens don't depend on its neighbours, so each task keeps a bounded
cache by word) and cut into pieces of at most ``capacity`` tokens. Each partition packs its pieces best-fit decreasing.
Sequences that are nearly full are final; the others become items themselves and go up a tree: each node takes the
items of ``FAN_IN`` nodes below, packs them best-fit again and passes on what is still not nearly full.

Best fit is worked out on counts: a node's task gets how many items of each size there are, ``capacity`` numbers at most,
and tells for each size which ranks go to which bins. The items themselves stay in tables. Their ranks are numbered within
chunks of at most 65,536 items of a node and size, and the chunks' beginnings by sums over their counts, so that neither
equal sizes nor the tree's root gather in one task. A piece's place is found by one join a level.

A null text counts as empty and has the end token only. Every row of documents is packed, rows with equal doc_id too
(their pieces then have equal names, and are told apart by sequence_id and offset). Extra columns are ignored; an empty
table has no pieces.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, doc_text, documents, fresh, id_type

CAPACITY = 4096
END = 1
#: Bins filled to this share are final at once.
NEARLY_FULL = 0.98
FAN_IN = 8
_CACHE_WORDS = 300_000
_CACHE_PAIRS = 500_000
_END = b"\xff"  # after a run's last byte: no byte of UTF-8
#: What str.split() takes for white space but the tokenizer's pattern doesn't (or where that isn't sure).
_ODD = re.compile("[\x1c-\x1f\x85]")
#: Characters whose lower case and normal form are beyond doubt: up to U+017F, but for I with a dot.
_PLAIN_WORD = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]*")
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN_SPLIT = re.compile("[ \t\n\r\v\f]+")


class WordTokens:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, for tokenizers whose splits never cross white space.

    Words are looked up in a bounded cache, then the runs of letters, digits and signs in them in another. A run that is
    new is merged here, pair by pair in the order of the tokenizer's merge list; words with characters beyond U+017F, or
    of over 48 characters, or with what may be a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.of: dict[str, bytes] = {}
        self.runs_of: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = _byte_letters()
        self.inner = {b: vocab[c] for b, c in enumerate(shown)}
        self.last = {b: vocab[c + suffix] for b, c in enumerate(shown)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # (left id, right id): place in the merge list, and the id that results
        self.merge = {(vocab[x], vocab[y]): (k, vocab[x + y]) for k, (x, y) in enumerate(pairs)}
        byte_of = {c: b for b, c in enumerate(shown)}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            core = token.removesuffix(suffix)
            if core and all(c in byte_of for c in core) and i not in (self.coder.token_to_id("<|startoftext|>"), self.coder.token_to_id("<|endoftext|>")):
                self.bytes_of[i] = bytes(byte_of[c] for c in core) + _END * token.endswith(suffix)
        self.guess = tiktoken.Encoding("guess", pat_str=r"\S+", mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})._core_bpe.encode_single_piece
        self.fits: dict[tuple[int, int], bool] = {}

    def _symbols(self, raw: bytes) -> list[int]:
        """Ids of single bytes; one that the end mark follows has the id of a last byte."""
        if not raw.endswith(_END):
            return [self.inner[b] for b in raw]
        return [*(self.inner[b] for b in raw[:-2]), self.last[raw[-2]]]

    def _merged(self, raw: bytes) -> list[int]:
        """Ids by the merge list, pair by pair."""
        ids = self._symbols(raw)
        get, none = self.merge.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _fits(self, a: int, b: int) -> bool:
        got = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b] if b >= 0 else self._merged(self.bytes_of[a]) == [a]
        if len(self.fits) > _CACHE_PAIRS:
            self.fits.clear()
        self.fits[a, b] = got
        return got

    def _run(self, run: str) -> bytes:
        """Ids of one run. They are guessed by merging whatever gives the lowest token, and right if each token alone and each
        pair of neighbours come out as they are by the merge list: its first merge across a border would show in the pair."""
        raw = run.encode() + _END
        ids = self.guess(raw)
        fits, check = self.fits, self._fits
        for p in [(ids[-1], -1), *zip(ids, ids[1:])]:
            ok = fits.get(p)
            if not (check(*p) if ok is None else ok):
                ids = self._merged(raw)
                break
        return np.array(ids, dtype="<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()

    def _new(self, word: str) -> bytes | None:
        """The word's ids, or None if the tokenizer has to make them."""
        if len(word) > 48 or "<|" in word or not _PLAIN_WORD.fullmatch(word):
            return None
        low, runs_of, out = word.lower(), self.runs_of, []
        for run in [low] if low.isascii() and low.isalpha() else _RUNS.findall(low):
            got = runs_of.get(run)
            if got is None:
                if len(runs_of) > _CACHE_WORDS:
                    runs_of.clear()
                got = runs_of[run] = self._run(run)
            out.append(got)
        return b"".join(out)

    def batch(self, texts: list[str]) -> list[bytes]:
        of, out = self.of, []
        for t in texts:
            words = _PLAIN_SPLIT.split(t) if _ODD.search(t) else t.split()
            if len(of) > _CACHE_WORDS:
                of.clear()
            try:
                out.append(b"".join([of[w] for w in words]))
                continue
            except KeyError:
                pass
            hard = []
            for w in words:
                if w not in of:
                    got = self._new(w)
                    if got is None:
                        hard.append(w)
                    else:
                        of[w] = got
            if hard:
                for w, e in zip(hard, self.coder.encode_batch_fast(hard, add_special_tokens=False), strict=True):
                    of[w] = np.array(e.ids, dtype="<u4").tobytes()
            out.append(b"".join([of[w] for w in words]))
            for w in hard:
                if len(w) > 48:
                    of.pop(w, None)
        return out


def _byte_letters() -> list[str]:
    """The characters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves (little-endian unsigned 32-bit integers, binary) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = word_tokens(path or default_tokenizer()), np.array([end], dtype="<u4").tobytes()
        for b in batches:
            who, k, start, length, crc, own = [], [], [], [], [], []
            for row, got in enumerate(coder.batch(b.column(1).to_pylist())):
                got += last
                for j, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at : at + 4 * capacity]
                    who.append(row)
                    k.append(j)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    own.append(part)
            columns = [b.column(0).take(pa.array(who, pa.int64())), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return doc_text(docs).mapInArrow(run, f"{id_type(docs)}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by decreasing size of so many items of each size. Rows: size, lo, hi, each, bin, used.

    The items of that size with ranks lo to hi (exclusive) go to the bins from ``bin`` on, ``each`` in turn to every bin, which
    already hold ``used``. A bin takes items of a size for as long as they fit, as it stays the fullest one that takes them.
    """
    out, bins = [], 0
    open_at: dict[int, list[tuple[int, int]]] = {}  # room: ranges of bins (first, how many) that have it
    rooms: list[int] = []  # rooms that some bin has, ascending

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((first, n))

    for size in sorted(counts, reverse=True):
        left, lo = counts[size], 0
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                room, first, have = capacity, bins, -(-left // (capacity // size))
                bins += have
            else:
                room = rooms[k]
                first, have = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[k]
            each = room // size
            took = min(left, have * each)
            whole, rest = divmod(took, each)
            out.append((size, lo, lo + took, each, first, capacity - room))
            put(room - each * size, first, whole)
            put(room - rest * size, first + whole, int(rest > 0))
            put(room, first + whole + (rest > 0), have - whole - (rest > 0))
            left, lo = left - took, lo + took
    return out


def _first_level(capacity: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sizes = np.concatenate([b.column(b.schema.get_field_index("length")).to_numpy() for b in held])
        at, offset, fill = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        own, first, count = np.unique(sizes[order], return_index=True, return_counts=True)
        begin = dict(zip(own.tolist(), first.tolist(), strict=True))
        for size, lo, hi, each, to, used in best_fit(dict(zip(own.tolist(), count.tolist(), strict=True)), capacity):
            items, k = order[begin[size] + lo : begin[size] + hi], np.arange(hi - lo)
            at[items], offset[items] = to + k // each, used + k % each * size
        np.add.at(fill, at, sizes)  # by bin; there are no more of them than items
        base, row = TaskContext.get().partitionId() << 32, 0
        for b in held:
            part = slice(row, row + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + at[part]), pa.array(offset[part]), pa.array(fill[at[part]])], names=names)
            row += b.num_rows

    return run


def _node(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = best_fit(dict(zip(rows["fill"].tolist(), rows["n"].tolist(), strict=True)), capacity)
        return pd.DataFrame(found, columns=["fill", "lo", "hi", "each", "to", "used"]).assign(node=rows["node"][0])[["node", "fill", "lo", "hi", "each", "to", "used"]]

    return run


def _level(live: DataFrame, level: int, capacity: int) -> DataFrame:
    """node, item, fill, parent, base: the bin of its node that each item goes to, and its place there. live: node, item, fill."""
    chunked = live.withColumn("chunk", F.shiftright("item", 16))
    counts = chunked.groupBy("node", "fill", "chunk").agg(F.count(F.lit(1)).alias("n"))
    begin = counts.withColumn("before", F.sum("n").over(Window.partitionBy("node", "fill").orderBy("chunk")) - F.col("n")).drop("n")
    rules = counts.groupBy("node", "fill").agg(F.sum("n").alias("n")).groupBy("node").applyInPandas(_node(capacity), "node long, fill long, lo long, hi long, each long, to long, used long")
    own = F.row_number().over(Window.partitionBy("node", "fill", "chunk").orderBy("item")) - 1
    ranked = chunked.withColumn("own", own).join(begin, ["node", "fill", "chunk"]).select("node", "item", "fill", (F.col("before") + F.col("own")).alias("rank"))
    placed = ranked.join(rules, ["node", "fill"]).where("rank >= lo and rank < hi")
    k = F.col("rank") - F.col("lo")
    tag = F.lit(level << 56).cast("long") + F.call_function("shiftleft", F.col("node"), F.lit(32))
    return placed.select("node", "item", "fill", (tag + F.col("to") + F.expr("(rank - lo) div each")).alias("parent"), (F.col("used") + k % F.col("each") * F.col("fill")).alias("base"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (with a column length, 1 to capacity) with sequence_id and offset, in place of columns of these names if there are any."""
    items = items.drop("sequence_id", "offset")
    bin_, full = fresh(items.columns, "_bin"), fresh(items.columns, "_fill")
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields]
    first = cut(items.mapInArrow(_first_level(capacity, [*items.columns, bin_, "offset", full]), ", ".join([*shape, f"`{bin_}` long", "offset long", f"`{full}` long"])))
    bins = first.where(F.col(full) < NEARLY_FULL * capacity).select(F.col(bin_).alias("item"), F.col(full).alias("fill")).distinct()
    live = bins.select((F.shiftright("item", 32) / FAN_IN).cast("long").alias("node"), "item", "fill")
    nodes = bins.agg(F.max(F.shiftright("item", 32))).first()[0]
    levels, span = [], FAN_IN
    while nodes is not None:
        levels.append(cut(_level(live, len(levels) + 1, capacity)))
        if span > nodes:
            break
        above = levels[-1].groupBy("node", "parent").agg(F.sum("fill").alias("fill")).where(F.col("fill") < NEARLY_FULL * capacity)
        live, span = above.select((F.col("node") / FAN_IN).cast("long").alias("node"), F.col("parent").alias("item"), "fill"), span * FAN_IN
    moved = None
    for level in reversed(levels):
        own = level.select("item", "parent", "base")
        if moved is not None:
            up = moved.select(F.col("item").alias("parent"), F.col("sequence_id").alias("top"), F.col("base").alias("more"))
            own = own.join(up, "parent", "left").select("item", F.coalesce("top", "parent").alias("parent"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        moved = own.select("item", F.col("parent").alias("sequence_id"), "base")
    if moved is None:
        return first.withColumn("sequence_id", F.col(bin_)).drop(bin_, full)
    top, more = fresh(items.columns, "_top"), fresh(items.columns, "_more")
    placed = first.join(moved.select(F.col("item").alias(bin_), F.col("sequence_id").alias(top), F.col("base").alias(more)), bin_, "left")
    return placed.select(*items.columns, F.coalesce(top, bin_).alias("sequence_id"), (F.col("offset") + F.coalesce(more, F.lit(0))).alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(documents(spark, sf_dir, "doc_id", "text")))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
