"""Hidden Markov language model: Baum-Welch over all training documents, scores by scaled forward recursion.

Tokens are the words of a text and an end. Every word has emissions of its own; only where they are kept differs:

* The DICTIONARY most frequent words are numbered (a table of bounded size, sent to all tasks), and their emissions are
  part of the model that each Baum-Welch round sends out.
* The words beyond share one symbol while the rounds run (tied emissions). The last round also sums the expected counts of
  each of them across the partitions, into a table by word that grows with the vocabulary and stays distributed. A word's
  shares by state are kept in 8 bits each, and its emissions are an even mix of its count in these shares, normalised over
  all such words, and of its smoothed share among them. They are joined to the tokens when texts are scored. Frequent words,
  the skewed ones, never enter that join.

Each round is one pass over the whole sequences of all training documents: alpha and beta run from a document's first token
to its end, vectorised over the documents of a group. Sequences lie by place (all first tokens, then all second ones, longer
documents first), so that those that go on are always the leading rows. Expected counts are summed per symbol across
partitions by a grouping; DICTIONARY + 2 rows of STATES numbers come back. Model.log_likelihood holds one number a round.

Training documents are those whose crc32(doc_id as text) mod 10 is not 0. Null texts count as empty: their only token is
the end. Rows are told apart by a row number, so repeated rows and repeated ids are scored each. With no training
document nothing is known and base scores are 0. Extra columns are ignored. A null doc_id doesn't train and is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, discard, doc_text, documents, held_out, id_type, map_batches

STATES = 8
#: Words numbered for all tasks; two more symbols make 16 bits.
DICTIONARY = (1 << 16) - 2
ROUNDS = 6
#: Weight, in tokens, of the corpus distribution in each state's emissions, and of uniform moves in its transitions.
PRIOR = 200.0
#: Share of the state-free part in the emissions of words beyond the dictionary.
TIED = 0.5
#: Sequences are taken together until they have so many tokens.
GROUP = 1_500_000
#: Rows that are summed in single precision.
_CHUNK = 1 << 15
#: Tokens held at once (two bytes each) to be sorted by the length of their sequences.
BUFFER = 16_000_000
#: Words that a task holds before it counts them, and those beyond the dictionary.
COUNTED, COUNTED_RARE = 4_000_000, 1_000_000
#: Bytes of texts that are cut into words at once.
PIECE = 8 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after another, and each text's number of words. Only A-Z are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # blanks before the first word or behind the last leave an empty one
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words if before[-1] == len(words) else words.filter(full), np.diff(before[at])


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """batch by rows that have about PIECE bytes of the column."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    borders = np.concatenate([[0], np.flatnonzero(np.diff(ends // PIECE)) + 1, [len(ends)]])
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all rows of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            got = pc.value_counts(pa.chunked_array(own, pa.string()))
            own.clear()
            return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "c"])

        for b in batches:
            for piece in pieces(b, "text"):
                own.append(words_of(piece.column("text"))[0])
                if sum(map(len, own)) >= COUNTED:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """The words of the highest counts, ``most`` rows at most: as many whole steps of the count (an eighth of an octave each) as fit."""
    step = F.floor(F.log2("c") * 8).cast("int")
    room, least = most, None
    for b, n in sorted(((r["b"], r["n"]) for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):  # some hundred rows
        if n > room:
            break
        room, least = room - n, b
    if least is None:
        return []
    return sorted(counts.where(step >= least).collect(), key=lambda r: (-r["c"], r["word"]))


class Sequences:
    """Sequences of symbols, laid out by place. ``place`` holds, document after document in ``order``, where each symbol lies."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in self.order])
        self.live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.flat = np.concatenate([docs[i] for i in self.order])
        first = np.cumsum(lengths) - lengths
        self.place = self.at[np.arange(len(self.flat)) - np.repeat(first, lengths)] + np.repeat(np.arange(len(docs)), lengths)
        self.x = np.empty_like(self.flat)
        self.x[self.place] = self.flat


class Room:
    """Three arrays to work in, kept from one group of sequences to the next: fresh memory costs as much as what is done in it."""

    def __init__(self) -> None:
        self.arrays: list[np.ndarray] = []

    def __call__(self, rows: int, states: int, dtype) -> list[np.ndarray]:
        if not self.arrays or len(self.arrays[0]) < rows:
            self.arrays = []
            self.arrays = [np.empty((rows, states), dtype=dtype) for _ in range(3)]
        return [a[:rows] for a in self.arrays]


class Model:
    """Start, moves and emissions; emissions by symbol: rows of STATES probabilities."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, log_likelihood: tuple[float, ...] = ()) -> None:
        self.start, self.moves, self.emits, self.log_likelihood = start, moves, emits, log_likelihood

    @classmethod
    def first(cls, shares: np.ndarray, states: int, seed: int = 7) -> Model:
        """States that differ by random factors on each symbol, and mostly stay."""
        noise = np.exp(np.random.default_rng(seed).normal(0.0, 1.0, (len(shares), states)))
        emits = shares[:, None] * noise
        moves = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))

    def forward(self, seqs: Sequences, seen: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """Scales by place: their product is a sequence's probability. alpha takes the scaled forward vectors; it may be seen itself."""
        start, moves, ones = self.start.astype(seen.dtype), self.moves.astype(seen.dtype), np.ones(len(self.start), dtype=seen.dtype)
        scale, a, o = np.empty(len(seen), dtype=seen.dtype), None, 0
        ahead, least = np.empty((len(seqs.order), len(start)), dtype=seen.dtype), np.array(1e-37, dtype=seen.dtype)
        for k in seqs.live.tolist():  # a step has few rows where texts are long, so that it is its calls that count
            here = seen[o : o + k]
            before = start if a is None else np.dot(a[:k], moves, out=ahead[:k])
            a, total = alpha[o : o + k], scale[o : o + k]
            np.multiply(before, here, out=a)
            np.dot(a, ones, out=total)
            np.maximum(total, least, out=total)
            np.divide(a, total[:, None], out=a)
            o += k
        return scale

    def expect(self, seqs: Sequences, out: tuple[np.ndarray, np.ndarray, np.ndarray], dtype=np.float64, room: Room | None = None) -> tuple[float, np.ndarray]:
        """Adds the expected starts, moves and emissions of whole sequences to out; their log likelihood, and the states' posteriors by place.

        room: memory to work in; the posteriors lie there, up to the next use of it.
        """
        starts, moves, emits = out
        x, states = seqs.x.astype(np.intp), len(self.start)
        seen, alpha, post = (room or Room())(len(x), states, dtype)
        np.take(self.emits.astype(dtype), x, axis=0, out=seen, mode="clip")
        scale = self.forward(seqs, seen, alpha)
        seen /= scale[:, None]
        back, ones = np.ascontiguousarray(self.moves.T.astype(dtype)), np.ones(states, dtype=dtype)
        live, at = seqs.live.tolist(), seqs.at.tolist()
        ahead, last = None, 0
        for k, o in zip(reversed(live), reversed(at[:-1]), strict=True):
            beta = post[o : o + k]
            if last:
                np.dot(ahead, back, out=beta[:last])
            if last < k:  # sequences that end here
                beta[last:] = 1
            ahead, last = seen[o : o + k], k
            np.multiply(ahead, beta, out=ahead)
        before = np.arange(at[1], len(x)) - np.repeat(seqs.live[:-1], seqs.live[1:])  # a place earlier in the same sequence
        for k in range(0, len(before), _CHUNK):
            moves += (alpha.take(before[k : k + _CHUNK], axis=0).T @ seen[at[1] + k : at[1] + k + _CHUNK]).astype(float) * self.moves
        post *= alpha
        post /= np.maximum(post @ ones, 1e-37)[:, None]
        starts += post[: at[1]].sum(axis=0)
        for s in range(states):
            emits[:, s] += np.bincount(x, weights=post[:, s], minlength=len(emits))
        return float(np.log(scale).sum(dtype=float)), post

    def score(self, docs: list[np.ndarray], symbol: int = -1, factors: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each sequence of symbols. factors: by state, what the occurrences of ``symbol`` are worth beside its emission, in order."""
        got = np.zeros(len(docs))
        if not docs:
            return got
        seqs = Sequences(docs)
        seen = self.emits.take(seqs.x, axis=0)
        lengths = np.array([len(d) for d in docs])
        if factors is not None and len(factors):
            n = np.array([np.count_nonzero(d == symbol) for d in docs])
            first, n = (np.cumsum(n) - n)[seqs.order], n[seqs.order]
            seen[seqs.place[seqs.flat == symbol]] *= factors[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        logs = np.log10(self.forward(seqs, seen, seen))[seqs.place]
        ends = np.cumsum(lengths[seqs.order])
        got[seqs.order] = np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]))
        return got


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], list[str | None]]]:
    """ids and tails (if there is such a column) of rows, about ``most`` tokens together. Of up to BUFFER tokens the longest sequences come first, so that
    few groups have long ones, each place of which costs a step."""
    ids: list[np.ndarray] = []
    tails: list[str | None] = []
    size = 0

    def groups() -> Iterator[tuple[list[np.ndarray], list[str | None]]]:
        for own in by_length(ids, most):
            yield [ids[i] for i in own], [tails[i] for i in own]

    for b in batches:
        for i, tail in zip(b.column(0).to_pylist(), b.column(1).to_pylist() if b.num_columns > 1 else [None] * b.num_rows, strict=True):
            ids.append(np.frombuffer(i, "<u2"))
            tails.append(tail)
            size += len(ids[-1])
            if size >= BUFFER:
                yield from groups()
                ids, tails, size = [], [], 0
    yield from groups()


def by_length(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Numbers of the sequences, the longest first, in groups of about ``most`` symbols."""
    out: list[list[int]] = []
    size = most
    for i in np.argsort([-len(d) for d in docs], kind="stable").tolist():
        if size >= most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(docs[i])
    return out


def baum_welch(encoded: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, DataFrame | None]:
    """The model, and word, n, s0, s1, ...: counts of the words of tails (the last symbol but one), and expected ones by state in the last round.

    encoded: columns ids (the training documents' symbols, 16-bit) and tail (blank-joined words beyond the dictionary, in
    order). shares: the symbols' shares in them.
    """
    sc, model, size = encoded.sparkSession.sparkContext, Model.first(shares, states), len(shares)
    names, rare, beyond = [f"s{i}" for i in range(states)], size - 2, None
    for turn in range(rounds):
        sent, last = sc.broadcast(model), turn == rounds - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            own, out, total = sent.value, (np.zeros(states), np.zeros((states, states)), np.zeros((size, states))), 0.0
            shape = lambda k, words, n, table: pa.RecordBatch.from_arrays([k, words, pa.array(n, pa.int64()), *[pa.array(table[:, s], pa.float64()) for s in range(states)]], names=["k", "word", "n", *names])
            words, parts, room = [], [], Room()  # of tails: words, and the states' posteriors where they stand

            def counted() -> pa.RecordBatch:
                coded, weights = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode(), np.concatenate(parts)
                which, most = coded.indices.to_numpy(), len(coded.dictionary)
                table = np.stack([np.bincount(which, weights=weights[:, s], minlength=most) for s in range(states)], axis=1)
                words.clear()
                parts.clear()
                return shape(pa.nulls(most, pa.int32()), coded.dictionary, np.bincount(which, minlength=most), np.rint(table * 1024) / 1024)  # short numbers take less room

            for ids, tails in _grouped(batches, GROUP):
                seqs = Sequences(ids)
                more, post = own.expect(seqs, out, np.float32, room)
                total += more
                if last:
                    words.append(pc.split_pattern(pa.array([tails[i] for i in seqs.order if tails[i] is not None], pa.string()), " ").flatten())
                    parts.append(post[seqs.place[seqs.flat == rare]])
                    if sum(map(len, words)) >= COUNTED_RARE:
                        yield counted()
            if words:
                yield counted()
            table = np.concatenate([out[2], out[1], out[0][None, :], np.full((1, states), total)])
            used = np.flatnonzero(table.any(axis=1))
            yield shape(pa.array(used, pa.int32()), pa.nulls(len(used), pa.string()), np.zeros(len(used), dtype=np.int64), table[used])

        found = encoded.select("ids", *["tail"] * last).mapInArrow(run, "k int, word string, n long, " + ", ".join(f"{n} double" for n in names))
        summed = found.groupBy("k", "word").agg(*[F.sum(n).alias(n) for n in ["n", *names]])
        if last:
            summed = cut(summed)
            beyond = summed.where("word is not null").drop("k")
        rows = summed.where("k is not null").drop("word", "n").toPandas()  # a row a symbol
        table = np.zeros((size + states + 2, states))
        table[rows["k"].to_numpy()] = rows[names].to_numpy()
        emits, moves, start = table[:size] + PRIOR * shares[:, None], table[size : size + states] + 1.0, table[-2] + 1.0
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0), (*model.log_likelihood, float(table[-1, 0])))
        sent.unpersist()
    return model, beyond


def train_and_score(docs: DataFrame, training, states: int = STATES, dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, training flag, counts and scores of every row. training: a boolean column of doc_id."""
    if states > 8:
        raise ValueError("a word's shares are kept for eight states at most")
    rows = doc_text(docs).withColumn("trains", F.coalesce(training, F.lit(False)))
    counts = cut(word_counts(rows.where("trains")))
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = rows.where("trains").count()
    n, v = words + n_docs, distinct + (n_docs > 0)
    top = most_frequent(counts, dictionary)
    numbered = pa.array([r["word"] for r in top], pa.string())
    c = np.array([r["c"] for r in top], dtype=np.float64)
    rare, end = len(top), len(top) + 1
    n_rare, v_rare = words - c.sum(), distinct - len(top)
    base_floor, rare_floor = float(n + 0.1 * (v + 1)), float(n_rare + 0.1 * (v_rare + 1))
    base_of = np.log10((c + 0.1) / base_floor)
    end_base = float(np.log10((n_docs + 0.1) / base_floor))
    sent = docs.sparkSession.sparkContext.broadcast((numbered, base_of))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        numbered, base_of = sent.value
        for whole in batches:
            for b in pieces(whole, "text"):
                own, n = words_of(b.column("text"))
                at = pc.index_in(own, value_set=numbered).fill_null(-1).to_numpy()
                hit, doc = at >= 0, np.repeat(np.arange(len(n)), n)
                known, base = np.bincount(doc[hit], minlength=len(n)), np.bincount(doc[hit], weights=base_of[at[hit]], minlength=len(n))
                ends = np.cumsum(n + 1)
                ids = np.full(ends[-1], end, dtype="<u2")
                ids[np.arange(len(at)) + doc] = np.where(hit, at, rare)
                beyond = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - known)), pa.int32()), own.filter(pa.array(~hit)))
                tail = pc.if_else(pa.array(known < n), pc.binary_join(beyond, " "), pa.scalar(None, pa.string()))
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(ids)])
                new = [np.arange(row, row + len(n)), ids, n + 1, known + (n_docs > 0), base + end_base, tail]
                row += len(n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("trains"), *[x if isinstance(x, pa.Array) else pa.array(x) for x in new]], names=names)

    shape = f"{id_type(docs)}, trains boolean, row long, ids binary, n_tokens long, known long, base double, tail string"
    names = StructType.fromDDL(shape).names
    encoded = cut(rows.mapInArrow(encode, shape))

    shares = np.append(c, [max(n_rare, 0), n_docs]).astype(float) + 0.1
    discard(counts)
    model, beyond = baum_welch(encoded.where("trains"), shares / shares.sum(), states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # words beyond the dictionary: counts and shares by a join on the word, one row per document again
    by_state = [f"s{i}" for i in range(states)]
    total = sum((F.col(s) for s in by_state[1:]), F.col(by_state[0]))
    bits = [F.call_function("shiftleft", F.round(F.col(s) / total * 255).cast("long"), F.lit(8 * i)) for i, s in enumerate(by_state)]
    packed = bits[0]
    for x in bits[1:]:
        packed = packed.bitwiseOR(x)
    by_word = beyond.select("word", F.col("n").alias("c"), F.when(total > 0, packed).otherwise(F.lit(0).cast("long")).alias("shares"))
    byte = lambda i: F.call_function("shiftrightunsigned", F.col("shares"), F.lit(8 * i)).bitwiseAND(F.lit(255).cast("long"))
    every = sum((byte(i) for i in range(1, states)), byte(0))
    sums = by_word.where("shares <> 0").agg(*[F.sum(F.col("c") * byte(i) / every) for i in range(states)]).first()
    weights = np.array([(1 - TIED) / x if x else 0.0 for x in sums])
    tails = encoded.where("tail is not null").select("row", F.posexplode(F.split("tail", " ")).alias("pos", "word")).join(by_word.hint("shuffle_hash"), "word", "left")  # a partition's words are few; their occurrences need no sort
    of = tails.groupBy("row").agg(F.collect_list(F.struct("pos", F.coalesce("c", F.lit(-1)).alias("c"), F.coalesce("shares", F.lit(0)).alias("shares"))).alias("words"))

    def forward():
        own = shared.value

        def one(b: pa.RecordBatch) -> list:
            get = lambda name: b.column(b.schema.get_field_index(name))
            words, n = get("words").flatten(), np.diff(get("words").offsets.to_numpy())
            n[~get("words").is_valid().to_numpy(zero_copy_only=False)] = 0
            doc = np.repeat(np.arange(b.num_rows), n)
            order = np.lexsort((words.field("pos").to_numpy(), doc))
            c = words.field("c").to_numpy()[order]
            share = words.field("shares").to_numpy()[order].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :states].astype(float)
            seen = np.maximum(c, 0)
            factors = share / np.maximum(share.sum(axis=1), 1)[:, None] * seen[:, None] * weights + ((seen + 0.1) / rare_floor * TIED)[:, None]
            tail_base = np.bincount(doc, weights=np.log10((seen + 0.1) / base_floor), minlength=b.num_rows)
            docs, score, first = [np.frombuffer(i, "<u2") for i in get("ids").to_pylist()], np.zeros(b.num_rows), np.cumsum(n) - n
            for group in by_length(docs, GROUP):
                at = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in group])
                score[group] = own.score([docs[i] for i in group], rare, factors[at])
            known = get("known").to_numpy() + np.bincount(doc, weights=c >= 0, minlength=b.num_rows).astype(np.int64)
            return [get("doc_id"), get("trains"), get("n_tokens"), pa.array(known, pa.int64()), pa.array(get("base").to_numpy() + tail_base, pa.float64()), pa.array(score, pa.float64())]

        return one

    scored = map_batches(encoded.drop("tail").join(of, "row", "left"), f"{id_type(docs)}, trains boolean, n_tokens long, n_known long, base_score double, score double", forward)
    return scored.select("doc_id", "trains", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = held_out(F.col("doc_id"), 10, 0)
    return train_and_score(docs, ~held_out(docs["doc_id"], 10, 0)).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
