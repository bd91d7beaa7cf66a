"""Spelling variants: words one edit apart, grouped under the form that most texts use.

Words are counted over all texts. Two of them are near if one inserted, deleted or replaced code point makes one the other. Such
a pair is found by an inverted index of positional 2-grams. A word of L letters, with a mark before and behind it, has L + 1
grams; one edit spoils two of them at most, leaves the others in their order, and moves none by more than one place. So two
near words, the longer of L letters, share at least L - 1 grams at places that differ by 0 (equal lengths) or by 0 or 1.

The index is dealt out by file: the length and place of the shorter word, and a gram. Among the three grams of a word that are
rarest (by frequency, then by place) is always one that the edit has left, and the first such is the same one in both words.
So a word is filed under its three rarest grams, as a home at its own length and place, and as a probe among words one letter
shorter at its place and the one before. Within a file a task keeps the postings of the homes by gram and place; each
member's shortest postings are merged by a heap, homes that have enough grams in common pass the count filter, and the pair is
verified.

A file of more than ``FILE`` members is not compared but filed again, each member under the three rarest of its other grams,
and so on: what the edit left besides the grams used so far is bounded in the same way, so no pair is lost. It ends, for
when all but two of a word's grams are used, what can share a file is bounded by the alphabet. Frequencies of grams are the
only table that every task holds: 91 letters and marks give 8,281 grams at most.

Copies of a word never meet: words are distinct, with their number as a column. Null and empty texts have no words, a null
doc_id is read as the empty string, rows of one doc_id count each, very long texts are read in slices cut between words.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, doc_text, documents

MIN_LETTERS, MIN_COUNT = 5, 3
#: A near word is the form of another if it occurs so many times as often.
RATIO = 2
#: Edits in a run of a document are simulated where its checksum is a multiple of this.
EDIT_EVERY = 97
GRAM = 2
#: Members up to which a file is compared.
FILE = 4096
#: Code points of a text that are read at once, and words that a task counts before it passes them on.
SLICE, HELD = 1 << 20, 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def _slices(text: str) -> Iterator[str]:
    """The text, ASCII lower-cased, in slices of which none ends within a run of letters."""
    at = 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end]
        while end < len(text) and (part[-1].isascii() and part[-1].isalpha() or "À" <= part[-1] <= "ÿ"):
            part, end = text[at : end + SLICE // 16], end + SLICE // 16
        at += len(part)
        yield part.lower() if part.isascii() else part.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spelt(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Runs of letters of a text as they count, with their numbers: now and then one lacks a letter."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in _slices(text):
        for run, n in Counter(_RUN.findall(part)).items():
            h = zlib.crc32(run.encode(), head)
            if h % EDIT_EVERY == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            yield run, n


def words(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of all documents that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in spelt(doc_id, text.as_py()):
                    if len(word) >= MIN_LETTERS:
                        held[word] = held.get(word, 0) + n
                        if len(held) >= HELD:
                            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
                            held = {}
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return doc_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def grams(word: str) -> list[str]:
    """2-grams by place, with a mark before and behind the word."""
    marked = f"^{word}$"
    return [marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)]


def gram_ranks(found: DataFrame) -> dict[str, int]:
    """Every gram's place in the order of frequency, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for word in b.column(0).to_pylist():
                held.update(grams(word))
        yield pa.RecordBatch.from_pydict({"gram": list(held), "n": list(held.values())}, pa.schema([("gram", pa.string()), ("n", pa.int64())]))

    counts = found.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: i for i, r in enumerate(sorted(counts.collect(), key=lambda r: (r["n"], r["gram"])))}  # 8,281 rows at most


FILED = "word string, n long, probe boolean, home long, used array<long>, file string"


def file(found: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Members under the three rarest of those of their grams that are not used.

    found: word, n, probe, home (letters of the homes; null for words not filed yet, which become homes and probes), used
    (places of the grams used so far), file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("word", pa.string()), ("n", pa.int64()), ("probe", pa.bool_()), ("home", pa.int64()), ("used", pa.list_(pa.int64())), ("file", pa.string())])
        for b in batches:
            out: list[tuple] = []
            for word, n, probe, home, used, path in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = grams(word)
                rarest = sorted((rank[g], at) for at, g in enumerate(own) if at not in used)[: GRAM + 1]
                for _, at in rarest:
                    roles = [(probe, home)] if home is not None else [(False, len(word)), (True, len(word) - 1)]
                    for as_probe, letters in roles:
                        for place in (at, at - 1) if as_probe else (at,):
                            if 0 <= place <= letters:
                                out.append((word, n, as_probe, letters, [*used, at], f"{path or letters};{own[at]}{place}"))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(shape), shape, strict=True)], schema=shape)

    return found.mapInArrow(run, FILED)


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or a letter longer, is one edit from it."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return b[k + 1 :] == (a[k + 1 :] if len(a) == len(b) else a[k:]) and a != b


def near_in_file(members: list[tuple[str, bool, list[int]]]) -> Iterator[tuple[int, int]]:
    """Numbers of near members: one is a home, the other a home or a probe. members: word, whether a probe, places of used grams.

    As an edit spoils two grams at most, a near home is in one of any three postings: the shortest three are merged, and the
    grams in common with what they hold are counted.
    """
    postings: dict[tuple[str, int], list[int]] = {}
    held: dict[int, set[tuple[str, int]]] = {}
    get = postings.get
    for i in sorted(range(len(members)), key=lambda i: members[i][1]):  # homes first
        word, probe, used = members[i]
        own = [x for x in zip(grams(word), range(len(word) + 1), strict=True) if x[1] not in used]
        bound = len(word) - 1 - len(used)
        if held:
            met = _merged(own, probe, get) if bound > 0 else held
            mine = {*own, *((g, at - 1) for g, at in own)} if probe and met else set(own) if met else None
            for j in met:
                if len(mine & held[j]) >= bound and one_edit(members[j][0], word):
                    yield j, i
        if not probe:
            for x in own:
                if (hit := get(x)) is None:
                    postings[x] = [i]
                else:
                    hit.append(i)
            held[i] = set(own)


def _merged(own: list[tuple[str, int]], probe: bool, get) -> list[int]:
    """Homes in the shortest three of the postings of a member's grams, in order. A gram without postings is the shortest there is."""
    lists, most = [], GRAM + 1
    for g, at in own:
        hits = [hit for hit in ((get((g, at)), get((g, at - 1))) if probe else (get((g, at)),)) if hit]
        if hits:
            lists.append(hits)
        else:
            most -= 1
            if not most:
                return []
    lists.sort(key=lambda hits: len(hits[0]) if len(hits) == 1 else len(hits[0]) + len(hits[1]))
    some = [hit for hits in lists[:most] for hit in hits]
    return some[0] if len(some) == 1 else [j for j, _ in groupby(merge(*some))]


_MET = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64()), ("probe", pa.bool_()), ("home", pa.int64()), ("used", pa.list_(pa.int64())), ("file", pa.string())])


def _compared(most: int):
    """Near pairs of the files that come in order, and (near is null) the members of the files that are to be filed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, over = None, [], False
        out: list[tuple] = []

        def close() -> None:
            if not over and len(held) > 1 and not all(m[2] for m in held):
                for i, j in near_in_file([(m[0], m[2], m[4]) for m in held]):
                    (x, n), (y, k) = held[i][:2], held[j][:2]
                    out.extend([(x, n, y, k, None, None, None, None), (y, k, x, n, None, None, None, None)])

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(_MET), _MET, strict=True)], schema=_MET)
            out.clear()
            return made

        for b in batches:
            for m in zip(*[c.to_pylist() for c in b.columns], strict=True):  # word, n, probe, home, used, file
                if m[5] != at:
                    close()
                    at, held, over = m[5], [], False
                held.append(m)
                if over or len(held) > most and len(m[4]) < m[3] - 1:
                    over = True
                    out.extend((w, n, None, None, probe, home, used, name) for w, n, probe, home, used, name in held)
                    held = []
            yield batch()
        close()
        yield batch()

    return run


def near_words(found: DataFrame, most: int = FILE) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words one edit apart. found: distinct words, in a table that is cheap to read again."""
    rank = gram_ranks(found)
    todo = found.select("word", "n", F.lit(False).alias("probe"), F.lit(None).cast("long").alias("home"), F.array().cast("array<long>").alias("used"), F.lit(None).cast("string").alias("file"))
    pairs = None
    while True:
        met = cut(file(todo, rank).repartition("file").sortWithinPartitions("file").mapInArrow(_compared(most), FILED.replace("probe", "near string, near_n long, probe", 1)))
        got = met.where("near is not null").select("word", "n", "near", "near_n")
        pairs = got if pairs is None else pairs.unionAll(got)
        todo = met.where("near is null").select("word", "n", "probe", "home", "used", "file")
        if todo.isEmpty():
            return pairs.dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms (word, form) lead in the end. Pointers double each round; numbers of occurrences at least double from word to form, so rounds are few."""
    live = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = live.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(live.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(live)
        if step.where("moved").isEmpty():
            return step.drop("moved")
        live = cut(step.drop("moved"))
        discard(step)


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words."""
    found = cut(words(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    led = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    told = cut(found.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), led["near"].alias("form"), (-led["less"]).alias("form_n")))
    return told.join(roots(told.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir, "doc_id", "text"))
