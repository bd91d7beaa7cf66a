"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings (4 to 9 letters), hashed: insults inflect, and their
stems carry over to forms that training never saw. Where a training text names a group, a counterfactual twin is made by
swapping each identity term for another of the same kind, and fitting adds ``pairing * (score(text) - score(twin))**2``
to the logistic loss. Terms of one kind are so pulled to one weight, and as neutral mentions outnumber hostile ones, to a
small one.

Fitting reads a bounded sample of labelled rows (see quality_classifier.MAX_ROWS), whose features are made where the
texts are. One task minimises the l1-penalised loss by accelerated proximal steps over the slots that are not at zero; slots join
until none that is left out would move. One that at most l1 * n texts of either class have can't leave zero whatever the
other weights are (its gradient never exceeds the penalty), and is passed over.
Scoring sums the few weights other than zero whose slots a text has.

Nulls and empty texts have no features and score the bias. Rows whose label is null don't train; several labels of one
doc_id count as their maximum; with no labels or one class all texts score the base rate. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, doc_text, documents, held_out
from .quality_classifier import MAX_ROWS, labelled_sample

#: Identity terms by kind, in the four languages of the corpus; a term is swapped within its kind only.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender people"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("african", "american", "european", "mexican", "chinese", "indian", "german", "french", "spanish"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einheimische", "zuwanderer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
)
BITS = 22
_RUNS = re.compile(r"\w+|[^\w\s]+")
_KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _KIND), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def counterfactual(text: str) -> str | None:
    """text with its identity terms swapped within their kinds; None if it names no group."""
    found = 0

    def other(m: re.Match) -> str:
        nonlocal found
        found += 1
        kind = _KIND[m[1].lower()]
        step = 1 + xxhash.xxh32_intdigest(f"{m[1].lower()}:{found}".encode()) % (len(kind) - 1)
        return kind[(kind.index(m[1].lower()) + step) % len(kind)]

    swapped = _TERM.sub(other, text)
    return swapped if found else None


def word_slots(word: str) -> list[int]:
    """Slots of one white-space word: of each of its runs, and of the run's beginnings."""
    out = []
    for run in _RUNS.findall(word.lower()):
        for x in (run + "$", *(run[:k] for k in range(4, min(9, len(run)) + 1))):
            out.append(xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) >> (32 - BITS))
    return out


def features(text: str) -> np.ndarray:
    return np.array(sorted({s for w in set(text.split()) for s in word_slots(w)}), dtype=np.int64)


def fit_pairs(rows: list[tuple[np.ndarray, np.ndarray | None, int]], l1: float = 4e-4, pairing: float = 0.5, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights and the bias. rows: slots of the text, of its twin or None, label."""
    n, y = len(rows), np.array([r[2] for r in rows], dtype=float)
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    if not n or y.mean() in (0.0, 1.0):
        return *none, 0.0 if not n else float(np.log((y.mean() + 1e-2) / (1 - y.mean() + 1e-2)))
    size = 1 << BITS
    hit_n, other_n = (np.bincount(np.concatenate([r[0] for r in rows if r[2] == label]), minlength=size) for label in (1, 0))
    able = np.flatnonzero(np.maximum(hit_n, other_n) > l1 * n)
    swapped = [np.setxor1d(r[0], r[1]) for r in rows if r[1] is not None]
    slots = np.unique(np.concatenate([able, *swapped])) if swapped else able
    if not len(slots):
        return *none, float(np.log(y.mean() / (1 - y.mean())))
    place_of = np.full(size, -1, dtype=np.int32)
    place_of[slots] = np.arange(len(slots))

    def flat(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        got = [c[c >= 0] for c in (place_of[x] for x in of)]
        return np.concatenate(got), np.repeat(np.arange(len(got)), [len(c) for c in got])

    col, row = flat([r[0] for r in rows])
    pairs = [r for r in rows if r[1] is not None]
    pair_col, pair_row = (flat([r[0] for r in pairs]), flat([r[1] for r in pairs])) if pairs else (None, None)
    m, q = len(slots), len(pairs)

    def slope(w: np.ndarray, bias: float, own: tuple, paired: tuple | None, size: int) -> tuple[np.ndarray, float]:
        """Gradients of the smooth part of the loss: by slot, and of the bias."""
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(own[1], weights=w[own[0]], minlength=n) + bias, -35, 35)))
        g = np.bincount(own[0], weights=(p - y)[own[1]], minlength=size) / n
        if paired:
            (a, i), (b, j) = paired
            gap = np.bincount(i, weights=w[a], minlength=q) - np.bincount(j, weights=w[b], minlength=q)
            g += 2 * pairing * (np.bincount(a, weights=gap[i], minlength=size) - np.bincount(b, weights=gap[j], minlength=size)) / n
        return g, float((p - y).mean())

    def descend(live: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Accelerated proximal steps over the slots ``live``."""
        place = np.full(m, -1, dtype=np.int64)
        place[live] = np.arange(len(live))
        keep = lambda x: (place[x[0]][place[x[0]] >= 0], x[1][place[x[0]] >= 0])
        own, paired, k = keep((col, row)), (keep(pair_col), keep(pair_row)) if pairs else None, len(live)
        bound = (0.25 * np.bincount(own[0], minlength=k) + 1) / n  # curvature along one slot
        if paired:
            bound += 2 * pairing * (np.bincount(paired[0][0], minlength=k) + np.bincount(paired[1][0], minlength=k)) / n
        bound = np.maximum(bound, 4 / n) * 8
        x, t = w[live], 1.0
        ahead = x.copy()
        for _ in range(steps):
            g, shift = slope(ahead, bias, own, paired, k)
            u = ahead - g / bound
            new = np.sign(u) * np.maximum(np.abs(u) - l1 / bound, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, x, t = new + (t - 1) / after * 0.9 * (new - x), new, after
            bias -= 2 * shift
        out = np.zeros(m)
        out[live] = x
        return out, bias

    # slots join for as long as some slot that is left at zero would move: at the end none would, as if all had been there from the start
    w, bias, live = np.zeros(m), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(m, dtype=bool)
    for _ in range(20):
        g, _ = slope(w, bias, (col, row), (pair_col, pair_row) if pairs else None, m)
        moved = (np.abs(g) > l1 * 1.001) & ~live
        if not moved.any():
            break
        live |= moved
        w, bias = descend(np.flatnonzero(live), w, bias)
    return slots[w != 0], w[w != 0], bias


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        twins = [counterfactual(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "slot": [features(t).astype("<i4").tobytes() for t in b["text"]], "twin": [None if t is None else features(t).astype("<i4").tobytes() for t in twins], "label": b["label"]})


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.doc_id)
    slots, w, bias = fit_pairs([(np.frombuffer(r.slot, "<i4"), np.frombuffer(r.twin, "<i4") if isinstance(r.twin, bytes) else None, int(r.label)) for r in rows])
    yield pd.DataFrame({"slots": [slots.astype("<i4").tobytes()], "w": [w.astype("<f4").tobytes()], "bias": [bias]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[dict[int, float], float]:
    """Weights by slot, and the bias."""
    made = labelled_sample(docs, labels, label, max_rows).mapInPandas(_featurise, "doc_id long, slot binary, twin binary, label int").repartition(1)
    got = made.mapInPandas(_fit, "slots binary, w binary, bias double").collect()
    if not got:
        return {}, 0.0
    return dict(zip(np.frombuffer(got[0]["slots"], "<i4").tolist(), np.frombuffer(got[0]["w"], "<f4").tolist(), strict=True)), got[0]["bias"]


def score(docs: DataFrame, model: tuple[dict[int, float], float], into: str = "score") -> DataFrame:
    """docs with a column ``into``, in place of one of that name if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, bias = shared.value
        known: dict[str, tuple[int, ...]] = {}  # words to those of their slots that count

        def one(texts: list[str | None]) -> list[pa.Array]:
            z = np.empty(len(texts))
            for i, text in enumerate(texts):
                found: set[int] = set()
                for word in set((text or "").split()):
                    own = known.get(word)
                    if own is None:
                        own = tuple(s for s in word_slots(word) if s in weights)
                        if len(known) >= 300_000:
                            known.clear()
                        if len(word) <= 40:
                            known[word] = own
                    if own:
                        found.update(own)
                z[i] = sum(weights[s] for s in sorted(found)) + bias
            return [pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))]

        return one

    return add_columns(docs.drop(into), ["text"], f"`{into}` double", make)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(doc_text(docs), model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
