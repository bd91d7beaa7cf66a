import math
import random
import tracemalloc
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.llm import hmm_lm
from tidepool.llm.common import held_out


def small_model():
    rnd = np.random.default_rng(3)
    start, moves, emits = rnd.random(3), rnd.random((3, 3)), rnd.random((5, 3))
    return hmm_lm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def paths(m, seq):
    """Probability of each path of states with the sequence."""
    for p in product(range(3), repeat=len(seq)):
        v = m.start[p[0]] * m.emits[seq[0], p[0]]
        for t in range(1, len(seq)):
            v *= m.moves[p[t - 1], p[t]] * m.emits[seq[t], p[t]]
        yield p, v


def test_forward_is_the_sum_over_paths():
    m, docs = small_model(), [np.array([0, 3, 1, 4]), np.array([2]), np.array([1, 1, 1, 1, 1, 0])]
    assert np.allclose(m.score(docs), [math.log10(sum(v for _, v in paths(m, d))) for d in docs])


def test_expected_counts_are_those_over_paths():
    m, docs = small_model(), [[0, 3, 1, 4], [2], [1, 1, 0]]
    out = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    log_likelihood, _ = m.expect(hmm_lm.Sequences([np.array(d) for d in docs]), out)
    starts, moves, emits, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for d in docs:
        z = sum(v for _, v in paths(m, d))
        total += math.log(z)
        for p, v in paths(m, d):
            starts[p[0]] += v / z
            for t, s in enumerate(d):
                emits[s, p[t]] += v / z
                if t:
                    moves[p[t - 1], p[t]] += v / z
    assert np.isclose(log_likelihood, total)
    for got, want in zip(out, (starts, moves, emits), strict=True):
        assert np.allclose(got, want)


def corpus():
    rnd = random.Random(11)
    common = [f"w{i}" for i in range(40)]
    return [(i, " ".join([rnd.choice(common) if rnd.random() < 0.9 else f"Rare{rnd.randint(0, 300)}é" for _ in range(rnd.randint(0, 40))])) for i in range(200)] + [(900, None), (901, ""), (902, "unseen1 unseen2 w1 W2"), (910, "w3 " * 30_000)]


@pytest.mark.parametrize("dictionary", [1 << 15, 25])
def test_base_scores_equal_brute_force(spark, dictionary):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    trains = {r["doc_id"] for r in df.where(~held_out(F.col("doc_id"), 10, 0)).collect()}
    words = {i: (t or "").lower().split() for i, t in rows}
    c = Counter(w for i in trains for w in words[i])
    end, n, v = len(trains), sum(c.values()) + len(trains), len(c) + 1
    got = {r["doc_id"]: r for r in hmm_lm.train_and_score(df, ~held_out(df["doc_id"], 10, 0), states=3, dictionary=dictionary, rounds=2).collect()}
    assert len(got) == len(rows)
    for i, own in words.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own) + math.log10((end + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["trains"]) == (len(own) + 1, sum(w in c for w in own) + 1, n, i in trains)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_learning_beats_the_unigram_model(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):  # words go by topic, so that states help
        topic = [f"{'abcd'[i % 4]}{k}" for k in range(12)]
        rows.append((i, " ".join(rnd.choice(topic) for _ in range(40))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in hmm_lm.train_and_score(df, ~held_out(df["doc_id"], 10, 0)).collect() if not r["trains"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.75


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert hmm_lm.train_and_score(df, F.lit(False)).count() == 2
    assert hmm_lm.train_and_score(df.limit(0), F.lit(True)).count() == 0


def brute_baum_welch(docs, shares, states, rounds, rare):
    """One document after another, one token after another."""
    m, tails = hmm_lm.Model.first(shares, states), None
    for _ in range(rounds):
        starts, moves, emits, tails = np.ones(states), np.ones((states, states)), hmm_lm.PRIOR * shares[:, None] * np.ones(states), {}
        for seq, words in docs:
            alpha, beta = np.zeros((len(seq), states)), np.ones((len(seq), states))
            for t, x in enumerate(seq):
                alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.moves) * m.emits[x]
            for t in range(len(seq) - 2, -1, -1):
                beta[t] = m.moves @ (m.emits[seq[t + 1]] * beta[t + 1])
            z, left = alpha[-1].sum(), list(words)
            starts = starts + alpha[0] * beta[0] / z
            for t, x in enumerate(seq):
                own = alpha[t] * beta[t] / z
                emits[x] += own
                if x == rare:
                    w = left.pop(0)
                    tails[w] = tails.get(w, 0) + own
                if t:
                    moves = moves + np.outer(alpha[t - 1], m.emits[x] * beta[t]) * m.moves / z
        m = hmm_lm.Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return m, tails


def test_training_and_scores_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") if rnd.random() < 0.8 else f"r{rnd.randint(0, 30)}" for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    training, states = F.col("doc_id") % 5 != 0, 3
    got = {r["doc_id"]: r["score"] for r in hmm_lm.train_and_score(df, training, states=states, dictionary=9, rounds=3).collect()}
    words = {i: t.split() for i, t in rows}
    c = Counter(w for i in words for w in words[i] if i % 5)
    ends = sum(1 for i in words if i % 5)
    top = sorted((w for w in c if len(w) == 1), key=lambda w: (-c[w], w))
    assert len(top) == 8 and min(c[w] for w in top) > 2 * max(c[w] for w in c if len(w) > 1)
    number, rare, end = {w: i for i, w in enumerate(top)}, 8, 9
    beyond = {w: k for w, k in c.items() if w not in number}
    shares = np.array([*(c[w] for w in top), sum(beyond.values()), ends], dtype=float) + 0.1
    encode = lambda own: ([*(number.get(w, rare) for w in own), end], [w for w in own if w not in number])
    m, tails = brute_baum_welch([encode(words[i]) for i in words if i % 5], shares / shares.sum(), states, 3, rare)
    share = {w: np.round(255 * v / v.sum()) / np.round(255 * v / v.sum()).sum() * beyond[w] for w, v in tails.items()}  # kept in 8 bits
    total, floor = sum(share.values()), sum(beyond.values()) + 0.1 * (len(beyond) + 1)
    for i, own in words.items():
        a = None
        for w in [*own, None]:
            e = m.emits[end if w is None else number.get(w, rare)]
            if w is not None and w not in number:
                e = e * (0.5 * share.get(w, 0) / total + 0.5 * (c.get(w, 0) + 0.1) / floor)
            a = (m.start if a is None else a @ m.moves) * e
        assert math.isclose(got[i], math.log10(a.sum()), rel_tol=3e-4), i


def test_likelihood_rises_from_round_to_round(spark):
    df = spark.createDataFrame([(bytes(np.array([*[x % 5] * 20, 6], dtype="<u2").tobytes()), None) for x in range(60)], "ids binary, tail string")
    model, beyond = hmm_lm.baum_welch(df, np.full(7, 1 / 7), 3, 5)
    assert len(model.log_likelihood) == 5 and list(model.log_likelihood) == sorted(model.log_likelihood) and beyond.count() == 0


def test_words_of_odd_texts():
    odd = ["", " ", "a", " A\tb\n\n c\x0bD\x0c\re ", "É x y\x1cz\x85q", "\x00 a\x00b", "ÀA Àa", "x" * 50, "a b", "　 a", "  B"]
    for texts in (pa.array(odd), pa.array(odd * 3).slice(7, 15), pa.array(["", " "]), pa.array([], pa.string())):
        words, n = hmm_lm.words_of(texts)
        want = [t.encode().lower().split() for t in texts.to_pylist()]
        assert [w.encode() for w in words.to_pylist()] == [w for own in want for w in own] and n.tolist() == [len(own) for own in want]


def test_pieces_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(hmm_lm, "PIECE", 10)
    for texts in (["", "abc", "x" * 35, "", "de" * 4, "f", ""], ["x" * 40], [""], []):
        got = [p.column("text").to_pylist() for p in hmm_lm.pieces(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text")]
        assert [t for p in got for t in p] == texts and all(got) and all(sum(map(len, p[1:])) < 10 for p in got)


def test_expectation_works_in_memory_that_it_has():
    rnd = np.random.default_rng(5)
    docs = [rnd.integers(0, 50, n).astype("<u2") for n in rnd.integers(1, 3000, 200)]
    seqs, m, room = hmm_lm.Sequences(docs), hmm_lm.Model.first(np.full(50, 1 / 50), 8), hmm_lm.Room()
    new = lambda: (np.zeros(8), np.zeros((8, 8)), np.zeros((50, 8)))
    once, again, alone = new(), new(), new()
    first = m.expect(seqs, once, np.float32, room)[0]
    short = m.expect(hmm_lm.Sequences(docs[:3]), new(), np.float32, room)[1]
    assert len(short) == sum(map(len, docs[:3])) and np.allclose(short.sum(axis=1), 1)
    assert m.expect(seqs, again, np.float32, room)[0] == first == m.expect(seqs, alone, np.float32)[0]
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(once, again, alone, strict=True))
    tracemalloc.start()
    m.expect(seqs, new(), np.float32, room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(seqs.x)  # three arrays of eight single floats a token would be 96 bytes


def test_words_beyond_the_dictionary_are_joined_without_a_sort(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hmm_lm.train_and_score(df, ~held_out(df["doc_id"], 10, 0), states=3, dictionary=25, rounds=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "ShuffledHashJoin [word" in plan and "SortMergeJoin [word" not in plan


def test_only_the_last_round_reads_the_tails(spark, monkeypatch):
    read = []
    whole = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *rest, **more: read.append(df.columns) or whole(df, *rest, **more))
    df = spark.createDataFrame([(bytes(np.array([0, 1, 2], dtype="<u2").tobytes()), "w") for _ in range(5)], "ids binary, tail string")
    _, beyond = hmm_lm.baum_welch(df, np.full(3, 1 / 3), 2, 3)
    assert read == [["ids"], ["ids"], ["ids", "tail"]] and [(r["word"], r["n"]) for r in beyond.collect()] == [("w", 5)]
