import hashlib
import random

import numpy as np
import pytest

from tidepool.llm import order_minhash as om


def brute(text, omh):
    """A fingerprint from the definition, k-mer by k-mer."""
    words = (text or "").split()
    if not words:
        return np.zeros(len(omh.orders), dtype=np.uint16)
    h = [int(x) for x in omh.numbered(omh._words(text))]
    k = min(omh.k, len(words))
    kmers = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    numbered = [(m, kmers[:i].count(m)) for i, m in enumerate(kmers)]
    assert len(set(h)) == len(set(numbered)) == len(h)  # occurrence numbers tell all apart
    out = []
    for order in omh.orders:
        ranked = sorted(range(len(h)), key=lambda i: (h[i] * int(order)) % (1 << 64))[: omh.taken]
        v = 0x51ED270B
        for i in sorted(ranked):
            v = ((v ^ h[i]) * 0x9E3779B97F4A7C15) % (1 << 64)
            v ^= v >> 31
        out.append((v >> 40) & 0xFFFF | 1)
    return np.array(out, dtype=np.uint16)


def corpus():
    rnd = random.Random(6)
    return [(i * 2, " ".join(rnd.choice(["a", "b", "cé", "🙂", "delta"]) for _ in range(rnd.randint(0, 30)))) for i in range(70)] + [(900, None), (901, ""), (902, "x"), (903, "long word " * 2000)]


@pytest.mark.parametrize("n", [74, 1])
def test_compare_equals_brute_force(spark, n):
    rows = corpus()[:n]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, range int, to string").repartition(3)
    omh = om.OrderMinHash()
    got = {r["doc_id"]: r for r in om.compare(df).collect()}
    assert len(got) == len(rows)
    for k, (name, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = brute(text, omh) if len(text) < 999 else omh(text), omh(edited), omh(following)
        r = got[name]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.astype("<u2").tobytes().hex(), other.astype("<u2").tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (float((own == other).mean()), float((own == after).mean()))


def test_likeness_feels_moved_passages():
    rnd = random.Random(9)
    words = [f"w{rnd.randint(0, 500)}" for _ in range(300)]
    omh = om.OrderMinHash()
    base = omh(" ".join(words))
    one = omh(" ".join([*words[:150], "new", *words[151:]]))
    moved = omh(" ".join(words[150:] + words[:150]))
    other = omh(" ".join(f"v{i}" for i in range(300)))
    assert om.likeness(base, base) == 1.0 and om.likeness(base, one) > 0.85
    assert om.likeness(base, other) < 0.05 < om.likeness(base, moved) < om.likeness(base, one)


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, "e")], "doc_id long, text string")
    got = om.compare(df).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 1, 2]  # a null id comes first
    assert [r["edited_sha256"] for r in got if r["doc_id"] is None] == [hashlib.sha256(b"d").hexdigest()]
    assert om.compare(df.limit(0)).count() == 0
    assert om.fingerprints(df).count() == 5
