import hashlib
import random

import numpy as np
import pytest

from tidepool.llm import suffix_dedup as sd


def brute(rows):
    """The contract, string by string."""
    out = {}
    for name, text in rows:
        raw = (text or "").encode()
        before = {b[i : i + sd.WIDTH] for other, t in rows if other < name for b in [(t or "").encode()] for i in range(len(b) - sd.WIDTH + 1)}
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - sd.WIDTH + 1):
            if raw[i : i + sd.WIDTH] in before:
                gone[i : i + sd.WIDTH] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[name] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("ab é🙂xyz") for _ in range(rnd.randint(45, 90))) for _ in range(6)] + ["a" * 120, "ab" * 70]
    rows = []
    for i in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80))) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(500, None), (501, ""), (502, rows[7][1]), (503, rows[7][1]), (504, "a" * 5000), (505, "a" * 49), (506, "a" * 50)]
    return rows


@pytest.mark.parametrize("hot", [sd.HOT, 200])
def test_digests_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.digests(df).collect()}
    assert got == brute(rows)


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(1)
    for letters, n in ((2, 300), (4, 500), (1, 100), (200, 400)):
        t = rnd.integers(0, letters, n).astype(np.uint8)
        raw = t.tobytes()
        order = sd.suffix_array(t)
        assert sorted(order.tolist()) == list(range(n))
        keys = [raw[i : i + sd.WIDTH] for i in order]
        assert keys == sorted(keys)
        prefix = sd.common_prefixes(t, order)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((j for j in range(min(len(a), len(b), sd.WIDTH)) if a[j] != b[j]), min(len(a), len(b), sd.WIDTH))
            assert min(prefix[k], len(a), len(b)) == same


def test_defined_cases(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away into the woods " * 3
    df = spark.createDataFrame([(1, long, "x", 7), (1, long, "y", 8), (None, long, "z", 9), (2, long + "é", "w", 1), (3, None, "v", 2)], "doc_id long, text string, _at string, tkey int")
    rows = sd.deduplicate(df).collect()
    assert [f for f in rows[0].__fields__] == df.columns and len(rows) == 5
    by = {r["_at"]: r for r in rows}
    assert by["x"]["text"] == by["y"]["text"] == by["z"]["text"] == long  # equal ids don't remove from each other; a null id takes no part
    assert by["w"]["text"] == "é" and by["w"]["tkey"] == 1
    assert sd.digests(df.limit(0)).count() == 0 and sd.deduplicate(df.limit(0)).count() == 0


def test_only_suffixes_that_strings_start_at_are_sorted(monkeypatch):
    """Four fifths of the bytes of short runs are tails of strings: they are not sorted."""
    rnd = random.Random(3)
    source = [bytes(rnd.choice(b"aab ") for _ in range(400)) for _ in range(3)]
    starts = [(rnd.choice(source), rnd.randint(0, 330), rnd.randint(1, 12)) for _ in range(200)]
    strings = sorted({x[a : a + sd.WIDTH - 1 + n] for x, a, n in starts} | {b"a" * 70, b"a" * 55})
    owners = np.array([rnd.randint(0, 50) for _ in strings])
    sorted_directly, seen = sd._sorted_directly, []
    monkeypatch.setattr(sd, "_sorted_directly", lambda t, at, depth: seen.append(len(at)) or sorted_directly(t, at, depth))
    run, first, upto, least = sd.least_owners(strings, owners)
    n = [len(s) - sd.WIDTH + 1 for s in strings]
    assert sum(seen) <= sum(n) + len(strings)
    want: dict[bytes, int] = {}
    for s, owner, k in zip(strings, owners.tolist(), n, strict=True):
        for i in range(k):
            want[s[i : i + sd.WIDTH]] = min(owner, want.get(s[i : i + sd.WIDTH], owner))
    got = {(r, i): v for r, a, b, v in zip(run.tolist(), first.tolist(), upto.tolist(), least.tolist(), strict=True) for i in range(a, b)}
    assert got == {(r, i): want[s[i : i + sd.WIDTH]] for r, s in enumerate(strings) for i in range(n[r])}


def test_texts_side_by_side_have_the_runs_of_each():
    texts = [(text or "").encode() for _, text in corpus()]
    texts = [t for t in texts if len(t) >= sd.WIDTH]
    h, text, start, n = sd.runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    begins = np.cumsum([0, *map(len, texts)])
    got = sorted(zip(text.tolist(), (start - begins[text]).tolist(), n.tolist(), h.tolist(), strict=True))
    alone = [(k, a, m, x) for k, t in enumerate(texts) for x, _, a, m in zip(*(v.tolist() for v in sd.runs(np.frombuffer(t, np.uint8), np.array([0, len(t)]))), strict=True)]
    assert got == sorted(alone) and sum(n) == sum(len(t) - sd.WIDTH + 1 for t in texts)


def test_any_number_of_parts_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "PART", 700)
    monkeypatch.setattr(sd, "HELD", 50)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.digests(df).collect()}
    assert got == brute(rows)
