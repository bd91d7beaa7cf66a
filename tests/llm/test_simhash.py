import random

import pytest
import xxhash

from tidepool.llm import simhash


def fingerprint(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    """Smallest index reachable by steps of 2 bits or fewer."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_documents_equal_brute_force(spark):
    rnd = random.Random(2)
    words = ["Alpha", "beta", "gamma", "Zeta", "é", "ÀB", "x"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(120)] + [None, "", " \n\t ", "one", "one two", "A B C", "a b c", "a b c", "word " * 20_000]
    df = spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    values = [fingerprint(t) for t in texts]
    assert got == {i + 10: (f"{v:016x}", c + 10) for i, (v, c) in enumerate(zip(values, classes(values), strict=True))}


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_components_of_clustered_values(spark, block):
    rnd = random.Random(4)
    values = set()
    for _ in range(25):
        v = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):  # chains of one to three flipped bits
            values.add(v)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                v ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.links(fps, 2, block)[0]).collect()}
    expected = classes(values)
    seen = {}
    for s, c in zip(signed, expected, strict=True):
        seen.setdefault(roots.get(s, s), set()).add(c)
    assert all(len(c) == 1 for c in seen.values()) and len(seen) == len(set(expected))


def test_thresholds_sum_to_the_pigeonhole_bound():
    total, chosen = simhash.allocate([[1.0, 10.0, 50.0], [5.0, 6.0, 7.0], [2.0, 9.0, 40.0]], 2 - 3 + 1)
    assert sum(chosen) == 0 and total == min(1 + 5 + 2, 10 + 2, 10 + 5, 1 + 6, 6 + 2, 1 + 9, 9 + 5, 50, 7, 40)


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None)], "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows) == [(False, 5), (False, 5), (False, 7), (True, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
