import random

import pytest

from tidepool.llm import similar_sets


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])) > 0:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near_copies_of(rnd):
    """Originals, copies of them with words changed, a passage in many, and cases at exactly 4/5."""
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = " ".join(word() for _ in range(30))
    texts = []
    for i in range(30):
        words = [word() for _ in range(rnd.choice([3, 8, 40, 90]))]
        texts.append(" ".join(words) + (f" {passage}" if i % 2 else ""))
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words).title() + (f" {passage}" if i % 2 else ""))
    base = [word() for _ in range(12)]
    texts += [" ".join(base), " ".join([*base, word(), word()]), " ".join([*base, word(), word(), word()]), passage, passage + " more", None, "", " \n"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("sample, few, block", [(similar_sets.SAMPLE, similar_sets.FEW, similar_sets.BLOCK), (1, 0, 3), (1, 1000, 3)])
def test_components_equal_brute_force(spark, monkeypatch, sample, few, block):
    for name, value in (("SAMPLE", sample), ("FEW", few), ("SOME", few), ("BLOCK", block)):
        monkeypatch.setattr(similar_sets, name, value)
    texts = near_copies_of(random.Random(11))
    expected = classes([shingles(t) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar_sets.near_copies(df).collect()} == dict(enumerate(expected))
    assert 20 < len(set(expected)) < len(texts) - 20


def test_pipeline_drops_a_near_copy_that_simhash_keeps(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_simhash import fingerprint

    words = [f"w{i * i}" for i in range(100)]
    copy = [*words[:50], "x", *words[51:]]
    copy[20] = "y"
    texts = [" ".join(words), " ".join(copy), "something else altogether that stays"]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [0, 2]


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "A b c d"), (5, "a b c d"), (7, None)], "doc_id long, text string")
    rows = similar_sets.near_copies(df).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows) == [(False, 5), (False, 5), (False, 7), (True, 5)]
    assert similar_sets.near_copies(df.limit(0)).count() == 0
