import random
import re
import zlib
from collections import Counter

import pytest

from tidepool.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by the definition."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(docs):
    words = counted(docs)
    form, out = {}, {}
    for w in words:
        them = sorted((-words[v], v) for v in words if near(w, v))
        form[w] = them[0][1] if them and -them[0][0] >= 2 * words[w] else None
        out[w] = [len(them)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], out[w][0], words[form[w]] if form[w] else None)
    return out


def got(spark, docs):
    df = spark.createDataFrame([(*x, "w", 1) for x in docs], "doc_id long, text string, word string, n int")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def corpus(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abcdéß", k=rnd.randint(4, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaa", "aaaaab", "baaaaa", "ababab", "bababa", "ababa"]
    texts = []
    for _ in range(250):
        some = []
        for _ in range(40):
            w = rnd.choice(stems[: rnd.randint(1, len(stems))])
            if rnd.random() < 0.4:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abZ") + w[k + 1 :]])
            some.append(w)
        texts.append(rnd.choice([" ", "-", "1"]).join(some))
    return [(i, t) for i, t in enumerate(texts)]


def test_variants_equal_brute_force(spark):
    docs = corpus(1) + [(None, "Straße straße STRASSE naïve Naïve naÏve"), (7, None), (8, ""), (9, "word " * 30_000 + "wordy " * 9), (9, "wordy"), (9, "× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷")]
    want = brute(docs)
    assert len(want) > 150 and any(f and w != r and f != r for w, (f, r, *_) in want.items())
    assert got(spark, docs) == want


@pytest.mark.parametrize("most", [1, 4, 30])
def test_files_over_the_bound_lose_no_pair(spark, most):
    words = sorted(counted(corpus(2)))
    found = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = {(r.word, r.near) for r in spelling.near_words(found, most).collect()}
    assert pairs == {(a, b) for a in words for b in words if near(a, b)}


def test_one_edit():
    rnd = random.Random(4)
    for _ in range(5000):
        a, b = ("".join(rnd.choices("ab", k=rnd.randint(3, 6))) for _ in range(2))
        if len(b) - len(a) in (0, 1):
            assert spelling.one_edit(a, b) == near(a, b)


def test_slices_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 16)
    text = "Alpha bétaBéta x1gamma " * 9 + "é" * 50
    joined = "".join(spelling._slices(text))
    assert joined == text.encode().lower().decode()
    assert [r for s in spelling._slices(text) for r in spelling._RUN.findall(s)] == spelling._RUN.findall(joined)


def test_empty_table(spark):
    assert got(spark, []) == {}
