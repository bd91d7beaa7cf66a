import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def texts():
    rnd = random.Random(12)
    words = ["the", "of", "a", "und", "é", "🙂", "#", "$5", "x|y", "\n", "\t", " ", "line\n", "\x0b"]
    out = ["".join(rnd.choice(words) + rnd.choice([" ", "", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    return [*out, None, "", " \n ", "a b c d e a b c d e", "same line\nsame line\nsame line", "x " * 3000, "n" * 50_000]


def test_base_counts_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in qr.measure(df).collect()}
    for i, t in enumerate(rows):
        want = brute(t) if len(t or "") < 40_000 else (1, 50_000, 0, 0, 0)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert qr.measure(df.limit(0)).count() == 0


def test_distance_of_histograms(spark):
    pairs = [((0.5, 0.5), (0.5, 0.5)), ((1.0, 0.0), (0.0, 1.0)), ((0.7, 0.3), (0.2, 0.8))]
    df = spark.createDataFrame([([{"p": a, "q": b} for a, b in zip(p, q, strict=True)],) for p, q in pairs], "pairs array<struct<p:double,q:double>>")
    got = [r["d"] for r in df.select(qr.divergence(F.col("pairs")).alias("d")).collect()]

    def distance(p, q):
        p, q = np.array(p), np.array(q)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.sqrt((np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))) / 2)

    assert np.allclose(got, [distance(*x) for x in pairs]) and np.allclose(got[:2], [0, 1])


def test_divergent_texts_go_and_plain_ones_stay(spark):
    rnd = random.Random(3)
    common = [w for w, n in qr.COMMON_WORDS["en"].items() for _ in range(n)]
    other = [f"{a}{b}ing" for a in ("walk", "talk", "read", "sing", "paint") for b in ("", "er", "ab", "on", "un")]
    plain = " ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(other) + rnd.choice(["", "", ".", ","]) for _ in range(300))
    keys = " ".join("".join(rnd.choice("!@#^~=+/\\{}[]0123456789") for _ in range(6)) for _ in range(300))
    rows = {r["doc_id"]: r["kept"] for r in qr.measure(spark.createDataFrame([(1, plain, "en"), (2, keys, "en")], "doc_id long, text string, lang string")).collect()}
    assert rows == {1: True, 2: False}
