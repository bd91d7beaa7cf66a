import os

import numpy as np
import pytest

from tidepool.llm import quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    hit = np.asarray(labels) == 1
    return (rank[hit].sum() - hit.sum() * (hit.sum() + 1) / 2) / (hit.sum() * (~hit).sum())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no labelled tables here")
@pytest.mark.parametrize("name, label, least", [("op6_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.9)])
def test_held_out_rows(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(f"{label} is not null").select("score", "predicted", label).collect()
    assert len(rows) > 300 and all(0 <= r["score"] <= 1 for r in rows)
    value = auc([r["score"] for r in rows], [r[label] for r in rows])
    right = np.mean([r["predicted"] == r[label] for r in rows])
    print(name, "AUC", round(value, 4), "right", round(float(right), 4))
    assert value > least and right > 0.85


def test_follow_the_regularised_leader_separates():
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y = i % 2
        at = np.unique(np.concatenate([rnd.integers(0, 50, 10), rnd.integers(50 + 25 * y, 75 + 25 * y, 5)]))
        rows.append((at, np.ones(len(at)), y))
    w, bias = quality_classifier.ftrl(rows, size=128)
    assert np.mean([(w[at] @ x + bias > 0) == y for at, x, y in rows]) > 0.98
    assert (w == 0).any()  # the l1 term leaves slots out


def test_swapping_pulls_identity_terms_together():
    assert toxicity.counterfactual("nobody here") is None
    swapped = toxicity.counterfactual("Muslim women")
    assert swapped and "muslim" not in swapped.lower() and "women" not in swapped.split()
    rnd = np.random.default_rng(5)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):  # one group is named in most insults, another in none
        toxic = int(i % 3 == 0)
        words = [*rnd.choice(filler, 8), *(["awful"] if toxic else []), "gay" if toxic and i % 2 else "straight" if i % 5 == 0 else "day"]
        text = " ".join(words)
        twin = toxicity.counterfactual(text)
        rows.append((toxicity.features(text), None if twin is None else toxicity.features(twin), toxic))

    def gap(pairing):
        slots, w, _ = toxicity.fit_pairs(rows, pairing=pairing)
        of = dict(zip(slots.tolist(), w.tolist(), strict=True))
        z = [sum(of.get(s, 0.0) for s in toxicity.features(t)) for t in ("gay", "straight")]
        return abs(z[0] - z[1])

    assert gap(0.5) < 0.5 * gap(0.0)


def test_fit_is_the_optimum_of_the_whole_loss():
    """No step of any weight or of the bias lowers the loss of brute force over all slots; rare and long words count too."""
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(200):
        words = [f"w{k}" for k in rnd.integers(0, 40, 8)] + (["vile"] if (i % 3 == 0) != (i % 10 == 0) else []) + (["women"] if i % 5 == 0 else [])
        twin = toxicity.counterfactual(" ".join(words))
        rows.append((toxicity.features(" ".join(words)), None if twin is None else toxicity.features(twin), int(i % 3 == 0)))
    slots, w, bias = toxicity.fit_pairs(rows, steps=2000)
    every = sorted({s for a, b, _ in rows for x in (a, b if b is not None else a) for s in x.tolist()})
    weight = dict.fromkeys(every, 0.0) | dict(zip(slots.tolist(), w.tolist(), strict=True))

    def loss(weight, bias):
        z = [sum(weight[s] for s in a.tolist()) + bias for a, *_ in rows]
        fit = np.mean([np.log1p(np.exp(-v)) if y else np.log1p(np.exp(v)) for v, (*_, y) in zip(z, rows, strict=True)])
        gaps = sum((sum(weight[s] for s in a.tolist()) - sum(weight[s] for s in b.tolist())) ** 2 for a, b, _ in rows if b is not None)
        return fit + 0.5 * gaps / len(rows) + 4e-4 * sum(map(abs, weight.values()))

    best = loss(weight, bias)
    for s in every[::7]:
        for step in (-0.05, 0.05):
            assert loss(weight | {s: weight[s] + step}, bias) > best - 1e-5
    assert min(loss(weight, bias + 0.05), loss(weight, bias - 0.05)) > best - 1e-5
    assert not np.array_equal(toxicity.features("x" * 64 + "a"), toxicity.features("x" * 64 + "b"))


def brute_ftrl(rows, size, passes, alpha=0.3, beta=1.0, l1=0.02, l2=0.05):
    """The updates one coordinate at a time."""
    share = sum(y for *_, y in rows) / len(rows)
    z, n, bias, bias_n, order = [0.0] * size, [0.0] * size, np.log(share / (1 - share)), 1.0, np.random.default_rng(17)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = [weight(i) for i in at]
            error = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(w, x, strict=True)) + bias))) - y
            for i, v, own in zip(at, x, w, strict=True):
                g = error * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * own
                n[i] += g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    return np.array([weight(i) for i in range(size)]), bias


def test_updates_equal_brute_force():
    rnd = np.random.default_rng(4)
    rows = [(np.unique(rnd.integers(0, 30, 6)), None, int(i % 3 == 0)) for i in range(50)]
    rows = [(at, rnd.random(len(at)), y) for at, _, y in rows]
    w, bias = quality_classifier.ftrl(rows, size=32, passes=3)
    want, want_bias = brute_ftrl(rows, 32, 3)
    assert np.allclose(w, want) and np.isclose(bias, want_bias)


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_defined_cases(spark, module, label):
    docs = spark.createDataFrame([(i, t, 1.5, "z") for i, t in enumerate(["good text", None, "", "bad text", "bad text", "w " * 20_000])], "doc_id long, text string, score double, Label string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (4, None), (None, 1), (5, 1)], f"doc_id long, {label} int")
    for own in (labels, labels.limit(0), labels.where("doc_id = 3")):
        model = module.fit(docs, own, label)
        rows = module.score(docs, model, "mine").collect()
        assert len(rows) == 6 and rows[0].__fields__ == [*docs.columns, "mine"] and all(0 <= r["mine"] <= 1 for r in rows)
        assert all(r["score"] == 1.5 for r in rows)
    assert module.score(docs.limit(0), model).count() == 0
