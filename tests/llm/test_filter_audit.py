import itertools
import random

import numpy as np

from tidepool.llm import filter_audit


def test_plain_changes_visit_every_order_once_by_neighbours():
    order, seen = list("ABCDE"), ["ABCDE"]
    for at in filter_audit.plain_changes(5):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append("".join(order))
    assert sorted(seen) == sorted("".join(p) for p in itertools.permutations("ABCDE"))


def test_the_walk_equals_each_order_worked_out_alone():
    cell = np.random.default_rng(3).integers(0, 50, (4, 32, 3))
    orders, steps, shapley = filter_audit.walk(cell)
    total = np.zeros((4, 5), dtype=int)
    for o, got in zip(orders, steps, strict=True):
        gone = 0
        for i, f in enumerate(o):
            hit = [m for m in range(32) if m & gone == 0 and m >> f & 1]
            gone |= 1 << f
            assert (got[i, 1] == cell[:, hit].sum(axis=1)).all() and (got[i, 0] == cell[:, [m for m in range(32) if m & gone == 0]].sum(axis=1)).all()
            total[:, f] += cell[:, hit, 0].sum(axis=1)
    assert (total == shapley).all()


def brute(docs, labels):
    words = lambda t: [w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, source in docs:
        t, w = text or "", words(text)
        fails = (len(w) < 200) * "A" + (100 * len(set(w)) < 50 * len(w)) * "B" + (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) * "C" + any(c in "#$%&*|" for c in t) * "D"
        fails += any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs) * "E"
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for p in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(p):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                shapley[f] += len(hit)
                out[part, "".join(p), k + 1] = [len(left), len(hit), len(failing) - len(hit), sum(r[1] == f for r in failing), sum(r[2] for r in hit), sum(r[3] for r in hit), None]
        for (_, o, k), v in ((x, v) for x, v in out.items() if x[0] == part):
            v[6] = shapley[o[k - 1]]
    return out


def table(spark, docs, labels):
    d = spark.createDataFrame([(*x, "m", 5) for x in docs], "doc_id long, text string, source string, mask string, n int")
    return filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "g#m", "délta", "x", "CAPS", "y z"]
    docs = [(i, " ".join(rnd.choices(words[: rnd.randint(1, 7)], k=rnd.choice([0, 3, 190, 200, 230]))), rnd.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[i % 7][1], "c") for i in range(20)] + [(300, None, "a"), (301, "", None), (302, " \n\t ", "b"), (None, docs[0][1], "a"), (None, docs[0][1], "a"), (0, docs[0][1], "c"), (0, docs[0][1], "c")]
    docs += [(303, " ".join(f"w{i}" for i in range(60_000)), "long")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in table(spark, docs, labels).collect()}
    assert got == brute(docs, labels)


def test_empty_tables(spark):
    assert table(spark, [], []).count() == 0
    assert table(spark, [(1, "a", "s")], []).count() == 600
