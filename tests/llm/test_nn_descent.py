import numpy as np
import pytest

from tidepool.llm import nn_descent


def planted(rnd, n, groups, spread=0.1, dims=32):
    """n random directions, and groups of vectors around one direction each."""
    rows = [rnd.standard_normal((n, dims))]
    for size in groups:
        centre = rnd.standard_normal(dims)
        rows.append(centre / np.linalg.norm(centre) + spread / np.sqrt(dims) * rnd.standard_normal((size, dims)))
    x = np.concatenate(rows) * rnd.uniform(0.1, 9, (n + sum(groups), 1))
    return x[rnd.permutation(len(x))].astype(np.float32)


def brute(rows):
    """n_links and component_id of (vec_id, list or None) by comparing all."""
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for size in {len(v) for (_, v), o in zip(rows, ok, strict=True) if o}:
        at = [i for i, o in enumerate(ok) if o and len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in np.argwhere(np.triu(x @ x.T >= 0.95, 1)):
            n[at[i]] += 1
            n[at[j]] += 1
            root[find(at[i])] = find(at[j])
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(least.get(find(i), vec_id), vec_id)
    return sorted(((rows[i][0], n[i], least.get(find(i)) if n[i] else rows[i][0]) for i in range(len(rows))), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, id int").repartition(5)
    out = nn_descent.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def test_equals_brute_force_with_odd_rows(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(planted(rnd, 600, [2] * 20 + [3, 5, 9, 20, 70, 130]))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [None] + [1.0] * 31), (1004, [float("nan")] * 32), (1005, [float("inf")] + [1.0] * 31)]
    rows += [(1100 + i, rows[7][1]) for i in range(40)] + [(1200, rows[9][1]), (1200, rows[9][1]), (5, rows[11][1]), (None, rows[3][1])]
    rows += [(1300, [1.0, 2.0]), (1301, [1.0, 2.01]), (1302, [3e38, 6e38 / 2]), (1303, [1e-30, 2e-30])]
    assert got(spark, rows) == brute(rows)


def test_a_dense_group_with_outliers_is_counted_exactly(spark):
    """A group wider than the ball: some of its vectors link with only part of it."""
    rnd = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(planted(rnd, 100, [300], spread=0.19))]
    want = brute(rows)
    assert len({n for _, n, _ in want}) > 5
    assert got(spark, rows) == want


def test_recall_of_many_pairs(spark):
    rnd = np.random.default_rng(3)
    x = planted(rnd, 3000, [2] * 250, spread=0.17, dims=64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = {i: n for i, n, _ in brute(rows)}
    found = {i: n for i, n, _ in got(spark, rows)}
    assert sum(want.values()) > 400 and all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.97 * sum(want.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(4, [1.0, 0.0])], [(4, [1.0, 0.0]), (3, [1.0, 0.0])]])
def test_tiny_tables(spark, rows):
    assert got(spark, rows) == brute(rows)
