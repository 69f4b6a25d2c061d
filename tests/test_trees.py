"""Level-wise trees against a plain recursive builder with the same draws."""

import hashlib
import math

import numpy as np
import pytest

from riskspark.operators import trees
from riskspark.plans.models import ModelSpec

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = np.stack([rng.normal(0, 1, 400), rng.integers(0, 4, 400), rng.integers(0, 60, 400), np.full(400, 3.0)], axis=1)
    y = ((x[:, 0] > 0.3) & (x[:, 1] > 1) | (rng.random(400) < 0.1)).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(400)]
    df = spark.createDataFrame([*rows, (990, None, 1.0, 1.0, 1.0, 1.0), (991, 1, None, 1.0, 1.0, 1.0)],
                               "id long, label int, a double, b double, c double, d double")
    return df, x, y


def plain_cuts(x):
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mids = (v[:-1] + v[1:]) / 2
        out.append(mids[np.linspace(0, len(mids) - 1, 20, dtype=int)] if len(mids) > 20 else mids)
    return out


def bag(i, t, seed):
    u = int(hashlib.md5(f"{seed}:bag:{t}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
    n, total = 0, math.exp(-1)
    while total <= u and n < 12:
        n += 1
        total += math.exp(-1) / math.factorial(n)
    return n


def plain_tree(x, y, counts, w, cuts, t, seed, depth, min_samples, m):
    """{node: (n, gini, value, feature, cut)}"""
    out = {}

    def gini(n0, n1):
        p = n1 * w[1] / (n0 * w[0] + n1 * w[1])
        return 1 - p * p - (1 - p) * (1 - p)

    def build(rows, node, d):
        n0, n1 = int(counts[rows][y[rows] == 0].sum()), int(counts[rows][y[rows] == 1].sum())
        zero, one = n0 * w[0], n1 * w[1]
        best = None
        if d < depth and n0 + n1 >= min_samples and n0 and n1:
            order = sorted(range(len(COLS)), key=lambda j: hashlib.md5(
                f"{seed}:features:{t}:{node}:{COLS[j]}".encode()).hexdigest())[:m]
            for j in order:
                for c in cuts[j]:
                    left = x[rows, j] <= c
                    l0, l1 = (int(counts[rows][left & (y[rows] == k)].sum()) for k in (0, 1))
                    r0, r1 = n0 - l0, n1 - l1
                    if l0 + l1 == 0 or r0 + r1 == 0:
                        continue
                    wl, wr = l0 * w[0] + l1 * w[1], r0 * w[0] + r1 * w[1]
                    cost = (wl * gini(l0, l1) + wr * gini(r0, r1)) / (wl + wr)
                    if best is None or cost < best[0] - 1e-13:
                        best = (cost, j, c, left)
        out[node] = (n0 + n1, gini(n0, n1) if n0 + n1 else 0.0, one / (zero + one) if n0 + n1 else 0.5,
                     COLS[best[1]] if best else None, best[2] if best else None)
        if best:
            build(rows[best[3]], 2 * node, d + 1)
            build(rows[~best[3]], 2 * node + 1, d + 1)

    build(np.flatnonzero(counts > 0), 1, 0)
    return out


@pytest.mark.parametrize("bootstrap", [True, False])
def test_forest_equals_the_plain_one(data, bootstrap):
    df, x, y = data
    forest = trees.grow_forest(df, COLS, "label", "id", n_trees=4, max_depth=4, min_samples=6, seed=3, bootstrap=bootstrap)
    cuts = plain_cuts(x)
    w = [len(y) / (2 * (y == k).sum()) for k in (0, 1)]
    value = np.zeros(len(y))
    for t in range(4):
        counts = np.array([bag(i, t, 3) if bootstrap else 1 for i in range(len(y))])
        want = plain_tree(x, y, counts, w, cuts, t, 3, 4, 6, 2)
        got = {n[1]: (n[3], n[5], n[6], n[7], n[8]) for n in forest.nodes if n[0] == t}
        assert set(got) == set(want)
        for node in want:
            assert got[node][0] == want[node][0] and got[node][3:] == want[node][3:], (t, node)
            assert got[node][1:3] == pytest.approx(want[node][1:3], abs=1e-12)
        for i in range(len(y)):
            node = 1
            while want[node][3]:
                node = 2 * node + int(x[i, COLS.index(want[node][3])] > want[node][4])
            value[i] += want[node][2] / 4
    got = {r["id"]: r["p"] for r in df.where("id < 400").select("id", forest.probability().alias("p")).collect()}
    assert all(got[i] == pytest.approx(value[i], abs=1e-12) for i in range(len(y)))


def test_importances_sum_to_one_and_find_the_signal(spark, data):
    df = data[0]
    forest = trees.grow_forest(df, COLS, "label", "id", n_trees=6, max_depth=4, seed=1)
    found = {r["feature"]: r["importance"] for r in trees.importances(forest.table(spark), COLS, "tree").collect()}
    assert sum(found.values()) == pytest.approx(1.0) and found["d"] == 0.0
    assert found["a"] + found["b"] > 0.7
    leaf = trees.grow_forest(df, COLS, "label", "id", n_trees=2, max_depth=0)
    assert {r["importance"] for r in trees.importances(leaf.table(spark), COLS, "tree").collect()} == {0.0}


def test_min_samples_and_empty_table(spark, data):
    df = data[0]
    forest = trees.grow_forest(df, COLS, "label", "id", n_trees=2, max_depth=6, min_samples=120, seed=1)
    parents = {(n[0], n[1]): n[3] for n in forest.nodes if n[7] is not None}
    assert parents and min(parents.values()) >= 120
    none = trees.grow_forest(df.where("id < 0"), COLS, "label", "id", n_trees=2, max_depth=3)
    assert [(n[1], n[3], n[6]) for n in none.nodes] == [(1, 0, 0.5)] * 2


def test_cut_points_follow_the_ranks(data):
    df, x, _ = data
    found = trees.cut_points(df.where("id < 400"), COLS)
    for c, want in zip(COLS, plain_cuts(x), strict=True):
        assert np.array_equal(found[c], want)


def test_model_spec_scores_in_a_bundle(spark, data, tmp_path):
    from riskspark.plans.training import prepare
    from riskspark.sources.bundle import Bundle
    df = data[0]
    prep = prepare(df, "label", "id", test_size=0.25, seed=2, use_smote=False)
    spec = ModelSpec("Forest", "rf_levels", {"cols": prep.feature_cols, "numTrees": 6, "maxDepth": 4})
    bundle = Bundle.from_prepared(prep, spec.fit(prep.train, "label", id_col="id"))
    bundle.save(str(tmp_path / "forest"))
    got = Bundle.load(spark, str(tmp_path / "forest")).score(df, "id").select("id", "label", "p").collect()
    assert {r["id"] for r in got if r["p"] is None} == {991}
    right = [(r["p"] >= 0.5) == (r["label"] == 1) for r in got if r["p"] is not None and r["label"] is not None]
    assert np.mean(right) > 0.8
