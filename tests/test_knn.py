import numpy as np
import pytest

from pyspark.sql import functions as F

from riskspark.operators.knn import knn_classify, knn_join, self_knn


def brute(q, b, qid, bid, k, exclude_self):
    out = {}
    for i, x in enumerate(q):
        d2 = np.zeros(len(b))
        for j in range(b.shape[1]):
            d2 = d2 + (x[j] - b[:, j]) * (x[j] - b[:, j])
        cand = [(d2[t], bid[t]) for t in range(len(b)) if not (exclude_self and bid[t] == qid[i])]
        out[qid[i]] = [t[1] for t in sorted(cand)[:k]]
    return out


def _frame(spark, x, ids, label=None):
    rows = [(int(i), [float(v) for v in row]) + ((int(label[n]),) if label is not None else ())
            for n, (i, row) in enumerate(zip(ids, x))]
    schema = "id long, features array<double>" + (", label int" if label is not None else "")
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_exact_with_duplicates_and_hot_cell(spark, exclude_self):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (120, 6)), np.zeros((70, 6)), rng.integers(0, 3, (40, 6))]).astype(float)
    ids = np.arange(230) * 7 + 3
    df = _frame(spark, x, ids)
    # tiny chunks and query blocks force the salted paths; few pivots force big cells
    out = knn_join(df, df, 4, exclude_self=exclude_self, max_pivots=5, chunk_rows=16, query_block_rows=8).toPandas()
    ref = brute(x, x, ids, ids, 4, exclude_self)
    got = {q: list(g.sort_values("rank")["nb_id"]) for q, g in out.groupby("q_id")}
    assert got == ref


def test_knn_queries_vs_other_base(spark):
    rng = np.random.default_rng(6)
    b, q = rng.normal(0, 1, (300, 3)), rng.normal(0, 2, (40, 3))
    out = knn_join(_frame(spark, q, np.arange(40)), _frame(spark, b, np.arange(300) + 10_000), 5).toPandas()
    ref = brute(q, b, np.arange(40), np.arange(300) + 10_000, 5, False)
    assert {k: list(g.sort_values("rank")["nb_id"]) for k, g in out.groupby("q_id")} == ref


def test_self_knn_k_larger_than_rows(spark):
    df = _frame(spark, np.array([[0.0], [1.0], [3.0]]), [1, 2, 3])
    out = self_knn(df, 5).toPandas()
    assert len(out) == 6  # each row gets its 2 others


def test_knn_classify_weights(spark):
    x = np.array([[0.0], [1.0], [2.0], [10.0]])
    y = np.array([1, 0, 0, 0])
    df = _frame(spark, x, [1, 2, 3, 4], y)
    q = _frame(spark, np.array([[0.5]]), [99])
    p = knn_classify(q, df, k=2, balanced=True).first()["p"]
    w1 = 1 / (0.5 + 1e-8) * (4 / (2 * 1))
    w0 = 1 / (0.5 + 1e-8) * (4 / (2 * 3))
    assert p == pytest.approx(w1 / (w1 + w0 + 1e-8))


def test_rows_without_a_vector_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None), (4, [5.0]), (5, [float("nan")]), (6, [None])],
                               "id long, features array<double>")
    rows = self_knn(df, 1).collect()
    assert {r.q_id: r.nb_id for r in rows} == {1: 2, 2: 1, 4: 2, 3: None, 5: None, 6: None} and len(rows) == 6
    assert all(r["rank"] is None and r.dist is None for r in rows if r.nb_id is None)


def test_knn_empty_base(spark):
    q = spark.createDataFrame([(1, [0.0])], "id long, features array<double>")
    b = spark.createDataFrame([], "id long, features array<double>")
    assert [tuple(r) for r in knn_join(q, b, 3).collect()] == [(1, None, None, None)]


def test_knn_hot_query_vector_is_salted(spark, monkeypatch):
    monkeypatch.setattr("riskspark.operators.knn.SALT_ROWS", 5)
    rng = np.random.default_rng(7)
    b, q = rng.integers(0, 4, (60, 2)).astype(float), np.vstack([np.ones((37, 2)), rng.normal(0, 1, (9, 2))])
    out = knn_join(_frame(spark, q, np.arange(46)), _frame(spark, b, np.arange(60)), 3, chunk_rows=8).toPandas()
    ref = brute(q, b, np.arange(46), np.arange(60), 3, False)
    assert {k: list(g.sort_values("rank")["nb_id"]) for k, g in out.groupby("q_id")} == ref


def _pairs(out):
    return {q: list(g.sort_values("rank")["nb_id"]) for q, g in out.dropna(subset=["rank"]).groupby("q_id")}


@pytest.mark.parametrize("tiles", [{}, {"max_pivots": 5, "chunk_rows": 16, "query_block_rows": 8}])
def test_within_and_unlike(spark, tiles):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (150, 3)), np.zeros((40, 3)), rng.integers(0, 3, (50, 3))]).astype(float)
    klass, fold = rng.integers(0, 4, 240), rng.integers(0, 3, 240)
    klass[0] = 9  # alone in its class
    rows = [(i, x[i].tolist(), f"k{klass[i]}" if klass[i] != 3 else None, None if i % 11 == 0 else int(fold[i]))
            for i in range(240)]
    df = spark.createDataFrame(rows, "id long, features array<double>, klass string, fold int")

    def brute(allowed):
        out = {}
        for i in range(240):
            d2 = ((x - x[i]) ** 2)
            d2 = (d2[:, 0] + d2[:, 1]) + d2[:, 2]
            near = sorted((d2[j], j) for j in range(240) if j != i and allowed(i, j))[:4]
            if near:
                out[i] = [j for _, j in near]
        return out

    same = knn_join(df, df, 4, exclude_self=True, within="klass", **tiles).toPandas()
    assert _pairs(same) == brute(lambda i, j: klass[i] == klass[j])
    assert same[same["q_id"] == 0]["nb_id"].isna().all() and len(same[same["q_id"] == 0]) == 1
    other = knn_join(df, df, 4, exclude_self=True, unlike="fold", **tiles).toPandas()
    assert _pairs(other) == brute(lambda i, j: i % 11 == 0 or j % 11 == 0 or fold[i] != fold[j])
    base = df.where("id < 120")
    both = knn_join(df, base, 4, exclude_self=True, within="klass", unlike="fold", **tiles).toPandas()
    assert _pairs(both) == brute(lambda i, j: j < 120 and klass[i] == klass[j]
                                 and (i % 11 == 0 or j % 11 == 0 or fold[i] != fold[j]))


def test_classify_all_folds_at_once(spark):
    rng = np.random.default_rng(2)
    x, y, fold = rng.normal(0, 1, (90, 2)), rng.integers(0, 2, 90), np.arange(90) % 3
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(90)],
                               "id long, features array<double>, label int, fold int")
    got = {r["id"]: r["p"] for r in knn_classify(df, df, 3, unlike="fold", folds=3).collect()}
    for f in range(3):
        one = knn_classify(df.where(f"fold = {f}"), df.where(f"fold <> {f}"), 3).collect()
        assert all(got[r["id"]] == pytest.approx(r["p"], abs=1e-12) for r in one) and len(one) == 30


def _clusters(spark, n, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(0, 1, (n, dim))
    return _frame(spark, x, np.arange(n))


def test_approximate_recall_and_exact_distances(spark):
    from riskspark.operators.knn_approx import approx_knn_join, recall
    df = _clusters(spark, 4000)
    exact = knn_join(df, df, 10, exclude_self=True)
    found = approx_knn_join(df, df, 10, exclude_self=True)
    assert recall(found, exact).first()["recall"] >= 0.9
    pdf, ref = found.toPandas(), exact.toPandas()
    dist = {(r.q_id, r.nb_id): r.dist for r in ref.itertuples()}
    assert all(dist[r.q_id, r.nb_id] == r.dist for r in pdf.itertuples() if (r.q_id, r.nb_id) in dist)
    assert pdf.groupby("q_id")["dist"].apply(lambda d: d.is_monotonic_increasing).all()


def test_approximate_ships_rows_in_proportion(spark):
    """Every base row is in one bucket a table, every query in at most ``probes``; buckets keep their size."""
    from riskspark.operators import knn_approx as A
    shipped, largest = [], []
    for n in (2000, 8000):
        df = _clusters(spark, n).selectExpr("id", "features", "0L as _key", "0L as _fold")
        x = np.array([r["features"] for r in df.collect()])
        tables = A.Tables(x[:A.SAMPLE], n, 4, 128, 1)
        base = A._placed(df, tables, 4, "id", "features", 1)
        asked = A._placed(df, tables, 4, "id", "features", 8)
        assert base.count() == 4 * n
        shipped.append(asked.count() / n)
        sizes = base.groupBy("_bucket").count().toPandas()["count"]
        largest.append((sizes ** 2).sum() / sizes.sum())  # rows in the bucket of a row, on average
    assert max(shipped) <= 32 and largest[1] < 2.5 * largest[0]


def test_approximate_hot_vectors_missing_and_keys(spark):
    from riskspark.operators.knn_approx import approx_knn_join
    rng = np.random.default_rng(6)
    x = np.vstack([np.ones((300, 2)), rng.normal(0, 1, (200, 2))])
    df = _frame(spark, x, np.arange(500)).selectExpr("id", "IF(id = 450, NULL, features) AS features", "id % 2 AS k")
    out = approx_knn_join(df, df, 3, exclude_self=True, within="k", tables=6, probes=8, leaf_rows=50).toPandas()
    assert set(out["q_id"]) == set(range(500)) and out[out["q_id"] == 450]["nb_id"].isna().all()
    met = out.dropna(subset=["nb_id"])
    assert (met["q_id"] % 2 == met["nb_id"] % 2).all() and (met["q_id"] != met["nb_id"]).all()
    assert (met[met["q_id"] < 300]["dist"] == 0).all()


def test_asked_rows_meet_all_rows(spark):
    df = _frame(spark, np.random.default_rng(8).normal(size=(90, 24)), np.arange(90))
    every = {tuple(r) for r in self_knn(df, 3).where("q_id % 20 = 0").collect()}
    assert {tuple(r) for r in self_knn(df, 3, asked=F.expr("id % 20 = 0")).collect()} == every and len(every) == 15


@pytest.mark.parametrize("shift,dims", [(0.0, 40), (1e6, 40), (0.0, 5)])
def test_nearest_agrees_with_plain_sums(shift, dims):
    from riskspark.operators.knn import NO_FOLD, _nearest, _squared
    rng = np.random.default_rng(9)
    y = np.repeat(rng.normal(size=(60, dims)), 2, axis=0) + shift  # every distance is there twice
    x, ids = rng.normal(size=(30, dims)) + shift, rng.permutation(120)
    folds = np.full(120, NO_FOLD)
    r, c, d = _nearest(x, y, ids, 5, np.full(30, np.inf), folds[:30], folds)
    d2 = _squared(x, y)
    want = [(i, int(ids[j]), d2[i, j]) for i in range(30) for j in sorted(range(120), key=lambda j: (d2[i, j], ids[j]))[:5]]
    assert [(int(a), int(ids[b]), v) for a, b, v in zip(r, c, d)] == want


def test_query_tiles_of_many_dimensions_are_filled_across_groups():
    import pandas as pd
    from riskspark.operators.knn import _Slots
    base = pd.DataFrame({"_key": 0, "_cell": range(50), "n": 100, "radius": 1.0})
    asked = pd.DataFrame({"_key": 0, "_cell": range(0, 50, 2), "n": 10, "radius": 1.0})
    slots = _Slots(base, asked, 100, 100, True)
    assert slots.tiles(slots.count, 100, slots.group)[1].sum() >= 50
    assert slots.tiles(slots.asked, 100, slots.q_group)[1].sum() == 3  # 250 queries; one tile per group of the base before
    narrow = _Slots(base, asked, 100, 100, False)
    assert narrow.q_group is narrow.group


def test_training_rows_use_the_cores(spark):
    from riskspark.plans.training import _few
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, 64)
    assert _few(rows, 1000, 8).rdd.getNumPartitions() == 1
    assert _few(rows, 500_000, 8).rdd.getNumPartitions() == min(12, 2 * cores)  # 46 MB: one task a step before


@pytest.mark.parametrize("text_ids", [False, True])
def test_wide_vectors_are_swept_in_few_groups(spark, monkeypatch, text_ids):
    """Each block of queries meets a chunk of base rows once and returns k rows a query, whatever the number of tiles."""
    from riskspark.operators import knn
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 20)).round(1)
    x[60:] = x[:30]  # copies tie
    ids, keys, folds = list(range(90)), (np.arange(90) % 2).tolist(), (np.arange(90) % 3).tolist()
    rows = [(f"v{i:03d}" if text_ids else i, [float(v) for v in x[i]], keys[i], folds[i]) for i in ids]
    df = spark.createDataFrame(rows, f"id {'string' if text_ids else 'long'}, features array<double>, key int, fold int")
    monkeypatch.setattr(knn, "LEAST_CELLS", 100)
    got = {}
    for r in knn.knn_join(df.where("fold = 1"), df, 3, exclude_self=True, within="key", unlike="fold", chunk_rows=7,
                          query_block_rows=5).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["nb_id"], r["dist"]))
    assert len(got) == 30
    for i in ids:
        if folds[i] != 1:
            continue
        near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in ids if keys[j] == keys[i] and folds[j] != 1)[:3]
        mine = sorted(got[rows[i][0]])
        assert [m[1] for m in mine] == [rows[j][0] for _, j in near]
        assert np.allclose([m[2] ** 2 for m in mine], [d for d, _ in near])
    base = df.select("id", "features", F.lit(0).cast("long").alias("_key"), F.lit(knn.NO_FOLD).alias("_fold"))
    monkeypatch.setattr(knn, "LEAST_CELLS", 10**9)
    made = []
    real = knn._running
    monkeypatch.setattr(knn, "_running", lambda k, tile: made.append((k, tile)) or real(k, tile))
    top = knn._swept(base.where("id = id"), base, 3, "id", "features", 20, 7, None)
    assert made == [(3, 7)] and top.count() == 270


def _counted(monkeypatch, K):
    """Cells of every block of distances, as they are computed."""
    cells, plain = [], K._squared
    monkeypatch.setattr(K, "_squared", lambda x, y: cells.append(len(x) * len(y)) or plain(x, y))
    return cells, plain


@pytest.mark.parametrize("text_ids", [False, True])
def test_tiles_of_few_dimensions_meet_near_rows_only(monkeypatch, text_ids):
    """Two full tiles: a query is not compared with rows that lie farther along one dimension than its bound."""
    from riskspark.operators import knn as K
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 1, (1000, 3)) * [500, 10, 1], np.round(rng.uniform(0, 1, (3000, 3)) * [500, 10, 1], 1)
    ids = rng.permutation(3000).astype(np.int64)
    ids = ids.astype(str).astype(object) if text_ids else ids
    none = np.full(3000, K.NO_FOLD)
    cells, plain = _counted(monkeypatch, K)
    r, c, d = K._nearest(x, y, ids, 5, np.full(1000, np.inf), none[:1000], none)
    assert sum(cells) < 1000 * 3000 / 2
    d2 = plain(x, y)
    want = np.concatenate([np.lexsort((ids, row))[:5] for row in d2])
    assert (c == want).all() and (r == np.repeat(np.arange(1000), 5)).all() and (d == d2[r, c]).all()


def test_tiles_are_asked_of_near_cells_only(monkeypatch):
    from riskspark.operators import knn as K
    rng = np.random.default_rng(9)
    piv, x = rng.uniform(0, 1, (900, 2)), rng.uniform(0.4, 0.6, (500, 2))
    piv = piv[K._neighbourly(piv)]
    reach, group, limit = rng.uniform(0, 0.03, 900), np.arange(900) // 9, rng.uniform(0, 0.02, 500)
    limit[7], reach[3] = np.inf, -np.inf
    cells, plain = _counted(monkeypatch, K)
    ok = K._within_reach(x, limit, piv, reach, group, 100)
    assert sum(cells) < 500 * 900 / 2
    d = np.sqrt(plain(x, piv)) - reach
    assert (ok == (np.minimum.reduceat(d, np.arange(0, 900, 9), axis=1) <= limit[:, None])).all()


def test_nearest_pivot_has_the_exact_distance():
    from riskspark.operators import knn as K
    rng = np.random.default_rng(10)
    x, piv = rng.normal(0, 1, (700, 4)) * [1e5, 10, 1, 1e-3], rng.normal(0, 1, (60, 4)) * [1e5, 10, 1, 1e-3]
    cell, far = K._nearest_pivot(x, piv)
    d = np.sqrt(K._squared(x, piv))
    assert (far == d[np.arange(700), cell]).all() and np.allclose(far, d.min(axis=1))
