import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions.columns import hash_hex
from riskspark.operators import split as S
from riskspark.operators.split import fold_assign, random_split, stratified_split


def _labelled(spark, n_pos=37, n_neg=203):
    rows = [(i, 1) for i in range(n_pos)] + [(1000 + i, 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "id long, label int")


def test_stratified_split_sizes_exact(spark):
    df = _labelled(spark)
    out = S.stratified_split(df, "label", "id", 0.2, 7).groupBy("label", "split").count().collect()
    got = {(r.label, r.split): r["count"] for r in out}
    assert got[(1, "test")] == max(1, round(37 * 0.2)) and got[(0, "test")] == max(1, round(203 * 0.2))
    assert got[(1, "train")] + got[(1, "test")] == 37


def test_rank_equals_plain_window(spark):
    df = _labelled(spark, 120, 400)
    got = S.class_rank(df, "label", "id", 42, digits=2)
    w = Window.partitionBy("label").orderBy(hash_hex(42, F.col("id")), "id")
    ref = df.withColumn("r", F.row_number().over(w))
    j = got.join(ref, ["id", "label"])
    assert j.where(F.col("class_rank") != F.col("r")).count() == 0 and j.count() == 520


def test_folds_disjoint_cover_and_sizes(spark):
    df = _labelled(spark, 11, 50)
    out = S.fold_assign(df, "label", "id", 3, 42).toPandas()
    assert len(out) == 61 and out["id"].is_unique
    for lab, n in [(1, 11), (0, 50)]:
        sizes = out[out.label == lab].groupby("fold").size().sort_index().to_numpy()
        assert list(sizes) == [len(a) for a in np.array_split(np.arange(n), 3)]
    tr, te = S.fold_train_test(S.fold_assign(df, "label", "id", 3, 42), 1)
    assert tr.join(te, "id").count() == 0 and tr.count() + te.count() == 61


def test_random_split_exact(spark):
    df = _labelled(spark)
    out = S.random_split(df, "id", 0.25, 3)
    assert out.where(F.col("split") == "test").count() == round(240 * 0.25)


def test_split_plan_has_no_single_partition_exchange(spark):
    df = _labelled(spark)
    plan = S.stratified_split(df, "label", "id", 0.2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_folds_without_shuffle_follow_id_order(spark):
    rows = [(i * i, i % 4 == 0 and 1 or 0) for i in range(300)]  # clustered, uneven ids
    df = spark.createDataFrame(rows, "id long, label int")
    out = S.fold_assign(df, "label", "id", 3, shuffle=False).toPandas()
    for lab in (0, 1):
        part = out[out.label == lab].sort_values("id")
        expect = np.concatenate([np.full(len(a), f) for f, a in enumerate(np.array_split(np.arange(len(part)), 3))])
        assert list(part["fold"]) == list(expect)


def test_cuts_equal_ranks_and_shuffle_no_rows(spark):
    rows = [(i, [0, 1, None, 2][i % 4] if i % 97 else 3) for i in range(2000)] + [(5000, 9), (5001, 9)]
    df = spark.createDataFrame(rows, "id long, y int")
    for k in (2, 5):
        a = {r["id"]: r["fold"] for r in fold_assign(df, "y", "id", k).collect()}
        assert a == {r["id"]: r["fold"] for r in fold_assign(df, "y", "id", k, with_rank=False).collect()}
        assert len(a) == len(rows)
    for split in (lambda **o: stratified_split(df, "y", "id", 0.3, **o), lambda **o: random_split(df, "id", 0.3, **o)):
        a = {r["id"]: r["split"] for r in split().collect()}
        got = split(with_rank=False)
        assert a == {r["id"]: r["split"] for r in got.collect()} and len(a) == len(rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "id long, y int")
    assert stratified_split(df, "y", "id").count() == 100
    assert fold_assign(df, "y", "id", 5).count() == 100


def test_ordered_folds_take_ids_of_any_type(spark):
    rng = np.random.default_rng(1)
    ids = [f"id-{v}" for v in rng.permutation(700)]
    rows = [(i, int(n % 5 == 0) if n % 50 else None) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id string, label int")
    out = S.fold_assign(df, "label", "id", 4, shuffle=False)
    assert out.count() == 700
    for lab, part in out.toPandas().groupby(out.toPandas()["label"].fillna(-1)):
        part = part.sort_values("id")
        want = np.concatenate([np.full(len(a), f) for f, a in enumerate(np.array_split(np.arange(len(part)), 4))])
        assert part["fold"].tolist() == want.tolist() and part["class_rank"].tolist() == list(range(1, len(part) + 1))


def test_cut_tables_joined_or_broadcast_give_the_same(spark, monkeypatch):
    rows = [(i, [0, 1, None, 2][i % 4]) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, y int")
    sent = {r["id"]: r["fold"] for r in fold_assign(df, "y", "id", 5, with_rank=False).collect()}
    monkeypatch.setattr("riskspark.operators.rank.BROADCAST_CLASSES", 0)
    assert sent == {r["id"]: r["fold"] for r in fold_assign(df, "y", "id", 5, with_rank=False).collect()}
