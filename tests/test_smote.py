import numpy as np
from pyspark.sql import functions as F

from riskspark.operators.resample import smote, smote_synthetic


def _imbalanced(spark, n_pos=9, n_neg=40, dup=False):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n_pos):
        v = [1.0, 1.0] if dup else [float(t) for t in rng.integers(0, 10, 2)]
        rows.append((i, 1, *v))
    for i in range(n_neg):
        rows.append((100 + i, 0, *[float(t) for t in rng.integers(0, 10, 2)]))
    return spark.createDataFrame(rows, "id long, label int, a double, b double")


def test_smote_balances_and_points_on_segments(spark):
    df = _imbalanced(spark)
    res = smote(df, "label", "id", ["a", "b"], k=3, seed=1)
    counts = {r.label: r["count"] for r in res.groupBy("label").count().collect()}
    assert counts[0] == counts[1] == 40
    syn = smote_synthetic(df, "label", "id", ["a", "b"], k=3, seed=1).toPandas()
    base = df.toPandas().set_index("id")
    for r in syn.itertuples():
        p, n = base.loc[r.parent_id, ["a", "b"]].to_numpy(), base.loc[r.nb_id, ["a", "b"]].to_numpy()
        assert 0.0 <= r.lam < 1.0 and r.parent_id != r.nb_id
        assert np.allclose([r.a, r.b], p + r.lam * (n - p))
        assert base.loc[r.nb_id, "label"] == 1


def test_smote_deterministic(spark):
    df = _imbalanced(spark)
    a = smote_synthetic(df, "label", "id", ["a", "b"], 3, 5).orderBy("synth_index").collect()
    b = smote_synthetic(df, "label", "id", ["a", "b"], 3, 5).orderBy("synth_index").collect()
    assert a == b


def test_smote_single_minority_row_duplicates(spark):
    df = _imbalanced(spark, n_pos=1)
    syn = smote_synthetic(df, "label", "id", ["a", "b"], 5, 1)
    assert syn.count() == 39 and syn.where(F.col("lam") != 0).count() == 0


def test_all_classes_in_one_pass_are_those_of_each_class_alone(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for cls, n in (("a", 60), ("b", 21), ("c", 8), ("d", 1), ("e", 33), (None, 4)):
        for _ in range(n):
            rows.append((i, cls, float(rng.normal()), float(rng.integers(0, 5))))
            i += 1
    df = spark.createDataFrame(rows, "id long, label string, x double, y double")
    syn = smote_synthetic(df, "label", "id", ["x", "y"], k=4, seed=2).toPandas()
    assert syn.groupby("label").size().to_dict() == {"b": 39, "c": 52, "d": 59, "e": 27}
    assert syn["id"].is_unique and syn["id"].max() < 0
    by_id = {r[0]: r for r in rows}
    for r in syn.itertuples():
        assert by_id[r.parent_id][1] == by_id[r.nb_id][1] == r.label
    for cls in "bce":
        two = df.where(F.col("label").isin("a", cls))
        alone = smote_synthetic(two, "label", "id", ["x", "y"], k=4, seed=2).toPandas().sort_values("synth_index")
        own = syn[syn["label"] == cls].sort_values("synth_index")
        for c in ("parent_id", "nb_id", "lam", "x", "y"):
            assert own[c].tolist() == alone[c].tolist()


def test_rows_with_missing_values_duplicate_as_parents(spark):
    rows = [(i, 0, float(i)) for i in range(30)] + [(100, 1, 1.0), (101, 1, 2.0), (102, 1, None)]
    df = spark.createDataFrame(rows, "id long, label int, x double")
    syn = smote_synthetic(df, "label", "id", ["x"], k=2, seed=1).toPandas()
    assert len(syn) == 27
    holes = syn[syn["parent_id"] == 102]
    assert len(holes) and (holes["nb_id"] == 102).all() and holes["x"].isna().all()
    assert syn[syn["parent_id"] != 102]["x"].notna().all()


def test_a_class_of_few_rows_is_salted(spark, monkeypatch):
    monkeypatch.setattr("riskspark.operators.resample.SALT_ROWS", 3)
    df = _imbalanced(spark, n_pos=3, n_neg=60)
    salted = smote_synthetic(df, "label", "id", ["a", "b"], 2, 5).orderBy("synth_index").collect()
    monkeypatch.setattr("riskspark.operators.resample.SALT_ROWS", 10_000)
    assert salted == smote_synthetic(df, "label", "id", ["a", "b"], 2, 5).orderBy("synth_index").collect()
    assert len(salted) == 57


def test_pairs_joined_or_broadcast_give_the_same(spark, monkeypatch):
    df = _imbalanced(spark)
    sent = smote_synthetic(df, "label", "id", ["a", "b"], 3, 5).orderBy("synth_index").collect()
    monkeypatch.setattr("riskspark.operators.resample.BROADCAST_BYTES", 0)
    assert sent == smote_synthetic(df, "label", "id", ["a", "b"], 3, 5).orderBy("synth_index").collect()
