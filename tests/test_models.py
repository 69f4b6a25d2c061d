import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators.explain import coefficient_table, feature_importance, row_contributions
from riskspark.operators.features import PopulationScaler
from riskspark.plans.models import default_specs
from riskspark.plans.training import prepare, train_and_compare
from riskspark.sources.bundle import Bundle


@pytest.fixture(scope="module")
def signal(spark):
    """F-SIGNAL: planted logistic signal (x1 strongly +, x2 strongly -), about 15 % positive."""
    rng = np.random.default_rng(11)
    n = 1500
    x = rng.normal(0, 1, (n, 6))
    z = -2.6 + 2.2 * x[:, 0] - 1.6 * x[:, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    cat = np.where(x[:, 2] > 0, "hi", "lo")
    rows = [(int(i), int(y[i]), str(cat[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, grp string, x1 double, x2 double, x3 double, "
                                       "x4 double, x5 double, x6 double")


@pytest.fixture(scope="module")
def prepared(signal):
    return prepare(signal, "label", "id", test_size=0.2, seed=42, use_smote=True)


def test_prepare_balances_and_scales(prepared):
    assert prepared.class_counts_after[0] == prepared.class_counts_after[1]
    stats = prepared.train.agg(F.avg("x1"), F.stddev_pop("x1")).first()
    assert stats[0] == pytest.approx(0.0, abs=1e-9) and stats[1] == pytest.approx(1.0, abs=1e-9)
    assert prepared.feature_cols == ["grp", "x1", "x2", "x3", "x4", "x5", "x6"]


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    m = PopulationScaler(inputCols=["a", "c"]).fit(df)
    got = m.transform(df).collect()
    assert [r.a for r in got] == [-1.0, 1.0] and [r.c for r in got] == [0.0, 0.0]
    assert m.transform(spark.createDataFrame([(0.0, 7.0)], "a double, c double")).first().c == 2.0


def test_models_beat_baseline_and_signs(spark, prepared):
    specs = default_specs(len(prepared.feature_cols), rf_trees=20)
    res = train_and_compare(prepared, specs, cv_k=2)
    cmp = {r.model: r for r in res.comparison.collect()}
    assert set(cmp) == set(s.name for s in specs)
    for name, r in cmp.items():
        assert r.recall > 0.5 and r.roc_auc > 0.7, name
    coefs = {r.feature: r.weight for r in coefficient_table(spark, res.fitted["Logistic Regression"].model,
                                                             prepared.feature_cols).collect()}
    assert coefs["x1"] > 0 and coefs["x2"] < 0
    fi = feature_importance(spark, res.fitted["Random Forest"].model, prepared.feature_cols).orderBy(
        F.desc("importance")).first()
    assert fi.feature in ("x1", "x2")
    assert res.best_name in cmp


def test_bundle_roundtrip_equal_scores(spark, signal, prepared, tmp_path):
    spec = default_specs(len(prepared.feature_cols), models=["Logistic Regression"])[0]
    b = Bundle.from_prepared(prepared, spec.fit(prepared.train, "label"))
    path = str(tmp_path / "bundle")
    b.save(path)
    b2 = Bundle.load(spark, path)
    s1 = b.score(signal, "id").select("id", F.col("p").alias("p1"))
    s2 = b2.score(signal.drop("x6"), "id").select("id", F.col("p").alias("p2"))  # missing column -> 0
    s3 = b2.score(signal, "id").select("id", F.col("p").alias("p3"))
    j = s1.join(s3, "id")
    assert j.where(F.abs(F.col("p1") - F.col("p3")) > 1e-12).count() == 0
    assert s2.count() == signal.count()


def test_row_contributions_top_abs(spark):
    df = spark.createDataFrame([(1, 1.0, -3.0, 0.5)], "id long, a double, b double, c double")
    out = row_contributions(df, {"a": 2.0, "b": 1.0, "c": -10.0}, "id", top_n=2).collect()
    assert [(r.feature, r.contribution, r.direction) for r in out] == [("c", -5.0, "stay"), ("b", -3.0, "stay")]


def test_score_keeps_original_values(spark, signal, prepared):
    spec = default_specs(len(prepared.feature_cols), models=["Logistic Regression"])[0]
    b = Bundle.from_prepared(prepared, spec.fit(prepared.train, "label"))
    scored = b.score(signal, "id")
    assert scored.columns == signal.columns + ["p"]
    j = scored.join(signal.select("id", F.col("grp").alias("g0"), F.col("x1").alias("x0")), "id")
    assert j.where((F.col("grp") != F.col("g0")) | (F.col("x1") != F.col("x0"))).count() == 0


def test_cv_resample_inside_fold(spark, prepared):
    from riskspark.plans.training import cross_validate
    spec = default_specs(len(prepared.feature_cols), models=["Logistic Regression"])[0]
    rows = cross_validate(spec, prepared.train, "label", "id", 2, prep=prepared).collect()
    assert len(rows) == 2 and all(0.0 <= r.recall <= 1.0 for r in rows)
    assert prepared.split_ids.groupBy("split").count().count() == 2


def test_score_profiles_and_report(spark, signal, prepared, tmp_path):
    from pyspark.sql import functions as F

    from riskspark.operators.score import at_risk_report, score_profiles
    spec = default_specs(len(prepared.feature_cols), models=["Logistic Regression"])[0]
    b = Bundle.from_prepared(prepared, spec.fit(prepared.train, "label"))
    prof = signal.drop("label").limit(40)
    rules = [("x1_too_high", F.col("x1") <= 1.5)]
    out = score_profiles(prof, b, "id", rules=rules).collect()
    bad = [r for r in out if r.violation is not None]
    assert all(r.p is None for r in bad) and all(r.p is not None for r in out if r.violation is None)
    assert len(out) == 40
    rep = at_risk_report(signal, b, "id", label="label", threshold=0.4, split_ids=prepared.split_ids,
                         out_path=str(tmp_path / "list"))
    s = rep["summary"].first()
    assert s.n_total == signal.count() and s.n_at_risk == rep["list"].count()
    assert rep["histogram"].agg(F.sum("n")).first()[0] == signal.count()
    assert "split" in rep["list"].columns
    assert spark.read.option("header", True).csv(str(tmp_path / "list")).count() == s.n_at_risk


def test_history_append_and_pivot(spark, tmp_path):
    from riskspark.sources.bundle import append_history, clear_history, read_history
    path = str(tmp_path / "hist")
    m1 = spark.createDataFrame([("LR", 0.8, 0.7)], "model string, recall double, accuracy double")
    m2 = spark.createDataFrame([("LR", 0.6, 0.9), ("RF", 0.7, 0.8)], "model string, recall double, accuracy double")
    assert append_history(spark, path, "LR", 100, m1) == 1
    assert append_history(spark, path, "RF", 120, m2) == 2
    wide = {r.run: r for r in read_history(spark, path).collect()}
    assert wide[1].LR_recall == 0.8 and wide[2].RF_acc == 0.8 and wide[2].n_models == 2
    clear_history(spark, path)
    assert read_history(spark, path).count() == 0


def test_history_takes_concurrent_writers_and_skips_unfinished_runs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from riskspark.sources.bundle import append_history, read_history
    path = str(tmp_path / "hist")
    runs = [spark.createDataFrame([(f"M{i}", i / 10, 0.5)], "model string, recall double, accuracy double")
            for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: append_history(spark, path, f"M{i}", 100 + i, runs[i]), range(6)))
    runs[0].selectExpr("'zz' key", "'M0' best", "1 n_models", "7L train_size", "model", "'acc' metric",
                       "recall value").write.parquet(f"{path}/run-zz")  # written, never committed
    wide = read_history(spark, path).collect()
    assert [r.run for r in wide] == [1, 2, 3, 4, 5, 6] and sorted(r.best for r in wide) == [f"M{i}" for i in range(6)]
    assert all(r[f"{r.best}_recall"] == int(r.best[1]) / 10 and r.train_size == 100 + int(r.best[1]) for r in wide)
    assert all(1 <= n <= 6 for n in numbers)
    assert append_history(spark, path, "M1", 1, runs[1]) == 7


def test_knn_bundle_with_custom_label_name(spark, signal, tmp_path):
    from riskspark.plans.training import prepare as prep_fn
    df = signal.withColumnRenamed("label", "Attrition").limit(400)
    p = prep_fn(df, "Attrition", "id", test_size=0.25, seed=3, use_smote=True)
    spec = default_specs(len(p.feature_cols), models=["KNN (Weighted)"])[0]
    b = Bundle.from_prepared(p, spec.fit(p.train, "Attrition"))
    b.save(str(tmp_path / "knn"))
    got = Bundle.load(spark, str(tmp_path / "knn")).score(df, "id")
    assert got.where(F.col("p").isNull()).count() == 0 and got.count() == 400


def test_prepare_reads_its_source_once(spark):
    """Cuts and split read the encoded rows several times; what makes the rows (whole texts) runs once."""
    from riskspark.plans.training import prepare
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return float(x % 7)

    df = spark.range(200).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"),
                                 costly.asNondeterministic()("id").alias("a"))
    prepared = prepare(df, "label", "id", use_smote=False)
    assert prepared.train.count() + prepared.test.count() == 200
    assert seen.value == 200


def test_document_counts_of_separators(spark, tmp_path):
    from riskspark.plans.views import documents_view
    texts = ["a b  c\nd", "", None, "é 日本 \n\n", "word"]
    docs = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0.5, 0) for i in range(5)], "doc_id long, quality double, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    got = {r["id"]: (r["n_words"], r["n_lines"]) for r in documents_view(spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if t is None else (t.count(" ") + 1, t.count("\n") + 1) for i, t in enumerate(texts)}
