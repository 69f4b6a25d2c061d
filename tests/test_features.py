import datetime as dt

import pytest

from riskspark.operators.dictionary import (DictionaryEncoder, DictionaryEncoderModel, decode_lookup, encode_lookup,
                                            fit_dictionary)
from riskspark.operators.features import split_columns_by_type
from riskspark.operators.quality import validate_table
from riskspark.operators.resample import smote
from riskspark.plans.training import prepare
from riskspark.sources.tables import schema_table


def typed(spark, n=80):
    rows = [(f"e{i}", i % 4 == 0, i % 3 == 0, dt.date(2020, 1 + i % 3, 1), dt.datetime(2020, 1, 1, i % 5), "ab"[i % 2], float(i))
            for i in range(n)]
    return spark.createDataFrame(rows, "id string, y boolean, flag boolean, day date, at timestamp, kind string, x double"
                                 ).selectExpr("id", "cast(y as int) y", "flag", "day", "at", "kind", "x")


def test_every_column_type_becomes_a_feature(spark):
    df = typed(spark)
    assert split_columns_by_type(df, "id", "y") == (["day", "at", "kind"], ["flag", "x"])
    with pytest.raises(TypeError):
        split_columns_by_type(df.selectExpr("id", "y", "array(x) v"), "id", "y")
    prep = prepare(df, "y", "id")  # text ids, oversampling included
    assert prep.feature_cols == ["flag", "day", "at", "kind", "x"]
    assert prep.class_counts_after == {0: 48, 1: 48}
    assert prep.train.count() == 96 and prep.train.select("id").distinct().count() == 96


def test_smote_leaves_null_labels_alone_and_ids_apart(spark):
    rows = [(-i, None if i % 10 == 0 else int(i % 5 == 0), float(i), float(i % 7)) for i in range(1, 60)]
    out = smote(spark.createDataFrame(rows, "id long, y int, a double, b double"), "y", "id", ["a", "b"])
    assert out.select("id").distinct().count() == out.count()
    assert out.where("y is null").count() == 5
    n = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert n[0] == n[1]


def test_dictionary(spark):
    values = ["b", "a", None, "c", "a", "ä"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    d = fit_dictionary(df, "v")
    assert {r["value"]: r["code"] for r in d.collect()} == {"a": 0, "b": 1, "c": 2, "ä": 3}
    coded = encode_lookup(df, d, "v")
    assert coded.where("v_code is null").count() == 1
    back = {r["id"]: r["w"] for r in decode_lookup(coded.select("id", "v_code"), d, "v_code", "w").collect()}
    assert back == dict(enumerate(values))
    other = spark.createDataFrame([(1, "zz")], "id int, v string")
    assert encode_lookup(other, d, "v", unseen="null").first()["v_code"] is None
    with pytest.raises(Exception, match="not in the dictionary"):
        encode_lookup(other, d, "v").collect()


def test_all_bad_labels_are_named_and_quotes_are_safe(spark):
    df = spark.createDataFrame([(i,) for i in range(60)], "`it's` int")
    row = validate_table(df, "it's").where("check = 'label_values'").first()
    assert len(row["observed"].split(",")) == 60 and not row["passed"]
    assert schema_table(df).first()["column"] == "it's"


def test_dictionary_stage_saves_and_encodes_like_the_indexer(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from riskspark.operators.features import fit_label_encoder
    rows = [(i, f"k{i * 37 % 500:03d}", "xyz"[i % 3] if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, key string, kind string")
    model = Pipeline(stages=[DictionaryEncoder(cols=["key", "kind"])]).fit(df)
    model.write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert isinstance(loaded.stages[0], DictionaryEncoderModel) and loaded.stages[0].uid == model.stages[0].uid
    got = {r["id"]: (r["key"], r["kind"]) for r in loaded.transform(df).collect()}
    whole = df.where("kind is not null")
    want = {r["id"]: (r["key"], r["kind"]) for r in fit_label_encoder(df.fillna("x"), ["key", "kind"]).transform(whole).collect()}
    assert all(got[i] == want[i] for i in want)
    assert [got[i][1] for i in got if i not in want] == [None] * 72
    assert loaded.transform(df).columns == df.columns
    odd = spark.createDataFrame([(1, "never", "x")], "id int, key string, kind string")
    with pytest.raises(Exception, match="not in the dictionary"):
        loaded.transform(odd).collect()
    lenient = DictionaryEncoder(cols=["key"], unseen="null").fit(df)
    assert lenient.transform(odd).first()["key"] is None
    assert lenient.transform(odd.drop("key")).columns == ["id", "kind"]


def test_rows_with_missing_features_are_scored_as_null(spark, tmp_path):
    from riskspark.operators.score import score_profiles, score_table
    from riskspark.plans.models import default_specs
    from riskspark.sources.bundle import Bundle
    rows = [(i, int(i % 3 == 0), "ab"[i % 2], float(i % 11)) for i in range(120)]
    rows += [(200, 1, None, 1.0), (201, 0, "a", None), (202, 0, "b", float("nan")), (203, None, "a", 2.0)]
    df = spark.createDataFrame(rows, "id long, y int, kind string, x double")
    prep = prepare(df, "y", "id", test_size=0.25)
    assert prep.train.count() + prep.test.count() >= 120 and prep.split_ids.count() == 120
    for name in ("Logistic Regression", "KNN (Weighted)"):
        bundle = Bundle.from_prepared(prep, default_specs(2, models=[name])[0].fit(prep.train, "y"))
        got = {r["id"]: r for r in score_table(df, bundle, "id").collect()}
        assert len(got) == 124
        assert {i for i, r in got.items() if r["p"] is None} == {200, 201, 202}
        assert all(got[i]["p_pct"] is None and got[i]["risk_level"] is None for i in (200, 201, 202))
        prof = {r["id"]: r for r in score_profiles(df.drop("y"), bundle, "id").collect()}
        assert prof[201]["risk_label"] is None and prof[201]["pred"] is None and prof[5]["pred"] in (0, 1)


def test_many_labels_are_counted_and_bounded(spark):
    from riskspark.operators.quality import observed_labels
    df = spark.createDataFrame([(f"v{i % 1500:04d}",) for i in range(3000)], "y string")
    row = validate_table(df, "y", max_shown=10).where("check = 'label_values'").first()
    assert row["observed"].split(",")[:2] == ["v0000", "v0001"] and row["observed"].endswith("(+1490 more)")
    assert observed_labels(df, "y").count() == 1500
