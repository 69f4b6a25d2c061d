from pyspark.sql import functions as F

from riskspark.plans.models import default_specs
from riskspark.plans.training import prepare
from riskspark.sources.bundle import Bundle
from riskspark.streaming.scoring import start_at_risk_sink


def test_stream_scores_match_batch(spark, tmp_path):
    rows = [(i, i % 3 == 0 and 1 or 0, "a" if i % 2 else "b", float(i % 17), float((i * 7) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, g string, x double, z double")
    prep = prepare(df, "label", "id", test_size=0.2, seed=1, use_smote=True)
    spec = default_specs(len(prep.feature_cols), models=["Logistic Regression"])[0]
    bundle = Bundle.from_prepared(prep, spec.fit(prep.train, "label"))
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    df.drop("label").write.parquet(src)
    q = start_at_risk_sink(spark, src, df.drop("label").schema, bundle, "id", sink, ck, 0.4, available_now=True)
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink)
    batch = bundle.score(df.drop("label"), "id").where(F.col("p") >= 0.4)
    assert streamed.count() == batch.count()
    j = streamed.select("id", F.col("p").alias("s")).join(batch.select("id", F.col("p").alias("b")), "id")
    assert j.where(F.abs(F.col("s") - F.col("b")) > 1e-12).count() == 0
