"""Model bundle (A9) and run history (A10).

A bundle is the fitted encoder, scaler, assembler and classifier of the best
model plus its remembered feature order. It is saved with MLlib's writers
(``PipelineModel.write().save``) next to a one-row metadata table, so any
executor-visible store works; kNN bundles also keep their training rows as
Parquet.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.operators.dictionary import DictionaryEncoderModel
from riskspark.operators.features import complete_row, encodable
from riskspark.operators.knn import knn_classify


@dataclass
class Bundle:
    name: str
    kind: str  # 'mllib' or 'knn'
    prep: PipelineModel  # dictionary encoder + scaler + assembler
    classifier: object  # PipelineModel for mllib, training DataFrame for knn
    feature_cols: list
    cat_cols: list
    params: dict

    @classmethod
    def from_prepared(cls, prepared, fitted) -> Bundle:
        prep = PipelineModel(stages=list(prepared.encoder.stages) + [prepared.scaler, prepared.assembler])
        if fitted.kind == "knn":
            clf = fitted.model
        else:
            m = fitted.model
            clf = m if isinstance(m, PipelineModel) else PipelineModel(stages=[m])
        return cls(fitted.name, "knn" if fitted.kind == "knn" else "mllib", prep, clf, list(prepared.feature_cols),
                   list(prepared.cat_cols), dict(fitted.params))

    def _prepare(self, df: DataFrame) -> DataFrame:
        """Encode present categoricals, fill missing feature columns with 0 (B3), scale, assemble.

        ``_complete`` tells the rows that have a value for every feature; the others pass as zeros and get no score.
        """
        present = set(df.columns)
        encoders = [st for st in self.prep.stages if isinstance(st, DictionaryEncoderModel)]
        coded = encodable(df, self.cat_cols)
        for st in encoders:
            coded = st.transform(coded)
        coded = coded.withColumns({c: F.lit(0.0) for c in self.feature_cols if c not in present}
                                  | {c: F.col(c).cast("double") for c in self.feature_cols if c in present})
        coded = coded.withColumn("_complete", complete_row(self.feature_cols))
        coded = coded.withColumns({c: F.when(F.col("_complete"), F.col(c)).otherwise(F.lit(0.0))
                                   for c in self.feature_cols})
        return PipelineModel(stages=[st for st in self.prep.stages if st not in encoders]).transform(coded)

    def score(self, df: DataFrame, id_col: str) -> DataFrame:
        """K17 core: adds ``p`` (probability of 1) to every row; input columns keep their original values.

        A row with a null (or NaN) in a feature column has a null ``p``: the reference imputes nothing either.

        Encoding and scaling work in place on the feature columns, so the
        originals ride along under private names in the same narrow
        projection (no join back).
        """
        from pyspark.ml.functions import vector_to_array
        keep = list(df.columns)
        carried = df.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"__orig_{c}") for c in keep])
        feats = self._prepare(carried)
        if self.kind == "knn":
            q = feats.where("_complete").select(id_col, vector_to_array("features").alias("features"))
            p = knn_classify(q, self.classifier, self.params.get("k", 5), self.params.get("label", "label"), id_col,
                             "features", weights=self.params.get("weights", "distance"),
                             balanced=self.params.get("balanced", True))
            return df.join(p.select(id_col, "p"), id_col, "left")
        out = self.classifier.transform(feats)
        return out.select(*[F.col(f"__orig_{c}").alias(c) for c in keep],
                          F.when(F.col("_complete"), vector_to_array("probability")[1]).alias("p"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.prep.write().overwrite().save(f"{path}/prep")
        if self.kind == "knn":
            self.classifier.write.mode("overwrite").parquet(f"{path}/train")
        else:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        meta = json.dumps({"name": self.name, "kind": self.kind, "feature_cols": self.feature_cols,
                           "cat_cols": self.cat_cols, "params": self.params})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        prep = PipelineModel.load(f"{path}/prep")
        clf = (spark.read.parquet(f"{path}/train") if meta["kind"] == "knn"
               else PipelineModel.load(f"{path}/classifier"))
        return cls(meta["name"], meta["kind"], prep, clf, meta["feature_cols"], meta["cat_cols"], meta["params"])


# ---------------------------------------------------------------- A10 run history

RUN_SCHEMA = "key string, best string, n_models int, train_size long, model string, metric string, value double"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(key, run): committed runs, numbered from 1 in the order of their commits (a row a run)."""
    try:
        found = spark.read.format("binaryFile").load(f"{path}/_commits").select(
            F.element_at(F.split("path", "/"), -1).alias("key"), "modificationTime")
    except AnalysisException as e:  # the first run: nothing stored yet; every other error is raised
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, run int")
    order = Window.orderBy("modificationTime", "key")
    return found.select("key", F.row_number().over(order).alias("run"))


def _filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def append_history(spark: SparkSession, path: str, best: str, train_size: int, metrics: DataFrame) -> int:
    """Append one run in long form (best, n_models, train_size, model, metric, value) and return its number.

    ``metrics`` is the comparison table (model, recall, accuracy, ...). A run is written into a folder of its own under a
    unique key and counts once its marker, a small file named by the key, is closed; runs are numbered by the order of
    their markers. So any number of writers may append at once, and a writer that dies halfway leaves no run.
    """
    key = uuid.uuid4().hex
    n_models = metrics.select("model").distinct().count()
    long = metrics.select("model", F.expr("stack(2, 'recall', recall, 'acc', accuracy) AS (metric, value)"))
    rows = long.select(F.lit(key).alias("key"), F.lit(best).alias("best"), F.lit(n_models).alias("n_models"),
                       F.lit(train_size).cast("long").alias("train_size"), "model", "metric",
                       F.col("value").cast("double").alias("value"))
    rows.write.parquet(f"{path}/run-{key}")
    files, marker = _filesystem(spark, f"{path}/_commits/{key}")
    out = files.create(marker, False)
    out.writeBytes(key)  # Spark's reader passes over empty files: a marker counts once it is closed
    out.close()
    return int(_commits(spark, path).where(F.col("key") == key).first()["run"])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Wide view keyed by run: best, n_models, train_size, then ``{model}_{metric}`` columns; committed runs only."""
    commits = _commits(spark, path)
    if commits.isEmpty():
        return spark.createDataFrame([], "run int, best string, n_models int, train_size long")
    h = spark.read.schema(RUN_SCHEMA).parquet(f"{path}/run-*").join(F.broadcast(commits), "key")  # a row a run
    keys = sorted(r[0] for r in h.select(F.concat_ws("_", "model", "metric")).distinct().collect())
    return (h.withColumn("key", F.concat_ws("_", "model", "metric"))
             .groupBy("run", "best", "n_models", "train_size").pivot("key", keys).agg(F.first("value"))
             .orderBy("run"))


def clear_history(spark: SparkSession, path: str) -> None:
    """Forget all runs."""
    files, at = _filesystem(spark, path)
    files.delete(at, True)
