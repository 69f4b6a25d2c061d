"""Classifiers (K8-K12) behind one small protocol.

``ModelSpec.fit(train)`` returns a ``Fitted`` whose ``predict(df)`` adds a
probability-of-1 column ``p`` and the decision ``pred = p >= 0.35``.
LR, RF and linear SVM are MLlib estimators (distributed tree-aggregate
training); the kNN classifier is the exact distributed kNN join.

Objectives follow the reference's, not its unconverged gradient loops:
LR: weighted log-loss + ||w||^2 / (2 C n)   -> regParam = 1 / (C n)
SVM: weighted hinge + ||w||^2 / (C n)       -> regParam = 2 / (C n)
MLlib normalises the data term by the weight sum, which equals n for
balanced weights.

``rf_levels`` is the forest of ``operators.trees``, whose nodes stop at a
smallest number of rows. ``lr_steps`` and ``svm_steps`` minimise the same objectives by the reference's
fixed number of gradient steps (``operators.gradient``). These two and kNN are
fold-aware: ``fit_folds`` fits or searches all folds of a cross-validation and
the whole training set in one pass.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import DECISION_THRESHOLD, linear_probability, predict_at, sigmoid
from riskspark.operators.gradient import by_fold, descend, platt
from riskspark.operators.knn import knn_classify
from riskspark.operators.trees import Forest, grow_forest

FOLD_AWARE = ("knn", "lr_steps", "svm_steps")
MODEL_NAMES = ["Logistic Regression", "Random Forest", "SVM (Linear)", "KNN (Weighted)"]


class MarginScaler(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Standardise the SVM margin with the training mean / population std (+1e-8)."""

    inputCol = Param(Params._dummy(), "inputCol", "raw prediction vector", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "1-d vector of the scaled margin",
                      typeConverter=TypeConverters.toString)
    mean = Param(Params._dummy(), "mean", "margin mean", typeConverter=TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "margin std", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, mean=None, std=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = vector_to_array(F.col(self.getOrDefault(self.inputCol)))[1]
        z = (m - F.lit(self.getOrDefault(self.mean))) / F.lit(self.getOrDefault(self.std))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(z)))


class LinearScorer(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A linear model with given weights as a saveable stage: probability = sigmoid(intercept + sum of w * x)."""

    cols = Param(Params._dummy(), "cols", "feature columns", typeConverter=TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "weight of each", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, cols=None, weights=None, intercept=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = linear_probability(self.getOrDefault(self.cols), self.getOrDefault(self.weights),
                               self.getOrDefault(self.intercept))
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))


class ForestScorer(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A level-wise forest as a saveable stage: its node table travels as JSON, bounded by trees x 2^(depth + 1)."""

    cols = Param(Params._dummy(), "cols", "feature columns", typeConverter=TypeConverters.toListString)
    nodes = Param(Params._dummy(), "nodes", "number of trees, depth and node table as JSON",
                  typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, cols=None, nodes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def forest(self) -> Forest:
        n_trees, depth, nodes = json.loads(self.getOrDefault(self.nodes))
        return Forest(self.getOrDefault(self.cols), n_trees, depth, [tuple(n) for n in nodes])

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_p1", self.forest().probability())
        return out.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - F.col("_p1"), F.col("_p1")))).drop("_p1")


def prob1(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


@dataclass
class Fitted:
    name: str
    model: object  # PipelineModel / MLlib model / kNN training frame
    kind: str
    params: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, features_col: str = "features", id_col: str = "id",
                label: str = "label", threshold: float = DECISION_THRESHOLD) -> DataFrame:
        if self.kind == "knn":
            q = df.select(id_col, vector_to_array(F.col(features_col)).alias("_fa"))
            train = self.model
            p = knn_classify(q.withColumnRenamed("_fa", "features"), train, self.params["k"], label, id_col,
                             "features", weights=self.params["weights"], balanced=self.params["balanced"])
            out = df.join(p.select(id_col, "p"), id_col, "left")
        else:
            out = self.model.transform(df).withColumn("p", prob1()).drop("rawPrediction", "probability",
                                                                        "prediction", "svm_raw", "svm_pred",
                                                                        "svm_z")
        return out.withColumn("pred", predict_at("p", threshold))


@dataclass
class ModelSpec:
    name: str
    kind: str
    params: dict = field(default_factory=dict)

    def fit(self, train: DataFrame, label: str = "label", features_col: str = "features", weight_col: str = "weight",
            id_col: str = "id", n: int | None = None) -> Fitted:
        n = n if n is not None else train.count()
        lab = F.col(label).cast("double")
        data = train.withColumn("_y", lab)
        pr = self.params
        if self.kind == "lr":
            est = LogisticRegression(featuresCol=features_col, labelCol="_y", weightCol=weight_col,
                                     regParam=1.0 / (pr.get("C", 1.0) * n), elasticNetParam=0.0,
                                     standardization=False, maxIter=pr.get("maxIter", 100), tol=1e-8)
            return Fitted(self.name, est.fit(data), "mllib", pr)
        if self.kind == "rf":
            d = pr["n_features"]
            est = RandomForestClassifier(featuresCol=features_col, labelCol="_y", weightCol=weight_col,
                                         numTrees=pr.get("numTrees", 80), maxDepth=pr.get("maxDepth", 8),
                                         maxBins=pr.get("maxBins", 21),  # at most 20 thresholds per feature
                                         featureSubsetStrategy=str(max(1, int(math.sqrt(d)))),
                                         seed=pr.get("seed", 42))
            return Fitted(self.name, est.fit(data), "mllib", pr)
        if self.kind == "svm":
            svc = LinearSVC(featuresCol=features_col, labelCol="_y", weightCol=weight_col,
                            regParam=2.0 / (pr.get("C", 1.0) * n), standardization=False,
                            maxIter=pr.get("maxIter", 100), rawPredictionCol="svm_raw", predictionCol="svm_pred")
            svm = svc.fit(data)
            margin = vector_to_array(F.col("svm_raw"))[1]
            st = svm.transform(data).agg(F.avg(margin).alias("m"), F.stddev_pop(margin).alias("s")).first()
            scaler = MarginScaler(inputCol="svm_raw", outputCol="svm_z", mean=float(st["m"]),
                                  std=float(st["s"] or 0.0) + 1e-8)
            cal_in = scaler.transform(svm.transform(data))
            cal = LogisticRegression(featuresCol="svm_z", labelCol="_y", regParam=1.0 / n, elasticNetParam=0.0,
                                     standardization=False, maxIter=100, tol=1e-8).fit(cal_in)
            return Fitted(self.name, PipelineModel(stages=[svm, scaler, cal]), "mllib", pr)
        if self.kind == "knn":
            tr = train.select(id_col, F.col(label), vector_to_array(F.col(features_col)).alias("features"))
            return Fitted(self.name, tr, "knn", {"k": pr.get("k", 5), "weights": pr.get("weights", "distance"),
                                                 "balanced": pr.get("balanced", True), "label": label})
        if self.kind == "rf_levels":  # MLlib's forest has no smallest node to split
            forest = grow_forest(train, pr["cols"], label, id_col, pr.get("numTrees", 80), pr.get("maxDepth", 8),
                                 pr.get("minSamples", 5), balanced=pr.get("balanced", True), seed=pr.get("seed", 42))
            stage = ForestScorer(cols=forest.cols, nodes=json.dumps([forest.n_trees, forest.max_depth, forest.nodes]))
            return Fitted(self.name, PipelineModel(stages=[stage]), "mllib", pr)
        if self.kind in FOLD_AWARE:
            return self._linear(self._steps(train, label)[-1])
        raise ValueError(self.kind)

    def _steps(self, train: DataFrame, label: str, fold_col: str | None = None, folds: int = 0) -> list:
        pr, svm = self.params, self.kind == "svm_steps"
        fits = descend(train, pr["cols"], label, "hinge" if svm else "logistic", pr.get("C", 1.0),
                       pr.get("steps", 100 if svm else 150), pr.get("balanced", True), fold_col, folds)
        return platt(train, fits, label, fold_col=fold_col) if svm else fits

    def _linear(self, fit) -> Fitted:
        scorer = LinearScorer(cols=list(fit.cols), weights=list(fit.weights), intercept=float(fit.intercept))
        return Fitted(self.name, PipelineModel(stages=[scorer]), "mllib", self.params)

    def fit_folds(self, folded: DataFrame, folds: int, label: str = "label", id_col: str = "id",
                  test: DataFrame | None = None, features_col: str = "features",
                  threshold: float = DECISION_THRESHOLD) -> tuple[Fitted, DataFrame]:
        """(the fit on all rows, every row scored by the fit that left its fold out: id, label, fold, p, pred).

        ``folded`` has a ``fold`` column; rows of ``test`` come with a null fold and are scored by the fit on all rows.
        kNN searches once for all of them, the linear models descend once.
        """
        if self.kind == "knn":
            vec = lambda df, fold: df.select(
                id_col, label, fold.cast("int").alias("fold"), vector_to_array(F.col(features_col)).alias("features"))
            rows = vec(folded, F.col("fold"))
            asked = rows if test is None else rows.unionByName(vec(test, F.lit(None)))
            pr = self.params
            p = knn_classify(asked, rows, pr.get("k", 5), label, id_col, weights=pr.get("weights", "distance"),
                             balanced=pr.get("balanced", True), unlike="fold", folds=folds)
            scored = asked.select(id_col, label, "fold").join(p.select(id_col, "p"), id_col, "left")
            fitted = Fitted(self.name, rows.drop("fold"), "knn", {
                "k": pr.get("k", 5), "weights": pr.get("weights", "distance"), "balanced": pr.get("balanced", True),
                "label": label})
        elif self.kind in FOLD_AWARE:
            fits = self._steps(folded, label, "fold", folds)
            scored = folded.select(id_col, label, "fold", sigmoid(by_fold(fits, "fold")).alias("p"))
            if test is not None:
                scored = scored.unionByName(test.select(id_col, label, F.lit(None).cast("int").alias("fold"),
                                                        sigmoid(fits[-1].score()).alias("p")))
            fitted = self._linear(fits[-1])
        else:
            raise ValueError(f"{self.kind} fits fold by fold")
        return fitted, scored.withColumn("pred", predict_at("p", threshold))


def default_specs(n_features: int, lr_c: float = 1.0, rf_trees: int = 80, svm_c: float = 1.0, knn_k: int = 5,
                  models: list[str] | None = None) -> list[ModelSpec]:
    specs = [
        ModelSpec("Logistic Regression", "lr", {"C": lr_c, "maxIter": 150}),
        ModelSpec("Random Forest", "rf", {"numTrees": rf_trees, "maxDepth": 8, "n_features": n_features}),
        ModelSpec("SVM (Linear)", "svm", {"C": svm_c}),
        ModelSpec("KNN (Weighted)", "knn", {"k": knn_k, "weights": "distance", "balanced": True}),
    ]
    return [s for s in specs if models is None or s.name in models]


def step_specs(cols: list[str], C: float = 1.0, lr_steps: int = 150, svm_steps: int = 100, knn_k: int = 5) -> list[ModelSpec]:
    """The fold-aware models over named feature columns: LR and SVM by the reference's gradient steps, kNN."""
    return [ModelSpec("Logistic Regression", "lr_steps", {"cols": list(cols), "C": C, "steps": lr_steps}),
            ModelSpec("SVM (Linear)", "svm_steps", {"cols": list(cols), "C": C, "steps": svm_steps}),
            ModelSpec("KNN (Weighted)", "knn", {"k": knn_k, "weights": "distance", "balanced": True})]
