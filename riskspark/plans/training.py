"""Preprocess -> train -> evaluate dataflow.

``prepare`` fits the ordered label encoder on all rows, splits exactly and
stratified, oversamples the training part with SMOTE (before scaling, as the
reference), fits the population scaler on the (resampled) training rows and
assembles vectors. Train and test are cut from their lineage with a reliable
checkpoint (shared ``spark.checkpoint.dir``) so the many MLlib passes neither
recompute the kNN join nor lose work when an executor goes away.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators import metrics as M
from riskspark.operators.dictionary import DictionaryEncoder
from riskspark.operators.features import PopulationScaler, complete_row, encodable, split_columns_by_type
from riskspark.operators.resample import smote
from riskspark.operators.split import fold_assign, fold_train_test, stratified_split
from riskspark.plans.models import FOLD_AWARE, Fitted, ModelSpec
from riskspark.session import cut_lineage


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    encoder: PipelineModel
    scaler: object
    assembler: VectorAssembler
    feature_cols: list[str]
    cat_cols: list[str]
    id_col: str
    label: str
    class_counts_before: dict = field(default_factory=dict)
    class_counts_after: dict = field(default_factory=dict)
    train_raw: DataFrame | None = None  # encoded training rows before SMOTE and scaling
    split_ids: DataFrame | None = None  # (id, split) of every input row
    use_smote: bool = True
    k_smote: int = 5
    seed: int = 42


def _few(df: DataFrame, n_rows: int, n_cols: int, target_bytes: int = 64 << 20, least_bytes: int = 4 << 20) -> DataFrame:
    """At most one partition per ``target_bytes`` of doubles, by a narrow coalesce: iterative solvers run a job per
    step, and a task per partition in each. While that leaves cores idle, partitions go down to ``least_bytes``."""
    size, cores = n_rows * 8 * (n_cols + 4), df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, -(-size // target_bytes), min(2 * cores, -(-size // least_bytes))))


def prepare(df: DataFrame, label: str, id_col: str, cat_cols=None, num_cols=None, test_size: float = 0.2,
            seed: int = 42, use_smote: bool = True, k_smote: int = 5, checkpoint: bool = True) -> Prepared:
    cats, nums = split_columns_by_type(df, id_col, label)
    cats = list(cat_cols) if cat_cols is not None else cats
    nums = list(num_cols) if num_cols is not None else nums
    feature_cols = [c for c in df.columns if c in set(cats) | set(nums)]  # table order, remembered
    df = encodable(df, cats)
    encoder = PipelineModel(stages=[DictionaryEncoder(cols=cats).fit(df)] if cats else [])
    enc = encoder.transform(df.select(id_col, label, *feature_cols))
    enc = enc.select(id_col, label, *[F.col(c).cast("double").alias(c) for c in feature_cols])
    # a row without a label or with a missing feature can train and test nothing; scoring takes it
    enc = enc.where(F.col(label).isNotNull() & complete_row(feature_cols))
    if checkpoint:  # the cuts and the split read the rows several times: their source is read once
        enc = cut_lineage(enc)
    split = stratified_split(enc, label, id_col, test_size, seed, with_rank=False)
    if checkpoint:
        split = cut_lineage(split)
    train = split.where(F.col("split") == "train").select(id_col, label, *feature_cols)
    test = split.where(F.col("split") == "test").select(id_col, label, *feature_cols)
    train_raw = train
    sizes = split.groupBy(label, "split").agg(F.count(F.lit(1)).alias("n")).collect()  # classes x 2 rows
    before = {r[label]: r["n"] for r in sizes if r["split"] == "train"}
    after = dict(before)
    if use_smote:
        train = smote(train, label, id_col, feature_cols, k_smote, seed, counts=before).drop("is_synthetic")
        if checkpoint:  # the kNN join and synthetic rows are computed once
            train = cut_lineage(_few(train, 2 * sum(before.values()), len(feature_cols)))
        top = max(before.values()) if before else 0
        after = {c: top for c in before}  # SMOTE lifts every class to the largest one
    scaler = PopulationScaler(inputCols=feature_cols).fit(train)
    assembler = VectorAssembler(inputCols=feature_cols, outputCol="features")
    n_test = sum(r["n"] for r in sizes if r["split"] == "test")
    test = _few(test, n_test, len(feature_cols))
    train_s = M.with_class_weights(assembler.transform(scaler.transform(train)), label)
    test_s = assembler.transform(scaler.transform(test))
    return Prepared(train_s, test_s, encoder, scaler, assembler, feature_cols, cats, id_col, label, before, after,
                    train_raw, split.select(id_col, "split"), use_smote, k_smote, seed)


def cross_validate(spec: ModelSpec, train: DataFrame, label: str = "label", id_col: str = "id", k: int = 3,
                   seed: int = 42, scoring: str = "recall", parallelism: int = 3,
                   prep: Prepared | None = None) -> DataFrame:
    """K7: fresh fit per stratified fold; per-fold score rows (model, fold, score).

    Default (as the reference): folds of the resampled, scaled training set.
    With ``prep`` given, folds are cut from the training rows *before* SMOTE
    and each fold's training part is oversampled and scaled on its own, so no
    synthetic point leaks into a validation fold.
    kNN and the step-wise linear models do all folds in one pass (``ModelSpec.fit_folds``); other models' folds are
    fitted concurrently from a small driver thread pool (as MLlib's
    ``CrossValidator(parallelism=...)``); each fit is itself distributed.
    """
    if prep is None and spec.kind in FOLD_AWARE:
        folded = fold_assign(train.drop("weight"), label, id_col, k, seed, with_rank=False)
        _, scored = spec.fit_folds(folded, k, label, id_col)
        return fold_scores(spec.name, scored, label, scoring)
    src = prep.train_raw if prep is not None else train.drop("weight")
    folded = fold_assign(src, label, id_col, k, seed, with_rank=False).persist()

    def one(f: int):
        tr, te = fold_train_test(folded, f)
        if prep is not None:
            feats = prep.feature_cols
            tr = tr.select(id_col, label, *feats)
            if prep.use_smote:
                tr = smote(tr, label, id_col, feats, prep.k_smote, prep.seed).drop("is_synthetic")
            sc = PopulationScaler(inputCols=feats).fit(tr)
            tr = prep.assembler.transform(sc.transform(tr))
            te = prep.assembler.transform(sc.transform(te.select(id_col, label, *feats)))
        fitted = spec.fit(M.with_class_weights(tr, label), label)
        p = fitted.predict(te, label=label).select(F.lit(f).alias("fold"), label, "pred")
        r = M.binary_metrics(p, label, "pred").first()
        return (spec.name, f, float(r[scoring]))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        rows = list(pool.map(one, range(k)))
    folded.unpersist()
    return train.sparkSession.createDataFrame(rows, f"model string, fold int, {scoring} double")


def fold_scores(name: str, scored: DataFrame, label: str, scoring: str) -> DataFrame:
    """(model, fold, score) from rows scored out of their fold, in one aggregate."""
    by_fold = M.binary_metrics(scored.where(F.col("fold").isNotNull()), label, "pred", group_cols=["fold"])
    return by_fold.select(F.lit(name).alias("model"), F.col("fold").cast("int").alias("fold"),
                          F.col(scoring).cast("double").alias(scoring))


@dataclass
class TrainResult:
    comparison: DataFrame
    fold_scores: DataFrame
    predictions: DataFrame
    fitted: dict
    best_name: str
    order: list


def train_and_compare(prep: Prepared, specs: list[ModelSpec], cv_k: int = 3, seed: int = 42,
                      parallelism: int = 4, resample_inside_fold: bool = False) -> TrainResult:
    """CV, fit, predict test, metrics per model; best = max test recall, first on ties.

    Models are trained concurrently (driver threads submitting independent
    Spark jobs); the metric tables are computed in one pass over the union of
    all test predictions.
    """
    spark = prep.train.sparkSession
    label, id_col = prep.label, prep.id_col
    n = prep.train.count()

    folded = fold_assign(prep.train.drop("weight"), label, id_col, cv_k, seed, with_rank=False)
    if any(s.kind in FOLD_AWARE for s in specs) and not resample_inside_fold:
        folded = cut_lineage(folded)

    def one(item):
        i, spec = item
        if spec.kind in FOLD_AWARE and not resample_inside_fold:
            fm, scored = spec.fit_folds(folded, cv_k, label, id_col, prep.test)
            scored = cut_lineage(scored)
            p = scored.where(F.col("fold").isNull()).select(
                F.lit(spec.name).alias("model"), F.lit(i + 1).alias("model_order"), id_col, label, "p", "pred")
            return spec.name, fold_scores(spec.name, scored, label, "recall"), fm, p
        cv = cross_validate(spec, prep.train, label, id_col, cv_k, seed,
                            prep=prep if resample_inside_fold else None)
        fm = spec.fit(prep.train, label, n=n)
        p = fm.predict(prep.test, label=label).select(
            F.lit(spec.name).alias("model"), F.lit(i + 1).alias("model_order"), id_col, label, "p", "pred")
        return spec.name, cv, fm, cut_lineage(p)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(specs)))) as pool:
        done = list(pool.map(one, enumerate(specs)))
    folds, preds, fitted = None, None, {}
    for name, cv, fm, p in done:
        fitted[name] = fm
        folds = cv if folds is None else folds.unionByName(cv)
        preds = p if preds is None else preds.unionByName(p)
    tm = M.binary_metrics(preds, label, "pred", group_cols=["model"])
    au = M.roc_auc(preds, label, "p", group_cols=["model"])
    order = spark.createDataFrame([(s.name, i + 1) for i, s in enumerate(specs)], "model string, model_order int")
    cmp = M.model_comparison(folds, tm, au).join(order, "model")
    best = M.best_model(cmp).first()["model"]
    return TrainResult(cmp, folds, preds, fitted, best, [s.name for s in specs])
