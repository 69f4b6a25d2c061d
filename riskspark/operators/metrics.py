"""Evaluation metrics as DataFrames.

Every metric is one distributed aggregate (or a per-score pre-aggregate plus
bucket-parallel prefix sums for the ROC curve); nothing is collected row-wise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import pct_1dp, safe_div
from riskspark.operators.rank import BROADCAST_CLASSES, join_null_safe, prefix_sums
from riskspark.session import cut_lineage

ROC_START_THRESHOLD = 1.01  # fixed value: first threshold of the curve
ROC_BUCKETS = 256
SPREAD_ROWS = 100_000  # from so many rows on, a join by class leaves them in their partitions


def class_weights(df: DataFrame, label: str, balanced: bool = True) -> DataFrame:
    """N / (K * n_c) per class ('balanced'), else 1. Output (label, n, weight); null labels are no class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # per-class table only: bounded by the number of classes
    if not balanced:
        return counts.withColumn("weight", F.lit(1.0))
    return counts.withColumn(
        "weight", F.sum("n").over(w).cast("double") / (F.count(F.lit(1)).over(w) * F.col("n")).cast("double"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight", balanced: bool = True) -> DataFrame:
    """Attach D12 weights as a column; a row without a label stays, with a null weight.

    From ``SPREAD_ROWS`` rows on, a small class table is broadcast, so that rows stay in their partitions: dealt out by the
    label, they would be in as many tasks as there are classes. Fewer rows are joined as the planner likes.
    """
    cw = class_weights(df, label, balanced).select(label, F.col("weight").alias(weight_col), F.col("n").alias("_n"))
    kept = cut_lineage(cw)
    classes, rows = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if rows >= SPREAD_ROWS and classes <= BROADCAST_CLASSES:
        return df.join(F.broadcast(kept.drop("_n")), on=[label], how="left")
    return df.join(cw.drop("_n"), on=[label], how="left")


def confusion_matrix(df: DataFrame, y: str, pred: str, labels: Sequence[int] | None = None,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Square matrix over the union of labels, zero cells kept, rows = actual; one matrix per group.

    The grid comes from the (actual, predicted) count table, so the rows are scanned once.
    """
    g = list(group_cols) or ["_all"]  # one group, so that the grid is an equi-join too
    rows = df if group_cols else df.withColumn("_all", F.lit(0))
    counts = cut_lineage(rows.groupBy(*g, F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")))
    if labels is None:
        lab = (counts.select(*g, F.explode(F.array("actual", "predicted")).alias("v")).where(F.col("v").isNotNull())
               .distinct())
    else:
        lab = counts.select(*g).distinct().withColumn("v", F.explode(F.array(*[F.lit(v) for v in labels])))
    grid = lab.select(*g, F.col("v").alias("actual")).join(lab.select(*g, F.col("v").alias("predicted")), g)
    return (grid.join(counts, [*g, "actual", "predicted"], "left")
            .select(*group_cols, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def binary_metrics(df: DataFrame, y: str, pred: str, pos: int = 1, group_cols: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 for ``pos``; 0 when a denominator is 0."""
    actual, said = F.col(y) == pos, F.col(pred) == pos
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("_correct"),
        F.count_if(actual & said).alias("tp"), F.count_if(said & ~actual).alias("fp"),
        F.count_if(actual & ~said).alias("fn"))
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = (agg.withColumn("accuracy", safe_div(F.col("_correct"), F.col("n")))
              .withColumn("precision", prec)
              .withColumn("recall", rec))
    out = out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    return out.select(*group_cols, "n", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                      F.col("fn").cast("long").alias("fn"), "accuracy", "precision", "recall", "f1")


def classification_report(df: DataFrame, y: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per true class precision/recall/F1/support plus an accuracy row.

    Output (cls string, precision, recall, f1, support). Classes are the
    distinct values of ``y``. One (actual, predicted) count table (at most
    |labels|^2 rows) is expanded into per-class contributions, so the data is
    scanned once and no join is needed. ``group_cols`` gives one report per group.
    """
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(y).alias("a"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("a") == F.col("p")
    contrib = counts.select(*g, F.explode(F.array(
        F.struct(F.col("a").alias("cls"), F.col("n").alias("support"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )).alias("c")).select(*g, "c.*")
    per = (contrib.where(F.col("cls").isNotNull()).groupBy(*g, "cls")
                  .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                       F.sum("support").alias("support"))
                  .where(F.col("support") > 0))
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    per = per.select(*g, F.col("cls").cast("string").alias("cls"), prec.alias("precision"), rec.alias("recall"),
                     F.col("support").cast("long").alias("support"))
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2.0 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    acc = counts.groupBy(*g).agg(
        F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        F.sum("n").cast("long").alias("support"),
        safe_div(F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)), F.sum("n")).alias("f1"))
    cols = [*g, "cls", "precision", "recall", "f1", "support"]
    return per.select(*cols).unionByName(acc.select(*cols))


def _score_table(df: DataFrame, y: str, score: str, group_cols: Sequence[str]) -> DataFrame:
    """Pre-aggregate by distinct score: (group, score, tp_s, fp_s) - partial agg absorbs hot scores.

    Rows without a score have no place on the curve and take no part; ``null_scores`` counts them.
    """
    return (df.where(F.col(score).isNotNull()).groupBy(*group_cols, F.col(score).cast("double").alias("score"))
              .agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("tp_s"),
                   F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("long").alias("fp_s")))


def _grouped(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Give ungrouped inputs a constant key so every join below is an equi-join."""
    if group_cols:
        return df, list(group_cols), list(group_cols)
    return df.withColumn("_g", F.lit(0)), ["_g"], []


def _roc_cumulative(df: DataFrame, y: str, score: str, gcols: list[str], n_buckets: int):
    # The per-score table (distinct scores, far smaller than the rows) feeds
    # several branches; materialise it once so the input is scanned once.
    st = cut_lineage(_score_table(df, y, score, gcols))
    totals = st.groupBy(*gcols).agg(F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"))
    # cuts at quantiles of the distinct scores, so that scores in a narrow range spread over all buckets too;
    # the array has n_buckets numbers whatever the input, and its exactness only matters for balance
    cuts = st.agg(F.percentile_approx("score", [i / n_buckets for i in range(1, n_buckets)], 10 * n_buckets)
                  .alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    edges = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    bucket = -F.size(F.filter(edges, lambda e: e <= F.col("score")))
    cum = prefix_sums(st, gcols, bucket, [F.col("score").desc()], ["tp_s", "fp_s"])
    return st, totals, join_null_safe(cum, totals, gcols)


def null_scores(df: DataFrame, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows without a score, per group: those that the ROC curve leaves out."""
    return df.groupBy(*group_cols).agg(F.count(F.when(F.col(score).isNull(), 1)).alias("null_scores"))


def roc_curve(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
              n_buckets: int = ROC_BUCKETS) -> DataFrame:
    """(threshold, fpr, tpr, tp, fp) for threshold 1.01, every distinct score (desc), then (1, 1).

    The point (0, 0) before the first threshold is implied (it repeats the
    1.01 point for probability scores). A rate is 0 when its class is absent.
    Cumulative counts use bucket-parallel prefix sums over score ranges
    cut at quantiles of the distinct scores, so a narrow range of scores is spread as well.
    The closing (1, 1) row has a null threshold.
    """
    df, gcols, out_cols = _grouped(df, group_cols)
    st, totals, pts = _roc_cumulative(df, y, score, gcols, n_buckets)
    pts = pts.select(*gcols, F.col("score").alias("threshold"), F.col("cum_tp_s").alias("tp"),
                     F.col("cum_fp_s").alias("fp"), "P", "N")
    start = st.where(F.col("score") >= ROC_START_THRESHOLD).groupBy(*gcols).agg(
        F.sum("tp_s").alias("tp"), F.sum("fp_s").alias("fp"))
    start = totals.join(start, on=gcols, how="left").select(
        *gcols, F.lit(ROC_START_THRESHOLD).alias("threshold"),
        F.coalesce(F.col("tp"), F.lit(0)).alias("tp"), F.coalesce(F.col("fp"), F.lit(0)).alias("fp"), "P", "N")
    end = totals.select(*gcols, F.lit(None).cast("double").alias("threshold"),
                        F.col("P").alias("tp"), F.col("N").alias("fp"), "P", "N")
    allp = start.unionByName(pts).unionByName(end)
    return allp.select(
        *out_cols, "threshold",
        F.when(F.col("threshold").isNull(), F.lit(1.0)).otherwise(safe_div(F.col("fp"), F.col("N"))).alias("fpr"),
        F.when(F.col("threshold").isNull(), F.lit(1.0)).otherwise(safe_div(F.col("tp"), F.col("P"))).alias("tpr"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


def roc_auc(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
            n_buckets: int = ROC_BUCKETS) -> DataFrame:
    """Trapezoid area under the E3 curve (ties count one half), exact.

    Each distinct score contributes (fpr_s - fpr_prev) * (tpr_s + tpr_prev) / 2;
    the closing segment to (1, 1) is added per group. One distributed sum.
    """
    df, gcols, out_cols = _grouped(df, group_cols)
    _, totals, j = _roc_cumulative(df, y, score, gcols, n_buckets)
    fpr = safe_div(F.col("cum_fp_s"), F.col("N"))
    tpr = safe_div(F.col("cum_tp_s"), F.col("P"))
    fpr0 = safe_div(F.col("cum_fp_s") - F.col("fp_s"), F.col("N"))
    tpr0 = safe_div(F.col("cum_tp_s") - F.col("tp_s"), F.col("P"))
    pieces = j.groupBy(*gcols).agg(F.sum((fpr - fpr0) * (tpr + tpr0) / F.lit(2.0)).alias("_area"))
    last_f = F.when(F.col("N") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    last_t = F.when(F.col("P") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    close = (F.lit(1.0) - last_f) * (last_t + F.lit(1.0)) / F.lit(2.0)
    out = totals.join(pieces, on=gcols, how="left")
    return out.select(*out_cols, (F.coalesce(F.col("_area"), F.lit(0.0)) + close).alias("roc_auc"),
                      F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"))


def cv_summary(fold_scores: DataFrame, model_col: str = "model", score_col: str = "recall") -> DataFrame:
    """Mean and population std of per-fold scores per model."""
    return fold_scores.groupBy(model_col).agg(
        F.avg(score_col).alias("cv_mean"), F.stddev_pop(score_col).alias("cv_std"),
        F.count(F.lit(1)).alias("n_folds"))


def at_risk_summary(scored: DataFrame, p: str, threshold: float, label: str | None = None,
                    pct_col: str | None = None) -> DataFrame:
    """N at risk (unrounded p >= t), % of all, mean rounded %, actual positives, threshold."""
    pc = F.col(p)
    rounded = F.col(pct_col) if pct_col else pct_1dp(pc)
    risk = pc >= F.lit(threshold)
    aggs = [F.count(F.lit(1)).alias("n_total"),
            F.sum(F.when(risk, 1).otherwise(0)).cast("long").alias("n_at_risk"),
            F.avg(F.when(risk, rounded)).alias("avg_risk_pct")]
    if label:
        aggs.append(F.sum(F.when(risk, F.col(label)).otherwise(0)).cast("long").alias("actual_positives"))
    out = scored.agg(*aggs)
    return (out.withColumn("pct_of_total", safe_div(F.col("n_at_risk") * 100.0, F.col("n_total")))
               .withColumn("threshold", F.lit(float(threshold))))


def model_comparison(fold_scores: DataFrame, test_metrics: DataFrame, aucs: DataFrame,
                     model_col: str = "model") -> DataFrame:
    """Model x (cv mean/std, accuracy, recall, precision, f1, roc_auc)."""
    cv = cv_summary(fold_scores, model_col)
    return (test_metrics.select(model_col, "accuracy", "recall", "precision", "f1")
            .join(cv.select(model_col, "cv_mean", "cv_std"), on=model_col, how="left")
            .join(aucs.select(model_col, "roc_auc"), on=model_col, how="left"))


def best_model(comparison: DataFrame, order_col: str = "model_order", model_col: str = "model",
               metric: str = "recall") -> DataFrame:
    """Highest test recall; the first in training order wins ties (TakeOrdered, 1 row)."""
    return comparison.orderBy(F.col(metric).desc(), F.col(order_col).asc()).limit(1).select(
        model_col, metric, order_col)
