"""Model explanations as DataFrames.

Importances and coefficients are per-feature tables (bounded by the feature
count); per-row contributions are computed JVM-side for every row with array
functions (no explode before the top-k cut).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import driver_direction


def feature_importance(spark: SparkSession, model, feature_cols: Sequence[str]) -> DataFrame:
    """(feature, importance) from a tree ensemble's normalised importances."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feature_cols, imp)],
                                 "feature string, importance double")


def importance_tier(fi: DataFrame, value_col: str = "importance", key_col: str = "feature",
                    top_n: int = 15) -> DataFrame:
    """F2 + B14: keep the top ``top_n`` by value; > q75 high, > q50 medium, else low (over the kept rows).

    The kept table has at most ``top_n`` rows, so its quantiles are a
    single-row aggregate over a bounded input.
    """
    kept = fi.orderBy(F.col(value_col).desc(), F.col(key_col).asc()).limit(top_n)
    whole = Window.partitionBy()  # over the kept rows only (at most top_n)
    j = (kept.withColumn("_q75", F.percentile(value_col, 0.75).over(whole))
             .withColumn("_q50", F.percentile(value_col, 0.5).over(whole)))
    tier = (F.when(F.col(value_col) > F.col("_q75"), F.lit("high"))
            .when(F.col(value_col) > F.col("_q50"), F.lit("medium")).otherwise(F.lit("low")))
    return j.select(key_col, value_col, tier.alias("tier"))


def coefficient_table(spark: SparkSession, model, feature_cols: Sequence[str], top_n: int = 10) -> DataFrame:
    """K15 + F3 + B15: per-feature weight of a linear model, top ``top_n`` by |weight|.

    Each feature gets its own coefficient (the reference shows one scalar for
    all features; the evident intent is kept).
    """
    coef = model.coefficients.toArray().tolist()
    df = spark.createDataFrame([(f, float(w)) for f, w in zip(feature_cols, coef)], "feature string, weight double")
    return top_abs(df, "weight", top_n, "feature")


def top_abs(df: DataFrame, col: str, n: int, key_col: str) -> DataFrame:
    """largest |col| first (ties by key), with the B15 direction."""
    return (df.withColumn("abs_" + col, F.abs(F.col(col)))
              .orderBy(F.col("abs_" + col).desc(), F.col(key_col).asc()).limit(n)
              .withColumn("direction", driver_direction(col)))


def row_contributions(df: DataFrame, weights: dict, id_col: str, top_n: int = 6) -> DataFrame:
    """contribution = weight x (scaled) value, top ``top_n`` by |contribution| for every row.

    Output (id, position 1..top_n, feature, contribution, direction). The
    ranking happens inside each row (array sort + slice), so rows are
    independent and the work is narrow.
    """
    items = [F.struct(F.lit(f).alias("feature"), (F.col(f).cast("double") * F.lit(float(w))).alias("contribution"))
             for f, w in weights.items()]
    arr = F.array(*items)

    def cmp(a: Column, b: Column) -> Column:
        ka, kb = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (F.when(ka > kb, F.lit(-1)).when(ka < kb, F.lit(1))
                .when(a["feature"] < b["feature"], F.lit(-1)).when(a["feature"] > b["feature"], F.lit(1))
                .otherwise(F.lit(0)))

    top = F.slice(F.array_sort(arr, cmp), 1, top_n)
    out = df.select(F.col(id_col), F.posexplode(top).alias("pos", "c"))
    return out.select(id_col, (F.col("pos") + 1).cast("int").alias("position"), F.col("c.feature").alias("feature"),
                      F.col("c.contribution").alias("contribution"),
                      driver_direction(F.col("c.contribution")).alias("direction"))


def correlation_weights(df: DataFrame, feature_cols: Sequence[str], label: str) -> dict:
    """Pearson correlation of each feature with the label (one aggregate): a data-derived weight table."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c)
                   for c in feature_cols]).first()
    return {c: float(row[c] or 0.0) for c in feature_cols}
