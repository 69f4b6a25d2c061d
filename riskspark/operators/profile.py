"""Profiling and outcome-rate aggregations (D1-D10, D4 banding, F1).

All group-bys are single-key hash aggregates with map-side partial
aggregation, so a key holding a third of the rows is pre-combined in every
task before the shuffle. Null group keys are dropped (pandas ``groupby``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import band, band_index, severity
from riskspark.operators.rank import prefix_sums
from riskspark.session import cut_lineage


def label_summary(df: DataFrame, label: str, n_meta_cols: int = 2) -> DataFrame:
    """N, positives, negatives, positive rate %, feature count (= columns - id - label)."""
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("positives"),
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("negatives"),
        (F.avg(y.cast("double")) * F.lit(100.0)).alias("rate_pct"),
    ).withColumn("n_features", F.lit(len(df.columns) - n_meta_cols))


def rate_by_group(df: DataFrame, key: str, label: str, high: float | None = None,
                  mid: float | None = None, sort_by_rate: bool = False) -> DataFrame:
    """D2 (+B12 severity, F1 order): 100*mean(label) per non-null key."""
    out = (df.where(F.col(key).isNotNull())
             .groupBy(key)
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col(label)).cast("long").alias("positives"),
                  (F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("rate_pct")))
    if high is not None:
        out = out.withColumn("severity", severity("rate_pct", high, mid))
    if sort_by_rate:
        out = out.orderBy(F.col("rate_pct").asc(), F.col(key).asc())
    return out


def rate_by_scores(df: DataFrame, score_cols: Sequence[str], label: str, high: float = 20.0,
                   mid: float = 12.0) -> DataFrame:
    """D3: rate per (metric, score) for several ordinal columns in one pass.

    Absent columns are skipped; the metric name travels with its column.
    ``unpivot`` is a narrow Expand, then one aggregate over all metrics.
    """
    cols = [c for c in score_cols if c in df.columns]
    long = df.select(F.col(label), *[F.col(c).cast("long").alias(c) for c in cols]).unpivot(
        [label], cols, "metric", "score")
    return (long.where(F.col("score").isNotNull())
                .groupBy("metric", "score")
                .agg(F.count(F.lit(1)).alias("n"),
                     (F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("rate_pct"))
                .withColumn("severity", severity("rate_pct", high, mid)))


def rate_by_band(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], label: str,
                 high: float = 20.0, mid: float = 12.0) -> DataFrame:
    """Right-closed bands then D2; out-of-band rows and empty bands dropped.

    The outer edges are also stated as a plain range predicate so Catalyst can
    push it to the scan (parquet min/max skipping); the CASE bands alone are
    opaque to pushdown.
    """
    df = df.where((F.col(col) > F.lit(edges[0])) & (F.col(col) <= F.lit(edges[-1])))
    banded = df.select(band(col, edges, labels).alias("band"), band_index(col, edges).alias("band_no"),
                       F.col(label))
    return (banded.where(F.col("band").isNotNull())
                  .groupBy("band_no", "band")
                  .agg(F.count(F.lit(1)).alias("n"),
                       (F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("rate_pct"))
                  .withColumn("severity", severity("rate_pct", high, mid)))


def class_histogram(df: DataFrame, col: str, bins: int, label: str | None = None) -> DataFrame:
    """Equal-width histogram, each class over its own [min, max].

    Left-closed bins, the last bin closed (``np.histogram``). When min == max
    the range widens to +-0.5 like NumPy. Empty bins are emitted with n = 0.
    Output: (label?, bin 1..bins, bin_lo, bin_hi, n).
    """
    keys = [label] if label else []
    x = F.col(col).cast("double")
    data = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull())
    lo_expr = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi_expr = F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    rng = (data.groupBy(*keys).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
               .select(*keys, lo_expr.alias("_lo"), hi_expr.alias("_hi")))
    grid = rng
    if label:
        from riskspark.operators.rank import join_null_safe
        b = join_null_safe(data, rng, keys)  # one row per class; the planner decides how
    else:
        # one range: a scalar subquery, so nothing runs before the result is asked for
        span = rng.select(F.struct("_lo", "_hi")).scalar()
        b = data.withColumn("_span", span).select("_x", F.col("_span._lo").alias("_lo"), F.col("_span._hi").alias("_hi"))
        grid = rng.where(F.col("_lo").isNotNull())
    pos = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))) + F.lit(1)
    counts = (b.select(*keys, F.least(F.lit(bins), pos).cast("int").alias("bin"))
               .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = grid.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (grid.join(counts, on=keys + ["bin"], how="left")
                .select(*keys, "bin",
                        (F.col("_lo") + (F.col("bin") - 1).cast("double") * width).alias("bin_lo"),
                        (F.col("_lo") + F.col("bin").cast("double") * width).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Count and % per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the per-class table only (bounded)
    return counts.withColumn("pct", F.col("n").cast("double") * F.lit(100.0) / total)


def level_counts(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Counts in a fixed level order; absent levels -> 0; null/unlisted values ignored."""
    spark = df.sparkSession
    lv = spark.createDataFrame([(i + 1, v) for i, v in enumerate(levels)], f"ordinal int, {col} string")
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(lv).join(counts, on=[col], how="left")
             .select("ordinal", col, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


# ---------------------------------------------------------------- exact quantiles

def _bucketizer(cut_map: dict):
    """Arrow-batch bucket number = count of cut points below the value (vectorised searchsorted)."""

    def run(batches):
        for pdf in batches:
            b = np.zeros(len(pdf), dtype=np.int32)
            for col, idx in pdf.groupby("column").groups.items():
                cuts = cut_map.get(col, np.zeros(0))
                b[pdf.index.get_indexer(idx)] = np.searchsorted(cuts, pdf.loc[idx, "value"].to_numpy(), side="left")
            yield pdf.assign(_bkt=b)

    return run


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                      n_buckets: int = 1024, accuracy: int = 10000) -> DataFrame:
    """Exact linear-interpolated percentiles (NumPy/pandas 'linear'), distributed.

    A sketch of every column (``percentile_approx``) gives a bracket of values around each wanted rank. One pass counts
    the values below each bracket and keeps, as (value, count), those inside: some ``10 / accuracy`` of a column. The
    rank is then exact within the bracket, found over value ranges in parallel. A bracket that turns out not to hold
    its ranks is taken anew over the whole column, so the sketch decides the work only, never the result.
    Columns without values give no rows. Output: (column, prob, value).
    """
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
    try:
        return _exact_percentiles(num, _sketch(num, cols, probs, accuracy), cols, probs, n_buckets, accuracy)
    finally:
        num.unpersist()


def _sketch(num: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int):
    """One row: per column its count, moments and the values around each wanted rank, in one scan."""
    around = [min(1.0, max(0.0, p + m)) for p in probs for m in (-4 / accuracy, 4 / accuracy)]
    return num.agg(*[F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.max(c).alias("max"), F.percentile_approx(c, around, accuracy).alias("at")).alias(c) for c in cols]).first()


def _exact_percentiles(num: DataFrame, sketch, cols, probs, n_buckets: int, accuracy: int) -> DataFrame:
    spark = num.sparkSession
    slots = {}  # one per column and wanted percentile
    for c in cols:
        n = sketch[c]["n"]
        for i, p in enumerate(probs if n else []):
            pos = p * (n - 1)
            # a column of few values is its own bracket
            lo, hi = sketch[c]["at"][2 * i:2 * i + 2] if n > accuracy else (sketch[c]["min"], sketch[c]["max"])
            slots[len(slots)] = (c, float(p), pos, math.floor(pos), math.ceil(pos), lo, hi)
    if not slots:
        return spark.createDataFrame([], "column string, prob double, value double")

    def gather(brackets: dict) -> tuple[DataFrame, dict]:
        """(slot, value, c) of the values inside each bracket, and the counts {slot: (below, inside)}.

        Values outside all brackets, nearly all, are only counted: they leave no row.
        """
        inside = {i: (F.col(c) >= lo) & (F.col(c) <= hi) for i, (c, lo, hi) in brackets.items()}
        counted = num.agg(*[F.count_if(F.col(c) < lo).alias(f"b{i}") for i, (c, lo, _) in brackets.items()],
                          *[F.count_if(x).alias(f"i{i}") for i, x in inside.items()]).first()
        cells = F.filter(F.array(*[F.when(x, F.struct(F.lit(i).alias("slot"), F.col(brackets[i][0]).alias("value")))
                                   for i, x in inside.items()]), lambda s: s.isNotNull())
        long = num.select(F.explode(cells).alias("s")).select("s.*")
        vals = cut_lineage(long.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("c")))
        return vals, {i: (counted[f"b{i}"], counted[f"i{i}"]) for i in brackets}

    vals, n = gather({i: (c, F.lit(lo), F.lit(hi)) for i, (c, _, _, _, _, lo, hi) in slots.items()})
    missed = [i for i, (_, _, _, r_lo, r_hi, _, _) in slots.items() if not n[i][0] <= r_lo <= r_hi < sum(n[i])]
    if missed:
        rest, n_rest = gather({i: (slots[i][0], F.lit(-math.inf), F.lit(math.nan)) for i in missed})  # NaN sorts last
        vals = vals.where(~F.col("slot").isin(missed)).unionByName(rest)
        n |= n_rest
    inside = vals.select(F.col("slot").alias("column"), "value", "c")
    cuts = [i / n_buckets for i in range(1, n_buckets)]
    # bounded: one sorted array of n_buckets - 1 cut points per slot
    cut_map = {r["column"]: np.asarray(r["_cuts"], dtype=np.float64) for r in inside.groupBy("column").agg(
        F.percentile_approx("value", cuts, accuracy).alias("_cuts")).collect()}
    bv = inside.mapInPandas(_bucketizer(cut_map), "column int, value double, c long, _bkt int")
    cum = prefix_sums(bv, ["column"], F.col("_bkt"), [F.col("value")], ["c"]).withColumnRenamed("column", "slot")
    targets = spark.createDataFrame(
        [(i, c, p, pos - r_lo, r_lo - n[i][0], r_hi - n[i][0])
         for i, (c, p, pos, r_lo, r_hi, _, _) in slots.items()],
        "slot int, column string, prob double, _part double, _lo long, _hi long")

    def at(rank: str):  # the row with cum_c - c <= r < cum_c holds rank r
        return F.max(F.when((F.col("cum_c") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("cum_c")),
                            F.col("value")))

    return (cum.join(F.broadcast(targets), "slot").groupBy("slot", "column", "prob", "_part")
               .agg(at("_lo").alias("_v_lo"), at("_hi").alias("_v_hi"))
               .select("column", "prob", (F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * F.col("_part"))
                       .alias("value")))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, decimals: int | None = 1) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (exact, linear), max per numeric column.

    Output is long-form: one row per column.
    """
    if cols is None:
        cols = [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")
                or t.startswith("decimal")]
    cols = list(cols)
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
    probs = [0.25, 0.5, 0.75]
    try:
        sketch = _sketch(num, cols, probs, 10000)
        q = _exact_percentiles(num, sketch, cols, probs, 1024, 10000)
    finally:
        num.unpersist()
    stats = df.sparkSession.createDataFrame(
        [(c, *[sketch[c][k] for k in ("n", "mean", "std", "min", "max")]) for c in cols],
        "column string, count long, mean double, std double, min double, max double")  # a row a column
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("p25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("p75"))
    out = stats.join(qw, on="column", how="left")
    out = out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    if decimals is not None:
        for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]:
            out = out.withColumn(c, F.bround(F.col(c), decimals))
    return out
