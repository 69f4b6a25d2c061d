"""Linear classifiers by a fixed number of gradient steps.

Each step is one aggregate over the rows: the weights travel as a literal array (so every step has the same plan and
compiled code), each task sums the gradient of its rows, and the driver adds as many numbers as there are features.
The objective, rate and decay are the reference's:

* logistic: weighted log-loss + |w|^2 / (2 C n), rate 0.1 / (1 + 0.01 step)
* hinge:    weighted hinge loss + |w|^2 / (C n), rate 0.01 / (1 + 0.05 step)

All models of a cross-validation are fitted in the same pass: model ``i`` leaves fold ``i`` out, the last one leaves
nothing out, and a row adds to every model but that of its own fold. Weights start from zero, so a fit depends on the
rows alone, and rows are told apart by nothing but their values: no shuffle, no order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import sigmoid

RATES = {"logistic": (0.1, 0.01), "hinge": (0.01, 0.05)}
PLATT_STEPS = 8


@dataclass(frozen=True)
class LinearFit:
    """A linear score: intercept + sum of weight x value; ``left_out`` is the fold it did not see (None: it saw all)."""

    cols: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    left_out: int | None = None

    def score(self) -> Column:
        z = F.lit(float(self.intercept))
        for c, w in zip(self.cols, self.weights, strict=True):
            z = z + F.col(c).cast("double") * F.lit(float(w))
        return z


def _dot(x: Column, weights: Sequence[float]) -> Column:
    """Intercept (the last weight) plus the dot product; the weights are one literal, whatever their values."""
    w = F.array(*[F.lit(float(v)) for v in weights[:-1]])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(weights[-1])), lambda s, v: s + v)


def _usable(df: DataFrame, cols: Sequence[str], label: str, fold_col: str | None, extra: Sequence[str] = ()) -> DataFrame:
    """(y, x, fold): rows with a label; a row with a missing feature can't be scored and is left out."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.where(F.col(label).isNotNull()).select(
        (F.col(label) == 1).cast("double").alias("y"), x.alias("x"),
        (F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")).alias("fold"), *extra)
    return rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _sizes(rows: DataFrame, folds: int, balanced: bool) -> list[tuple[float, float, float]]:
    """(rows, weight of class 0, weight of class 1) of every model: weights n / (classes x rows of the class)."""
    counted = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for left_out in [*range(folds), None]:
        n = [sum(v for (f, y), v in counted.items() if y == c and (left_out is None or f != left_out)) for c in (0.0, 1.0)]
        classes = sum(c > 0 for c in n)
        weight = [sum(n) / (classes * c) if c and balanced else 1.0 for c in n]
        out.append((float(sum(n)), weight[0], weight[1]))
    return out


def descend(df: DataFrame, cols: Sequence[str], label: str, loss: str = "logistic", C: float = 1.0, steps: int = 150,
            balanced: bool = True, fold_col: str | None = None, folds: int = 0) -> list[LinearFit]:
    """One fit per left-out fold 0..folds-1, then one on all rows, by ``steps`` full gradient steps.

    Rows without a label train nothing, nor do rows with a missing feature. Without training rows all weights are 0.
    """
    rows = _usable(df, cols, label, fold_col if folds else None).persist()
    try:
        sizes = _sizes(rows, folds, balanced)
        models = [i if i < folds else None for i in range(folds + 1)]
        weights = [[0.0] * (len(cols) + 1) for _ in models]
        rate, decay = RATES[loss]
        x, y = F.col("x"), F.col("y")
        for step in range(steps):
            errors = []
            for m, (left_out, (_, w0, w1)) in enumerate(zip(models, sizes, strict=True)):
                z, class_weight = _dot(x, weights[m]), F.when(y == 1, F.lit(w1)).otherwise(F.lit(w0))
                if loss == "logistic":
                    e = (sigmoid(z) - y) * class_weight
                else:
                    sign = y * 2 - 1
                    e = F.when(sign * z < 1, -sign * class_weight).otherwise(F.lit(0.0))
                here = F.lit(True) if left_out is None else ~F.col("fold").eqNullSafe(F.lit(left_out))
                errors.append(F.when(here, e).otherwise(F.lit(0.0)).alias(f"e{m}"))
            sums = [F.sum(F.col(f"e{m}") * x[j] if j < len(cols) else F.col(f"e{m}")).alias(f"g{m}_{j}")
                    for m in range(len(models)) for j in range(len(cols) + 1)]
            got = rows.select("x", *errors).agg(*sums).first()
            now = rate / (1.0 + decay * step)
            for m, (n, _, _) in enumerate(sizes):
                if not n:
                    continue
                pull = (1.0 if loss == "logistic" else 2.0) / (C * n)
                for j in range(len(cols) + 1):
                    g = float(got[f"g{m}_{j}"]) / n
                    weights[m][j] -= now * (g + pull * weights[m][j] if j < len(cols) else g)
    finally:
        rows.unpersist()
    return [LinearFit(tuple(cols), tuple(w[:-1]), w[-1], m) for w, m in zip(weights, models, strict=True)]


def platt(df: DataFrame, fits: Sequence[LinearFit], label: str, C: float = 1.0, steps: int = PLATT_STEPS,
          fold_col: str | None = None) -> list[LinearFit]:
    """Each fit with its score replaced by a calibrated one, score' = a (score - mean) / (std + 1e-8) + b.

    Mean and population std are those of the fit's training scores; (a, b) minimise the unweighted log-loss plus
    a^2 / (2 C n) by ``steps`` Newton steps, each of which needs five sums over the rows.
    """
    if not fits:
        return []
    rows = _usable(df, fits[0].cols, label, fold_col).persist()
    try:
        seen = [F.lit(True) if f.left_out is None else ~F.col("fold").eqNullSafe(F.lit(f.left_out)) for f in fits]
        raw = [_dot(F.col("x"), [*f.weights, f.intercept]) for f in fits]
        stats = []
        for m, (here, z) in enumerate(zip(seen, raw, strict=True)):
            z = F.when(here, z)
            stats += [F.count(z).alias(f"n{m}"), F.avg(z).alias(f"m{m}"), F.stddev_pop(z).alias(f"s{m}")]
        st = rows.agg(*stats).first()
        n = [float(st[f"n{m}"]) for m in range(len(fits))]
        mean = [float(st[f"m{m}"] or 0.0) for m in range(len(fits))]
        std = [float(st[f"s{m}"] or 0.0) + 1e-8 for m in range(len(fits))]
        scored = rows.select("y", *[F.when(here, (z - F.lit(mean[m])) / F.lit(std[m])).alias(f"s{m}")
                                    for m, (here, z) in enumerate(zip(seen, raw, strict=True))])
        par = [(0.0, 0.0)] * len(fits)
        for _ in range(steps):
            sums = []
            for m, (a, b) in enumerate(par):
                s = F.col(f"s{m}")
                p = sigmoid(s * F.lit(float(a)) + F.lit(float(b)))
                e, h = p - F.col("y"), p * (1 - p)
                sums += [F.sum(F.when(s.isNotNull(), v)).alias(f"{k}{m}") for k, v in (
                    ("gs", e * s), ("g", e), ("hss", h * s * s), ("hs", h * s), ("h", h))]
            got = scored.agg(*sums).first()
            for m, (a, b) in enumerate(par):
                if not n[m]:
                    continue
                g1, g2 = got[f"gs{m}"] / n[m] + a / (C * n[m]), got[f"g{m}"] / n[m]
                h11, h12, h22 = got[f"hss{m}"] / n[m] + 1.0 / (C * n[m]), got[f"hs{m}"] / n[m], got[f"h{m}"] / n[m]
                det = h11 * h22 - h12 * h12
                if det > 1e-300:
                    par[m] = (a - (h22 * g1 - h12 * g2) / det, b - (h11 * g2 - h12 * g1) / det)
    finally:
        rows.unpersist()
    return [LinearFit(f.cols, tuple(w * a / s for w in f.weights), a * (f.intercept - mu) / s + b, f.left_out)
            for f, (a, b), mu, s in zip(fits, par, mean, std, strict=True)]


def by_fold(fits: Sequence[LinearFit], fold_col: str) -> Column:
    """The score of each row under the fit that left its fold out."""
    z = F.lit(None).cast("double")
    for f in fits:
        if f.left_out is not None:
            z = F.when(F.col(fold_col) == F.lit(f.left_out), f.score()).otherwise(z)
    return z


def fit_table(spark, fits: Sequence[LinearFit]) -> DataFrame:
    """(left_out, feature, weight): the weights of all fits, the intercept as feature ``(intercept)``."""
    rows = [(f.left_out, c, float(w)) for f in fits
            for c, w in zip((*f.cols, "(intercept)"), (*f.weights, f.intercept), strict=True)]
    return spark.createDataFrame(rows, "left_out int, feature string, weight double")
