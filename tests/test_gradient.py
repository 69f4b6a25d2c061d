"""Gradient steps and Platt scaling against plain NumPy loops, one model per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators.gradient import by_fold, descend, fit_table, platt


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (240, 3))
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - x[:, 1] - 1)))).astype(int)
    fold = np.arange(240) % 3
    rows = [(i, int(y[i]), int(fold[i]), *map(float, x[i])) for i in range(240)]
    rows += [(900, None, 0, 1.0, 1.0, 1.0), (901, 1, 1, None, 0.0, 0.0), (902, 0, 2, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, label int, fold int, a double, b double, c double")
    return df, x, y, fold


def plain(x, y, loss, steps, C=1.0):
    n, d = x.shape
    weight = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    w, b = np.zeros(d), 0.0
    for step in range(steps):
        z = x @ w + b
        if loss == "logistic":
            e, pull, rate = (1 / (1 + np.exp(-z)) - y) * weight, 1 / (C * n), 0.1 / (1 + 0.01 * step)
        else:
            s = 2 * y - 1
            e, pull, rate = np.where(s * z < 1, -s * weight, 0.0), 2 / (C * n), 0.01 / (1 + 0.05 * step)
        w, b = w - rate * (x.T @ e / n + pull * w), b - rate * e.mean()
    return w, b


@pytest.mark.parametrize("loss,C", [("logistic", 1.0), ("hinge", 0.2)])
def test_every_fold_is_fitted_in_one_pass(points, loss, C):
    df, x, y, fold = points
    fits = descend(df, ["a", "b", "c"], "label", loss, C=C, steps=12, fold_col="fold", folds=3)
    assert [f.left_out for f in fits] == [0, 1, 2, None]
    for f in fits:
        own = np.ones(len(y), dtype=bool) if f.left_out is None else fold != f.left_out
        w, b = plain(x[own], y[own], loss, 12, C)
        assert np.allclose(f.weights, w, atol=1e-12) and f.intercept == pytest.approx(b, abs=1e-12)
    alone = descend(df, ["a", "b", "c"], "label", loss, C=C, steps=12)
    assert len(alone) == 1 and np.allclose(alone[0].weights, fits[-1].weights)


def test_platt_is_at_its_optimum(points):
    df, x, y, fold = points
    fits = descend(df, ["a", "b", "c"], "label", "hinge", steps=20, fold_col="fold", folds=3)
    for f, g in zip(fits, platt(df, fits, "label", fold_col="fold"), strict=True):
        own = np.ones(len(y), dtype=bool) if f.left_out is None else fold != f.left_out
        z = x[own] @ np.array(f.weights) + f.intercept
        s = (z - z.mean()) / (z.std() + 1e-8)
        a = g.weights[0] / f.weights[0] * (z.std() + 1e-8)
        b = g.intercept - a * (f.intercept - z.mean()) / (z.std() + 1e-8)
        p = 1 / (1 + np.exp(-(a * s + b)))
        assert abs(((p - y[own]) * s).mean() + a / own.sum()) < 1e-9 and abs((p - y[own]).mean()) < 1e-9


def test_scores_by_fold_and_table(spark, points):
    df, x, _, fold = points
    fits = descend(df, ["a", "b", "c"], "label", steps=3, fold_col="fold", folds=3)
    got = {r["id"]: r["z"] for r in df.where("id < 240").select("id", by_fold(fits, "fold").alias("z")).collect()}
    for i in range(240):
        f = fits[fold[i]]
        assert got[i] == pytest.approx(float(x[i] @ np.array(f.weights) + f.intercept), abs=1e-12)
    assert fit_table(spark, fits).where(F.col("feature") == "(intercept)").count() == 4


def test_no_rows_and_one_class(spark, points):
    df = points[0]
    none = descend(df.where("id < 0"), ["a", "b", "c"], "label", steps=2)[0]
    assert none.weights == (0.0, 0.0, 0.0) and none.intercept == 0.0
    one = descend(df.where("label = 1"), ["a", "b", "c"], "label", steps=2)[0]
    assert one.intercept > 0
