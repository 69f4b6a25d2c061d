import numpy as np
import pandas as pd
import pytest

from riskspark.operators import profile as P


def test_rate_by_group_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 0)], "g string, y int")
    got = {r.g: (r.n, r.rate_pct) for r in P.rate_by_group(df, "g", "y").collect()}
    assert got == {"a": (2, 50.0), "b": (1, 0.0)}


@pytest.mark.parametrize("bins", [5, 30])
def test_class_histogram_matches_numpy(spark, bins):
    rng = np.random.default_rng(1)
    x0 = rng.integers(1000, 20000, 300).astype(float)
    x1 = np.concatenate([rng.normal(5000, 800, 50), [20000.0]])
    rows = [(float(v), 0) for v in x0] + [(float(v), 1) for v in x1] + [(7.0, 2)] * 4  # class 2: lo == hi
    df = spark.createDataFrame(rows, "x double, y int")
    out = P.class_histogram(df, "x", bins, "y").toPandas()
    for cls, xs in [(0, x0), (1, x1), (2, np.array([7.0] * 4))]:
        counts, _ = np.histogram(xs, bins=bins)
        got = out[out.y == cls].sort_values("bin")["n"].to_numpy()
        assert np.array_equal(got, counts), cls
    assert len(out) == 3 * bins  # empty bins kept


def test_exact_percentiles_with_hot_value(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(1600, 0.25), rng.integers(0, 5, 200).astype(float)])
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": x[::-1] * 3}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = P.exact_percentiles(df, ["a", "b"], probs, n_buckets=16).toPandas()
    for col, arr in [("a", x), ("b", x[::-1] * 3)]:
        for p in probs:
            got = out[(out.column == col) & (out.prob == p)]["value"].iloc[0]
            assert got == pytest.approx(np.percentile(arr, p * 100), abs=1e-12)


def test_exact_percentiles_of_sparse_and_empty_columns(spark):
    few = [float(v) for v in np.random.default_rng(4).permutation(10)]
    rows = [(few[i // 100] if i % 100 == 0 else None, None, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["column"], r["prob"]): r["value"] for r in P.exact_percentiles(df, ["a", "b", "c"], [0.25, 0.5]).collect()}
    assert got == {("a", 0.25): 2.25, ("a", 0.5): 4.5, ("c", 0.25): 249.75, ("c", 0.5): 499.5}
    assert P.exact_percentiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_describe_numeric_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 100, 500), "b": rng.normal(10, 3, 500), "c": np.ones(500)})
    out = P.describe_numeric(spark.createDataFrame(pdf)).toPandas().set_index("column")
    ref = pdf.describe().round(1)
    for c in pdf.columns:
        assert out.loc[c, "count"] == ref.loc["count", c]
        for k, rk in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                      ("p75", "75%"), ("max", "max")]:
            assert out.loc[c, k] == pytest.approx(ref.loc[rk, c], abs=1e-9), (c, k)


def test_level_counts_keeps_missing_levels(spark):
    df = spark.createDataFrame([("High",), ("High",), (None,)], "lvl string")
    got = [(r.ordinal, r.lvl, r.n) for r in P.level_counts(df, "lvl", ["High", "Medium", "Low"]).orderBy("ordinal")
           .collect()]
    assert got == [(1, "High", 2), (2, "Medium", 0), (3, "Low", 0)]
