import duckdb
import numpy as np
from pyspark.sql import functions as F

from riskspark.functions import columns as C


def test_bands_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 3000.0, 3001.0, 6000.0, 10000.0, 20000.0, 20001.0, None]],
                               "x double")
    out = {r.x: r.b for r in df.select("x", C.band("x", C.INCOME_BAND_EDGES, C.INCOME_BAND_LABELS).alias("b"))
           .collect()}
    assert out[0.0] is None and out[3000.0] == "<3K" and out[3001.0] == "3K-6K"
    assert out[6000.0] == "3K-6K" and out[10000.0] == "6K-10K" and out[20000.0] == ">10K"
    assert out[20001.0] is None and out[None] is None


def test_risk_levels_and_labels(spark):
    ps = [0.0, 0.35, 0.3500001, 0.55, 0.6, 0.65, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    pred = C.predict_at("p")
    rows = df.select("p", C.risk_level("p").alias("lvl"), C.risk_label("p").alias("lab"), pred.alias("pred"),
                     C.action_tier("p", pred).alias("act")).collect()
    got = {r.p: (r.lvl, r.lab, r.pred, r.act) for r in rows}
    assert got[0.0] == (None, "LOW RISK", 0, "retain")          # p = 0 has no level
    assert got[0.35] == ("Low", "LOW RISK", 1, "medium")       # inclusive decision at .35
    assert got[0.55][0] == "Medium" and got[0.6][1] == "MEDIUM RISK"
    assert got[0.65] == ("High", "HIGH RISK", 1, "medium")     # strict > .65 for the high tier
    assert got[1.0] == ("High", "HIGH RISK", 1, "high")


def test_pct_half_even_matches_numpy(spark):
    rng = np.random.default_rng(0)
    ps = list(rng.random(2000)) + [0.1235, 0.0005, 0.2225, 0.9995]
    df = spark.createDataFrame([(float(p),) for p in ps], "p double")
    got = [r[0] for r in df.select(C.pct_1dp("p")).collect()]
    assert np.array_equal(np.array(got), np.round(np.array(ps) * 100, 1))


def test_severity_strict(spark):
    df = spark.createDataFrame([(20.0,), (20.01,), (14.0,), (14.5,)], "r double")
    got = [r[0] for r in df.select(C.severity("r", 20.0, 14.0)).collect()]
    assert got == ["medium", "high", "low", "medium"]


def test_hash_uniform_equals_duckdb(spark):
    df = spark.range(0, 300).select(F.col("id"), C.hash_uniform(42, "p", F.col("id")).alias("u"))
    got = {r.id: r.u for r in df.collect()}
    ref = duckdb.sql("SELECT i, CAST(('0x' || substr(md5('42:p:' || CAST(i AS VARCHAR)), 1, 13))::BIGINT AS DOUBLE)"
                     " / CAST(4503599627370496 AS DOUBLE) FROM range(300) t(i)").fetchall()
    assert all(got[i] == u for i, u in ref)
    assert all(0.0 <= u < 1.0 for u in got.values())
