from pyspark.sql import functions as F

from riskspark.operators import quality as Q
from riskspark.sources import tables as T


def test_validate_first_failure(spark):
    df = spark.createDataFrame([(i, 2 if i == 3 else i % 2) for i in range(60)], "id long, Attrition int")
    out = {r.check: r for r in Q.validate_table(df).collect()}
    assert not out["label_values"].passed and out["label_values"].first_failure
    assert out["min_rows"].passed and not out["min_rows"].first_failure
    small = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, Attrition int")
    out2 = {r.check: r for r in Q.validate_table(small, max_rows=5).collect()}
    assert out2["max_rows"].first_failure and not out2["min_rows"].first_failure


def test_consistency_rules_first_broken(spark):
    df = spark.createDataFrame([(1, 30, 15, 20, 1), (2, 25, 3, 5, 1), (3, 40, 5, 1, 9), (4, 50, 10, 2, 3)],
                               "id long, Age int, YearsAtCompany int, YearsSinceLastPromotion int, "
                               "YearsInCurrentRole int")
    got = {r.id: r.violation for r in Q.consistency_violations(df, Q.hr_consistency_rules(), "id").collect()}
    assert got == {1: "years_at_company_exceeds_working_life", 2: "promotion_before_joining",
                   3: "role_before_joining"}


def test_binarize_lenient_and_strict(spark):
    df = spark.createDataFrame([("yES",), ("no",), (None,), ("maybe",)], "a string")
    assert [r.a for r in T.binarize_label(df, "a").collect()] == [1, 0, 0, 0]
    strict = T.binarize_label(df, "a", strict=True)
    assert dict(strict.dtypes)["a"] == "string"  # unchanged: not all values are yes/no
    ok = spark.createDataFrame([("Yes",), ("NO",)], "a string")
    assert [r.a for r in T.binarize_label(ok, "a", strict=True).collect()] == [1, 0]


def test_standardize_columns_ignores_absent(spark):
    df = spark.createDataFrame([(1, 2)], "Employee_ID long, Overtime int")
    assert T.standardize_columns(df).columns == ["EmployeeID", "OverTime"]


def test_distinct_labels_skip_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (1,)], "y int")
    assert sorted(r.y for r in Q.distinct_labels(df, "y").collect()) == [0, 1]
    assert df.where(F.col("y").isNull()).count() == 1


def test_validate_label_values_numeric_vs_text(spark):
    dbl = spark.createDataFrame([(i, float(i % 2)) for i in range(60)], "id long, Attrition double")
    assert {r.check: r.passed for r in Q.validate_table(dbl).collect()}["label_values"]
    txt = spark.createDataFrame([(i, str(i % 2)) for i in range(60)], "id long, Attrition string")
    assert not {r.check: r.passed for r in Q.validate_table(txt).collect()}["label_values"]
