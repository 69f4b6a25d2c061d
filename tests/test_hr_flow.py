"""The reference's own workflow on an HR-shaped table (fixture F-HR), end to end."""

import numpy as np
from pyspark.sql import functions as F

from riskspark.functions.columns import INCOME_BAND_EDGES, INCOME_BAND_LABELS, SEVERITY_CUTS
from riskspark.operators import profile as P
from riskspark.operators import quality as Q
from riskspark.operators.score import AT_RISK_COLUMNS, at_risk_report
from riskspark.plans.models import default_specs
from riskspark.plans.training import prepare
from riskspark.sources import tables as T
from riskspark.sources.bundle import Bundle


def _hr_csv(tmp_path):
    rng = np.random.default_rng(21)
    incomes = [0, 3000, 3001, 6000, 10000, 20000, 20001]
    rows = []
    for i in range(120):
        age = int(rng.integers(22, 60))
        yac = int(rng.integers(0, max(1, age - 18)))
        ot = "Yes" if rng.random() < 0.3 else "No"
        inc = incomes[i] if i < len(incomes) else int(rng.integers(1000, 20000))
        leave = rng.random() < (0.45 if ot == "Yes" else 0.12)
        attr = ("yES" if i == 7 else "Yes") if leave else ("NO" if i == 8 else "No")
        dept = None if i == 9 else ["Sales", "Research & Development", "Human Resources"][i % 3]
        rows.append([1000 + i, attr, age, dept or "", ot, inc, yac, min(yac, int(rng.integers(0, 5))),
                     min(yac, int(rng.integers(0, 6))), int(rng.integers(1, 5)), 3])
    rows[10][6], rows[10][2] = 40, 30          # years at company beyond working life
    rows[11][7], rows[11][6] = 9, 2            # promotion before joining
    rows[12][8], rows[12][6], rows[12][7] = 9, 2, 1  # role before joining
    rows.append(list(rows[20]))                # duplicate feature row (new id below)
    rows[-1][0] = 5000
    header = ["Employee_ID", "Attrition", "Age", "Department", "Overtime", "Monthly_Income", "Years_at_Company",
              "Years_Since_Last_Promotion", "Years_in_Current_Role", "Job_Satisfaction", "Performance_Rating"]
    path = tmp_path / "hr.csv"
    with open(path, "w") as fh:
        fh.write(",".join(header) + "\n")
        for r in rows:
            fh.write(",".join("" if v == "" else str(v) for v in r) + "\n")
    return str(path)


def test_hr_workflow(spark, tmp_path):
    df = T.read_table(spark, _hr_csv(tmp_path))
    df = T.standardize_columns(df)
    assert {"EmployeeID", "OverTime", "MonthlyIncome", "YearsAtCompany"} <= set(df.columns)
    df = T.binarize_label(df, "Attrition", strict=True)  # mixed case yES / NO still maps
    assert dict(df.dtypes)["Attrition"] == "int"
    checks = {r.check: r.passed for r in Q.validate_table(df).collect()}
    assert all(checks.values())

    ot = {r.OverTime: r for r in P.rate_by_group(df, "OverTime", "Attrition", *SEVERITY_CUTS["overtime"]).collect()}
    assert set(ot) == {"Yes", "No"}
    dept = P.rate_by_group(df, "Department", "Attrition").collect()
    assert all(r.Department is not None for r in dept) and sum(r.n for r in dept) == df.count() - 1
    bands = {r.band: r.n for r in P.rate_by_band(df, "MonthlyIncome", INCOME_BAND_EDGES, INCOME_BAND_LABELS,
                                                "Attrition").collect()}
    assert sum(bands.values()) == df.where((F.col("MonthlyIncome") > 0) & (F.col("MonthlyIncome") <= 20000)).count()
    viol = {r.EmployeeID: r.violation for r in Q.consistency_violations(df, Q.hr_consistency_rules(),
                                                                         "EmployeeID").collect()}
    assert viol[1010] == "years_at_company_exceeds_working_life"
    assert viol[1011] == "promotion_before_joining" and viol[1012] == "role_before_joining"
    hist = P.class_histogram(df, "MonthlyIncome", 30, "Attrition")
    assert hist.where(F.col("n") == 0).count() > 0  # empty bins kept
    desc = {r.column: r for r in P.describe_numeric(df).collect()}
    assert desc["PerformanceRating"].std == 0.0  # constant column

    data = df.fillna({"Department": "Unknown"})
    prep = prepare(data, "Attrition", "EmployeeID", test_size=0.2, seed=42, use_smote=True)
    assert prep.class_counts_after[0] == prep.class_counts_after[1]
    spec = default_specs(len(prep.feature_cols), models=["Logistic Regression"])[0]
    bundle = Bundle.from_prepared(prep, spec.fit(prep.train, "Attrition"))
    rep = at_risk_report(data, bundle, "EmployeeID", label="Attrition", threshold=0.40,
                         show_cols=AT_RISK_COLUMNS, split_ids=prep.split_ids,
                         pct_col="Attrition_Probability_%", level_col="Risk_Level")
    lst = rep["list"]
    assert lst.columns[0] == "EmployeeID" and "split" in lst.columns
    assert "Attrition_Probability_%" in lst.columns and "Risk_Level" in lst.columns
    pcts = [r["Attrition_Probability_%"] for r in lst.collect()]
    assert pcts == sorted(pcts, reverse=True)
    s = rep["summary"].first()
    assert s.n_total == data.count() and s.n_at_risk == len(pcts)
    levels = {r.Risk_Level: r.n for r in rep["levels"].collect()}
    assert set(levels) == {"High", "Medium", "Low"}
