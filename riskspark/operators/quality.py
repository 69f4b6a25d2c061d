"""Validation and consistency rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import cut_lineage

# The validator's limits.
MIN_ROWS = 50
MAX_COLUMNS = 100
ALLOWED_LABELS = (0, 1)
#: Labels that the check names; ``observed_labels`` has them all.
MAX_SHOWN = 1000


def validate_table(df: DataFrame, label: str = "Attrition", required: Sequence[str] | None = None,
                   max_rows: int | None = None, min_rows: int = MIN_ROWS,
                   max_columns: int = MAX_COLUMNS, max_shown: int = MAX_SHOWN) -> DataFrame:
    """A5: ordered checks -> DataFrame (ordinal, check, observed, limit, passed, first_failure).

    One grouped aggregate gives the row count and the distinct labels, of any number; the check names the first
    ``max_shown`` in order and says how many it leaves out. ``max_rows`` protects one machine; it is off by default.
    """
    required = list(required) if required is not None else [label]
    missing = missing_columns(df, required)
    spark = df.sparkSession
    if label in df.columns:
        lab = F.col(label)
        numeric = dict(df.dtypes)[label] in ("int", "bigint", "smallint", "tinyint", "double", "float") or \
            dict(df.dtypes)[label].startswith("decimal")
        # numeric labels compare by value (1.0 == 1); text labels never equal the integers 0/1
        allowed = lab.isin(*ALLOWED_LABELS) if numeric else F.lit(False)
        seen = cut_lineage(df.groupBy(lab.cast("string").alias("v"), allowed.alias("ok"))
                           .agg(F.count(F.lit(1)).alias("n")))  # one scan: every value with its count
        total = seen.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNotNull() & ~F.col("ok"), F.col("n"))
                                                      .otherwise(0)).alias("bad"), F.count_distinct("v").alias("k")).first()
        n, n_bad = int(total["n"] or 0), int(total["bad"] or 0)
        vals = [r["v"] for r in seen.where(F.col("v").isNotNull()).select("v").distinct().orderBy("v")
                .limit(max_shown).collect()]
        if total["k"] > len(vals):
            vals.append(f"(+{total['k'] - len(vals)} more)")
    else:
        n = df.count()
        vals, n_bad = [], 0
    checks = [
        ("max_rows", str(n), None if max_rows is None else str(max_rows),
         True if max_rows is None else n <= max_rows),
        ("required_columns", ",".join(sorted(missing)) if missing else "", ",".join(required), not missing),
        ("label_values", ",".join(vals), ",".join(str(v) for v in ALLOWED_LABELS),
         (label in df.columns) and n_bad == 0),
        ("min_rows", str(n), str(min_rows), n >= min_rows),
        ("max_columns", str(len(df.columns)), str(max_columns), len(df.columns) <= max_columns),
    ]
    first_bad = next((i for i, c in enumerate(checks) if not c[3]), None)
    rows = [(i + 1, c[0], c[1], c[2], bool(c[3]), first_bad == i) for i, c in enumerate(checks)]
    return spark.createDataFrame(
        rows, "ordinal int, check string, observed string, limit string, passed boolean, first_failure boolean")


def observed_labels(df: DataFrame, label: str) -> DataFrame:
    """D11 + A5: (label, n) of every distinct label, null included."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def consistency_violations(df: DataFrame, rules: Sequence[tuple[str, Column]], id_col: str) -> DataFrame:
    """First broken rule per row (rules are (name, condition-that-must-hold)).

    Rows whose checked columns are null do not break a rule (comparison is
    unknown). Returns only violating rows: (id, violation).
    """
    return (df.select(F.col(id_col), violation_column(rules).alias("violation"))
              .where(F.col("violation").isNotNull()))


def violation_column(rules: Sequence[tuple[str, Column]]) -> Column:
    """B6 as a column: the name of the first broken rule, else null."""
    expr = None
    for name, must_hold in rules:
        broken = F.coalesce(~must_hold, F.lit(False))
        expr = F.when(broken, F.lit(name)) if expr is None else expr.when(broken, F.lit(name))
    return expr


def hr_consistency_rules(age="Age", at_company="YearsAtCompany", since_promo="YearsSinceLastPromotion",
                         in_role="YearsInCurrentRole") -> list[tuple[str, Column]]:
    """The reference's three profile rules, in order."""
    return [
        ("years_at_company_exceeds_working_life", F.col(at_company) <= F.col(age) - F.lit(18)),
        ("promotion_before_joining", F.col(since_promo) <= F.col(at_company)),
        ("role_before_joining", F.col(in_role) <= F.col(at_company)),
    ]


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """Distinct non-null label values (a grouped, partially aggregated distinct)."""
    return df.where(F.col(label).isNotNull()).select(F.col(label)).distinct()


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the table."""
    return [c for c in required if c not in df.columns]


def filter_by_class(df: DataFrame, label: str, value) -> DataFrame:
    """Rows of one class (pushed down to the scan when the label is a stored column)."""
    return df.where(F.col(label) == F.lit(value))
