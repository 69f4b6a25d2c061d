"""Scans and table normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The snake_case -> CamelCase header map of the HR export.
HR_COLUMN_MAP = {
    "Employee_ID": "EmployeeID",
    "Marital_Status": "MaritalStatus",
    "Job_Role": "JobRole",
    "Job_Level": "JobLevel",
    "Monthly_Income": "MonthlyIncome",
    "Hourly_Rate": "HourlyRate",
    "Years_at_Company": "YearsAtCompany",
    "Years_in_Current_Role": "YearsInCurrentRole",
    "Years_Since_Last_Promotion": "YearsSinceLastPromotion",
    "Work_Life_Balance": "WorkLifeBalance",
    "Job_Satisfaction": "JobSatisfaction",
    "Performance_Rating": "PerformanceRating",
    "Training_Hours_Last_Year": "TrainingTimesLastYear",
    "Project_Count": "ProjectCount",
    "Average_Hours_Worked_Per_Week": "AverageHoursWorkedPerWeek",
    "Work_Environment_Satisfaction": "EnvironmentSatisfaction",
    "Relationship_with_Manager": "RelationshipSatisfaction",
    "Job_Involvement": "JobInvolvement",
    "Distance_From_Home": "DistanceFromHome",
    "Number_of_Companies_Worked": "NumCompaniesWorked",
    "Overtime": "OverTime",
}


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: StructType | str | None = None) -> DataFrame:
    """A1: read a labelled table. CSV: header + inferred (or given) schema; Parquet by extension."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def standardize_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """A2: rename by a fixed map; names absent from the table are ignored."""
    mapping = HR_COLUMN_MAP if mapping is None else mapping
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def binarize_label(df: DataFrame, col: str, positive: str = "yes", strict: bool = False) -> DataFrame:
    """A3 / A4: map a text label to 1/0.

    Lenient (A3): ``lower(x) == positive`` -> 1, anything else including null -> 0.
    Strict (A4): map only when every value is yes/no (case-insensitive, a null
    fails the test); otherwise the column is returned unchanged (and the
    validator rejects it). The test is one distributed aggregate.
    Numeric columns are returned unchanged in both modes.
    """
    if dict(df.dtypes)[col] != "string":
        return df
    mapped = F.coalesce((F.lower(F.col(col)) == F.lit(positive.lower())).cast("int"), F.lit(0))
    if not strict:
        return df.withColumn(col, mapped)
    ok = df.agg(F.coalesce(F.bool_and(F.coalesce(F.lower(F.col(col)).isin("yes", "no"), F.lit(False))),
                           F.lit(True)).alias("ok")).first()["ok"]
    return df.withColumn(col, mapped) if ok else df


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """First n rows with an explicit order (TakeOrdered, no global sort)."""
    if order_by is not None:
        cols = [order_by] if isinstance(order_by, str) else list(order_by)
        df = df.orderBy(*cols)
    return df.limit(n)


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, dtype, non_null) - the schema with non-null counts from one aggregate.

    The per-column counts are computed in a single distributed pass and laid
    out one row per column (no driver-side row building). Names may hold quotes.
    """
    names = [n for n, _ in df.dtypes]
    counts = df.agg(*[F.count(F.col("`" + n.replace("`", "``") + "`")).alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("dtype"),
                              F.col(f"c{i}").alias("non_null")) for i, (n, t) in enumerate(df.dtypes)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
