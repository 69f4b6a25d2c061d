"""Scoring whole tables into banded at-risk lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import (DEFAULT_AT_RISK_THRESHOLD, action_tier, pct_1dp, predict_at,
                                         risk_label, risk_level)
from riskspark.session import cut_lineage

# The columns the at-risk export shows, in order.
AT_RISK_COLUMNS = ["EmployeeID", "Department", "JobRole", "OverTime", "JobSatisfaction", "YearsAtCompany",
                   "MonthlyIncome", "Attrition_Probability_%", "Risk_Level", "Attrition"]


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    return df.select(*[c for c in cols if c in df.columns])


def at_risk_filter(scored: DataFrame, p: str, threshold: float = DEFAULT_AT_RISK_THRESHOLD) -> DataFrame:
    """Unrounded probability >= threshold."""
    return scored.where(F.col(p) >= F.lit(float(threshold)))


def add_score_bands(scored: DataFrame, p: str, pct_col: str = "p_pct", level_col: str = "risk_level",
                    threshold: float | None = None) -> DataFrame:
    """H2 + B8 (+ B9-B11 when ``threshold`` is given): rounded % and level columns."""
    out = scored.withColumn(pct_col, pct_1dp(p)).withColumn(level_col, risk_level(p))
    if threshold is not None:
        pred = predict_at(p, threshold)
        has = F.col(p).isNotNull()
        out = (out.withColumn("pred", F.when(has, pred)).withColumn("risk_label", F.when(has, risk_label(p)))
                  .withColumn("action", F.when(has, action_tier(p, F.col("pred")))))
    return out


def at_risk_list(scored: DataFrame, p: str, threshold: float, id_col: str, cols: Sequence[str],
                 pct_col: str = "p_pct") -> DataFrame:
    """at-risk rows by rounded % descending (ties by id) with the chosen columns.

    The sort is a distributed range-partitioned sort; no row limit is applied
    (the list is the whole at-risk population).
    """
    if pct_col not in scored.columns:
        scored = scored.withColumn(pct_col, pct_1dp(p))
    return select_available(at_risk_filter(scored, p, threshold)
                            .orderBy(F.col(pct_col).desc(), F.col(id_col).asc()), cols)


def score_table(df: DataFrame, bundle, id_col: str, pct_col: str = "p_pct",
                level_col: str = "risk_level") -> DataFrame:
    """Score every row with a fitted bundle -> p, rounded %, level (and the original columns).

    A row with a missing feature value stays, without p, % and level.

    Encoding, column alignment (B3), scaling and the classifier run as one
    narrow pass of the bundle's PipelineModel (or the kNN join for kNN).
    ``pct_col`` / ``level_col`` name the outputs (e.g. the HR export's
    ``Attrition_Probability_%`` and ``Risk_Level``).
    """
    scored = bundle.score(df, id_col)
    return add_score_bands(scored, "p", pct_col=pct_col, level_col=level_col, threshold=None)


def score_profiles(df: DataFrame, bundle, id_col: str, rules=None,
                   threshold: float = DEFAULT_AT_RISK_THRESHOLD) -> DataFrame:
    """Hypothetical profiles: rule check (B6), score, label (B9), decision (B11), action tier.

    Rows breaking a rule are returned with their violation and no score. The rule is a column, so rows are told
    apart where they stand, without a join. A row with a missing feature has neither score nor decision.
    """
    from riskspark.operators.quality import violation_column
    broken = violation_column(rules) if rules else F.lit(None).cast("string")
    marked = df.withColumn("violation", broken)
    scored = bundle.score(marked.where(F.col("violation").isNull()), id_col)
    pred, has = predict_at("p"), F.col("p").isNotNull()
    out = scored.select(id_col, "p", pct_1dp("p").alias("p_pct"), F.when(has, risk_label("p")).alias("risk_label"),
                        F.when(has, pred).alias("pred"), F.when(has, action_tier("p", pred)).alias("action"), "violation")
    if not rules:
        return out
    none = {"p": "double", "p_pct": "double", "risk_label": "string", "pred": "int", "action": "string"}
    return out.unionByName(marked.where(F.col("violation").isNotNull()).select(
        id_col, *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "violation"))


def at_risk_report(df: DataFrame, bundle, id_col: str, label: str | None = None,
                   threshold: float = DEFAULT_AT_RISK_THRESHOLD, show_cols: Sequence[str] | None = None,
                   out_path: str | None = None, split_ids: DataFrame | None = None, pct_col: str = "p_pct",
                   level_col: str = "risk_level", keep_scores: bool = True) -> dict:
    """Score -> filter -> sort -> columns -> summary, histogram, level counts (-> CSV).

    Every row is scored, training rows included (as the reference); pass the
    ``(id, split)`` table of the preparation step as ``split_ids`` to show
    which rows the model was trained on (column ``split``).
    Returns a dict of lazy DataFrames; ``out_path`` also writes the list (A8). ``keep_scores`` writes the scored
    rows to the shared folder once, for callers that use several of the four; without it each scores on its own.
    """
    if split_ids is not None:
        df = df.join(split_ids.select(id_col, "split"), id_col, "left")
    from riskspark.functions.columns import RISK_LEVEL_ORDER
    from riskspark.operators.metrics import at_risk_summary
    from riskspark.operators.profile import class_histogram, level_counts
    scored = score_table(df, bundle, id_col, pct_col, level_col)
    if keep_scores:
        scored = cut_lineage(scored)
    cols = list(show_cols) if show_cols else [id_col] + [c for c in df.columns if c != id_col] + [pct_col,
                                                                                                  level_col]
    if split_ids is not None and "split" not in cols:
        cols.append("split")
    lst = at_risk_list(scored, "p", threshold, id_col, cols, pct_col=pct_col)
    report = {
        "list": lst,
        "summary": at_risk_summary(scored, "p", threshold, label=label if label in df.columns else None,
                                   pct_col=pct_col),
        "histogram": class_histogram(scored, "p", 40),
        "levels": level_counts(scored, level_col, RISK_LEVEL_ORDER),
    }
    if out_path:
        from riskspark.sources.sinks import write_at_risk
        write_at_risk(lst, out_path)
    return report
