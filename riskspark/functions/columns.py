"""Column-level functions (all JVM-side, codegen friendly).

Every function returns a ``Column`` so callers compose them inside
``select``/``withColumn`` and Catalyst keeps them in one codegen stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on (cut points and labels of the reference).
RISK_LEVEL_EDGES = [0.0, 0.35, 0.55, 1.0]
RISK_LEVEL_LABELS = ["Low", "Medium", "High"]
RISK_LEVEL_ORDER = ["High", "Medium", "Low"]
RISK_LABEL_HIGH = 0.6
RISK_LABEL_MEDIUM = 0.35
ACTION_HIGH = 0.65
DECISION_THRESHOLD = 0.35
DEFAULT_AT_RISK_THRESHOLD = 0.40
INCOME_BAND_EDGES = [0, 3000, 6000, 10000, 20000]
INCOME_BAND_LABELS = ["<3K", "3K-6K", "6K-10K", ">10K"]
# Severity cut points (strict ">"): overtime 20; department 20/14; role 25/15;
# satisfaction and income band 20/12.
SEVERITY_CUTS = {
    "overtime": (20.0, None),
    "department": (20.0, 14.0),
    "role": (25.0, 15.0),
    "satisfaction": (20.0, 12.0),
    "income": (20.0, 12.0),
}
HASH_BITS = 52
HASH_SCALE = float(2 ** HASH_BITS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- hashing (2.11)

def hash_hex(*parts) -> Column:
    """md5 of the ':'-joined parts (strings/ids). Same text in DuckDB:
    ``md5(concat_ws(':', ...))``."""
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_int52(*parts) -> Column:
    """First 13 hex digits of the md5 as a non-negative 52-bit integer."""
    return F.conv(F.substring(hash_hex(*parts), 1, 13), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Deterministic uniform in [0, 1) from the md5 of the parts."""
    return hash_int52(*parts).cast("double") / F.lit(HASH_SCALE)


def id_hash52(id_col) -> Column:
    """Integer hash of a key alone (no seed): ``md5(cast(id as string))``."""
    return F.conv(F.substring(F.md5(_col(id_col).cast("string")), 1, 13), 16, 10).cast("long")


# ---------------------------------------------------------------- rounding

def round_half_even_int(x) -> Column:
    """Integer round half to even (NumPy ``round``)."""
    return F.rint(_col(x)).cast("long")


def pct_1dp(p) -> Column:
    """``np.round(p * 100, 1)``: round half-even after scaling by 10."""
    return F.rint(_col(p) * F.lit(100.0) * F.lit(10.0)) / F.lit(10.0)


# ---------------------------------------------------------------- bands

def band(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed, left-open bands ``(e_i, e_{i+1}]``; outside -> null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges)-1 labels")
    c = _col(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def band_index(x, edges: Sequence[float]) -> Column:
    """1-based band number for :func:`band`, null outside."""
    c = _col(x)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]), start=1):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def risk_level(p) -> Column:
    """(0,.35] Low, (.35,.55] Medium, (.55,1] High; p=0 -> null."""
    return band(p, RISK_LEVEL_EDGES, RISK_LEVEL_LABELS)


def risk_label(p) -> Column:
    c = _col(p)
    return (F.when(c > F.lit(RISK_LABEL_HIGH), F.lit("HIGH RISK"))
            .when(c > F.lit(RISK_LABEL_MEDIUM), F.lit("MEDIUM RISK"))
            .otherwise(F.lit("LOW RISK")))


def predict_at(p, threshold: float = DECISION_THRESHOLD) -> Column:
    """1 iff p >= threshold (inclusive), as int."""
    return F.when(_col(p) >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def action_tier(p, pred) -> Column:
    c, d = _col(p), _col(pred)
    return (F.when((d == 1) & (c > F.lit(ACTION_HIGH)), F.lit("high"))
            .when(d == 1, F.lit("medium"))
            .otherwise(F.lit("retain")))


def severity(rate, high: float, mid: float | None = None) -> Column:
    c = _col(rate)
    expr = F.when(c > F.lit(high), F.lit("high"))
    if mid is not None:
        expr = expr.when(c > F.lit(mid), F.lit("medium"))
    return expr.otherwise(F.lit("low"))


def driver_direction(w) -> Column:
    return F.when(_col(w) > 0, F.lit("leave")).otherwise(F.lit("stay"))


# ---------------------------------------------------------------- numeric helpers

def sigmoid(z) -> Column:
    """1/(1+exp(-clip(z, -500, 500)))."""
    zc = F.greatest(F.least(_col(z), F.lit(500.0)), F.lit(-500.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-zc))


def safe_div(num, den) -> Column:
    """num/den, 0 when den is 0 (zero_division=0)."""
    n, d = _col(num), _col(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def linear_probability(cols: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """H4-H5: sigmoid(intercept + sum(w_i * x_i)) with the reference's clip at +-500."""
    z = F.lit(float(intercept))
    for c, w in zip(cols, weights):
        z = z + F.col(c).cast("double") * F.lit(float(w))
    return sigmoid(z)
