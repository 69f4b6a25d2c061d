"""Exact deterministic splits and folds.

Randomness is ``md5(seed:id)`` (see ``functions.columns``), so Spark and any
SQL engine reproduce the same assignment; sizes are exact, not Bernoulli.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.rank import DEFAULT_HEX_DIGITS, cuts_before, hash_rank, range_rank


def class_rank(df: DataFrame, label: str | None, id_col: str, seed: int = 42,
               digits: int = DEFAULT_HEX_DIGITS, with_size: bool = False) -> DataFrame:
    """1-based position of each row in its class after a deterministic shuffle.

    ``with_size`` adds ``_class_n`` (class size) from the rank's own bucket counts.
    """
    return hash_rank(df, [label] if label else [], id_col, seed, "class_rank", digits,
                     total_col="_class_n" if with_size else None)


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2, seed: int = 42,
                     digits: int = DEFAULT_HEX_DIGITS, with_rank: bool = True) -> DataFrame:
    """K3: per class ``max(1, round_half_even(n_c * test_size))`` rows go to test.

    Adds ``split`` ('train'/'test'), exact sizes; rows without a label form a class of their own. ``with_rank`` also
    adds ``class_rank`` (E1), which shuffles every row; without it rows are only compared with their class's cut.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    if not with_rank:
        return _cut_split(df, label, id_col, test_size, seed, digits)
    sized = class_rank(df, label, id_col, seed, digits, with_size=True)
    n_test = F.greatest(F.lit(1), F.rint(F.col("_class_n").cast("double") * F.lit(float(test_size))).cast("long"))
    return (sized.withColumn("split", F.when(F.col("class_rank") <= n_test, F.lit("test")).otherwise(F.lit("train")))
                 .drop("_class_n"))


def random_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42,
                 digits: int = DEFAULT_HEX_DIGITS, with_rank: bool = True) -> DataFrame:
    """K4: exactly ``max(1, round_half_even(n * test_size))`` test rows, no strata (``with_rank`` as in K3)."""
    if not with_rank:
        return _cut_split(df, None, id_col, test_size, seed, digits)
    ranked = class_rank(df, None, id_col, seed, digits, with_size=True)
    n_test = F.greatest(F.lit(1), F.rint(F.col("_class_n").cast("double") * F.lit(float(test_size))).cast("long"))
    return ranked.withColumn("split", F.when(F.col("class_rank") <= n_test, F.lit("test"))
                             .otherwise(F.lit("train"))).drop("_class_n")


def _cut_split(df: DataFrame, label: str | None, id_col: str, test_size: float, seed: int, digits: int) -> DataFrame:
    def ranks(n):
        size = F.rint(n.cast("double") * F.lit(float(test_size))).cast("long")
        return F.array(F.greatest(F.lit(1).cast("long"), size))

    out = cuts_before(df, label, id_col, seed, ranks, "split", digits)
    return out.withColumn("split", F.when(F.col("split") == 0, F.lit("test")).otherwise(F.lit("train")))


def fold_assign(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42, shuffle: bool = True,
                digits: int = DEFAULT_HEX_DIGITS, with_rank: bool = True) -> DataFrame:
    """Stratified fold number 0..k-1 with ``array_split`` sizes.

    Within a class of n rows, the first ``n % k`` folds get ``n//k + 1`` rows
    (identical to ``ntile(k)``). ``shuffle=False`` keeps id order (ids of any type that sorts). ``with_rank=False`` leaves ``class_rank`` out
    and compares rows with their class's k - 1 cuts, without a shuffle of the rows.
    """
    if not 2 <= k:
        raise ValueError("k must be >= 2")
    if shuffle and not with_rank:
        def ranks(n):
            size, more = F.floor(n / F.lit(k)), n % F.lit(k)
            return F.array(*[(size * (i + 1) + F.least(more, F.lit(i + 1))).cast("long") for i in range(k - 1)])

        return cuts_before(df, label, id_col, seed, ranks, "fold", digits)
    if shuffle:
        sized = class_rank(df, label, id_col, seed, digits, with_size=True)
    else:
        sized = range_rank(df, [label], id_col, "class_rank", "_class_n")
    n, r = F.col("_class_n"), F.col("class_rank")
    q = (n / F.lit(k)).cast("long")
    rem = n % F.lit(k)
    big = rem * (q + F.lit(1))
    fold = (F.when(r <= big, ((r - F.lit(1)) / (q + F.lit(1))).cast("long"))
            .otherwise(rem + ((r - big - F.lit(1)) / F.greatest(q, F.lit(1))).cast("long")))
    return sized.withColumn("fold", fold.cast("int")).drop("_class_n")


def fold_train_test(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """train = every fold except ``fold``; test = ``fold`` (disjoint by construction)."""
    return folded.where(F.col("fold") != F.lit(fold)), folded.where(F.col("fold") == F.lit(fold))
