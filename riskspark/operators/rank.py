"""Distributed ordered rank / prefix sums without a single-partition window.

A plain ``row_number().over(Window.orderBy(...))`` moves every row to one
task. Here the sort key is cut into order-preserving buckets first:

1. count rows (or sum values) per (partition keys, bucket)   -> small table
2. running total of the lower buckets                         -> offsets
3. ``row_number`` / running sum inside (partition keys, bucket), plus offset

Step 2 runs over the bucket table only (one row per bucket and partition-key
value); the planner decides how to join it to step 3, by its measured size.
Step 3 is spread over all buckets, so no task holds more than one bucket.
Null partition keys form a group of their own: no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import hash_hex
from riskspark.session import cut_lineage

BROADCAST_CLASSES = 10_000
DEFAULT_HEX_DIGITS = 4  # 65 536 buckets per partition key value


def hash_order_key(seed, id_col: str, *salt) -> Column:
    """Deterministic shuffle key: md5('seed:[salt:]id') as hex text."""
    return hash_hex(seed, *salt, F.col(id_col))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; keeps one copy of the keys."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def class_cuts(df: DataFrame, label: str | None, id_col: str, seed, ranks, digits: int = DEFAULT_HEX_DIGITS):
    """(keyed rows, cut table) for cuts of the deterministic shuffle order at given ranks, per class.

    ``ranks`` maps the class-size column to an array of cut ranks. Bucket counts tell the bucket that holds each
    cut; only that bucket's rows are ranked. The cut table has one row per class: ``_cuts``, the (hash, id) of the
    row at each positive rank, and ``_zeros``, the number of cuts before the first row. So a split or a fold is a
    comparison of each row with its class's few cuts, without a shuffle of the rows.
    """
    pcols = [label] if label else ["_all"]
    keyed = df.withColumn("_hkey", hash_order_key(seed, id_col)).withColumn("_bkt", F.substring("_hkey", 1, digits))
    keyed = keyed if label else keyed.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    counts = (keyed.groupBy(*pcols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
              .withColumn("_total", F.sum("_n").over(Window.partitionBy(*pcols)))
              .select("*", F.posexplode(ranks(F.col("_total"))).alias("_cut", "_rank")))
    edge = counts.where((F.col("_off") < F.col("_rank")) & (F.col("_rank") <= F.col("_off") + F.col("_n"))).select(
        *pcols, "_bkt", "_cut", (F.col("_rank") - F.col("_off")).alias("_need"))
    near = join_null_safe(keyed.select(*pcols, "_bkt", "_hkey", F.col(id_col).alias("_id")), edge, [*pcols, "_bkt"])
    place = F.row_number().over(Window.partitionBy(*pcols, "_bkt", "_cut").orderBy("_hkey", "_id"))
    at = near.withColumn("_place", place).where(F.col("_place") == F.col("_need")).groupBy(*pcols).agg(
        F.collect_list(F.struct("_hkey", "_id")).alias("_cuts"))
    zeros = counts.where(F.col("_off") == 0).groupBy(*pcols).agg(
        F.sum((F.col("_rank") <= 0).cast("int")).alias("_zeros"))
    return keyed, join_null_safe(zeros, at, pcols, "left"), pcols


def cuts_before(df: DataFrame, label: str | None, id_col: str, seed, ranks, out: str,
                digits: int = DEFAULT_HEX_DIGITS) -> DataFrame:
    """Add ``out``: how many of its class's cuts lie before each row."""
    keyed, cuts, pcols = class_cuts(df, label, id_col, seed, ranks, digits)
    cuts = cut_lineage(cuts)
    if cuts.count() <= BROADCAST_CLASSES:  # a checked size: one row per class; beyond it the planner joins as it can
        cuts = F.broadcast(cuts)
    own = F.struct(F.col("_hkey"), F.col(id_col).alias("_id"))
    n = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < own))
    joined = join_null_safe(keyed, cuts, pcols)
    return joined.withColumn(out, (F.col("_zeros") + n).cast("int")).select(*df.columns, out)


def rank_within(df: DataFrame, partition_cols: Sequence[str], bucket: Column, order_cols: Sequence,
                rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """1-based rank inside ``partition_cols`` by ``order_cols``.

    ``bucket`` must be non-decreasing in ``order_cols`` (e.g. a prefix of the
    sort key), so offsets of lower buckets plus the in-bucket row number give
    the global rank. ``total_col`` also attaches the partition's row count,
    taken from the same bucket-count table (no extra pass over the rows).
    """
    pcols = list(partition_cols)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*pcols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*pcols)).alias(total_col)] if total_col else []
    offsets = counts.select(*pcols, "_bkt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), *extra)
    joined = join_null_safe(b, offsets, [*pcols, "_bkt"])
    w2 = Window.partitionBy(*pcols, "_bkt").orderBy(*order_cols)
    return (joined.withColumn(rank_col, (F.row_number().over(w2) + F.col("_off")).cast("long"))
                  .drop("_bkt", "_off"))


def hash_rank(df: DataFrame, partition_cols: Sequence[str], id_col: str, seed,
              rank_col: str = "rank", digits: int = DEFAULT_HEX_DIGITS, salt: Sequence = (),
              total_col: str | None = None) -> DataFrame:
    """Rank rows in a deterministic pseudo-random order (md5 of seed:id), ties by id."""
    key = hash_order_key(seed, id_col, *salt)
    keyed = df.withColumn("_hkey", key)
    out = rank_within(keyed, partition_cols, F.substring("_hkey", 1, digits), [F.col("_hkey"), F.col(id_col)],
                      rank_col, total_col)
    return out.drop("_hkey")


def prefix_sums(df: DataFrame, partition_cols: Sequence[str], bucket: Column, order_cols: Sequence,
                value_cols: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_cols`` order, per partition key."""
    pcols = list(partition_cols)
    b = df.withColumn("_bkt", bucket)
    totals = b.groupBy(*pcols, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    w = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*pcols, "_bkt",
                            *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}")
                              for c in value_cols])
    joined = join_null_safe(b, offsets, [*pcols, "_bkt"])
    w2 = (Window.partitionBy(*pcols, "_bkt").orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for c in value_cols:
        joined = joined.withColumn(f"{prefix}{c}", F.sum(c).over(w2) + F.col(f"_o_{c}"))
    return joined.drop("_bkt", *[f"_o_{c}" for c in value_cols])


def range_rank(df: DataFrame, partition_cols: Sequence[str], order_col: str, rank_col: str = "rank",
               total_col: str | None = None) -> DataFrame:
    """1-based rank inside ``partition_cols`` in the order of a column of any type that sorts (nulls first).

    Spark's sampled range partitions over (partition columns, order column) are the buckets; they are written once, so
    that counts and rows see the same ones.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*partition_cols, order_col)]
    dealt = cut_lineage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    return rank_within(dealt, partition_cols, F.col("_range"), [F.col(order_col).asc_nulls_first()], rank_col,
                       total_col).drop("_range")
