"""Distributed SMOTE (K5, G1), all classes in one pass.

For every class below the largest, ``need = max_count - n_c`` synthetic rows:
parent uniform (with replacement) over the class rows, neighbour uniform over
its k nearest class rows (exact kNN join, self excluded by id), one
lambda in [0, 1) per synthetic row: x = parent + lambda * (neighbour - parent).
With ``k = min(k, n_c - 1) < 1`` the parent is duplicated.

The neighbours of all classes come from one search whose tiles lie inside a
class (``knn_join(within=label)``), and synthetic rows of all classes from one
``spark.range``: the number of jobs does not depend on the number of classes.

Synthetic ids lie below every id of the input (numbers) or start with
``synthetic:`` (text), so they collide with none.

Randomness is md5-derived (``hash_uniform``) per class and synthetic index, so
the result is reproducible in SQL. Synthetic rows meet their (parent,
neighbour) pair by an equi-join; where a class has far fewer rows than it
needs, its pairs are repeated under salts, so no pair is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import hash_uniform
from riskspark.operators.knn import self_knn
from riskspark.operators.rank import hash_rank
from riskspark.session import cut_lineage

#: Synthetic rows that one parent row may meet under one salt, about.
SALT_ROWS = 10_000
#: Pairs of at most so many bytes are broadcast; a text id counts as ``ID_BYTES``.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 256


def _by_class(position: Column, values: Sequence, kind: str) -> Column:
    """The value of the class at a 0-based position, from a literal array (an entry a class)."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), position + 1)


def smote_synthetic(df: DataFrame, label: str, id_col: str, features: Sequence[str], k: int = 5,
                    seed: int = 42, counts: dict | None = None) -> DataFrame:
    """Synthetic rows only: (label, synth_index, parent_id, nb_id, lam, *features, id).

    ``counts`` (class -> rows) may be passed when the caller already knows them. Rows without a label are no class. A
    class whose rows all lack a feature value has no neighbours to draw and duplicates parents.
    """
    feats = list(features)
    if counts is None:
        counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("empty input")
    top = max((n for c, n in counts.items() if c is not None), default=0)
    short = sorted(c for c, n in counts.items() if c is not None and n < top)
    kind, label_kind = dict(df.dtypes)[id_col], dict(df.dtypes)[label]
    if not short:
        return df.sparkSession.createDataFrame(
            [], f"{label} {label_kind}, synth_index long, parent_id {kind}, nb_id {kind}, lam double, "
                + ", ".join(f"{c} double" for c in feats) + f", {id_col} {'string' if kind == 'string' else 'long'}")
    size, need = [counts[c] for c in short], [top - counts[c] for c in short]
    offset = [sum(need[:i]) for i in range(len(short))]
    near = [min(k, n - 1) for n in size]
    salts = [max(1, -(-m // (n * SALT_ROWS))) for n, m in zip(size, need, strict=True)]

    # written once: ranks, vectors and both ends of every pair read the same rows
    rows = cut_lineage(df.where(F.col(label).isin(short)).select(
        F.col(id_col), F.col(label), *[F.col(c).cast("double").alias(c) for c in feats]))
    width = 8 * (2 * len(feats) + 6) + (2 * ID_BYTES if kind == "string" else 0)
    small = sum(n * max(1, r) * m for n, r, m in zip(size, near, salts, strict=True)) * width <= BROADCAST_BYTES
    sent = F.broadcast if small else (lambda table: table)  # a checked size: rows, ranks and salts of all classes
    parents = hash_rank(rows, [label], id_col, seed, "_ord", salt=("smote", F.col(label))).select(
        F.col(label), (F.col("_ord") - 1).alias("_ord"), F.col(id_col).alias("parent_id"),
        *[F.col(c).alias(f"_p_{c}") for c in feats])
    place = F.array_position(F.array(*[F.lit(c).cast(label_kind) for c in short]), F.col(label)).cast("int") - 1
    ranks = F.sequence(F.lit(1), F.greatest(F.lit(1), _by_class(place, near, "int")))
    drawn = parents.withColumn("_nbr", F.explode(ranks))
    if max(near) >= 1:
        vec = rows.select(id_col, label, F.array(*[F.col(c) for c in feats]).alias("_v"))
        nn = self_knn(vec, max(near), id_col, "_v", seed=seed, within=label).where(F.col("rank").isNotNull()).select(
            F.col("q_id").alias("parent_id"), F.col("rank").alias("_nbr"), "nb_id")
        ends = rows.select(F.col(id_col).alias("nb_id"), *[F.col(c).alias(f"_n_{c}") for c in feats])
        # a rank that a row has no neighbour for (missing values, the only row of its class) is the row itself
        pairs = drawn.join(sent(nn.join(sent(ends), "nb_id")), ["parent_id", "_nbr"], "left")
    else:
        pairs = drawn.select("*", F.lit(None).cast(kind).alias("nb_id"),
                             *[F.lit(None).cast("double").alias(f"_n_{c}") for c in feats])
    pairs = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), _by_class(place, salts, "int") - 1)))
    index = F.size(F.filter(F.array(*[F.lit(o).cast("long") for o in offset]), lambda o: o <= F.col("id"))) - 1
    syn = spark_range(df, sum(need)).withColumn("_c", index).select(
        _by_class(F.col("_c"), short, label_kind).alias(label), "_c", F.col("id").alias("_at"),
        (F.col("id") - _by_class(F.col("_c"), offset, "long")).alias("synth_index"))
    u = lambda tag: hash_uniform(seed, F.col(label), tag, F.col("synth_index"))
    syn = syn.select(
        label, "_at", "synth_index", F.floor(u("p") * _by_class(F.col("_c"), size, "long")).cast("long").alias("_ord"),
        (F.floor(u("n") * _by_class(F.col("_c"), [max(n, 1) for n in near], "int")) + 1).cast("int").alias("_nbr"),
        u("l").alias("lam"), F.pmod(F.xxhash64("_at"), _by_class(F.col("_c"), salts, "long")).cast("int").alias("_salt"))
    met = syn.join(sent(pairs), [label, "_ord", "_nbr", "_salt"])
    alone = F.col("nb_id").isNull()
    met = met.withColumn("lam", F.when(alone, F.lit(0.0)).otherwise(F.col("lam")))
    point = [F.when(alone, F.col(f"_p_{c}")).otherwise(
        F.col(f"_p_{c}") + F.col("lam") * (F.col(f"_n_{c}") - F.col(f"_p_{c}"))).alias(c) for c in feats]
    if kind == "string":
        new_id = F.concat(F.lit(f"synthetic:{seed}:"), F.col("_at"))
    else:
        floor_ = min(0, int(df.agg(F.min(F.col(id_col).cast("long"))).first()[0] or 0))  # below every id at hand
        new_id = F.lit(floor_) - (F.col("_at") + F.lit(1))
    return met.select(label, "synth_index", "parent_id", F.coalesce("nb_id", "parent_id").alias("nb_id"), "lam", *point,
                      new_id.alias(id_col))


def spark_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(0, n, 1, max(1, df.sparkSession.sparkContext.defaultParallelism))


def smote(df: DataFrame, label: str, id_col: str, features: Sequence[str], k: int = 5, seed: int = 42,
          counts: dict | None = None) -> DataFrame:
    """K5 + G1: original rows plus synthetic rows, flagged by ``is_synthetic``."""
    feats = list(features)
    syn = smote_synthetic(df, label, id_col, feats, k, seed, counts)
    orig = df.select(F.col(id_col), F.col(label), *[F.col(c).cast("double") for c in feats],
                     F.lit(False).alias("is_synthetic"))
    return orig.unionByName(syn.select(id_col, label, *feats, F.lit(True).alias("is_synthetic")))
