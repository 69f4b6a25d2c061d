"""Approximate k-nearest-neighbour join by random-projection buckets with multi-probe (C1, an explicit option).

Each of ``tables`` hash tables projects the vectors on a few random orthonormal directions and cuts every direction at
quantiles, so a bucket (one slab per direction) holds about ``leaf_rows`` base rows whatever their number. The quantiles
come from a bounded sample (``SAMPLE`` rows by hash); they decide how even the buckets are, not which rows are indexed:
every base row is in one bucket of every table. Buckets that still hold far more rows are cut along further directions,
and what cannot be cut (rows closer than a slab) is dealt over several records.

A query looks into its own bucket and the ``probes - 1`` next ones, in the order of the squared distance to the slabs
that it would have to cross (Lv et al., VLDB 2007). What it finds is refined by exact distance, so a returned row's
distance and the order of the rows are exact; a near row may be missing. Rows shipped per base row: ``tables``; per
query: ``tables * probes``; so the shuffled bytes grow in proportion to the rows.

Identical vectors, rows without a vector, ``within``, ``unlike`` and ``payload`` are treated as by the exact join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from riskspark.functions.columns import hash_hex
from riskspark.operators.knn import _as_matrix, _block, _nearest, knn_join

SAMPLE = 8192
#: Slabs per direction beyond the first cut, further directions for full buckets, and what counts as full.
SLABS, MORE_CUTS, FULL = 4, 6, 4
TILE_ROWS = 2048


class Tables:
    """Directions and cut points of all hash tables."""

    def __init__(self, sample: np.ndarray, n_rows: int, tables: int, leaf_rows: int, seed: int):
        dim = sample.shape[1]
        cells = max(1.0, n_rows / leaf_rows)
        self.axes = int(min(dim, max(1, math.ceil(math.log2(cells) / 2)))) if cells > 1 else 0
        slabs = max(1, math.ceil(cells ** (1 / self.axes))) if self.axes else 1
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.directions, self.cuts = [], []
        for _ in range(tables):
            blocks = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-(self.axes + MORE_CUTS) // dim))]
            a = np.concatenate(blocks, axis=1)[:, :self.axes + MORE_CUTS]
            z = sample @ a
            self.directions.append(a)
            self.cuts.append([np.quantile(z[:, j], np.linspace(0, 1, (slabs if j < self.axes else SLABS) + 1)[1:-1])
                              for j in range(z.shape[1])])

    def slabs(self, table: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slab of every row along every direction, projections)."""
        z = x @ self.directions[table]
        return np.stack([np.searchsorted(c, z[:, j], side="right") for j, c in enumerate(self.cuts[table])], axis=1), z

    def bucket(self, table: int, slab: np.ndarray) -> np.ndarray:
        """Number of the bucket that the first directions tell."""
        out = np.full(len(slab), table, dtype=np.int64)
        for j in range(self.axes):
            out = out * (len(self.cuts[table][j]) + 1) + slab[:, j]
        return out

    def further(self, slab: np.ndarray) -> np.ndarray:
        """The slabs along the further directions as one number, the first direction in the highest digit."""
        out = np.zeros(len(slab), dtype=np.int64)
        for j in range(MORE_CUTS):
            out = out * SLABS + slab[:, self.axes + j]
        return out

    def probes(self, table: int, slab: np.ndarray, z: np.ndarray, n: int) -> list[np.ndarray]:
        """For every row the slabs of its ``n`` likeliest buckets, its own first."""
        out = []
        for s, p in zip(slab, z, strict=True):
            steps = []  # (squared distance to the next slab, direction, step)
            for j in range(self.axes):
                cuts = self.cuts[table][j]
                if s[j] > 0:
                    steps.append(((p[j] - cuts[s[j] - 1]) ** 2, j, -1))
                if s[j] < len(cuts):
                    steps.append(((cuts[s[j]] - p[j]) ** 2, j, 1))
            steps.sort()
            steps = steps[:n]
            sets = [(0.0, ())] + [(d, (i,)) for i, (d, _, _) in enumerate(steps)]
            sets += [(steps[a][0] + steps[b][0], (a, b)) for b in range(len(steps)) for a in range(b)
                     if steps[a][1] != steps[b][1]]
            sets.sort()
            rows = np.repeat(s[None, :], min(n, len(sets)), axis=0)
            for row, (_, moved) in zip(rows, sets, strict=False):
                for i in moved:
                    row[steps[i][1]] += steps[i][2]
            out.append(rows)
        return out


def _placed(rows: DataFrame, tables: Tables, n_tables: int, id_col: str, feat_col: str, probes: int) -> DataFrame:
    """(row, bucket, further): every row in a bucket of every table, in ``probes`` buckets of it if these are more."""
    keep = ["_key", "_fold", id_col, feat_col]

    def place(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _as_matrix(pdf[feat_col])
            for t in range(n_tables):
                slab, z = tables.slabs(t, x)
                if probes == 1:
                    yield pdf[keep].assign(_bucket=tables.bucket(t, slab), _further=tables.further(slab))
                    continue
                found = tables.probes(t, slab, z, probes)
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                every = np.concatenate(found)
                yield pdf[keep].iloc[at].assign(_bucket=tables.bucket(t, every), _further=tables.further(every))

    schema = StructType([StructField("_key", LongType()), StructField("_fold", LongType()), rows.schema[id_col],
                         StructField(feat_col, ArrayType(DoubleType())), StructField("_bucket", LongType()),
                         StructField("_further", LongType())])
    return rows.select(*keep).mapInPandas(place, schema)


def _records(placed: DataFrame, sizes: DataFrame, id_col: str, feat_col: str, prefix: str) -> DataFrame:
    """One record for at most about ``TILE_ROWS`` rows of a (cut) bucket: ids, folds and vectors."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": pdf["_key"].iloc[:1], "bucket": pdf["_bucket"].iloc[:1], "cut": pdf["_cut"].iloc[:1],
                             "ids": [pdf[id_col].to_numpy()],
                             "folds": [pdf["_fold"].to_numpy(np.int64).tobytes()],
                             "vec": [_as_matrix(pdf[feat_col]).tobytes()]})

    schema = StructType([StructField("key", LongType()), StructField("bucket", LongType()), StructField("cut", LongType()),
                         StructField("ids", ArrayType(placed.schema[id_col].dataType)),
                         StructField("folds", BinaryType()), StructField("vec", BinaryType())])
    # a full bucket is cut by as many of the further digits as its size asks for
    digits = F.lit(SLABS ** MORE_CUTS) / F.pow(F.lit(float(SLABS)), F.col("_depth"))
    dealt = (placed.join(sizes, ["_key", "_bucket"], "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))
             .withColumn("_cut", F.floor(F.col("_further") / digits).cast("long")))
    counts = dealt.groupBy("_key", "_bucket", "_cut").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("long").alias("_parts"))
    dealt = dealt.join(counts, ["_key", "_bucket", "_cut"]).withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts")))
    packed = dealt.select("_key", "_bucket", "_cut", "_part", "_fold", id_col, feat_col).groupBy(
        "_key", "_bucket", "_cut", "_part").applyInPandas(pack, schema)
    return packed.toDF(*[c if c in ("key", "bucket", "cut") else f"{prefix}{c}" for c in packed.columns])


def _meet(k: int):
    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                q_ids, x, xf = _block(t.q_ids, t.q_vec, t.q_folds)
                b_ids, y, yf = _block(t.b_ids, t.b_vec, t.b_folds)
                r, c, d = _nearest(x, y, b_ids, k, np.full(len(x), np.inf), xf, yf)
                yield pd.DataFrame({"q_id": q_ids[r], "nb_id": b_ids[c], "_d2": d})

    return run


def _search(n_tables: int, probes: int, leaf_rows: int):
    def core(queries: DataFrame, base: DataFrame, n_base: int, k: int, id_col: str, feat_col: str, seed: int,
             max_pivots, tile_rows, query_tile_rows, kept: list) -> DataFrame:
        sample = (base.withColumn("_h", hash_hex(seed, "sample", F.col(id_col))).orderBy("_h", id_col).limit(SAMPLE)
                      .select(feat_col).collect())
        tables = Tables(np.array([r[0] for r in sample], dtype=np.float64), n_base, n_tables, leaf_rows, seed)
        b = _placed(base, tables, n_tables, id_col, feat_col, 1).persist()
        kept.append(b)
        full = (b.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FULL * leaf_rows)
                .select("_key", "_bucket", F.least(F.lit(MORE_CUTS), F.ceil(
                    F.log(F.col("_n") / leaf_rows) / math.log(SLABS))).cast("int").alias("_depth")).persist())
        kept.append(full)
        q = _placed(queries, tables, n_tables, id_col, feat_col, probes)
        met = _records(q, full, id_col, feat_col, "q_").join(
            _records(b, full, id_col, feat_col, "b_"), ["key", "bucket", "cut"])
        hits = StructType([StructField("q_id", queries.schema[id_col].dataType),
                           StructField("nb_id", base.schema[id_col].dataType), StructField("_d2", DoubleType())])
        found = met.mapInPandas(_meet(k), hits).groupBy("q_id", "nb_id").agg(F.min("_d2").alias("_d2"))
        near = Window.partitionBy("q_id").orderBy("_d2", "nb_id")
        return found.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")

    return core


def approx_knn_join(queries: DataFrame, base: DataFrame, k: int, id_col: str = "id", feat_col: str = "features",
                    tables: int = 6, probes: int = 8, leaf_rows: int = 256, **options) -> DataFrame:
    """C1 approximate: like ``knn_join`` (same options and columns), but a near row may be missed.

    More ``tables`` and ``probes`` find more and ship more; ``leaf_rows`` is the size that buckets aim at. A query that
    meets fewer than k rows has fewer; one that meets none has one row of nulls.
    """
    return knn_join(queries, base, k, id_col, feat_col, core=_search(tables, probes, leaf_rows), **options)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, found, wanted, recall): the share of the exact neighbours that the approximate join returned."""
    want = exact.where(F.col("nb_id").isNotNull()).select("q_id", "nb_id")
    hit = approx.select("q_id", "nb_id", F.lit(1).alias("_hit"))
    met = want.join(hit, ["q_id", "nb_id"], "left")
    return met.agg(F.count_distinct("q_id").alias("queries"), F.count("_hit").alias("found"),
                   F.count(F.lit(1)).alias("wanted")).withColumn("recall", F.col("found") / F.col("wanted"))
