"""Decision trees grown level by level, and what they explain.

A tree is a table: (tree, node, depth, n, weight, gini, value, feature, cut), nodes numbered as a heap (the children of
``i`` are ``2 i`` and ``2 i + 1``; a value <= ``cut`` goes left). Growing a level is one pass over the rows: every task
routes its rows through the trees grown so far and adds up class counts per (node, feature, bin); the summed histogram
table, whose size depends on the trees and not on the rows, then yields every node's best cut by windows. Child counts
follow from the cut, so no pass is spent on them.

The rules are the reference's: weighted Gini, at most 20 cut points a feature (midpoints between neighbouring values),
floor(sqrt(d)) features a node, no split of a pure node, of fewer than ``min_samples`` rows or at ``max_depth``; the
largest gain wins, then the first feature drawn, then the lowest cut. MLlib's forest knows no ``min_samples``. Draws come
from md5 and not from a stream: a row counts Poisson(1) times in a tree, by its id, which needs no exchange; the features
of a node are those with the smallest hashes. Cut points are those of all rows rather than of a node's rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import hash_uniform
from riskspark.operators.dictionary import number_values
from riskspark.operators.features import complete_row

MAX_CUTS = 20
NODES = ("tree int, node int, depth int, n long, weight double, gini double, value double, feature string, cut double")
#: Distribution function of Poisson(1); beyond its last entry lies less than 1e-10.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]).tolist()


def cut_points(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """At most ``MAX_CUTS`` midpoints between neighbouring distinct values of each column, evenly spaced by rank.

    The distinct values are numbered by range partitions; only the few next to a cut come to the driver.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
    values = df.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull() & ~F.isnan("value")).distinct()
    numbered = number_values(values)
    sizes = {r["column"]: r["n"] for r in numbered.groupBy("column").agg((F.max("code") + 1).alias("n")).collect()}
    wanted = {}
    for c, n in sizes.items():
        mids = np.arange(n - 1) if n - 1 <= MAX_CUTS else np.linspace(0, n - 2, MAX_CUTS).astype(int)
        wanted[c] = sorted(set(mids.tolist()))
    near = [(c, int(i) + side) for c, mids in wanted.items() for i in mids for side in (0, 1)]
    if not near:
        return {c: [] for c in cols}
    table = df.sparkSession.createDataFrame(sorted(set(near)), "column string, code long")  # at most 40 a column
    at = {(r["column"], r["code"]): r["value"]
          for r in numbered.join(F.broadcast(table), ["column", "code"]).collect()}
    return {c: [(at[c, i] + at[c, i + 1]) / 2 for i in wanted.get(c, [])] for c in cols}


def node_features(cols: Sequence[str], n: int, seed: int, tree: int, node: int) -> list[int]:
    """The ``n`` features that a node may split on, in the order of their hashes."""
    drawn = [hashlib.md5(f"{seed}:features:{tree}:{node}:{c}".encode()).hexdigest() for c in cols]
    return sorted(range(len(cols)), key=drawn.__getitem__)[:n]


def bag_counts(id_col: str, trees: int, seed: int) -> Column:
    """How often a row counts in each tree: Poisson(1) by the md5 of seed, tree and id."""
    draw = lambda t: F.size(F.filter(F.array(*[F.lit(c) for c in _POISSON]),
                                     lambda c: c <= hash_uniform(seed, "bag", t, F.col(id_col))))
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), draw)


def gini(w0: float, w1: float) -> float:
    total = w0 + w1
    if total == 0:
        return 0.0
    p1 = w1 / total
    return 1 - p1 * p1 - (1 - p1) * (1 - p1)


@dataclass
class Forest:
    """Grown trees; ``nodes`` are tuples in the order of ``NODES``, bounded by trees x 2^(depth + 1)."""

    cols: list[str]
    n_trees: int
    max_depth: int
    nodes: list[tuple] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature or -1, cut, value) of every node of every tree, by heap number."""
        shape = (self.n_trees, 1 << (self.max_depth + 1))
        feature, cut, value = np.full(shape, -1, dtype=np.int64), np.zeros(shape), np.zeros(shape)
        place = {c: j for j, c in enumerate(self.cols)}
        for tree, node, *_, v, f, c in self.nodes:
            value[tree, node] = v
            if f is not None:
                feature[tree, node], cut[tree, node] = place[f], c
        return feature, cut, value

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODES)

    def probability(self) -> Column:
        """Mean of the leaf values over the trees."""
        feature, cut, value = self.arrays()

        @F.pandas_udf("double")
        def p(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            m = np.vstack([np.asarray(v, dtype=np.float64) for v in x])
            total = np.zeros(len(m))
            for t in range(len(feature)):
                total += value[t, route(m, feature[t], cut[t])]
            return pd.Series(total / len(feature))

        return p(F.array(*[F.col(c).cast("double") for c in self.cols]))


def route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The heap number of the deepest grown node that every row reaches in one tree."""
    node = np.ones(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = x[rows, np.maximum(f, 0)] > cut[node]
        node = np.where(inner, 2 * node + right, node)


def _histogram(feature, cut, cuts: list[np.ndarray], slot: np.ndarray, subset: np.ndarray, n_features: int):
    """(slot, place, bin, n0, n1): class counts of the nodes in ``slot`` per feature place and bin, added up in a task."""
    width = MAX_CUTS + 1

    def run(batches):
        total = np.zeros((2, len(subset) * n_features * width), dtype=np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["x"]])
            bag = np.vstack([np.asarray(v, dtype=np.int64) for v in pdf["bag"]])
            y = pdf["y"].to_numpy() == 1
            bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
            for t in range(len(feature)):
                mine = slot[t][slot[t] >= 0]  # the open nodes of a tree are neighbours
                if not len(mine):
                    continue
                first, last = int(mine.min()) * n_features * width, (int(mine.max()) + 1) * n_features * width
                own = slot[t, route(x, feature[t], cut[t])]
                rows = np.flatnonzero((own >= 0) & (bag[:, t] > 0))
                own = own[rows]
                for place in range(n_features):
                    at = (own * n_features + place) * width + bins[rows, subset[own, place]] - first
                    for cls in (0, 1):
                        total[cls, first:last] += np.bincount(at, weights=bag[rows, t] * (y[rows] == bool(cls)),
                                                              minlength=last - first).astype(np.int64)
        some = np.flatnonzero(total.sum(axis=0))
        if len(some):
            yield pd.DataFrame({"slot": some // (n_features * width), "place": some // width % n_features,
                                "bin": some % width, "n0": total[0, some], "n1": total[1, some]})

    return run


def best_cuts(histogram: DataFrame, w0: float, w1: float) -> DataFrame:
    """(slot, place, bin, l0, l1, r0, r1) of every slot's best cut; a slot without a cut that parts its rows has none.

    ``histogram``: (slot, place, bin, n0, n1). A cut at bin ``b`` sends the bins up to ``b`` left.
    """
    own = Window.partitionBy("slot", "place")
    up = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram.select("*", F.sum("n0").over(up).alias("l0"), F.sum("n1").over(up).alias("l1"),
                            F.sum("n0").over(own).alias("t0"), F.sum("n1").over(own).alias("t1")).select(
        "slot", "place", "bin", "l0", "l1", (F.col("t0") - F.col("l0")).alias("r0"), (F.col("t1") - F.col("l1")).alias("r1"))

    def weigh(a: str, b: str) -> tuple[Column, Column]:
        zero, one = F.col(a) * F.lit(w0), F.col(b) * F.lit(w1)
        p1 = one / (zero + one)
        return zero + one, 1 - p1 * p1 - (1 - p1) * (1 - p1)

    parted = sums.where((F.col("l0") + F.col("l1") > 0) & (F.col("r0") + F.col("r1") > 0))
    (wl, gl), (wr, gr) = weigh("l0", "l1"), weigh("r0", "r1")
    # the parent's impurity is the same for all cuts of a slot: the least impure children are the largest gain
    ranked = parted.withColumn("_left", (wl * gl + wr * gr) / (wl + wr)).withColumn(
        "_r", F.row_number().over(Window.partitionBy("slot").orderBy("_left", "place", "bin")))
    return ranked.where(F.col("_r") == 1).select("slot", "place", "bin", "l0", "l1", "r0", "r1")


def grow_forest(df: DataFrame, cols: Sequence[str], label: str, id_col: str, n_trees: int = 80, max_depth: int = 8,
                min_samples: int = 5, n_features: int | None = None, balanced: bool = True, seed: int = 42,
                bootstrap: bool = True) -> Forest:
    """K9: grow all trees together, one pass over the rows a level.

    ``n_features`` a node, by default floor(sqrt(number of columns)). Without ``bootstrap`` every row counts once in
    every tree. Rows without a label or with a missing feature take no part; without any row each tree is a leaf of 0.5.
    """
    cols = list(cols)
    n_features = min(n_features or max(1, int(math.sqrt(len(cols)))), len(cols))
    bag = bag_counts(id_col, n_trees, seed) if bootstrap else F.array_repeat(F.lit(1), n_trees)
    used = df.where(F.col(label).isNotNull() & complete_row(cols))
    rows = used.select((F.col(label) == 1).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
                       bag.alias("bag")).persist()
    forest = Forest(cols, n_trees, max_depth)
    try:
        found = cut_points(used, cols)
        cuts = [np.array(found[c], dtype=np.float64) for c in cols]
        counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        n, classes = sum(counts.values()), len(counts)
        weights = [n / (classes * counts[c]) if balanced and counts.get(c) else 1.0 for c in (0, 1)]
        sums = rows.select(F.posexplode(F.zip_with("bag", F.array_repeat("y", n_trees), lambda b, y: F.struct(
            (b * (1 - y)).alias("n0"), (b * y).alias("n1")))).alias("tree", "c")).groupBy("tree").agg(
                F.sum("c.n0").alias("n0"), F.sum("c.n1").alias("n1")).collect()
        totals = {(r["tree"], 1): (r["n0"], r["n1"]) for r in sums}
        totals |= {(t, 1): (0, 0) for t in range(n_trees) if (t, 1) not in totals}
        for depth in range(max_depth + 1):
            open_ = [key for key, (n0, n1) in sorted(totals.items())
                     if depth < max_depth and n0 + n1 >= min_samples and n0 and n1]
            split = _split_level(rows, forest, cuts, open_, n_features, weights, seed) if open_ else {}
            children = {}
            for (tree, node), (n0, n1) in sorted(totals.items()):
                zero, one = n0 * weights[0], n1 * weights[1]
                j, c, left, right = split.get((tree, node), (None, None, None, None))
                forest.nodes.append((tree, node, depth, n0 + n1, zero + one, gini(zero, one),
                                     one / (zero + one) if n0 + n1 else 0.5, None if j is None else cols[j], c))
                if j is not None:
                    children[tree, 2 * node], children[tree, 2 * node + 1] = left, right
            totals = children
    finally:
        rows.unpersist()
    return forest


def _split_level(rows: DataFrame, forest: Forest, cuts, open_, n_features: int, weights, seed: int) -> dict:
    """{(tree, node): (feature, cut, left counts, right counts)} of the open nodes that can be split."""
    feature, cut, _ = forest.arrays()
    slot = np.full(feature.shape, -1, dtype=np.int64)
    subset = np.zeros((len(open_), n_features), dtype=np.int64)
    for i, (tree, node) in enumerate(open_):
        slot[tree, node] = i
        subset[i] = node_features(forest.cols, n_features, seed, tree, node)
    histogram = rows.mapInPandas(_histogram(feature, cut, cuts, slot, subset, n_features),
                                 "slot long, place long, bin long, n0 long, n1 long")
    histogram = histogram.groupBy("slot", "place", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = {}
    for r in best_cuts(histogram, *weights).collect():  # at most a row per open node
        j = int(subset[r["slot"], r["place"]])
        out[open_[r["slot"]]] = (j, float(cuts[j][r["bin"]]), (r["l0"], r["l1"]), (r["r0"], r["r1"]))
    return out


def node_table(rows: DataFrame, tree: DataFrame, label: str, weight: Column | None = None) -> DataFrame:
    """(node, feature, cut, n, weight, gini, value) of a given tree over given rows.

    ``tree``: (node, feature, cut) of the inner nodes, by heap number. Every row counts in each node on its way down;
    ways are expressions over the row, so the pass is one aggregate. Nodes that no row reaches are absent.
    """
    inner = {r["node"]: (r["feature"], r["cut"]) for r in tree.select("node", "feature", "cut").collect()}

    def way(node: int) -> Column:
        here = F.array(F.lit(node))
        if node not in inner:
            return here
        f, c = inner[node]
        return F.concat(here, F.when(F.col(f) <= F.lit(c), way(2 * node)).otherwise(way(2 * node + 1)))

    w = weight if weight is not None else F.lit(1.0)
    each = rows.where(F.col(label).isNotNull()).select(F.explode(way(1)).alias("node"), F.col(label).alias("_y"), w.alias("_w"))
    stat = each.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("weight"),
                                    F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("_w1"))
    p1 = F.col("_w1") / F.col("weight")
    return stat.join(tree.select("node", "feature", "cut"), "node", "left").select(
        "node", "feature", "cut", "n", "weight", (1 - p1 * p1 - (1 - p1) * (1 - p1)).alias("gini"), p1.alias("value"))


def importances(nodes: DataFrame, cols: Sequence[str], tree_col: str | None = None) -> DataFrame:
    """(feature, importance) from a node table, normalised to a sum of 1 (all 0 if nothing was split).

    Importance of a feature: over its inner nodes, the node's share of its tree's weight times the Gini that its children
    take away, at least 0 a node.
    """
    tree = F.col(tree_col) if tree_col else F.lit(0)
    n = nodes.select(tree.alias("t"), "node", "feature", "weight", "gini")
    root = n.where(F.col("node") == 1).select("t", F.col("weight").alias("root"))
    side = lambda s, bit: n.select("t", F.expr("node div 2").cast("int").alias("node"), F.col("weight").alias(f"w{s}"),
                                   F.col("gini").alias(f"g{s}"), (F.col("node") % 2).alias("_bit")).where(
                                       (F.col("_bit") == bit) & (F.col("node") > 0)).drop("_bit")
    met = (n.where(F.col("feature").isNotNull()).withColumn("node", F.col("node").cast("int"))
           .join(side("l", 0), ["t", "node"], "left").join(side("r", 1), ["t", "node"], "left").join(root, "t"))
    part = lambda s: F.coalesce(F.col(f"w{s}") / F.col("weight") * F.col(f"g{s}"), F.lit(0.0))
    gain = F.greatest(F.lit(0.0), F.col("weight") / F.col("root") * (F.col("gini") - part("l") - part("r")))
    sums = met.groupBy("feature").agg(F.sum(gain).alias("s"))
    total = Window.partitionBy()  # a row per feature
    every = nodes.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return every.join(sums, "feature", "left").withColumn("s", F.coalesce("s", F.lit(0.0))).select(
        "feature", F.when(F.sum("s").over(total) > 0, F.col("s") / F.sum("s").over(total)).otherwise(F.lit(0.0))
        .alias("importance"))

