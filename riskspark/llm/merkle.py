"""Merkle manifest of a dataset as a persistent, path-copying tree (operator 13).

Leaves are ranked inside their group (one tree a group) by a range partition and small counts, then cut into aligned
blocks of ``1 << BLOCK_BITS`` leaves. A block builds its subtree in one task; the block tops are the leaves of the next
tier, which is cut into blocks the same way, until every group has one node. The group roots are the leaves of one more
tree of that kind, whose top is the root of the dataset.

A changed leaf makes a new version of the tree: it copies its ancestors only and shares every other node with the first
version. ``manifest`` makes the copies inside the leaf's block and continues them along the upper tiers, where the path
of a block is one short row, so a version never needs more than its block and that row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.frames import pick, stored

BLOCK_BITS = 10
_NODE = "grp string, pos long, path array<string>, block long"


def node(children: Sequence[str]) -> str:
    """Digest of a run of one or two nodes, given and returned as lowercase hex."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Block:
    """An aligned subtree of a given height: ``levels[0]`` holds its leaves, ``levels[-1]`` its top."""

    def __init__(self, leaves: list[str], height: int):
        self.levels = [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([node(below[i:i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[str]:
        """The sibling on each level: ``L`` or ``R`` (where it stands) and its digest, empty if there is none."""
        out = []
        for level in self.levels[:-1]:
            other = at ^ 1
            out.append(("L" if other < at else "R") + level[other] if other < len(level) else "")
            at >>= 1
        return out


def copies(leaf: str, path: list[str]) -> list[str]:
    """The nodes that a version with this leaf copies, from the leaf to the top; all others it shares."""
    out = [leaf]
    for step in path:
        pair = [out[-1]] if not step else [step[1:], out[-1]] if step[0] == "L" else [out[-1], step[1:]]
        out.append(node(pair))
    return out


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (place in the group by ``order``, nulls first, from 0) and ``n`` (rows of the group).

    The rows are sorted over range partitions and written; a group's place in a partition follows from counts per
    partition, so a group may hold any share of the rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    laid = stored(laid, "ranked")
    counts = laid.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_here"))
    of_group = Window.partitionBy(group)
    before = F.sum("_here").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    table = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first",
                          F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_here").over(of_group).alias("n"))
    met = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))
    return (laid.join(table, met).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_part", "_at", "_p", "_g", "_first", "_before"))


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    return max(0, int(n) - 1).bit_length()


def _tier(nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(the path of every node within its block, the block tops) for rows (grp, pos, n, digest)."""

    def build(key, pdf):
        import pandas as pd
        pdf = pdf.sort_values("pos")
        block = Block(pdf["digest"].tolist(), min(bits, height_of(pdf["n"].iloc[0])))
        return pd.DataFrame({"grp": key[0], "pos": pdf["pos"].to_numpy(), "block": key[1], "top": block.top,
                             "path": [block.path(i) for i in range(len(pdf))],
                             "n": (int(pdf["n"].iloc[0]) - 1 >> bits) + 1})

    built = stored(nodes.groupBy("grp", F.shiftright("pos", bits).alias("block"))
                   .applyInPandas(build, f"{_NODE}, top string, n long"), "tier")
    tops = built.where(F.col("pos") == F.shiftleft("block", bits)).select(
        "grp", F.col("block").alias("pos"), "n", F.col("top").alias("digest"))
    return built.select("grp", "pos", "path", "block"), tops


def upper_paths(tops: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, path, root) for rows (grp, pos, n, digest): the siblings of every node up to its group's root."""
    tiers, here = [], tops
    while (here.agg(F.max("n")).first()[0] or 0) > 1:
        paths, here = _tier(here, bits)
        tiers.append(paths)
    out = here.select("grp", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    for paths in reversed(tiers):
        above = out.select(F.col("grp").alias("_g"), F.col("pos").alias("_b"), F.col("path").alias("_above"), "root")
        out = paths.join(above, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).select(
            "grp", "pos", F.concat("path", "_above").alias("path"), "root")
    return out


def _block_tops(leaves: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, n, digest) of the blocks of the leaves (grp, pos, n, leaf)."""

    def build(key, pdf):
        import pandas as pd
        n = int(pdf["n"].iloc[0])
        block = Block(pdf.sort_values("pos")["leaf"].tolist(), min(bits, height_of(n)))
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [(n - 1 >> bits) + 1], "digest": [block.top]})

    return (leaves.select("grp", "pos", "n", "leaf").groupBy("grp", F.shiftright("pos", bits).alias("block"))
            .applyInPandas(build, "grp string, pos long, n long, digest string"))


def _prove(bits: int):
    def prove(key, rows, upper):
        """Every leaf of a block: its proof up to the root and the nodes that its version copies."""
        import pandas as pd
        rows = rows.sort_values("pos")
        above = list(upper["path"].iloc[0])
        block = Block(rows["leaf"].tolist(), min(bits, height_of(rows["n"].iloc[0])))
        out = {c: [] for c in ("proof_sha256", "folded_root", "copied", "shared")}
        for at, changed in enumerate(rows["changed"].tolist()):
            path = block.path(at) + above
            version = copies(block.levels[0][at] if changed is None else changed, path)
            out["proof_sha256"].append(node([step[1:] for step in path]))
            out["folded_root"].append(version[-1])
            out["copied"].append(None if changed is None else version)
            out["shared"].append(None if changed is None else path)
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": upper["subroot"].iloc[0],
                             "root": upper["root"].iloc[0], **out})

    return prove


def leaf_of(columns: Sequence[str], change: str | None = None) -> Column:
    """Digest of a row: each column as ``-`` if null, else its length in UTF-8 bytes, a colon and the value.

    ``change`` names a number column that counts one more.
    """
    fields = []
    for name in columns:
        value = F.col(name)
        if name == change:
            value = value.cast("decimal(20,0)") + 1
        value = value.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def manifest(docs: DataFrame, tampered: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256,
    folded_root, copied, shared.

    A tree per ``lang`` (null is one, the first), leaves by doc_id (nulls first; rows that share one by digest), and a
    tree over their roots by ``lang``. ``tampered`` picks the rows whose leaf is replaced by that of one more n_chars,
    each in a version of its own: ``copied`` are the nodes of the version from leaf to root, ``shared`` the untouched
    nodes beside them (with their side, empty if none); both are null for other rows, whose ``folded_root`` comes from
    their own leaf. A null in ``tampered`` is false; a null n_chars stays null. An empty table has no rows.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = pick(docs, **{c: c for c in names}).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("grp"), leaf_of(names).alias("leaf"),
        F.when(tampered, leaf_of(names, "n_chars")).alias("changed"))
    leaves = ranked(rows, "grp", ("doc_id", "leaf"))
    to_subroot = stored(upper_paths(stored(_block_tops(leaves, bits), "blocks"), bits), "upper")
    subroots = to_subroot.groupBy("grp").agg(F.first("root").alias("digest"))
    # the trees of the groups are the leaves of the last tree
    placed = ranked(subroots.select(F.lit("").alias("one"), "grp", "digest"), "one", ("grp",))
    placed = stored(placed, "subroots")
    tops = upper_paths(placed.select(F.col("one").alias("grp"), "pos", "n", "digest"), bits)
    last = placed.select(F.col("grp").alias("_g"), "pos", F.col("digest").alias("subroot")).join(
        tops.select("pos", F.col("path").alias("_above"), F.col("root").alias("_root")), "pos").drop("pos")
    upper = to_subroot.join(last, F.col("grp").eqNullSafe(F.col("_g"))).select(
        "grp", F.col("pos").alias("block"), F.concat("path", "_above").alias("path"), "subroot",
        F.col("_root").alias("root"))
    return (leaves.withColumn("block", F.shiftright("pos", bits)).groupBy("grp", "block")
            .cogroup(upper.groupBy("grp", "block"))
            .applyInPandas(_prove(bits), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, copied array<string>, shared array<string>"))
