"""Exact k-nearest-neighbour join in packed tiles.

Pivot partitioning with triangle-inequality pruning (after Lu, Shen, Chen, Ooi, VLDB 2012), on blocks instead of rows:

1. Distinct vectors are written once. ``P`` pivots are the base rows with the smallest md5(seed:id), put in a
   neighbourly order. P is at least the square root of the number of vectors at every size, so cells don't outgrow
   their number; the pivot matrix in the tasks grows with that root only.
2. Every row goes to its nearest pivot's cell. Neighbouring cells are packed into tiles: one record holds the ids and
   vectors of a bounded block of rows. A cell larger than a tile is dealt over several.
3. Probe: a query tile meets the base tile of its own cells. The k-th distance found there bounds each query's answer.
4. A base tile survives for a query if it has a cell with d(query, pivot) - radius within that bound. Surviving pairs
   are (tile, tile, bit per query): ids only. Each pair then brings its two tiles together once, and returns what lies
   within the bound.
5. The final top-k per query is ranked over those rows, ties by id.

A search can be confined to rows of the query's own key (``within``: tiles are built inside a key, so one pass serves all
classes of a SMOTE) or to rows outside the query's own group (``unlike``: one pass gives every row its neighbours under
the fold that leaves it out).

The result is exact: pruning only drops tiles that can't hold one of the k nearest rows (a small slack guards
floating error). On few dimensions most tiles go.

On many dimensions (the 64-d embeddings) nearly all tiles would survive, so vectors of more than ``WIDE`` are swept
instead (``_swept``): a block of queries meets a chunk of base rows in one group, which keeps the k nearest so far and
their bound from tile to tile. A row is shipped once per block or chunk of the other side, not once per pair of tiles,
and a group returns k rows a query. A matrix product and its rounding bound pick the distances that are summed exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from riskspark.functions.columns import hash_hex
from riskspark.session import cut_lineage

CELL_ROWS = 64  # target base rows per pivot cell while there are few rows (more cells = tighter pruning)
FINE_PIVOTS = 4096  # cells of that size up to this many; beyond it the square root of the rows decides
TILE_ROWS, TILE_BYTES = 4096, 1 << 20  # of one packed record
SLACK = 1e-9
RUN_ROWS = 64  # queries that meet a tile's rows together
CACHED_CELLS = 1 << 16  # of a block of distances that is summed dimension by dimension
WIDE = 16  # beyond so many dimensions a matrix product tells which distances are worth the exact sum
GROUP_BYTES, GROUP_CELLS = 16 << 20, 2_000_000_000  # of a block of queries or a chunk of base rows; distances of a group
GROUPS_PER_CORE, LEAST_CELLS = 4, 20_000_000  # groups while they have at least so many distances
NO_FOLD = np.iinfo(np.int64).min  # of a row that no fold leaves out
SALT_ROWS = 100_000  # rows of one query vector that one join key may hold
MAX_HOT = 4096  # vectors that can be hotter than that are at most so many
_KEEP = StorageLevel.MEMORY_AND_DISK


def _pivot_count(n_base: int, max_pivots: int | None) -> int:
    want = max(math.sqrt(max(n_base, 1)), min(FINE_PIVOTS, n_base / CELL_ROWS))
    return int(max(1, round(min(want, max_pivots or want))))


def _as_matrix(series: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.values])


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, summed dimension by dimension."""
    d2, diff = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for a, b in zip(x.T, np.ascontiguousarray(y.T), strict=True):
        np.subtract(a[:, None], b[None, :], out=diff)
        diff *= diff
        d2 += diff
    return d2


def _pivot_distances(x: np.ndarray, piv: np.ndarray):
    """(first row, exact distances of a slice of rows to the pivots), slice by slice."""
    step = max(1, CACHED_CELLS // max(1, len(piv)))
    for s0 in range(0, len(x), step):
        yield s0, np.sqrt(_squared(x[s0:s0 + step], piv))


def _neighbourly(piv: np.ndarray) -> np.ndarray:
    """Order of the pivots by halving at the median of the widest dimension, so that close pivots get close numbers."""
    todo, order = [np.arange(len(piv))], []
    while todo:
        part = todo.pop()
        if len(part) == 1:
            order.append(part[0])
            continue
        x = piv[part]
        ranked = part[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
        half = len(part) // 2
        todo += [ranked[half:], ranked[:half]]
    return np.array(order)


def _nearest_pivot(x: np.ndarray, piv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, exact distance to it) of every row. A matrix product tells the nearest one: where it rounds to a pivot that
    is a little farther, the row is in that one's cell, whose radius covers it."""
    turned, norm = -2 * piv.T, (piv * piv).sum(axis=1)
    cell, step = np.empty(len(x), dtype=np.int32), max(1, CACHED_CELLS // len(piv))
    for s0 in range(0, len(x), step):
        d2 = x[s0:s0 + step] @ turned
        d2 += norm
        cell[s0:s0 + step] = d2.argmin(axis=1)
    own = np.zeros(len(x))
    for a, b in zip(x.T, piv[cell].T, strict=True):
        own += (a - b) ** 2
    return cell, np.sqrt(own)


def _assign_cells(rows: DataFrame, piv: np.ndarray, feat_col: str) -> DataFrame:
    """Nearest pivot and exact distance to it for every row."""
    def assign(batches):
        for pdf in batches:
            if len(pdf):
                cell, far = _nearest_pivot(_as_matrix(pdf[feat_col]), piv)
                yield pdf.assign(_cell=cell, _dpiv=far)

    return rows.mapInPandas(assign, StructType(rows.schema.fields + [StructField("_cell", IntegerType()),
                                                                     StructField("_dpiv", DoubleType())]))


class _Slots:
    """The occupied (key, cell) pairs, sorted: base and query rows, radius, group of neighbouring slots of one key.

    Query tiles lie inside the groups of the base, which gives them close bounds. With ``full`` they are filled across
    groups (``q_group``, its first base group in ``home``): where nearly all tiles survive anyway, the number of query
    tiles tells how often the base is shipped.
    """

    def __init__(self, base: pd.DataFrame, queries: pd.DataFrame, tile_rows: int, query_tile_rows: int, full: bool):
        both = base.merge(queries, on=["_key", "_cell"], how="outer", suffixes=("", "_q")).sort_values(["_key", "_cell"])
        self.key, self.cell = both["_key"].to_numpy(np.int64), both["_cell"].to_numpy(np.int64)
        self.count, self.asked = both["n"].fillna(0).to_numpy(float), both["n_q"].fillna(0).to_numpy(float)
        self.reach = np.where(self.count > 0, both["radius"].fillna(0).to_numpy(float), -np.inf)
        self.span = {}
        self.group, n_groups = np.zeros(len(both), dtype=np.int64), 0
        for key in np.unique(self.key).tolist():
            lo, hi = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
            own = self.count[lo:hi]
            _, group = np.unique((np.cumsum(own) - own) // tile_rows, return_inverse=True)
            self.group[lo:hi] = group + n_groups
            n_groups += int(group.max()) + 1
            self.span[key] = (int(lo), int(hi))
        self.q_group, self.home = self.group, self.group
        if full:
            part = [(np.cumsum(self.asked[lo:hi]) - self.asked[lo:hi]) // query_tile_rows for lo, hi in self.span.values()]
            _, start, self.q_group = np.unique(np.stack([self.key, np.concatenate(part).astype(np.int64)]), axis=1,
                                               return_index=True, return_inverse=True) if part else (None, [], self.group)
            self.q_group = self.q_group.ravel()
            self.home = self.group[start][self.q_group] if part else self.group

    def tiles(self, count: np.ndarray, tile_rows: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first tile, number of tiles) of every group, for rows counted per slot."""
        rows = np.bincount(group, weights=count)
        tiles = np.maximum(1, np.ceil(rows / (1.5 * tile_rows))).astype(np.int64)
        return np.cumsum(tiles) - tiles, tiles


def _packed(assigned: DataFrame, slots: _Slots, group: np.ndarray, home: np.ndarray, first: np.ndarray,
            tiles: np.ndarray, id_col: str, feat_col: str, prefix: str) -> DataFrame:
    """One record per tile: its number, key and (base) group of slots, ids, folds and vectors of its rows."""
    table = pd.DataFrame({"_key": slots.key, "_cell": slots.cell.astype(np.int32), "_group": home.astype(np.int32),
                          "_first": first[group], "_tiles": tiles[group]})
    cells = assigned.sparkSession.createDataFrame(
        table, "_key long, _cell int, _group int, _first long, _tiles long")  # a row per key and pivot
    dealt = assigned.join(F.broadcast(cells), ["_key", "_cell"]).withColumn(
        "_tile", F.col("_first") + F.pmod(F.xxhash64(id_col), F.col("_tiles")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": pdf["_tile"].iloc[:1], "key": pdf["_key"].iloc[:1], "group": pdf["_group"].iloc[:1],
                             "ids": [pdf[id_col].to_numpy()],
                             "folds": [pdf["_fold"].to_numpy(np.int64).tobytes()],
                             "vec": [_as_matrix(pdf[feat_col]).tobytes()]})

    schema = StructType([StructField("tile", LongType()), StructField("key", LongType()),
                         StructField("group", IntegerType()),
                         StructField("ids", ArrayType(assigned.schema[id_col].dataType)),
                         StructField("folds", BinaryType()), StructField("vec", BinaryType())])
    records = dealt.select("_tile", "_key", "_group", "_fold", id_col, feat_col).groupBy("_tile").applyInPandas(pack, schema)
    return records.toDF(*[f"{prefix}{c}" for c in records.columns])


def _nearest(x: np.ndarray, y: np.ndarray, y_ids: np.ndarray, k: int, bound: np.ndarray, x_folds: np.ndarray,
             y_folds: np.ndarray, slice_cells: int = 1_000_000):
    """(row of x, row of y, squared distance): the k nearest rows of y within ``bound`` of each row, ties by id.

    Rows of one fold are no neighbours of each other; fold ``NO_FOLD`` leaves nothing out.

    The squared distance is summed dimension by dimension (same order as a SQL ``reduce`` over the zipped arrays), so
    values are bit-identical.
    """
    by_id = np.argsort(y_ids, kind="stable")  # numbers or text
    y, y_folds, k = y[by_id], y_folds[by_id], min(k, len(y))
    split = bool((x_folds != NO_FOLD).any())
    if x.shape[1] <= WIDE:
        return _nearest_along(x, y, by_id, k, bound, x_folds, y_folds, split)
    x_norm, y_norm = (x * x).sum(axis=1), (y * y).sum(axis=1)
    # what rounding can do to a distance taken from the matrix product
    off = 16 * np.finfo(float).eps * (x.shape[1] + 8) * (np.sqrt(x_norm) + np.sqrt(y_norm.max(initial=0.0))) ** 2
    wide = bool(np.isfinite(off).all())
    step = max(1, (slice_cells if wide else CACHED_CELLS) // max(1, len(y)))
    turned = -2 * y.T if wide else None
    out = []
    for s0 in range(0, len(x), step):
        xs = x[s0:s0 + step]
        own = x_folds[s0:s0 + step]
        if wide:  # squared distances less the query's own norm
            d2 = xs @ turned
            d2 += y_norm
            limit, more = bound[s0:s0 + step] + off[s0:s0 + step] - x_norm[s0:s0 + step], 2 * off[s0:s0 + step]
        else:
            d2 = _squared(xs, y)
            limit, more = bound[s0:s0 + step], 0.0
        out_of = (own[:, None] == y_folds[None, :]) & (own != NO_FOLD)[:, None] if split else None
        if split:
            d2[out_of] = np.inf
        near = d2 <= limit[:, None]
        if np.count_nonzero(near) > 4 * k * len(xs):  # the bound alone leaves too much
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            near &= d2 <= (kth + more)[:, None]
        r, c = np.divmod(np.flatnonzero(near & ~out_of if split else near), len(y))
        if wide:
            d = np.zeros(len(r))
            for j in range(x.shape[1]):
                diff = xs[r, j] - y[c, j]
                d += diff * diff
            within = d <= bound[s0 + r]
            r, c, d = r[within], c[within], d[within]
        else:
            d = d2[r, c]
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)  # of ties at the k-th distance the smaller ids stay
        out.append((r[place < k] + s0, by_id[c[place < k]], d[place < k]))
    return tuple(np.concatenate(part) for part in zip(*out))


def _nearest_along(x: np.ndarray, y: np.ndarray, by_id: np.ndarray, k: int, bound: np.ndarray, x_folds: np.ndarray,
                   y_folds: np.ndarray, split: bool):
    """``_nearest`` on few dimensions, for rows of y in id order: both sides are sorted along the widest dimension, and a
    run of x meets the rows of y that lie no farther along it than the run's largest bound."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    if not len(x) or not len(y):
        return none
    dim = int(np.ptp(y, axis=0).argmax())
    order, asked = np.argsort(y[:, dim], kind="stable"), np.argsort(x[:, dim], kind="stable")
    y, y_folds = y[order], y_folds[order]
    along = np.ascontiguousarray(y[:, dim])
    out = [none]

    def squared(rows, own, lo, hi):
        """Squared distances, and which pairs are of one fold."""
        d2 = _squared(rows, y[lo:hi])
        out_of = (own[:, None] == y_folds[None, lo:hi]) & (own != NO_FOLD)[:, None] if split else None
        if split:
            d2[out_of] = np.inf
        return d2, out_of

    for s0 in range(0, len(x), RUN_ROWS):
        at = asked[s0:s0 + RUN_ROWS]
        xs, own, limit = x[at], x_folds[at], bound[at]
        first, last = xs[0, dim], xs[-1, dim]
        lo = max(0, int(np.searchsorted(along, first)) - RUN_ROWS - k)
        hi = int(np.searchsorted(along, last, side="right")) + RUN_ROWS + k
        if not np.isfinite(limit).all() and k <= min(hi, len(y)) - lo < len(y):  # close rows bound what is near
            limit = np.minimum(limit, np.partition(squared(xs, own, lo, hi)[0], k - 1, axis=1)[:, k - 1])
        reach = np.sqrt(limit.max()) * (1 + SLACK) + SLACK * max(abs(first), abs(last))
        lo = int(np.searchsorted(along, first - reach))
        hi = int(np.searchsorted(along, last + reach, side="right"))
        step = max(1, CACHED_CELLS // max(1, hi - lo))
        for r0 in range(0, len(xs) if hi > lo else 0, step):
            part = slice(r0, r0 + step)
            d2, out_of = squared(xs[part], own[part], lo, hi)
            near = (d2 <= limit[part, None]) & ~out_of if split else d2 <= limit[part, None]
            if k < hi - lo and np.count_nonzero(near) > 4 * k * len(d2):  # the bound alone leaves too much
                near &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1, None]
            r, c = np.divmod(np.flatnonzero(near), hi - lo)
            d, c = d2[r, c], order[lo + c]
            best = np.lexsort((c, d, r))
            r, c, d = r[best], c[best], d[best]
            place = np.arange(len(r)) - np.searchsorted(r, r)  # of ties at the k-th distance the smaller ids stay
            out.append((at[r0 + r[place < k]], by_id[c[place < k]], d[place < k]))
    r, c, d = (np.concatenate(part) for part in zip(*out))
    by_row = np.argsort(r, kind="stable")
    return r[by_row], c[by_row], d[by_row]


def _block(ids, vec: bytes, folds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(ids)
    return ids, np.frombuffer(vec, dtype=np.float64).reshape(len(ids), -1), np.frombuffer(folds, dtype=np.int64)


def _probe(k: int):
    """A query tile with the base tile of its cells: what it finds there, and the k-th distance (squared) per query."""
    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                q_ids, x, xf = _block(t.q_ids, t.q_vec, t.q_folds)
                bound = np.full(len(x), np.inf)
                if t.b_ids is None:  # no base row came to these cells
                    yield pd.DataFrame({"q_tile": [t.q_tile], "probed": [-1], "bound": [bound.tobytes()],
                                        "hit_q": [[]], "hit_b": [[]], "hit_d": [[]]})
                    continue
                b_ids, y, yf = _block(t.b_ids, t.b_vec, t.b_folds)
                r, c, d = _nearest(x, y, b_ids, k, bound, xf, yf)
                bound[r] = d  # the last one of each row is its k-th, if it has k
                bound[np.bincount(r, minlength=len(x)) < k] = np.inf
                yield pd.DataFrame({"q_tile": [t.q_tile], "probed": [t.b_tile], "bound": [bound.tobytes()],
                                    "hit_q": [q_ids[r]], "hit_b": [b_ids[c]], "hit_d": [d]})

    return run


def _within_reach(x: np.ndarray, limit: np.ndarray, piv: np.ndarray, reach: np.ndarray, group: np.ndarray, n_groups: int
                  ) -> np.ndarray:
    """Rows of x by groups: has the group a cell (pivot, reach) with distance - reach within the row's limit?

    A run of rows is asked of the cells only that its box, grown by its largest limit, comes to.
    """
    ok = np.zeros((len(x), n_groups), dtype=bool)
    if not len(x):
        return ok
    order = np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")
    for s0 in range(0, len(x), RUN_ROWS):
        at = order[s0:s0 + RUN_ROWS]
        xs = x[at]
        gap = np.maximum(np.maximum(xs.min(axis=0) - piv, piv - xs.max(axis=0)), 0.0)
        near = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) * (1 - SLACK) - reach <= limit[at].max())
        if not len(near):
            continue
        starts = np.flatnonzero(np.diff(group[near], prepend=-1))
        d = np.concatenate([d for _, d in _pivot_distances(xs, piv[near])])
        d -= reach[near]
        ok[at[:, None], group[near[starts]]] = np.minimum.reduceat(d, starts, axis=1) <= limit[at, None]
    return ok


def _survivors(piv: np.ndarray, slots: _Slots, first: np.ndarray, tiles: np.ndarray):
    """(query tile, base tile, bit per query) of the tiles that may hold one of the k nearest rows of a query."""

    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                x = _block(t.q_ids, t.q_vec, t.q_folds)[1]
                lo, hi = slots.span[t.q_key]
                own = slots.group[lo:hi]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                limit = np.sqrt(np.frombuffer(t.bound, dtype=np.float64)) * (1 + SLACK) + SLACK
                ok = _within_reach(x, limit, piv[slots.cell[lo:hi]], slots.reach[lo:hi], own - own[0], len(starts))
                for i in np.flatnonzero(ok.any(axis=0)).tolist():
                    g = own[starts[i]]
                    bits = np.packbits(ok[:, i]).tobytes()
                    met = [b for b in range(first[g], first[g] + tiles[g]) if b != t.probed]
                    yield pd.DataFrame({"q_tile": t.q_tile, "b_tile": met, "bits": [bits] * len(met)})

    return run


def _meet(k: int):
    """The two tiles of a surviving pair: rows within the bound of the queries for which the tile survived."""
    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                q_ids, x, xf = _block(t.q_ids, t.q_vec, t.q_folds)
                b_ids, y, yf = _block(t.b_ids, t.b_vec, t.b_folds)
                rows = np.flatnonzero(np.unpackbits(np.frombuffer(t.bits, dtype=np.uint8), count=len(x)))
                r, c, d = _nearest(x[rows], y, b_ids, k, np.frombuffer(t.bound, dtype=np.float64)[rows], xf[rows], yf)
                yield pd.DataFrame({"q_id": q_ids[rows[r]], "nb_id": b_ids[c], "_d2": d})

    return run


def _dealt(rows: DataFrame, table: pd.DataFrame, id_col: str, feat_col: str) -> DataFrame:
    """One record per tile of a key: its group, tile number, ids, folds and vectors. ``table``: a row per key."""
    plan = rows.sparkSession.createDataFrame(table[["_key", "_tiles", "_groups"]], "_key long, _tiles long, _groups long")
    placed = rows.join(F.broadcast(plan), "_key").withColumn("_tile", F.pmod(F.xxhash64(id_col, feat_col), F.col("_tiles")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1], "_group": pdf["_tile"].iloc[:1] % pdf["_groups"].iloc[0],
                             "ids": [pdf[id_col].to_numpy()],
                             "folds": [pdf["_fold"].to_numpy(np.int64).tobytes()],
                             "vec": [_as_matrix(pdf[feat_col]).tobytes()]})

    schema = StructType([StructField("_key", LongType()), StructField("_group", LongType()),
                         StructField("ids", ArrayType(rows.schema[id_col].dataType)),
                         StructField("folds", BinaryType()), StructField("vec", BinaryType())])
    return placed.groupBy("_key", "_tile").applyInPandas(pack, schema)


def _running(k: int, tile_rows: int):
    """A block of queries and a chunk of base rows: the k nearest of the chunk, kept from tile to tile."""
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, dtype=object), np.zeros(0, dtype=object), np.zeros(0))]
        if len(asked) and len(held):
            parts = [_block(*t) for t in held[["ids", "vec", "folds"]].itertuples(index=False)]
            ids, y, yf = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(ids, kind="stable")
            ids, y, yf, at = ids[order], y[order], yf[order], np.arange(len(order))
            for t in asked[["ids", "vec", "folds"]].itertuples(index=False):
                q_ids, x, xf = _block(*t)
                r, c, d = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
                bound = np.full(len(x), np.inf)
                for lo in range(0, len(y), tile_rows):
                    part = slice(lo, lo + tile_rows)
                    r2, c2, d2 = _nearest(x, y[part], at[part], k, bound, xf, yf[part])
                    r, c, d = np.concatenate([r, r2]), np.concatenate([c, c2 + lo]), np.concatenate([d, d2])
                    best = np.lexsort((c, d, r))
                    r, c, d = r[best], c[best], d[best]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, d, place = r[place < k], c[place < k], d[place < k], place[place < k]
                    bound[r[place == k - 1]] = d[place == k - 1]
                found.append((q_ids[r], ids[c], d))
        q_id, nb_id, d2 = (np.concatenate(p) for p in zip(*found[1:] or found))
        return pd.DataFrame({"q_id": q_id, "nb_id": nb_id, "_d2": d2})

    return run


def _swept(queries: DataFrame, base: DataFrame, k: int, id_col: str, feat_col: str, dims: int, tile_rows: int | None,
           query_block_rows: int | None) -> DataFrame:
    """Exact top-k (q_id, nb_id, _d2) per query by sweeping every chunk of base rows past every block of queries.

    The work is all queries times all rows of their key; a group holds one block and one chunk, both bounded by bytes.
    """
    def counted(rows, name):
        return rows.groupBy("_key").agg(F.count(F.lit(1)).alias(name)).toPandas()  # a row per key

    fit = max(1, min(TILE_ROWS, TILE_BYTES // (8 * dims)))
    tile, most = tile_rows or fit, max(1, GROUP_BYTES // (8 * dims))
    size = counted(base, "n").merge(counted(queries, "asked"), on="_key").sort_values("_key")
    cells = float((size["n"] * size["asked"].astype(float)).sum())
    cores = base.sparkSession.sparkContext.defaultParallelism
    each = min(GROUP_CELLS, max(LEAST_CELLS, cells / (GROUPS_PER_CORE * cores)))
    size["blocks"] = np.ceil(size["asked"] / min(query_block_rows or most, most)).astype(np.int64)
    rows = np.minimum(each / np.ceil(size["asked"] / size["blocks"]), most)
    size["b_tiles"] = np.ceil(size["n"] / tile).astype(np.int64)
    size["chunks"] = np.minimum(np.ceil(size["n"] / rows), size["b_tiles"]).astype(np.int64)
    size["q_tiles"] = np.maximum(np.ceil(size["asked"] / fit).astype(np.int64), size["blocks"])

    def sent(packed: DataFrame, to: str, group: str, other: str) -> DataFrame:
        plan = base.sparkSession.createDataFrame(size[["_key", to]], f"_key long, {to} long")
        return packed.withColumnRenamed("_group", group).join(F.broadcast(plan), "_key").withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1))).drop(to)

    plans = [size.rename(columns=names) for names in ({"q_tiles": "_tiles", "blocks": "_groups"},
                                                      {"b_tiles": "_tiles", "chunks": "_groups"})]
    asked = sent(_dealt(queries, plans[0], id_col, feat_col), "chunks", "_block", "_chunk")
    held = sent(_dealt(base, plans[1], id_col, feat_col), "blocks", "_chunk", "_block")
    hits = StructType([StructField("q_id", queries.schema[id_col].dataType),
                       StructField("nb_id", base.schema[id_col].dataType), StructField("_d2", DoubleType())])
    met = [side.groupBy("_key", "_block", "_chunk") for side in (asked, held)]
    near = met[0].cogroup(met[1]).applyInPandas(_running(k, tile), hits)
    w = Window.partitionBy("q_id").orderBy("_d2", "nb_id")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _knn_core(queries: DataFrame, base: DataFrame, n_base: int, k: int, id_col: str, feat_col: str, seed: int,
              max_pivots: int | None, tile_rows: int | None, query_tile_rows: int | None, kept: list) -> DataFrame:
    """Exact top-k (q_id, nb_id, _d2) per query over distinct base vectors; ``kept`` collects what is persisted."""
    dims = base.select(F.size(feat_col)).first()[0]
    if dims > WIDE:
        return _swept(queries, base, k, id_col, feat_col, dims, tile_rows, query_tile_rows)
    top = (base.withColumn("_h", hash_hex(seed, "pivot", F.col(id_col))).orderBy("_h", id_col)
               .limit(_pivot_count(n_base, max_pivots)).select(feat_col).collect())
    # (the pivots serve all keys: a key's rows fill the cells that they lie in)
    piv = np.array([r[0] for r in top], dtype=np.float64)
    piv = piv[_neighbourly(piv)]
    fit = max(1, min(TILE_ROWS, TILE_BYTES // (8 * max(1, piv.shape[1]))))

    def cells_of(rows: DataFrame):
        placed = _assign_cells(rows, piv, feat_col).persist(_KEEP)
        kept.append(placed)
        return placed, placed.groupBy("_key", "_cell").agg(F.count(F.lit(1)).alias("n"),
                                                           F.max("_dpiv").alias("radius")).toPandas()  # a row per slot

    placed, stats = cells_of(base)
    q_placed, q_stats = (placed, stats) if queries is base else cells_of(queries)
    slots = _Slots(stats, q_stats, tile_rows or fit, query_tile_rows or fit, False)
    first, tiles = slots.tiles(slots.count, tile_rows or fit, slots.group)
    b_tiles = _packed(placed, slots, slots.group, slots.group, first, tiles, id_col, feat_col, "b_").persist(_KEEP)
    q_tiles = _packed(q_placed, slots, slots.q_group, slots.home, *slots.tiles(
        slots.asked, query_tile_rows or fit, slots.q_group), id_col, feat_col, "q_").persist(_KEEP)
    kept += [b_tiles, q_tiles]

    kind, b_kind = queries.schema[id_col].dataType, base.schema[id_col].dataType
    home = b_tiles.groupBy("b_group").agg(F.min("b_tile").alias("b_tile"))
    probe_schema = StructType([StructField("q_tile", LongType()), StructField("probed", LongType()),
                               StructField("bound", BinaryType()), StructField("hit_q", ArrayType(kind)),
                               StructField("hit_b", ArrayType(b_kind)), StructField("hit_d", ArrayType(DoubleType()))])
    probed = (q_tiles.join(home, F.col("q_group") == F.col("b_group"), "left").drop("b_group")
                     .withColumn("b_tile", F.coalesce("b_tile", F.lit(-1))).join(b_tiles, "b_tile", "left")
                     .mapInPandas(_probe(k), probe_schema).persist(_KEEP))
    kept.append(probed)
    bounded = q_tiles.join(probed.select("q_tile", "probed", "bound"), "q_tile")
    pairs = bounded.mapInPandas(_survivors(piv, slots, first, tiles),
                                "q_tile long, b_tile long, bits binary")
    hits = StructType([StructField("q_id", kind), StructField("nb_id", b_kind), StructField("_d2", DoubleType())])
    far = pairs.join(bounded, "q_tile").join(b_tiles, "b_tile").mapInPandas(_meet(k), hits)
    near = probed.select(F.explode(F.arrays_zip("hit_q", "hit_b", "hit_d")).alias("h")).select(
        F.col("h.hit_q").alias("q_id"), F.col("h.hit_b").alias("nb_id"), F.col("h.hit_d").alias("_d2"))
    w = Window.partitionBy("q_id").orderBy("_d2", "nb_id")
    return near.unionByName(far).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def knn_join(queries: DataFrame, base: DataFrame, k: int, id_col: str = "id", feat_col: str = "features",
             exclude_self: bool = False, payload: tuple[str, ...] = (), seed: int = 42,
             max_pivots: int | None = None, chunk_rows: int | None = None, query_block_rows: int | None = None,
             within: str | None = None, unlike: str | None = None, core=None) -> DataFrame:
    """K nearest base rows per query (Euclidean), ties by base id.

    Output: (q_id, rank 1..k, nb_id, dist, *payload of the neighbour). A query that has no neighbour (its vector is null
    or holds a null, NaN or infinity; no base row is allowed for it) has one row whose other columns are null. Base rows
    without a finite vector are nobody's neighbour.
    ``exclude_self`` drops the base row with the query's id (C2 self-join).
    ``within`` names a column of few values (a class) on both sides: neighbours have the query's value of it (null is a
    value). ``unlike`` names an integer column (a fold) on both sides: neighbours have another value of it; a query
    without a value leaves nothing out.
    ``core`` replaces the exact search over distinct vectors (see ``knn_approx``).
    ``chunk_rows`` and ``query_block_rows`` set the rows of a base and of a query tile (by default what fits 1 MB).

    Identical vectors (of one ``within`` and ``unlike`` value) are collapsed first, so a vector shared by a third of the
    rows is searched once:
    * base: per distinct vector only its ``k+1`` smallest ids are kept
      (``row_number <= k+1``, which Spark limits per task before the shuffle);
    * queries: the search runs once per distinct query vector, and its at most k+1 nearest rows go to the query rows
      as one array by an equi-join, whose hot vectors are salted.
    The k nearest rows always lie within the k+1 nearest distinct vectors
    ranked by (distance, smallest id), so the result is exact.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = base.sparkSession
    kb = k + (1 if exclude_self else 0)
    feat = F.col(feat_col).cast("array<double>")
    key = (F.xxhash64(within) if within else F.lit(0)).cast("long").alias("_key")
    fold = (F.coalesce(F.col(unlike).cast("long"), F.lit(NO_FOLD)) if unlike else F.lit(NO_FOLD)).cast("long").alias("_fold")
    finite = F.coalesce(F.forall(feat_col, lambda v: F.abs(v) < F.lit(math.inf)), F.lit(False))
    same = [feat_col, "_key", "_fold"]
    b = base.select(F.col(id_col), feat.alias(feat_col), key, fold, *payload).where(finite)
    every = queries.select(F.col(id_col), feat.alias(feat_col), key, fold, finite.alias("_ok"))
    q = every.where("_ok")
    vec_hash = F.xxhash64(*same).alias("_hash")
    by_vec = Window.partitionBy(vec_hash, *same)  # sorts by numbers; vectors are compared where hashes are equal
    members = cut_lineage(b.withColumn("_m", F.row_number().over(by_vec.orderBy(id_col))).where(F.col("_m") <= kb)
                           .withColumn("_rep", F.min(id_col).over(by_vec)))
    # one row per distinct query vector (partial aggregation collapses hot vectors map-side)
    qv = cut_lineage(q.groupBy(*same).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("_n")))
    vectors = qv.select(id_col, *same)
    # in a self-join the distinct query vectors are the base representatives
    reps = vectors if queries is base else members.where(F.col("_m") == 1).select(id_col, *same)
    n_base = reps.count()
    extra = [b.schema[c] for c in payload]
    if n_base == 0:
        return every.select(F.col(id_col).alias("q_id"), F.lit(None).cast("int").alias("rank"),
                            F.lit(None).cast(b.schema[id_col].dataType).alias("nb_id"),
                            F.lit(None).cast("double").alias("dist"),
                            *[F.lit(None).cast(c.dataType).alias(c.name) for c in extra])
    kept: list = []
    top = (core or _knn_core)(vectors, reps, n_base, kb, id_col, feat_col, seed, max_pivots, chunk_rows, query_block_rows, kept)
    rows = top.select(F.col("q_id").alias(id_col), F.col("nb_id").alias("_rep"), "_d2").join(
        members.select("_rep", F.col(id_col).alias("nb_id"), *payload), "_rep")
    near = rows.groupBy(id_col).agg(F.slice(F.sort_array(F.collect_list(
        F.struct("_d2", "nb_id", *payload))), 1, kb).alias("_near"))  # of at most (k+1)^2
    unit = max(SALT_ROWS, -(-int(qv.agg(F.sum("_n")).first()[0] or 0) // MAX_HOT))
    hot = qv.where(F.col("_n") > unit).groupBy(vec_hash).agg(F.max(F.ceil(F.col("_n") / unit)).alias("_salts"))
    hot = F.broadcast(hot)  # at most MAX_HOT rows

    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", vec_hash).join(hot, "_hash", "left").withColumn(
            "_salts", F.coalesce("_salts", F.lit(1)).cast("long"))

    answers = (salted(qv.join(near, id_col, "left"))
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
               .select("_hash", *same, F.col("_salt").cast("long").alias("_salt"), "_near"))
    # a query without a vector meets nothing, wherever it is dealt
    asked = salted(every.withColumn(feat_col, F.when(F.col("_ok"), F.col(feat_col)))).select(
        F.col(id_col).alias("q_id"), "_hash", *same, F.pmod(F.xxhash64(id_col), F.when(
            F.col("_ok"), F.col("_salts")).otherwise(F.lit(1 << 20))).alias("_salt"))
    own = F.filter("_near", lambda s: s["nb_id"] != F.col("q_id")) if exclude_self else F.col("_near")
    ranked = asked.join(answers, ["_hash", *same, "_salt"], "left").select(
        "q_id", F.posexplode_outer(F.slice(own, 1, k)).alias("_p", "_s"))
    out = ranked.select("q_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_s.nb_id").alias("nb_id"),
                        F.sqrt("_s._d2").alias("dist"), *[F.col("_s")[c].alias(c) for c in payload])
    # materialise the (q, k) result in the shared checkpoint folder, then release the cached
    # intermediates: no cache outlives the call and downstream joins start from a short lineage
    out = cut_lineage(out)
    for d in kept:
        d.unpersist()
    return out


def self_knn(df: DataFrame, k: int, id_col: str = "id", feat_col: str = "features", asked: Column | None = None,
             **kw) -> DataFrame:
    """Neighbours of every row (of the rows for which ``asked`` holds) among all other rows (self excluded by id,
    k <= n - 1)."""
    return knn_join(df if asked is None else df.where(asked), df, k, id_col, feat_col, exclude_self=True, **kw)


def class_weight_table(train: DataFrame, label: str, balanced: bool = True, unlike: str | None = None,
                       folds: int = 0) -> DataFrame:
    """(_fold, label, _cw): the weight N / (K n_c) of every class over the rows outside each fold, ``_fold`` -1 for all
    rows. One count per fold and class; bounded by both."""
    fold = F.col(unlike).cast("int") if unlike else F.lit(None).cast("int")
    counts = train.where(F.col(label).isNotNull()).groupBy(fold.alias("_own"), label).agg(F.count(F.lit(1)).alias("_n"))
    left_out = F.explode(F.array(*[F.lit(f) for f in [-1, *range(folds)]])).alias("_fold")
    seen = (counts.select("*", left_out).where((F.col("_fold") == -1) | ~F.col("_own").eqNullSafe(F.col("_fold")))
            .groupBy("_fold", label).agg(F.sum("_n").alias("_n")))
    if not balanced:
        return seen.select("_fold", label, F.lit(1.0).alias("_cw"))
    whole = Window.partitionBy("_fold")
    return seen.select("_fold", label, (F.sum("_n").over(whole).cast("double")
                                        / (F.count(F.lit(1)).over(whole) * F.col("_n")).cast("double")).alias("_cw"))


def knn_classify(queries: DataFrame, train: DataFrame, k: int = 5, label: str = "label", id_col: str = "id",
                 feat_col: str = "features", weights: str = "distance", balanced: bool = True,
                 exclude_self: bool = False, unlike: str | None = None, folds: int = 0, **kw) -> DataFrame:
    """p(1) = sum of w over neighbours labelled 1 / (sum of w + 1e-8).

    w = 1/(d + 1e-8) ('distance') or 1 ('uniform'), times the balanced class
    weight N/(K n_c) of the neighbour's label computed on the training rows
    (a per-class table: bounded, broadcast). Output (id, p, n_neighbours); a query without neighbours has a null p.

    With ``unlike`` (a fold column of both sides, 0..folds-1 or null) a query's training rows are those of the other
    folds, for the neighbours and for the class weights: all folds of a cross-validation in one search.
    """
    asked = queries.select(F.col(id_col).alias("q_id"), F.col(unlike).cast("int").alias("_qf")) if unlike else None
    nb = knn_join(queries, train, k, id_col, feat_col, exclude_self=exclude_self, payload=(label,), unlike=unlike, **kw)
    cw = class_weight_table(train, label, balanced, unlike, folds)
    if unlike:
        nb = nb.join(asked, "q_id").withColumn("_fold", F.coalesce("_qf", F.lit(-1)))
    else:
        nb = nb.withColumn("_fold", F.lit(-1))
    wd = F.lit(1.0) / (F.col("dist") + F.lit(1e-8)) if weights == "distance" else F.lit(1.0)
    scored = nb.join(cw, ["_fold", label], "left").withColumn("_w", wd * F.col("_cw"))
    agg = scored.groupBy("q_id").agg(
        F.sum(F.when(F.col(label) == 1, F.col("_w")).otherwise(0.0)).alias("_w1"),
        F.sum("_w").alias("_wall"),
        F.count("_cw").alias("n_neighbours"))
    return agg.select(F.col("q_id").alias(id_col), (F.col("_w1") / (F.col("_wall") + F.lit(1e-8))).alias("p"),
                      "n_neighbours")
