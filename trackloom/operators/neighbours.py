"""Who is near whom inside a frame, without emitting pairs.

A frame of at most ``BLOCK_OBJECTS`` objects (checked) is one group of rows in one
task; a larger one is cut into hash blocks and each block meets every other one on
an equi key, so the work of a frame spreads over tasks and a task holds two blocks.
The k nearest are searched leaf by leaf of a space cut into leaves of equal size:
leaves that lie further away than k objects already found are skipped.  Sums of distances and
counts within a radius need every pair; they are added up tile by tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.geometry import length

BLOCK_OBJECTS = 65536
LEAF = 64
TILE = 512
SLACK = 1e-9
FRAME = ["window_id", "frame_id"]


def neighbour_stats(
    points: DataFrame,
    group: Sequence[str] = tuple(FRAME),
    id_col: str = "track_id",
    coords: Sequence[str] = ("cx", "cy"),
    k: int = 1,
    radius: float = 10.0,
    extra: Sequence[str] = (),
    block: int = BLOCK_OBJECTS,
    totals: bool = True,
) -> DataFrame:
    """Per (group, id): ``num_others``, ``nearest``, the k closest as (distance, id, extra...)
    ordered by distance, then id, and with ``totals`` ``num_near`` (distance <= radius) and
    ``sum_distance``, which take every pair.  Pass a materialised table."""
    group = list(group)
    rows = points.select(*group, id_col, *coords, *[c for c in extra if c not in coords])
    id_type = points.schema[id_col].dataType
    found = T.StructType(
        [T.StructField("distance", T.DoubleType()), T.StructField("id", id_type)]
        + [T.StructField(c, T.DoubleType()) for c in extra]
    )
    schema = T.StructType(
        [points.schema[g] for g in group]
        + [T.StructField(id_col, id_type), T.StructField("num_others", T.LongType())]
        + ([T.StructField("num_near", T.LongType()), T.StructField("sum_distance", T.DoubleType())] if totals else [])
        + [T.StructField("nearest", T.ArrayType(found))]
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left, right, group, id_col, coords, k, radius if totals else None, extra)

    sizes = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    crowded = sizes.where(F.col("_n") > block)
    if crowded.isEmpty():
        return rows.groupBy(*group).applyInArrow(lambda table: meet(table, table), schema)

    marked = rows.join(crowded, group, "left")
    single = marked.where(F.col("_n").isNull()).drop("_n")
    many = marked.where(F.col("_n").isNotNull()).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    many = many.withColumn("_left", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    key = [*group, "_left", "_right"]
    left = many.withColumn("_right", every).groupBy(*key)
    # new column identities, since both sides come from one table
    right = many.toDF(*many.columns).withColumnRenamed("_left", "_right").withColumn("_left", every).groupBy(*key)
    merged = (
        left.cogroup(right)
        .applyInArrow(meet, schema)
        .groupBy(*group, id_col)
        .agg(
            *[F.sum(f.name).alias(f.name) for f in schema.fields[len(group) + 1 : -1]],
            F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k).alias("nearest"),
        )
    )
    alone = single.groupBy(*group).applyInArrow(lambda table: meet(table, table), schema)
    return alone.unionByName(merged)


def _meet(
    left: pa.Table,
    right: pa.Table,
    group: Sequence[str],
    id_col: str,
    coords: Sequence[str],
    k: int,
    radius: float | None,
    extra: Sequence[str],
) -> pa.Table:
    """One row per object of ``left`` about its neighbours in ``right``; without a radius no totals."""
    same = left is right
    left_ids = left[id_col].combine_chunks()
    # in id order, so that the smaller position wins a tie
    right = right.take(pc.sort_indices(right[id_col].combine_chunks()))
    ids = right[id_col].combine_chunks()
    own = pc.fill_null(pc.index_in(left_ids, value_set=ids), -1).to_numpy(zero_copy_only=False)
    a = np.array([left[c].to_numpy() for c in coords], dtype=float)
    b = np.array([right[c].to_numpy() for c in coords], dtype=float)
    plain = bool(np.isnan(a).any() or np.isnan(b).any() or pc.count_distinct(ids, mode="all").as_py() < len(ids))
    if plain:
        others, near, total, rows, cols, dist = _plain(a, b, left_ids, ids, k, radius or 0.0)
    else:
        others = len(ids) - (own >= 0)
        rows, cols, dist = _nearest(a, b, own, k)
        if radius is not None:
            near, total = _own_totals(b, own, radius) if same else _totals(a, b, radius)
            near = near - ((own >= 0) & (radius >= 0))
    sizes = np.bincount(rows, minlength=len(left_ids))
    take = pa.array(cols, pa.int64())
    structs = pa.StructArray.from_arrays(
        [pa.array(dist, pa.float64()), ids.take(take), *[right[c].combine_chunks().cast(pa.float64()).take(take) for c in extra]],
        names=["distance", "id", *extra],
    )
    out = {**{g: left[g].combine_chunks() for g in group}, id_col: left_ids, "num_others": pa.array(others, pa.int64())}
    if radius is not None:
        out |= {"num_near": pa.array(near, pa.int64()), "sum_distance": pa.array(total, pa.float64())}
    out["nearest"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), structs)
    return pa.table(out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the columns of ``a`` (axis, n) from those of ``b``."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b):
        step = x[:, None] - y[None, :]
        step *= step
        out += step
    return np.sqrt(out, out=out)


def _best(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least finite entries of every row, by row, value and column."""
    keep = min(k, dist.shape[1])
    if keep == 1:
        rows, cols = np.arange(len(dist)), dist.argmin(axis=1)
        there = np.isfinite(dist[rows, cols])
        return rows[there], cols[there]
    limit = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
    rows, cols = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    order = np.lexsort((cols, dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
    return rows[best], cols[best]


def _leaves(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in leaf order, where leaves start, and their least and largest coordinates: slabs are cut axis by axis."""
    width, n = at.shape
    wide, slab = n, np.zeros(n, np.int64)
    for axis in range(width - 1):
        cuts = max(1, int((wide / LEAF) ** (1 / (width - axis))))
        narrow = -(-wide // (cuts * LEAF)) * LEAF
        order = np.lexsort((at[axis], slab))
        inside = np.arange(n) - np.searchsorted(slab[order], slab[order])
        slab[order] = slab[order] * -(-wide // narrow) + inside // narrow
        wide = narrow
    order = np.lexsort((at[-1], slab))
    starts = np.arange(0, n, LEAF)
    placed = at[:, order]
    return order, starts, np.minimum.reduceat(placed, starts, axis=1), np.maximum.reduceat(placed, starts, axis=1)


def _nearest(a: np.ndarray, b: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest columns of ``b`` for every column of ``a``, without the own one: rows, columns, distances."""
    if b.shape[1] == 0 or a.shape[1] == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    # of objects at one place the k + 1 first can be among the k nearest of any
    order = np.lexsort((np.arange(b.shape[1]), *b))
    moved = np.concatenate([[True], (np.diff(b[:, order], axis=1) != 0).any(axis=0)])
    first = np.flatnonzero(moved)
    nth = np.arange(len(order)) - first[np.cumsum(moved) - 1]
    kept = np.sort(order[nth <= k])
    where = np.full(b.shape[1] + 1, -1)
    where[kept] = np.arange(len(kept))
    b, own = b[:, kept], where[own]

    def against(some: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distances of some objects from ``cols``, which ascend; infinite from itself."""
        dist = _distances(a[:, some], b[:, cols])
        at = np.searchsorted(cols, own[some])
        hit = np.flatnonzero((own[some] >= 0) & (at < len(cols)))
        hit = hit[cols[at[hit]] == own[some][hit]]
        dist[hit, at[hit]] = np.inf
        return dist

    out = []
    leaf_order, leaf_starts, low, high = _leaves(b)
    chunk_order, chunk_starts, chunk_low, chunk_high = _leaves(a)
    few = 4 + (k + 1) // LEAF
    for c, start in enumerate(chunk_starts):
        some = chunk_order[start : start + LEAF]
        if len(leaf_starts) > few:
            gap = np.maximum(np.maximum(low - chunk_high[:, c, None], chunk_low[:, c, None] - high), 0.0)
            lower = np.sqrt((gap * gap).sum(axis=0))
            close = np.argpartition(lower, few)[:few]
            cols = np.sort(np.concatenate([leaf_order[s : s + LEAF] for s in leaf_starts[close]]))
            dist = against(some, cols)
            bound = np.partition(dist, k - 1, axis=1)[:, k - 1].max()
            reach = np.flatnonzero(lower <= bound * (1 + SLACK) + SLACK)
            if len(np.setdiff1d(reach, close, assume_unique=True)):
                cols = np.sort(np.concatenate([leaf_order[s : s + LEAF] for s in leaf_starts[reach]]))
                dist = against(some, cols)
        else:
            cols = np.arange(b.shape[1])
            dist = against(some, cols)
        rows, best = _best(dist, k)
        out.append((some[rows], kept[cols[best]], dist[rows, best]))
    rows, cols, dist = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], dist[order]


def _totals(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of columns of ``b`` within the radius and sum of all distances, for every column of ``a``."""
    near, total = np.zeros(a.shape[1], np.int64), np.zeros(a.shape[1])
    for i in range(0, a.shape[1], TILE):
        rows = slice(i, i + TILE)
        for j in range(0, b.shape[1], TILE):
            dist = _distances(a[:, rows], b[:, j : j + TILE])
            total[rows] += dist.sum(axis=1)
            near[rows] += np.count_nonzero(dist <= radius, axis=1)
    return near, total


def _own_totals(b: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """``_totals`` of a table with itself: a tile off the diagonal serves both of its sides."""
    n = b.shape[1]
    near, total = np.zeros(n, np.int64), np.zeros(n)
    for i in range(0, n, TILE):
        rows = slice(i, i + TILE)
        for j in range(i, n, TILE):
            cols = slice(j, j + TILE)
            dist = _distances(b[:, rows], b[:, cols])
            close = dist <= radius
            total[rows] += dist.sum(axis=1)
            near[rows] += np.count_nonzero(close, axis=1)
            if j > i:
                total[cols] += dist.sum(axis=0)
                near[cols] += np.count_nonzero(close, axis=0)
    return near[own], total[own]


def _plain(a: np.ndarray, b: np.ndarray, left_ids: pa.Array, ids: pa.Array, k: int, radius: float):
    """Everything from whole rows of distances, also with missing coordinates or repeated ids."""
    names, mine = (x.to_numpy(zero_copy_only=False) for x in (ids, left_ids))
    parts = []
    many = max(1, (1 << 21) // max(1, len(names)))
    for start in range(0, len(mine), many):
        dist = _distances(a[:, start : start + many], b)
        is_own = mine[start : start + many, None] == names[None, :]
        count = (~is_own).sum(axis=1)
        near, total = ((dist <= radius) & ~is_own).sum(axis=1), np.where(is_own, 0.0, dist).sum(axis=1)
        # missing distances come after all others, the own ones last
        order = np.lexsort((np.broadcast_to(np.arange(len(names)), dist.shape), dist, is_own), axis=1)[:, :k]
        valid = np.arange(order.shape[1])[None, :] < count[:, None]
        rows = np.nonzero(valid)[0]
        parts.append((count, near, total, rows + start, order[valid], dist[rows, order[valid]]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def knn_edges(
    points: DataFrame,
    k: int = 3,
    max_distance: float = float("inf"),
    max_velocity: float = float("inf"),
    group: Sequence[str] = tuple(FRAME),
) -> DataFrame:
    """Undirected edges to the k nearest of each object.

    The list is cut to k first; then edges that are too long or join objects of
    too different motion are dropped.  Needs columns vx, vy.
    """
    stats = neighbour_stats(points, group, k=k, extra=("vx", "vy"), totals=False)
    mine = points.select(*group, "track_id", F.col("vx").alias("_vx"), F.col("vy").alias("_vy"))
    pairs = stats.select(*group, "track_id", F.explode("nearest").alias("n")).join(mine, [*group, "track_id"])
    apart = length(F.col("n.vx") - F.col("_vx"), F.col("n.vy") - F.col("_vy"))
    return (
        pairs.where((F.col("n.distance") <= max_distance) & (apart <= max_velocity))
        .select(
            *group,
            F.least("track_id", "n.id").alias("left"),
            F.greatest("track_id", "n.id").alias("right"),
        )
        .distinct()
    )


def with_window_motion(points: DataFrame) -> DataFrame:
    """vx, vy: centre difference to the object's previous point in its window (0 first).

    A (window, track) group has at most window-size rows.
    """
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    return points.withColumns(
        {
            "vx": F.coalesce(F.col("cx") - F.lag("cx").over(w), F.lit(0.0)),
            "vy": F.coalesce(F.col("cy") - F.lag("cy").over(w), F.lit(0.0)),
        }
    )
