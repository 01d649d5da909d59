"""Exact nearest points of clouds: leaf by leaf inside tasks, for very large clouds by voxel hashing with growing rings.

A task holds a block of the target, cut into leaves of a space, and streams a part of the source past it; leaves that lie further away than a
point already found are skipped.  One shuffle does it, whatever the number of pairs.

The cells of a pair follow the spread of its middle half of points, so that a cell holds about ``PER_CELL`` of them.  Points of both clouds are
packed by cell; packed cells meet on equi keys, ring by ring around the cell of the source.  A point is done once its best distance is not above its distance to the
faces of the searched cube; faces beyond the outermost target cells don't count, nothing lies behind them.
Points that are still open after the last ring (far from everything, or of a very uneven cloud) meet all blocks of their pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.neighbours import BLOCK_OBJECTS, LEAF, SLACK, _leaves
from trackloom.session import materialize

PER_CELL = 8
#: Half widths of the searched cubes, in cells.
RINGS = (1, 2, 4)
#: Target points of a pair up to which all blocks meet at once.
FEW = 2048
PART = 256
#: Target points of a pair up to which they are searched leaf by leaf, and source points of a part.
MANY = 1 << 18
PART_ROWS = 1 << 14


def _grids(target: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Cell size, origin and outermost cells of every pair; approximate quartiles do, they only set the size."""
    stats = target.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(a).alias(f"_lo{a}") for a in axes],
        *[F.max(a).alias(f"_hi{a}") for a in axes],
        *[F.percentile_approx(a, [0.25, 0.75], 200).alias(f"_q{a}") for a in axes],
    )
    middle = [F.col(f"_q{a}")[1] - F.col(f"_q{a}")[0] for a in axes]
    # half of the points lie between the quartiles of an axis, an eighth of an independent cloud in the box of all three
    volume = F.lit(1.0)
    for m in middle:
        volume = volume * F.greatest(m, F.lit(1e-9))
    size = F.pow(volume * PER_CELL / (F.col("_n") / 2 ** len(list(axes))), F.lit(1.0 / len(list(axes))))
    widest = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in axes]) if len(list(axes)) > 1 else F.lit(0.0)
    # flat clouds: never more than a million cells along an axis
    return stats.withColumn("_h", F.greatest(size, widest / 1e6, F.lit(1e-12))).select(
        "pair_id", "_h", *[f"_lo{a}" for a in axes], *[F.floor((F.col(f"_hi{a}") - F.col(f"_lo{a}")) / F.col("_h")).cast("long").alias(f"_end{a}") for a in axes]
    )


def _celled(points: DataFrame, grids: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Points with the cell they lie in; a point outside goes to the nearest cell of the grid."""
    placed = points.join(grids, "pair_id")
    cells = {
        f"_c{a}": F.least(F.greatest(F.floor((F.col(a) - F.col(f"_lo{a}")) / F.col("_h")).cast("long"), F.lit(0)), F.col(f"_end{a}"))
        for a in axes
    }
    return placed.withColumns(cells)


def _packed(points: DataFrame, axes: Sequence[str], name: str, *more: str) -> DataFrame:
    """Rows of at most about PART points of one cell."""
    cell = ["pair_id", *[f"_c{a}" for a in axes]]
    sizes = points.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    marked = points.join(sizes, cell).withColumn("_part", F.pmod(F.xxhash64("pt"), F.col("_parts")).cast("int"))
    return marked.groupBy(*cell, "_part").agg(F.collect_list(F.struct("pt", *axes, *more)).alias(name)).drop("_part")


def met_cells(source: DataFrame, target: DataFrame, inner: int, outer: int, axes: Sequence[str]) -> DataFrame:
    """Packed source cells (``_s``) with the packed target cells (``_t``) of the rings ``inner`` < ring <= ``outer`` around them."""
    steps = F.sequence(F.lit(-outer), F.lit(outer))
    rows = _packed(source, axes, "_s")
    for a in axes:
        rows = rows.withColumn(f"_d{a}", F.explode(steps))
    ring = F.greatest(*[F.abs(f"_d{a}") for a in axes])
    rows = rows.where(ring > inner).withColumns({f"_c{a}": F.col(f"_c{a}") + F.col(f"_d{a}") for a in axes})
    return rows.drop(*[f"_d{a}" for a in axes]).join(target, ["pair_id", *[f"_c{a}" for a in axes]])


def best_of(met: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Nearest target point (``near``: d2, pt, coordinates) of every source point over the rows it was met in."""

    def closest(s):
        found = F.transform(
            "_t",
            lambda t: F.struct(
                sum(((s[a] - t[a]) * (s[a] - t[a]) for a in axes), F.lit(0.0)).alias("d2"), t["pt"].alias("pt"), *[t[a].alias(a) for a in axes]
            ),
        )
        return F.struct(s["pt"].alias("pt"), F.array_min(found).alias("near"))

    rows = met.select("pair_id", F.explode(F.transform("_s", closest)).alias("r")).select("pair_id", "r.*")
    return rows.groupBy("pair_id", "pt").agg(F.min("near").alias("near"))


def in_rings(source: DataFrame, target: DataFrame, axes: Sequence[str], rings: Sequence[int] = RINGS) -> tuple[DataFrame, DataFrame]:
    """Source points with their ``near``, and the source points that no ring could settle."""
    axes = list(axes)
    grids = materialize(_grids(target, axes))
    cells = materialize(_packed(_celled(target.select("pair_id", "pt", *axes), grids, axes), axes, "_t"))
    open_ = materialize(_celled(source.select("pair_id", "pt", *axes), grids, axes).withColumn("near", F.lit(None).cast(_near(target, axes))))
    done, inner = None, -1
    for outer in rings:
        found = best_of(met_cells(open_, cells, inner, outer, axes), axes).withColumnRenamed("near", "_new")
        faces = []
        for a in axes:
            low = F.col(f"_lo{a}") + (F.col(f"_c{a}") - outer) * F.col("_h")
            high = F.col(f"_lo{a}") + (F.col(f"_c{a}") + outer + 1) * F.col("_h")
            faces.append(F.when(F.col(f"_c{a}") - outer > 0, F.col(a) - low).otherwise(F.lit(float("inf"))))
            faces.append(F.when(F.col(f"_c{a}") + outer < F.col(f"_end{a}"), high - F.col(a)).otherwise(F.lit(float("inf"))))
        # a hair less, so that rounding of the faces never settles a point too early
        reach = F.greatest(F.least(*faces), F.lit(0.0)) * (1 - 1e-9)
        rows = open_.join(found, ["pair_id", "pt"], "left").withColumn("near", F.least("near", "_new")).drop("_new")
        settled = F.coalesce(F.col("near.d2") <= reach * reach, F.lit(False))
        rows = materialize(rows.withColumn("_settled", settled))
        part = rows.where("_settled").select("pair_id", "pt", *axes, "near")
        done = part if done is None else done.unionByName(part)
        open_, inner = rows.where("NOT _settled").drop("_settled"), outer
        if open_.isEmpty():
            break
    return done, open_.select("pair_id", "pt", *axes)


def _near(target: DataFrame, axes: Sequence[str]) -> str:
    fields = ", ".join(f"{a}: {target.schema[a].dataType.simpleString()}" for a in axes)
    return f"struct<d2: double, pt: {target.schema['pt'].dataType.simpleString()}, {fields}>"


def by_leaves(source: DataFrame, target: DataFrame, axes: Sequence[str], block: int = BLOCK_OBJECTS, part: int = PART_ROWS) -> DataFrame:
    """Source points with their ``near``; every part of the source of a pair passes every block of its target."""
    axes = list(axes)
    sides = [df.select("pair_id", "pt", *axes, F.lit(kind).alias("_kind")) for kind, df in enumerate((target, source))]
    rows = sides[0].unionByName(sides[1])
    parts = lambda kind, size: F.ceil(F.count(F.when(F.col("_kind") == kind, 1)) / size).cast("int")
    sizes = materialize(
        rows.groupBy("pair_id").agg(parts(0, block).alias("_blocks"), parts(1, part).alias("_parts")).where("_blocks > 0 AND _parts > 0")
    )
    whole = (sizes.agg(F.max("_blocks")).first()[0] or 0) <= 1
    own = lambda n: F.array(F.pmod(F.xxhash64("pt"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    first = F.col("_kind") == 0
    dealt = (
        rows.join(F.broadcast(sizes) if whole else sizes, "pair_id")
        .withColumn("_b", F.explode(F.when(first, own("_blocks")).otherwise(every("_blocks"))))
        .withColumn("_p", F.explode(F.when(first, every("_parts")).otherwise(own("_parts"))))
        .drop("_blocks", "_parts")
    )
    key = ["pair_id", "_p", "_b"]
    placed = dealt.repartition(*key).sortWithinPartitions(*key, "_kind")
    kind = {c: target.schema[c].dataType.simpleString() for c in ("pair_id", "pt", *axes)}
    schema = f"pair_id {kind['pair_id']}, pt {source.schema['pt'].dataType.simpleString()}, {', '.join(f'{a} {kind[a]}' for a in axes)}, near {_near(target, axes)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, leaves = None, [], None
        for batch in batches:
            places = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "_kind")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in places], axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                rows = batch.slice(int(start), int(stop - start))
                at = tuple(x[start] for x in places[:3])
                if at != held:
                    held, waiting, leaves = at, [], None
                if places[3][start] == 0:
                    waiting.append(rows)
                elif waiting:
                    leaves = leaves or _Leaves(pa.Table.from_batches(waiting), axes)
                    yield leaves.nearest(rows)

    found = placed.mapInArrow(work, schema)
    if whole:
        return found
    return found.groupBy("pair_id", "pt").agg(*[F.first(a).alias(a) for a in axes], F.min("near").alias("near"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the columns of ``a`` (axis, n) from those of ``b``."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b):
        step = x[:, None] - y[None, :]
        step *= step
        out += step
    return out


class _Leaves:
    """Target points cut into leaves; of points at one place the least ``pt`` stands for the others."""

    FEW = 4

    def __init__(self, points: pa.Table, axes: list[str]):
        self.axes = axes
        self.points = points.take(pc.sort_indices(points["pt"].combine_chunks()))
        self.all = np.array([self.points[a].to_numpy() for a in axes], dtype=float)
        kept = np.flatnonzero(np.isfinite(self.all).all(axis=0))
        order = kept[np.lexsort((kept, *self.all[:, kept]))]
        moved = np.ones(len(order), bool)
        moved[1:] = (np.diff(self.all[:, order], axis=1) != 0).any(axis=0)
        self.kept = np.sort(order[moved])
        self.at = self.all[:, self.kept]
        if len(self.kept):
            self.order, self.starts, self.low, self.high = _leaves(self.at)

    def nearest(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        a = np.array([rows.column(x).to_numpy(zero_copy_only=False) for x in self.axes], dtype=float)
        best, d2 = np.zeros(a.shape[1], np.int64), np.full(a.shape[1], np.nan)
        finite = np.isfinite(a).all(axis=0)
        if not len(self.kept):
            finite[:] = False
        some = np.flatnonzero(finite)
        if len(some):
            best[some], d2[some] = self._search(a[:, some])
        for i in np.flatnonzero(~finite):  # what is not a number comes after every number
            d = _squares(a[:, i : i + 1], self.all)[0]
            best[i] = np.lexsort((d, np.isnan(d)))[0]
            d2[i] = d[best[i]]
        missing = np.any([rows.column(x).is_null().to_numpy(zero_copy_only=False) for x in self.axes], axis=0)
        take = pa.array(best)
        names = ["d2", "pt", *self.axes]
        near = pa.StructArray.from_arrays([pa.array(d2, pa.float64(), mask=missing), *[self.points[c].combine_chunks().take(take) for c in names[1:]]], names=names)
        out = ["pair_id", "pt", *self.axes]
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in out], near], names=[*out, "near"])

    def _search(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest target point of every column of ``a`` and its squared distance."""
        best, d2 = np.empty(a.shape[1], np.int64), np.empty(a.shape[1])
        order, starts, low, high = _leaves(a)
        for c, start in enumerate(starts):
            some = order[start : start + LEAF]
            close = np.arange(len(self.starts))
            if len(self.starts) > self.FEW + 1:
                gap = np.maximum(np.maximum(self.low - high[:, c, None], low[:, c, None] - self.high), 0.0)
                lower = (gap * gap).sum(axis=0)
                few = np.argpartition(lower, self.FEW)[: self.FEW]
                bound = _squares(a[:, some], self.at[:, self._columns(few)]).min(axis=1).max()
                close = np.flatnonzero(lower <= bound * (1 + SLACK))
            cols = np.sort(self._columns(close))
            dist = _squares(a[:, some], self.at[:, cols])
            least = dist.argmin(axis=1)
            best[some], d2[some] = self.kept[cols[least]], dist[np.arange(len(some)), least]
        return best, d2

    def _columns(self, leaves: np.ndarray) -> np.ndarray:
        at = self.starts[leaves][:, None] + np.arange(LEAF)
        return self.order[at[at < len(self.order)]]
