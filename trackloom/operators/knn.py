"""Exact k-nearest-neighbour join of two vector tables.

The base table is split into Voronoi cells of a bounded number of pivots.  A query
searches its own cell first; the k-th distance found there bounds, by the triangle
inequality, the other cells that can still hold a neighbour, and only to those it
goes in a second turn.  None is skipped wrongly.  Cells are cut into blocks of
bounded size and queries into chunks; a (chunk, block) row is the unit of work for
a NumPy kernel that keeps only the k best.

Vectors of many components lie too evenly for cells to be skipped.  There a task holds a
group of queries and streams a shard of the base past them; products of matrices find the
rows that can be among the k best, and only those get their distance in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.scale import row_positions
from trackloom.session import materialize

BLOCK_ROWS = 2048
CHUNK_ROWS = 256
MAX_PIVOTS = 256
SLACK = 1e-9
WIDE = 32
#: Components up to which cells are searched, also of tables of more than a block.
NARROW = 6
GROUP_ROWS = 32768
STREAM_TASKS = 56
TILE = (512, 2048)


def vectorize(df: DataFrame, id_col: str, columns: Sequence[str], profile: dict | None = None) -> DataFrame:
    """(id, vector) rows; with a column profile, standardised by population deviation.

    A column without spread keeps scale 1.
    """

    def scaled(c: str):
        value = F.col(c).cast("double")
        if profile is None:
            return value
        std = profile[c]["std"]
        return (value - F.lit(float(profile[c]["mean"]))) / F.lit(float(std) if std > 0 else 1.0)

    return df.select(F.col(id_col).alias("id"), F.array(*[scaled(c) for c in columns]).alias("vector"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        step = a[:, axis, None] - b[None, :, axis]
        total += step * step
    return np.sqrt(total)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    exclude_self: bool = False,
    block: int = BLOCK_ROWS,
    chunk: int = CHUNK_ROWS,
    pivots: int | None = None,
    apart: float | None = None,
    within: float | None = None,
) -> DataFrame:
    """``query_id, neighbor_id, distance, rank`` (1..k by distance, then id).

    Both inputs have columns ``id`` and ``vector`` and should be materialised.  With
    ``apart`` (or ``within``) they also have ``place``, and only neighbours more
    than (at most) that far from the query's place count.  The bound of a query
    rests on neighbours that count, so cells are skipped all the same.
    """
    placed = apart is not None or within is not None
    id_type = base.schema["id"].dataType
    count = base.count()
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if pivots is None and count and queries.schema["id"].dataType == id_type:
        width = base.select(F.size("vector").alias("n")).first()["n"] or 0
        if width >= WIDE:
            return ranked(_streamed(queries, base, count, k, exclude_self, apart, within))
        if width > NARROW and count > block and not placed:
            numbered, few = _numbered(base, k)
            found = ranked(_streamed(queries, few, few.count(), k, exclude_self, None, None)).withColumnRenamed("neighbor_id", "_n")
            return found.join(numbered, "_n").select("query_id", "neighbor_id", "distance", "rank")
    n_pivots = pivots if pivots is not None else int(min(MAX_PIVOTS, max(1, count // (4 * block))))

    def search(routed: DataFrame, cells: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """The k best of every (query, block) of the cells that each row of ``routed`` names."""
        blocks = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // block))])
        per_cell = {r["_cell"]: r["n"] for r in routed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not per_cell:
            per_cell = {0: 1}
        chunks = F.create_map(*[F.lit(x) for c, n in per_cell.items() for x in (c, -(-n // chunk))])

        body = F.struct("id", "vector", *(["place"] if placed else []))
        right = (
            cells.withColumn("_block", F.pmod(F.xxhash64("id"), blocks[F.col("_cell")]).cast("int"))
            .groupBy("_cell", "_block")
            .agg(F.collect_list(body).alias("b"))
        )
        left = (
            routed.withColumn("_chunk", F.pmod(F.xxhash64("id"), chunks[F.col("_cell")]).cast("int"))
            .groupBy("_cell", "_chunk")
            .agg(F.collect_list(body).alias("q"))
            .withColumn("_block", F.explode(F.sequence(F.lit(0), (blocks[F.col("_cell")] - 1).cast("int"))))
        )
        pairs = left.join(right, ["_cell", "_block"]).select("q", "b")
        schema = T.StructType(
            [
                T.StructField("query_id", queries.schema["id"].dataType),
                T.StructField("neighbor_id", id_type),
                T.StructField("distance", T.DoubleType()),
            ]
        )

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    q = batch.column(0)[row].values
                    b = batch.column(1)[row].values
                    q_ids, b_ids = q.field(0), b.field(0)
                    names = b_ids.to_pylist()
                    dist = _distances(_matrix(q.field(1)), _matrix(b.field(1)))
                    if exclude_self:
                        where = {name: i for i, name in enumerate(names)}
                        same = np.array([where.get(x, -1) for x in q_ids.to_pylist()])
                        dist[np.flatnonzero(same >= 0), same[same >= 0]] = np.inf
                    if placed:
                        gap = _distances(_matrix(q.field(2)), _matrix(b.field(2)))
                        if apart is not None:
                            dist[gap <= apart] = np.inf
                        if within is not None:
                            dist[gap > within] = np.inf
                    keep = min(k, dist.shape[1])
                    limit = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
                    rows, cols = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
                    place = np.empty(len(names), np.int64)
                    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                    order = np.lexsort((place[cols], dist[rows, cols], rows))
                    rows, cols = rows[order], cols[order]
                    first = np.searchsorted(rows, rows)
                    best = np.arange(len(rows)) - first < keep
                    rows, cols = rows[best], cols[best]
                    values = dist[rows, cols]
                    yield pa.RecordBatch.from_arrays(
                        [q_ids.take(pa.array(rows, pa.int64())), b_ids.take(pa.array(cols, pa.int64())), pa.array(values, pa.float64())],
                        names=["query_id", "neighbor_id", "distance"],
                    )

        return pairs.mapInArrow(kernel, schema)

    if n_pivots <= 1 or count == 0:
        cells = base.withColumn("_cell", F.lit(0))
        sizes = {0: max(count, 1)}
        return ranked(search(queries.withColumn("_cell", F.lit(0)), cells, sizes))
    cells, sizes, own, others = _route(queries, base, n_pivots)
    first = materialize(ranked(search(own, cells, sizes)).drop("rank"))
    # fewer than k neighbours in the own cell bound nothing
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_reach"))
    again = materialize(others(own.join(reach, own["id"] == reach["query_id"], "left").drop("query_id")))
    return ranked(first.unionByName(search(again, cells, sizes)))


def _numbered(base: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Ids by their place in order (``_n``), and the rows that can be neighbours: of equal vectors the k + 1 first."""
    placed = materialize(row_positions(base.select("id", "vector"), [], [("id", True)], "_n").drop("_n_count"))
    alike = Window.partitionBy("vector").orderBy("_n")
    few = placed.withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= k + 1).drop("_rn")
    return placed.select("_n", F.col("id").alias("neighbor_id")), materialize(few)


def _streamed(
    queries: DataFrame, base: DataFrame, count: int, k: int, exclude_self: bool, apart: float | None, within: float | None
) -> DataFrame:
    """The k best of every (query, shard of the base).

    A task gets the rows of its queries first, at most about ``GROUP_ROWS``, then those of its shard one batch at a time.
    Rows of the base are named by ``_n`` if they have it.
    """
    named = "_n" in base.columns
    queries = queries.withColumn("_n", F.lit(None).cast("long")) if named else queries
    asked = queries.count()
    groups = max(-(-asked // GROUP_ROWS), min(8, -(-asked // BLOCK_ROWS)), 1)
    shards = max(1, min(-(-STREAM_TASKS // groups), -(-count // BLOCK_ROWS)))
    carried = ["id", "vector", *(["place"] if apart is not None or within is not None else []), *(["_n"] if named else [])]
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = queries.select(*carried, own(groups).alias("_g"), every(shards).alias("_s"), F.lit(0).alias("_kind")).unionByName(
        base.select(*carried, every(groups).alias("_g"), own(shards).alias("_s"), F.lit(1).alias("_kind"))
    )
    rows = rows.select(*carried, (F.col("_g") * shards + F.col("_s")).alias("_task"), "_kind")
    rows = rows.repartition(groups * shards, "_task").sortWithinPartitions("_task", "_kind")
    id_type = base.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("neighbor_id", T.LongType() if named else id_type), T.StructField("distance", T.DoubleType())]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, task = None, None
        for batch in batches:
            tasks, kinds = (batch.column(c).to_numpy() for c in ("_task", "_kind"))
            cuts = np.flatnonzero(np.diff(tasks) | np.diff(kinds)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                if tasks[start] != task:
                    if state is not None:
                        yield state.found()
                    state, task = _Best(k, exclude_self, apart, within), tasks[start]
                part = batch.slice(int(start), int(stop - start))
                state.meet(part) if kinds[start] else state.ask(part)
        if state is not None:
            yield state.found()

    return rows.mapInArrow(kernel, schema)


class _Best:
    """The k best rows so far of some queries, by distance, then id."""

    def __init__(self, k: int, exclude_self: bool, apart: float | None, within: float | None):
        self.k, self.exclude_self, self.apart, self.within = k, exclude_self, apart, within
        self.parts: list[pa.RecordBatch] = []
        self.ids = None

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def meet(self, part: pa.RecordBatch) -> None:
        if not self.parts:
            return
        b_ids, b = part.column("id"), _matrix(part.column("vector"))
        b_names = part.column("_n") if "_n" in part.schema.names else b_ids
        if self.ids is None:
            self._begin(b_names)
        names = b_names.to_numpy(zero_copy_only=False)
        norms = (b * b).sum(axis=1)
        # what rounding can add to a square taken from a product of matrices
        longest = sum(np.sqrt(n.max(where=np.isfinite(n), initial=0.0)) for n in (self.norms, norms))
        error = (b.shape[1] + 8) * np.finfo(float).eps * 2 * longest**2
        same = pc.fill_null(pc.index_in(b_ids, value_set=self.ids), -1).to_numpy(zero_copy_only=False) if self.exclude_self else None
        place = _matrix(part.column("place")) if self.place is not None else None
        for i in range(0, len(self.vectors), TILE[0]):
            q = self.vectors[i : i + TILE[0]]
            for j in range(0, len(b), TILE[1]):
                cols = slice(j, min(j + TILE[1], len(b)))
                square = q @ (-2.0 * b[cols]).T
                square += self.norms[i : i + TILE[0], None]
                square += norms[None, cols]
                if same is not None:
                    hit = np.flatnonzero((same[cols] >= i) & (same[cols] < i + len(q)))
                    square[same[cols][hit] - i, hit] = np.inf
                if place is not None:
                    gap = _distances(self.place[i : i + TILE[0]], place[cols])
                    if self.apart is not None:
                        square[gap <= self.apart] = np.inf
                    if self.within is not None:
                        square[gap > self.within] = np.inf
                limit = self.limit[i : i + len(q)]
                if square.shape[1] >= self.k and np.isinf(limit).any():
                    limit = np.minimum(limit, np.partition(square, self.k - 1, axis=1)[:, self.k - 1])
                rows, at = np.nonzero((square <= limit[:, None] + 2 * error) & (square < np.inf))
                if len(rows):
                    self._merge(rows + i, names[cols][at], self.vectors[rows + i], b[cols][at])

    def _begin(self, b_names: pa.Array) -> None:
        table = pa.Table.from_batches(self.parts)
        self.ids = table["id"].combine_chunks()
        self.vectors = _matrix(table["vector"].combine_chunks())
        self.place = _matrix(table["place"].combine_chunks()) if "place" in table.column_names else None
        self.norms = (self.vectors * self.vectors).sum(axis=1)
        shape = (len(self.ids), self.k)
        self.distance = np.full(shape, np.inf)
        self.names = np.full(shape, b_names[0].as_py(), dtype=b_names.to_numpy(zero_copy_only=False).dtype)
        self.kind = b_names.type
        self.limit = np.full(len(self.ids), np.inf)

    def _merge(self, rows: np.ndarray, names: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        total = np.zeros(len(rows))
        for axis in range(a.shape[1]):
            step = a[:, axis] - b[:, axis]
            total += step * step
        touched, local = np.unique(rows, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), local])
        distance = np.concatenate([self.distance[touched].ravel(), np.sqrt(total)])
        name = np.concatenate([self.names[touched].ravel(), names])
        order = np.lexsort((name, distance, row))
        first = np.searchsorted(row[order], np.arange(len(touched)))
        kept = order[first[:, None] + np.arange(self.k)]
        self.distance[touched], self.names[touched] = distance[kept], name[kept]
        self.limit[touched] = self.distance[touched, -1] ** 2

    def found(self) -> pa.RecordBatch:
        if self.ids is None:
            kind = self.parts[0].column("id").type if self.parts else pa.int64()
            names = pa.int64() if self.parts and "_n" in self.parts[0].schema.names else kind
            return pa.RecordBatch.from_arrays([pa.array([], kind), pa.array([], names), pa.array([], pa.float64())], names=["query_id", "neighbor_id", "distance"])
        rows, at = np.nonzero(np.isfinite(self.distance))
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(rows)), pa.array(self.names[rows, at], self.kind), pa.array(self.distance[rows, at])],
            names=["query_id", "neighbor_id", "distance"],
        )


def _route(queries: DataFrame, base: DataFrame, n_pivots: int):
    """Cell of each base row, cell sizes, the own cell of each query, and what sends queries with a reach to other cells.

    The driver sees the pivots and, per cell, its size and radius.
    """
    picked = base.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("vector").collect()
    centers = np.unique(np.array([r["vector"] for r in picked], dtype=float), axis=0)

    @F.pandas_udf("cell int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        dist = _distances(np.stack(vectors.to_numpy()), centers)
        cell = dist.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "distance": dist[np.arange(len(cell)), cell]})

    carried = [c for c in ("id", "vector", "place") if c in base.columns]
    placed = base.withColumn("_p", nearest("vector")).select(
        *carried, F.col("_p.cell").alias("_cell"), F.col("_p.distance").alias("_d")
    )
    placed = materialize(placed)
    stats = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("radius")).collect()
    live = np.array(sorted(r["_cell"] for r in stats))
    radius = np.array([{r["_cell"]: r["radius"] for r in stats}[c] for c in live])

    @F.pandas_udf("int")
    def own_cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(live[_distances(np.stack(vectors.to_numpy()), centers[live]).argmin(axis=1)].astype("int32"))

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series, own: pd.Series, reach: pd.Series) -> pd.Series:
        lower = _distances(np.stack(vectors.to_numpy()), centers[live]) - radius[None, :]
        bound = reach.fillna(np.inf).to_numpy(dtype=float)
        hit = (lower <= (bound * (1 + SLACK) + SLACK)[:, None]) & (live[None, :] != own.to_numpy()[:, None])
        return pd.Series([live[h].astype("int32") for h in hit])

    own = materialize(queries.select(*carried, own_cell("vector").alias("_cell")))

    def others(asking: DataFrame) -> DataFrame:
        return asking.select(*carried, F.explode(reachable("vector", "_cell", "_reach")).alias("_cell"))

    return placed.drop("_d"), {int(r["_cell"]): int(r["n"]) for r in stats}, own, others


def mean_neighbour_distance(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("query_id").agg(F.avg("distance").alias("score"))


def local_outlier_factors(train: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Local outlier factor of query vectors against a training set (novelty form).

    k is at most training size - 1.  Two kNN joins; reachability distances and
    densities are joins and averages.
    """
    k = max(1, min(k, train.count() - 1))
    inner = materialize(knn_join(train, train, k, exclude_self=True))
    reach_of = inner.groupBy("query_id").agg(F.max("distance").alias("kdist")).withColumnRenamed("query_id", "neighbor_id")

    def density(neighbours: DataFrame) -> DataFrame:
        reached = neighbours.join(reach_of, "neighbor_id").withColumn("reach", F.greatest("distance", "kdist"))
        return reached.groupBy("query_id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))

    train_density = materialize(density(inner))
    outer = materialize(knn_join(queries, train, k))
    own = density(outer)
    around = outer.join(
        train_density.select(F.col("query_id").alias("neighbor_id"), F.col("lrd").alias("_nlrd")), "neighbor_id"
    )
    return (
        around.join(own, "query_id")
        .groupBy("query_id")
        .agg(F.avg(F.col("_nlrd") / F.col("lrd")).alias("score"))
    )
