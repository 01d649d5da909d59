"""Retrieval on embedding tables: positives, recall, crops, mining, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import length
from trackloom.operators.knn import knn_join
from trackloom.session import materialize

RECALL_AT = (1, 5, 10, 20)


def radius_join(queries: DataFrame, base: DataFrame, radius: float, exclude_self: bool = False) -> DataFrame:
    """Pairs (query_id, base_id, gap) at most ``radius`` apart; inputs have id, x, y.

    Base rows sit in square cells of side radius; a query looks into its cell and
    the eight around it, so the join is an equi join.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    left = queries.select(
        F.col("id").alias("query_id"),
        F.col("x").alias("_qx"),
        F.col("y").alias("_qy"),
        F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("_cx"),
        cell("y").alias("_y"),
    ).select("*", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)).alias("_cy"))
    right = base.select(
        F.col("id").alias("base_id"),
        F.col("x").alias("_bx"),
        F.col("y").alias("_by"),
        cell("x").alias("_cx"),
        cell("y").alias("_cy"),
    )
    gap = length(F.col("_qx") - F.col("_bx"), F.col("_qy") - F.col("_by"))
    pairs = left.join(right, ["_cx", "_cy"]).withColumn("gap", gap).where(F.col("gap") <= radius)
    if exclude_self:
        pairs = pairs.where(F.col("query_id") != F.col("base_id"))
    return pairs.select("query_id", "base_id", "gap")


def first_hits(neighbours: DataFrame, is_positive: Column) -> DataFrame:
    """Rank of the first positive of every query (null without one)."""
    return neighbours.groupBy("query_id").agg(
        F.min(F.when(is_positive, F.col("rank"))).alias("first_hit"),
        F.min_by("neighbor_id", "rank").alias("top_id"),
        F.min_by("distance", "rank").alias("top_distance"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, is_positive.cast("int"))), F.lit(0)).alias("top_correct"),
    )


def recall_at(hits: DataFrame, at: Sequence[int] = RECALL_AT) -> DataFrame:
    """Percent of queries whose first positive is among the best N."""
    rows = F.explode(F.array(*[F.lit(n) for n in at])).alias("n")
    return (
        hits.select("first_hit", rows)
        .groupBy("n")
        .agg((100.0 * F.avg(F.coalesce(F.col("first_hit") <= F.col("n"), F.lit(False)).cast("double"))).alias("recall"))
    )


def merge_crops(results: DataFrame, k: int = 20) -> DataFrame:
    """Pool the results of several crops of a query: closest per base row, best k."""
    closest = results.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return closest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_vectors(crops: DataFrame) -> DataFrame:
    """Element-wise mean of the vectors of each id."""
    parts = crops.select("id", F.posexplode("vector").alias("axis", "value"))
    means = parts.groupBy("id", "axis").agg(F.avg("value").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("axis", "value")))
    return means.groupBy("id").agg(F.transform(ordered, lambda e: e["value"]).alias("vector"))


def pca_reduce(vectors: DataFrame, dims: int) -> DataFrame:
    """Project to the leading principal components of all vectors."""
    as_vectors = vectors.withColumn("_v", array_to_vector("vector"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(as_vectors)
    return model.transform(as_vectors).select("id", vector_to_array("_p").alias("vector"))


def best_positives(queries: DataFrame, base: DataFrame, radius: float = 10.0) -> DataFrame:
    """Nearest base row in feature space among those within the radius."""
    return knn_join(queries, base, 1, exclude_self=True, within=radius)


def hardest_negatives(queries: DataFrame, base: DataFrame, radius: float = 25.0, k: int = 10) -> DataFrame:
    """The k nearest base rows in feature space outside the radius."""
    return knn_join(queries, base, k, exclude_self=True, apart=radius)


def mining_turn(
    queries: DataFrame,
    base: DataFrame,
    earlier: DataFrame | None,
    turn: int,
    samples: int,
    radius: float = 25.0,
    k: int = 10,
    seed: int = 42,
) -> DataFrame:
    """The hardest negatives of every query after one more turn: ``query_id, neighbor_id, distance, rank``.

    A turn draws ``samples`` base rows by hash of seed and turn, takes the k nearest of them outside the radius, and sets them against the
    negatives kept from the turn before, whose distances are taken anew since features change between turns.  The result
    (at most k rows a query) is the ``earlier`` of the next turn; write it once.
    """
    drawn = materialize(base.orderBy(uniform_hash(seed, F.lit(turn), F.col("id")), "id").limit(samples))
    found = hardest_negatives(queries, drawn, radius, k).drop("rank")
    if earlier is not None:
        squares = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        kept = (
            earlier.select("query_id", "neighbor_id")
            .join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("_a")), "query_id")
            .join(base.select(F.col("id").alias("neighbor_id"), F.col("vector").alias("_b")), "neighbor_id")
            .select("query_id", "neighbor_id", F.sqrt(squares).alias("distance"))
        )
        # a negative found again has the same distance up to rounding
        found = found.unionByName(kept).groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def uniform_hash(seed: int, *keys: Column) -> Column:
    """A reproducible uniform number in (0, 1) from the md5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    digits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (digits + 1.0) / F.lit(float(16**12 + 1))


def weighted_sample(rows: DataFrame, n: int, weight: Column, seed: int = 42, id_col: str = "id") -> DataFrame:
    """n rows without replacement, likelier with a larger weight (exponential keys)."""
    key = -F.log(uniform_hash(seed, F.col(id_col))) / weight
    return rows.withColumn("sample_key", key).orderBy("sample_key", id_col).limit(n)
