"""Isolation forest, PCA residuals and combinations of several detectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.detectors import BEHAVIOUR_COLUMNS, lof_scores, nearest_profile_scores
from trackloom.operators.evaluate import top_k
from trackloom.operators.knn import knn_join
from trackloom.operators.ranks import average_ranks, column_profile, melt, rank01, stratified_rank, widen
from trackloom.operators.scale import percentiles
from trackloom.session import materialize

TREES = 100
TREE_ROWS = 256
EULER = 0.5772156649015329

SUBSPACES = BEHAVIOUR_COLUMNS


def _average_depth(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _drawn(train: DataFrame, trees: int, rows: int, total: int, seed: int) -> DataFrame:
    """``tree`` and the training rows it is grown on: those of the ``rows`` smallest draws.

    One md5 of seed, group of four trees and id holds the draws of four trees.  A cut that leaves about four
    times as many rows goes before the shuffle.
    """
    groups = F.sequence(F.lit(0), F.lit((trees + 3) // 4 - 1))
    hashes = F.transform(groups, lambda g: F.md5(F.concat_ws(":", F.lit(str(seed)), g.cast("string"), F.col("id").cast("string"))))
    each = lambda h, g: F.array(*[F.struct((g * 4 + k).alias("tree"), F.substring(h, 8 * k + 1, 8).alias("draw")) for k in range(4)])
    below = "g" if total <= 4 * rows else f"{int((1 << 32) * 4 * rows / total):08x}"
    mine = F.filter(F.flatten(F.transform(hashes, each)), lambda d: (d["tree"] < trees) & (d["draw"] < below))
    drawn = train.select("id", "vector", F.explode(mine).alias("_d")).select("id", "vector", "_d.tree", "_d.draw")
    order = Window.partitionBy("tree").orderBy("draw", "id")
    return drawn.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= rows)


def isolation_forest(
    train: DataFrame, queries: DataFrame, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42
) -> DataFrame:
    """Isolation forest anomaly score (0..1) of query vectors; without training rows every score is 1.

    Each tree is grown by one task on its own ``rows`` training rows.  What is drawn, the axis and the cut of a node are read
    off md5 of seed, tree and id or node, so the same forest grows on any engine: node 1 is the root, 2n and 2n + 1 are the
    children of n.  The forest (trees * 2 * rows nodes at most) is shipped to the tasks that score the queries batch by batch.
    """
    total = train.count()
    size = min(rows, total)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(pdf["vector"].to_numpy())
        tree = int(pdf["tree"].iloc[0])
        nodes: list[tuple] = []
        waiting = [(1, np.arange(len(data)), 0)]
        while waiting:
            node, index, depth = waiting.pop()
            part = data[index]
            low, high = part.min(axis=0), part.max(axis=0)
            open_axes = np.flatnonzero(high > low)
            if depth >= limit or len(open_axes) == 0:
                nodes.append((tree, node, -1, 0.0, len(index)))
                continue
            digits = hashlib.md5(f"{seed}/{tree}/{node}".encode()).hexdigest()
            axis = int(open_axes[int(digits[13:21], 16) % len(open_axes)])
            cut = float(low[axis] + int(digits[:13], 16) / 2**52 * (high[axis] - low[axis]))
            cut = cut if cut < high[axis] else float(low[axis])
            left = part[:, axis] <= cut
            nodes.append((tree, node, axis, cut, len(index)))
            waiting += [(2 * node, index[left], depth + 1), (2 * node + 1, index[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "axis", "cut", "size"])

    forest = _drawn(train, trees, rows, total, seed).groupBy("tree").applyInPandas(grow, "tree int, node long, axis int, cut double, size int").toPandas()
    shipped = []
    for _, tree in forest.sort_values(["tree", "node"]).groupby("tree"):
        node = tree["node"].to_numpy()
        axis, cut, ends = np.full(node.max() + 1, -1), np.zeros(node.max() + 1), np.zeros(node.max() + 1)
        axis[node], cut[node] = tree["axis"], tree["cut"]
        ends[node] = np.floor(np.log2(node)) + _average_depth(tree["size"].to_numpy())
        shipped.append((axis, cut, ends))
    shipped = queries.sparkSession.sparkContext.broadcast(shipped)
    scale = float(_average_depth(np.array([size]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees_ = shipped.value
        for vectors in batches:
            data = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))
            total = np.zeros(len(data))
            for axis, cut, ends in trees_:
                node = np.ones(len(data), dtype=int)
                inside = np.flatnonzero(axis[node] >= 0)
                while len(inside):
                    at = node[inside]
                    node[inside] = 2 * at + (data[inside, axis[at]] > cut[at])
                    inside = inside[axis[node[inside]] >= 0]
                total += ends[node]
            yield pd.Series(np.power(2.0, -(total / max(len(trees_), 1)) / scale))

    return queries.select("id", score("vector").alias("score"))


def isolation_scores(
    train_features: DataFrame, score_features: DataFrame, columns: Sequence[str], id_col: str = "sample_id", seed: int = 42
) -> DataFrame:
    """Forest scores by feature columns.  Cuts are uniform between the ends of a node, so scaling would change nothing; values
    are taken to six digits, a missing one is 0."""

    def vectors(df: DataFrame) -> DataFrame:
        values = [F.round(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 6) for c in columns]
        return df.select(F.col(id_col).alias("id"), F.array(*values).alias("vector"))

    train = materialize(vectors(train_features))
    return isolation_forest(train, vectors(score_features), seed=seed).withColumnRenamed("id", id_col)


def pca_residuals(
    train: DataFrame, score: DataFrame, columns: Sequence[str], ids: Sequence[str], components: int = 3
) -> DataFrame:
    """``error``: mean squared part of a standardised row outside the leading components.

    Scaling is by population deviation; the projection is orthonormal, so the error
    is what the projection leaves of the squared length.
    """
    ids = list(ids)
    profile = column_profile(train, columns)
    means = {c: profile[c]["mean"] for c in columns}
    stds = {c: profile[c]["std"] if profile[c]["std"] > 0 else 1.0 for c in columns}

    def scaled(df: DataFrame) -> DataFrame:
        values = F.array(*[(F.col(c).cast("double") - F.lit(means[c])) / F.lit(stds[c]) for c in columns])
        return df.select(*ids, array_to_vector(values).alias("_x"))

    model = PCA(k=max(1, min(components, len(columns))), inputCol="_x", outputCol="_p").fit(scaled(train))

    def squared(v):
        return F.aggregate(vector_to_array(v), F.lit(0.0), lambda a, x: a + x * x)

    left = F.greatest(squared("_x") - squared("_p"), F.lit(0.0)) / len(columns)
    return model.transform(scaled(score)).select(*ids, left.alias("error"))


def rank_ensemble(
    train_features: DataFrame,
    score_features: DataFrame,
    columns: list[str],
    weights: tuple[float, float, float] = (0.4, 0.35, 0.25),
    strata: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Weighted ranks of nearest-profile, LOF and isolation scores, optionally re-ranked inside feature strata.

    Scores are taken to nine digits, so that no rank hangs on the order of summation.
    """
    near = nearest_profile_scores(train_features, score_features, columns).withColumnRenamed("score", "nearest")
    lof = lof_scores(train_features, score_features, columns).withColumnRenamed("score", "lof")
    iso = isolation_scores(train_features, score_features, columns, seed=seed).withColumnRenamed("score", "isolation")
    names = ["nearest", "lof", "isolation"]
    joined = near.join(lof, "sample_id").join(iso, "sample_id").select("sample_id", *[F.round(n, 9).alias(n) for n in names])
    ranked = rank01(joined, ["sample_id"], names, ["sample_id"])
    total = sum(weights)
    score = sum((F.col(f"r_{n}") * (w / total) for n, w in zip(names, weights)), F.lit(0.0))
    scored = ranked.withColumn("score", score)
    if not strata:
        return scored
    table = scored.join(score_features.select("sample_id", *strata), "sample_id")
    return stratified_rank(table, ["sample_id"], "score", list(strata), ["sample_id"])


def complementary_scores(
    train_features: DataFrame, score_features: DataFrame, k: int = 1, seed: int = 42
) -> DataFrame:
    """Mean average-rank of route kNN, speed isolation, shape LOF and modal deviation, each taken to nine digits."""
    route = nearest_profile_scores(train_features, score_features, SUBSPACES["route"], k=k)
    speed = isolation_scores(train_features, score_features, SUBSPACES["speed"], seed=seed)
    shape = lof_scores(train_features, score_features, SUBSPACES["shape"], k=k)
    modal = modal_deviation(train_features, score_features)
    long = None
    for name, part in (("route", route), ("speed", speed), ("shape", shape), ("modal", modal)):
        rows = part.select("sample_id", F.lit(name).alias("component"), F.round("score", 9).alias("value"))
        long = rows if long is None else long.unionByName(rows)
    return mean_rank(materialize(long))


def modal_deviation(train_features: DataFrame, score_features: DataFrame) -> DataFrame:
    """Mean distance of the modal features from the training median in MADs (0 without spread)."""
    profile = column_profile(train_features, SUBSPACES["modal"])
    usable = [c for c in SUBSPACES["modal"] if c in profile and profile[c]["mad"] > 0]
    terms = [F.abs(F.col(c) - F.lit(profile[c]["median"])) / F.lit(profile[c]["mad"]) for c in usable]
    score = sum(terms, F.lit(0.0)) / len(terms) if terms else F.lit(0.0)
    return score_features.select("sample_id", score.alias("score"))


def mean_rank(long: DataFrame) -> DataFrame:
    """Mean over components of the average rank scaled to 0..1 (0 for a flat component)."""
    spans = long.groupBy("component").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    ranked = average_ranks(long, ["component"]).join(F.broadcast(spans), "component")
    flat = (F.col("_hi") <= F.col("_lo")) | (F.col("rank_count") <= 1)
    rank = F.when(flat, F.lit(0.0)).otherwise((F.col("avg_rank") - 1) / (F.col("rank_count") - 1))
    return ranked.groupBy("sample_id").agg(F.avg(rank).alias("score"))


# --------------------------------------------------------------------------- detector tables
def align_detectors(long: DataFrame, detectors: Sequence[str], fill: float | None = None) -> DataFrame:
    """One column per detector over the union of samples; gaps take the detector's median.

    ``long`` has sample_id, component, value.
    """
    wide = widen(long, ["sample_id"], detectors, "value")
    if fill is None:
        rows = percentiles(long, ["component"], {"_m": ("value", 0.5)}, cold_rows=None).collect()
        fills = {r["component"]: r["_m"] for r in rows}
    else:
        fills = {d: fill for d in detectors}
    return wide.select(
        "sample_id", *[F.coalesce(F.col(d), F.lit(float(fills.get(d, 0.0)))).alias(d) for d in detectors]
    )


def inverse_ranks(table: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """``i_{detector}``: 1 / average rank from the top, per detector."""
    long = melt(table, ["sample_id"], detectors)
    ranked = average_ranks(long, ["component"]).withColumn(
        "_i", 1.0 / (F.col("rank_count") + 1 - F.col("avg_rank"))
    )
    return widen(ranked, ["sample_id"], detectors, "_i", "i_")


def mean_max_ensemble(table: DataFrame, detectors: Sequence[str]) -> DataFrame:
    inverse = inverse_ranks(table, detectors)
    columns = [F.col(f"i_{d}") for d in detectors]
    largest = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return inverse.select(
        "sample_id", (sum(columns, F.lit(0.0)) / len(columns)).alias("mean_score"), largest.alias("max_score")
    )


def analysis_frame(aligned: DataFrame, mean_max: DataFrame, tracks: DataFrame) -> DataFrame:
    """Aligned detector scores with the ensembles of each sample and what is known of its track; samples keep their rows.

    ``tracks`` has at most one row per sample (its key columns and counts); what is missing stays null.
    """
    return aligned.join(mean_max, "sample_id", "left").join(tracks, "sample_id", "left")


def top_jaccard(scores: DataFrame, pairs: Sequence[tuple[str, str]], k: int = 500) -> DataFrame:
    """Jaccard of the k best samples of two methods, for each pair of method names.

    ``scores`` has method, sample_id, score.
    """
    best = top_k(scores, k).select("method", "sample_id")
    wanted = scores.sparkSession.createDataFrame(list(pairs), "a string, b string")
    left = best.join(F.broadcast(wanted), best.method == F.col("a")).select("a", "b", "sample_id")
    right = best.join(F.broadcast(wanted), best.method == F.col("b")).select("a", "b", "sample_id", F.lit(1).alias("_r"))
    both = left.withColumn("_l", F.lit(1)).join(right, ["a", "b", "sample_id"], "full_outer")
    return both.groupBy("a", "b").agg(
        (F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)) / F.count(F.lit(1))).alias("jaccard")
    )


def complementary_elimination(
    table: DataFrame, detectors: Sequence[str], k: int = 500, rule: str = "min"
) -> DataFrame:
    """Drop one detector after the other by how the max ensemble's top k changes.

    Each step is one Spark aggregate over all candidate removals (at most one step
    per detector); ``rule`` picks the removal with the smallest or largest Jaccard.
    """
    if rule not in ("min", "max"):
        raise ValueError("rule must be 'min' or 'max'")
    inverse = materialize(inverse_ranks(table, detectors))
    current, steps = list(detectors), []
    while len(current) > 1:

        def largest(names: Sequence[str]):
            columns = [F.col(f"i_{d}") for d in names]
            return F.greatest(*columns) if len(columns) > 1 else columns[0]

        variants = [("", largest(current))] + [(d, largest([c for c in current if c != d])) for d in current]
        scores = inverse.select(
            "sample_id",
            F.explode(
                F.array(*[F.struct(F.lit(f"-{n}").alias("method"), c.alias("score")) for n, c in variants])
            ).alias("v"),
        ).select("sample_id", "v.method", "v.score")
        found = {r["b"][1:]: r["jaccard"] for r in top_jaccard(scores, [("-", f"-{d}") for d in current], k).collect()}
        choose = min if rule == "min" else max
        removed = choose(current, key=lambda d: found[d])
        steps.append((len(steps), removed, len(current) - 1, float(found[removed])))
        current.remove(removed)
    return table.sparkSession.createDataFrame(
        steps, "iteration int, removed string, num_remaining int, jaccard double"
    )


def neighbourhood_loss(embedded: DataFrame, k: int = 6) -> DataFrame:
    """Loss deviation from the k embedding neighbours over the neighbours' own deviation.

    ``embedded`` has id, vector, loss.  A flat neighbourhood keeps the raw deviation.
    """
    table = materialize(embedded)
    vectors = table.select("id", "vector")
    near = materialize(knn_join(vectors, vectors, k, exclude_self=True).select("query_id", "neighbor_id"))
    own = table.select(F.col("id").alias("query_id"), F.col("loss").alias("_l"))
    other = table.select(F.col("id").alias("neighbor_id"), F.col("loss").alias("_o"))
    deviation = materialize(
        near.join(own, "query_id")
        .join(other, "neighbor_id")
        .groupBy("query_id")
        .agg(F.avg(F.abs(F.col("_l") - F.col("_o"))).alias("deviation"))
    )
    around = (
        near.join(deviation.select(F.col("query_id").alias("neighbor_id"), F.col("deviation").alias("_d")), "neighbor_id")
        .groupBy("query_id")
        .agg(F.avg("_d").alias("_mean"))
    )
    ratio = F.when(F.abs("_mean") < 1e-8, F.col("deviation")).otherwise(F.col("deviation") / F.col("_mean"))
    return deviation.join(around, "query_id").select(F.col("query_id").alias("id"), ratio.alias("score"))
