"""Alignment of scores with labels and ranking metrics, all methods at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.scale import running_totals

METRICS = ["auroc", "auprc", "f1", "threshold", "precision_at_k", "recall_at_k", "num_positive", "num_total"]


def label_violations(labels: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Rule breaks of a label table: missing key, label not 0/1, reversed frames, duplicate key."""
    checks = [
        *[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in keys],
        F.when(F.col("label").isNull() | ~F.col("label").isin(0, 1), F.lit("label not 0 or 1")),
    ]
    if {"frame_start", "frame_end"} <= set(labels.columns):
        checks.append(F.when(F.col("frame_end") < F.col("frame_start"), F.lit("frames reversed")))
    found = labels.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    return found.unionByName(_duplicates(labels, keys))


def score_violations(scores: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == F.lit(float("inf")))
    checks = [
        *[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in keys],
        F.when(bad, F.lit("score not finite")),
    ]
    found = scores.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    return found.unionByName(_duplicates(scores, keys))


def _duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*keys, F.lit("duplicate key").alias("problem"))
    )


def alignment_report(scores: DataFrame, labels: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Row, key, duplicate, missing and extra counts of one score and one label table."""
    keys = list(keys)
    a = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    b = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    both = a.join(b, keys, "full_outer")
    left, right = F.col("_l"), F.col("_s")

    def n(condition):
        return F.count(F.when(condition, F.lit(1)))

    return both.agg(
        F.coalesce(F.sum(left), F.lit(0)).alias("num_label_rows"),
        F.coalesce(F.sum(right), F.lit(0)).alias("num_score_rows"),
        n(left.isNotNull()).alias("num_unique_label_keys"),
        n(right.isNotNull()).alias("num_unique_score_keys"),
        n(left > 1).alias("num_duplicate_label_keys"),
        n(right > 1).alias("num_duplicate_score_keys"),
        n(left.isNotNull() & right.isNull()).alias("num_missing_score_keys"),
        n(left.isNull() & right.isNotNull()).alias("num_extra_score_keys"),
    )


def require_strict_keys(report: DataFrame) -> DataFrame:
    """Report rows that fail the merge gate: any duplicate, missing or extra key."""
    columns = [
        "num_duplicate_label_keys",
        "num_duplicate_score_keys",
        "num_missing_score_keys",
        "num_extra_score_keys",
    ]
    return report.where(sum((F.col(c) for c in columns), F.lit(0)) > 0)


def align(scores: DataFrame, labels: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One row per (method, label key): largest label and score.

    A key without a score, or with NaN only, scores minus infinity; infinite scores keep their
    place.  ``methods`` is the short list of methods in ``scores``.
    """
    keys = list(keys)
    truth = (
        labels.groupBy(*keys)
        .agg(F.max(F.col("label").cast("int")).alias("label"))
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    )
    best = scores.groupBy("method", *keys).agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    return truth.join(best, ["method", *keys], "left").select(
        "method",
        *keys,
        F.when(F.col("label") > 0, F.lit(1)).otherwise(F.lit(0)).alias("label"),
        F.coalesce("score", F.lit(float("-inf"))).alias("score"),
    )


def threshold_curve(aligned: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Per distinct score, descending: rows, positives and their running totals.

    Equal scores collapse before any ordering, so ties never pile up in a task.
    """
    by = list(by)
    points = aligned.groupBy(*by, "score").agg(
        F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("rows")
    )
    totals = points.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("rows").alias("n"))
    return running_totals(points, by, "score", {"tp": "pos", "predicted": "rows"}).join(
        F.broadcast(totals), by
    )


def curve_metrics(aligned: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """AUROC, average precision and best F1 per method.

    AUROC is the rank sum with ties counted half and null for one class only;
    average precision steps over distinct thresholds; the best F1 takes the highest
    threshold among equals.
    """
    by = list(by)
    curve = threshold_curve(aligned, by)
    neg = F.col("rows") - F.col("pos")
    N = F.col("n") - F.col("P")
    below = N - (F.col("predicted") - F.col("tp"))
    wins = F.col("pos") * (below + neg / 2)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("predicted") + F.col("P"))).otherwise(F.lit(0.0))
    top = F.struct(F.round(F.col("_f1"), 12), F.col("score"))
    table = curve.withColumn("_f1", f1).withColumn("_wins", wins).groupBy(*by).agg(
        F.sum("_wins").alias("_w"),
        F.sum(F.col("pos") * F.col("tp") / F.col("predicted")).alias("_ap"),
        F.max_by("_f1", top).alias("f1"),
        F.max_by("score", top).alias("threshold"),
        F.max("P").alias("num_positive"),
        F.max("n").alias("num_total"),
    )
    p = F.col("num_positive")
    both = (p > 0) & (p < F.col("num_total"))
    return table.select(
        *by,
        F.when(both, F.col("_w") / (p * (F.col("num_total") - p))).alias("auroc"),
        F.when(p > 0, F.col("_ap") / p).otherwise(F.lit(0.0)).alias("auprc"),
        "f1",
        "threshold",
        "num_positive",
        "num_total",
    )


def top_k(aligned: DataFrame, k: int, keys: Sequence[str] = ("sample_id",), by: Sequence[str] = ("method",)) -> DataFrame:
    """The k best rows per method; ties go to the smaller key.

    The row_number <= k filter prunes to k rows per task before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), *[F.col(c).asc() for c in keys])
    return aligned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def precision_at_k(aligned: DataFrame, k: int, keys: Sequence[str] = ("sample_id",), by: Sequence[str] = ("method",)) -> DataFrame:
    by = list(by)
    if k < 0:
        raise ValueError("k must be non-negative")
    hits = top_k(aligned, k, keys, by).groupBy(*by).agg(F.sum("label").alias("hits_at_k"))
    totals = aligned.groupBy(*by).agg(
        F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    h = F.coalesce("hits_at_k", F.lit(0)).cast("long")
    cut = F.least(F.lit(k), F.col("_n")).cast("long")
    return totals.join(hits, by, "left").select(
        *by,
        cut.alias("k"),
        h.alias("hits_at_k"),
        F.when(cut > 0, h / cut).otherwise(F.lit(0.0)).alias("precision_at_k"),
        F.when(F.col("_p") > 0, h / F.col("_p")).otherwise(F.lit(0.0)).alias("recall_at_k"),
    )


def evaluate(
    scores: DataFrame, labels: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("sample_id",), k: int = 100
) -> DataFrame:
    """The metrics row of every method, with its key audit."""
    aligned = align(scores, labels, methods, keys)
    return curve_metrics(aligned).join(precision_at_k(aligned, k, keys), "method").join(
        audit(scores, labels, methods, keys), "method"
    )


def audit(scores: DataFrame, labels: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Alignment counts per method in one pass."""
    keys = list(keys)
    truth = (
        labels.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_l"))
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    )
    scored = scores.groupBy("method", *keys).agg(F.count(F.lit(1)).alias("_s"))

    def n(condition):
        return F.count(F.when(condition, F.lit(1)))

    left, right = F.col("_l"), F.col("_s")
    return truth.join(scored, ["method", *keys], "full_outer").groupBy("method").agg(
        n(left > 1).alias("num_duplicate_label_keys"),
        n(right > 1).alias("num_duplicate_score_keys"),
        n(left.isNotNull() & right.isNull()).alias("num_missing_score_keys"),
        n(left.isNull() & right.isNotNull()).alias("num_extra_score_keys"),
    )
