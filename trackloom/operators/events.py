"""Matching of predicted and true event intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import frame_iou
from trackloom.session import materialize

BUCKET_FRAMES = 64
IDENTITY = ["sequence", "track_id"]


def overlap_candidates(predicted: DataFrame, truth: DataFrame, min_iou: float = 0.1) -> DataFrame:
    """(pred_id, true_id, iou) of events of one track that overlap enough.

    Intervals meet on shared frame buckets; a pair is kept in the first bucket both
    have, so it appears once and a long track spreads over many keys.
    """
    first = lambda c: F.floor(F.col(c) / BUCKET_FRAMES)

    def bucketed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *IDENTITY,
            F.col("event_id").alias(f"{tag}_id"),
            F.col("frame_start").alias(f"_{tag}s"),
            F.col("frame_end").alias(f"_{tag}e"),
            F.explode(F.sequence(first("frame_start"), first("frame_end"))).alias("_bucket"),
        )

    pairs = bucketed(predicted, "pred").join(bucketed(truth, "true"), [*IDENTITY, "_bucket"])
    once = F.col("_bucket") == F.greatest(first("_preds"), first("_trues"))
    iou = frame_iou(F.col("_preds"), F.col("_prede"), F.col("_trues"), F.col("_truee"))
    return pairs.where(once).select("pred_id", "true_id", iou.alias("iou")).where(F.col("iou") >= min_iou)


def greedy_matches(candidates: DataFrame) -> DataFrame:
    """One-to-one matches, best IoU first (ties: larger pred id, then true id).

    A pair that is the best of both its events is what the greedy order would take
    anyway, so all such pairs match at once and their events leave the table; the
    loop ends when none is left.
    """
    left = materialize(candidates)
    matched = None
    while not left.isEmpty():
        order = F.struct("iou", "pred_id", "true_id")
        best_p = left.groupBy("pred_id").agg(F.max(order).alias("_b")).select("_b.*")
        best_t = left.groupBy("true_id").agg(F.max(order).alias("_b")).select("_b.*")
        agreed = materialize(best_p.join(best_t.select("pred_id", "true_id"), ["pred_id", "true_id"]))
        matched = agreed if matched is None else matched.unionByName(agreed)
        left = materialize(
            left.join(agreed.select("pred_id"), "pred_id", "left_anti").join(
                agreed.select("true_id"), "true_id", "left_anti"
            )
        )
    return matched if matched is not None else candidates.select("pred_id", "true_id", "iou")


def event_f1(predicted: DataFrame, truth: DataFrame, min_iou: float = 0.1) -> DataFrame:
    """Precision, recall and F1 of predicted events after one-to-one matching."""
    matches = greedy_matches(overlap_candidates(predicted, truth, min_iou))
    one = F.lit(1).alias("_one")
    counts = (
        predicted.agg(F.count(F.lit(1)).alias("num_predicted"), one)
        .join(truth.agg(F.count(F.lit(1)).alias("num_true"), one), "_one")
        .join(matches.agg(F.count(F.lit(1)).alias("num_matched"), one), "_one")
    )
    m, p, t = F.col("num_matched"), F.col("num_predicted"), F.col("num_true")
    zero = F.lit(0.0)
    return counts.select(
        "num_predicted",
        "num_true",
        "num_matched",
        F.when(p > 0, m / p).otherwise(zero).alias("event_precision"),
        F.when(t > 0, m / t).otherwise(zero).alias("event_recall"),
        F.when(p + t > 0, 2.0 * m / (p + t)).otherwise(zero).alias("event_f1"),
    )
