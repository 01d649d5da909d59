"""Motion tokens of tracks and an additively smoothed n-gram model over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.motion import TRACK, track_steps
from trackloom.operators.scale import CHUNK_FRAMES, with_previous
from trackloom.session import materialize

# Fixed values of the token alphabet.
DIRECTIONS = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]
SPEED_BINS = (0.5, 1.5, 3.0)
TURN_BINS = (0.5, 1.5)
BOS, EOS, UNK = "<BOS>", "<EOS>", "<UNK>"
SLOTS = 4


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    return sum(((value > e).cast("int") for e in edges), F.lit(0)).cast("string")


def motion_tokens(points: DataFrame, grid_size: int = 16) -> DataFrame:
    """``turn``, ``dir`` and ``spd`` tokens of every step, in order of ``position``.

    A step is a stay when it is no longer than 1 / grid_size.  The first step has no
    turn; a turn next to a step without length counts as angle 0.
    """
    steps = track_steps(points).where(F.col("step").isNotNull())
    octant = F.pmod(F.rint(F.atan2("dy", "dx") / (math.pi / 4)).cast("int"), F.lit(8))
    names = F.array(*[F.lit(d) for d in DIRECTIONS])
    direction = F.when(F.col("step") <= 1.0 / max(int(grid_size), 1), F.lit("STAY")).otherwise(F.get(names, octant))
    has_turn = F.col("acceleration").isNotNull()
    tokens = F.array(
        F.struct(
            F.lit(0).alias("slot"),
            F.when(has_turn, F.concat(F.lit("turn:"), _bin(F.coalesce("turn", F.lit(0.0)), TURN_BINS))).alias("token"),
        ),
        F.struct(F.lit(1).alias("slot"), F.concat(F.lit("dir:"), direction).alias("token")),
        F.struct(F.lit(2).alias("slot"), F.concat(F.lit("spd:"), _bin(F.col("speed"), SPEED_BINS)).alias("token")),
    )
    return (
        steps.select(*TRACK, "frame_id", F.explode(tokens).alias("t"))
        .where(F.col("t.token").isNotNull())
        .select(*TRACK, (F.col("frame_id") * SLOTS + F.col("t.slot")).alias("position"), "t.token")
    )


def ngram_events(points: DataFrame, order: int = 2, grid_size: int = 16) -> DataFrame:
    """(track, context, token) of every n-gram, padded by BOS and closed by EOS."""
    tokens = motion_tokens(points, grid_size)
    closing = points.groupBy(*TRACK).agg(
        (F.max("frame_id") * SLOTS + (SLOTS - 1)).alias("position"), F.lit(EOS).alias("token")
    )
    stream = tokens.unionByName(closing)
    width = max(0, int(order) - 1)
    if width == 0:
        return stream.select(*TRACK, F.lit("").alias("context"), "token")
    lagged = with_previous(materialize(stream), TRACK, "position", ["token"], width, chunk=CHUNK_FRAMES * SLOTS)
    context = F.concat_ws(" ", *[F.coalesce(f"prev{n}_token", F.lit(BOS)) for n in range(width, 0, -1)])
    return lagged.select(*TRACK, context.alias("context"), "token")


def ngram_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("context", "token").agg(F.count(F.lit(1)).alias("count"))


def ngram_scores(train_events: DataFrame, score_events: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Mean negative log probability of each track under the training counts.

    Tokens outside the training vocabulary count as UNK.  The alphabet is fixed
    (about twenty tokens), so the count table is bounded by alphabet ** order and
    is broadcast.
    """
    if not (alpha > 0 and math.isfinite(alpha)):
        raise ValueError("alpha must be a finite positive value")
    counts = materialize(ngram_counts(train_events))
    totals = counts.groupBy("context").agg(F.sum("count").alias("total"))
    vocabulary = sorted({r["token"] for r in counts.select("token").distinct().collect()} | {EOS, UNK})
    known = F.array(*[F.lit(t) for t in [*vocabulary, BOS]])

    def mapped(token: Column) -> Column:
        return F.when(F.array_contains(known, token), token).otherwise(F.lit(UNK))

    context = F.array_join(F.transform(F.split("context", " "), mapped), " ")
    rows = score_events.select(*TRACK, context.alias("context"), mapped(F.col("token")).alias("token"))
    joined = rows.join(counts, ["context", "token"], "left").join(totals, "context", "left")
    zero = F.lit(0)
    probability = (F.coalesce("count", zero) + alpha) / (F.coalesce("total", zero) + alpha * len(vocabulary))
    return joined.groupBy(*TRACK).agg(
        F.avg(-F.log(probability)).alias("score"), (F.count(F.lit(1)) - 1).alias("num_tokens")
    )
