"""Rank and robust normalisation of score tables, exact for any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import clamp, finite
from trackloom.operators.scale import COLD_ROWS, percentiles, row_positions, running_totals
from trackloom.session import materialize

EPSILON = 1e-6
MAD_SCALE = 1.4826


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form: ids, ``component``, ``value``."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*ids, F.explode(pairs).alias("_m")).select(*ids, "_m.component", "_m.value")


def widen(long: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Back to one row per id (the component names are known, so no pivot scan)."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col("component") == c, F.col(value))).alias(prefix + c) for c in columns]
    )


def column_profile(df: DataFrame, columns: Sequence[str], cold_rows: int = COLD_ROWS) -> dict[str, dict[str, float]]:
    """Median, MAD, mean, population deviation and extremes of each column.

    Returns a fixed number of scalars per column to the driver, never rows.
    ``df`` should be materialised: a table of at most ``cold_rows`` rows uses the
    built-in percentile, a larger one bucketed order statistics.
    """
    columns = list(columns)
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    small = df.count() <= cold_rows
    spec = {"mean": F.avg, "std": F.stddev_pop, "low": F.min, "high": F.max, "n": F.count}
    row = df.agg(
        *[f(c).alias(f"{c}|{name}") for c in columns for name, f in spec.items()],
        *([F.median(c).alias(f"{c}|median") for c in columns] if small else []),
    ).first()
    profile: dict[str, dict[str, float]] = {c: {} for c in columns}
    for key, value in row.asDict().items():
        column, _, name = key.rpartition("|")
        profile[column][name] = value
    if not small:
        for r in percentiles(melt(df, [], columns), ["component"], {"m": ("value", 0.5)}, None).collect():
            profile[r["component"]]["median"] = r["m"]
    profile = {c: p for c, p in profile.items() if p["n"]}
    spread = df.select(
        *[F.abs(F.col(c) - F.lit(profile[c]["median"])).alias(f"{c}|mad") for c in profile],
        *[F.abs(F.col(c)).alias(f"{c}|abs_median") for c in profile],
    )
    names = spread.columns
    if small:
        found = spread.agg(*[F.median(F.col(f"`{n}`")).alias(n) for n in names]).first().asDict()
    else:
        long = melt(spread.toDF(*[str(i) for i in range(len(names))]), [], [str(i) for i in range(len(names))])
        rows = percentiles(long, ["component"], {"m": ("value", 0.5)}, None).collect()
        found = {names[int(r["component"])]: r["m"] for r in rows}
    for key, value in found.items():
        column, _, name = key.rpartition("|")
        profile[column][name] = value
    return profile


def robust_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], tie: str = "sample_id") -> DataFrame:
    """``n_{column}``: distance above the median in MADs over the whole table.

    A column without spread falls back to its ordinal position by (value, id).
    """
    base = materialize(df.select(*ids, *columns))
    profile = column_profile(base, columns)
    flat = [c for c in columns if c in profile and profile[c]["mad"] <= EPSILON]
    scaled = base.select(
        *ids,
        *[
            F.greatest(
                F.lit(0.0),
                (F.col(c) - profile[c]["median"]) / (MAD_SCALE * profile[c]["mad"] + EPSILON),
            ).alias(f"n_{c}")
            for c in columns
            if c in profile and c not in flat
        ],
    )
    if not flat:
        return scaled
    placed = row_positions(melt(base, ids, flat), ["component"], [("value", True), (tie, True)])
    ordinal = placed.withColumn(
        "_n", F.col("position") / F.greatest(F.col("position_count") - 1, F.lit(1))
    )
    return scaled.join(widen(ordinal, ids, flat, "_n", "n_"), list(ids))


def robust_by_group(
    df: DataFrame, group: Sequence[str], ids: Sequence[str], columns: Sequence[str], tie: str,
    cold_rows: int | None = COLD_ROWS,
) -> DataFrame:
    """``n_{column}`` scaled inside each group; groups of any size and number."""
    group, ids = list(group), list(ids)
    base = materialize(df.select(*ids, *columns))
    long = melt(base, ids, columns)
    keys = [*group, "component"]
    centred = materialize(long.join(percentiles(long, keys, {"_med": ("value", 0.5)}, cold_rows), keys))
    spread = percentiles(
        centred.withColumn("_dev", F.abs(F.col("value") - F.col("_med"))),
        keys,
        {"_mad": ("_dev", 0.5)},
        cold_rows,
    )
    scored = materialize(centred.join(spread, keys))
    wide = F.col("_mad") > EPSILON
    scaled = scored.where(wide).withColumn(
        "_n",
        F.greatest(
            F.lit(0.0), (F.col("value") - F.col("_med")) / (MAD_SCALE * F.col("_mad") + EPSILON)
        ),
    )
    placed = row_positions(scored.where(~wide), keys, [("value", True), (tie, True)])
    ordinal = placed.withColumn(
        "_n", F.col("position") / F.greatest(F.col("position_count") - 1, F.lit(1))
    )
    keep = [*ids, "component", "_n"]
    return widen(scaled.select(*keep).unionByName(ordinal.select(*keep)), ids, columns, "_n", "n_")


def rank01(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    ties: Sequence[str],
    group: Sequence[str] = (),
    inverse: Sequence[str] = (),
) -> DataFrame:
    """``r_{column}``: position by (value, ties) spread over 0..1.

    All-equal values rank 0; columns in ``inverse`` get 1 - rank.  All columns are
    ranked by one range sort.
    """
    ids, group = list(ids), list(group)
    long = melt(df, ids, columns).withColumn("value", finite(F.col("value")))
    keys = [*group, "component"]
    placed = row_positions(long, keys, [("value", True), *[(t, True) for t in ties]])
    spans = placed.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rank = F.col("position") / (F.col("position_count") - 1)
    if inverse:
        rank = F.when(F.col("component").isin(list(inverse)), 1.0 - rank).otherwise(rank)
    ranked = placed.join(spans, keys).withColumn(
        "_r", F.when(F.col("_hi") > F.col("_lo"), rank).otherwise(F.lit(0.0))
    )
    return widen(ranked, ids, columns, "_r", "r_")


def average_ranks(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``avg_rank`` (1 = smallest, ties share the mean) and group size ``rank_count``.

    Equal values collapse to one row before they are ranked.
    """
    keys = list(keys)
    sizes = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    totals = sizes.groupBy(*keys).agg(F.sum("_ties").alias("rank_count"))
    ranked = running_totals(sizes, keys, value, {"_upto": "_ties"}, descending=False).join(totals, keys)
    mean_rank = F.col("_upto") - (F.col("_ties") - 1) / 2.0
    return long.join(ranked.select(*keys, value, mean_rank.alias("avg_rank"), "rank_count"), [*keys, value])


def quantile_bins(df: DataFrame, column: str, bins: int) -> Column:
    """Index of the quantile stratum of a column, right-closed, distinct edges.

    The ``bins + 1`` edges are scalars fetched from one aggregate.
    """
    qs = {f"q{i}": (column, i / bins) for i in range(bins + 1)}
    row = percentiles(
        df.select(F.lit(1).alias("_g"), column), ["_g"], qs, cold_rows=None
    ).first()
    edges = sorted({row[name] for name in qs}) if row else []
    inner = edges[1:-1]
    return sum(((F.col(column) > e).cast("int") for e in inner), F.lit(0))


def stratified_rank(
    df: DataFrame,
    ids: Sequence[str],
    score: str,
    columns: Sequence[str],
    ties: Sequence[str],
    bins: int = 4,
    global_weight: float = 0.7,
) -> DataFrame:
    """Global rank blended with the mean rank inside quantile strata of columns.

    A stratum with fewer than two rows uses the global rank.
    """
    ids = list(ids)
    base = materialize(df.select(*ids, score, *columns))
    everywhere = rank01(base, ids, [score], ties).withColumnRenamed(f"r_{score}", "_global")
    strata = base.select(
        *ids,
        score,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("axis"), quantile_bins(base, c, bins).alias("stratum"))
                    for c in columns
                ]
            )
        ).alias("_s"),
    ).select(*ids, score, "_s.axis", "_s.stratum")
    placed = row_positions(
        strata.withColumn("value", finite(F.col(score))),
        ["axis", "stratum"],
        [("value", True), *[(t, True) for t in ties]],
    )
    spans = placed.groupBy("axis", "stratum").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    local = F.when(F.col("position_count") < 2, F.col("_global")).otherwise(
        F.when(F.col("_hi") > F.col("_lo"), F.col("position") / (F.col("position_count") - 1)).otherwise(
            F.lit(0.0)
        )
    )
    mean_local = (
        placed.join(spans, ["axis", "stratum"])
        .join(everywhere, ids)
        .groupBy(*ids)
        .agg(F.avg(local).alias("local_rank"), F.first("_global").alias("global_rank"))
    )
    g = min(1.0, max(0.0, global_weight))
    return mean_local.withColumn(
        "score", clamp(g * F.col("global_rank") + (1.0 - g) * F.col("local_rank"))
    )
