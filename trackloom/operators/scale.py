"""Building blocks that keep hot keys from landing in one task.

A plain ``Window.partitionBy(key)`` or ``percentile`` aggregate gathers a whole
key in one task.  That is fine for a key whose size is bounded (one track inside
a 16-frame window) and fatal for one that may hold a third of the table.  The
functions here are exact for any key size:

* ``with_previous``    lag over an integer order, cut into frame chunks with a halo
* ``dense_position``   dense rank of an integer order, from per-chunk counts
* ``percentiles``      exact interpolated percentiles (plain aggregate for keys of
                       checked size, bucketed order statistics for the rest)
* ``running_totals``   cumulative sums along a value, from per-bucket totals
* ``row_positions``    row_number over a total order, from a range-partitioned table
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import materialize

Quantile = float | Callable[[Column], Column]

CHUNK_FRAMES = 4096
COLD_ROWS = 200_000
BUCKETS_PER_E = 512


# --------------------------------------------------------------------------- order by frame
def one_chunk(df: DataFrame, order: str, chunk: int = CHUNK_FRAMES) -> bool:
    """Whether every value of the integer ``order`` lies in the same chunk.

    Run it on a materialised table, where it reads a single column.
    """
    row = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    return row["lo"] is None or row["lo"] // chunk == row["hi"] // chunk


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    depth: int = 1,
    chunk: int = CHUNK_FRAMES,
    single: bool | None = None,
) -> DataFrame:
    """Add ``prev{n}_{column}`` (n = 1..depth) of the n-th earlier row of the key.

    ``order`` is an integer that is unique within ``keys``, so one (key, chunk)
    group has at most ``chunk`` rows.  The last ``depth`` rows of every chunk are
    handed to the next one as its halo, so a long key spreads over many tasks.
    When the whole table lies in one chunk (``single``, found by one min/max over
    the input unless given) no halo exists and the plain window is already bounded.
    """
    keys = list(keys)
    wanted = [order] + [c for c in columns if c != order]
    if one_chunk(df, order, chunk) if single is None else single:
        bounded = Window.partitionBy(*keys).orderBy(order)
        return df.select(
            "*",
            *[
                F.lag(F.col(c), n).over(bounded).alias(f"prev{n}_{c}")
                for n in range(1, depth + 1)
                for c in wanted
            ],
        )
    parts = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long")).repartition(
        *[F.col(k) for k in keys], F.col("_chunk")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    ranked = parts.withColumn("_rn", F.row_number().over(inside))
    for n in range(1, depth + 1):
        ranked = ranked.withColumns(
            {f"_in{n}_{c}": F.lag(F.col(c), n).over(inside) for c in wanted}
        )

    tails = parts.groupBy(*keys, "_chunk").agg(
        F.slice(
            F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in wanted])), asc=False), 1, depth
        ).alias("_tail")
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-depth, -1)
    halo = (
        tails.withColumn("_halo", F.sort_array(F.flatten(F.collect_list("_tail").over(earlier)), asc=False))
        .where(F.size("_halo") > 0)
        .select(*keys, "_chunk", F.slice("_halo", 1, depth).alias("_halo"))
    )

    joined = ranked.join(halo, [*keys, "_chunk"], "left")
    added = {}
    for n in range(1, depth + 1):
        missing = F.lit(n) - F.col("_rn") + F.lit(1)
        for c in wanted:
            added[f"prev{n}_{c}"] = F.when(F.col("_rn") > n, F.col(f"_in{n}_{c}")).otherwise(
                F.get(F.col("_halo"), missing - 1)[c]
            )
    return joined.select(*[F.col(c) for c in df.columns], *[e.alias(a) for a, e in added.items()])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    wanted: Mapping[str, tuple[str, str]],
    chunk: int = CHUNK_FRAMES,
    single: bool = False,
) -> DataFrame:
    """Inclusive running aggregates along an integer order, carried across chunks.

    ``wanted`` maps an output name to ``(kind, column)`` with kind ``sum``,
    ``max`` or ``last`` (last non-null value, i.e. forward fill).  With ``single``
    the caller knows that all rows share a chunk, so nothing is carried.
    """
    keys = list(keys)
    group = [*keys, "_chunk"]
    parts = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    inside = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    over_rows, per_chunk, carried, out = {}, [], [], []
    for name, (kind, column) in wanted.items():
        value = F.col(column)
        if kind == "sum":
            over_rows[f"_in_{name}"] = F.sum(value).over(inside)
            per_chunk.append(F.sum(value).alias(f"_c_{name}"))
            carried.append(F.sum(f"_c_{name}").over(earlier).alias(f"_o_{name}"))
            total = F.coalesce(F.col(f"_o_{name}"), F.lit(0)) + F.coalesce(F.col(f"_in_{name}"), F.lit(0))
        elif kind == "max":
            over_rows[f"_in_{name}"] = F.max(value).over(inside)
            per_chunk.append(F.max(value).alias(f"_c_{name}"))
            carried.append(F.max(f"_c_{name}").over(earlier).alias(f"_o_{name}"))
            total = F.greatest(F.col(f"_o_{name}"), F.col(f"_in_{name}"))
        elif kind == "last":
            over_rows[f"_in_{name}"] = F.last(value, ignorenulls=True).over(inside)
            per_chunk.append(
                F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_c_{name}")
            )
            carried.append(F.last(f"_c_{name}", ignorenulls=True).over(earlier).alias(f"_o_{name}"))
            total = F.coalesce(F.col(f"_in_{name}"), F.col(f"_o_{name}"))
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")
        out.append(total.alias(name))
    if single:
        plain = [
            (F.coalesce(F.col(f"_in_{name}"), F.lit(0)) if kind == "sum" else F.col(f"_in_{name}")).alias(name)
            for name, (kind, _) in wanted.items()
        ]
        return parts.withColumns(over_rows).select(*[F.col(c) for c in df.columns], *plain)
    carry = parts.groupBy(*group).agg(*per_chunk).select(*group, *carried)
    return (
        parts.withColumns(over_rows)
        .join(carry, group, "left")
        .select(*[F.col(c) for c in df.columns], *out)
    )


def dense_position(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "position", chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Distinct (keys, order) rows with their 0-based position within ``keys``.

    Chunks of the integer ``order`` are counted first; the running count over the
    chunk table (1/chunk of the rows) gives each chunk its offset.
    """
    keys = list(keys)
    distinct = df.select(*keys, order).distinct().withColumn(
        "_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long")
    )
    counts = distinct.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        distinct.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .select(*keys, order, (F.col("_offset") + F.col("_rn") - 1).cast("long").alias(out))
    )


# --------------------------------------------------------------------------- order statistics
def value_bucket(value: Column, resolution: int = BUCKETS_PER_E) -> Column:
    """A weakly monotone integer bucket of a double, a fraction of a percent wide.

    Infinities lie beyond all numbers and NaN beyond infinity, as in Spark's own order.
    """
    magnitude = F.floor(F.log1p(F.abs(value) * F.lit(1e6)) * F.lit(float(resolution)))
    edge = 2**62
    return (
        F.when(F.isnan(value), F.lit(edge + 1))
        .when(value == float("inf"), F.lit(edge))
        .when(value == float("-inf"), F.lit(-edge))
        .otherwise((F.signum(value) * magnitude).cast("long"))
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, Quantile]],
    cold_rows: int | None = COLD_ROWS,
) -> DataFrame:
    """Exact linearly interpolated percentiles per key; nulls are ignored, NaN is the largest value.

    ``wanted`` maps an output name to ``(column, q)``; instead of a share ``q`` may
    be a function of the number of values that gives the 0-based position.  Keys of at most
    ``cold_rows`` rows use the built-in aggregate; whether larger ones exist is
    checked first (so pass a materialised table); those, rows / cold_rows at most, go through
    ``bucketed_percentiles``.  ``cold_rows=None`` treats every key as large.
    """
    keys = list(keys)
    columns = sorted({c for c, _ in wanted.values()})
    df = df.select(*keys, *columns)
    if cold_rows is None:
        return bucketed_percentiles(df, keys, wanted)
    plain = [_cold_percentile(c, q).alias(a) for a, (c, q) in wanted.items()]
    hot_keys = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cold_rows).select(*keys)
    )
    if hot_keys.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    hot_keys = materialize(hot_keys)
    cold = df.join(hot_keys, keys, "left_anti").groupBy(*keys).agg(*plain)
    hot = bucketed_percentiles(df.join(hot_keys, keys, "left_semi"), keys, wanted)
    return cold.unionByName(hot)


def _cold_percentile(column: str, q: Quantile) -> Column:
    if callable(q):
        ordered = F.sort_array(F.collect_list(column))
        return F.get(ordered, q(F.size(ordered)).cast("int"))
    return F.percentile(F.col(column), F.lit(q))


def bucketed_percentiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, Quantile]]
) -> DataFrame:
    """Exact percentiles without gathering a key: count values, count buckets, pick.

    Equal values collapse before the shuffle; the bucket holding an order
    statistic is found on the small bucket table and only that bucket's values
    are ranked.
    """
    keys = list(keys)
    columns = sorted({c for c, _ in wanted.values()})
    quantiles: dict[str, list[tuple[str, Quantile]]] = {}
    for out, (column, q) in wanted.items():
        quantiles.setdefault(column, []).append((out, q))

    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in columns]
            )
        ).alias("_e"),
    ).select(*keys, "_e._col", "_e._v")
    values = (
        long.where(F.col("_v").isNotNull())
        .groupBy(*keys, "_col", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", value_bucket(F.col("_v")))
    )
    group = [*keys, "_col"]
    buckets = values.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_bn"))
    ordered = Window.partitionBy(*group).orderBy("_bucket")
    buckets = buckets.withColumn(
        "_before",
        F.coalesce(F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_total", F.sum("_bn").over(Window.partitionBy(*group)))

    targets = F.lit(None)
    for column, items in quantiles.items():
        positions = []
        for out, q in items:
            at = q(F.col("_total")) if callable(q) else (F.col("_total") - 1) * F.lit(float(q))
            for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                positions.append(
                    F.struct(
                        F.lit(out).alias("out"),
                        F.lit(side).alias("side"),
                        position.cast("long").alias("pos"),
                        (at - F.floor(at)).alias("frac"),
                    )
                )
        targets = F.when(F.col("_col") == column, F.array(*positions)).otherwise(targets)
    picked = (
        buckets.withColumn("_t", F.explode(targets))
        .where(
            (F.col("_t.pos") >= F.col("_before")) & (F.col("_t.pos") < F.col("_before") + F.col("_bn"))
        )
        .select(*group, "_bucket", "_before", "_t")
    )
    inside = (
        Window.partitionBy(*group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = values.join(picked.select(*group, "_bucket").distinct(), [*group, "_bucket"], "left_semi")
    spans = needed.withColumn("_start", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hits = spans.join(picked, [*group, "_bucket"]).where(
        (F.col("_t.pos") >= F.col("_before") + F.col("_start"))
        & (F.col("_t.pos") < F.col("_before") + F.col("_start") + F.col("_n"))
    )
    outputs = []
    for out in wanted:
        lo = F.max(F.when((F.col("_t.out") == out) & (F.col("_t.side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_t.out") == out) & (F.col("_t.side") == "hi"), F.col("_v")))
        frac = F.max(F.when(F.col("_t.out") == out, F.col("_t.frac")))
        outputs.append(F.when(lo == hi, lo).otherwise(lo * (1 - frac) + hi * frac).alias(out))
    return hits.groupBy(*keys).agg(*outputs)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, str],
    descending: bool = True,
) -> DataFrame:
    """Inclusive running sums along ``value`` (unique per key), one column per entry.

    Two levels: totals per value bucket, then rows inside each bucket, so that no
    task sees a whole key.  ``sums`` maps output name to summed column.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", value_bucket(F.col(value)))
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_b_{a}") for a, c in sums.items()])
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = (
        Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_b_{a}").over(before), F.lit(0)).alias(f"_o_{a}") for a in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(direction(value))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = bucketed.select(
        "*", *[F.sum(c).over(inside).alias(f"_i_{a}") for a, c in sums.items()]
    ).join(offsets, [*keys, "_bucket"])
    return ranked.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o_{a}") + F.col(f"_i_{a}")).alias(a) for a in sums],
    )


# --------------------------------------------------------------------------- total order
def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    out: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """0-based position and group size of every row in the order given per key.

    ``order`` lists ``(column, ascending)`` and must be a total order (end it with
    an id).  The table is range-partitioned on keys and order, so that even equal
    values of one key spread over tasks by their id, and written once: the range
    bounds are sampled, hence the partition numbers must be fixed before they are
    counted and used.
    """
    keys = list(keys)
    sorting = [F.col(k).asc() for k in keys] + [
        F.col(c).asc() if asc else F.col(c).desc() for c, asc in order
    ]
    # without a number AQE merges neighbouring small ranges, which keeps the order
    ranged = df.repartitionByRange(partitions, *sorting) if partitions else df.repartitionByRange(*sorting)
    placed = materialize(ranged.withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{out}_count"),
    )
    inside = Window.partitionBy(*keys, "_pid").orderBy(*sorting[len(keys):])
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_pid"])
        .select(
            *[F.col(c) for c in df.columns],
            (F.col("_offset") + F.col("_rn") - 1).cast("long").alias(out),
            F.col(f"{out}_count").cast("long").alias(f"{out}_count"),
        )
    )
