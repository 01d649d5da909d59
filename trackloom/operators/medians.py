"""Running medians: every row against the median of all earlier rows of its key, for keys of any length.

Rows are cut into chunks of their integer order.  Inside a chunk an Arrow kernel keeps the values in order and inserts one row after the other.
What a chunk needs of all earlier rows is little: while it adds its at most n rows, the median moves by at most n / 2 + 1
places, so it gets the earlier values of that stretch and the number of those below it, not the earlier rows.

The stretches are found from ranks.  A value's rank within its key, cut into blocks, is a number; one pass over (chunk, block, count) keeps
a counter per block (rows of the key / chunk of them) and notes the blocks of every chunk's stretch.  Blocks travel packed, as one row each, to the
chunks that asked for them.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.scale import CHUNK_FRAMES, one_chunk, row_positions
from trackloom.session import materialize

#: Chunks that ask for a block together; a block is copied once for each such set.
ASKERS = 64


def running_medians(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: int = CHUNK_FRAMES, single: bool | None = None
) -> DataFrame:
    """Add ``{column}_before``: median of the column over the earlier rows of the key (null without one).

    ``order`` is an integer, unique within ``keys``, which are not null.  Null values of a column count nowhere; NaN counts as infinity.
    ``df`` should be materialised.  When all rows lie in one chunk (``single``) nothing is handed over.
    """
    keys, columns = list(keys), list(columns)
    rows = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    handed = None
    if not (one_chunk(df, order, chunk) if single is None else single):
        for place, column in enumerate(columns):
            part = _stretches(rows, keys, order, column, chunk).withColumn("_column", F.lit(place))
            handed = part if handed is None else handed.unionByName(part)
    return _kernel(rows, handed, keys, order, columns, df)


def _kernel(rows: DataFrame, handed: DataFrame | None, keys: list[str], order: str, columns: list[str], df: DataFrame) -> DataFrame:
    group = [*keys, "_chunk"]
    extra = {"_column": "int", "_below": "long", "_total": "long", "_values": "array<double>"}
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in extra.items()})
    if handed is not None:
        rows = rows.unionByName(handed.select(*group, *extra), allowMissingColumns=True)
    # what is handed over (no order value) comes before the rows of the chunk
    placed = rows.repartition(*group).sortWithinPartitions(*group, F.col(order).asc_nulls_first())
    numbers = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    placed = placed.select(*df.columns, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], *numbers, *extra)

    names = list(df.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[list[float]] = []
        below: list[int] = []
        count: list[int] = []
        for batch in batches:
            own = list(zip(*[batch.column(f"_k{i}").to_pylist() for i in range(len(group))]))
            values = [batch.column(f"_v{i}").to_pylist() for i in range(len(columns))]
            given, lows, totals, places = (batch.column(c).to_pylist() for c in ("_values", "_below", "_total", "_column"))
            out: list[list[float | None]] = [[] for _ in columns]
            kept = []
            for n, k in enumerate(own):
                if k != key:
                    key = k
                    held, below, count = [[] for _ in columns], [0] * len(columns), [0] * len(columns)
                if places[n] is not None:
                    c = places[n]
                    held[c], below[c], count[c] = sorted(given[n]), lows[n], totals[n]
                    continue
                kept.append(n)
                for c in range(len(columns)):
                    total, line = count[c], held[c]
                    if total:
                        at = total - 1 >> 1
                        low = line[at - below[c]]
                        out[c].append(low if total & 1 else (low + line[at + 1 - below[c]]) / 2)
                    else:
                        out[c].append(None)
                    value = values[c][n]
                    if value is not None:
                        insort(line, math.inf if math.isnan(value) else value)
                        count[c] += 1
            some = batch.select(names).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, *[pa.array(o, pa.float64()) for o in out]], names=[*names, *[f"{c}_before" for c in columns]]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return placed.mapInArrow(work, kinds + "".join(f", `{c}_before` double" for c in columns))


def _stretches(rows: DataFrame, keys: list[str], order: str, column: str, chunk: int) -> DataFrame:
    """What every chunk but the first of a key needs: ``_values`` of its stretch and the number of earlier values ``_below`` it."""
    value = F.when(F.isnan(F.col(column).cast("double")), F.lit(math.inf)).otherwise(F.col(column).cast("double"))
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    keyed = [f"_key{i}" for i in range(len(keys))]
    flat = rows.select(*named, F.col("_chunk").alias("c"), F.col(order).alias("o"), value.alias("v")).where(F.col("v").isNotNull())
    ranked = row_positions(flat, keyed, [("v", True), ("o", True)], "r")
    ranked = materialize(ranked.select(*keyed, "c", "v", F.floor(F.col("r") / chunk).cast("long").alias("b")))
    counts = ranked.groupBy(*keyed, "c", "b").agg(F.count(F.lit(1)).alias("n"))
    # chunks whose values are all null still ask
    asking = rows.select(*named, F.col("_chunk").alias("c")).distinct().select(*keyed, "c", F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    placed = counts.unionByName(asking).repartition(*keyed).sortWithinPartitions(*keyed, "c", "b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keyed).schema.fields)
    wanted = materialize(placed.mapInArrow(_asked(keyed), f"{kinds}, c long, b0 long, b1 long, below long, total long"))

    block = [*keyed, "b"]
    packed = ranked.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("_p"))
    asks = wanted.withColumn("b", F.explode(F.sequence("b0", "b1")))
    sets = asks.groupBy(*block, F.floor(F.col("c") / ASKERS).alias("_s")).agg(F.collect_list(F.struct("c", "below", "total")).alias("_a"))
    met = sets.join(packed, block).withColumn("_a", F.explode("_a"))
    earlier = F.transform(F.filter("_p", lambda p: p["c"] < F.col("_a.c")), lambda p: p["v"])
    met = met.select(*keyed, F.col("_a.c").alias("c"), F.col("_a.below").alias("_below"), F.col("_a.total").alias("_total"), earlier.alias("_part"))
    whole = met.groupBy(*keyed, "c", "_below", "_total").agg(F.flatten(F.collect_list("_part")).alias("_values"))
    return whole.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], F.col("c").alias("_chunk"), "_below", "_total", "_values")


def _asked(keyed: list[str]):
    """Blocks of the stretch of every chunk, from (chunk, block, count) in order; holds one counter per block of a key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        counter = np.zeros(16, np.int64)
        total, current, fresh, size, out = 0, None, {}, 0, []

        def close() -> None:
            """The chunk has been read: note its stretch among the earlier values, then add its own."""
            nonlocal total, counter
            if total:
                ends = np.cumsum(counter)
                first = max((total - size - 1) // 2, 0)
                last = min((total + size) // 2, total - 1)
                b0, b1 = (int(np.searchsorted(ends, p, "right")) for p in (first, last))
                out.append((*key, current, b0, b1, int(ends[b0] - counter[b0]), total))
            for b, n in fresh.items():
                if b >= len(counter):
                    counter = np.concatenate([counter, np.zeros(max(b + 1 - len(counter), len(counter)), np.int64)])
                counter[b] += n
            total += size

        types: list = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keyed] + [pa.int64()] * 5
            for *own, c, b, n in zip(*[batch.column(x).to_pylist() for x in (*keyed, "c", "b", "n")]):
                if (own := tuple(own)) != key or c != current:
                    if key is not None:
                        close()
                    if own != key:
                        key, total, counter = own, 0, np.zeros(16, np.int64)
                    current, fresh, size = c, {}, 0
                if b >= 0:
                    fresh[b] = fresh.get(b, 0) + n
                    size += n
            yield _table(out, types)
            out = []
        if key is not None:
            close()
            yield _table(out, types)

    def _table(out: list[tuple], types: list) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[*keyed, "c", "b0", "b1", "below", "total"])

    return work
