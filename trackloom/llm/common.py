"""Helpers shared by the corpus operators: tables, checked broadcasts, components, pair verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.words import chunks
from trackloom.session import materialize

#: Rows up to which a counted, narrow table (ids and numbers) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of one group that are handled beside each other; larger groups are split.
SPLIT_ROWS = 256
MAX_ROUNDS = 60
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """``_id``, ``_th`` and ``_text``: id, hash of the text and text of every document.

    Rows equal in id and text are one document read twice; every decision holds for all of them.
    A null text is an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"), *more)


def same_document(left: DataFrame, right: DataFrame, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join on ``_id`` (null equal to null) and ``_th``; ``right`` is broadcast if its counted rows are few."""
    right = right.select(
        F.coalesce("_id", F.lit(0)).alias("_rk"), F.col("_id").isNull().alias("_rn"), F.col("_th").alias("_rt"),
        *[c for c in right.columns if c not in ("_id", "_th")],
    )
    if rows is not None and rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
    on = (
        (F.coalesce("_id", F.lit(0)) == F.col("_rk")) & (F.col("_id").isNull() == F.col("_rn"))
        & (F.col("_th") == F.col("_rt"))
    )
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_rk", "_rn", "_rt")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node of the undirected ``edges`` (u, v).

    Large-star and small-star contraction: joins and aggregations with map-side combine,
    a written table per round, rounds in the logarithm of the longest path.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else pairs
        low = both if large else pairs
        low = low.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        met = near.join(low, "u")
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        else:
            out = met.where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
            out = out.unionByName(low.select("u", F.col("_m").alias("v")))
        return out.where(F.col("u") > F.col("v")).distinct()

    def stamp(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    seen = stamp(current)
    for _ in range(MAX_ROUNDS):
        current = materialize(stars(stars(current, True), False))
        now = stamp(current)
        if now == seen:
            heads = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads)
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


#: Of a batch with a text column ``_text``: row of each set member, and the member, sorted by both.
Members = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def overlaps(pairs: DataFrame, texts: DataFrame, members: Members, partitions: int) -> DataFrame:
    """``x``, ``y``, ``nx``, ``ny`` and ``common``: set sizes and overlap of every pair of nodes.

    ``texts`` has ``node`` (unique) and ``_text``.  The texts of all x of one y stream past the set of y;
    a y with many x is split, and only its own text is repeated for each part.
    """
    counts = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).alias("_k"))
    placed = pairs.join(counts, "y").withColumn("_part", F.pmod(F.xxhash64("x"), F.col("_k")).cast("int"))
    first = counts.select("y", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)).alias("_part")).join(
        texts.withColumnRenamed("node", "y"), "y"
    )
    other = placed.select("x", "y", "_part").join(texts.withColumnRenamed("node", "x"), "x")
    rows = (
        first.select("y", "_part", F.lit(None).cast(pairs.schema["x"].dataType).alias("x"), "_text")
        .unionByName(other.select("y", "_part", "x", "_text"))
        .repartition(partitions, "y", "_part")
        .sortWithinPartitions("y", "_part", F.col("x").asc_nulls_first())
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_y = np.zeros(0, np.uint64), None
        for batch in chunks(batches, "_text"):
            row, member = members(batch.column("_text"))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ys, xs = batch.column("y").to_pylist(), batch.column("x").to_pylist()
            out: list[tuple] = []
            for i, (y, x) in enumerate(zip(ys, xs)):
                own = member[at[i] : at[i + 1]]
                if x is None:
                    held, held_y = own, y
                    continue
                assert held_y == y
                common = 0
                if len(held) and len(own):
                    place = np.searchsorted(held, own)
                    place[place == len(held)] = 0
                    common = int((held[place] == own).sum())
                out.append((x, y, len(own), len(held), common))
            if out:
                kinds = [batch.schema.field("x").type] * 2 + [pa.int64()] * 3
                cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "nx", "ny", "common"])

    kind = pairs.schema["x"].dataType.simpleString()
    return rows.mapInArrow(compare, f"x {kind}, y {kind}, nx long, ny long, common long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, order: list[str], value: str, by: tuple[str, ...] = (), out: str = "cum") -> DataFrame:
    """``df`` with the inclusive sum of ``value`` along ``order`` (which starts with ``by``), per ``by``.

    The table is range-partitioned, so that a key of any size spreads over tasks, and written once: its
    partition numbers must not change between the sums per partition and the sums within it.
    """
    spark = df.sparkSession
    sort = [F.col(c).asc_nulls_last() for c in order]
    placed = materialize(
        df.repartitionByRange(shuffle_partitions(spark), *sort).withColumn("_p", F.spark_partition_id())
    )
    totals = placed.groupBy("_p", *by).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy("_p", *by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_within", F.sum(value).over(within))
        .join(totals, ["_p", *by])
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_p", "_before", "_within")
    )


def n_words(text) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE))).otherwise(0).cast("long")


def host_key(column: str) -> Column:
    """A key that is never null and tells a null from every string."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))
