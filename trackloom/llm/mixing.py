"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source stand in a shuffled order (by a seeded digest) and may repeat for some epochs.  A copy's virtual
finish time is the number of its source's words up to its end, divided by the source's target.  All copies
are range-sorted by that time and the queue is cut where the total budget is spent, so every source gets its
share up to about a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, host_key, n_words, running_sums
from trackloom.session import materialize

#: Copies of a document at most, and so the largest target in sizes of a source.
EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-42"
_ORDER = ["_s", "_o", "_k"]


def targets(sizes: DataFrame, budget: int, epochs: int = EPOCHS) -> DataFrame:
    """``target`` of every source (``source_size``, ``weight`` > 0): the budget by weight, at most ``epochs`` times its size.

    What is above a source's cap is shared again by weight among the others; every round is one sum over sources.
    """
    cap = F.col("source_size") * epochs

    def share(level: float | None) -> float:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        row = sizes.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("spent"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        return (budget - (row["spent"] or 0)) / row["open"] if row["open"] else (level or 0.0)

    level = share(None)
    while (after := share(level)) > level:
        level = after
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def by_position(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``weight`` of every source: ``weights`` repeating in the order of ``_s`` (code points, null last)."""
    placed = running_sums(sources.withColumn("_one", F.lit(1)), ["_s"], "_one", out="_at").drop("_one")
    at = F.pmod(F.col("_at") - 1, F.lit(len(weights)))
    return placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int"))).drop("_at")


def mixed(
    docs: DataFrame, source: str = "source", weights: tuple[float, ...] | DataFrame = WEIGHTS, seed: str = SEED, share: float = 1.0
) -> DataFrame:
    """One row per document: ``doc_id``, ``_th``, ``_s``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes the document, ``taken`` the
    words of these copies.  ``weights`` repeat over the sources in code point order, or are a table
    (source, weight).  The budget is ``share`` of all words.  A null source is a source of its own; documents
    without words are never taken.  Repeated rows stand in the queue as often as they occur.  Reruns
    agree, whatever the partitions.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)))
    rows = materialize(
        docs.select("doc_id", F.xxhash64(text, host_key(source)).alias("_th"), host_key(source).alias("_s"), key.alias("_k"), n_words(text).alias("size"))
    ).withColumn("_o", F.substring("_k", 1, 15))
    sizes = rows.groupBy("_s").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(host_key("source").alias("_s"), F.col("weight").cast("double"))
        sizes = sizes.join(given, "_s")
    else:
        sizes = by_position(sizes, weights)
    sizes = materialize(sizes)
    budget = int((sizes.agg(F.sum("source_size")).first()[0] or 0) * share)
    aims = materialize(targets(sizes, budget).drop("weight"))
    queue = running_sums(rows, _ORDER, "size", by=("_s",), out="_cum").join(aims, "_s")
    queue = materialize(queue)
    ready = (F.col("size") > 0) & (F.col("target") > 0)
    epochs = F.least(F.floor(F.try_divide("target", "source_size")), F.lit(EPOCHS - 1)).cast("int")
    copies = queue.where(ready).select(
        "_s", "_o", "_k", "size", "_cum", "source_size", "target", F.explode(F.sequence(F.lit(0), epochs)).alias("_e")
    )
    finish = F.try_divide(F.col("_e") * F.col("source_size") + F.col("_cum"), F.col("target"))
    line = running_sums(copies.withColumn("_v", finish), ["_v", *_ORDER, "_e"], "size", out="_all")
    at = [F.col(c) for c in ("_v", *_ORDER, "_cum")]
    last = line.where(F.col("_all") <= budget).agg(F.max(F.struct(*at)).alias("m")).first()["m"]
    taken = F.lit(0)
    if last is not None:
        for e in range(EPOCHS):
            end = F.try_divide(F.lit(e) * F.col("source_size") + F.col("_cum"), F.col("target"))
            before = F.struct(end.alias("_v"), *at[1:]) <= F.struct(*[F.lit(last[c]).alias(c) for c in ("_v", *_ORDER, "_cum")])
            taken = taken + F.when(ready & (F.lit(e) <= epochs) & before, 1).otherwise(0)
    return queue.withColumn("copies", taken.cast("int")).select(
        "doc_id", "_th", "_s", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, source: str = "source", weights: tuple[float, ...] | DataFrame = WEIGHTS, **more) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated, once or not at all; all columns as they were.

    Of rows equal in id, text and source each gets the same number of copies, rounded up from their sum.
    """
    plan = mixed(docs, source, weights, **more).select(F.col("doc_id").cast("long").alias("_id"), "_th", "copies")
    plan = materialize(
        plan.groupBy("_id", "_th").agg(F.ceil(F.sum("copies") / F.count(F.lit(1))).cast("int").alias("copies")).where("copies > 0")
    )
    right = plan.select(
        F.coalesce("_id", F.lit(0)).alias("_k"), F.col("_id").isNull().alias("_null"), F.col("_th").alias("_t"), "copies"
    )
    right = F.broadcast(right) if plan.count() <= BROADCAST_ROWS else right
    whole = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), host_key(source)).alias("_th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
    )
    on = (F.coalesce("_id", F.lit(0)) == F.col("_k")) & (F.col("_id").isNull() == F.col("_null")) & (F.col("_th") == F.col("_t"))
    return (
        whole.join(right, on)
        .select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
        .select("_doc.*")
    )


def oracle(seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> str:
    """The query in DuckDB's SQL."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH r AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
p AS (SELECT s, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * {epochs} AS cap,
    CASE (row_number() OVER (ORDER BY s) - 1) % {len(weights)} {cases} END::DOUBLE AS w FROM r GROUP BY s),
q AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
    (SELECT sum(source_size)::BIGINT FROM p) AS b FROM p WINDOW o AS (ORDER BY cap / w, s)),
a AS (SELECT s, source_size, least(w * (SELECT max((b - spent) / open_) FROM q WHERE w * (b - spent) / open_ < cap OR cap = 0), cap) AS target, b FROM q),
c AS (SELECT r.*, a.source_size, a.target, a.b, sum(size) OVER (PARTITION BY r.s ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS cum FROM r JOIN a USING (s)),
e AS (SELECT doc_id, k, s, size, b, cum, n.i AS e, (n.i * source_size + cum) / target AS v FROM c, (VALUES (0), (1), (2)) AS n(i)
    WHERE size > 0 AND target > 0 AND n.i <= least(floor(target / source_size), {epochs - 1})),
l AS (SELECT doc_id, k, size, sum(size) OVER (ORDER BY v, s, k, cum, e ROWS UNBOUNDED PRECEDING) AS cut, b FROM e),
t AS (SELECT doc_id, k, sum(size)::BIGINT AS taken FROM l WHERE cut <= b GROUP BY doc_id, k)
SELECT c.doc_id, c.size, c.source_size, round(c.target, 6) + 0.0 AS target, coalesce(t.taken, 0)::BIGINT AS taken
FROM c LEFT JOIN t ON t.k = c.k"""
