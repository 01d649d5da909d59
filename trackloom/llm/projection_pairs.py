"""Near-duplicate vectors by sorted projection passes.

In every pass the vectors stand in lexicographic order of the signs of random projections, and each is compared
with the neighbours in a bounded window.  Pairs of cosine >= the threshold are links; the links of all passes are
united into components.  A window sees only part of a dense group, so the links inside each component
are then counted in full, block by block, without writing pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import components, running_sums
from trackloom.session import materialize

COSINE = 0.95
#: At cosine 0.95 two vectors share the signs of ten projections with probability 0.34 in a pass.
PASSES, BITS = 16, 60
WINDOW, BLOCK = 64, 512
_EPS = 1e-12


@lru_cache(maxsize=8)
def _planes(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([dim, 20]).normal(size=(dim, passes * BITS))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of length one, in double precision; all vectors have the same number of components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: int):
    def work(group: pa.Table) -> pa.Table:
        x = unit(group.column("e").combine_chunks())
        signs = (x @ _planes(x.shape[1], passes) > 0).reshape(len(x), passes, BITS)
        key = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        cid = np.repeat(group.column("cid").to_numpy(), passes)
        dim = np.full(len(cid), x.shape[1], np.int32)
        number = np.tile(np.arange(passes, dtype=np.int32), len(x))
        return pa.table({"dim": dim, "pass": number, "key": key.reshape(-1), "cid": cid})

    return work


def _window_links(window: int, cosine: float):
    """A spanning forest of the links inside the windows of one block."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        x, pos, cid = unit(group.column("e").combine_chunks()), group.column("pos").to_numpy(), group.column("cid").to_numpy()
        near = np.abs(pos[:, None] - pos) <= window
        a, b = np.nonzero(np.triu((x @ x.T >= cosine - _EPS) & near, 1))
        parent = np.arange(len(x))
        us, vs = [], []
        for i, j in zip(a.tolist(), b.tolist()):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            while parent[j] != j:
                parent[j] = j = parent[parent[j]]
            if i != j:
                parent[max(i, j)] = min(i, j)
                us.append(int(cid[i]))
                vs.append(int(cid[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return work


def _counted(cosine: float):
    """Of each vector, the rows linked to it on the other side of a pair of blocks of one component."""

    def work(group: pa.Table) -> pa.Table:
        x, cid, root = unit(group.column("e").combine_chunks()), group.column("cid").to_numpy(), group.column("root").to_numpy()
        copies, own = group.column("copies").to_numpy(), group.column("own").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = (x[left] @ x[right].T >= cosine - _EPS) & (root[left][:, None] == root[right]) & (cid[left][:, None] != cid[right])
        ids, n = [cid[left]], [links @ copies[right]]
        if i != j:
            ids.append(cid[right])
            n.append(links.T @ copies[left])
        return pa.table({"cid": np.concatenate(ids), "n": np.concatenate(n)})

    return work


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors with different
    numbers of components never link.  Equal vectors link with each other; they go through the passes as
    one.  ``component_id`` is the smallest id reachable by links (null ids count as largest); ``kept`` says that it is the own
    one.  Repeated rows are vectors of their own.  An empty table gives an empty result.
    """
    e = F.col("embedding")
    sound = (
        e.isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), e).alias("e"))
    classes = materialize(
        rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    keys = (
        classes.select("cid", "e", F.size("e").alias("_d"), F.shiftright("cid", 11).alias("_c"))
        .groupBy("_d", "_c")
        .applyInArrow(_keys(passes), "dim int, pass int, key long, cid long")
    )
    order = ["dim", "pass", "key", "cid"]
    placed = running_sums(keys.withColumn("_one", F.lit(1)), order, "_one", by=("dim", "pass"), out="pos")
    at = F.floor((F.col("pos") - 1) / block)
    also = F.when((F.col("pos") - 1 - at * block < window) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    blocks = placed.select("dim", "pass", "cid", "pos", F.explode(also).alias("block")).join(classes.select("cid", "e"), "cid")
    links = materialize(
        blocks.groupBy("dim", "pass", "block").applyInArrow(_window_links(window, cosine), "u long, v long").distinct()
    )
    roots = materialize(components(links))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("_c"))
    members = materialize(roots.join(sizes, "root").select(F.col("node").alias("cid"), "root", "_c"))
    # small components share a task, large ones are cut into blocks that meet in pairs
    small = F.col("_c") * 4 <= block
    shared = max(1, -(-members.where(small).count() // block))
    k = F.when(small, 1).otherwise(F.ceil(F.col("_c") / block)).cast("int")
    own = F.pmod(F.xxhash64("cid"), k).cast("int")
    meet = (
        members.join(classes.select("cid", "e", "copies"), "cid")
        .withColumn("group", F.when(small, -1 - F.pmod(F.xxhash64("root"), F.lit(shared))).otherwise(F.col("root")))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .select("group", "i", "j", "own", "cid", "root", "copies", "e")
        .withColumn("dim", F.size("e"))
    )
    counts = meet.groupBy("group", "dim", "i", "j").applyInArrow(_counted(cosine), "cid long, n long")
    counts = counts.groupBy("cid").agg(F.sum("n").alias("n"))
    head = members.join(classes.select("cid", "rep"), "cid").groupBy("root").agg(F.min("rep").alias("head"))
    linked = members.select("cid", "root").join(head, "root").join(counts, "cid").select("cid", "head", "n")
    known = classes.join(linked, "cid", "left").select(
        "e", F.coalesce("head", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(known, "e", "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding, embedding) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""
