"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles.

A shingle of weight w is a Poisson process of rate w: its points arrive after exponential steps, each point
goes to a register drawn from the same hash stream, and a register keeps the shingle that came first.  Two
documents agree in a register with the probability Jaccard similarity of their weights.  A document stops
drawing once the next arrival of every shingle is later than its fullest register (early termination).

Signatures are cut into bands; documents that share a band, or have equal sets of shingles, are candidates and are
verified on their whole texts by the Jaccard similarity of their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import (
    BROADCAST_ROWS,
    components,
    identified,
    overlaps,
    same_document,
    shuffle_partitions,
)
from trackloom.llm.words import U64, Words, chunks, combine, mix, runs, words_of
from trackloom.session import materialize

WIDTH = 5
SIMILARITY = 0.8
#: Weight of a shingle that occurs very often; one that occurs once weighs 1.  Links are verified on sets, so weights are
#: bounded: counts that differ between two texts lower the similarity that a register sees by a bounded part only.
HEAVIEST = 1.25
#: Of pairs of set similarity 0.8 twenty-four bands of five rows miss 7 in 100,000 where counts are equal, and about 3 in
#: 1,000 in the worst case, in which each text repeats many times what the other holds once.
BANDS, ROWS = 24, 5
#: Turns in which clusters that share a bucket meet one more leader, before they meet in full.
TURNS = 1
#: Documents of a bucket that meet in one task, and shingles held by both that are looked at together.
BLOCK = 1024
HITS = 1 << 20

_STEP = U64(0x9E3779B97F4A7C15)
_PLACES = [U64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)]


def shingles(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all runs of ``width`` words; a shorter text is one shingle of all its words."""
    h, row = words.hash, words.row
    n = len(h) - width + 1
    begin, length = runs(row, words.n_rows)
    short = np.flatnonzero((length > 0) & (length < width))
    if n > 0:
        inside = row[:n] == row[width - 1 :]
        at = np.flatnonzero(inside)
        total = np.zeros(len(at), U64)
        for j in range(width):
            total += (h[at + j] + U64(j)) * (_PLACES[j % 5] + U64(2 * (j // 5)))
        out_row, out = row[at], mix(total)
    else:
        out_row, out = np.zeros(0, np.int64), np.zeros(0, U64)
    if len(short):
        pick = np.repeat(begin[short], length[short]) + np.concatenate([np.arange(k) for k in length[short]])
        at = np.concatenate([[0], np.cumsum(length[short])[:-1]])
        out_row = np.concatenate([out_row, short])
        out = np.concatenate([out, combine(h[pick], at, length[short], 7)])
    return out_row, out


def weighted(row: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, member and count of the distinct members of each row, sorted by row and member."""
    order = np.lexsort((member, row))
    row, member = row[order], member[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (member[1:] != member[:-1])
    at = np.flatnonzero(new)
    return row[at], member[at], np.diff(np.append(at, len(row)))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    row, member, _ = weighted(*shingles(words_of(column)))
    return row, member


def registers(row: np.ndarray, member: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """ProbMinHash registers (n_rows x m): the member whose point came first; zero in rows without members."""
    first = np.full(n_rows * m, np.inf)
    winner = np.zeros(n_rows * m, U64)
    time, k, weight = np.zeros(len(row)), 0, weight.astype(np.float64)
    limit = np.full(n_rows, np.inf)
    while len(row):
        k += 1
        draw = mix(member + np.multiply(_STEP, np.array([k], U64)))
        time = time - np.log(((draw >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        live = time < limit[row]
        row, member, weight, time, draw = row[live], member[live], weight[live], time[live], draw[live]
        register = row * m + (mix(draw) % U64(m)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        winner[register[won]] = member[won]
        limit = first.reshape(n_rows, m).max(1)
        live = time < limit[row]
        row, member, weight, time = row[live], member[live], weight[live], time[live]
    return winner.reshape(n_rows, m)


def band_keys(row: np.ndarray, member: np.ndarray, count: np.ndarray, n_rows: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys (n_rows x bands + 1) of the bands of each row's signature, and last that of its set of members."""
    found = registers(row, member, HEAVIEST - (HEAVIEST - 1.0) / count, n_rows, bands * rows).reshape(-1, bands, rows)
    key = np.zeros((n_rows, bands + 1), U64)
    for j in range(rows):
        key[:, :bands] = mix(key[:, :bands] * _PLACES[j % 5] + found[:, :, j] + U64(j + 1))
    key[:, bands] = combine(member, *runs(row, n_rows), 3)
    return mix(key + np.arange(bands + 1, dtype=U64) * _STEP)


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``_id``, ``_th``, two hashes of the sequence of words, distinct shingles and band keys of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            words = words_of(batch.column("_text"))
            begin, length = runs(words.row, words.n_rows)
            row, member, count = weighted(*shingles(words, width))
            key = band_keys(row, member, count, words.n_rows, bands, rows)
            at = np.arange(0, words.n_rows * (bands + 1) + 1, bands + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_th"),
                    pa.array(combine(words.hash, begin, length, 1).view(np.int64)),
                    pa.array(combine(words.hash, begin, length, 2).view(np.int64)),
                    pa.array(np.bincount(row, minlength=words.n_rows).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(key.reshape(-1).view(np.int64))),
                ],
                names=["_id", "_th", "c1", "c2", "n", "bands"],
            )

    return identified(docs).mapInArrow(sign, "_id long, _th long, c1 long, c2 long, n long, bands array<long>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Class of every document among its near duplicates; ``docs`` has ``doc_id`` and ``text``.

    Returns one row per document: ``_id``, ``_th``, ``copy_of`` (smallest id of the texts with the same words),
    ``cluster_id`` (smallest id reachable over pairs of similarity >= ``similarity``), ``cluster_size``
    (documents) and ``kept`` (one document of each cluster; of rows equal in id and text all are kept).
    Null ids come last among ids.  Null texts and texts without words are alike to nothing: clusters of
    their own.  An empty table gives an empty result.

    Copies collapse into one class first.  In a bucket of a band every class meets two leaders only; where a
    bucket still holds members of different clusters, those meet another leader for some turns, and what is apart
    after that meets in full.  So a family of n near copies costs about n pairs, and no link between texts that
    share a band is lost.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    signed = materialize(signatures(docs))
    whole = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"))
    classes = materialize(
        signed.where("n > 0")
        .groupBy("c1", "c2")
        .agg(F.min(whole).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = materialize(
        buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    few = shared.count() <= BROADCAST_ROWS // 4
    members = materialize(buckets.join(F.broadcast(shared) if few else shared, "bucket"))
    nodes = materialize(members.select("node").distinct())
    wanted = materialize(
        classes.join(nodes, "node", "left_semi").select("node", F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"))
    )
    texts = materialize(
        same_document(identified(docs), wanted, "inner", wanted.count()).select("node", "_text").dropDuplicates(["node"])
    )

    def tried(pairs: DataFrame) -> DataFrame:
        found = overlaps(pairs, texts, shingle_sets, parts)
        return materialize(found.select("x", "y", (F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))).alias("s")))

    # Leaders of a bucket: the member of the fullest buckets, which stands in the middle of a family, and a random one.
    central = members.groupBy("node").agg(F.sum("_n").alias("_c"))
    ranked = materialize(members.join(central, "node").select("bucket", "node", "_c"))
    first = _led(ranked, F.struct(-F.col("_c"), "node")).unionByName(_led(ranked, F.struct(F.xxhash64("node", "bucket"), "node")))
    links = tried(materialize(first.select("x", "y").distinct()))
    roots = _roots(links, similarity)
    for turn in range(TURNS):
        open_ = materialize(_open(ranked, roots))
        more = _led(open_, F.struct(F.xxhash64("node", "bucket", F.lit(turn)), "node")).where(F.col("lx") != F.col("ly"))
        more = materialize(more.select("x", "y").distinct().join(links, ["x", "y"], "left_anti"))
        if more.isEmpty():
            break
        links = links.unionByName(tried(more))
        roots = _roots(links, similarity)
    # What shares a bucket and is still apart meets in full, inside tasks: only links become rows.
    open_ = materialize(_open(ranked, roots))
    if not open_.isEmpty():
        links = links.unionByName(materialize(_block_links(open_, texts, similarity)))
        roots = _roots(links, similarity)
    grouped = (
        classes.select("c1", "c2", "node", "rep", "copies")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    heads = grouped.groupBy("root").agg(F.min("rep").alias("head"), F.sum("copies").alias("cluster_size"))
    named = grouped.join(heads, "root").select("c1", "c2", "rep", "head", "cluster_size")
    own_key = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"))
    out = signed.select("_id", "_th", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "_id",
        "_th",
        F.when(alone, F.col("_id")).otherwise(F.col("rep.id")).alias("copy_of"),
        F.when(alone, F.col("_id")).otherwise(F.col("head.id")).alias("cluster_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("cluster_size")).alias("cluster_size"),
        (alone | (F.col("head") == own_key)).alias("kept"),
    )


def _led(members: DataFrame, rank: Column) -> DataFrame:
    """Each member of a bucket with the leader of smallest ``rank``; labels too if there are any."""
    label = [F.col("label").alias("l")] if "label" in members.columns else []
    best = members.groupBy("bucket").agg(F.min_by(F.struct("node", *label), rank).alias("_b"))
    met = members.join(best, "bucket").where(F.col("node") != F.col("_b.node"))
    pair = [F.col("node").alias("x"), F.col("_b.node").alias("y")]
    return met.select(*pair, *([F.col("label").alias("lx"), F.col("_b.l").alias("ly")] if label else []))


def _block_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links that join labels, among all pairs of a bucket with other labels; buckets are cut into blocks that meet in pairs."""
    counts = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    own = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    rows = (
        members.join(counts, "bucket")
        .join(texts, "node")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        .select("bucket", "_i", "_j", "_own", "node", "label", "_text")
    )

    def meet(group: pa.Table) -> pa.Table:
        row, member = shingle_sets(group.column("_text").combine_chunks())
        node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        own, i, j = group.column("_own").to_numpy(), group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
        at = np.searchsorted(row, np.arange(group.num_rows + 1))
        size = np.diff(at)
        order = np.argsort(member, kind="stable")
        value, holder = member[order], row[order]
        step = max(1, HITS // group.num_rows)
        joined: dict[int, int] = {}

        def root(a: int) -> int:
            while joined.setdefault(a, a) != a:
                joined[a] = joined[joined[a]]
                a = joined[a]
            return a

        xs, ys, s = [], [], []
        for x in np.flatnonzero(own == i):
            common = np.zeros(group.num_rows, np.int64)
            for k in range(at[x], at[x + 1], step):
                mine = member[k : min(k + step, at[x + 1])]
                lo, hi = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
                n = hi - lo
                hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common += np.bincount(holder[hit], minlength=group.num_rows)
            alike = common >= similarity * (size[x] + size - common) - 1e-12
            for y in np.flatnonzero(alike & (label != label[x]) & (own == j)):
                a, b = root(int(label[x])), root(int(label[y]))
                if a != b:
                    joined[a] = b
                    xs.append(int(node[x]))
                    ys.append(int(node[y]))
                    s.append(float(common[y] / (size[x] + size[y] - common[y])))
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64()), "s": pa.array(s, pa.float64())})

    return rows.groupBy("bucket", "_i", "_j").applyInArrow(meet, "x long, y long, s double")


def _roots(links: DataFrame, similarity: float) -> DataFrame:
    return components(links.where(F.col("s") >= similarity).select(F.col("x").alias("u"), F.col("y").alias("v")))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their label so far, of buckets that hold more than one label."""
    own = members.select("bucket", "node").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    own = own.select("bucket", "node", "label")
    split = own.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b")
    return own.join(split.select("bucket"), "bucket")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each cluster, all columns as they were; of rows equal in id and text one stays."""
    found = materialize(near_duplicates(docs, similarity).groupBy("_id", "_th").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("_n")))
    gone = materialize(found.where("not kept").select("_id", "_th"))
    twice = materialize(found.where("kept and _n > 1").select("_id", "_th"))
    whole = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
    )
    kept = same_document(whole, gone, "left_anti", gone.count())
    n = twice.count()
    if n:
        once = same_document(kept, twice, "left_semi", n).dropDuplicates(["_id", "_th"])
        kept = same_document(kept, twice, "left_anti", n).unionByName(once)
    return kept.select("_doc.*")
