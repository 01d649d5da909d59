"""Merkle fixity audit of WARC replicas, in DataFrame functions.

Every record of an archive file has an offset, a length and a digest.  Records are hashed into ranges of offsets, ranges into
ranges of sixteen, up to one root per file.  Two replicas compare roots, then only the ranges below nodes
that differ, and at last the records of the ranges that differ.  A damaged record changes the hashes on its
own path only, so sound files and sound branches are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import running_sums
from trackloom.session import materialize

FANOUT = 16
#: Bytes of a leaf range, and of an archive file (the last record may go beyond).
LEAF_BYTES = 1 << 16
FILE_BYTES = LEAF_BYTES * FANOUT**2 * 4


def record(url: Column, body: Column) -> Column:
    """A WARC response record as text; null parts are empty."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, file_bytes: int = FILE_BYTES, **more: Column) -> DataFrame:
    """``file``, ``offset``, ``length``, ``digest`` and ``page_id`` of the records of ``pages`` (page_id, url, html).

    Records follow each other in order of page id (null last), then digest, and fill files of ``file_bytes``.
    Repeated rows are records of their own.  Only digests and lengths are moved, never bodies.  ``more`` columns are kept.
    """
    whole = record(F.col("url"), F.col("html"))
    rows = pages.select(
        "page_id", F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("length"),
        *[c.alias(n) for n, c in more.items()],
    )
    placed = running_sums(rows, ["page_id", "digest"], "length", out="_end").withColumn("_at", F.col("_end") - F.col("length"))
    placed = materialize(placed.withColumn("file", F.floor(F.col("_at") / F.lit(file_bytes))))
    first = placed.groupBy("file").agg(F.min("_at").alias("_first"))
    return placed.join(first, "file").select("file", (F.col("_at") - F.col("_first")).alias("offset"), "length", "digest", "page_id", *more)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (path), ``offset``, ``length``, ``digest`` and ``uri`` of the records of uncompressed WARC files.

    A task holds one file.  Bytes that are no record end the file's list; a cut record is listed with what is left of it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: list[tuple] = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data, at = content.as_buffer().to_pybytes() if content.is_valid else b"", 0
                while data.startswith(b"WARC/", at):
                    end = data.find(b"\r\n\r\n", at)
                    head = data[at : end if end >= 0 else len(data)].split(b"\r\n")
                    named = {k.strip().lower(): v.strip() for k, _, v in (h.partition(b":") for h in head[1:])}
                    size = int(named.get(b"content-length", b"0")) if named.get(b"content-length", b"0").isdigit() else 0
                    stop = min(len(data), end + 4 + size + 4) if end >= 0 else len(data)
                    uri = named.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                    out.append((name, at, stop - at, hashlib.sha256(data[at:stop]).hexdigest(), uri))
                    at = stop
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "offset", "length", "digest", "uri"])

    return files.mapInArrow(parse, "file string, offset long, length long, digest string, uri string")


def _folded(rows: DataFrame, parent: Column, item: Column) -> DataFrame:
    """Hash of the ordered items of each parent node; a node has few: a leaf's records or sixteen children."""
    return (
        rows.groupBy("file", parent.alias("node"))
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select("file", "node", F.sha2(F.to_json("_items"), 256).alias("hash"))
    )


def tree(of: DataFrame, levels: int, leaf_bytes: int = LEAF_BYTES) -> list[DataFrame]:
    """Levels of the tree from the leaf ranges to the roots: ``file``, ``node`` (number of the range) and ``hash``."""
    leaf = F.floor(F.col("offset") / F.lit(leaf_bytes))
    out = [materialize(_folded(of, leaf, F.struct("offset", "length", "digest")))]
    for _ in range(levels):
        out.append(materialize(_folded(out[-1], F.floor(F.col("node") / F.lit(FANOUT)), F.struct("node", "hash"))))
    return out


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Records in which two manifests differ: ``file``, ``offset``, ``status`` and both lengths and digests.

    ``changed``: other bytes or length; ``missing``: not in ``right``; ``extra``: not in ``left``.  Both need ``file``,
    ``offset``, ``length`` and ``digest`` without nulls; of several records at one offset each is compared with each of its rank.
    The height of the trees follows the largest offset.  An empty manifest makes all records of the other one missing or extra.
    """
    keep = ["file", "offset", "length", "digest"]
    left, right = left.select(*keep), right.select(*keep)
    top = max((d.agg(F.max("offset")).first()[0] or 0) for d in (left, right)) // leaf_bytes
    levels = 0
    while top:
        top //= FANOUT
        levels += 1
    trees = [tree(left, levels, leaf_bytes), tree(right, levels, leaf_bytes)]
    open_ = None
    for k in range(levels, -1, -1):
        nodes = [t[k] for t in trees]
        if open_ is not None:
            nodes = [n.withColumn("_up", F.floor(F.col("node") / F.lit(FANOUT))).join(open_, ["file", "_up"], "left_semi").drop("_up") for n in nodes]
        met = nodes[0].withColumnRenamed("hash", "a").join(nodes[1].withColumnRenamed("hash", "b"), ["file", "node"], "full")
        open_ = materialize(met.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", F.col("node").alias("_up")))
    sides = []
    for side, d in (("left", left), ("right", right)):
        own = d.withColumn("_up", F.floor(F.col("offset") / F.lit(leaf_bytes))).join(open_, ["file", "_up"], "left_semi").drop("_up")
        rank = own.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("length", "digest"))).alias("_all"))
        sides.append(
            rank.select("file", "offset", F.posexplode("_all").alias("_rank", "_r")).select(
                "file", "offset", "_rank", F.col("_r.length").alias(f"{side}_length"), F.col("_r.digest").alias(f"{side}_digest")
            )
        )
    met = sides[0].join(sides[1], ["file", "offset", "_rank"], "full")
    status = (
        F.when(F.col("right_digest").isNull(), "missing")
        .when(F.col("left_digest").isNull(), "extra")
        .when((F.col("left_digest") != F.col("right_digest")) | (F.col("left_length") != F.col("right_length")), "changed")
    )
    return met.withColumn("status", status).where("status is not null").drop("_rank")


def damage(every: int = 200) -> tuple[Column, Column]:
    """Body of a page in a damaged replica, and whether its record is gone; faults follow from the page id.

    Of about one in ``every`` pages the last character is replaced, of as many the second half of the body is lost,
    and as many are gone.  Pages without an id are sound.
    """
    digest = F.substring(F.md5(F.col("page_id").cast("string")), 1, 8)
    dice = F.coalesce(F.conv(digest, 16, 10).cast("long") % every, F.lit(-1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    n = F.length(html)
    body = F.when(dice == 0, F.concat(F.substring(html, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit("#")))
    body = body.when(dice == 1, F.substring(html, F.lit(1), F.floor(n / 2).cast("int"))).otherwise(html)
    return body, dice == 2


def audited(pages: DataFrame, file_bytes: int = FILE_BYTES, leaf_bytes: int = LEAF_BYTES, every: int = 200) -> DataFrame:
    """Every record of the archive of ``pages`` with its place and what the audit of a damaged replica says of it (``ok`` or a status).

    The replica keeps every record at its place.  Rows may repeat, and any column may be null; an empty table gives an empty result.
    """
    body, gone = damage(every)
    other = record(F.col("url"), body)
    own = materialize(
        manifest(pages, file_bytes, r_length=F.octet_length(other).cast("long"), r_digest=F.sha2(other, 256), r_gone=gone)
    )
    replica = own.where("not r_gone").select("file", "offset", F.col("r_length").alias("length"), F.col("r_digest").alias("digest"))
    found = audit(own, replica, leaf_bytes).select("file", "offset", "status")
    return own.join(found, ["file", "offset"], "left").select(
        "page_id", "file", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status")
    )


def oracle(file_bytes: int = FILE_BYTES, every: int = 200) -> str:
    """The query in DuckDB's SQL for tables whose ids are unique, with damage found by comparing all records."""
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, chr(13) || chr(10) AS e,
    ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % {every} AS dice FROM pages),
r AS (SELECT page_id, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || u || e || 'Content-Type: text/html' || e
    || 'Content-Length: ' || strlen(h) || e || e || h || e || e AS a,
    CASE dice WHEN 0 THEN substr(h, -1) <> '#' WHEN 1 THEN h <> '' ELSE false END AS bad, dice = 2 AS gone FROM p),
d AS (SELECT page_id, sha256(a) AS digest, strlen(a)::BIGINT AS length, bad, gone FROM r),
s AS (SELECT *, (sum(length) OVER (ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS pos FROM d),
f AS (SELECT *, (pos // {file_bytes})::BIGINT AS file FROM s)
SELECT page_id, file, (pos - min(pos) OVER (PARTITION BY file))::BIGINT AS "offset", length, digest,
    CASE WHEN gone THEN 'missing' WHEN bad THEN 'changed' ELSE 'ok' END AS status FROM f"""
