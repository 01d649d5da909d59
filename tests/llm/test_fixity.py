import hashlib

import pytest
from pyspark.sql import functions as F

from trackloom.llm import fixity as X
from trackloom.llm.queries import ORACLES, QUERIES


def as_record(url, body):
    n = len((body or "").encode())
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {n}\r\n\r\n{body or ''}\r\n\r\n".encode()


def brute(rows, file_bytes, every):
    """Place and status of every record by comparing all records."""
    made = sorted(((i is None, i or 0, hashlib.sha256(as_record(u, h)).hexdigest(), i, u, h) for i, u, h in rows), key=lambda r: r[:3])
    at, out, first = 0, [], {}
    for _, _, digest, i, u, h in made:
        size, file = len(as_record(u, h)), at // file_bytes
        first.setdefault(file, at)
        dice = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % every if i is not None else -1
        h = h or ""
        other = h[: max(len(h) - 1, 0)] + "#" if dice == 0 else h[: len(h) // 2] if dice == 1 else h
        status = "missing" if dice == 2 else "ok" if as_record(u, other) == as_record(u, h) else "changed"
        out.append((i, file, at - first[file], size, digest, status))
        at += size
    return sorted(out, key=str)


def test_odd_rows_equal_brute_force(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 50) + "x" * (i % 7)) for i in range(300)]
    rows += [(None, "u", "h"), (5000, None, None), (5001, "", ""), (7, "http://h/7", "again"), (7, "http://h/7", "again"), (6000, "u", "y" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    out = X.audited(pages, file_bytes=8192, leaf_bytes=512, every=9).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 8192, 9)


def test_query_equals_sql_and_brute_force(spark, sf):
    from compare import compare, duck

    found = QUERIES["op10_warc_fixity"](spark, sf)
    assert compare(found, duck(sf), ORACLES["op10_warc_fixity"]) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, X.audited(spark.read.parquet(f"{sf}/pages.parquet"), every=20).collect()), key=str) == brute(rows, X.FILE_BYTES, 20)


def test_audit_of_manifests(spark):
    schema = "file string, offset long, length long, digest string"
    a = [("f", i * 100, 100, f"d{i}") for i in range(2000)] + [("g", 0, 5, "x"), ("h", 0, 5, "x"), ("h", 0, 5, "y")]
    b = [r for r in a if r != ("f", 700, 100, "d7")] + [("f", 300_000, 9, "z")]
    b[3] = ("f", 300, 99, "d3")
    b[-2] = ("h", 0, 5, "w")
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    out = sorted((r.file, r.offset, r.status) for r in X.audit(left, right, 1000).collect())
    assert out == [("f", 300, "changed"), ("f", 700, "missing"), ("f", 300_000, "extra"), ("h", 0, "changed"), ("h", 0, "changed")]
    assert X.audit(left, left, 1000).count() == 0
    empty = spark.createDataFrame([], schema)
    assert X.audit(empty, empty).count() == 0
    assert {r.status for r in X.audit(left, empty).collect()} == {"missing"} and X.audit(empty, left).count() == len(a)


def test_read_manifest(spark, tmp_path):
    parts = [as_record("http://a", "one"), as_record("http://b", "zwei é"), as_record(None, "")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(b"".join(parts)[:-10] + b"")
    (tmp_path / "c.warc").write_bytes(b"junk")
    rows = X.read_manifest(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [(r.offset, r.length, r.uri) for r in rows[:3]] == [(0, len(parts[0]), "http://a"), (len(parts[0]), len(parts[1]), "http://b"), (len(parts[0] + parts[1]), len(parts[2]), "")]
    assert rows[1].digest == hashlib.sha256(parts[1]).hexdigest() and len(rows) == 6 and rows[5].length == len(parts[2]) - 10
    one, two = (X.read_manifest(spark, str(tmp_path / n)).withColumn("file", F.lit("f")) for n in ("a.warc", "b.warc"))
    assert [r.status for r in X.audit(one, two).collect()] == ["changed"]


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_small_tables(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert X.audited(pages).count() == len(rows)
