"""Running medians against sorting everything again for each row."""

import random
import statistics

import pytest

from trackloom.operators.medians import running_medians


def brute(rows):
    """Rows (key, order, value, other) with the medians of both before each row."""
    out, past = {}, {}
    for key, order, *values in sorted(rows, key=lambda r: (r[0], r[1])):
        for c, v in enumerate(values):
            seen = past.setdefault((key, c), [])
            out[key, order, c] = statistics.median(seen) if seen else None
            if v is not None:
                seen.append(v)
    return out


def found(df, **how):
    rows = running_medians(df, ["key"], "t", ["v", "w"], **how).collect()
    return {(r.key, r.t, c): r[n] for r in rows for c, n in enumerate(("v_before", "w_before"))}


def made(seed):
    """Trends, ties, nulls, gaps, one key with most rows."""
    r = random.Random(seed)
    rows = []
    for key, n in (("hot", 700), ("b", 40), ("c", 1)):
        t = 0
        for k in range(n):
            t += r.choice([1, 1, 2, 30])
            v = None if r.random() < 0.1 else r.choice([k / 3, -float(k), r.random(), 5.0])
            rows.append((key, t, v, float(r.randrange(4)) if k % 50 < 40 else None))
    rows += [("empty", t, None, None) for t in range(0, 100, 9)]
    return rows


@pytest.mark.parametrize("chunk", [1, 7, 64, 100_000])
def test_chunks_of_any_size(spark, chunk):
    rows = made(chunk)
    df = spark.createDataFrame(rows, "key string, t long, v double, w double")
    got = found(df, chunk=chunk)
    assert got == pytest.approx(brute(rows))


def test_other_columns_stay(spark):
    rows = [("n", t, float(t % 3), 1) for t in range(30)] + [("a", 5, 1.0, 2), ("a", 2, 3.0, 2)]
    df = spark.createDataFrame(rows, "key string, t long, v double, w long")
    out = running_medians(df, ["key"], "t", ["v"])
    assert out.columns == ["key", "t", "v", "w", "v_before"] and out.count() == len(rows)
    got = {(r.key, r.t): r.v_before for r in out.collect()}
    assert got["a", 5] == 3.0 and got["a", 2] is None and got["n", 29] == statistics.median(float(t % 3) for t in range(29))


def test_stretches_stay_small(spark):
    """A long key hands few values to a chunk, whatever came before it."""
    from pyspark.sql import functions as F

    from trackloom.operators import medians

    chunk = 128
    df = spark.range(128 * 60).select(F.lit("k").alias("key"), F.col("id").alias("t"), (F.hash("id") % 1000).cast("double").alias("v"))
    rows = df.withColumn("_chunk", F.floor(F.col("t") / chunk).cast("long"))
    sizes = medians._stretches(rows, ["key"], "t", "v", chunk).agg(F.max(F.size("_values")), F.count(F.lit(1))).first()
    assert sizes[1] == 59 and sizes[0] <= 4 * chunk
    assert running_medians(df, ["key"], "t", ["v"], chunk=chunk).where("t > 0 AND v_before IS NULL").isEmpty()


def test_empty_table(spark):
    assert running_medians(spark.createDataFrame([], "key string, t long, v double"), ["key"], "t", ["v"]).count() == 0
