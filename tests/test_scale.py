"""The skew-safe building blocks against plain Python, with every hot path forced."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import scale


def rows(n_keys=3, n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n_keys):
        frames = sorted(rng.sample(range(200), n if k == 0 else n // 3))
        out += [(f"k{k}", f, round(rng.uniform(-5, 5), 1)) for f in frames]
    rng.shuffle(out)
    return out


def test_with_previous_over_chunks(spark):
    data = rows()
    df = spark.createDataFrame(data, "key string, frame int, v double").repartition(3)
    got = scale.with_previous(df, ["key"], "frame", ["v"], depth=3, chunk=7, single=False).collect()
    plain = scale.with_previous(df, ["key"], "frame", ["v"], depth=3, single=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain), key=str)
    by_key = {}
    for k, f, v in sorted(data):
        by_key.setdefault(k, []).append((f, v))
    found = {(r["key"], r["frame"]): r for r in got}
    for k, items in by_key.items():
        for i, (f, _) in enumerate(items):
            for n in (1, 2, 3):
                want = items[i - n] if i >= n else (None, None)
                r = found[(k, f)]
                assert (r[f"prev{n}_frame"], r[f"prev{n}_v"]) == want


def test_running_over_chunks(spark):
    data = [(k, f, v if f % 3 else None) for k, f, v in rows()]
    df = spark.createDataFrame(data, "key string, frame int, v double")
    wanted = {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}
    a = scale.running(df, ["key"], "frame", wanted, chunk=9).collect()
    b = scale.running(df, ["key"], "frame", wanted, single=True).collect()

    def clean(rs):
        return sorted((r["key"], r["frame"], round(r["s"], 6), r["m"], r["l"]) for r in rs if r["m"] is not None)

    assert clean(a) == clean(b)


def test_dense_position(spark):
    data = rows() + rows()
    df = spark.createDataFrame(data, "key string, frame int, v double")
    got = {(r["key"], r["frame"]): r["position"] for r in scale.dense_position(df, ["key"], "frame", chunk=11).collect()}
    for k in {d[0] for d in data}:
        for i, f in enumerate(sorted({d[1] for d in data if d[0] == k})):
            assert got[(k, f)] == i


def test_percentiles_hot_equals_cold_equals_numpy(spark):
    data = rows(n=90)
    df = spark.createDataFrame(data, "key string, frame int, v double")
    wanted = {"p50": ("v", 0.5), "p95": ("v", 0.95), "mid": ("v", lambda n: F.floor(n / 2))}
    cold = {r["key"]: r for r in scale.percentiles(df, ["key"], wanted).collect()}
    hot = {r["key"]: r for r in scale.percentiles(df, ["key"], wanted, cold_rows=None).collect()}
    mixed = {r["key"]: r for r in scale.percentiles(df, ["key"], wanted, cold_rows=40).collect()}
    for k in {d[0] for d in data}:
        values = sorted(d[2] for d in data if d[0] == k)
        for table in (cold, hot, mixed):
            assert abs(table[k]["p50"] - statistics.median(values)) < 1e-9
            assert abs(table[k]["p95"] - np.percentile(values, 95)) < 1e-9
            assert table[k]["mid"] == values[len(values) // 2]


def test_row_positions_with_one_tied_value(spark):
    data = [("a", f"id{i:03d}", 1.0) for i in range(50)] + [("a", "z", 0.5), ("b", "q", 2.0)]
    df = spark.createDataFrame(data, "key string, id string, v double")
    got = scale.row_positions(df, ["key"], [("v", True), ("id", True)], partitions=4).collect()
    for k in ("a", "b"):
        want = [d[1] for d in sorted((d for d in data if d[0] == k), key=lambda d: (d[2], d[1]))]
        mine = sorted((r["position"], r["id"]) for r in got if r["key"] == k)
        assert [i for _, i in mine] == want
        assert [p for p, _ in mine] == list(range(len(want)))
        assert {r["position_count"] for r in got if r["key"] == k} == {len(want)}


def test_running_totals(spark):
    data = [("m", float(v), v + 1) for v in range(-20, 20)] + [("n", 0.25, 4)]
    df = spark.createDataFrame(data, "key string, v double, w long")
    got = {(r["key"], r["v"]): r["t"] for r in scale.running_totals(df, ["key"], "v", {"t": "w"}).collect()}
    for k, v, _ in data:
        assert got[(k, v)] == sum(w for kk, vv, w in data if kk == k and vv >= v)
