"""Nearest points by voxel rings against every distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import cloud, nearest

SCHEMA = "pair_id long, pt long, x double, y double, z double"


def frame(spark, clouds):
    rows = [(p, k, *map(float, c)) for p, points in clouds.items() for k, c in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(source, target):
    out = {}
    for pair, points in source.items():
        for k, c in enumerate(points):
            d2 = ((np.asarray(target[pair]) - c) ** 2).sum(1)
            out[pair, k] = (d2.min(), int(np.flatnonzero(d2 == d2.min())[0]))
    return out


def test_rings_equal_every_distance(spark):
    """Even, clustered, flat and repeated clouds; sources inside, outside and far away."""
    r = np.random.default_rng(0)
    even = r.random((900, 3))
    clusters = np.concatenate([r.normal(c, 0.01, (300, 3)) for c in ((0, 0, 0), (5, 5, 5), (5.1, 5, 5))])
    flat = np.c_[r.random((500, 2)), np.zeros(500)]
    same = np.repeat(r.random((3, 3)), 200, axis=0)
    target = {1: even, 2: clusters, 3: flat, 4: same, 5: r.random((20, 3))}
    source = {p: np.concatenate([t[::7] + r.normal(0, 0.02, t[::7].shape), r.normal(0, 4, (15, 3)), [[90.0, -70, 3]]]) for p, t in target.items()}
    found = cloud.nearest_points(frame(spark, source), frame(spark, target), few=100)
    got = {(x.pair_id, x.pt): (x.near.d2, x.near.pt) for x in found.collect()}
    want = brute(source, target)
    assert set(got) == set(want)
    for k, (d2, pt) in want.items():
        assert got[k][0] == pytest.approx(d2, abs=1e-15) and (got[k][1] == pt or d2 == pytest.approx(got[k][0], abs=1e-15))
    assert all(got[4, k][1] % 200 == 0 for k in range(80))  # ties: the least point


def test_both_paths_agree(spark):
    r = np.random.default_rng(1)
    source, target = {1: r.random((300, 3))}, {1: r.random((400, 3))}
    a = cloud.nearest_points(frame(spark, source), frame(spark, target), few=10)
    b = cloud.nearest_points(frame(spark, source), frame(spark, target))
    assert sorted((x.pt, x.near.d2, x.near.pt) for x in a.collect()) == sorted((x.pt, x.near.d2, x.near.pt) for x in b.collect())


def test_compared_pairs_grow_with_the_points(spark):
    """A cloud of 100,000 points compares a few hundred points each, not 100,000, and the first ring settles nearly all."""
    n = 100_000
    def uniform(salt):
        return [(F.pmod(F.xxhash64("id", F.lit(f"{salt}{a}")), F.lit(1 << 30)) / float(1 << 30)).alias(a) for a in "xyz"]

    target = spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").alias("pt"), *uniform("t"))
    source = spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").alias("pt"), *uniform("s"))
    axes = ["x", "y", "z"]
    grids = nearest._grids(target, axes)
    cells = nearest._packed(nearest._celled(target, grids, axes), axes, "_t")
    met = nearest.met_cells(nearest._celled(source, grids, axes), cells, -1, 1, axes)
    compared = met.agg(F.sum(F.size("_s").cast("long") * F.size("_t"))).first()[0]
    assert compared < 500 * n
    done, left = nearest.in_rings(source, target, axes, rings=(1,))
    assert done.count() + left.count() == n and left.count() < n / 50


def test_leaves_in_one_shuffle(spark, monkeypatch):
    """Clouds of a few thousand points take one plan of one shuffle, not a join per ring; several blocks and rings find the same."""
    r = np.random.default_rng(2)
    target = {1: r.random((5000, 3)), 2: np.repeat(r.random((700, 3)), 5, axis=0), 3: r.random((30, 3))}
    source = {p: np.concatenate([r.random((600, 3)), r.normal(0, 9, (9, 3))]) for p in target}
    a, b = frame(spark, source), frame(spark, target)
    found = cloud.nearest_points(a.where("pair_id < 3"), b.where("pair_id < 3"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("MapInArrow") == 1
    want = brute(source, target)
    rows = lambda df: {(x.pair_id, x.pt): (x.near.d2, x.near.pt) for x in df.collect()}
    got = rows(found)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items() if k[0] < 3}
    assert all(d2 == pytest.approx(want[k][0], rel=1e-12) for k, (d2, _) in got.items())
    assert rows(nearest.by_leaves(a, b, list("xyz"), block=512, part=100)) == rows(nearest.by_leaves(a, b, list("xyz")))
    monkeypatch.setattr(nearest, "MANY", 4000)
    assert rows(cloud.nearest_points(a, b, few=100)) == rows(nearest.by_leaves(a, b, list("xyz")))


def test_points_without_numbers(spark):
    nan, inf = float("nan"), float("inf")
    target = spark.createDataFrame([(1, k, float(k), 0.0, 0.0) for k in range(40)] + [(1, 40, nan, 0.0, 0.0), (1, 41, None, 0.0, 0.0), (1, 42, inf, 0.0, 0.0)], SCHEMA)
    source = spark.createDataFrame([(1, 0, 3.2, 0.0, 0.0), (1, 1, nan, 0.0, 0.0), (1, 2, None, 0.0, 0.0), (1, 3, -inf, 0.0, 0.0)], SCHEMA)
    for few in (10, 100):
        got = {x.pt: (x.near.d2, x.near.pt) for x in cloud.nearest_points(source, target, few=few).collect()}
        assert got[0] == (pytest.approx(0.04), 3) and np.isnan(got[1][0]) and got[2][0] is None and got[3] == (inf, 0)
