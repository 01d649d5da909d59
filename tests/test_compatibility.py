"""Second-order compatibility against dense matrices."""

import numpy as np
import pytest

from trackloom.operators import cloud, compatibility


def dense(rows, tau, turns):
    """Weights of one pair with whole matrices."""
    source, target = np.array([r[2:5] for r in rows]), np.array([r[5:8] for r in rows])

    def lengths(p):
        return np.linalg.norm(p[:, None] - p[None], axis=-1)

    first = np.clip(1 - ((lengths(source) - lengths(target)) / tau) ** 2, 0, 1)
    np.fill_diagonal(first, 0)
    second = first @ first * first
    v = np.full(len(rows), 1 / len(rows))
    for _ in range(turns):
        v = second @ v
        norm = np.linalg.norm(v)
        if norm <= 1e-12:
            break
        v = v / norm
    return second.sum(1), v if v.max() > 0 else 1 / (np.array([r[8] for r in rows]) + 1e-6)


def made(pair, n, wrong, seed):
    r = np.random.default_rng(seed)
    source = r.normal(size=(n, 3))
    target = source[:, [1, 0, 2]] * [1, -1, 1] + [0.5, 0, 1] + r.normal(size=(n, 3)) * 0.01
    bad = r.random(n) < wrong
    target[bad] += r.normal(size=(bad.sum(), 3))
    return [(pair, k, *map(float, source[k]), *map(float, target[k]), float(r.random())) for k in range(n)]


@pytest.mark.parametrize("block", [7, 512])
def test_weights_equal_dense_matrices(spark, block):
    """Pairs of many blocks and of one; a pair in which nothing fits falls back to its distances; a single correspondence."""
    pairs = {1: made(1, 45, 0.4, 1), 2: made(2, 9, 0.0, 2), 3: [(3, k, float(k * k), 0.0, 0.0, float(k * k) * (k + 2), 0.0, 0.0, 0.1 * k) for k in range(5)], 4: made(4, 1, 0.0, 4)}
    df = spark.createDataFrame([r for rows in pairs.values() for r in rows], "pair_id long, pt long, x double, y double, z double, tx double, ty double, tz double, distance double")
    got = {(r.pair_id, r.pt): (r.support, r.weight) for r in compatibility.compatibility_weights(df, 0.1, 4, block).collect()}
    assert len(got) == sum(map(len, pairs.values()))
    for pair, rows in pairs.items():
        support, weight = dense(rows, 0.1, 4)
        for k in range(len(rows)):
            assert got[pair, k] == pytest.approx((support[k], weight[k]), rel=1e-9, abs=1e-12)


def test_no_pair_list_is_written(spark):
    """Weights of a block pair are a few rows, zero weights none."""
    df = spark.createDataFrame([r[:8] for r in made(1, 60, 0.5, 3)], "pair_id long, pt long, x double, y double, z double, tx double, ty double, tz double")
    blocks = compatibility._blocks(df, 20)
    n = blocks.count()
    squares = compatibility.second_order(blocks, 0.1).collect()
    assert n == 3 and len(squares) <= n * (n + 1) // 2
    assert all(len(s.r) == len(s.c) == len(s.w) > 0 and min(s.w) > 0 for s in squares)


def test_empty_table(spark):
    df = spark.createDataFrame([], "pair_id long, pt long, x double, y double, z double, tx double, ty double, tz double")
    assert compatibility.compatibility_weights(df, 0.1).count() == 0
    with pytest.raises(ValueError):
        compatibility.compatibility_weights(df, 0.0)


@pytest.mark.parametrize("block", [37, 8192])
def test_degrees_count_each_meeting_once(spark, block):
    """Blocks meet once, in tasks that work on arrays; missing coordinates fit nothing."""
    rows = [r[:8] for n, pair in ((300, 1), (5, 2), (1, 3)) for r in made(pair, n, 0.5, pair)]
    rows[7] = (*rows[7][:2], None, *rows[7][3:])
    df = spark.createDataFrame(rows, "pair_id long, pt long, x double, y double, z double, tx double, ty double, tz double")
    found = cloud.compatibility(df, 0.1, block)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.pair_id, r.pt): r.degree for r in found.collect()}
    at = np.array([r[2:] for r in rows], dtype=float)
    pair = np.array([r[0] for r in rows])
    length = lambda p: np.linalg.norm(p[:, None] - p[None], axis=-1)
    fits = (np.abs(length(at[:, :3]) - length(at[:, 3:])) <= 0.1) & (pair[:, None] == pair[None]) & ~np.eye(len(rows), dtype=bool)
    assert got == {r[:2]: n for r, n in zip(rows, fits.sum(1).tolist())}
