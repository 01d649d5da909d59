import numpy as np
import pyarrow as pa
import pytest

from trackloom.operators import neighbours


def brute(at, ids, k, radius):
    dist = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    out = {}
    for i, name in enumerate(ids):
        others = sorted((dist[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[name] = ([n for _, n in others[:k]], sum(d <= radius for d, _ in others), sum(d for d, _ in others))
    return out


@pytest.mark.parametrize("kind", ["even", "grid", "one place", "far"])
@pytest.mark.parametrize("k", [1, 3])
def test_leaves_and_tiles_find_all(kind, k):
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 300, (1500, 2))
    if kind == "grid":
        at = np.round(at / 25) * 25
    elif kind == "one place":
        at[:1400] = 7.0
    elif kind == "far":
        at[::300] *= 1e6
    ids = [str(i) for i in rng.permutation(1500)]
    table = pa.table({"window_id": ["w"] * 1500, "track_id": ids, "cx": at[:, 0], "cy": at[:, 1]})
    got = neighbours._meet(table, table, ["window_id"], "track_id", ("cx", "cy"), k, 10.0, ()).to_pylist()
    expected = brute(at, ids, k, 10.0)
    for r in got:
        names, near, total = expected[r["track_id"]]
        assert [n["id"] for n in r["nearest"]] == names and r["num_near"] == near and r["num_others"] == 1499
        assert r["sum_distance"] == pytest.approx(total)


def test_nearest_looks_at_few_pairs(monkeypatch):
    """The work of the search grows with the objects of a frame, not with their pairs."""
    seen = []
    plain = neighbours._distances
    monkeypatch.setattr(neighbours, "_distances", lambda a, b: seen.append(a.shape[1] * b.shape[1]) or plain(a, b))
    pairs = {}
    for n in (4000, 16000):
        seen.clear()
        at = np.random.default_rng(1).uniform(0, 300, (2, n))
        neighbours._nearest(at, at, np.arange(n), 3)
        pairs[n] = sum(seen)
    assert pairs[16000] < 5 * pairs[4000]


def test_crowded_frames_and_missing_places(spark):
    rng = np.random.default_rng(2)
    rows = [("w", 1, str(i), float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (90, 2)))]
    rows += [("w", 2, "a", 1.0, 1.0), ("w", 2, "b", 4.0, 5.0), ("w", 2, "c", None, 1.0)]
    df = spark.createDataFrame(rows, "window_id string, frame_id int, track_id string, cx double, cy double")
    expected = brute(np.array([r[3:] for r in rows[:90]]), [r[2] for r in rows[:90]], 2, 10.0)
    for totals in (True, False):
        got = neighbours.neighbour_stats(df, k=2, block=20, totals=totals).collect()
        assert len(got) == 93 and ("num_near" in got[0]) == totals
        for r in got:
            if r["frame_id"] == 1:
                assert [n["id"] for n in r["nearest"]] == expected[r["track_id"]][0] and r["num_others"] == 89
                assert not totals or r["num_near"] == expected[r["track_id"]][1]
        a = next(r for r in got if r["track_id"] == "a")
        assert a["num_others"] == 2 and a["nearest"][0]["id"] == "b" and a["nearest"][0]["distance"] == 5.0


def test_normals_come_from_the_nearest_points(spark, monkeypatch):
    """No pair of points is written: the plan has no join of blocks."""
    from trackloom.operators import cloud

    at = np.random.default_rng(5).normal(0, 1, (400, 3))
    rows = [(p, i, *map(float, v)) for p in (0, 1) for i, v in enumerate(at * (p + 1))]
    df = spark.createDataFrame(rows, "pair_id int, pt long, x double, y double, z double")
    found = cloud.normals(df, 8)
    assert "Join" not in found._jdf.queryExecution().toString()
    for block in (65536, 150):
        got = {(r["pair_id"], r["pt"]): np.array(r["normal"]) for r in cloud.normals(df, 8, block).collect()}
        assert len(got) == 800
        for i in range(400):
            order = np.argsort(((at - at[i]) ** 2).sum(1), kind="stable")[1:9]
            thin = np.linalg.eigh(np.cov(at[order].T, bias=True))[1][:, 0]
            assert abs(got[0, i] @ thin) == pytest.approx(1) and abs(got[1, i] @ thin) == pytest.approx(1)
