import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import knn


def _rows(spark, n, copies=0):
    data = np.random.default_rng(6).normal(0, 1, (n, 40)).round(2)
    data[n - copies :] = data[0]
    rows = [(i, [float(x) for x in v], [float(v[0]), float(v[1])]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, place array<double>")
    return data, df.repartition(6)


@pytest.mark.parametrize("apart,within", [(None, None), (1.0, None), (None, 1.5)])
def test_wide_vectors_are_exact(spark, monkeypatch, apart, within):
    monkeypatch.setattr(knn, "GROUP_ROWS", 100)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 90)
    data, df = _rows(spark, 300, copies=30)
    dist = knn._distances(data, data)
    gap = knn._distances(data[:, :2], data[:, :2])
    counts = ~np.eye(300, dtype=bool)
    if apart is not None:
        counts &= gap > apart
    if within is not None:
        counts &= gap <= within
    got = {}
    for r in knn.knn_join(df, df, 7, exclude_self=True, apart=apart, within=within).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["neighbor_id"])
    for i in range(300):
        best = sorted((dist[i, j], j) for j in np.flatnonzero(counts[i]))[:7]
        assert [got.get(i, {})[n + 1] for n in range(len(best))] == best


def test_wide_vectors_are_not_repeated_per_block(spark, monkeypatch):
    """A table goes to its tasks once per group or shard, and no pair of a chunk and a block is shuffled."""
    _, df = _rows(spark, 300)
    plan = knn.knn_join(df.select("id", "vector"), df.select("id", "vector"), 3, exclude_self=True)._jdf.queryExecution().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("exclude", [False, True])
def test_feature_vectors_are_streamed_and_exact(spark, monkeypatch, exclude):
    """Vectors of some ten components with text ids and many equal rows: no pair of a chunk and a block, every tie by id."""
    monkeypatch.setattr(knn, "GROUP_ROWS", 100)
    data = np.random.default_rng(8).normal(0, 1, (260, 9)).round(1)
    data[200:] = data[3]
    names = [f"s{i % 7}:{i}" for i in range(260)]
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, data)], "id string, vector array<double>").repartition(5)
    found = knn.knn_join(df, df, 5, exclude_self=exclude, block=60)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["neighbor_id"])
    dist = knn._distances(data, data)
    for i, name in enumerate(names):
        best = sorted((dist[i, j], names[j]) for j in range(260) if not (exclude and i == j))[:5]
        assert [got[name][n + 1] for n in range(5)] == best
