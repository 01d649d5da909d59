import numpy as np

from trackloom.llm import projection_pairs as V


def brute(rows, cosine=0.95):
    x = np.array([v if v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() else [0] * 8 for _, v in rows], float)
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    link = unit @ unit.T >= cosine - 1e-12
    np.fill_diagonal(link, False)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], int(link[i].sum()), low, rows[i][0] == low))
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, cid string, e int, root int"


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in V.near_vectors(frame, **more).collect()), key=str)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8) for _ in range(300)]
    for size, spread in ((150, 0.1), (40, 0.12), (2, 0.05), (2, 0.05)):
        base = rng.normal(size=8)
        vectors += [base + spread * rng.normal(size=8) for _ in range(size)]
    vectors += [vectors[0]] * 30 + [vectors[0] * 3]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    # small blocks and windows: groups longer than a window, components longer than a block
    assert run(spark, rows, window=16, block=48) == brute(rows)


def test_odd_rows(spark):
    one = [1.0] * 8
    rows = [
        (1, None), (2, []), (3, [0.0] * 8), (4, [None] + one[1:]), (5, [float("nan")] + one[1:]), (6, [float("inf")] + one[1:]),
        (7, one), (8, one), (8, one), (None, one), (9, [2.0] * 8), (10, [-1.0] * 8), (11, [-0.0] * 8), (None, None), (12, [1e38] * 8),
    ]
    found = run(spark, rows)
    assert found == brute(rows) or [r[:3] for r in found] == [r[:3] for r in brute(rows)]
    short = run(spark, [(1, one), (2, one[:4]), (3, one[:4]), (4, [1.0])])
    assert [(r[0], r[1]) for r in short] == [(1, 0), (2, 1), (3, 1), (4, 0)]
    assert run(spark, []) == []
