"""Literal cases and brute-force comparisons on small fixtures."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import (
    cloud,
    ensembles,
    evaluate,
    events,
    groups,
    knn,
    neighbours,
    pairing,
    protocol,
    ranks,
    report,
    retrieval,
    segments,
    series,
    tokens,
    tracking,
    windows,
)

POINT = "sample_id string, sequence string, track_id string, frame_id int, category_name string, rgb_cx double, rgb_cy double, thermal_cx double, thermal_cy double, w double, h double"


def observation(rows):
    return [("s:" + t, "s", t, f, "c", *rgb, *th, 4.0, 4.0) for t, f, rgb, th in rows]


def test_fusion_confidence(spark):
    none = (None, None)
    df = spark.createDataFrame(
        observation([("1", 0, (10.0, 20.0), (14.0, 24.0)), ("1", 1, (10.0, 20.0), none), ("1", 2, none, none)]), POINT
    )
    got = {r["frame_id"]: r for r in pairing.fuse_points(df).collect()}
    assert (got[0]["cx"], got[0]["cy"], got[0]["num_modalities"]) == (12.0, 22.0, 2)
    assert got[0]["confidence"] > got[1]["confidence"] == 0.55
    assert (got[1]["cx"], got[1]["cy"]) == (10.0, 20.0)
    assert 2 not in got


def test_metrics_literals(spark):
    scores = spark.createDataFrame(
        [("m", "a", 0.9), ("m", "b", 0.8), ("m", "c", 0.7), ("m", "d", 0.1)], "method string, sample_id string, score double"
    )
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 0)], "sample_id string, label int")
    row = evaluate.evaluate(scores, labels, ["m"], k=2).first()
    assert row["auroc"] == pytest.approx(0.75)
    assert row["precision_at_k"] == 0.5 and row["recall_at_k"] == 0.5
    assert row["threshold"] == 0.7 and row["f1"] == pytest.approx(0.8)
    one_class = evaluate.curve_metrics(evaluate.align(scores, labels.withColumn("label", F.lit(1)), ["m"])).first()
    assert one_class["auroc"] is None


def test_alignment_duplicates_and_missing(spark):
    scores = spark.createDataFrame([("m", "a", 0.2), ("m", "a", 0.6), ("m", "x", 1.0)], "method string, sample_id string, score double")
    labels = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "sample_id string, label int")
    got = {r["sample_id"]: r for r in evaluate.align(scores, labels, ["m"]).collect()}
    assert got["a"]["label"] == 1 and got["a"]["score"] == 0.6
    assert got["b"]["score"] == float("-inf")
    report_row = evaluate.alignment_report(scores, labels).first().asDict()
    assert report_row == {
        "num_label_rows": 3,
        "num_score_rows": 3,
        "num_unique_label_keys": 2,
        "num_unique_score_keys": 2,
        "num_duplicate_label_keys": 1,
        "num_duplicate_score_keys": 1,
        "num_missing_score_keys": 1,
        "num_extra_score_keys": 1,
    }
    assert evaluate.require_strict_keys(evaluate.alignment_report(scores, labels)).count() == 1


def test_event_segments_literal(spark):
    rows = [("a", 1, 0.4, "join", 0.1), ("a", 2, 0.5, "leave", 0.2), ("a", 4, 0.72, "leave", 0.3), ("a", 5, 0.1, "x", 0.0), ("a", 8, 0.6, "stop", 0.4)]
    df = spark.createDataFrame(rows, "key string, frame_id int, score double, dominant_reason string, c double")
    got = segments.event_segments(df, ["key"], ["c"], threshold=0.3, max_gap=2).orderBy("frame_start").collect()
    assert [(r["frame_start"], r["frame_end"], r["score"], r["dominant_reason"], r["num_frames"], r["c"]) for r in got] == [
        (1, 4, 0.72, "leave", 3, 0.3),
        (8, 8, 0.6, "stop", 1, 0.4),
    ]


def greedy(pred, true, least):
    pairs = []
    for (pid, ps, pe), (tid, ts, te) in itertools.product(pred, true):
        inter = max(0, min(pe, te) - max(ps, ts) + 1)
        union = pe - ps + 1 + te - ts + 1 - inter
        if inter / union >= least:
            pairs.append((inter / union, pid, tid))
    used_p, used_t, out = set(), set(), set()
    for _, p, t in sorted(pairs, reverse=True):
        if p not in used_p and t not in used_t:
            used_p.add(p)
            used_t.add(t)
            out.add((p, t))
    return out


def test_event_matching_is_greedy(spark):
    rng = random.Random(5)
    make = lambda tag, n: [(f"{tag}{i:02d}", s, s + rng.randint(0, 120)) for i in range(n) for s in [rng.randint(0, 400)]]
    pred, true = make("p", 25), make("t", 15)
    schema = "event_id string, frame_start int, frame_end int"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumns({"sequence": F.lit("s"), "track_id": F.lit("1")})
    got = events.greedy_matches(events.overlap_candidates(frame(pred), frame(true), 0.1)).collect()
    assert {(r["pred_id"], r["true_id"]) for r in got} == greedy(pred, true, 0.1)
    row = events.event_f1(frame([("p1", 0, 9), ("p2", 100, 109), ("p3", 200, 209)]), frame([("t1", 0, 9), ("t2", 300, 309)])).first()
    assert (row["event_precision"], row["event_recall"], row["event_f1"]) == (pytest.approx(1 / 3), 0.5, pytest.approx(0.4))


def test_neighbour_blocks_agree(spark):
    rng = random.Random(3)
    rows = [("w", f, str(i), rng.randint(0, 30) * 1.0, rng.randint(0, 30) * 1.0) for f in (1, 2) for i in range(40 if f == 1 else 3)]
    df = spark.createDataFrame(rows, "window_id string, frame_id int, track_id string, cx double, cy double")
    for block in (512, 7):
        got = {(r["frame_id"], r["track_id"]): r for r in neighbours.neighbour_stats(df, k=3, block=block).collect()}
        for w, f, t, x, y in rows:
            others = sorted((math.dist((x, y), (a, b)), o) for ww, g, o, a, b in rows if g == f and o != t)
            r = got[(f, t)]
            assert r["num_others"] == len(others) and r["num_near"] == sum(d <= 10 for d, _ in others)
            assert r["sum_distance"] == pytest.approx(sum(d for d, _ in others))
            assert [n["id"] for n in r["nearest"]] == [o for _, o in others[:3]]


def test_knn_with_pivots_and_blocks_is_exact(spark):
    rng = np.random.default_rng(0)
    data = np.round(np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in (0.0, 5.0, 9.0)]), 1)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<double>")
    dist = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    for pivots, block in ((1, 2048), (1, 16), (12, 8)):
        got = {}
        for r in knn.knn_join(df, df, 4, exclude_self=True, block=block, chunk=20, pivots=pivots).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["neighbor_id"]
        for i in range(len(data)):
            order = sorted((round(dist[i, j], 12), j) for j in range(len(data)) if j != i)[:4]
            assert [dist[i, got[i][n]] for n in (1, 2, 3, 4)] == pytest.approx([d for d, _ in order])


def lof_brute(train, query, k):
    k = min(k, len(train) - 1)
    d = np.sqrt(((train[:, None] - train[None]) ** 2).sum(-1))
    near = [sorted((d[i, j], j) for j in range(len(train)) if j != i)[:k] for i in range(len(train))]
    kd = [n[-1][0] for n in near]
    lrd = [1 / (np.mean([max(x, kd[j]) for x, j in n]) + 1e-10) for n in near]
    out = []
    for q in query:
        n = sorted((float(np.linalg.norm(q - t)), j) for j, t in enumerate(train))[:k]
        own = 1 / (np.mean([max(x, kd[j]) for x, j in n]) + 1e-10)
        out.append(np.mean([lrd[j] for _, j in n]) / own)
    return out


def test_lof_brute_force(spark):
    rng = np.random.default_rng(1)
    train, query = rng.normal(0, 1, (40, 2)), np.concatenate([rng.normal(0, 1, (5, 2)), [[9.0, 9.0]]])
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vector array<double>")
    got = {r["query_id"]: r["score"] for r in knn.local_outlier_factors(frame(train), frame(query), 20).collect()}
    assert [got[i] for i in range(6)] == pytest.approx(lof_brute(train, query, 20))
    assert max(got, key=got.get) == 5
    scores = {r["id"]: r["score"] for r in ensembles.isolation_forest(frame(train), frame(query)).collect()}
    again = {r["id"]: r["score"] for r in ensembles.isolation_forest(frame(train), frame(query)).collect()}
    assert scores == again and max(scores, key=scores.get) == 5 and all(0 < s < 1 for s in scores.values())


def test_star_components_and_small_components_agree(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample([f"n{i:02d}" for i in range(60)], 2))) for _ in range(45)} | {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)}
    df = spark.createDataFrame([("w", 1, a, b) for a, b in edges], "window_id string, frame_id int, left string, right string")
    small = {r["track_id"]: r["component"] for r in tracking._small_components(df).collect()}
    stars = {r["track_id"]: r["component"] for r in tracking.star_components(df).collect()}
    assert small == stars
    assert {small[f"p{i:02d}"] for i in range(31)} == {"p00"}


@pytest.mark.parametrize("pivots", [1, 7])
def test_knn_outside_and_inside_a_radius(spark, pivots):
    """Cells are skipped by neighbours that count, so a bound never rests on a row inside the excluded radius."""
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 4, (6, 2))
    vectors = middle[rng.integers(0, 6, 160)] + rng.normal(0, 0.3, (160, 2))
    places = vectors[:, :1] * 2 + rng.normal(0, 1, (160, 1))
    rows = [(i, [float(x) for x in v], [float(x) for x in p]) for i, (v, p) in enumerate(zip(vectors, places))]
    df = spark.createDataFrame(rows, "id long, vector array<double>, place array<double>")
    for how in ({"apart": 3.0}, {"within": 2.0}):
        got = {}
        for r in knn.knn_join(df, df, 3, exclude_self=True, block=16, chunk=10, pivots=pivots, **how).collect():
            got.setdefault(r["query_id"], []).append(r["neighbor_id"])
        for i in range(160):
            gap = np.abs(places[:, 0] - places[i, 0])
            allowed = gap > 3.0 if "apart" in how else gap <= 2.0
            d = np.linalg.norm(vectors - vectors[i], axis=1)
            want = sorted((d[j], j) for j in range(160) if allowed[j] and j != i)[:3]
            assert sorted(got.get(i, [])) == sorted(j for _, j in want)


def test_group_split_keeps_id(spark):
    rows = [("w", 1, m, "a") for m in "abc"] + [("w", 2, "a", "a"), ("w", 2, "b", "a"), ("w", 2, "c", "c")]
    df = spark.createDataFrame(rows, "window_id string, frame_id int, track_id string, component string")
    got = {(r["frame_id"], r["component"]): (r["group_id"], r["split_merge"]) for r in tracking.track_groups(df).collect()}
    assert got == {(1, "a"): ("g1", False), (2, "a"): ("g1", True), (2, "c"): ("g2", True)}


def graph_brute(points, k, rho_p, rho_v, eta):
    """Frame loop over one window: points are (frame, track, x, y)."""
    frames = sorted({p[0] for p in points})
    med = lambda v: float(np.median(v))
    last, state = {}, {}
    for f, t, x, y in sorted(points):
        px, py = last.get(t, (x, y))
        state[(f, t)] = [x, y, x - px, y - py]
        last[t] = (x, y)
    for f in frames:
        here = [t for (g, t) in state if g == f]
        mx, my = med([state[(f, t)][2] for t in here]), med([state[(f, t)][3] for t in here])
        for t in here:
            s = state[(f, t)]
            state[(f, t)] = [s[0], s[1], s[2] - mx, s[3] - my]
    jac = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    counter, previous = 0, []
    dist_h, size_h, disp_h, last_n, best = {}, {}, {}, {}, {}
    for f in frames:
        here = sorted(t for (g, t) in state if g == f)
        links = {t: set() for t in here}
        for t in here:
            a = state[(f, t)]
            near = sorted((math.dist(a[:2], state[(f, o)][:2]), o) for o in here if o != t)[:k]
            for d, o in near:
                if d <= rho_p and math.dist(a[2:], state[(f, o)][2:]) <= rho_v:
                    links[t].add(o)
                    links[o].add(t)
        comps, seen = [], set()
        for t in here:
            if t in seen:
                continue
            stack, comp = [t], set()
            while stack:
                c = stack.pop()
                if c not in comp:
                    comp.add(c)
                    stack += links[c]
            seen |= comp
            comps.append(comp)
        found = [sorted((-jac(c, m), g) for g, m in previous if jac(c, m) >= 0.3) for c in comps]
        used, current, flagged, claims = set(), [], set(), {}
        for c, m in zip(comps, found):
            g = next((g for _, g in m if g not in used), None)
            if g is None:
                counter += 1
                g = f"g{counter}"
            else:
                used.add(g)
            current.append((g, c))
        for (g, _), m in zip(current, found):
            if len({x for _, x in m}) > 1:
                flagged |= {g} | {x for _, x in m}
            for _, x in m:
                claims.setdefault(x, []).append(g)
        for x, gs in claims.items():
            if len(set(gs)) > 1:
                flagged |= {x, *gs}
        previous = current
        for g, c in current:
            pts = [state[(f, t)] for t in sorted(c)]
            cx, cy = np.mean([p[0] for p in pts]), np.mean([p[1] for p in pts])
            disp = float(np.mean([math.dist(p[:2], (cx, cy)) for p in pts]))

            def change(cur, hist):
                if not hist:
                    return 0.0
                b = med(hist)
                return abs(cur - b) if b <= 0 else abs(cur / b - 1)

            event = max(change(len(c), size_h.get(g, [])), change(disp, disp_h.get(g, [])), 1.0 if g in flagged else 0.0)
            for t in sorted(c):
                s = state[(f, t)]
                d = math.dist(s[:2], (cx, cy))
                hist = dist_h.get(t, [])
                b = med(hist) if hist else None
                leave = 0.0 if b is None else max(0.0, d) if b <= 0 else max(0.0, d / b - 1)
                others = [state[(f, o)] for o in c if o != t]
                motion = 0.0
                if others:
                    mx, my = np.mean([o[2] for o in others]), np.mean([o[3] for o in others])
                    own, mean = math.hypot(*s[2:]), math.hypot(mx, my)
                    if own > 0:
                        motion = 1.0 if mean <= 1e-9 else 1 - max(-1, min(1, (s[2] * mx + s[3] * my) / (own * mean)))
                neighbour = 0.0 if t not in last_n else 1 - jac(links[t], last_n[t])
                score = max(leave, motion, neighbour, eta * event)
                best[t] = max(best.get(t, 0.0), score)
                dist_h.setdefault(t, []).append(d)
                last_n[t] = links[t]
            size_h.setdefault(g, []).append(len(c))
            disp_h.setdefault(g, []).append(disp)
    return best


def test_graph_scores_match_a_frame_loop(spark):
    rng = random.Random(11)
    rows = [(f, str(t), rng.randint(0, 60) / 1.0, rng.randint(0, 60) / 1.0) for t in range(9) for f in range(8) if rng.random() < 0.85]
    df = spark.createDataFrame(
        [("w", 0, 7, "s", "s:" + t, t, f, x, y) for f, t, x, y in rows],
        "window_id string, frame_start int, frame_end int, sequence string, sample_id string, track_id string, frame_id int, cx double, cy double",
    )
    scored = tracking.graph_track_scores(tracking.graph_frame_scores(neighbours.with_window_motion(df), 3, 25.0, 60.0))
    got = {r["track_id"]: r["score"] for r in scored.collect()}
    want = graph_brute(rows, 3, 25.0, 60.0, 0.5)
    assert got.keys() == want.keys()
    assert [got[t] for t in sorted(got)] == pytest.approx([want[t] for t in sorted(want)])


def test_tokens_and_unseen_contexts(spark):
    pts = [("s:1", "s", "1", f, float(x), float(y)) for f, x, y in [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 1, 5)]]
    df = spark.createDataFrame(pts, "sample_id string, sequence string, track_id string, frame_id int, cx double, cy double")
    stream = [r["token"] for r in tokens.motion_tokens(df).orderBy("position").collect()]
    assert stream == ["dir:E", "spd:1", "turn:0", "dir:STAY", "spd:0", "turn:0", "dir:N", "spd:3"]
    other = df.withColumn("cx", -F.col("cx"))
    row = tokens.ngram_scores(tokens.ngram_events(df), tokens.ngram_events(other)).first()
    assert math.isfinite(row["score"]) and row["num_tokens"] == 8
    assert tokens.ngram_events(df, 3).where("token = 'dir:E'").first()["context"] == "<BOS> <BOS>"


def test_injection_repeats_and_leaves_input(spark, sf):
    from trackloom.sources.tables import observations

    pts = pairing.fuse_points(observations(spark, sf)).cache()
    before = sorted(map(str, pts.collect()))
    a, la = protocol.inject_track_anomalies(pts, 0.4, 7)
    b, lb = protocol.inject_track_anomalies(pts, 0.4, 7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != before
    assert la.count() == lb.count() == math.ceil(0.4 * pts.select("sample_id").distinct().count())
    assert sorted(map(str, pts.collect())) == before
    win = windows.window_points(observations(spark, sf))
    out, labels = protocol.inject_group_anomalies(win, 1.0, 7)
    kinds = {r["anomaly_type"]: r["n"] for r in labels.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) == set(protocol.GROUP_ANOMALIES)
    copies = out.where(F.col("track_id").endswith(":population_copy")).select("window_id").distinct().count()
    assert copies == kinds["population_change"]


def test_icp_and_kabsch_recover_a_pose(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(-1, 1, (40, 3))
    angle = 0.1
    rot = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    moved = pts @ rot.T + [0.02, -0.01, 0.03]
    frame = lambda m: spark.createDataFrame([(p, i, *map(float, v)) for p in (0, 1) for i, v in enumerate(m)], "pair_id int, pt int, x double, y double, z double")
    found = cloud.icp(frame(pts), frame(moved), rounds=20).collect()
    for r in found:
        assert np.allclose(np.array(r["pose"]).reshape(3, 4)[:, :3], rot, atol=1e-6)
    a = cloud.nearest_points(frame(pts), frame(moved), block=256).select("pair_id", "pt", "near.d2", "near.pt").collect()
    b = cloud.nearest_points(frame(pts), frame(moved), block=7).select("pair_id", "pt", "near.d2", "near.pt").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_rank01_and_flat_values(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 2.0, 5.0)], "sample_id string, v double, flat double")
    got = {r["sample_id"]: (r["r_v"], r["r_flat"]) for r in ranks.rank01(df, ["sample_id"], ["v", "flat"], ["sample_id"]).collect()}
    assert got == {"a": (0.0, 0.0), "b": (0.5, 0.0), "c": (1.0, 0.0)}


def test_elimination_rules(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i:02d}", *map(float, rng.normal(size=3))) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, a double, b double, c double")
    low = ensembles.complementary_elimination(df, ["a", "b", "c"], k=8, rule="min").orderBy("iteration").collect()
    high = ensembles.complementary_elimination(df, ["a", "b", "c"], k=8, rule="max").orderBy("iteration").collect()
    assert [r["num_remaining"] for r in low] == [2, 1]
    assert low[0]["jaccard"] <= high[0]["jaccard"]


def test_resample_against_numpy(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for t, n in (("a", 1), ("b", 5), ("c", 16), ("d", 40)):
        frames = sorted(rng.sample(range(100), n))
        values = [rng.uniform(0, 9) for _ in frames]
        rows += [(t, f, v) for f, v in zip(frames, values)]
        want[t] = np.interp(np.linspace(0, 1, 16), np.linspace(0, 1, n), values) if n > 1 else np.repeat(values, 16)
    df = spark.createDataFrame(rows, "key string, frame_id int, v double")
    got = series.resample(df, ["key"], ["v"], 16).orderBy("key", "slot").collect()
    for t, values in want.items():
        assert [r["v"] for r in got if r["key"] == t] == pytest.approx(list(values))


def test_convergence_and_labels(spark):
    history = spark.createDataFrame(
        [("a", e, v) for e, v in enumerate([1.0, 0.5, 0.4999, 0.5, 0.5, 0.5, 0.5], 1)] + [("b", 1, 1.0), ("b", 2, 0.5)],
        "run string, epoch int, value double",
    )
    got = {r["run"]: (r["best_epoch"], r["epochs_since_best"], r["status"]) for r in report.convergence(history, 7).collect()}
    assert got == {"a": (2, 5, "converged"), "b": (2, 0, "early-stopped")}
    nan, inf = float("nan"), float("inf")
    broken = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, 0.5), ("a", 3, nan), ("b", 1, nan), ("b", 2, None), ("c", 1, 2.0), ("c", 2, -inf), ("c", 3, inf)],
        "run string, epoch int, value double",
    )
    got = {r["run"]: (r["final_epoch"], r["best_epoch"], r["status"]) for r in report.convergence(broken, 3).collect()}
    assert got == {"a": (3, 2, "max-budget-not-converged"), "b": (2, None, "no-loss-history"), "c": (3, 1, "max-budget-not-converged")}
    words = spark.createDataFrame([(w,) for w in ["1", " Yes", "ABNORMAL", "0.0", "neg", "2", "maybe"]], "w string")
    assert [r[0] for r in words.select(report.binary_label(F.col("w"))).collect()] == [1, 1, 1, 0, 0, None, None]


def test_radius_join_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = {(r["query_id"], r["base_id"]) for r in retrieval.radius_join(df, df, 12.5, exclude_self=True).collect()}
    assert got == {(a, b) for a, x, y in rows for b, u, v in rows if a != b and math.dist((x, y), (u, v)) <= 12.5}


def test_context_features_for_a_lonely_track(spark):
    df = spark.createDataFrame(
        [("w", "s:1", "s", "1", f, float(f), 0.0) for f in range(3)],
        "window_id string, sample_id string, sequence string, track_id string, frame_id int, cx double, cy double",
    )
    row = groups.context_features(neighbours.with_window_motion(df)).first()
    assert row["context_nearest_distance_mean"] == 20.0 and row["context_isolation_ratio"] == 1.0


def test_shape_of_a_turning_track(spark):
    # two repeats of a place, a right angle and a way back; a track that stands still has no shape
    places = [(0.0, 0.0), (0.0, 0.0), (3.0, 0.0), (3.0, 4.0), (3.0, 4.0), (1.0, 4.0)]
    rows = [("s:1", "s", "1", f, "rgb", x, y) for f, (x, y) in enumerate(places)] + [("s:2", "s", "2", f, "rgb", 1.0, 1.0) for f in range(4)]
    sensor = spark.createDataFrame(rows, "sample_id string, sequence string, track_id string, frame_id int, modality string, x double, y double")
    got = series.shape_sequences(sensor, time_step=0.1).orderBy("slot").collect()
    kept = np.array([p for i, p in enumerate(places) if i == 0 or p != places[i - 1]])
    path = np.linalg.norm(np.diff(kept, axis=0), axis=1).sum()
    stamps, at = np.arange(len(kept)) / path, (kept - kept[0]) / path
    grid = [*np.arange(0.0, stamps[-1], 0.1), stamps[-1]]
    curve = np.stack([np.interp(grid, stamps, at[:, c]) for c in (0, 1)], axis=1)
    z = (curve - curve.mean(axis=0)) / curve.std(axis=0)
    main, side = (z[:, 0] + z[:, 1]) / math.sqrt(2), (z[:, 0] - z[:, 1]) / math.sqrt(2)
    if (z[:, 0] * z[:, 1]).sum() < 0:
        main, side = side, main
    assert {r["sample_id"] for r in got} == {"s:1"}
    assert [r["main_axis"] for r in got] == pytest.approx(list(main))
    assert [r["side_axis"] for r in got] == pytest.approx(list(side))
