"""Queries on frame groups, neighbour search, token models and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import detectors, ensembles, groups, motion, neighbours, retrieval, tokens, windows
from trackloom.operators.knn import knn_join
from trackloom.operators.protocol import split_rows, split_sequences
from trackloom.plans import oracle as sql
from trackloom.plans.detector_queries import points, train_score
from trackloom.plans.registry import query, select
from trackloom.session import materialize
from trackloom.sources.tables import embeddings, observations


def moving_points(spark, sf):
    return materialize(neighbours.with_window_motion(windows.window_points(observations(spark, sf))))


_MOVE = """wm AS (SELECT *, coalesce(cx - lag(cx) OVER t, 0) AS vx, coalesce(cy - lag(cy) OVER t, 0) AS vy
  FROM wstates WINDOW t AS (PARTITION BY window_id, track_id ORDER BY frame_id))"""
_PAIRS = """prs AS (SELECT a.window_id, a.frame_id, a.track_id, b.track_id AS other, sqrt((a.cx - b.cx)^2 + (a.cy - b.cy)^2) AS d,
  sqrt((a.vx - b.vx)^2 + (a.vy - b.vy)^2) AS dv
  FROM wm a JOIN wm b ON a.window_id = b.window_id AND a.frame_id = b.frame_id AND a.track_id <> b.track_id)"""
_NN = """nn AS (SELECT w.window_id, w.frame_id, w.track_id, arg_min(other, (d, other)) AS neighbour, count(d) AS num_others,
  count(d) FILTER (d <= 10) AS num_near, coalesce(sum(d), 0) AS sum_distance, min(d) AS closest
  FROM wm w LEFT JOIN prs p ON w.window_id = p.window_id AND w.frame_id = p.frame_id AND w.track_id = p.track_id GROUP BY ALL)"""
_GROUP = [*sql.WINDOWED, _MOVE, _PAIRS, _NN]
_EDGES = """edges AS (SELECT DISTINCT window_id, frame_id, least(track_id, other) AS "left", greatest(track_id, other) AS "right"
  FROM (SELECT *, row_number() OVER (PARTITION BY window_id, frame_id, track_id ORDER BY d, other) AS rn FROM prs) p
  WHERE rn <= 3 AND d <= 30 AND dv <= 60)"""


@query(
    "neighbour_stats",
    select("window_id, frame_id, track_id, num_others, num_near, ~sum_distance, neighbour, ~closest", "nn", _GROUP),
)
def neighbour_stats(spark, sf):
    stats = neighbours.neighbour_stats(moving_points(spark, sf))
    first = F.get("nearest", F.lit(0))
    return stats.select(
        "window_id",
        "frame_id",
        "track_id",
        "num_others",
        "num_near",
        "sum_distance",
        first["id"].alias("neighbour"),
        first["distance"].alias("closest"),
    )


@query("frame_knn_edges", select('window_id, frame_id, "left", "right"', "edges", [*_GROUP, _EDGES]))
def frame_knn_edges(spark, sf):
    return neighbours.knn_edges(moving_points(spark, sf), 3, 30.0, 60.0)


@query(
    "relative_displacement",
    select(
        """window_id, frame_id, track_id, ~vx - median(vx) OVER f AS rel_dx, ~vy - median(vy) OVER f AS rel_dy""",
        "wm",
        [*sql.WINDOWED, _MOVE],
        "WINDOW f AS (PARTITION BY window_id, frame_id)",
    ),
)
def relative_displacement(spark, sf):
    rows = groups.relative_displacement(moving_points(spark, sf))
    return rows.select("window_id", "frame_id", "track_id", "rel_dx", "rel_dy")


_CHURN1 = """ch1 AS (SELECT window_id, frame_id, track_id, CASE WHEN pf IS NOT NULL THEN 1 ELSE 0 END AS compared,
  CASE WHEN pf IS NOT NULL AND pn IS DISTINCT FROM neighbour THEN 1 ELSE 0 END AS changed
  FROM (SELECT *, lag(frame_id) OVER t AS pf, lag(neighbour) OVER t AS pn FROM nn WINDOW t AS (PARTITION BY window_id, track_id ORDER BY frame_id)) c)"""
_CHURN2 = """ch2 AS (SELECT n.window_id, n.frame_id, n.track_id, CASE WHEN p.track_id IS NOT NULL THEN 1 ELSE 0 END AS compared,
  CASE WHEN p.track_id IS NOT NULL AND p.neighbour IS DISTINCT FROM n.neighbour THEN 1 ELSE 0 END AS changed
  FROM nn n JOIN (SELECT window_id, frame_id, lag(frame_id) OVER (PARTITION BY window_id ORDER BY frame_id) AS pf
                  FROM (SELECT DISTINCT window_id, frame_id FROM nn) f0) f ON f.window_id = n.window_id AND f.frame_id = n.frame_id
  LEFT JOIN nn p ON p.window_id = n.window_id AND p.frame_id = f.pf AND p.track_id = n.track_id)"""


@query(
    "neighbour_churn",
    select(
        "window_id, sum(compared)::BIGINT AS compared, sum(changed)::BIGINT AS changed",
        "ch1",
        [*_GROUP, _CHURN1],
        "GROUP BY window_id",
    ),
)
def neighbour_churn(spark, sf):
    stats = neighbours.neighbour_stats(moving_points(spark, sf), totals=False)
    churn = groups.churn_since_seen(groups.nearest_ids(stats))
    return churn.groupBy("window_id").agg(F.sum("compared").alias("compared"), F.sum("changed").alias("changed"))


@query(
    "neighbour_churn_by_frame",
    select(
        "window_id, frame_id, sum(compared)::BIGINT AS compared, sum(changed)::BIGINT AS changed",
        "ch2",
        [*_GROUP, _CHURN2],
        "GROUP BY window_id, frame_id",
    ),
)
def neighbour_churn_by_frame(spark, sf):
    stats = neighbours.neighbour_stats(moving_points(spark, sf), totals=False)
    churn = groups.churn_since_previous_frame(groups.nearest_ids(stats))
    return churn.groupBy("window_id", "frame_id").agg(
        F.sum("compared").alias("compared"), F.sum("changed").alias("changed")
    )


_DISP = """disp AS (SELECT window_id, frame_id, count(*) AS size, avg(sqrt((cx - mx)^2 + (cy - my)^2)) AS dispersion
  FROM (SELECT *, avg(cx) OVER f AS mx, avg(cy) OVER f AS my FROM wstates WINDOW f AS (PARTITION BY window_id, frame_id)) a GROUP BY ALL)"""
_GF = """gf AS (SELECT * FROM
  (SELECT window_id, sequence, frame_start, frame_end, count(DISTINCT track_id) AS num_objects, coalesce(avg(speed), 0) AS mean_speed,
          coalesce(stddev_pop(speed), 0) AS std_speed FROM wsteps GROUP BY ALL) a
  JOIN (SELECT window_id, count(*) AS num_frames, avg(size) AS mean_group_size, max(size)::DOUBLE AS max_group_size,
               avg(dispersion) AS mean_dispersion, max(dispersion) AS max_dispersion FROM disp GROUP BY window_id) b USING (window_id)
  JOIN (SELECT window_id, CASE WHEN sum(compared) > 0 THEN sum(changed) / sum(compared) ELSE 0.0::DOUBLE END AS neighbor_churn FROM ch1 GROUP BY window_id) c USING (window_id))"""
_GF_ALL = [*_GROUP, sql.WSTEPS, _DISP, _CHURN1, _GF]


@query(
    "group_features",
    select(
        """window_id, sequence, frame_start, frame_end, num_objects, num_frames, ~mean_group_size, ~max_group_size,
        ~mean_dispersion, ~max_dispersion, ~mean_speed, ~std_speed, ~neighbor_churn""",
        "gf",
        _GF_ALL,
    ),
)
def group_features(spark, sf):
    return groups.group_features(moving_points(spark, sf))


_SIG = """nedge AS (SELECT DISTINCT window_id, frame_id, least(track_id, neighbour) AS a, greatest(track_id, neighbour) AS b FROM nn WHERE neighbour IS NOT NULL),
deg AS (SELECT n.window_id, n.frame_id, n.track_id, count(e.a) AS d FROM nn n LEFT JOIN nedge e
        ON n.window_id = e.window_id AND n.frame_id = e.frame_id AND (n.track_id = e.a OR n.track_id = e.b) GROUP BY ALL),
sig AS (SELECT * FROM
  (SELECT window_id, frame_id, avg(d) AS mean_degree, stddev_pop(d) AS degree_std, sum(d) / 2 AS ne FROM deg GROUP BY ALL) a
  JOIN disp USING (window_id, frame_id)
  JOIN (SELECT window_id, frame_id, sum(sum_distance) AS pd FROM nn GROUP BY ALL) p USING (window_id, frame_id)
  JOIN (SELECT window_id, frame_id, coalesce(avg(speed), 0) AS mean_speed FROM wsteps GROUP BY ALL) s USING (window_id, frame_id)
  JOIN (SELECT window_id, frame_id, CASE WHEN sum(compared) > 0 THEN sum(changed) / sum(compared) ELSE 0.0::DOUBLE END AS neighbor_churn FROM ch2 GROUP BY ALL) c USING (window_id, frame_id))"""


@query(
    "frame_signatures",
    select(
        """window_id, frame_id, size::DOUBLE AS num_objects, ~CASE WHEN size > 1 THEN ne / (size * (size - 1) / 2) ELSE 0 END AS edge_density,
        ~mean_degree, ~degree_std, ~CASE WHEN size > 1 THEN pd / (size * (size - 1)) ELSE 0 END AS mean_pair_distance,
        ~dispersion, ~mean_speed, ~neighbor_churn""",
        "sig",
        [*_GROUP, sql.WSTEPS, _DISP, _CHURN2, _SIG],
    ),
)
def frame_signatures(spark, sf):
    pts = moving_points(spark, sf)
    return groups.frame_signatures(pts, materialize(neighbours.neighbour_stats(pts)))


_CTX = """ctx AS (SELECT sample_id, sequence, track_id, avg(num_near) AS context_num_neighbors,
  avg(coalesce(closest, 20)) AS context_nearest_distance_mean,
  avg(CASE WHEN num_others = 0 THEN 20 ELSE sum_distance / num_others END) AS context_neighbor_distance_mean,
  avg(dispersion) AS context_group_dispersion_mean,
  avg(CASE WHEN num_others = 0 OR closest > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS context_isolation_ratio,
  avg(sqrt((vx - gx)^2 + (vy - gy)^2)) AS context_relative_speed_mean
  FROM (SELECT *, avg(vx) OVER f AS gx, avg(vy) OVER f AS gy FROM wm WINDOW f AS (PARTITION BY window_id, frame_id)) m
  JOIN nn USING (window_id, frame_id, track_id) JOIN disp USING (window_id, frame_id) GROUP BY ALL)"""
_CTX_COLS = ", ".join(f"~{c}" for c in groups.CONTEXT)


@query("context_features", select(f"sample_id, sequence, track_id, {_CTX_COLS}", "ctx", [*_GROUP, _DISP, _CTX]))
def context_features(spark, sf):
    return groups.context_features(moving_points(spark, sf))


_CTXHAND = f"""ctxhand AS (SELECT h.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in groups.CONTEXT)} FROM hand h LEFT JOIN ctx USING (sample_id))"""
_AWARE = [*_GROUP, _DISP, _CTX, sql.STEPS, sql.HANDCRAFTED, _CTXHAND]


@query(
    "context_aware_features",
    select(f"sample_id, ~path_length, ~max_speed, {_CTX_COLS}", "ctxhand", _AWARE),
)
def context_aware_features(spark, sf):
    table = groups.context_aware_features(points(spark, sf), moving_points(spark, sf))
    return table.select("sample_id", "path_length", "max_speed", *groups.CONTEXT)


@query(
    "neighbour_set_change",
    select(
        """o.window_id, o.frame_id, o.track_id, ~CASE WHEN o.pf IS NULL OR len(list_distinct(list_concat(o.ns, p.ns))) = 0 THEN 0.0
           ELSE 1 - len(list_intersect(o.ns, p.ns)) / len(list_distinct(list_concat(o.ns, p.ns))) END AS neighbour_change""",
        "ns2 o LEFT JOIN ns2 p ON p.window_id = o.window_id AND p.track_id = o.track_id AND p.frame_id = o.pf",
        [
            *_GROUP,
            _EDGES,
            """links AS (SELECT window_id, frame_id, "left" AS track_id, "right" AS other FROM edges UNION ALL SELECT window_id, frame_id, "right", "left" FROM edges),
            ns2 AS (SELECT w.window_id, w.frame_id, w.track_id, coalesce(list(other) FILTER (other IS NOT NULL), []) AS ns,
                           lag(w.frame_id) OVER (PARTITION BY w.window_id, w.track_id ORDER BY w.frame_id) AS pf
                    FROM wm w LEFT JOIN links l ON w.window_id = l.window_id AND w.frame_id = l.frame_id AND w.track_id = l.track_id
                    GROUP BY w.window_id, w.frame_id, w.track_id)""",
        ],
    ),
)
def neighbour_set_change(spark, sf):
    pts = moving_points(spark, sf)
    return groups.neighbour_set_change(materialize(neighbours.knn_edges(pts, 3, 30.0, 60.0)), pts)


@query(
    "knn_profile",
    select(
        "sample_id, ~score",
        "d1",
        [*sql.MOTION, sql.HANDCRAFTED, sql.SPLIT, *sql.knn("d1", "hand", "sample_id", motion.HANDCRAFTED, 1)],
    ),
)
def knn_profile(spark, sf):
    train, score = train_score(spark, sf, motion.handcrafted_features(points(spark, sf)))
    return detectors.nearest_profile_scores(train, score, motion.HANDCRAFTED)


@query(
    "context_knn_profile",
    select(
        "sample_id, ~score",
        "d7",
        [*_AWARE, sql.SPLIT, *sql.knn("d7", "ctxhand", "sample_id", [*motion.HANDCRAFTED, *groups.CONTEXT], 1)],
    ),
)
def context_knn_profile(spark, sf):
    """Windows only ever hold tracks of one sequence, so train and score windows split alike."""
    table = groups.context_aware_features(points(spark, sf), moving_points(spark, sf))
    train, score = train_score(spark, sf, table)
    return detectors.nearest_profile_scores(train, score, [*motion.HANDCRAFTED, *groups.CONTEXT])


@query(
    "window_knn_profile",
    select(
        "window_id, track_id, sample_id, ~score",
        "d15 JOIN wobj USING (window_id)",
        [*_GF_ALL, sql.SPLIT, *sql.knn("d15", "gf", "window_id", groups.GROUP_FEATURES, 3)],
    ),
)
def window_knn_profile(spark, sf):
    pts = moving_points(spark, sf)
    train, score = train_score(spark, sf, groups.group_features(pts))
    scores = detectors.nearest_profile_scores(train, score, groups.GROUP_FEATURES, "window_id", k=3)
    return detectors.spread_to_objects(scores, pts).select("window_id", "track_id", "sample_id", "score")


@query(
    "lof_scores",
    select(
        "sample_id, ~score",
        "lof",
        [*sql.MOTION, sql.HANDCRAFTED, sql.SPLIT, *sql.lof("lof", "hand", "sample_id", motion.HANDCRAFTED, 20)],
    ),
)
def lof_scores(spark, sf):
    train, score = train_score(spark, sf, motion.handcrafted_features(points(spark, sf)))
    return detectors.lof_scores(train, score, motion.HANDCRAFTED)


@query(
    "window_lof_scores",
    select(
        "window_id, ~score",
        "lofw",
        [*_GF_ALL, sql.SPLIT, *sql.lof("lofw", "gf", "window_id", groups.GROUP_FEATURES, 20)],
    ),
)
def window_lof_scores(spark, sf):
    train, score = train_score(spark, sf, groups.group_features(moving_points(spark, sf)))
    return detectors.lof_scores(train, score, groups.GROUP_FEATURES, "window_id")


@query(
    "isolation_forest_windows",
    select("window_id, ~score", "isow", [*_GF_ALL, sql.SPLIT, *sql.isolation("isow", "gf", "window_id", groups.GROUP_FEATURES)]),
)
def isolation_forest_windows(spark, sf):
    train, score = train_score(spark, sf, groups.group_features(moving_points(spark, sf)))
    return ensembles.isolation_scores(train, score, groups.GROUP_FEATURES, "window_id")


# ------------------------------------------------------------------ tokens
_TOKENS = """tok AS (
  SELECT sample_id, sequence, frame_id * 4 + slot AS position, token FROM (
  SELECT sample_id, sequence, frame_id, 0 AS slot, 'turn:' || ((coalesce(turn, 0) > 0.5)::INT + (coalesce(turn, 0) > 1.5)::INT) AS token FROM steps WHERE acceleration IS NOT NULL
  UNION ALL SELECT sample_id, sequence, frame_id, 1, 'dir:' || CASE WHEN step <= 0.0625 THEN 'STAY'
     ELSE ['E','NE','N','NW','W','SW','S','SE'][(CAST(round_even(atan2(dy, dx) / (pi() / 4), 0) AS INT) + 8) % 8 + 1] END FROM steps WHERE step IS NOT NULL
  UNION ALL SELECT sample_id, sequence, frame_id, 2, 'spd:' || ((speed > 0.5)::INT + (speed > 1.5)::INT + (speed > 3.0)::INT) FROM steps WHERE step IS NOT NULL) t)"""
_EVENTS = """ev AS (SELECT sample_id, sequence, coalesce(lag(token) OVER (PARTITION BY sample_id ORDER BY position), '<BOS>') AS context, token
  FROM (SELECT * FROM tok UNION ALL SELECT sample_id, sequence, max(frame_id) * 4 + 3, '<EOS>' FROM fused GROUP BY ALL) t)"""
_NGRAM = """evs AS (SELECT ev.*, split FROM ev JOIN split USING (sequence)),
vocab AS (SELECT DISTINCT token FROM evs WHERE split = 'train' UNION SELECT '<EOS>' UNION SELECT '<UNK>'),
cnt AS (SELECT context, token, count(*) AS n FROM evs WHERE split = 'train' GROUP BY ALL),
tot AS (SELECT context, sum(n) AS total FROM cnt GROUP BY ALL),
mapped AS (SELECT sample_id, CASE WHEN context IN (SELECT token FROM vocab) OR context = '<BOS>' THEN context ELSE '<UNK>' END AS context,
   CASE WHEN token IN (SELECT token FROM vocab) THEN token ELSE '<UNK>' END AS token FROM evs WHERE split = 'val'),
ng AS (SELECT sample_id, avg(-ln((coalesce(n, 0) + 1.0) / (coalesce(total, 0) + (SELECT count(*) FROM vocab)))) AS score, count(*) - 1 AS num_tokens
  FROM mapped LEFT JOIN cnt USING (context, token) LEFT JOIN tot USING (context) GROUP BY sample_id)"""


@query("motion_tokens", select("sample_id, position, token", "tok", [*sql.MOTION, _TOKENS]))
def motion_tokens(spark, sf):
    return tokens.motion_tokens(points(spark, sf)).select("sample_id", "position", "token")


@query(
    "ngram_counts",
    select("context, token, count(*) AS count", "ev", [*sql.MOTION, _TOKENS, _EVENTS], "GROUP BY context, token"),
)
def ngram_counts(spark, sf):
    return tokens.ngram_counts(tokens.ngram_events(points(spark, sf)))


@query(
    "ngram_scores",
    select("sample_id, ~score, num_tokens", "ng", [*sql.MOTION, _TOKENS, _EVENTS, sql.SPLIT, _NGRAM]),
)
def ngram_scores(spark, sf):
    pts = points(spark, sf)
    events = materialize(split_rows(tokens.ngram_events(pts), split_sequences(pts)))
    scores = tokens.ngram_scores(events.where("split = 'train'"), events.where("split = 'val'"))
    return scores.select("sample_id", "score", "num_tokens")


# ------------------------------------------------------------------ retrieval
_EMB = """emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)"""
_L2 = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_TOPK = f"""sims AS (SELECT a.id AS query_id, b.id AS neighbor_id, {_L2} AS distance, a.label = b.label AS same,
  sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS gap FROM emb a JOIN emb b ON a.id <> b.id),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM sims) s WHERE rank <= 20)"""


def vectors(spark, sf):
    e = embeddings(spark, sf)
    at = lambda i: (F.get("vector", F.lit(i)) * 100)
    return materialize(
        e.select(
            F.col("vec_id").alias("id"), "vector", "label", at(0).alias("x"), at(1).alias("y"), F.array(at(0), at(1)).alias("place")
        )
    )


@query("embedding_topk", select("query_id, neighbor_id, ~distance, rank", "topk", [_EMB, _TOPK]))
def embedding_topk(spark, sf):
    base = vectors(spark, sf).select("id", "vector")
    return knn_join(base, base, 20, exclude_self=True)


def _labelled_topk(spark, sf):
    table = vectors(spark, sf)
    base = table.select("id", "vector")
    found = knn_join(base, base, 20, exclude_self=True)
    q = table.select(F.col("id").alias("query_id"), F.col("label").alias("_ql"))
    b = table.select(F.col("id").alias("neighbor_id"), F.col("label").alias("_bl"))
    joined = found.join(q, "query_id").join(b, "neighbor_id")
    return retrieval.first_hits(joined, F.col("_ql") == F.col("_bl"))


_HITS = "hits AS (SELECT query_id, min(rank) FILTER (same) AS first_hit, arg_min(neighbor_id, rank) AS top_id, min(distance) AS top_distance, bool_or(same AND rank = 1)::INT AS top_correct FROM topk GROUP BY query_id)"


@query(
    "recall_at_n",
    select(
        "n, ~100 * avg(CASE WHEN first_hit <= n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall",
        "hits, (SELECT unnest([1, 5, 10, 20]) AS n) r",
        [_EMB, _TOPK, _HITS],
        "GROUP BY n",
    ),
)
def recall_at_n(spark, sf):
    return retrieval.recall_at(_labelled_topk(spark, sf))


@query(
    "retrieval_results",
    select("query_id, first_hit, top_id, ~top_distance, top_correct", "hits", [_EMB, _TOPK, _HITS]),
)
def retrieval_results(spark, sf):
    return _labelled_topk(spark, sf)


@query(
    "radius_positives",
    select("query_id, neighbor_id AS base_id, ~gap", "sims", [_EMB, _TOPK], "WHERE gap <= 25"),
)
def radius_positives(spark, sf):
    table = vectors(spark, sf)
    return retrieval.radius_join(table, table, 25.0, exclude_self=True)


@query(
    "best_positives",
    select(
        "query_id, arg_min(neighbor_id, (distance, neighbor_id)) AS neighbor_id, ~min(distance) AS distance, 1 AS rank",
        "sims",
        [_EMB, _TOPK],
        "WHERE gap <= 10 GROUP BY query_id",
    ),
)
def best_positives(spark, sf):
    table = vectors(spark, sf)
    return retrieval.best_positives(table, table)


@query(
    "hardest_negatives",
    select(
        "query_id, neighbor_id, ~distance, rank",
        "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM sims WHERE gap > 25) s",
        [_EMB, _TOPK],
        "WHERE rank <= 10",
    ),
)
def hardest_negatives(spark, sf):
    table = vectors(spark, sf)
    return retrieval.hardest_negatives(table, table)


_HALF = _L2.replace("a.v,", "a.v[1:32],").replace("b.v)", "b.v[1:32])")
_TURNS = [
    *[f"d{t} AS (SELECT id FROM emb ORDER BY substr(md5('42:{t}:' || id), 1, 12), id LIMIT 150)" for t in (1, 2)],
    """old AS (SELECT query_id, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rn FROM sims
        WHERE gap > 25 AND neighbor_id IN (SELECT id FROM d1)) s WHERE rn <= 10)""",
    f"""half AS (SELECT a.id AS query_id, b.id AS neighbor_id, {_HALF} AS distance, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS gap FROM emb a JOIN emb b ON a.id <> b.id)""",
    """pool AS (SELECT h.query_id, h.neighbor_id, h.distance FROM half h LEFT JOIN old o USING (query_id, neighbor_id)
        WHERE o.query_id IS NOT NULL OR (gap > 25 AND neighbor_id IN (SELECT id FROM d2)))""",
]


@query(
    "hardest_negatives_second_turn",
    select(
        "query_id, neighbor_id, ~distance, rank",
        "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM pool) s",
        [_EMB, _TOPK, *_TURNS],
        "WHERE rank <= 10",
    ),
)
def hardest_negatives_second_turn(spark, sf):
    """Two turns over different draws; in the second the features are the first half of the vectors."""
    table = vectors(spark, sf)
    first = materialize(retrieval.mining_turn(table, table, None, 1, 150))
    changed = table.withColumn("vector", F.slice("vector", 1, 32))
    return retrieval.mining_turn(changed, changed, first, 2, 150)


def _crop_sql(name: str, part: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rn
  FROM (SELECT a.id AS query_id, b.id AS neighbor_id,
        sqrt(list_sum(list_transform(list_zip(a.v{part}, b.v{part}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
        FROM emb a JOIN emb b ON a.id <> b.id) s) t WHERE rn <= 20)"""


@query(
    "merge_crops",
    select(
        "query_id, neighbor_id, ~distance, rank",
        """(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM
            (SELECT query_id, neighbor_id, min(distance) AS distance FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) u GROUP BY ALL) m) r""",
        [_EMB, _crop_sql("c1", "[1:32]"), _crop_sql("c2", "[33:64]")],
        "WHERE rank <= 20",
    ),
)
def merge_crops(spark, sf):
    """Two crops of a query: the halves of its vector."""
    table = vectors(spark, sf)
    found = []
    for start in (1, 33):
        half = table.select("id", F.slice("vector", start, 32).alias("vector"))
        found.append(knn_join(half, half, 20, exclude_self=True))
    return retrieval.merge_crops(found[0].unionByName(found[1]))


@query(
    "mean_crops",
    select(
        "id, pos - 1 AS axis, ~list_avg([v[pos], v[pos + 16], v[pos + 32], v[pos + 48]]) AS value",
        "(SELECT *, unnest(generate_series(1, 16)) AS pos FROM emb) e",
        [_EMB],
    ),
)
def mean_crops(spark, sf):
    table = vectors(spark, sf)
    crops = table.select(
        "id", F.explode(F.array(*[F.slice("vector", 1 + 16 * i, 16) for i in range(4)])).alias("vector")
    )
    means = retrieval.mean_vectors(crops)
    return means.select("id", F.posexplode("vector").alias("axis", "value")).withColumn(
        "axis", F.col("axis").cast("long")
    )


@query("pca_reduce")
def pca_reduce(spark, sf):
    reduced = retrieval.pca_reduce(vectors(spark, sf).select("id", "vector"), 8)
    return reduced.select("id", F.posexplode("vector").alias("axis", "value"))


@query(
    "weighted_queries",
    select(
        "id, ~-ln((('0x' || substr(md5('42:' || id), 1, 12))::BIGINT + 1.0::DOUBLE) / (16.0::DOUBLE ** 12 + 1)) / (1 + label) AS sample_key",
        "emb",
        [_EMB],
        "ORDER BY sample_key LIMIT 100",
    ),
)
def weighted_queries(spark, sf):
    picked = retrieval.weighted_sample(vectors(spark, sf), 100, 1.0 + F.col("label"))
    return picked.select("id", "sample_key")
