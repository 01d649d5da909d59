"""Queries on splits, anomaly injection, labels and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import detectors, evaluate, groups, motion, neighbours, protocol, ranks, windows
from trackloom.plans import oracle as sql
from trackloom.plans.detector_queries import points
from trackloom.plans.group_queries import moving_points
from trackloom.plans.registry import query, select
from trackloom.session import materialize
from trackloom.sources.tables import observations

FRACTION = 0.1


def _sign(tag: str, key: str, size: str) -> str:
    return f"CASE WHEN substr(md5('42:{tag}:' || {key}), 1, 1) < '8' THEN {size} ELSE -{size} END"


def _inject_sql() -> list[str]:
    """``fused0`` disturbed into ``fused``, labels in ``poslab``."""
    moved = []
    for axis, shift, jump, offset, stretch in (("x", 6.0, 10.0, 3.0, 1.25), ("y", 4.0, 8.0, 2.0, 0.5)):
        for m in ("", "rgb_", "thermal_"):
            c = f"{m}c{axis}"
            extra = (
                f"WHEN anomaly_type = 'modal_offset' THEN t.{c} + {_sign(f'offset_{axis}', 't.sample_id', offset)}" if m else ""
            )
            moved.append(
                f"""CASE WHEN t.{c} IS NULL THEN NULL
  WHEN anomaly_type = 'route_shift' THEN t.{c} + {_sign(f'shift_{axis}', 't.sample_id', shift)}
  WHEN anomaly_type = 'speed_spike' AND idx > 0 THEN t.{c} + t.c{axis} - f{axis}
  WHEN anomaly_type = 'stop_or_slowdown' AND idx > greatest(n // 2 - 1, 0) THEN s{axis}
  WHEN anomaly_type = 'jump' AND idx = n // 2 THEN t.{c} + {_sign(f'jump_{axis}', 't.sample_id', jump)}
  WHEN anomaly_type = 'shape_warp' THEN m{axis} + (t.{c} - m{axis}) * {stretch}::DOUBLE {extra} ELSE t.{c} END AS {c}"""
            )
    return [
        sql.FUSED.replace("fused AS (", "fused0 AS (", 1),
        """trk AS (SELECT sample_id, sequence, track_id, count(*) AS n, min(frame_id) AS frame_start, max(frame_id) AS frame_end FROM fused0 GROUP BY ALL)""",
        f"""poslab AS (SELECT sample_id, sequence, track_id, n, frame_start, frame_end, CASE WHEN n >= 2 THEN a
      WHEN a IN ('speed_spike', 'stop_or_slowdown') THEN 'jump' WHEN a = 'shape_warp' THEN 'modal_offset' ELSE a END AS anomaly_type
  FROM (SELECT *, ['route_shift','speed_spike','stop_or_slowdown','jump','shape_warp','modal_offset'][pos % 6 + 1] AS a FROM
    (SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) - 1 AS pos, count(*) OVER () AS total FROM trk) p
   WHERE pos < greatest(ceil(total * {FRACTION}::DOUBLE), 1)) q)""",
        f"""fused AS (SELECT t.* EXCLUDE (cx, cy, rgb_cx, rgb_cy, thermal_cx, thermal_cy), {", ".join(moved)}
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY frame_id) - 1 AS idx FROM fused0) t
  LEFT JOIN (SELECT sample_id, n, anomaly_type FROM poslab) p ON p.sample_id = t.sample_id
  LEFT JOIN (SELECT sample_id, arg_min(cx, frame_id) AS fx, arg_min(cy, frame_id) AS fy, avg(cx) AS mx, avg(cy) AS my,
                    max(CASE WHEN idx = greatest(n // 2 - 1, 0) THEN cx END) AS sx, max(CASE WHEN idx = greatest(n // 2 - 1, 0) THEN cy END) AS sy
             FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY frame_id) - 1 AS idx,
                          count(*) OVER (PARTITION BY sample_id) AS n FROM fused0) i GROUP BY sample_id) s ON s.sample_id = t.sample_id)""",
        """lab AS (SELECT t.sample_id, t.sequence, t.track_id, t.frame_start, t.frame_end, CASE WHEN p.sample_id IS NULL THEN 0 ELSE 1 END AS label,
  coalesce(p.anomaly_type, 'normal') AS anomaly_type FROM trk t LEFT JOIN poslab p ON p.sample_id = t.sample_id)""",
    ]


_INJECTED = [sql.RAW, sql.OBS, *_inject_sql()]
_HAND = [*_INJECTED, sql.STEPS, sql.HANDCRAFTED]
METHODS = ["max_speed", "mean_turn_angle", "modal_offset_mean"]
_SCORES = "sc AS (" + " UNION ALL ".join(f"SELECT sample_id, '{m}' AS method, round({m}, 9) AS score FROM hand" for m in METHODS) + ")"
_ALIGNED = "al AS (SELECT l.sample_id, method, label, anomaly_type, score FROM lab l JOIN sc USING (sample_id))"
_CURVE = """pts AS (SELECT method, score, sum(label) AS pos, count(*) AS n FROM al GROUP BY ALL),
cur AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS predicted, sum(pos) OVER (PARTITION BY method) AS p, sum(n) OVER (PARTITION BY method) AS total
        FROM pts WINDOW d AS (PARTITION BY method ORDER BY score DESC))"""
_EVAL = [*_HAND, _SCORES, _ALIGNED, _CURVE]


def injected(spark, sf):
    return protocol.inject_track_anomalies(points(spark, sf), FRACTION)


def scored(spark, sf):
    """Injected tracks: complete labels and the score table of three methods."""
    pts, positives = injected(spark, sf)
    labels = materialize(protocol.complete_labels(protocol.track_keys(pts), positives))
    features = motion.handcrafted_features(pts)
    scores = ranks.melt(features, ["sample_id"], METHODS).select(
        "sample_id", F.col("component").alias("method"), F.round("value", 9).alias("score")
    )
    return materialize(scores), labels


@query(
    "inject_track_anomalies",
    select(
        "sample_id, frame_id, ~cx, ~cy, ~rgb_cx, ~rgb_cy, ~thermal_cx, ~thermal_cy", "fused", _INJECTED
    ),
)
def inject_track_anomalies(spark, sf):
    pts, _ = injected(spark, sf)
    return pts.select("sample_id", "frame_id", "cx", "cy", "rgb_cx", "rgb_cy", "thermal_cx", "thermal_cy")


@query(
    "complete_labels",
    select(
        "sample_id, sequence, track_id, frame_start, frame_end, label, anomaly_type, 42 AS injection_seed", "lab", _INJECTED
    ),
)
def complete_labels(spark, sf):
    pts, positives = injected(spark, sf)
    return protocol.complete_labels(protocol.track_keys(pts), positives)


_GROUP_INJECT = f"""wkeys AS (SELECT DISTINCT window_id, sample_id, sequence, track_id, frame_start, frame_end FROM wstates),
wsel AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || window_id), window_id) - 1 AS pos, count(*) OVER () AS total FROM
   (SELECT window_id, arg_min(track_id, (md5('42:' || window_id || ':' || sample_id), sample_id)) AS victim,
           arg_min(track_id, (TRY_CAST(track_id AS BIGINT) IS NULL, TRY_CAST(track_id AS BIGINT), track_id)) AS lead, count(*) AS size FROM wkeys GROUP BY window_id) a) b
   WHERE pos < greatest(ceil(total * {FRACTION}::DOUBLE), 1)),
wpos AS (SELECT s.window_id, victim, CASE WHEN victim <> lead THEN lead ELSE second END AS other,
   CASE WHEN size < 2 AND pos % 6 = 2 THEN 'population_change' ELSE
   ['leave_group','against_motion','neighbor_replacement','population_change','dispersion_change','split_merge'][pos % 6 + 1] END AS anomaly_type
   FROM wsel s LEFT JOIN (SELECT k.window_id, arg_min(track_id, (TRY_CAST(track_id AS BIGINT) IS NULL, TRY_CAST(track_id AS BIGINT), track_id)) AS second
     FROM wkeys k JOIN wsel z ON k.window_id = z.window_id AND k.track_id <> z.lead GROUP BY k.window_id) u ON u.window_id = s.window_id),
glab AS (SELECT k.*, CASE WHEN p.victim IS NULL THEN 0 ELSE 1 END AS label, coalesce(p.anomaly_type, 'normal') AS anomaly_type
   FROM wkeys k LEFT JOIN wpos p ON p.window_id = k.window_id AND p.victim = k.track_id)"""


def _ginj() -> str:
    cols = []
    for axis, leave in (("x", 12.0), ("y", 8.0)):
        c = f"c{axis}"
        split = (
            "WHEN anomaly_type = 'split_merge' THEN o.cx + CASE WHEN o.i < o.n // 2 THEN -5.0 ELSE 5.0 END" if axis == "x" else ""
        )
        key = "o.window_id || ':' || o.sample_id"
        cols.append(
            f"""CASE WHEN anomaly_type = 'leave_group' THEN o.{c} + {_sign(f'leave_{axis}', key, leave)}
  WHEN anomaly_type = 'against_motion' THEN r.{c}
  WHEN anomaly_type = 'neighbor_replacement' THEN coalesce(b.{c} + 1.5, o.{c})
  WHEN anomaly_type = 'dispersion_change' THEN o.{c} + CASE WHEN o.{c} <> m{axis} THEN o.{c} - m{axis} ELSE 5.0 END {split} ELSE o.{c} END AS {c}"""
        )
    return f"""wi AS (SELECT *, row_number() OVER (PARTITION BY window_id, track_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY window_id, track_id) AS n FROM wstates),
ginj AS (SELECT o.window_id, o.sample_id, o.track_id, o.frame_id, {", ".join(cols)}
  FROM wi o LEFT JOIN wpos p ON p.window_id = o.window_id AND p.victim = o.track_id
  LEFT JOIN wi r ON r.window_id = o.window_id AND r.track_id = o.track_id AND r.i = o.n - 1 - o.i
  LEFT JOIN wi b ON b.window_id = p.window_id AND b.track_id = p.other AND b.frame_id = o.frame_id
  LEFT JOIN (SELECT window_id, avg(cx) AS mx, avg(cy) AS my FROM wstates GROUP BY window_id) m ON m.window_id = o.window_id
  UNION ALL SELECT w.window_id, sample_id || ':population_copy', track_id || ':population_copy', frame_id, cx, cy
  FROM wstates w JOIN wpos p ON p.window_id = w.window_id AND p.victim = w.track_id AND anomaly_type = 'population_change')"""


_GINJ = [*sql.WINDOWED, _GROUP_INJECT, _ginj()]


@query("inject_group_anomalies", select("window_id, sample_id, track_id, frame_id, ~cx, ~cy", "ginj", _GINJ))
def inject_group_anomalies(spark, sf):
    pts = materialize(windows.window_points(observations(spark, sf)))
    out, _ = protocol.inject_group_anomalies(pts, FRACTION)
    return out.select("window_id", "sample_id", "track_id", "frame_id", "cx", "cy")


@query(
    "complete_group_labels",
    select("window_id, sample_id, track_id, frame_start, frame_end, label, anomaly_type", "glab", [*sql.WINDOWED, _GROUP_INJECT]),
)
def complete_group_labels(spark, sf):
    pts = materialize(windows.window_points(observations(spark, sf)))
    _, positives = protocol.inject_group_anomalies(pts, FRACTION)
    done = protocol.complete_labels(protocol.window_keys(pts), positives, by=("window_id", "sample_id"))
    return done.drop("sequence", "injection_seed")


@query(
    "sequence_split_by_quota",
    select(
        "sequence, tracks, CASE WHEN upto - tracks < 0.2 * total THEN 'val' ELSE 'train' END AS split",
        """(SELECT *, sum(tracks) OVER (ORDER BY md5('42:' || sequence), sequence) AS upto, sum(tracks) OVER () AS total
            FROM (SELECT sequence, count(DISTINCT track_id) AS tracks FROM obs GROUP BY sequence) c) q""",
        sql.BASE,
    ),
)
def sequence_split_by_quota(spark, sf):
    counts = (
        observations(spark, sf)
        .groupBy("sequence", "track_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sequence")
        .agg(F.count(F.lit(1)).alias("tracks"))
    )
    return protocol.split_by_quota(counts)


@query(
    "bounded_training_sample",
    select("sample_id", "trk", [*sql.POINTS, "trk AS (SELECT DISTINCT sample_id FROM fused)"], "ORDER BY md5('42:' || sample_id), sample_id LIMIT 12"),
)
def bounded_training_sample(spark, sf):
    tracks = points(spark, sf).select("sample_id").distinct()
    return protocol.holdout_sample(tracks, 12)


@query(
    "auroc",
    select(
        """method, ~sum(pos * ((total - p) - (predicted - tp) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))) AS auroc""",
        "cur",
        _EVAL,
        "GROUP BY method",
    ),
)
def auroc(spark, sf):
    scores, labels = scored(spark, sf)
    return evaluate.curve_metrics(evaluate.align(scores, labels, METHODS)).select("method", "auroc")


@query(
    "average_precision",
    select("method, ~sum(pos * tp / predicted) / max(p) AS auprc", "cur", _EVAL, "GROUP BY method"),
)
def average_precision(spark, sf):
    scores, labels = scored(spark, sf)
    return evaluate.curve_metrics(evaluate.align(scores, labels, METHODS)).select("method", "auprc")


@query(
    "best_f1",
    select(
        "method, ~f1, ~score AS threshold",
        "(SELECT *, 2.0::DOUBLE * tp / (predicted + p) AS f1 FROM cur) f",
        _EVAL,
        "QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(f1, 12) DESC, score DESC) = 1",
    ),
)
def best_f1(spark, sf):
    scores, labels = scored(spark, sf)
    return evaluate.curve_metrics(evaluate.align(scores, labels, METHODS)).select("method", "f1", "threshold")


_PK = """pk AS (SELECT method, least(100, max(total))::BIGINT AS k, count(*) FILTER (label > 0 AND rn <= 100) AS hits_at_k, sum(label) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, sample_id) AS rn, count(*) OVER (PARTITION BY method) AS total FROM al) a GROUP BY method)"""


@query(
    "precision_at_k",
    select("method, k, hits_at_k, ~hits_at_k / k AS precision_at_k, ~hits_at_k / p AS recall_at_k", "pk", [*_EVAL, _PK]),
)
def precision_at_k(spark, sf):
    scores, labels = scored(spark, sf)
    return evaluate.precision_at_k(evaluate.align(scores, labels, METHODS), 100)


_PRED_VAL = """ps AS (SELECT sample_id, score FROM pred JOIN split USING (sequence) WHERE split = 'val')"""


@query(
    "alignment_report",
    select(
        """sum(l)::BIGINT AS num_label_rows, sum(s)::BIGINT AS num_score_rows, count(l) AS num_unique_label_keys, count(s) AS num_unique_score_keys,
        count(*) FILTER (l > 1) AS num_duplicate_label_keys, count(*) FILTER (s > 1) AS num_duplicate_score_keys,
        count(*) FILTER (s IS NULL) AS num_missing_score_keys, count(*) FILTER (l IS NULL) AS num_extra_score_keys""",
        """(SELECT sample_id, count(*) AS l FROM obs GROUP BY ALL) a FULL JOIN (SELECT sample_id, count(*) AS s FROM ps GROUP BY ALL) b USING (sample_id)""",
        [*sql.WINDOWED, sql.PREDICTION, sql.SPLIT, _PRED_VAL],
    ),
)
def alignment_report(spark, sf):
    """Validation-window scores against one label row per observation."""
    obs = materialize(observations(spark, sf))
    split = protocol.split_sequences(obs)
    predicted = windows.linear_prediction(windows.window_points(obs))
    scores = protocol.split_rows(predicted, split).where("split = 'val'")
    return evaluate.alignment_report(scores, obs.select("sample_id"))


@query(
    "evaluate_matrix",
    select(
        """method, ~auroc, ~auprc, ~f1, ~threshold, num_positive, num_total, k, hits_at_k, ~precision_at_k, ~recall_at_k,
        0::BIGINT AS num_duplicate_label_keys, 0::BIGINT AS num_duplicate_score_keys, 0::BIGINT AS num_missing_score_keys, 0::BIGINT AS num_extra_score_keys""",
        """(SELECT method, sum(pos * ((total - p) - (predicted - tp) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))) AS auroc,
              sum(pos * tp / predicted) / max(p) AS auprc, max(p)::BIGINT AS num_positive, max(total)::BIGINT AS num_total,
              arg_max(2.0::DOUBLE * tp / (predicted + p), (round(2.0::DOUBLE * tp / (predicted + p), 12), score)) AS f1,
              arg_max(score, (round(2.0::DOUBLE * tp / (predicted + p), 12), score)) AS threshold FROM cur GROUP BY method) c
           JOIN (SELECT method, k, hits_at_k, hits_at_k / k AS precision_at_k, hits_at_k / p AS recall_at_k FROM pk) k USING (method)""",
        [*_EVAL, _PK],
    ),
)
def evaluate_matrix(spark, sf):
    scores, labels = scored(spark, sf)
    return evaluate.evaluate(scores, labels, METHODS)


@query(
    "score_violations",
    select(
        "sample_id, 'duplicate key' AS problem", "pred", [*sql.WINDOWED, sql.PREDICTION], "GROUP BY sample_id HAVING count(*) > 1"
    ),
)
def score_violations(spark, sf):
    """Window scores checked under the per-track key rule."""
    predicted = windows.linear_prediction(windows.window_points(observations(spark, sf)))
    return evaluate.score_violations(predicted)


@query(
    "label_violations",
    select(
        "sample_id, 'duplicate key' AS problem", "glab", [*sql.WINDOWED, _GROUP_INJECT], "GROUP BY sample_id HAVING count(*) > 1"
    ),
)
def label_violations(spark, sf):
    """Window labels checked under the per-track key rule."""
    pts = materialize(windows.window_points(observations(spark, sf)))
    _, positives = protocol.inject_group_anomalies(pts, FRACTION)
    done = protocol.complete_labels(protocol.window_keys(pts), positives, by=("window_id", "sample_id"))
    return evaluate.label_violations(done)
