"""Queries on summaries, rankings, explanations, set operations and ensembles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators import (
    detectors,
    ensembles,
    evaluate,
    events,
    groups,
    matrix,
    motion,
    neighbours,
    protocol,
    ranks,
    report,
    segments,
    tracking,
    windows,
)
from trackloom.plans import oracle as sql
from trackloom.plans.detector_queries import points, steps, train_score
from trackloom.plans.group_queries import _EDGES, _GROUP, moving_points, vectors
from trackloom.plans.protocol_queries import _ALIGNED, _CURVE, _EVAL, _GROUP_INJECT, _HAND, _INJECTED, _PK, _SCORES, FRACTION, METHODS, injected, scored
from trackloom.plans.registry import query, select
from trackloom.session import materialize, shared_dir
from trackloom.sources.tables import observations, raw_detections


def window_labels(spark, sf):
    pts = materialize(windows.window_points(observations(spark, sf)))
    _, positives = protocol.inject_group_anomalies(pts, FRACTION)
    return materialize(protocol.complete_labels(protocol.window_keys(pts), positives, by=("window_id", "sample_id")))


_GLAB = [*sql.WINDOWED, _GROUP_INJECT]


@query(
    "labels_by_sample",
    select(
        """sample_id, max(label) AS label, min(frame_start) AS frame_start, max(frame_end) AS frame_end, count(*) AS num_windows,
        count(*) FILTER (label = 1) AS positive_windows,
        coalesce(arg_min(anomaly_type, (frame_start, window_id)) FILTER (label = 1), 'normal') AS anomaly_type""",
        "glab",
        _GLAB,
        "GROUP BY sample_id",
    ),
)
def labels_by_sample(spark, sf):
    return report.labels_by_sample(window_labels(spark, sf))


@query(
    "best_rows",
    select(
        "sample_id, ~max(score) AS score, arg_min(window_id, (-score, window_id)) AS window_id, arg_min(frame_start, (-score, window_id)) AS frame_start",
        "pred",
        [*sql.WINDOWED, sql.PREDICTION],
        "GROUP BY sample_id",
    ),
)
def best_rows(spark, sf):
    predicted = windows.linear_prediction(windows.window_points(observations(spark, sf)))
    return report.best_rows(predicted.select("sample_id", "score", "window_id", "frame_start"))


@query(
    "label_distribution",
    select(
        "coalesce(anomaly_type, '*') AS anomaly_type, count(*) AS num_rows, sum(label)::BIGINT AS num_positive",
        "glab",
        _GLAB,
        "GROUP BY ROLLUP (anomaly_type)",
    ),
)
def label_distribution(spark, sf):
    return report.label_distribution(window_labels(spark, sf))


_FIELDS = ["sequence", "track_id", "frame_id", "rgb_cx", "thermal_cx", "category_name"]


@query(
    "field_coverage",
    select(
        "field, present, total - present AS missing",
        "(" + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) AS total FROM obs" for c in _FIELDS) + ") u",
        sql.BASE,
    ),
)
def field_coverage(spark, sf):
    return report.field_coverage(observations(spark, sf).select(*_FIELDS))


@query(
    "schema_diagnostics",
    select(
        """concat_ws(',', CASE WHEN m > 0 THEN 'missing_score_keys' END, CASE WHEN dl > 0 THEN 'duplicate_label_keys' END,
           CASE WHEN ds > 0 THEN 'duplicate_score_keys' END, CASE WHEN lp THEN 'partial_label_field_coverage' END) AS warnings, 'warning' AS status""",
        """(SELECT count(*) FILTER (s IS NULL) AS m, count(*) FILTER (l > 1) AS dl, count(*) FILTER (s > 1) AS ds FROM
             (SELECT sample_id, count(*) AS l FROM obs GROUP BY ALL) a LEFT JOIN (SELECT sample_id, count(*) AS s FROM ps GROUP BY ALL) b USING (sample_id)) k,
           (SELECT count(rgb_cx) < count(*) AS lp FROM obs) c""",
        [*sql.WINDOWED, sql.PREDICTION, sql.SPLIT, "ps AS (SELECT sample_id, score FROM pred JOIN split USING (sequence) WHERE split = 'val')"],
    ),
)
def schema_diagnostics(spark, sf):
    obs = materialize(observations(spark, sf))
    predicted = windows.linear_prediction(windows.window_points(obs))
    split = protocol.split_sequences(obs)
    scores = materialize(protocol.split_rows(predicted, split).where("split = 'val'").select("sample_id", "score"))
    labels = obs.select("sample_id", "rgb_cx")
    return report.diagnostic_warnings(
        evaluate.alignment_report(scores, labels), report.field_coverage(labels), report.field_coverage(scores)
    )


# ------------------------------------------------------------------ method tables
def _with_types(spark, sf):
    scores, labels = scored(spark, sf)
    aligned = materialize(evaluate.align(scores, labels, METHODS))
    return aligned.join(labels.select("sample_id", "anomaly_type"), "sample_id")


_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, sample_id) AS rank FROM al)"
_AL = [*_HAND, _SCORES, _ALIGNED, _RANKED]


@query(
    "top_k_hits",
    select("method, sample_id, label, ~score, rank::INT AS rank", "rk", _AL, "WHERE rank <= 100"),
)
def top_k_hits(spark, sf):
    scores, labels = scored(spark, sf)
    return evaluate.top_k(evaluate.align(scores, labels, METHODS), 100)


@query(
    "anomaly_type_hits",
    select(
        """method, anomaly_type, count(*) FILTER (rank <= 20) AS hits_at_k, count(*) AS total_positive,
        ~count(*) FILTER (rank <= 20) / count(*) AS recall_at_k, ~avg(score) AS mean_positive_score""",
        "rk",
        _AL,
        "WHERE label > 0 GROUP BY method, anomaly_type",
    ),
)
def anomaly_type_hits(spark, sf):
    aligned = _with_types(spark, sf)
    return report.anomaly_type_hits(evaluate.top_k(aligned, 20), aligned, 20)


@query(
    "case_rows",
    select(
        "method, sample_id, label, anomaly_type, ~score, rank, case_type, case_rank::INT AS case_rank",
        """(SELECT *, row_number() OVER (PARTITION BY method, case_type ORDER BY CASE WHEN case_type = 'false_negative' THEN score END, rank, sample_id) AS case_rank
            FROM (SELECT *, CASE WHEN label > 0 THEN 'true_positive' ELSE 'false_positive' END AS case_type FROM rk
                  UNION ALL SELECT *, 'false_negative' FROM rk WHERE label > 0 AND rank > 20) c) d""",
        _AL,
        "WHERE case_rank <= 12",
    ),
)
def case_rows(spark, sf):
    return report.case_rows(_with_types(spark, sf), 20)


_LEVELS = {"max_speed": "speed", "mean_turn_angle": "shape", "modal_offset_mean": "modal"}


@query(
    "leaderboard",
    select(
        "method, ~sum(pos * ((total - p) - (predicted - tp) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))) AS auroc, "
        "CASE method WHEN 'max_speed' THEN 'speed' WHEN 'mean_turn_angle' THEN 'shape' ELSE 'modal' END AS method_family",
        "cur",
        _EVAL,
        "GROUP BY method",
    ),
)
def leaderboard(spark, sf):
    scores, labels = scored(spark, sf)
    metrics = evaluate.curve_metrics(evaluate.align(scores, labels, METHODS)).select("method", "auroc")
    family = F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])
    profiles = scores.select("method").distinct().withColumn("method_family", family[F.col("method")])
    return report.leaderboard(metrics, profiles)


SEEDS = (41, 42, 43)


def seed_runs(spark, sf):
    """The same methods under three injection seeds, evaluated as one table."""
    pts = points(spark, sf)
    parts_s, parts_l = [], []
    for seed in SEEDS:
        out, positives = protocol.inject_track_anomalies(pts, FRACTION, seed)
        labels = protocol.complete_labels(protocol.track_keys(out), positives, seed)
        features = motion.handcrafted_features(out)
        scores = ranks.melt(features, ["sample_id"], METHODS).select(
            F.concat_ws("|", F.lit(str(seed)), "sample_id").alias("sample_id"),
            F.col("component").alias("method"),
            F.lit(seed).alias("seed"),
            F.round("value", 9).alias("score"),
        )
        parts_s.append(scores)
        parts_l.append(labels.select(F.concat_ws("|", F.lit(str(seed)), "sample_id").alias("sample_id"), "label"))
    scores, labels = materialize(report.stack_tables(parts_s)), materialize(report.stack_tables(parts_l))
    aligned = scores.join(labels, "sample_id")
    return materialize(evaluate.curve_metrics(aligned, ["method", "seed"]))


def _seed_sql(seed: int) -> str:
    """Curve figures of every method under one injection seed."""
    ctes = [c.replace("'42:", f"'{seed}:") for c in [*_INJECTED, sql.STEPS, sql.HANDCRAFTED, *sql.SIMPLE[len(sql.MOTION) :]]]
    ctes.append(_SCORES.removesuffix(")") + " UNION ALL SELECT sample_id, 'simple', round(score, 9) FROM ind)")
    columns = f"""{seed}::INT AS seed, method, sum(pos * ((total - p) - (predicted - tp) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))) AS auroc, sum(pos * tp / predicted) / max(p) AS auprc,
        arg_max(2.0::DOUBLE * tp / (predicted + p), (round(2.0::DOUBLE * tp / (predicted + p), 12), score)) AS f1, max(p)::BIGINT AS num_positive, max(total)::BIGINT AS num_total"""
    return "SELECT * FROM (WITH " + ",\n".join([*ctes, _ALIGNED, _CURVE]) + f" SELECT {columns} FROM cur GROUP BY method) s{seed}"


_RUNS = "runs AS MATERIALIZED (" + " UNION ALL ".join(_seed_sql(s) for s in SEEDS) + ")"
_THREE = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in ("auroc", "auprc", "f1"))
_SUMMARY = f"""summary AS (SELECT method, count(*) AS num_runs, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds, {_THREE} FROM runs
  WHERE method IN ({", ".join(repr(m) for m in METHODS)}) GROUP BY method)"""


@query(
    "matrix_run",
    select("'track' AS level, seed, method, ~auroc, ~auprc, ~f1, num_positive, num_total", "runs", [_RUNS]),
)
def matrix_run(spark, sf):
    """Registered detectors under three seeds, scores committed part by part, metrics in one job."""
    folder = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    named = {"track": {"simple": ("simple", {}), **{m: ("feature", {"column": m}) for m in METHODS}}}
    matrix.run({"track": points(spark, sf)}, named, SEEDS, folder, FRACTION)
    return matrix.metrics(spark, folder).select("level", "seed", "method", "auroc", "auprc", "f1", "num_positive", "num_total")


@query(
    "seed_summary",
    select(
        "method, num_runs, seeds, ~auroc_mean, ~auroc_std, ~auprc_mean, ~auprc_std, ~f1_mean, ~f1_std", "summary", [_RUNS, _SUMMARY]
    ),
)
def seed_summary(spark, sf):
    return report.seed_summary(seed_runs(spark, sf), ["auroc", "auprc", "f1"], ["method"])


@query(
    "best_by_metric",
    select(
        "metric, method, num_runs, ~mean, ~std",
        "("
        + " UNION ALL ".join(
            f"(SELECT '{m}' AS metric, method, num_runs, {m}_mean AS mean, {m}_std AS std FROM summary ORDER BY {m}_mean DESC, method LIMIT 1)"
            for m in ("auroc", "auprc", "f1")
        )
        + ") b",
        [_RUNS, _SUMMARY],
    ),
)
def best_by_metric(spark, sf):
    summary = report.seed_summary(seed_runs(spark, sf), ["auroc", "auprc", "f1"], ["method"])
    return report.best_by_metric(summary, ["auroc", "auprc", "f1"])


@query(
    "report_table",
    select(
        "method, " + ", ".join(f"format('{{:.4f}} +/- {{:.4f}}', {m}_mean, {m}_std) AS {m}" for m in ("auroc", "auprc", "f1")),
        "summary",
        [_RUNS, _SUMMARY],
    ),
)
def report_table(spark, sf):
    summary = report.seed_summary(seed_runs(spark, sf), ["auroc", "auprc", "f1"], ["method"])
    return report.report_table(report.rank_rows(summary), ["auroc", "auprc", "f1"])


@query("event_f1")
def event_f1(spark, sf):
    """Evidence segments of disturbed tracks against the injected intervals."""
    pts, labels = injected(spark, sf)
    rows = materialize(motion.track_steps(pts))
    evidence = materialize(segments.frame_evidence(rows, rows))
    found = segments.event_segments(evidence).select(
        "sequence",
        "track_id",
        "frame_start",
        "frame_end",
        F.concat_ws("@", "sample_id", F.format_string("%08d", "frame_start")).alias("event_id"),
    )
    truth = labels.select("sequence", "track_id", "frame_start", "frame_end", F.col("sample_id").alias("event_id"))
    return events.event_f1(materialize(found), truth)


# ------------------------------------------------------------------ maps and timelines
def track_scores(spark, sf):
    return materialize(
        detectors.simple_track_scores(points(spark, sf), with_events=False).select("sample_id", "sequence", "track_id", "score")
    )


@query(
    "heat_grid",
    select(
        """f.sequence, least(floor(least(greatest(cx, 0.0), 299.0) / 300.0 * 32), 31)::INT AS grid_x,
        least(floor(least(greatest(cy, 0.0), 99.0) / 100.0 * 24), 23)::INT AS grid_y, ~sum(score / n) AS mass, count(*) AS points""",
        "fused f JOIN ind USING (sample_id) JOIN (SELECT sample_id, count(*) AS n FROM fused GROUP BY ALL) c USING (sample_id)",
        sql.SIMPLE,
        "GROUP BY ALL",
    ),
)
def heat_grid(spark, sf):
    return report.heat_grid(points(spark, sf), track_scores(spark, sf), 300.0, 100.0, 32, 24)


@query(
    "sequence_mass",
    select(
        "sequence, count(*) AS num_tracks, ~sum(score) AS total_mass, ~avg(score) AS mean_score",
        "ind",
        sql.SIMPLE,
        "GROUP BY sequence",
    ),
)
def sequence_mass(spark, sf):
    return report.sequence_mass(track_scores(spark, sf))


_TOP80 = """top80 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY score DESC, sample_id) AS rank, max(score) OVER (PARTITION BY sequence) AS top FROM ind) r)"""


@query(
    "frame_mass",
    select(
        "f.sequence, frame_id, ~sum(score / n) AS mass",
        "fused f JOIN top80 USING (sample_id) JOIN (SELECT sample_id, count(*) AS n FROM fused GROUP BY ALL) c USING (sample_id)",
        [*sql.SIMPLE, _TOP80],
        "GROUP BY f.sequence, frame_id",
    ),
)
def frame_mass(spark, sf):
    return report.frame_mass(points(spark, sf), track_scores(spark, sf))


@query(
    "playback_stats",
    select(
        """sample_id, t.sequence, rank::INT AS rank, ~score, ~score / greatest(top, 1e-6) AS score_ratio, first_frame, last_frame, last_frame - first_frame + 1 AS duration,
        ~avg_confidence, ~confidence_drop, ~max_modal_offset, ~path_length, ~avg_speed, ~max_speed, 0.58::DOUBLE AS source_coverage,
        ~max_speed / (max_speed + 6) AS motion, ~max_modal_offset / (max_modal_offset + 8) AS modal, ~least(confidence_drop * 2, 1.0) AS confidence""",
        """top80 t JOIN (SELECT sample_id, min(frame_id) AS first_frame, max(frame_id) AS last_frame, avg(round(confidence, 4)) AS avg_confidence,
             max(round(confidence, 4)) - min(round(confidence, 4)) AS confidence_drop, max(modal_offset) AS max_modal_offset, coalesce(sum(step), 0) AS path_length,
             coalesce(avg(speed), 0) AS avg_speed, coalesce(max(speed), 0) AS max_speed FROM steps GROUP BY ALL) s USING (sample_id)""",
        [*sql.SIMPLE, _TOP80],
    ),
)
def playback_stats(spark, sf):
    scores = track_scores(spark, sf).withColumn("used_sources", F.lit("individual"))
    return report.playback_stats(steps(spark, sf), scores)


@query(
    "modality_audit",
    select(
        """sequence, count(DISTINCT sample_id) AS track_count, count(*) AS point_count, count(*) FILTER (rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) AS fused_points,
        count(rgb_cx) AS rgb_points, count(thermal_cx) AS thermal_points, ~count(*) FILTER (rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) / count(*) AS fused_coverage,
        ~count(rgb_cx) / count(*) AS rgb_coverage, ~count(thermal_cx) / count(*) AS thermal_coverage,
        CASE WHEN count(rgb_cx) < count(*) OR count(thermal_cx) < count(*) THEN 'partial_modality' ELSE 'ok' END AS status""",
        "obs",
        sql.BASE,
        "GROUP BY sequence",
    ),
)
def modality_audit(spark, sf):
    return report.modality_audit(observations(spark, sf))


@query(
    "convergence",
    """WITH RECURSIVE o AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS epoch,
      CASE WHEN o_orderkey % 4 = 0 OR o_custkey % 17 = 0 THEN NULL ELSE o_totalprice::DOUBLE END AS value FROM orders),
    l AS (SELECT run, max(epoch) AS final_epoch FROM o GROUP BY run),
    f AS (SELECT run, epoch, value, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM o WHERE value IS NOT NULL),
    b AS (SELECT run, i, epoch AS be, value AS bv FROM f WHERE i = 1
      UNION ALL SELECT b.run, f.i, CASE WHEN f.value < least(bv * 0.999, bv - 0.001) THEN f.epoch ELSE be END,
        CASE WHEN f.value < least(bv * 0.999, bv - 0.001) THEN f.value ELSE bv END FROM b JOIN f ON f.run = b.run AND f.i = b.i + 1),
    e AS (SELECT run, max_by(be, i) AS be, max_by(bv, i) AS bv FROM b GROUP BY run)
    SELECT l.run, final_epoch, be AS best_epoch, round(bv, 6) + 0.0 AS best_value, final_epoch - be AS epochs_since_best,
      CASE WHEN be IS NULL THEN 'no-loss-history' WHEN final_epoch < 12 THEN 'early-stopped' WHEN final_epoch - be >= 5 THEN 'converged'
        ELSE 'max-budget-not-converged' END AS status FROM l LEFT JOIN e USING (run)""",
)
def convergence(spark, sf):
    """Order totals of a customer, in order of date, stand for a loss log; a quarter are not finite, some logs have none that is."""
    from trackloom.operators.scale import row_positions
    from trackloom.sources.tables import read_table

    orders = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"),
        "o_orderkey",
        "o_orderdate",
        F.when((F.col("o_orderkey") % 4 == 0) | (F.col("o_custkey") % 17 == 0), F.when(F.col("o_orderkey") % 8 == 0, float("nan")).otherwise(float("-inf")))
        .otherwise(F.col("o_totalprice").cast("double"))
        .alias("value"),
    )
    placed = row_positions(orders, ["run"], [("o_orderdate", True), ("o_orderkey", True)])
    return report.convergence(placed.select("run", (F.col("position") + 1).cast("int").alias("epoch"), "value"), 12)


@query(
    "fingerprint",
    select(
        "sum(n)::BIGINT AS num_rows, sha256(string_agg(b || ':' || n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3 || ':' || s4 || ':' || s5 || ':' || s6 || ':' || s7, ';' ORDER BY b)) AS fingerprint",
        "(SELECT substr(h, 1, 2) AS b, count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::BIGINT AS s{i}" for i in range(8)) + """
          FROM (SELECT sha256(sequence || '|' || track_id || '|' || frame_id || '|' || event_id) AS h FROM obs) d GROUP BY ALL) p""",
        sql.BASE,
    ),
)
def fingerprint(spark, sf):
    return report.fingerprint(observations(spark, sf), ["sequence", "track_id", "frame_id", "event_id"])


# ------------------------------------------------------------------ explanations
@query(
    "strongest_detector",
    select(
        """sample_id, CASE WHEN max_speed >= mean_turn_angle AND max_speed >= modal_offset_mean THEN 'max_speed'
             WHEN mean_turn_angle >= modal_offset_mean THEN 'mean_turn_angle' ELSE 'modal_offset_mean' END AS top_detector,
           ~greatest(max_speed, mean_turn_angle, modal_offset_mean) AS top_detector_score,
           array_to_string(list_transform(list_reverse_sort([{'v': max_speed, 'i': 0, 'n': 'max_speed'}, {'v': mean_turn_angle, 'i': -1, 'n': 'mean_turn_angle'},
             {'v': modal_offset_mean, 'i': -2, 'n': 'modal_offset_mean'}]), lambda e: printf('%s=%.6f', e.n, e.v)), '; ') AS detector_breakdown""",
        "(SELECT sample_id, r_max_speed AS max_speed, r_mean_turn_angle AS mean_turn_angle, r_modal_offset_mean AS modal_offset_mean FROM rr) z",
        [*sql.MOTION, sql.HANDCRAFTED, sql.rank01("rr", "hand", "sample_id", METHODS, "sample_id")],
    ),
)
def strongest_detector(spark, sf):
    ranked = ranks.rank01(motion.handcrafted_features(points(spark, sf)), ["sample_id"], METHODS, ["sample_id"])
    return report.strongest_detector(ranked.select("sample_id", *[F.col(f"r_{m}").alias(m) for m in METHODS]), METHODS)


@query(
    "ranked_components",
    select(
        "sample_id, pos AS place, name, ~value AS value, family",
        """(SELECT sample_id, name, value, CASE WHEN name LIKE 'S\\_%' ESCAPE '\\' THEN 'fusion' ELSE 'individual' END AS family,
              CASE WHEN agg = 0 AND rn = 1 THEN 1 WHEN agg = 1 AND rn = 1 THEN 2 WHEN agg = 0 THEN rn + 1 ELSE rn + 4 END AS pos
            FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, agg ORDER BY CASE WHEN name = 'S_event' THEN 0 ELSE 1 END, -abs(value), name) AS rn
                  FROM (SELECT sample_id, unnest(['individual_speed_spike', 'individual_turn_irregularity', 'individual_low_confidence_ratio', 'individual_modal_offset_median', 'S_event', 'S_fused']) AS name,
                               unnest([round(n_speed_spike, 6), round(n_turn_irregularity, 6), round(n_low_confidence_ratio, 6), round(n_modal_offset_median, 6), round(event_score, 6), round(score, 6)]) AS value,
                               unnest([0, 0, 0, 0, 1, 1]) AS agg
                        FROM ind JOIN (SELECT sample_id, max(score) AS event_score FROM evidence GROUP BY sample_id) e USING (sample_id)) u) v) w""",
        [*sql.SIMPLE, sql.EVIDENCE],
        "WHERE pos <= 5",
    ),
)
def ranked_components(spark, sf):
    scores = detectors.simple_track_scores(points(spark, sf))
    names = list(segments.WEIGHTS)
    components = F.create_map(
        *[x for n in names for x in (F.lit(f"individual_{n}"), F.col(f"n_{n}"))],
        F.lit("S_event"),
        F.col("event_score"),
        F.lit("S_fused"),
        F.col("score"),
    )
    ranked = scores.select("sample_id", F.posexplode(report.ranked_components(components)).alias("place", "e"))
    return ranked.select(
        "sample_id", (F.col("place") + 1).cast("long").alias("place"), "e.name", "e.value", "e.family"
    )


@query(
    "score_decomposition",
    select(
        """sample_id, ~CASE WHEN s_ind = 0 AND ri IS NOT NULL AND rg IS NOT NULL THEN ri ELSE s_ind END AS s_ind,
        ~CASE WHEN s_grp = 0 AND ri IS NOT NULL AND rg IS NOT NULL THEN rg ELSE s_grp END AS s_grp, ~s_event, ~score AS s_fused""",
        "fusedscores LEFT JOIN (SELECT sample_id, score AS ri FROM inds) a USING (sample_id) LEFT JOIN (SELECT sample_id, score AS rg FROM grp) b USING (sample_id)",
        [*sql.SIMPLE, sql.EVIDENCE, sql.WINDOWS, sql.PREDICTION, *sql.FUSED_SCORES],
    ),
)
def score_decomposition(spark, sf):
    obs = observations(spark, sf)
    ind = materialize(detectors.simple_track_scores(points(spark, sf)))
    grp = materialize(windows.aggregate_to_tracks(windows.linear_prediction(windows.window_points(obs))))
    fused = detectors.fuse_scores(ind, grp)
    rows = (
        fused.join(ind.select("sample_id", F.col("score").alias("individual_raw")), "sample_id", "left")
        .join(grp.select("sample_id", F.col("score").alias("group_raw")), "sample_id", "left")
        .select(
            "sample_id",
            F.create_map(
                F.lit("S_ind"), "s_ind", F.lit("S_grp"), "s_grp", F.lit("S_event"), "s_event", F.lit("S_fused"), "score"
            ).alias("components"),
            "used_sources",
            "score",
            F.col("s_event").alias("event_score"),
            "individual_raw",
            "group_raw",
        )
    )
    return report.score_decomposition(rows)


# ------------------------------------------------------------------ sets and sampling
@query(
    "top_sequences",
    select(
        "sequence, min(part) AS part",
        """((SELECT sequence, 0 AS part FROM ind GROUP BY sequence ORDER BY sum(score) DESC, sequence LIMIT 3)
            UNION ALL (SELECT sequence, 1 FROM ind ORDER BY score DESC, sample_id LIMIT 10)) u""",
        sql.SIMPLE,
        "GROUP BY sequence",
    ),
)
def top_sequences(spark, sf):
    scores = track_scores(spark, sf)
    return report.top_sequences(report.sequence_mass(scores), scores, 3)


@query(
    "evenly_spaced_frames",
    select(
        "sequence, frame_id, position",
        """(SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY frame_id) - 1 AS position, count(*) OVER (PARTITION BY sequence) AS n
            FROM (SELECT DISTINCT sequence, frame_id FROM obs) d) f""",
        sql.BASE,
        "WHERE n <= 12 OR list_contains(list_transform(range(12), lambda i: round_even(i * (n - 1) / 11.0::DOUBLE, 0)::BIGINT), position)",
    ),
)
def evenly_spaced_frames(spark, sf):
    frames = observations(spark, sf).select("sequence", "frame_id").distinct()
    return report.evenly_spaced(frames, "frame_id", "sequence", 12)


@query(
    "first_wins_tracks",
    select(
        "sample_id, sequence, track_id, n, source",
        """(SELECT sample_id, sequence, track_id, count(*) AS n, 'rgb' AS source FROM obs WHERE rgb_cx IS NOT NULL GROUP BY ALL
            UNION ALL SELECT sample_id, sequence, track_id, count(*), 'thermal' FROM obs WHERE thermal_cx IS NOT NULL AND sample_id NOT IN
              (SELECT sample_id FROM obs WHERE rgb_cx IS NOT NULL) GROUP BY ALL) u""",
        sql.BASE,
    ),
)
def first_wins_tracks(spark, sf):
    obs = observations(spark, sf)
    keys = ["sample_id", "sequence", "track_id"]
    parts = [
        obs.where(F.col(f"{m}_cx").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(m))
        for m in ("rgb", "thermal")
    ]
    return report.first_wins(parts, keys)


@query(
    "key_union_and_intersection",
    select(
        "count(*) AS num_union, count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL) AS num_both",
        "obs",
        sql.BASE,
        "WHERE rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL",
    ),
)
def key_union_and_intersection(spark, sf):
    obs = materialize(observations(spark, sf))
    keys = ["sequence", "track_id", "frame_id"]
    rgb, thermal = (obs.where(F.col(f"{m}_cx").isNotNull()).select(*keys) for m in ("rgb", "thermal"))
    union, both = rgb.union(thermal).distinct(), rgb.intersect(thermal)
    tagged = union.select(F.lit(1).alias("u"), F.lit(0).alias("b")).unionByName(
        both.select(F.lit(0).alias("u"), F.lit(1).alias("b"))
    )
    return tagged.agg(F.sum("u").alias("num_union"), F.sum("b").alias("num_both"))


@query(
    "key_differences",
    select(
        "sample_id, frame_id, CASE WHEN rgb_cx IS NULL THEN 'missing' ELSE 'extra' END AS side",
        "obs",
        sql.BASE,
        "WHERE (rgb_cx IS NULL) <> (thermal_cx IS NULL)",
    ),
)
def key_differences(spark, sf):
    """Keys only the thermal (missing) or only the RGB sensor (extra) has."""
    obs = materialize(observations(spark, sf))
    rgb, thermal = (
        obs.where(F.col(f"{m}_cx").isNotNull()).select("sample_id", "frame_id") for m in ("rgb", "thermal")
    )
    return thermal.subtract(rgb).withColumn("side", F.lit("missing")).unionByName(
        rgb.subtract(thermal).withColumn("side", F.lit("extra"))
    )


@query(
    "stacked_tables",
    select(
        "*",
        """(SELECT sample_id, 'track' AS kind, round(score, 6) + 0.0 AS score, NULL::BIGINT AS num_windows FROM ind
            UNION ALL SELECT sample_id, 'window', round(max(score), 6), count(*) FROM pred GROUP BY sample_id) u""",
        [*sql.SIMPLE, sql.WINDOWS, sql.PREDICTION],
    ),
)
def stacked_tables(spark, sf):
    a = track_scores(spark, sf).select("sample_id", F.lit("track").alias("kind"), "score")
    predicted = windows.linear_prediction(windows.window_points(observations(spark, sf)))
    b = windows.aggregate_to_tracks(predicted).select("sample_id", F.lit("window").alias("kind"), "score", "num_windows")
    return report.stack_tables([a, b])


@query(
    "normalize_labels",
    select(
        """doc_id::VARCHAR AS sample_id, doc_id::VARCHAR AS sequence, doc_id::VARCHAR AS track_id, toxic AS label,
        CASE WHEN toxic = 1 THEN 'real_anomaly' ELSE 'normal' END AS anomaly_type, NULL::VARCHAR AS problem""",
        "labels",
        [],
    ),
)
def normalize_labels(spark, sf):
    from trackloom.sources.tables import read_table

    spelled = read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("object_id"),
        F.when(F.col("toxic") == 1, F.lit(" Abnormal")).otherwise(F.lit("NO ")).alias("is_anomaly"),
        F.lit("").alias("sample_id"),
    )
    aliases = {
        "sample_id": ["sample_id", "object_id"],
        "sequence": ["sequence"],
        "track_id": ["track_id"],
        "label": ["label", "is_anomaly"],
        "anomaly_type": ["anomaly_type"],
    }
    return report.normalize_labels(spelled, aliases)


@query(
    "normalize_sequence_names",
    select(
        """DISTINCT url, regexp_replace(regexp_replace(trim(replace(url || '\\01', '\\', '/')), '^/+|/+$', '', 'g'), '/(00|01)$', '') AS name""",
        "pages",
        [],
    ),
)
def normalize_sequence_names(spark, sf):
    from trackloom.sources.tables import read_table

    pages = read_table(spark, sf, "pages").select("url").distinct()
    return pages.select("url", report.normalize_sequence_name(F.concat("url", F.lit("\\01"))).alias("name"))


@query(
    "summarize_top",
    select(
        "sequence, count(*) AS top_k_count, ~avg(mean_score) AS mean_of_mean_score, ~avg(max_score) AS mean_of_max_score",
        """(SELECT sequence, sample_id, (r_max_speed + r_mean_turn_angle + r_modal_offset_mean) / 3 AS mean_score,
                   greatest(r_max_speed, r_mean_turn_angle, r_modal_offset_mean) AS max_score FROM rr ORDER BY round((r_max_speed + r_mean_turn_angle + r_modal_offset_mean) / 3, 9) DESC, sample_id LIMIT 50) t""",
        [*sql.MOTION, sql.HANDCRAFTED, sql.rank01("rr", "hand", "sample_id, sequence", METHODS, "sample_id")],
        "GROUP BY sequence",
    ),
)
def summarize_top(spark, sf):
    ranked = ranks.rank01(
        motion.handcrafted_features(points(spark, sf)), ["sample_id", "sequence"], METHODS, ["sample_id"]
    )
    columns = [F.col(f"r_{m}") for m in METHODS]
    rows = ranked.select(
        "sample_id",
        "sequence",
        F.round((columns[0] + columns[1] + columns[2]) / 3, 9).alias("mean_score"),
        F.greatest(*columns).alias("max_score"),
    )
    return report.summarize_top(rows, "sequence", 50)


# ------------------------------------------------------------------ tracking, graph score and ensembles
_COMPONENTS = """sym AS (SELECT window_id, frame_id, "left" AS a, "right" AS b FROM edges UNION ALL SELECT window_id, frame_id, "right", "left" FROM edges),
reach AS (SELECT window_id, frame_id, track_id AS a, track_id AS b FROM wm
  UNION SELECT r.window_id, r.frame_id, r.a, s.b FROM reach r JOIN sym s ON r.window_id = s.window_id AND r.frame_id = s.frame_id AND r.b = s.a),
fg AS (SELECT window_id, frame_id, a AS track_id, min(b) AS component FROM reach GROUP BY ALL)"""
_OVERLAPS = """fi AS (SELECT window_id, frame_id, row_number() OVER (PARTITION BY window_id ORDER BY frame_id) AS i FROM (SELECT DISTINCT window_id, frame_id FROM fg) f),
pl AS (SELECT * FROM fg JOIN fi USING (window_id, frame_id)),
sz AS (SELECT window_id, frame_id, i, component, count(*) AS size FROM pl GROUP BY ALL),
sh AS (SELECT a.window_id, a.i, a.component, b.component AS previous, count(*) AS c FROM pl a JOIN pl b
  ON a.window_id = b.window_id AND a.track_id = b.track_id AND b.i = a.i - 1 GROUP BY ALL),
mt AS (SELECT sh.* FROM sh JOIN sz x ON x.window_id = sh.window_id AND x.i = sh.i AND x.component = sh.component
  JOIN sz y ON y.window_id = sh.window_id AND y.i = sh.i - 1 AND y.component = sh.previous WHERE c::DOUBLE / (x.size + y.size - c) >= 0.3)"""


def _recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("frame_groups", _recursive(select("window_id, frame_id, track_id, component", "fg", [*_GROUP, _EDGES, _COMPONENTS])))
def frame_groups(spark, sf):
    pts = moving_points(spark, sf)
    return tracking.frame_groups(pts, neighbours.knn_edges(pts, 3, 30.0, 60.0))


@query(
    "group_overlaps",
    _recursive(
        select(
            "s.window_id, s.frame_id, s.component, s.size, (SELECT count(*) FROM mt WHERE mt.window_id = s.window_id AND mt.i = s.i AND mt.component = s.component)::INT AS num_matches",
            "sz s",
            [*_GROUP, _EDGES, _COMPONENTS, _OVERLAPS],
        )
    ),
)
def group_overlaps(spark, sf):
    found = tracking.group_overlaps(materialize(frame_groups(spark, sf)))
    return found.select("window_id", "frame_id", "component", "size", F.size(F.coalesce("matches", F.array())).alias("num_matches"))


# One step names one group of every window: its best match whose id is free in the frame, else the next number.
_NAMED = """od AS MATERIALIZED (SELECT s.window_id, s.frame_id, s.i, s.component, row_number() OVER (PARTITION BY s.window_id ORDER BY s.i, s.component) AS step,
    (SELECT list({'o': -overlap, 'p': previous}) FROM mt WHERE mt.window_id = s.window_id AND mt.i = s.i AND mt.component = s.component) AS ms FROM sz s),
nm AS (SELECT window_id, 0::BIGINT AS step, 0::BIGINT AS i, 0::BIGINT AS cnt, MAP {}::MAP(VARCHAR, VARCHAR) AS prev, MAP {}::MAP(VARCHAR, VARCHAR) AS cur, NULL::INT AS frame_id, NULL::VARCHAR AS component, NULL::VARCHAR AS gid
    FROM (SELECT DISTINCT window_id FROM od) w
  UNION ALL
  SELECT window_id, step, i, CASE WHEN best IS NULL THEN cnt + 1 ELSE cnt END, prev, map_concat(cur, MAP([component], [coalesce(best, 'g' || (cnt + 1))])), frame_id, component, coalesce(best, 'g' || (cnt + 1))
  FROM (SELECT *, list_sort(list_filter(list_transform(coalesce(ms, []), lambda m: {'o': m.o, 'g': prev[m.p]}), lambda x: NOT list_contains(map_values(cur), x.g)))[1].g AS best
    FROM (SELECT od.window_id, od.step, od.i, nm.cnt, od.ms, od.frame_id, od.component, CASE WHEN od.i = nm.i THEN nm.prev ELSE nm.cur END AS prev,
            CASE WHEN od.i = nm.i THEN nm.cur ELSE MAP {}::MAP(VARCHAR, VARCHAR) END AS cur FROM nm JOIN od ON od.window_id = nm.window_id AND od.step = nm.step + 1) j) k),
nt AS MATERIALIZED (SELECT window_id, i, frame_id, component, gid FROM nm WHERE step > 0),
mg AS MATERIALIZED (SELECT mt.window_id, a.frame_id, mt.component, a.gid AS target, b.gid AS source FROM mt JOIN nt a ON a.window_id = mt.window_id AND a.i = mt.i AND a.component = mt.component
    JOIN nt b ON b.window_id = mt.window_id AND b.i = mt.i - 1 AND b.component = mt.previous),
ev AS MATERIALIZED (SELECT window_id, frame_id, 'merge' AS event_type, list(source ORDER BY source) AS sources, [target] AS targets FROM mg GROUP BY window_id, frame_id, component, target HAVING count(*) > 1
  UNION ALL SELECT window_id, frame_id, 'split', [source], list(target ORDER BY component) FROM mg GROUP BY window_id, frame_id, source HAVING count(*) > 1)"""
_IDENTITY = [*_GROUP, _EDGES, _COMPONENTS, _OVERLAPS.replace("SELECT sh.* FROM", "SELECT sh.*, c::DOUBLE / (x.size + y.size - c) AS overlap FROM"), _NAMED]


@query(
    "track_groups",
    _recursive(
        select(
            "nt.window_id, nt.frame_id, component, gid AS group_id, f.id IS NOT NULL AS split_merge",
            """nt LEFT JOIN (SELECT DISTINCT window_id, frame_id, unnest(list_concat(sources, targets)) AS id FROM ev) f
                ON f.window_id = nt.window_id AND f.frame_id = nt.frame_id AND f.id = nt.gid""",
            _IDENTITY,
        )
    ),
)
def track_groups(spark, sf):
    return tracking.track_groups(materialize(frame_groups(spark, sf)))


@query(
    "group_events",
    _recursive(
        select("window_id, frame_id, event_type, array_to_string(sources, ',') AS sources, array_to_string(targets, ',') AS targets", "ev", _IDENTITY)
    ),
)
def group_events(spark, sf):
    found = tracking.group_events(materialize(frame_groups(spark, sf)))
    return found.withColumns({c: F.concat_ws(",", c) for c in ("sources", "targets")})


def _graph_scores(pts):
    return tracking.graph_track_scores(tracking.graph_frame_scores(pts, 3, 30.0, 60.0))


@query("graph_group_scores")
def graph_group_scores(spark, sf):
    return _graph_scores(moving_points(spark, sf))


@query("hybrid_scores")
def hybrid_scores(spark, sf):
    """Prediction, graph and window-profile ranks of the validation windows, fused."""
    pts = moving_points(spark, sf)
    train, score = train_score(spark, sf, groups.group_features(pts))
    val = pts.join(score.select("window_id").distinct(), "window_id", "left_semi")
    temporal = detectors.nearest_profile_scores(train, score, groups.GROUP_FEATURES, "window_id", k=3)
    predicted = windows.linear_prediction(val).select("window_id", "sample_id", F.col("score").alias("prediction"))
    graph = _graph_scores(materialize(val)).select("window_id", "sample_id", F.col("score").alias("graph"))
    table = (
        predicted.join(graph, ["window_id", "sample_id"], "left")
        .join(temporal.withColumnRenamed("score", "temporal"), "window_id", "left")
        .na.fill(0.0, ["graph", "temporal"])
    )
    ranked = ranks.rank01(
        table, ["sample_id", "window_id"], ["prediction", "graph", "temporal"], ["sample_id", "window_id"], inverse=["graph", "temporal"]
    )
    return detectors.hybrid_rank_fusion(ranked, gate=True, gate_floor=0.2)


@query("isolation_forest", select("sample_id, ~score", "iso", [*sql.MOTION, sql.HANDCRAFTED, sql.SPLIT, *sql.isolation("iso", "hand", "sample_id", motion.HANDCRAFTED)]))
def isolation_forest(spark, sf):
    train, score = train_score(spark, sf, motion.handcrafted_features(points(spark, sf)))
    return ensembles.isolation_scores(train, score, motion.HANDCRAFTED)


@query("pca_residuals")
def pca_residuals(spark, sf):
    pts = moving_points(spark, sf)
    signatures = groups.frame_signatures(pts, materialize(neighbours.neighbour_stats(pts)))
    rows = signatures.withColumn("sequence", F.substring_index("window_id", ":", 1))
    train, score = train_score(spark, sf, rows)
    errors = ensembles.pca_residuals(train, score, groups.SIGNATURES, ["window_id", "neighbor_churn", "dispersion"])
    return errors.groupBy("window_id").agg(
        F.avg("error").alias("score"), F.avg("neighbor_churn").alias("churn"), F.avg("dispersion").alias("dispersion")
    )


_TRIO = ["nearest", "lof", "isolation"]


@query(
    "rank_ensemble",
    select(
        "sample_id, ~r_nearest, ~r_lof, ~r_isolation, ~r_nearest * 0.4::DOUBLE + r_lof * 0.35::DOUBLE + r_isolation * 0.25::DOUBLE AS score",
        "ens",
        [
            *sql.MOTION, sql.HANDCRAFTED, sql.SPLIT,
            *sql.knn("e1", "hand", "sample_id", motion.HANDCRAFTED, 1),
            *sql.lof("e2", "hand", "sample_id", motion.HANDCRAFTED, 20),
            *sql.isolation("e3", "hand", "sample_id", motion.HANDCRAFTED),
            "trio AS MATERIALIZED (SELECT sample_id, " + ", ".join(f"round(e{k + 1}.score, 9) AS {n}" for k, n in enumerate(_TRIO)) + " FROM e1 JOIN e2 USING (sample_id) JOIN e3 USING (sample_id))",
            sql.rank01("ens", "trio", "sample_id", _TRIO, "sample_id"),
        ],
    ),
)
def rank_ensemble(spark, sf):
    train, score = train_score(spark, sf, motion.handcrafted_features(points(spark, sf)))
    return ensembles.rank_ensemble(train, score, motion.HANDCRAFTED)


def _modal_sql(name: str, columns: list[str]) -> list[str]:
    """Mean distance of validation rows from the training median in MADs, over the columns that have one."""
    median = ", ".join(f"median({c}) AS m_{c}" for c in columns)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in columns)
    total = " + ".join(f"CASE WHEN d_{c} > 0 THEN abs({c} - m_{c}) / d_{c} ELSE 0 END" for c in columns)
    used = " + ".join(f"(d_{c} > 0)::INT" for c in columns)
    return [
        f"{name}_tv AS (SELECT * FROM hand JOIN split USING (sequence))",
        f"{name}_m AS (SELECT {median} FROM {name}_tv WHERE split = 'train')",
        f"{name}_d AS (SELECT {mad} FROM {name}_tv, {name}_m WHERE split = 'train')",
        f"{name} AS (SELECT sample_id, CASE WHEN {used} = 0 THEN 0 ELSE ({total}) / ({used}) END AS score FROM {name}_tv, {name}_m, {name}_d WHERE split = 'val')",
    ]


@query(
    "complementary_scores",
    select(
        "sample_id, ~avg(r) AS score",
        """(SELECT sample_id, CASE WHEN max(v) OVER p <= min(v) OVER p THEN 0 ELSE (rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2 - 1) / (count(*) OVER p - 1) END AS r
            FROM four WINDOW p AS (PARTITION BY c)) x""",
        [
            *sql.MOTION, sql.HANDCRAFTED, sql.SPLIT,
            *sql.knn("c1", "hand", "sample_id", ensembles.SUBSPACES["route"], 1),
            *sql.isolation("c2", "hand", "sample_id", ensembles.SUBSPACES["speed"]),
            *sql.lof("c3", "hand", "sample_id", ensembles.SUBSPACES["shape"], 1),
            *_modal_sql("c4", ensembles.SUBSPACES["modal"]),
            "four AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT sample_id, {k} AS c, round(score, 9) AS v FROM c{k}" for k in (1, 2, 3, 4)) + ")",
        ],
        "GROUP BY sample_id",
    ),
)
def complementary_scores(spark, sf):
    train, score = train_score(spark, sf, motion.handcrafted_features(points(spark, sf)))
    return ensembles.complementary_scores(train, score)


_DETECTORS = ["max_speed", "mean_turn_angle", "modal_offset_mean", "path_length"]


def detector_table(spark, sf):
    """Detector scores in long form; each detector lacks the tracks it is blind to (score 0)."""
    features = motion.handcrafted_features(points(spark, sf))
    long = ranks.melt(features, ["sample_id"], _DETECTORS).withColumn("value", F.round("value", 9))
    return ensembles.align_detectors(materialize(long.where("value > 0")), _DETECTORS)


_DET = [
    *sql.MOTION,
    sql.HANDCRAFTED,
    "detl AS (" + " UNION ALL ".join(f"SELECT sample_id, '{d}' AS c, round({d}, 9) AS v FROM hand WHERE round({d}, 9) > 0" for d in _DETECTORS) + ")",
    "dett AS (SELECT sample_id, "
    + ", ".join(f"coalesce(max(v) FILTER (c = '{d}'), (SELECT median(v) FROM detl WHERE c = '{d}')) AS {d}" for d in _DETECTORS)
    + " FROM detl GROUP BY sample_id)",
    "deti AS (SELECT sample_id, "
    + ", ".join(f"1 / (rank() OVER (ORDER BY {d} DESC) + (count(*) OVER (PARTITION BY {d}) - 1) / 2) AS {d}" for d in _DETECTORS)
    + " FROM dett)",
]


@query("align_detectors", select("sample_id, " + ", ".join(f"~{d}" for d in _DETECTORS), "dett", _DET))
def align_detectors(spark, sf):
    return detector_table(spark, sf)


@query(
    "mean_max_ensemble",
    select(
        f"sample_id, ~({' + '.join(_DETECTORS)}) / 4 AS mean_score, ~greatest({', '.join(_DETECTORS)}) AS max_score", "deti", _DET
    ),
)
def mean_max_ensemble(spark, sf):
    return ensembles.mean_max_ensemble(materialize(detector_table(spark, sf)), _DETECTORS)


@query(
    "analysis_frame",
    select(
        "sample_id, " + ", ".join(f"~dett.{d} AS {d}" for d in _DETECTORS)
        + f""", ~({' + '.join('deti.' + d for d in _DETECTORS)}) / 4 AS mean_score, ~greatest({', '.join('deti.' + d for d in _DETECTORS)}) AS max_score,
        sequence, track_id, category_name, num_points, visible_rgb_frames, visible_thermal_frames""",
        """dett JOIN deti USING (sample_id) LEFT JOIN (SELECT sample_id, sequence, track_id, arg_min(category_name, frame_id) AS category_name, count(*) AS num_points,
          count(rgb_cx) AS visible_rgb_frames, count(thermal_cx) AS visible_thermal_frames FROM obs WHERE track_id NOT LIKE '%7' GROUP BY ALL) t USING (sample_id)""",
        _DET,
    ),
)
def analysis_frame(spark, sf):
    """Metadata of some tracks is missing, so the left joins show."""
    table = materialize(detector_table(spark, sf))
    known = observations(spark, sf).where(~F.col("track_id").endswith("7"))
    tracks = known.groupBy("sample_id", "sequence", "track_id").agg(
        F.min_by("category_name", "frame_id").alias("category_name"),
        F.count(F.lit(1)).alias("num_points"),
        F.count("rgb_cx").alias("visible_rgb_frames"),
        F.count("thermal_cx").alias("visible_thermal_frames"),
    )
    return ensembles.analysis_frame(table, ensembles.mean_max_ensemble(table, _DETECTORS), tracks)


@query("complementary_elimination")
def complementary_elimination(spark, sf):
    return ensembles.complementary_elimination(materialize(detector_table(spark, sf)), _DETECTORS, k=30)


@query(
    "top_jaccard",
    select(
        "'max_speed' AS a, o AS b, ~count(*) FILTER (n = 2) / count(*) AS jaccard",
        """(SELECT o, sample_id, count(*) AS n FROM (SELECT unnest(['mean_turn_angle', 'modal_offset_mean']) AS o) p, tops
            WHERE method IN ('max_speed', o) GROUP BY ALL) z""",
        [
            *_HAND,
            _SCORES,
            "tops AS (SELECT method, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, sample_id) AS rn FROM sc) s WHERE rn <= 60)",
        ],
        "GROUP BY o",
    ),
)
def top_jaccard(spark, sf):
    scores, _ = scored(spark, sf)
    return ensembles.top_jaccard(scores, [("max_speed", "mean_turn_angle"), ("max_speed", "modal_offset_mean")], k=60)


@query(
    "neighbourhood_loss",
    select(
        "id, ~CASE WHEN abs(m) < 1e-8 THEN dev ELSE dev / m END AS score",
        "(SELECT k.q AS id, any_value(d.dev) AS dev, avg(e.dev) AS m FROM kn k JOIN devs d ON d.q = k.q JOIN devs e ON e.q = k.n GROUP BY k.q) z",
        [
            "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS loss FROM embeddings)",
            f"kn AS (SELECT a.id AS q, b.id AS n, a.loss AS lq, b.loss AS ln FROM emb a JOIN emb b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {sql._L2}, b.id) <= 6)",
            "devs AS (SELECT q, avg(abs(lq - ln)) AS dev FROM kn GROUP BY q)",
        ],
    ),
)
def neighbourhood_loss(spark, sf):
    """The vector norm stands for a reconstruction loss."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return ensembles.neighbourhood_loss(vectors(spark, sf).select("id", "vector", norm.alias("loss")))


@query(
    "infer_level",
    select(
        """DISTINCT event_type AS method, sequence AS task,
        CASE sequence WHEN 's0' THEN 'individual' WHEN 's1' THEN 'group' WHEN 's2' THEN 'individual' WHEN 's3' THEN 'group'
          WHEN 's4' THEN 'group' WHEN 's5' THEN NULL WHEN 's6' THEN CASE WHEN event_type = 'view' THEN 'individual' WHEN event_type = 'click' THEN 'group' END
          WHEN 's7' THEN 'individual' END AS level""",
        "(SELECT event_type, 's' || (user_id % 8) AS sequence FROM events) e",
        [],
    ),
)
def infer_level(spark, sf):
    """Every word of either level, in task, method or source, alone and against each other."""
    raw = raw_detections(spark, sf).select(F.col("category_name").alias("method"), F.col("sequence").alias("task")).distinct()
    words = {
        "s0": ("x", "person_speed", "a"),
        "s1": ("x", "graph_rules", "a"),
        "s2": ("x", "single_knn", "a\\b"),
        "s3": ("x", "team_score", "a"),
        "s4": ("x", "m", "runs\\collective\\a.csv"),
        "s5": ("x", "person_team", "a"),
        "s7": ("new_individual", "graph_a", "a"),
    }
    by_method = F.when(F.col("method") == "view", F.lit("x_individual_y")).when(F.col("method") == "click", F.lit("group_a")).otherwise(
        F.col("method")
    )

    def part(i, rest):
        out = rest
        for task, named in words.items():
            out = F.when(F.col("task") == task, F.lit(named[i])).otherwise(out)
        return out

    level = report.infer_level(part(0, F.lit("x")), part(1, by_method), part(2, F.lit("a")))
    return raw.select("method", "task", level.alias("level"))
