"""Shared SQL fragments (CTEs) for the DuckDB side of the correctness check."""

RAW = """raw AS (
  SELECT sequence, track_id, sequence || ':' || track_id AS sample_id, frame_id, event_id, category_name,
         CASE WHEN event_id % 7 <> 0 THEN value END AS rgb_cx,
         CASE WHEN event_id % 7 <> 0 THEN CAST(k AS DOUBLE) END AS rgb_cy,
         CASE WHEN event_id % 5 <> 0 THEN value + ((event_id % 11) - 5) * 0.5::DOUBLE END AS thermal_cx,
         CASE WHEN event_id % 5 <> 0 THEN k + ((event_id % 9) - 4) * 0.25::DOUBLE END AS thermal_cy,
         CAST(4 + event_id % 6 AS DOUBLE) AS w, CAST(4 + event_id % 5 AS DOUBLE) AS h
  FROM (SELECT event_id, value, event_type AS category_name,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               's' || CAST(user_id % 8 AS VARCHAR) AS sequence,
               CAST(user_id AS VARCHAR) AS track_id,
               CAST(floor((epoch(ts) - 1704067200) / 43200) AS INT) AS frame_id
        FROM events) e)"""

OBS = """obs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY sequence, track_id, frame_id ORDER BY event_id) AS rn FROM raw) z
  WHERE rn = 1)"""

FUSED = """fused AS (
  SELECT sample_id, sequence, track_id, frame_id, category_name, rgb_cx, rgb_cy, thermal_cx, thermal_cy, w, h,
         CASE WHEN b THEN (rgb_cx + thermal_cx) / 2 ELSE coalesce(rgb_cx, thermal_cx) END AS cx,
         CASE WHEN b THEN (rgb_cy + thermal_cy) / 2 ELSE coalesce(rgb_cy, thermal_cy) END AS cy,
         CASE WHEN b THEN 2 ELSE 1 END AS num_modalities,
         CASE WHEN b THEN 'rgb+thermal' WHEN rgb_cx IS NOT NULL THEN 'rgb' ELSE 'thermal' END AS source_modalities,
         CASE WHEN b THEN off ELSE 0.0::DOUBLE END AS modal_offset,
         CASE WHEN b THEN 1.0::DOUBLE / (1.0 + off / 25.0) ELSE 0.55::DOUBLE END AS confidence
  FROM (SELECT *, rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL AS b,
               sqrt((thermal_cx - rgb_cx)^2 + (thermal_cy - rgb_cy)^2) AS off FROM obs) o
  WHERE rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL)"""


def steps(name: str, source: str, partition: str) -> str:
    """Lagged motion columns over ``source`` per ``partition``, ordered by frame."""
    over = f"OVER (PARTITION BY {partition} ORDER BY frame_id)"
    return f"""{name} AS (
  SELECT *, CASE WHEN na > 0 AND nb > 0 THEN acos(greatest(-1.0, least(1.0, (dx1 * dx + dy1 * dy) / (na * nb)))) END AS turn,
         least(abs(atan2(dy, dx) - atan2(dy1, dx1)), 2 * pi() - abs(atan2(dy, dx) - atan2(dy1, dx1))) AS heading_turn,
         abs(speed - speed1) AS acceleration,
         abs(abs(speed - speed1) - abs(speed1 - speed2)) AS jerk
  FROM (SELECT *, lag(dx) {over} AS dx1, lag(dy) {over} AS dy1, lag(step) {over} AS na, step AS nb,
               lag(speed) {over} AS speed1, lag(speed, 2) {over} AS speed2
        FROM (SELECT *, sqrt(dx * dx + dy * dy) AS step, sqrt(dx * dx + dy * dy) / greatest(gap, 1) AS speed
              FROM (SELECT *, cx - lag(cx) {over} AS dx, cy - lag(cy) {over} AS dy,
                           frame_id - lag(frame_id) {over} AS gap FROM {source}) s0) s1) s2)"""


STEPS = steps("steps", "fused", "sample_id")

BASE = [RAW, OBS]
POINTS = [RAW, OBS, FUSED]
MOTION = [RAW, OBS, FUSED, STEPS]

HANDCRAFTED = """hand AS (
  SELECT sample_id, sequence, track_id,
         CAST(max(frame_id) - min(frame_id) + 1 AS BIGINT) AS duration_frames, count(*) AS num_points,
         coalesce(sum(step), 0) AS path_length,
         sqrt((arg_max(cx, frame_id) - arg_min(cx, frame_id))^2 + (arg_max(cy, frame_id) - arg_min(cy, frame_id))^2) AS displacement,
         coalesce(avg(speed), 0) AS mean_speed, coalesce(max(speed), 0) AS max_speed,
         coalesce(stddev_pop(speed), 0) AS std_speed,
         coalesce(avg(acceleration), 0) AS mean_acceleration, coalesce(max(acceleration), 0) AS max_acceleration,
         coalesce(avg(turn), 0) AS mean_turn_angle, coalesce(max(turn), 0) AS max_turn_angle,
         avg(w * h) AS bbox_area_mean, stddev_pop(w * h) AS bbox_area_std,
         sum(coalesce(o1, 0) + coalesce(o2, 0) + coalesce(o3, 0)) / sum((o1 IS NOT NULL)::INT + (o2 IS NOT NULL)::INT + (o3 IS NOT NULL)::INT) AS modal_offset_mean,
         max(greatest(o1, o2, o3)) AS modal_offset_max
  FROM (SELECT *, sqrt((cx - rgb_cx)^2 + (cy - rgb_cy)^2) AS o1, sqrt((cx - thermal_cx)^2 + (cy - thermal_cy)^2) AS o2,
               sqrt((thermal_cx - rgb_cx)^2 + (thermal_cy - rgb_cy)^2) AS o3 FROM steps) s
  GROUP BY sample_id, sequence, track_id)"""

KINEMATIC = """kin AS (
  SELECT *, 1 - path_efficiency AS smoothness_residual FROM (
  SELECT *, CASE WHEN path_length > 0 THEN greatest(0.0, least(1.0, displacement / path_length)) ELSE 1.0::DOUBLE END AS path_efficiency FROM (
  SELECT sample_id, sequence, track_id,
         CAST(max(frame_id) - min(frame_id) + 1 AS BIGINT) AS duration_frames, count(*) AS num_points,
         coalesce(sum(step), 0) AS path_length,
         sqrt((arg_max(cx, frame_id) - arg_min(cx, frame_id))^2 + (arg_max(cy, frame_id) - arg_min(cy, frame_id))^2) AS displacement,
         coalesce(avg(speed), 0) AS mean_speed, coalesce(max(speed), 0) AS max_speed,
         coalesce(var_pop(speed), 0) AS speed_variance,
         coalesce(avg(CASE WHEN speed IS NULL THEN NULL WHEN speed <= 1e-6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0) AS stop_ratio,
         coalesce(avg(acceleration), 0) AS mean_acceleration, coalesce(max(acceleration), 0) AS max_acceleration,
         coalesce(avg(jerk), 0) AS mean_jerk, coalesce(max(jerk), 0) AS max_jerk,
         coalesce(avg(turn), 0) AS mean_turn_angle, coalesce(max(turn), 0) AS max_turn_angle
  FROM steps GROUP BY sample_id, sequence, track_id) a) b)"""

SIMPLE_COMPONENTS = """comp AS (
  SELECT sample_id, sequence, track_id,
         greatest(0.0, coalesce(quantile_cont(step, 0.95) - median(step), 0)) AS speed_spike,
         coalesce(quantile_cont(heading_turn, 0.95), 0) AS turn_irregularity,
         avg(CASE WHEN confidence < 0.65 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS low_confidence_ratio,
         median(modal_offset) AS modal_offset_median
  FROM steps GROUP BY sample_id, sequence, track_id)"""

WINDOWS = """frames AS (
  SELECT sequence, frame_id, dense_rank() OVER (PARTITION BY sequence ORDER BY frame_id) - 1 AS pos,
         count(*) OVER (PARTITION BY sequence) AS nf
  FROM (SELECT DISTINCT sequence, frame_id FROM obs) d),
winframes AS (
  SELECT sequence, frame_id, start, min(frame_id) OVER (PARTITION BY sequence, start) AS frame_start,
         max(frame_id) OVER (PARTITION BY sequence, start) AS frame_end
  FROM (SELECT f.*, unnest(generate_series(0, nf, 8)) AS start FROM frames f) g
  WHERE pos >= start AND pos < start + 16 AND start + 16 <= nf),
wstates0 AS (
  SELECT w.sequence || ':' || w.frame_start || '-' || w.frame_end AS window_id, w.frame_start, w.frame_end, o.*,
         o.rgb_cx IS NOT NULL OR o.thermal_cx IS NOT NULL AS visible
  FROM winframes w JOIN obs o ON w.sequence = o.sequence AND w.frame_id = o.frame_id),
wobj AS (
  SELECT window_id, sequence, frame_start, frame_end, track_id, sample_id,
         count(*) FILTER (visible) AS visible_any_frames,
         count(*) FILTER (rgb_cx IS NOT NULL) AS visible_rgb_frames,
         count(*) FILTER (thermal_cx IS NOT NULL) AS visible_thermal_frames
  FROM wstates0 GROUP BY ALL HAVING count(*) FILTER (visible) >= 2),
wstates AS (
  SELECT s.window_id, s.frame_start, s.frame_end, f.*
  FROM wstates0 s JOIN wobj USING (window_id, track_id)
  JOIN fused f ON f.sample_id = s.sample_id AND f.frame_id = s.frame_id)"""
WSTEPS = steps("wsteps", "wstates", "window_id, track_id")
WINDOWED = [RAW, OBS, FUSED, WINDOWS]
WMOTION = [RAW, OBS, FUSED, WINDOWS, WSTEPS]

PREDICTION = """pred AS (
  SELECT sample_id, window_id, sequence, track_id, frame_start, frame_end,
         coalesce(max(sqrt((p1x + (p1x - p2x) / g1 * g0 - cx)^2 + (p1y + (p1y - p2y) / g1 * g0 - cy)^2)), 0) AS score
  FROM (SELECT *, greatest(frame_id - f1, 1) AS g0, greatest(f1 - f2, 1) AS g1
        FROM (SELECT *, lag(cx) OVER t AS p1x, lag(cy) OVER t AS p1y, lag(cx, 2) OVER t AS p2x, lag(cy, 2) OVER t AS p2y,
                     lag(frame_id) OVER t AS f1, lag(frame_id, 2) OVER t AS f2
              FROM wstates WINDOW t AS (PARTITION BY window_id, track_id ORDER BY frame_id)) a) b
  GROUP BY ALL)"""


def robust(name: str, source: str, ids: str, columns: list[str], partition: str = "", tie: str = "sample_id") -> str:
    """Median / MAD scaling of columns, ordinal when the MAD vanishes."""
    over = f"OVER (PARTITION BY {partition})" if partition else "OVER ()"
    part = f"PARTITION BY {partition} " if partition else ""
    med = ", ".join(f"median({c}) {over} AS med_{c}" for c in columns)
    mad = ", ".join(f"median(abs({c} - med_{c})) {over} AS mad_{c}" for c in columns)
    out = ", ".join(
        f"CASE WHEN mad_{c} <= 1e-6 THEN (row_number() OVER ({part}ORDER BY {c}, {tie}) - 1)::DOUBLE / greatest(count(*) {over} - 1, 1) "
        f"ELSE greatest(0.0, ({c} - med_{c}) / (1.4826 * mad_{c} + 1e-6)) END AS n_{c}"
        for c in columns
    )
    return f"""{name} AS (
  SELECT {ids}, {out} FROM (SELECT *, {mad} FROM (SELECT *, {med} FROM {source}) r0) r1)"""


def rank01(name: str, source: str, ids: str, columns: list[str], tie: str, partition: str = "") -> str:
    """Stable rank to 0..1 by value then key; all-equal values rank 0."""
    over = f"OVER (PARTITION BY {partition})" if partition else "OVER ()"
    part = f"PARTITION BY {partition} " if partition else ""
    out = ", ".join(
        f"CASE WHEN max({c}) {over} <= min({c}) {over} THEN 0.0::DOUBLE ELSE "
        f"(row_number() OVER ({part}ORDER BY {c}, {tie}) - 1)::DOUBLE / (count(*) {over} - 1) END AS r_{c}"
        for c in columns
    )
    return f"{name} AS (SELECT {ids}, {out} FROM {source})"


SPLIT = """split AS (
  SELECT sequence, CASE WHEN row_number() OVER (ORDER BY md5('42:' || sequence), sequence)
                        <= least(greatest(CAST(floor(count(*) OVER () * 0.25) AS INT), 1), greatest(count(*) OVER () - 1, 1))
                   THEN 'val' ELSE 'train' END AS split
  FROM (SELECT DISTINCT sequence FROM obs) s)"""

SIMPLE_SCORES = """ind AS (
  SELECT *, 0.35 * n_speed_spike + 0.25 * n_turn_irregularity + 0.20 * n_low_confidence_ratio + 0.20 * n_modal_offset_median AS score
  FROM (SELECT c.sample_id, c.sequence, c.track_id, r.n_speed_spike, r.n_turn_irregularity, r.n_low_confidence_ratio, r.n_modal_offset_median
        FROM comp c JOIN rcomp r USING (sample_id)) z)"""
SIMPLE = [
    *MOTION,
    SIMPLE_COMPONENTS,
    robust(
        "rcomp",
        "comp",
        "sample_id",
        ["speed_spike", "turn_irregularity", "low_confidence_ratio", "modal_offset_median"],
    ),
    SIMPLE_SCORES,
]

EVIDENCE = """evidence AS (
  SELECT *, round(0.35 * speed_spike + 0.25 * turn_irregularity + 0.20 * low_confidence_ratio + 0.20 * modal_offset_median, 6) AS score,
         CASE greatest(speed_spike, turn_irregularity, low_confidence_ratio, modal_offset_median)
           WHEN turn_irregularity THEN 'turn_irregularity' WHEN speed_spike THEN 'speed_spike'
           WHEN modal_offset_median THEN 'modal_offset_median' ELSE 'low_confidence_ratio' END AS dominant_reason
  FROM (SELECT sample_id, frame_id,
               CASE WHEN top > 1e-6 THEN greatest(0.0, coalesce(step - med, 0)) / top ELSE 0.0::DOUBLE END AS speed_spike,
               coalesce(heading_turn / pi(), 0) AS turn_irregularity,
               greatest(0.0, least(1.0, (0.65 - confidence) / 0.65)) AS low_confidence_ratio,
               CASE WHEN offmax > 1e-6 THEN modal_offset / offmax ELSE 0.0::DOUBLE END AS modal_offset_median
        FROM (SELECT *, median(step) OVER (PARTITION BY sample_id) AS med,
                     greatest(0.0, coalesce(max(step) OVER (PARTITION BY sample_id) - median(step) OVER (PARTITION BY sample_id), 0)) AS top,
                     max(modal_offset) OVER (PARTITION BY sample_id) AS offmax FROM steps) a) b)"""

SEGMENTS = """seg AS (
  SELECT *, sum(opens) OVER (PARTITION BY sample_id ORDER BY frame_id) AS island
  FROM (SELECT *, CASE WHEN score > 0.25 AND (pf IS NULL OR ps <= 0.25 OR frame_id > pf + 2) THEN 1 ELSE 0 END AS opens
        FROM (SELECT *, lag(frame_id) OVER (PARTITION BY sample_id ORDER BY frame_id) AS pf,
                     lag(score) OVER (PARTITION BY sample_id ORDER BY frame_id) AS ps FROM evidence) a) b
  QUALIFY score > 0.25)"""

LIGHT = """ends AS (
  SELECT window_id, track_id, sample_id, arg_min(cx, frame_id) AS ax, arg_min(cy, frame_id) AS ay,
         arg_max(cx, frame_id) AS bx, arg_max(cy, frame_id) AS by_, count(*) AS n,
         coalesce(median(modal_offset) FILTER (num_modalities = 2), 0) AS modal_inconsistency
  FROM wstates GROUP BY ALL),
others AS (
  SELECT a.window_id, a.track_id, coalesce(median(b.bx - b.ax), 0) AS ox, coalesce(median(b.by_ - b.ay), 0) AS oy
  FROM ends a LEFT JOIN ends b ON a.window_id = b.window_id AND a.track_id <> b.track_id GROUP BY ALL),
light AS (
  SELECT e.window_id, e.track_id, e.sample_id, sqrt((bx - ax - ox)^2 + (by_ - ay - oy)^2) AS motion_inconsistency,
         CASE WHEN n >= 2 THEN greatest(0.0, sqrt((bx - mbx)^2 + (by_ - mby)^2) - sqrt((ax - max_)^2 + (ay - may)^2)) ELSE 0.0::DOUBLE END AS group_leaving,
         modal_inconsistency
  FROM ends e JOIN others USING (window_id, track_id)
  JOIN (SELECT window_id, median(ax) AS max_, median(ay) AS may, median(bx) AS mbx, median(by_) AS mby FROM ends GROUP BY window_id) m USING (window_id))"""

FUSED_SCORES = [
    "evmax AS (SELECT sample_id, max(score) AS event_score FROM evidence GROUP BY sample_id)",
    "grp AS (SELECT sample_id, max(score) AS score FROM pred GROUP BY sample_id)",
    "inds AS (SELECT sample_id, score, event_score FROM ind JOIN evmax USING (sample_id))",
    robust("indn", "inds", "sample_id, event_score", ["score"]),
    robust("grpn", "grp", "sample_id", ["score"]),
    """fusedscores AS (
  SELECT sample_id, CASE WHEN i.n_score IS NOT NULL AND g.n_score IS NOT NULL THEN 0.65 * i.n_score + 0.35 * g.n_score
                         ELSE coalesce(i.n_score, g.n_score) END AS score,
         coalesce(i.n_score, 0) AS s_ind, coalesce(g.n_score, 0) AS s_grp, coalesce(event_score, 0) AS s_event,
         concat_ws('+', CASE WHEN i.n_score IS NOT NULL THEN 'individual' END, CASE WHEN g.n_score IS NOT NULL THEN 'group' END) AS used_sources
  FROM indn i FULL JOIN grpn g USING (sample_id))""",
]


def profile(name: str, source: str, columns: list[str]) -> list[str]:
    """Median, MAD, deviation and median size of training columns (one row)."""
    med = ", ".join(f"median({c}) AS med_{c}, stddev_pop({c}) AS std_{c}, median(abs({c})) AS abs_{c}" for c in columns)
    mad = ", ".join(f"median(abs({c} - med_{c})) AS mad_{c}" for c in columns)
    return [
        f"{name}_train AS (SELECT t.* FROM {source} t JOIN split USING (sequence) WHERE split = 'train')",
        f"{name}_med AS (SELECT {med} FROM {name}_train)",
        f"{name}_mad AS (SELECT {mad} FROM {name}_train, {name}_med)",
        f"{name} AS (SELECT t.*, m.*, d.* FROM {source} t JOIN split USING (sequence), {name}_med m, {name}_mad d WHERE split = 'val')",
    ]


def kinematic_scores() -> list[str]:
    parts = {
        "speed": ["mean_speed", "max_speed", "speed_variance", "stop_ratio"],
        "acceleration": ["mean_acceleration", "max_acceleration"],
        "jerk": ["mean_jerk", "max_jerk"],
        "turn": ["mean_turn_angle", "max_turn_angle"],
        "smoothness": ["path_efficiency", "smoothness_residual"],
    }

    def residual(c: str) -> str:
        return (
            f"abs({c} - med_{c}) / greatest(CASE WHEN mad_{c} > 0 THEN 1.4826 * mad_{c} "
            f"ELSE greatest(abs_{c}, 1.0) * 0.001 END, 0.001)"
        )

    columns = ", ".join(f"({' + '.join(map(residual, cs))}) / {len(cs)} AS {n}" for n, cs in parts.items())
    return [
        *profile("kp", "kin", [c for cs in parts.values() for c in cs]),
        f"kscore AS (SELECT sample_id, {columns} FROM kp)",
    ]


def behaviour_scores() -> list[str]:
    parts = {
        "route_score": ["duration_frames", "num_points", "path_length", "displacement"],
        "speed_score": ["mean_speed", "max_speed", "std_speed", "mean_acceleration", "max_acceleration"],
        "jump_score": ["max_speed", "max_acceleration"],
        "shape_score": ["mean_turn_angle", "max_turn_angle", "bbox_area_mean", "bbox_area_std"],
        "modal_offset_score": ["modal_offset_mean", "modal_offset_max"],
    }

    def scale(c: str) -> str:
        return f"(CASE WHEN mad_{c} > 1e-6 THEN mad_{c} WHEN std_{c} > 1e-6 THEN std_{c} ELSE 1.0 END)"

    def mean(cs: list[str]) -> str:
        return f"(({' + '.join(f'abs({c} - med_{c}) / {scale(c)}' for c in cs)}) / {len(cs)})"

    columns = [f"{mean(cs)} / (1 + {mean(cs)}) AS {n}" for n, cs in parts.items()]
    slow = f"greatest(0.0, (med_mean_speed - mean_speed) / {scale('mean_speed')})"
    columns.append(f"{slow} / (1 + {slow}) AS speed_slowdown_score")
    used = sorted({c for cs in parts.values() for c in cs})
    return [*profile("bp", "hand", used), f"bscore AS (SELECT sample_id, {', '.join(columns)} FROM bp)"]


def stratified(score: str, axes: list[str]) -> list[str]:
    ctes = [rank01("grank", "hand", "sample_id", [score], "sample_id")]
    unions = []
    for a in axes:
        ctes.append(
            f"edges_{a} AS (SELECT list_sort(list_distinct(quantile_cont({a}::DOUBLE, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM hand)"
        )
        unions.append(
            f"SELECT sample_id, {score}, '{a}' AS axis, len(list_filter(e[2:len(e) - 1], lambda x: {a} > x)) AS stratum FROM hand, edges_{a}"
        )
    ctes.append(f"strata AS ({' UNION ALL '.join(unions)})")
    ctes.append(rank01("lrank", "strata", "sample_id, axis, stratum, count(*) OVER (PARTITION BY axis, stratum) AS sn", [score], "sample_id", "axis, stratum"))
    ctes.append(
        f"""strat AS (SELECT sample_id, any_value(g.r_{score}) AS global_rank,
  avg(CASE WHEN sn < 2 THEN g.r_{score} ELSE l.r_{score} END) AS local_rank
  FROM lrank l JOIN grank g USING (sample_id) GROUP BY sample_id)"""
    )
    return ctes


def _standardised(name: str, source: str, key: str, columns: list[str]) -> list[str]:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    vec = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END" for c in columns)
    return [
        f"{name}_stats AS (SELECT {stats} FROM {source} JOIN split USING (sequence) WHERE split = 'train')",
        f"{name}_vec AS (SELECT {key} AS id, split, [{vec}]::DOUBLE[] AS v FROM {source} JOIN split USING (sequence), {name}_stats)",
    ]


_L2 = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def knn(name: str, source: str, key: str, columns: list[str], k: int) -> list[str]:
    """Mean distance of validation rows to their k nearest training rows."""
    return [
        *_standardised(name, source, key, columns),
        f"""{name} AS (SELECT id AS {key}, avg(d) AS score FROM (
  SELECT a.id, {_L2} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_L2}, b.id) AS rn
  FROM {name}_vec a JOIN {name}_vec b ON a.split = 'val' AND b.split = 'train') n WHERE rn <= {k} GROUP BY id)""",
    ]


def lof(name: str, source: str, key: str, columns: list[str], k: int) -> list[str]:
    """Local outlier factor of validation rows against training rows."""
    top = f"QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_L2}, b.id) <= least({k}, (SELECT count(*) FROM {name}_vec WHERE split = 'train') - 1)"
    return [
        *_standardised(name, source, key, columns),
        f"""{name}_in AS (SELECT a.id AS q, b.id AS n, {_L2} AS d FROM {name}_vec a JOIN {name}_vec b
  ON a.split = 'train' AND b.split = 'train' AND a.id <> b.id {top})""",
        f"{name}_kd AS (SELECT q AS n, max(d) AS kd FROM {name}_in GROUP BY q)",
        f"{name}_lrd AS (SELECT q AS n, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM {name}_in JOIN {name}_kd USING (n) GROUP BY q)",
        f"""{name}_out AS (SELECT a.id AS q, b.id AS n, {_L2} AS d FROM {name}_vec a JOIN {name}_vec b
  ON a.split = 'val' AND b.split = 'train' {top})""",
        f"{name}_own AS (SELECT q, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM {name}_out JOIN {name}_kd USING (n) GROUP BY q)",
        f"""{name} AS (SELECT o.q AS {key}, avg(l.lrd / w.lrd) AS score FROM {name}_out o JOIN {name}_lrd l ON o.n = l.n
  JOIN {name}_own w ON o.q = w.q GROUP BY o.q)""",
    ]


def isolation(name: str, source: str, key: str, columns: list[str], trees: int = 100, rows: int = 256, seed: int = 42) -> list[str]:
    """Scores of the validation rows by a forest of hash-driven cuts grown level by level on the training rows."""
    levels = (rows - 1).bit_length()
    values = ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 6)" for c in columns)
    depth = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} = 2 THEN 1 ELSE 2 * (ln({0} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({0} - 1) / {0} END"
    hashed = f"md5('{seed}/' || tree || '/' || node)"
    out = [
        f"{name}_in AS MATERIALIZED (SELECT {key} AS id, split, [{values}] AS v FROM {source} JOIN split USING (sequence))",
        f"{name}_size AS (SELECT least({rows}, count(*)) AS size, ceil(log2(greatest(least({rows}, count(*)), 2))) AS lim FROM {name}_in WHERE split = 'train')",
        f"""{name}_l0 AS MATERIALIZED (SELECT tree, id, v, 1::BIGINT AS node FROM
  (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY substr(md5('{seed}:' || (tree // 4) || ':' || id), 1 + 8 * (tree % 4)::INT, 8), id) AS rn
   FROM {name}_in, (SELECT unnest(generate_series(0, {trees - 1})) AS tree) t WHERE split = 'train') d WHERE rn <= {rows})""",
        f"{name}_q0 AS MATERIALIZED (SELECT tree, id, v, 1::BIGINT AS node FROM {name}_in, (SELECT unnest(generate_series(0, {trees - 1})) AS tree) t WHERE split = 'val')",
    ]
    for d in range(levels + 1):
        out.append(f"""{name}_b{d} AS MATERIALIZED (SELECT tree, node, axis, min(x) AS lo, max(x) AS hi, count(*) AS n FROM
  (SELECT tree, node, unnest(range(1, {len(columns) + 1})) AS axis, unnest(v) AS x FROM {name}_l{d}) u GROUP BY ALL)""")
        out.append(f"""{name}_g{d} AS MATERIALIZED (SELECT c.tree, c.node, c.n, b.axis, CASE WHEN lo + u * (hi - lo) < hi THEN lo + u * (hi - lo) ELSE lo END AS cut FROM
  (SELECT *, open[1 + ('0x' || substr(h, 14, 8))::BIGINT % len(open)] AS pick, ('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM
    (SELECT tree, node, max(n) AS n, list(axis ORDER BY axis) FILTER (hi > lo) AS open, {hashed} AS h FROM {name}_b{d} GROUP BY tree, node) o) c
  LEFT JOIN {name}_b{d} b ON b.tree = c.tree AND b.node = c.node AND b.axis = c.pick AND {d} < (SELECT lim FROM {name}_size))""")
        if d < levels:
            for part in "lq":
                out.append(f"{name}_{part}{d + 1} AS MATERIALIZED (SELECT tree, id, v, 2 * node + (v[axis] > cut)::INT AS node FROM {name}_{part}{d} JOIN {name}_g{d} USING (tree, node) WHERE axis IS NOT NULL)")
    ends = " UNION ALL ".join(f"SELECT id, {d} + {depth.format('n')} AS e FROM {name}_q{d} JOIN {name}_g{d} USING (tree, node) WHERE axis IS NULL" for d in range(levels + 1))
    out.append(f"{name} AS (SELECT id AS {key}, power(2::DOUBLE, -(sum(e) / {trees}) / (SELECT {depth.format('size')} FROM {name}_size)) AS score FROM ({ends}) e GROUP BY id)")
    return out
