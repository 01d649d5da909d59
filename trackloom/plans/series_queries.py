"""Queries on resampled series and on point-cloud tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import cloud, compatibility, series, windows
from trackloom.plans import oracle as sql
from trackloom.plans.detector_queries import points, train_score
from trackloom.plans.registry import query, select
from trackloom.session import materialize
from trackloom.sources.tables import embeddings, observations

_CHANNELS = """chan AS (SELECT sample_id, sequence, frame_id, cx, cy, coalesce(dx / greatest(gap, 1), 0) AS vx, coalesce(dy / greatest(gap, 1), 0) AS vy,
  coalesce(speed, 0) AS speed, confidence, modal_offset, w * h AS area, num_modalities::DOUBLE AS num_modalities,
  row_number() OVER (PARTITION BY sample_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM steps)"""


def _lerp(c: str) -> str:
    return f"a.{c} + (coalesce(b.{c}, a.{c}) - a.{c}) * (slot * (a.n - 1) / 31.0::DOUBLE - a.i)"


_SERIES = f"""ser AS (SELECT a.sample_id, a.sequence, slot, {", ".join(f"{_lerp(c)} AS {c}" for c in series.TRACK_CHANNELS)}
  FROM (SELECT *, unnest(range(32)) AS slot FROM (SELECT DISTINCT sample_id, n FROM chan) k) k
  JOIN chan a ON a.sample_id = k.sample_id AND a.i = (slot * (k.n - 1)) // 31
  LEFT JOIN chan b ON b.sample_id = k.sample_id AND b.i = a.i + 1)"""
_TRACK_COLS = ", ".join(f"~{c}" for c in series.TRACK_CHANNELS)


@query("track_series", select(f"sample_id, slot::INT AS slot, {_TRACK_COLS}", "ser", [*sql.MOTION, _CHANNELS, _SERIES]))
def track_series(spark, sf):
    return series.track_series(points(spark, sf)).drop("sequence", "track_id")


@query(
    "standardized_series",
    select(
        "sample_id, slot::INT AS slot, "
        + ", ".join(f"~({c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END AS {c}" for c in series.TRACK_CHANNELS),
        "ser JOIN split USING (sequence), st",
        [
            *sql.MOTION,
            _CHANNELS,
            _SERIES,
            sql.SPLIT,
            "st AS (SELECT "
            + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in series.TRACK_CHANNELS)
            + " FROM ser JOIN split USING (sequence) WHERE split = 'train')",
        ],
        "WHERE split = 'val'",
    ),
)
def standardized_series(spark, sf):
    train, score = train_score(spark, sf, series.track_series(points(spark, sf)))
    return series.standardize_series(score, train, series.TRACK_CHANNELS).drop("sequence", "track_id", "split")


_OBJECT = """cen AS (SELECT window_id, frame_id, avg(cx) AS x, avg(cy) AS y FROM wstates GROUP BY ALL),
gridw AS (SELECT window_id, frame_start, unnest(range(16)) AS slot FROM (SELECT DISTINCT window_id, frame_start FROM wstates) d),
cent AS (SELECT g.window_id, slot, coalesce(last_value(x IGNORE NULLS) OVER u, 0) AS gx, coalesce(last_value(y IGNORE NULLS) OVER u, 0) AS gy
  FROM gridw g LEFT JOIN cen c ON c.window_id = g.window_id AND c.frame_id = g.frame_start + slot
  WINDOW u AS (PARTITION BY g.window_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
obj0 AS (SELECT k.window_id, k.sample_id, k.track_id, k.slot, s.w * s.h AS area, CASE WHEN s.num_modalities = 2 THEN s.modal_offset END AS modal_offset,
    CASE WHEN s.cx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS visible, gx, gy,
    coalesce(last_value(s.cx IGNORE NULLS) OVER m, first_value(gx) OVER m) AS cx, coalesce(last_value(s.cy IGNORE NULLS) OVER m, first_value(gy) OVER m) AS cy
  FROM (SELECT DISTINCT window_id, sample_id, track_id, frame_start, slot FROM wobj, (SELECT unnest(range(16)) AS slot) r) k
  JOIN cent c ON c.window_id = k.window_id AND c.slot = k.slot
  LEFT JOIN wstates s ON s.window_id = k.window_id AND s.track_id = k.track_id AND s.frame_id = k.frame_start + k.slot
  WINDOW m AS (PARTITION BY k.window_id, k.track_id ORDER BY k.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
objs AS (SELECT *, coalesce(cx - lag(cx) OVER m, 0) AS vx, coalesce(cy - lag(cy) OVER m, 0) AS vy FROM obj0 WINDOW m AS (PARTITION BY window_id, track_id ORDER BY slot))"""


@query(
    "object_series",
    select(
        """window_id, sample_id, track_id, slot::INT AS slot, ~cx, ~cy, ~cx - gx AS rel_x, ~cy - gy AS rel_y, ~vx, ~vy, ~sqrt(vx * vx + vy * vy) AS speed,
        ~coalesce(area, 0) AS area, ~coalesce(modal_offset, 0) AS modal_offset, ~visible""",
        "objs",
        [*sql.WINDOWED, _OBJECT],
    ),
)
def object_series(spark, sf):
    return series.object_series(materialize(windows.window_points(observations(spark, sf))))


@query(
    "top_fraction_mean",
    select(
        "window_id, sample_id, ~list_avg(list_reverse_sort(list(sqrt(vx * vx + vy * vy)))[1:4]) AS score",
        "objs",
        [*sql.WINDOWED, _OBJECT],
        "GROUP BY window_id, sample_id",
    ),
)
def top_fraction_mean(spark, sf):
    table = series.object_series(materialize(windows.window_points(observations(spark, sf))))
    return series.top_fraction_mean(table, ["window_id", "sample_id"], "speed", 0.25)


_SENSOR = """sensor0 AS (SELECT sample_id, frame_id, 'rgb' AS modality, rgb_cx AS x, rgb_cy AS y FROM obs WHERE rgb_cx IS NOT NULL
  UNION ALL SELECT sample_id, frame_id, 'thermal', thermal_cx, thermal_cy FROM obs WHERE thermal_cx IS NOT NULL),
sensor AS (SELECT *, count(*) OVER (PARTITION BY sample_id, modality) AS n FROM sensor0 QUALIFY count(*) OVER (PARTITION BY sample_id, modality) >= 3)"""
_SPEEDS = """spd AS (SELECT sample_id, modality, frame_id, n, coalesce(sqrt((x - lag(x) OVER t)^2 + (y - lag(y) OVER t)^2) / greatest(frame_id - lag(frame_id) OVER t, 1), 0) AS speed
  FROM sensor WINDOW t AS (PARTITION BY sample_id, modality ORDER BY frame_id))"""


def sensor(spark, sf):
    return materialize(series.sensor_points(observations(spark, sf)))


@query(
    "speed_sequences", select("sample_id, modality, frame_id, ~speed", "spd", [*sql.BASE, _SENSOR, _SPEEDS])
)
def speed_sequences(spark, sf):
    return series.speed_sequences(sensor(spark, sf)).drop("sequence", "track_id")


@query(
    "length_filter",
    select("sample_id, modality, frame_id, ~speed", "spd", [*sql.BASE, _SENSOR, _SPEEDS], "WHERE n BETWEEN 30 AND 36"),
)
def length_filter(spark, sf):
    rows = materialize(series.speed_sequences(sensor(spark, sf)))
    return series.length_filter(rows, ["sample_id", "modality"], 30, 36).drop("sequence", "track_id")


_ROUTE = """rt0 AS (SELECT *, x - first_value(x) OVER t AS rx, y - first_value(y) OVER t AS ry, coalesce(sqrt((x - lag(x) OVER t)^2 + (y - lag(y) OVER t)^2), 0) AS d
  FROM sensor WINDOW t AS (PARTITION BY sample_id, modality ORDER BY frame_id)),
rt AS (SELECT *, sum(d) OVER (PARTITION BY sample_id, modality ORDER BY frame_id) AS cum, sum(d) OVER (PARTITION BY sample_id, modality) AS total,
   row_number() OVER (PARTITION BY sample_id, modality ORDER BY frame_id) AS i FROM rt0),
rg AS (SELECT sample_id, modality, max(total) AS total, unnest(range(ceil((max(total) + 10) / 10)::BIGINT)) AS slot FROM rt GROUP BY sample_id, modality),
route AS (SELECT g.sample_id, g.modality, g.slot,
   CASE WHEN g.slot * 10 >= g.total THEN e.rx ELSE a.rx + (b.rx - a.rx) * (g.slot * 10 - a.cum) / (b.cum - a.cum) END AS x,
   CASE WHEN g.slot * 10 >= g.total THEN e.ry ELSE a.ry + (b.ry - a.ry) * (g.slot * 10 - a.cum) / (b.cum - a.cum) END AS y
 FROM rg g JOIN (SELECT sample_id, modality, arg_max(rx, frame_id) AS rx, arg_max(ry, frame_id) AS ry FROM rt GROUP BY ALL) e ON e.sample_id = g.sample_id AND e.modality = g.modality
 LEFT JOIN rt a ON a.sample_id = g.sample_id AND a.modality = g.modality AND a.cum <= g.slot * 10
 LEFT JOIN rt b ON b.sample_id = a.sample_id AND b.modality = a.modality AND b.i = a.i + 1 AND b.cum > g.slot * 10
 WHERE g.slot * 10 >= g.total OR b.i IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY g.sample_id, g.modality, g.slot ORDER BY a.i DESC NULLS LAST) = 1)"""


@query("route_sequences", select("sample_id, modality, slot, ~x, ~y", "route", [*sql.BASE, _SENSOR, _ROUTE]))
def route_sequences(spark, sf):
    return series.route_sequences(sensor(spark, sf)).drop("sequence", "track_id")


@query("shape_sequences")
def shape_sequences(spark, sf):
    return series.shape_sequences(sensor(spark, sf), time_step=0.01)


# ------------------------------------------------------------------ clouds
def clouds(spark, sf):
    """Ten clouds: embeddings of one label, first three components as x, y, z."""
    e = embeddings(spark, sf)
    return e.select(
        F.col("label").alias("pair_id"),
        F.lit("source").alias("side"),
        F.col("vec_id").alias("pt"),
        *[F.get("vector", F.lit(i)).alias(a) for i, a in enumerate(cloud.AXES)],
    )


_CLOUD = "cl AS (SELECT label AS pair_id, vec_id AS pt, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
# a quarter turn about z and a shift
_QUARTER = [[0, -1, 0, 0.1], [1, 0, 0, -0.2], [0, 0, 1, 0.3]]


def moved_clouds(spark, sf):
    source = materialize(clouds(spark, sf))
    posed = source.withColumn("pose", cloud.pose_of(_QUARTER))
    return source, cloud.apply_pose(posed).drop("pose").withColumn("side", F.lit("target"))


_MOVED = "mv AS (SELECT pair_id, pt, -y + 0.1 AS x, x - 0.2 AS y, z + 0.3 AS z FROM cl)"


@query("apply_pose", select("pair_id, pt, ~x, ~y, ~z", "mv", [_CLOUD, _MOVED]))
def apply_pose(spark, sf):
    return moved_clouds(spark, sf)[1].drop("side")


_D2 = "min((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2)"


@query(
    "chamfer_distance",
    select(
        "pair_id, ~sum(d) AS chamfer",
        f"""(SELECT pair_id, avg(d) AS d FROM (SELECT a.pair_id, a.pt, {_D2} AS d FROM cl a JOIN mv b ON a.pair_id = b.pair_id GROUP BY ALL) p GROUP BY pair_id
             UNION ALL SELECT pair_id, avg(d) FROM (SELECT a.pair_id, a.pt, {_D2} AS d FROM mv a JOIN cl b ON a.pair_id = b.pair_id GROUP BY ALL) q GROUP BY pair_id) u""",
        [_CLOUD, _MOVED],
        "GROUP BY pair_id",
    ),
)
def chamfer_distance(spark, sf):
    source, target = moved_clouds(spark, sf)
    return cloud.chamfer(source, target)


@query(
    "trimmed_chamfer_distance",
    select(
        "pair_id, ~sum(d) AS chamfer",
        f"""(SELECT pair_id, avg(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY d) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM
              (SELECT a.pair_id, a.pt, {_D2} AS d FROM cl a JOIN mv b ON a.pair_id = b.pair_id GROUP BY ALL) p) r WHERE rn <= ceil(n * 0.7::DOUBLE) GROUP BY pair_id
             UNION ALL SELECT pair_id, avg(d) FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY d) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM
              (SELECT a.pair_id, a.pt, {_D2} AS d FROM mv a JOIN cl b ON a.pair_id = b.pair_id GROUP BY ALL) q) s WHERE rn <= ceil(n * 0.7::DOUBLE) GROUP BY pair_id) u""",
        [_CLOUD, _MOVED],
        "GROUP BY pair_id",
    ),
)
def trimmed_chamfer_distance(spark, sf):
    source, target = moved_clouds(spark, sf)
    return cloud.chamfer(source, target, keep=0.7)


@query(
    "voxel_means",
    select(
        """pair_id, 'source' AS side, floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz, ~avg(x) AS x, ~avg(y) AS y, ~avg(z) AS z, count(*) AS points""",
        "(SELECT *, x AS x0 FROM cl) c",
        [_CLOUD],
        "GROUP BY pair_id, floor(c.x / 0.1), floor(c.y / 0.1), floor(c.z / 0.1)",
    ),
)
def voxel_means(spark, sf):
    return cloud.voxel_means(clouds(spark, sf), 0.1)


def _u(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 12))::BIGINT + 1.0::DOUBLE) / (16.0::DOUBLE ** 12 + 1))"


_CROP = f"""dirs AS (SELECT pair_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, 2 * pi() * {_u("'42:' || pair_id || ':a'")} AS ang, 2 * {_u("'42:' || pair_id || ':z'")} - 1 AS up FROM cl GROUP BY pair_id),
along AS (SELECT c.*, (x - mx) * sqrt(1 - up * up) * cos(ang) + (y - my) * sqrt(1 - up * up) * sin(ang) + (z - mz) * up AS s FROM cl c JOIN dirs USING (pair_id))"""


@query(
    "half_space_crop",
    select("pair_id, pt", "(SELECT *, quantile_cont(s, 0.3) OVER (PARTITION BY pair_id) AS cut FROM along) a", [_CLOUD, _CROP], "WHERE s > cut"),
)
def half_space_crop(spark, sf):
    return cloud.crop(clouds(spark, sf), 0.7).select("pair_id", "pt")


@query("half_space_crop_even", select("pair_id, pt", "along", [_CLOUD, _CROP], "WHERE s > 0"))
def half_space_crop_even(spark, sf):
    return cloud.crop(clouds(spark, sf), 0.5).select("pair_id", "pt")


def _noise(axis: str) -> str:
    key = "'42:' || pair_id || ':source:' || pt || ':"
    u, v = _u(f"{key}{axis}'"), _u(f"{key}{axis}2'")
    return f"greatest(-0.05, least(0.05, 0.01 * sqrt(-2 * ln({u})) * cos(2 * pi() * {v})))"


@query(
    "jitter_points",
    select("pair_id, pt, " + ", ".join(f"~{a} + {_noise(a)} AS {a}" for a in "xyz"), "cl", [_CLOUD]),
)
def jitter_points(spark, sf):
    return cloud.jitter(clouds(spark, sf)).drop("side")


@query(
    "resample_points",
    select(
        "pair_id, pt, (80 - rn) // least(n, 80) + 1 AS copies",
        "(SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY md5('42:' || pair_id || ':source:' || pt), pt) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM cl) r",
        [_CLOUD],
        "WHERE rn <= 80",
    ),
)
def resample_points(spark, sf):
    drawn = cloud.resample_points(clouds(spark, sf), 80)
    return drawn.groupBy("pair_id", "pt").agg(F.count(F.lit(1)).alias("copies"))


_POSES = f"""ang AS (SELECT DISTINCT pair_id, radians(45) * {_u("'42:' || pair_id || ':rx'")} AS ax, radians(45) * {_u("'42:' || pair_id || ':ry'")} AS ay, radians(45) * {_u("'42:' || pair_id || ':rz'")} AS az,
  (2 * {_u("'42:' || pair_id || ':tx'")} - 1) * 0.5 AS tx, (2 * {_u("'42:' || pair_id || ':ty'")} - 1) * 0.5 AS ty, (2 * {_u("'42:' || pair_id || ':tz'")} - 1) * 0.5 AS tz FROM cl),
tr AS (SELECT *, cos(ay) * cos(az) + sin(ax) * sin(ay) * sin(az) + cos(ax) * cos(az) + cos(ax) * cos(ay) AS trace FROM ang)"""


@query(
    "pose_errors",
    select(
        "pair_id, ~degrees(acos(greatest(-1.0, least(1.0, (trace - 1) / 2)))) AS rotation_error_deg, ~sqrt(tx * tx + ty * ty + tz * tz) AS translation_error",
        "tr",
        [_CLOUD, _POSES],
    ),
)
def pose_errors(spark, sf):
    """Random poses against the identity."""
    pairs = clouds(spark, sf).select("pair_id").distinct()
    identity = cloud.pose_of([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    posed = cloud.random_poses(pairs).withColumn("eye", identity)
    return posed.select(
        "pair_id",
        cloud.rotation_error("pose", "eye").alias("rotation_error_deg"),
        cloud.translation_error("pose", "eye").alias("translation_error"),
    )


def posed_pairs(spark, sf):
    """Source clouds, targets under a random pose per pair, and the poses."""
    source = materialize(clouds(spark, sf))
    poses = materialize(cloud.random_poses(source.select("pair_id").distinct(), 20.0, 0.05))
    target = cloud.apply_pose(source.join(poses, "pair_id")).drop("pose").withColumn("side", F.lit("target"))
    return source, materialize(target), poses


@query(
    "inverse_pose",
    select("pair_id, count(*) AS points, ~0.0::DOUBLE AS largest_gap", "cl", [_CLOUD], "GROUP BY pair_id"),
)
def inverse_pose(spark, sf):
    """Moving a cloud and moving it back leaves every point in place."""
    source, target, poses = posed_pairs(spark, sf)
    back = cloud.apply_pose(target.join(poses.select("pair_id", cloud.invert("pose").alias("pose")), "pair_id"))
    both = source.join(back.select("pair_id", "pt", *[F.col(a).alias(f"b{a}") for a in cloud.AXES]), ["pair_id", "pt"])
    gap = F.sqrt(sum(((F.col(a) - F.col(f"b{a}")) ** 2 for a in cloud.AXES), F.lit(0.0)))
    return both.groupBy("pair_id").agg(F.count(F.lit(1)).alias("points"), F.max(gap).alias("largest_gap"))


def _matches(spark, sf):
    source, target, poses = posed_pairs(spark, sf)
    pairs = source.join(target.select("pair_id", "pt", *[F.col(a).alias(f"t{a}") for a in cloud.AXES]), ["pair_id", "pt"])
    return source, target, poses, pairs


@query(
    "kabsch",
    select("pair_id, true AS found, ~0.0::DOUBLE AS translation_error", "(SELECT DISTINCT pair_id FROM cl) p", [_CLOUD]),
)
def kabsch(spark, sf):
    """The pose behind exact correspondences is found again."""
    _, _, poses, pairs = _matches(spark, sf)
    found = cloud.kabsch(pairs).withColumnRenamed("pose", "est").join(poses, "pair_id")
    return found.select(
        "pair_id",
        (cloud.rotation_error("est", "pose") < 1e-4).alias("found"),
        cloud.translation_error("est", "pose").alias("translation_error"),
    )


@query(
    "compatibility_degrees",
    select(
        "a.pair_id, a.pt, count(*) AS degree",
        "cl a JOIN cl b ON a.pair_id = b.pair_id AND a.pt <> b.pt",
        [_CLOUD],
        "GROUP BY a.pair_id, a.pt",
    ),
)
def compatibility_degrees(spark, sf):
    """A rigid motion keeps every distance, so all other correspondences agree."""
    return cloud.compatibility(materialize(_matches(spark, sf)[3]), 1e-6)


def _bent(spark, sf):
    """Correspondences of a quarter turn: every third one wrong, the rest a little off."""
    source, target = moved_clouds(spark, sf)
    off = F.when(F.col("pt") % 3 == 0, 0.3 * (F.col("pt") % 7 - 3)).otherwise(0.004 * (F.col("pt") % 5))
    there = target.select("pair_id", "pt", (F.col("x") + off).alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    return materialize(source.drop("side").join(there, ["pair_id", "pt"]))


_TURNS = 10
_BENT = [
    _CLOUD,
    _MOVED,
    "co AS MATERIALIZED (SELECT c.*, m.x + CASE WHEN pt % 3 = 0 THEN 0.3 * (pt % 7 - 3) ELSE 0.004 * (pt % 5) END AS tx, m.y AS ty, m.z AS tz FROM cl c JOIN mv m USING (pair_id, pt))",
    """fit AS MATERIALIZED (SELECT pair_id, i, j, d, greatest(0, 1 - (d / 0.05::DOUBLE)^2) AS w FROM (SELECT a.pair_id, a.pt AS i, b.pt AS j,
        abs(sqrt((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) - sqrt((a.tx - b.tx)^2 + (a.ty - b.ty)^2 + (a.tz - b.tz)^2)) AS d
        FROM co a JOIN co b ON a.pair_id = b.pair_id AND a.pt <> b.pt) p)""",
    """second AS MATERIALIZED (SELECT a.pair_id, a.i, b.j, sum(a.w * b.w) * any_value(m.w) AS w FROM fit a JOIN fit b ON a.pair_id = b.pair_id AND a.j = b.i
        JOIN fit m ON m.pair_id = a.pair_id AND m.i = a.i AND m.j = b.j WHERE m.w > 0 GROUP BY ALL)""",
    "v0 AS MATERIALIZED (SELECT pair_id, pt, 1.0::DOUBLE / count(*) OVER (PARTITION BY pair_id) AS v FROM co)",
    *[
        f"""v{t + 1} AS MATERIALIZED (SELECT pair_id, pt, y / sqrt(sum(y * y) OVER (PARTITION BY pair_id)) AS v FROM
        (SELECT v.pair_id, v.pt, coalesce(sum(s.w * u.v), 0) AS y FROM v{t} v LEFT JOIN second s ON s.pair_id = v.pair_id AND s.i = v.pt
         LEFT JOIN v{t} u ON u.pair_id = s.pair_id AND u.pt = s.j GROUP BY ALL) p)"""
        for t in range(_TURNS)
    ],
]


@query(
    "compatibility_weights",
    select(
        "pair_id, pt, degree, ~support, ~v AS weight",
        f"""v{_TURNS} JOIN (SELECT pair_id, i AS pt, count(*) FILTER (d <= 0.05) AS degree FROM fit GROUP BY ALL) d USING (pair_id, pt)
            JOIN (SELECT co.pair_id, co.pt, coalesce(sum(w), 0) AS support FROM co LEFT JOIN second s ON s.pair_id = co.pair_id AND s.i = co.pt GROUP BY ALL) w USING (pair_id, pt)""",
        _BENT,
    ),
)
def compatibility_weights(spark, sf):
    """Degrees and second-order weights where the limit rejects a good share."""
    matches = _bent(spark, sf)
    weights = compatibility.compatibility_weights(matches, 0.05, _TURNS)
    return weights.join(cloud.compatibility(matches, 0.05), ["pair_id", "pt"]).select("pair_id", "pt", "degree", "support", "weight")


@query("compatible_pose", select("pair_id, true AS found", "(SELECT DISTINCT pair_id FROM cl) p", [_CLOUD]))
def compatible_pose(spark, sf):
    """Wrong correspondences carry no weight, so the turn behind the others is found."""
    found = compatibility.compatible_pose(_bent(spark, sf), 0.05, 20)
    return found.withColumn("true_pose", cloud.pose_of(_QUARTER)).select(
        "pair_id", (cloud.rotation_error("pose", "true_pose") < 5.0).alias("found")
    )


@query("icp")
def icp(spark, sf):
    source, target, poses = posed_pairs(spark, sf)
    found = materialize(cloud.icp(source, target, rounds=8))
    return found.withColumnRenamed("pose", "est").join(poses, "pair_id").select(
        "pair_id", "rounds", "error", cloud.rotation_error("est", "pose").alias("rotation_error_deg")
    )


# four degrees about z and a small shift
_NUDGE = [[0.9975640502598242, -0.0697564737441253, 0, 0.01], [0.0697564737441253, 0.9975640502598242, 0, -0.008], [0, 0, 1, 0.005]]


def _nudged(spark, sf):
    source = materialize(clouds(spark, sf))
    target = cloud.apply_pose(source.withColumn("pose", cloud.pose_of(_NUDGE))).drop("pose").withColumn("side", F.lit("target"))
    return source, materialize(target)


def _recovered(found):
    return found.withColumn("true_pose", cloud.pose_of(_NUDGE)).select(
        "pair_id",
        (cloud.rotation_error("pose", "true_pose") < 0.05).alias("found"),
        (cloud.translation_error("pose", "true_pose") < 0.001).alias("placed"),
    )


@query("icp_small_motion", select("pair_id, true AS found, true AS placed", "(SELECT DISTINCT pair_id FROM cl) p", [_CLOUD]))
def icp_small_motion(spark, sf):
    """A motion smaller than the gaps between points is found exactly; clouds over 20 points are searched, not met all at once."""
    source, target = _nudged(spark, sf)
    return _recovered(cloud.icp(source, target, rounds=12, few=20))


@query("trimmed_icp", select("pair_id, true AS found, true AS placed", "(SELECT DISTINCT pair_id FROM cl) p", [_CLOUD]))
def trimmed_icp(spark, sf):
    """Some target points lie elsewhere, so the closest 0.7 of the source decide."""
    source, target = _nudged(spark, sf)
    astray = F.when(F.col("pt") % 10 == 1, F.col("x") + 3.0).otherwise(F.col("x"))
    return _recovered(cloud.icp(source, target.withColumn("x", astray), rounds=20, keep=0.7, few=20))


def pair_table(spark, sf):
    """Two methods on every pair: exact correspondences and the untouched start pose."""
    source, target, poses, pairs = _matches(spark, sf)
    identity = cloud.pose_of([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    solved = materialize(cloud.kabsch(pairs))
    estimates = solved.select(F.lit("kabsch").alias("method"), "pair_id", "pose").unionByName(
        poses.select(F.lit("identity").alias("method"), "pair_id", identity.alias("pose"))
    )
    moved = cloud.apply_pose(source.join(solved, "pair_id")).drop("pose")
    distances = cloud.chamfer(moved, target).withColumn("method", F.lit("kabsch")).unionByName(
        cloud.chamfer(source, target).withColumn("method", F.lit("identity"))
    )
    return materialize(cloud.pair_results(estimates.withColumn("runtime_sec", F.lit(0.0)), poses, distances))


def _hash01(tag: str) -> str:
    return _u(f"'42:' || pair_id || ':{tag}'")


_POSES = [
    _CLOUD,
    f"""po AS MATERIALIZED (SELECT pair_id, cos(ax) AS cx, sin(ax) AS sx, cos(ay) AS cy, sin(ay) AS sy, cos(az) AS cz, sin(az) AS sz, tx, ty, tz FROM (SELECT pair_id,
      {", ".join(f"{_hash01('r' + a)} * radians(20.0::DOUBLE) AS a{a}, (2 * {_hash01('t' + a)} - 1) * 0.05::DOUBLE AS t{a}" for a in cloud.AXES)} FROM (SELECT DISTINCT pair_id FROM cl) d) p)""",
    """mp AS MATERIALIZED (SELECT pair_id, pt, cy * cz * x + (sx * sy * cz - cx * sz) * y + (cx * sy * cz + sx * sz) * z + tx AS x,
      cy * sz * x + (sx * sy * sz + cx * cz) * y + (cx * sy * sz - sx * cz) * z + ty AS y, -sy * x + sx * cy * y + cx * cy * z + tz AS z FROM cl JOIN po USING (pair_id))""",
    f"""ch AS (SELECT pair_id, sum(d) AS chamfer FROM (SELECT pair_id, avg(d) AS d FROM (SELECT a.pair_id, a.pt, {_D2} AS d FROM cl a JOIN mp b ON a.pair_id = b.pair_id GROUP BY ALL) p GROUP BY pair_id
      UNION ALL SELECT pair_id, avg(d) FROM (SELECT a.pair_id, a.pt, {_D2} AS d FROM mp a JOIN cl b ON a.pair_id = b.pair_id GROUP BY ALL) q GROUP BY pair_id) u GROUP BY pair_id)""",
    """res AS MATERIALIZED (SELECT *, rotation <= 15 AND translation <= 0.5 AS success FROM (
      SELECT 'identity' AS method, pair_id, degrees(acos(greatest(-1, least(1, (cy * cz + sx * sy * sz + cx * cz + cx * cy - 1) / 2)))) AS rotation, sqrt(tx^2 + ty^2 + tz^2) AS translation, chamfer FROM po JOIN ch USING (pair_id)
      UNION ALL SELECT 'kabsch', pair_id, 0, 0, 0 FROM po) r)""",
]
#: Angles of a pose against itself are noise of an arc cosine: four digits of all errors are compared.
_METRIC = """count(*) AS num_pairs, round(avg(rotation), 4) AS rotation_mean, round(sqrt(avg(rotation^2)), 4) AS rotation_rmse, round(avg(translation), 4) AS translation_mean,
  round(sqrt(avg(translation^2)), 4) AS translation_rmse, round(avg(chamfer), 4) AS chamfer_mean, round(avg(success::INT), 4) AS success_rate, 0.0::DOUBLE AS skip_rate, 0.0::DOUBLE AS runtime_mean,
  round(avg(rotation) + 50 * avg(translation), 4) AS pose_error"""


def _four(df):
    return df.withColumns({c: F.round(c, 4) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


@query(
    "pair_results",
    select(
        """method, pair_id, round(rotation, 4) AS rotation_error_deg, round(translation, 4) AS translation_error, round(chamfer, 4) AS chamfer, 0.0::DOUBLE AS runtime_sec, false AS skipped, success,
        round(chamfer + 0.02 * rotation + 2 * translation + CASE WHEN success THEN 0 ELSE 1 END, 4) AS score""",
        "res",
        _POSES,
    ),
)
def pair_results(spark, sf):
    return _four(cloud.row_score(pair_table(spark, sf)))


@query("registration_metrics", select(f"method, {_METRIC}", "res", _POSES, "GROUP BY method"))
def registration_metrics(spark, sf):
    return _four(cloud.registration_metrics(pair_table(spark, sf)))


@query(
    "registration_macro",
    select(
        """method, count(*) AS num_cases, round(avg(success::INT), 4) AS success_rate, round(avg(rotation) FILTER (success), 4) AS rotation_mean, round(avg(translation) FILTER (success), 4) AS translation_mean,
        round(avg(chamfer) FILTER (success), 4) AS chamfer_mean""",
        "res",
        _POSES,
        "GROUP BY method",
    ),
)
def registration_macro(spark, sf):
    """Every pair counts as a case of its own."""
    cases = cloud.registration_metrics(pair_table(spark, sf), ["method", "pair_id"])
    return _four(cloud.macro_metrics(cases))


@query(
    "ball_query",
    select(
        "pair_id, pt, neighbour, slot::INT AS slot",
        """(SELECT a.pair_id, a.pt, b.pt AS neighbour, row_number() OVER (PARTITION BY a.pair_id, a.pt ORDER BY b.pt) AS slot FROM cl a JOIN cl b
            ON a.pair_id = b.pair_id AND (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2 <= 0.04) n""",
        [_CLOUD],
        "WHERE slot <= 4",
    ),
)
def ball_query(spark, sf):
    return cloud.ball_query(materialize(clouds(spark, sf)), 0.2, 4)


@query("point_normals")
def point_normals(spark, sf):
    found = cloud.normals(materialize(clouds(spark, sf)), 8)
    return found.select("pair_id", "pt", *[found.normal[i].alias(f"n{a}") for i, a in enumerate(cloud.AXES)])


@query("robustness_cases")
def robustness_cases(spark, sf):
    """Correspondence poses under every robustness case, averaged over cases."""
    source, target, poses, _ = _matches(spark, sf)
    there = target.select("pair_id", "pt", *[F.col(a).alias(f"t{a}") for a in cloud.AXES])
    cases = None
    for name in cloud.CASES:
        seen = materialize(cloud.case_clouds(source, name))
        solved = materialize(cloud.kabsch(seen.join(there, ["pair_id", "pt"])))
        estimates = solved.select(F.lit("kabsch").alias("method"), "pair_id", "pose", F.lit(0.0).alias("runtime_sec"))
        moved = materialize(cloud.apply_pose(source.join(solved, "pair_id")).drop("pose"))
        distances = cloud.chamfer(moved, target).withColumn("method", F.lit("kabsch"))
        results = cloud.pair_results(estimates, poses, distances)
        part = materialize(cloud.registration_metrics(results).withColumn("case", F.lit(name)))
        cases = part if cases is None else cases.unionByName(part)
    return cloud.macro_metrics(cases)
