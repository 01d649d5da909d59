"""Point-cloud tables: many pairs at once, one row per point.

Tables: ``clouds`` (pair_id, side, pt, x, y, z), poses as twelve numbers row by row
(r11 r12 r13 t1 ...).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import nearest
from trackloom.operators.neighbours import BLOCK_OBJECTS, neighbour_stats
from trackloom.operators.protocol import hash_order
from trackloom.operators.retrieval import uniform_hash
from trackloom.operators.scale import percentiles
from trackloom.session import materialize

AXES = ["x", "y", "z"]
POSE_WEIGHT = 50.0
NEAR_BLOCK = 256
#: Correspondences of a block, and of a tile of two blocks that is compared at once.
DEGREE_BLOCK = 8192
DEGREE_TILE = 256
# Success limits and the robustness cases.
MAX_ROTATION = 15.0
MAX_TRANSLATION = 0.5


def at(pose: str, row: int, column: int) -> Column:
    return F.get(F.col(pose), F.lit(4 * row + column))


def apply_pose(points: DataFrame, pose: str = "pose", axes: Sequence[str] = tuple(AXES), rotate_only: bool = False) -> DataFrame:
    """x R' + t on the named axes (normals are only rotated)."""
    out = {}
    for r, name in enumerate(axes):
        total = sum((at(pose, r, c) * F.col(a) for c, a in enumerate(axes)), F.lit(0.0))
        out[name] = total if rotate_only else total + at(pose, r, 3)
    return points.withColumns(out)


def compose(a: str, b: str) -> Column:
    """Pose that applies b first, then a."""
    cells = []
    for r in range(3):
        for c in range(4):
            total = sum((at(a, r, k) * at(b, k, c) for k in range(3)), F.lit(0.0))
            cells.append(total + at(a, r, 3) if c == 3 else total)
    return F.array(*cells)


def invert(pose: str) -> Column:
    cells = []
    for r in range(3):
        cells += [at(pose, c, r) for c in range(3)]
        cells.append(-sum((at(pose, c, r) * at(pose, c, 3) for c in range(3)), F.lit(0.0)))
    return F.array(*cells)


def rotation_error(a: str, b: str) -> Column:
    """Angle in degrees between the rotations of two (orthonormal) poses."""
    trace = sum((at(a, r, c) * at(b, r, c) for r in range(3) for c in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) / 2.0))))


def translation_error(a: str, b: str) -> Column:
    return F.sqrt(sum(((at(a, r, 3) - at(b, r, 3)) ** 2 for r in range(3)), F.lit(0.0)))


def pose_of(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.lit(float(v)) for row in rows for v in row])


def nearest_points(
    source: DataFrame, target: DataFrame, block: int = NEAR_BLOCK, axes: Sequence[str] = tuple(AXES), few: int = nearest.FEW
) -> DataFrame:
    """Nearest target point of every source point of a pair: ``near`` (d2, pt, x, y, z).

    Blocks of pairs of at most ``few`` target points (counted) meet all at once, larger ones are searched leaf by leaf, and those of
    more than ``nearest.MANY`` in voxel rings.  Of equally near points the one with the lesser ``pt`` is taken; a target
    point without a coordinate is near to none.
    """
    target = target.dropna(subset=list(axes))
    sizes = target.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"))
    low, high = sizes.agg(F.min("_n"), F.max("_n")).first()
    if high is None or high <= few:
        return _nearest_in_blocks(source, target, block, axes)
    if low > few and high <= nearest.MANY:
        return nearest.by_leaves(source, target, axes)
    sizes = materialize(sizes)

    def those(size: str) -> tuple[DataFrame, DataFrame]:
        some = sizes.where(size).select("pair_id")
        return source.join(some, "pair_id", "left_semi"), target.join(some, "pair_id", "left_semi")

    middle = those(f"_n > {few} AND _n <= {nearest.MANY}")
    found = _nearest_in_blocks(*those(f"_n <= {few}"), block, axes).unionByName(nearest.by_leaves(*middle, axes))
    if high <= nearest.MANY:
        return found
    large = those(f"_n > {nearest.MANY} AND _n > {few}")
    done, left = nearest.in_rings(*large, axes)
    return found.unionByName(done).unionByName(nearest.by_leaves(materialize(left), large[1], axes))


def _nearest_in_blocks(source: DataFrame, target: DataFrame, block: int, axes: Sequence[str]) -> DataFrame:
    """Every source block of a pair meets every target block.

    Clouds are packed into hash blocks of bounded size; source and target blocks of
    a pair meet on an equi key and reduce to one candidate per source point at
    once.  A large pair spreads over (blocks x blocks) tasks.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
        marked = df.join(sizes, "pair_id").withColumn("_b", F.pmod(F.xxhash64("pt"), F.col("_nb")).cast("int"))
        return marked.groupBy("pair_id", "_nb", "_b").agg(F.collect_list(F.struct("pt", *axes)).alias(name))

    right = packed(target, "_t").select("pair_id", F.col("_b").alias("_tb"), F.col("_nb").alias("_tn"), "_t")
    counts = right.select("pair_id", "_tn").distinct()
    left = packed(source, "_s").join(counts, "pair_id").withColumn(
        "_tb", F.explode(F.sequence(F.lit(0), F.col("_tn") - 1))
    )
    met = left.drop("_tn").join(right.drop("_tn"), ["pair_id", "_tb"])

    def closest(s):
        found = F.transform(
            "_t",
            lambda t: F.struct(
                sum(((s[a] - t[a]) * (s[a] - t[a]) for a in axes), F.lit(0.0)).alias("d2"),
                t["pt"].alias("pt"),
                *[t[a].alias(a) for a in axes],
            ),
        )
        return F.struct(s["pt"].alias("pt"), *[s[a].alias(a) for a in axes], F.array_min(found).alias("near"))

    rows = met.select("pair_id", F.explode(F.transform("_s", closest)).alias("r")).select("pair_id", "r.*")
    return rows.groupBy("pair_id", "pt").agg(
        *[F.first(a).alias(a) for a in axes], F.min("near").alias("near")
    )


def chamfer(source: DataFrame, target: DataFrame, keep: float = 1.0) -> DataFrame:
    """Mean nearest squared distance both ways per pair, over the closest share of points."""
    both = None
    for a, b in ((source, target), (target, source)):
        d2 = nearest_points(a, b).select("pair_id", F.col("near.d2").alias("d2"))
        if keep < 1.0:
            d2 = _closest_share(materialize(d2), "d2", keep)
        part = d2.groupBy("pair_id").agg(F.avg("d2").alias("_d"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("pair_id").agg(F.sum("_d").alias("chamfer"))


def _closest_share(rows: DataFrame, value: str, keep: float) -> DataFrame:
    """Rows up to the (keep)-th order statistic of each pair."""
    cut = percentiles(
        rows, ["pair_id"], {"_cut": (value, lambda n: F.greatest(F.ceil(n * F.lit(float(keep))) - 1, F.lit(0)))}
    )
    return rows.join(cut, "pair_id").where(F.col(value) <= F.col("_cut")).drop("_cut")


def voxel_means(points: DataFrame, size: float) -> DataFrame:
    """One mean point per voxel and side."""
    cells = [F.floor(F.col(a) / size).cast("long").alias(f"v{a}") for a in AXES]
    return points.groupBy("pair_id", "side", *cells).agg(
        *[F.avg(a).alias(a) for a in AXES], F.count(F.lit(1)).alias("points")
    )


def crop(points: DataFrame, keep: float, seed: int = 42) -> DataFrame:
    """Keep the points above the (1 - keep) percentile along a random direction per pair.

    Directions come from the hash of seed and pair; positions are centred first, and
    keep = 0.5 keeps the positive side.
    """
    keys = ["pair_id", "side"]
    angle = 2 * math.pi * uniform_hash(seed, F.col("pair_id"), F.lit("a"))
    up = 2 * uniform_hash(seed, F.col("pair_id"), F.lit("z")) - 1
    flat = F.sqrt(1 - up * up)
    means = points.groupBy(*keys).agg(*[F.avg(a).alias(f"_m{a}") for a in AXES])
    along = (
        (F.col("x") - F.col("_mx")) * flat * F.cos(angle)
        + (F.col("y") - F.col("_my")) * flat * F.sin(angle)
        + (F.col("z") - F.col("_mz")) * up
    )
    rows = points.join(means, keys).withColumn("_along", along)
    if keep == 0.5:
        return rows.where(F.col("_along") > 0).select(*points.columns)
    rows = materialize(rows)
    cut = percentiles(rows, keys, {"_cut": ("_along", 1.0 - keep)})
    return rows.join(cut, keys).where(F.col("_along") > F.col("_cut")).select(*points.columns)


def jitter(points: DataFrame, scale: float = 0.01, clip: float = 0.05, seed: int = 42) -> DataFrame:
    """Add clipped normal noise, reproducible per point and axis (Box-Muller on hashes)."""

    def noise(axis: str) -> Column:
        u = uniform_hash(seed, F.col("pair_id"), F.col("side"), F.col("pt"), F.lit(axis))
        v = uniform_hash(seed, F.col("pair_id"), F.col("side"), F.col("pt"), F.lit(axis + "2"))
        normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), normal * scale))

    return points.withColumns({a: F.col(a) + noise(a) for a in AXES})


def random_poses(pairs: DataFrame, max_angle: float = 45.0, max_shift: float = 0.5, seed: int = 42) -> DataFrame:
    """A pose per pair from Euler angles and a shift, by the hash of seed and pair."""
    angle = {
        a: uniform_hash(seed, F.col("pair_id"), F.lit(f"r{a}")) * math.radians(max_angle) for a in AXES
    }
    shift = {a: (2 * uniform_hash(seed, F.col("pair_id"), F.lit(f"t{a}")) - 1) * max_shift for a in AXES}
    cx, sx = F.cos(angle["x"]), F.sin(angle["x"])
    cy, sy = F.cos(angle["y"]), F.sin(angle["y"])
    cz, sz = F.cos(angle["z"]), F.sin(angle["z"])
    cells = [
        cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz, shift["x"],
        cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz, shift["y"],
        -sy, sx * cy, cx * cy, shift["z"],
    ]
    return pairs.select("pair_id", F.array(*cells).alias("pose"))


def resample_points(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n points per (pair, side): without repeats first, then again from the start.

    Order is by hash; the row_number <= n filter prunes before the shuffle.
    """
    keys = ["pair_id", "side"]
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    order = hash_order(seed, F.col("pair_id").cast("string"), F.col("side"), F.col("pt").cast("string"))
    w = Window.partitionBy(*keys).orderBy(order, "pt")
    first = points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    times = F.floor((n - F.col("_rn")) / F.least(F.col("_n"), F.lit(n))) + 1
    repeated = first.join(counts, keys).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return repeated.drop("_rn", "_n")


def kabsch(matches: DataFrame) -> DataFrame:
    """Best rigid pose per pair of weighted correspondences (x, y, z) -> (tx, ty, tz).

    Spark reduces each pair to sixteen sums; only the 3 x 3 decomposition runs in
    NumPy, batched over pairs.
    """
    w = F.col("weight") if "weight" in matches.columns else F.lit(1.0)
    sums = [F.sum(w).alias("w")]
    sums += [F.sum(w * F.col(a)).alias(f"s{a}") for a in AXES]
    sums += [F.sum(w * F.col(f"t{a}")).alias(f"d{a}") for a in AXES]
    sums += [F.sum(w * F.col(a) * F.col(f"t{b}")).alias(f"c{a}{b}") for a in AXES for b in AXES]
    reduced = matches.groupBy("pair_id").agg(*sums)

    @F.pandas_udf("array<double>")
    def solve(*columns: pd.Series) -> pd.Series:
        table = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)
        weight = np.maximum(table[:, 0], 1e-12)
        source, target = table[:, 1:4] / weight[:, None], table[:, 4:7] / weight[:, None]
        cross = table[:, 7:].reshape(-1, 3, 3) / weight[:, None, None] - source[:, :, None] * target[:, None, :]
        u, _, vt = np.linalg.svd(cross)
        v = np.swapaxes(vt, 1, 2)
        flip = np.sign(np.linalg.det(v @ np.swapaxes(u, 1, 2)))
        v[:, :, 2] *= np.where(flip < 0, -1.0, 1.0)[:, None]
        rotation = v @ np.swapaxes(u, 1, 2)
        shift = target - np.einsum("nij,nj->ni", rotation, source)
        poses = np.concatenate([rotation, shift[:, :, None]], axis=2).reshape(-1, 12)
        return pd.Series(list(poses))

    names = ["w", *[f"s{a}" for a in AXES], *[f"d{a}" for a in AXES], *[f"c{a}{b}" for a in AXES for b in AXES]]
    return reduced.select("pair_id", solve(*names).alias("pose"))


def icp(
    source: DataFrame, target: DataFrame, rounds: int = 20, keep: float = 1.0, tolerance: float = 1e-6, few: int = nearest.FEW
) -> DataFrame:
    """Point-to-point ICP of all pairs at once (trimmed when keep < 1).

    Every round is a nearest-point join, a per-pair reduction and a pose update over
    the pairs still moving; finished pairs leave the loop.  Each round is written
    to the shared folder.
    """
    identity = pose_of([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    state = materialize(
        source.select("pair_id").distinct().select("pair_id", identity.alias("pose"), F.lit(float("inf")).alias("error"))
    )
    done = None
    for turn in range(1, rounds + 1):
        moved = apply_pose(source.join(state.select("pair_id", "pose"), "pair_id"))
        near = nearest_points(moved.select("pair_id", "pt", *AXES), target, few=few)
        flat = materialize(near.select("pair_id", "pt", *AXES, F.col("near.d2").alias("d2"), *[F.col(f"near.{a}").alias(f"t{a}") for a in AXES]))
        if keep < 1.0:
            flat = materialize(_closest_share(flat, "d2", keep))
        step = kabsch(flat).withColumnRenamed("pose", "_step").join(
            flat.groupBy("pair_id").agg(F.avg(F.sqrt("d2")).alias("_now")), "pair_id"
        )
        updated = materialize(
            state.join(step, "pair_id").select(
                "pair_id",
                compose("_step", "pose").alias("pose"),
                F.col("_now").alias("error"),
                (F.abs(F.col("error") - F.col("_now")) < tolerance).alias("_still"),
                F.lit(turn).alias("rounds"),
            )
        )
        finished = updated.where("_still" if turn < rounds else "true").drop("_still")
        done = finished if done is None else done.unionByName(finished)
        state = updated.where("NOT _still").select("pair_id", "pose", "error")
        if state.isEmpty():
            break
    return done


def pair_results(estimates: DataFrame, truth: DataFrame, distances: DataFrame) -> DataFrame:
    """Errors and flags per method and pair; a pair without estimate counts as identity, failed.

    ``estimates``: method, pair_id, pose (null when skipped), runtime_sec.
    """
    identity = pose_of([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    joined = (
        estimates.join(truth.withColumnRenamed("pose", "_gt"), "pair_id")
        .join(distances, ["method", "pair_id"], "left")
        .withColumn("skipped", F.col("pose").isNull())
        .withColumn("_est", F.coalesce("pose", identity))
    )
    rot, shift = rotation_error("_est", "_gt"), translation_error("_est", "_gt")
    return joined.select(
        "method",
        "pair_id",
        rot.alias("rotation_error_deg"),
        shift.alias("translation_error"),
        "chamfer",
        "runtime_sec",
        "skipped",
        (~F.col("skipped") & (rot <= MAX_ROTATION) & (shift <= MAX_TRANSLATION)).alias("success"),
    )


def registration_metrics(results: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Means, RMS, success, skip rate and runtime per method; infinite without a valid pair."""
    used = ~F.col("skipped")
    inf = F.lit(float("inf"))

    def mean(c: str):
        return F.coalesce(F.avg(F.when(used, F.col(c))), inf)

    def rms(c: str):
        return F.coalesce(F.sqrt(F.avg(F.when(used, F.col(c) * F.col(c)))), inf)

    table = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_pairs"),
        mean("rotation_error_deg").alias("rotation_mean"),
        rms("rotation_error_deg").alias("rotation_rmse"),
        mean("translation_error").alias("translation_mean"),
        rms("translation_error").alias("translation_rmse"),
        mean("chamfer").alias("chamfer_mean"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg(F.col("skipped").cast("double")).alias("skip_rate"),
        F.avg("runtime_sec").alias("runtime_mean"),
    )
    return table.withColumn("pose_error", F.col("rotation_mean") + POSE_WEIGHT * F.col("translation_mean"))


def macro_metrics(cases: DataFrame) -> DataFrame:
    """Mean over cases; errors only from cases with a success."""
    hit = F.col("success_rate") > 0
    return cases.groupBy("method").agg(
        F.count(F.lit(1)).alias("num_cases"),
        F.avg("success_rate").alias("success_rate"),
        F.avg(F.when(hit, F.col("rotation_mean"))).alias("rotation_mean"),
        F.avg(F.when(hit, F.col("translation_mean"))).alias("translation_mean"),
        F.avg(F.when(hit, F.col("chamfer_mean"))).alias("chamfer_mean"),
    )


def row_score(results: DataFrame) -> DataFrame:
    """Badness of a pair: Chamfer, weighted errors, runtime and a failure point, never below 0."""
    score = (
        F.col("chamfer")
        + 0.02 * F.col("rotation_error_deg")
        + 2.0 * F.col("translation_error")
        + 0.5 * F.col("runtime_sec")
        + (~F.col("success")).cast("double")
    )
    return results.withColumn("score", F.greatest(F.lit(0.0), score))


def compatibility(matches: DataFrame, tau: float, block: int = DEGREE_BLOCK) -> DataFrame:
    """Degree of each correspondence: others of the pair that keep distances within tau.

    Correspondences (pt, x, y, z, tx, ty, tz) are dealt to blocks; every two blocks of a pair meet once, in a task that counts
    tile by tile for both of them.  No edge list is written.
    """
    columns = [*AXES, *[f"t{a}" for a in AXES]]
    sizes = matches.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    points = matches.select("pair_id", "pt", *[F.col(c).cast("double").alias(c) for c in columns])
    marked = points.join(sizes, "pair_id").withColumn("_b", F.pmod(F.xxhash64("pt"), F.col("_nb")).cast("int"))
    dealt = marked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        "pair_id", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "pt", *columns
    )
    key = ["pair_id", "_i", "_j"]
    placed = dealt.repartition(*key).sortWithinPartitions(*key, "_b")
    kind = {c: matches.schema[c].dataType.simpleString() for c in ("pair_id", "pt")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            places = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in places], axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                at = tuple(x[start] for x in places)
                if at != held and parts:
                    yield _degrees(pa.Table.from_batches(parts), columns, tau)
                    parts = []
                held = at
                parts.append(batch.slice(int(start), int(stop - start)))
        if parts:
            yield _degrees(pa.Table.from_batches(parts), columns, tau)

    rows = placed.mapInArrow(work, f"pair_id {kind['pair_id']}, pt {kind['pt']}, degree long")
    return rows.groupBy("pair_id", "pt").agg(F.sum("degree").alias("degree"))


def _degrees(rows: pa.Table, columns: Sequence[str], tau: float) -> pa.RecordBatch:
    """Of two blocks, or of one with itself: how many correspondences of the other block each one fits."""
    rows = rows.combine_chunks()
    i, j = (rows[c][0].as_py() for c in ("_i", "_j"))
    of = rows["_b"].to_numpy()
    xyz = np.array([rows[c].to_numpy() for c in columns], dtype=float)
    degree = np.zeros(len(of), np.int64)
    # equal points are of one block
    name = rows["pt"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if i == j else None
    first, second = np.flatnonzero(of == i), np.flatnonzero(of == j)

    def lengths(a: np.ndarray, b: np.ndarray, axes: range) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for axis in axes:
            step = xyz[axis][a][:, None] - xyz[axis][b][None, :]
            step *= step
            out += step
        return np.sqrt(out, out=out)

    for start in range(0, len(first), DEGREE_TILE):
        a = first[start : start + DEGREE_TILE]
        for other in range(start if i == j else 0, len(second), DEGREE_TILE):
            b = second[other : other + DEGREE_TILE]
            apart = lengths(a, b, range(3))
            apart -= lengths(a, b, range(3, 6))
            fits = np.abs(apart, out=apart) <= tau
            if i == j:
                fits &= name[a, None] != name[None, b]
            degree[a] += np.count_nonzero(fits, axis=1)
            if i != j or other > start:
                degree[b] += np.count_nonzero(fits, axis=0)
    names = ["pair_id", "pt", "degree"]
    return pa.RecordBatch.from_arrays([*[rows[c].combine_chunks() for c in names[:2]], pa.array(degree)], names=names)


def ball_query(points: DataFrame, radius: float, n: int, block: int = NEAR_BLOCK) -> DataFrame:
    """The first n points (by index) within the radius of every point, itself included.

    Block pairs reduce to n candidates per point at once; the candidates of all
    blocks of a point are then cut to n again.
    """
    met = _self_blocks(points, block)

    def near(a):
        inside = F.filter("_o", lambda b: sum(((a[c] - b[c]) ** 2 for c in AXES), F.lit(0.0)) <= radius * radius)
        found = F.array_sort(F.transform(inside, lambda b: b["pt"]))
        return F.struct(a["pt"].alias("pt"), F.slice(found, 1, n).alias("found"))

    rows = met.select("pair_id", F.explode(F.transform("_m", near)).alias("r")).select("pair_id", "r.*")
    hits = rows.select("pair_id", "pt", F.explode("found").alias("neighbour"))
    w = Window.partitionBy("pair_id", "pt").orderBy("neighbour")
    return hits.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n)


def _self_blocks(points: DataFrame, block: int) -> DataFrame:
    """Every block of a cloud (``_m``) with every block of the same cloud (``_o``)."""
    sizes = points.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    marked = points.join(sizes, "pair_id").withColumn("_b", F.pmod(F.xxhash64("pt"), F.col("_nb")).cast("int"))
    packed = marked.groupBy("pair_id", "_nb", "_b").agg(F.collect_list(F.struct("pt", *AXES)).alias("_m"))
    left = packed.select("pair_id", "_m", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_b"))
    return left.join(packed.select("pair_id", "_b", F.col("_m").alias("_o")), ["pair_id", "_b"])


def normals(points: DataFrame, k: int = 8, block: int = BLOCK_OBJECTS) -> DataFrame:
    """Unit normal of every point: the thinnest direction of its k nearest points.

    Spark finds the neighbours and sums their moments; NumPy takes the smallest
    eigenvector of the 3 x 3 covariances, batched.  The largest component of a
    normal is positive.
    """
    near = neighbour_stats(points, ["pair_id"], "pt", AXES, k, extra=AXES, block=block, totals=False)
    best = near.select("pair_id", "pt", F.explode("nearest").alias("n"))
    moments = best.groupBy("pair_id", "pt").agg(
        *[F.covar_pop(f"n.{a}", f"n.{b}").alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    )

    @F.pandas_udf("array<double>")
    def thinnest(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        cells = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).astype(float).reshape(-1, 3, 3)
        _, vectors = np.linalg.eigh(cells)
        normal = vectors[:, :, 0]
        lead = np.take_along_axis(normal, np.abs(normal).argmax(axis=1)[:, None], axis=1)
        return pd.Series(list(normal * np.where(lead < 0, -1.0, 1.0)))

    names = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
    return moments.select("pair_id", "pt", thinnest(*names).alias("normal"))


# The robustness cases (noise, points, kept share).
CASES = {
    "base_crop": ("crop", 256, 0.7),
    "sparse_crop": ("crop", 256, 0.5),
    "dense_crop": ("crop", 256, 0.9),
    "points_512": ("crop", 512, 0.7),
    "jitter": ("jitter", 256, 0.7),
    "clean": ("clean", 256, 0.7),
}


def case_clouds(points: DataFrame, case: str, seed: int = 42) -> DataFrame:
    """A cloud as one robustness case sees it: cropped or jittered, then resampled."""
    noise, count, keep = CASES[case]
    rows = crop(points, keep, seed) if noise == "crop" else points
    rows = resample_points(rows, count, seed)
    return jitter(rows, seed=seed) if noise == "jitter" else rows
