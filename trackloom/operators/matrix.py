"""Detectors by name, and their run over methods, seeds and levels.

A detector is a function of training rows, rows to score and parameters that returns ``key`` and ``score``; it is registered under a name for
one level.  At the level ``track`` rows are fused points and keys tracks, at the level ``window`` rows are points of frame windows and keys window objects.

A run writes the scores of every (level, seed, method) to a folder of its own in one commit.  A rerun finds finished parts and leaves them
alone, whatever stopped the run before.  All metrics then come from one job over the table of all parts, with level, seed and method as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import detectors, ensembles, evaluate, motion, protocol, windows
from trackloom.session import materialize

RUN = ["level", "seed", "method"]
KINEMATIC = ["max_speed", "mean_turn_angle", "modal_offset_mean"]


@dataclass(frozen=True)
class Detector:
    name: str
    level: str
    run: Callable[..., DataFrame]

    def score(self, train: DataFrame, rows: DataFrame, **params) -> DataFrame:
        """``key`` and ``score`` (double) of every track or window object of ``rows``."""
        return self.run(train, rows, **params).select("key", F.col("score").cast("double").alias("score"))


DETECTORS: dict[tuple[str, str], Detector] = {}


def detector(name: str, level: str = "track"):
    """Register a detector; a name stands for one detector of a level."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if (level, name) in DETECTORS:
            raise ValueError(f"detector {name!r} of level {level!r} registered twice")
        DETECTORS[level, name] = Detector(name, level, run)
        return run

    return register


def by_name(name: str, level: str = "track") -> Detector:
    if (level, name) not in DETECTORS:
        known = ", ".join(sorted(n for lv, n in DETECTORS if lv == level))
        raise KeyError(f"no detector {name!r} of level {level!r}; known: {known}")
    return DETECTORS[level, name]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("sample_id", "key")


@detector("simple")
def _simple(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _keyed(detectors.simple_track_scores(rows, with_events=False))


@detector("feature")
def _feature(train: DataFrame, rows: DataFrame, column: str = "max_speed") -> DataFrame:
    return _keyed(motion.handcrafted_features(rows)).withColumn("score", F.col(column))


@detector("kinematic_profile")
def _kinematic(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _keyed(detectors.kinematic_profile_scores(materialize(motion.kinematic_features(train)), motion.kinematic_features(rows)))


def _features(train: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return materialize(motion.handcrafted_features(train)), materialize(motion.handcrafted_features(rows))


@detector("nearest_profile")
def _nearest(train: DataFrame, rows: DataFrame, columns: Sequence[str] = tuple(KINEMATIC), k: int = 1) -> DataFrame:
    return _keyed(detectors.nearest_profile_scores(*_features(train, rows), list(columns), k=k))


@detector("lof")
def _lof(train: DataFrame, rows: DataFrame, columns: Sequence[str] = tuple(KINEMATIC), k: int = 20) -> DataFrame:
    return _keyed(detectors.lof_scores(*_features(train, rows), list(columns), k=k))


@detector("isolation_forest")
def _forest(train: DataFrame, rows: DataFrame, columns: Sequence[str] = tuple(KINEMATIC), seed: int = 42) -> DataFrame:
    return _keyed(ensembles.isolation_scores(*_features(train, rows), list(columns), seed=seed))


def _window_keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat_ws("|", "window_id", "sample_id"))


@detector("prediction", "window")
def _prediction(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _window_keyed(windows.linear_prediction(rows))


@detector("lightweight_group", "window")
def _lightweight(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _window_keyed(detectors.lightweight_group_scores(rows))


def track_case(rows: DataFrame, seed: int, fraction: float) -> tuple[DataFrame, DataFrame]:
    """Disturbed points and (key, label) of every track."""
    points, positives = protocol.inject_track_anomalies(rows, fraction, seed)
    return points, _keyed(protocol.complete_labels(protocol.track_keys(points), positives, seed)).select("key", "label")


def window_case(rows: DataFrame, seed: int, fraction: float) -> tuple[DataFrame, DataFrame]:
    """Disturbed window points and (key, label) of every window object."""
    points, positives = protocol.inject_group_anomalies(rows, fraction, seed)
    labels = protocol.complete_labels(protocol.window_keys(points), positives, seed, by=("window_id", "sample_id"))
    return points, _window_keyed(labels).select("key", "label")


CASES = {"track": track_case, "window": window_case}


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a part has been committed; a folder without a committed file counts as none."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def run(
    tables: Mapping[str, DataFrame],
    methods: Mapping[str, Mapping[str, tuple[str, dict]]],
    seeds: Sequence[int],
    folder: str,
    fraction: float = 0.1,
    train: Mapping[str, DataFrame] | None = None,
) -> list[tuple[str, int, str]]:
    """Score every level, seed and method that ``folder`` does not hold yet; returns the parts that were computed.

    ``tables`` has the rows of each level, ``methods`` per level a name in the results -> (detector, parameters), ``train`` the training rows of
    a level (the disturbed rows themselves without it).
    """
    computed = []
    for level, named in methods.items():
        spark = tables[level].sparkSession
        for seed in seeds:
            part = f"level={level}/seed={seed}"
            missing = [m for m in named if not _finished(spark, f"{folder}/scores/{part}/method={m}")]
            labelled = _finished(spark, f"{folder}/labels/{part}")
            if labelled and not missing:
                continue
            rows, labels = CASES[level](tables[level], seed, fraction)
            if not labelled:
                labels.write.mode("overwrite").parquet(f"{folder}/labels/{part}")
            for method in missing:
                name, params = named[method]
                base = rows if train is None else train[level]
                scores = by_name(name, level).score(base, rows, **params)
                scores.write.mode("overwrite").parquet(f"{folder}/scores/{part}/method={method}")
                computed.append((level, seed, method))
    return computed


def read_run(spark: SparkSession, folder: str) -> DataFrame:
    """One row per level, seed, method and labelled key; a key without a score, or with NaN only, scores minus infinity."""
    kinds = "key string, score double, level string, seed int, method string"
    scores = spark.read.schema(kinds).option("basePath", f"{folder}/scores").parquet(f"{folder}/scores")
    labels = spark.read.schema("key string, label int, level string, seed int").parquet(f"{folder}/labels")
    methods = scores.select(*RUN).distinct()
    truth = labels.groupBy("level", "seed", "key").agg(F.max("label").alias("label")).join(methods, ["level", "seed"])
    best = scores.groupBy(*RUN, "key").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    return truth.join(best, [*RUN, "key"], "left").select(
        *RUN, F.col("key").alias("sample_id"), "label", F.coalesce("score", F.lit(float("-inf"))).alias("score")
    )


def metrics(spark: SparkSession, folder: str, k: int = 100) -> DataFrame:
    """Ranking metrics of every level, seed and method of a run, in one job."""
    aligned = materialize(read_run(spark, folder).withColumn("score", F.round("score", 9)))
    return evaluate.curve_metrics(aligned, RUN).join(evaluate.precision_at_k(aligned, k, by=RUN), RUN)
