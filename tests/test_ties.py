"""Values that SQL takes as equal must be equal to the last bit, or ranks differ."""

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import motion
from trackloom.plans.registry import rounded


def test_steps_are_equal_to_the_last_bit(spark):
    at = np.round(np.random.default_rng(3).uniform(0, 500, (400, 2)), 2)
    rows = [("s:1", "s", "1", i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    points = spark.createDataFrame(rows, "sample_id string, sequence string, track_id string, frame_id int, cx double, cy double")
    steps = motion.track_steps(points).orderBy("frame_id").where(F.col("step").isNotNull())
    found = np.array([r["step"] for r in steps.collect()])
    d = np.diff(at, axis=0)
    assert (found == np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])).all()


def test_rounding_follows_the_product(spark):
    values = [0.8819224999999999, -0.8819224999999999, float("nan"), float("inf"), 1e305, None, 2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["v"] for r in rounded(df).orderBy("i").collect()]
    assert found[:2] == [0.881923, -0.881923] and np.isnan(found[2])
    assert found[3:] == [float("inf"), 1e305, None, 2.5]
