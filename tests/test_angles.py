import math

from pyspark.sql import functions as F

from rigtable.functions import angles


def test_mean_of_directions_that_cancel_is_that_of_the_c_library(spark):
    """The JVM's sine of 32.4 degrees is one unit off, which decides the mean of directions that nearly cancel."""
    ks = [(k, k + 50) for k in range(50)]
    rows = spark.createDataFrame([(i, j * 1.8 - 90.0) for i, pair in enumerate(ks) for j in pair] + [(99, None)], "i int, yaw double")
    got = dict(rows.groupBy("i").agg(angles.circ_mean_deg(F.col("yaw"))).collect())
    assert got.pop(99) == 0.0
    for i, pair in enumerate(ks):
        twice = [math.radians((k * 1.8 - 90.0) * 2.0) for k in pair]
        want = math.degrees(math.atan2(sum(map(math.sin, twice)) / 2, sum(map(math.cos, twice)) / 2)) / 2
        assert abs(got[i] - want) < 1e-9, (i, got[i], want)
