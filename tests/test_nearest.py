"""Distances that differ only by rounding are ties."""

from pyspark.sql import functions as F

from rigtable.functions import vec
from rigtable.operators import robot as rb


def test_nearest_of_equal_distances_is_the_smaller_id(spark):
    rows = [("s", 1, 0.1 + 0.2, 0.0), ("s", 2, 0.3, 0.0), ("t", 1, 0.3, 1.0), ("t", 2, 0.3, 0.0)]
    dets = spark.createDataFrame(rows, "session string, id int, x double, y double").select("session", "id", vec.pack((F.col("x"), F.col("y"), F.lit(0.0))).alias("center"))
    got = rb.nearest(dets, ["session"], vec.lits((0, 0, 0))).collect()
    assert sorted((r.session, r.id) for r in got) == [("s", 1), ("t", 2)]
