"""Calibration sessions written and read in both layouts."""

import glob
import os

from pyspark.sql import functions as F

from rigtable.sources import readers as rd
from rigtable.sources import sinks as sk


def test_sessions_as_lines_and_as_folders_read_the_same(spark, tmp_path):
    eye = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(4)]) for i in range(4)])
    sample = lambda n: F.struct(F.lit(n).alias("index"), F.lit("ä \n.png").alias("image"), eye.alias("base_T_ee"), F.lit(9).alias("n_corners"))
    docs = spark.range(0, 40, 1, 3).select(
        F.col("id").cast("string").alias("session_id"), F.lit("base").alias("base_frame"), F.when(F.col("id") > 5, "ee").alias("ee_frame"),
        F.lit("board.json").alias("board"), F.when(F.col("id") % 2 == 0, F.array(sample(0), sample(4))).otherwise(F.array(sample(2))).alias("samples"),
    )
    lines, folders = str(tmp_path / "lines"), str(tmp_path / "folders")
    sk.write_sessions(docs, lines)
    assert sk.write_sessions(docs, folders, "files").agg(F.sum("lines")).first()[0] == 40
    assert len(glob.glob(f"{folders}/*/session.json")) == 40
    # Files follow the tasks that wrote them, not the sessions.
    assert len([f for _, _, names in os.walk(lines) for f in names if f.startswith("part-")]) == 3
    a, b = (sorted(map(repr, df.collect())) for df in (rd.read_sessions(spark, lines, "lines"), rd.read_sessions(spark, folders)))
    assert a == b and len(a) == 60
