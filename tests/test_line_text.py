"""Label lines are plain text work: no pattern formatter, and each term worked out at most a few times; boxes meet by numbers."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from rigtable.functions import text


def test_six_digits_without_a_formatter(spark):
    values = [0.0, 1.0, 0.5, 1e-7, 5e-7, 1.5e-6, 0.1234565, 0.9999995, 0.9999994, 1 / 3, 2 / 3, 0.046875]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed6(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == [f"{v:.6f}" for v in values]
    assert "format_string" not in df._jdf.queryExecution().analyzed().toString()


def test_boxes_meet_without_their_names(spark):
    plan = contract.queries()["A22_box_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]
    assert "concat_ws" not in below
