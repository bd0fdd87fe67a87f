"""The streaming perception plan on a steady object: frames in, published messages out."""

import os

import pytest
from pyspark.sql import functions as F

from rigtable import schemas
from rigtable.catalog import tracking
from rigtable.catalog.bind import detections
from rigtable.functions import vec
from rigtable.plans.perception import perception_stream, publish
from rigtable.sources.readers import explode_detections
from rigtable.streaming.run import drain

SF = "/root/testdata/sf0.001"


def test_steady_object_is_published_in_the_base_frame(spark, tmp_path):
    point = lambda x, y, z: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
    det = F.struct(
        F.lit("cork").alias("class_name"), F.lit(0.9).alias("confidence"), point(0.1, 0.0, 0.3).alias("center"), point(0.02, 0.02, 0.01).alias("extent"),
        F.lit(0.0).alias("yaw_deg"), F.lit(200).alias("point_count"), F.lit(True).alias("in_workspace"), F.lit(False).alias("yaw_reliable"),
    )
    frames = spark.range(12).select(
        F.lit("s").alias("session_id"), F.col("id").alias("frame_index"), F.timestamp_millis(1_700_000_000_000 + F.col("id") * 66).alias("ts"), F.array(det).alias("detections")
    )
    frames.coalesce(1).write.json(str(tmp_path / "in"))
    pose = spark.createDataFrame([("s", 1_699_999_999_990, 1.0), ("s", 1_700_000_000_600, 2.0)], "session_id string, ms long, tx double").select(
        "session_id", F.timestamp_millis("ms").alias("ts"), "tx", *[F.lit(0.0).alias(c) for c in ("ty", "tz", "qx", "qy", "qz")], F.lit(1.0).alias("qw")
    )
    eye = vec.rigid_lit([[1, 0, 0, 0.0], [0, 1, 0, 0.0], [0, 0, 1, 0.5]])
    stream = spark.readStream.schema(schemas.FRAMES).json(str(tmp_path / "in"))
    out = drain(perception_stream(stream, pose, eye, {"x": (0.0, 3.0), "y": (-1.0, 1.0), "z": (0.0, 1.0)}), str(tmp_path / "out")).collect()
    got = {r["frame_index"]: (r["id"], round(r["position"]["x"], 6), round(r["position"]["z"], 6)) for r in out}
    # the eighth frame latches; the pose changes between frames 9 and 10
    assert got == {i: ("0", 1.1 if i < 10 else 2.1, 0.8) for i in range(7, 12)}


@pytest.mark.parametrize("max_age_s", [None, 5.0])
def test_old_poses_count_in_stream_and_batch(spark, tmp_path, max_age_s):
    """Poses seconds, hours and days before; some right after a detection, in its second or its hour."""
    point = lambda x, y, z: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
    det = F.struct(
        F.lit("cork").alias("class_name"), F.lit(0.9).alias("confidence"), point(0.1, 0.0, 0.3).alias("center"), point(0.02, 0.02, 0.01).alias("extent"),
        F.lit(0.0).alias("yaw_deg"), F.lit(200).alias("point_count"), F.lit(True).alias("in_workspace"), F.lit(False).alias("yaw_reliable"),
    )
    at = [0, 70, 140, 210, 280, 350, 420, 490, 560, 5_000, 9_000, 3_600_500, 3_700_000, 90_000_000, 200_000_000]
    start = 1_700_000_000_000
    frames = spark.createDataFrame([("s", i, start + ms) for i, ms in enumerate(at)] + [("none", i, start + ms) for i, ms in enumerate(at)], "session_id string, frame_index long, ms long")
    frames = frames.select("session_id", "frame_index", F.timestamp_millis("ms").alias("ts"), F.array(det).alias("detections"))
    frames.write.parquet(str(tmp_path / "in"))
    moves = [(-90_000_000, 1.0), (3_000, 2.0), (9_000, 3.0), (9_001, 4.0), (3_600_501, 5.0), (3_600_600, 6.0), (90_000_001, 7.0), (100_000_000, 8.0)]
    pose = spark.createDataFrame([("s", start + ms, tx) for ms, tx in moves], "session_id string, ms long, tx double").select(
        "session_id", F.timestamp_millis("ms").alias("ts"), "tx", *[F.lit(0.0).alias(c) for c in ("ty", "tz", "qx", "qy", "qz")], F.lit(1.0).alias("qw")
    )
    eye = vec.rigid_lit([[1, 0, 0, 0.0], [0, 1, 0, 0.0], [0, 0, 1, 0.5]])
    stream = spark.readStream.schema(schemas.FRAMES).parquet(str(tmp_path / "in"))
    got = drain(perception_stream(stream, pose, eye, max_age_s=max_age_s), str(tmp_path / "out")).collect()
    batch = publish(explode_detections(frames), pose, eye, max_age_s=max_age_s).collect()
    key = lambda rows: sorted((r["session_id"], r["frame_index"], r["id"], round(r["position"]["x"], 6)) for r in rows)
    assert key(got) == key(batch)

    def held(ms):
        found = [(t, tx) for t, tx in moves if t <= ms]
        return found[-1][1] if found and (max_age_s is None or ms - found[-1][0] <= max_age_s * 1000) else None

    want = [("s", i, "0", round(held(ms) + 0.1, 6)) for i, ms in enumerate(at) if i >= 7 and held(ms) is not None]
    assert key(got) == want and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_query_has_the_batch_rows(spark):
    det = detections(spark, SF)
    poses = tracking.pose_table(det).withColumn("session_id", F.col("session_id").cast("string"))
    batch = publish(explode_detections(tracking.frame_rows(det)), poses, vec.rigid_lit(tracking.EE_CAM), tracking.BOUNDS, tracking.PUBLISH_CFG)
    want = sorted(tuple(r) for r in tracking.message_rows(batch).collect())
    assert want
    assert sorted(tuple(r) for r in tracking.QUERIES["T2_perception_stream"](spark, SF).collect()) == want
