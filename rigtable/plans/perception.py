"""From located detections to published messages, as a batch table or a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.functions import vec
from rigtable.operators.geometry import Bounds
from rigtable.operators.tracking import TrackerConfig, asof_pose, retag_workspace, to_base, to_published, track
from rigtable.scale import running
from rigtable.streaming.stateful import track_stream

POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def posed(tracked: DataFrame, ee_T_cam: Column, bounds: Bounds | None) -> DataFrame:
    """Base position of the filtered centre from the pose columns; workspace judged afterwards."""
    pose = vec.rigid_from_quat(tuple(F.col(c) for c in POSE[:3]), tuple(F.col(c) for c in POSE[3:]))
    flat = tracked.withColumn("_pose", F.when(F.col("tx").isNotNull(), pose)).withColumn("_cam", ee_T_cam)
    flat = flat.withColumns({f"_f{a}": F.col("center_filtered")[a] for a in "xyz"})
    based = to_base(flat, ["_fx", "_fy", "_fz"], "_pose", "_cam")
    return retag_workspace(based, bounds).drop("_pose", "_cam", "_fx", "_fy", "_fz")


def publish(
    dets: DataFrame, poses: DataFrame, ee_T_cam: Column, bounds: Bounds | None = None, cfg: TrackerConfig = TrackerConfig(),
    keys: Sequence[str] = ("session_id",), max_age_s: float | None = None,
) -> DataFrame:
    """Batch plan: track, look up the pose, move to the base frame, publish what is stable.

    The latest pose at or before a detection counts, however old it is unless ``max_age_s`` is given.
    """
    tracked = track(dets, cfg)
    known = asof_pose(tracked, poses, keys, POSE, tolerance_s=max_age_s)
    return to_published(posed(known, ee_T_cam, bounds))


def second(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000))


def hour(s: Column) -> Column:
    return F.floor(s / F.lit(3600))


def pose_seconds(poses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pose table as three small steps of a search: (session_id, _hs) hours with poses; (session_id, _h, _ss) seconds
    with poses of such an hour; (session_id, _s, _ps) poses of such a second.

    Each list also starts with what was last before it, so the last entry at or before a time is always found.
    """
    by_second = poses.groupBy("session_id", second().alias("_s")).agg(F.array_sort(F.collect_list(F.struct("ts", *POSE))).alias("_own"))
    known = running(by_second, ["session_id"], hour(F.col("_s")), [F.col("_s")], {"_before": ("last", F.element_at("_own", -1))}, exclusive=True)
    known = known.withColumn("_h", hour(F.col("_s")))
    seconds = known.select("session_id", "_s", F.concat(F.array_compact(F.array("_before")), "_own").alias("_ps"))
    earlier = F.min_by(second("_before.ts"), "_s")
    hours = known.groupBy("session_id", "_h").agg(F.concat(F.array_compact(F.array(earlier)), F.array_sort(F.collect_list("_s"))).alias("_ss"))
    sessions = hours.groupBy("session_id").agg(F.array_sort(F.collect_list("_h")).alias("_hs"))
    return sessions, hours, seconds


def perception_stream(
    frames: DataFrame, poses: DataFrame, ee_T_cam: Column, bounds: Bounds | None = None, cfg: TrackerConfig = TrackerConfig(), max_age_s: float | None = None,
) -> DataFrame:
    """Stream plan: tracked stream against a stored pose table; the same messages as ``publish``.

    The latest pose is searched by hour, second and time.  Lists on the way are bounded by the sensor rate (about 100 Hz),
    the seconds of an hour, and the hours of a session.
    """
    sessions, hours, seconds = pose_seconds(poses)
    last = lambda found, at: F.try_element_at(F.filter(found, lambda x: x <= at), F.lit(-1))
    tracked = track_stream(frames, cfg)
    timed = tracked.join(sessions, "session_id", "left").withColumn("_h", last("_hs", hour(second()))).drop("_hs")
    timed = timed.join(hours, ["session_id", "_h"], "left").withColumn("_s", last("_ss", second())).drop("_ss", "_h")
    joined = timed.join(seconds, ["session_id", "_s"], "left")
    known = joined.withColumn("_hit", F.try_element_at(F.filter("_ps", lambda p: p["ts"] <= F.col("ts")), F.lit(-1))).drop("_ps", "_s")
    if max_age_s is not None:
        age = (F.unix_micros("ts") - F.unix_micros(F.col("_hit.ts"))) / 1e6
        known = known.withColumn("_hit", F.when(age <= max_age_s, F.col("_hit")))
    return to_published(posed(known.withColumns({c: F.col(f"_hit.{c}") for c in POSE}), ee_T_cam, bounds))
