"""Event-time windows and stateless stream steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.functions import arm
from rigtable.operators.robot import decide, errors_of, gripper_joints, unnest_joints
from rigtable.scale import running
from rigtable.streaming.stateful import asof_pose_stream


def publish_stats(stream: DataFrame, keys: Sequence[str], every: str = "1 second", delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Stable and published counts per window; published ones need a transform."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, every))
        .agg(
            F.count("*").alias("n"),
            F.count_if("stable").alias("n_stable"),
            F.count_if(F.col("stable") & F.col("tf_ok")).alias("n_published"),
            F.coalesce(F.min(F.when(F.col("stable"), F.col("tf_ok"))), F.lit(False)).alias("tf_ok"),
        )
        .select(*keys, F.col("window.start").alias("start"), "n", "n_stable", "n_published", "tf_ok")
    )


def idle_sessions(stream: DataFrame, keys: Sequence[str], gap: str = "3 seconds", delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Runs of eligible events, closed once the gap passes without one."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap))
        .agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
        .select(*keys, F.col("session_window.start").alias("first_ts"), "last_ts", "n")
    )


def drop_repeated_frames(stream: DataFrame, keys: Sequence[str], delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """One row per key within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def joint_stream(states: DataFrame, gripper: DataFrame | None = None) -> DataFrame:
    """Per-joint rows, with both finger joints derived from the gripper motor."""
    rows = unnest_joints(states, drop_prefix=None)
    return rows if gripper is None else rows.unionByName(gripper_joints(gripper))


def fresh_at(ticks: DataFrame, messages: DataFrame, keys: Sequence[str], ttl_s: float = 1.0, ts: str = "ts", bucket_s: int = 3600) -> DataFrame:
    """Batch twin of freshness: is the newest array at each tick recent and not empty?"""
    both = ticks.withColumn("_side", F.lit(1)).unionByName(
        messages.select(*keys, ts, F.lit(0).alias("_side"), F.struct(F.col(ts).alias("at"), F.col("n_detections").alias("n")).alias("_msg")),
        allowMissingColumns=True,
    )
    bucket = F.floor(F.unix_micros(ts) / F.lit(bucket_s * 1_000_000))
    known = running(both, keys, bucket, [F.col(ts), F.col("_side")], {"_last": ("last", F.col("_msg"))}).filter("_side = 1")
    age = (F.unix_micros(ts) - F.unix_micros("_last.at")) / 1e6
    view = (F.col("_last.n") > 0) & (age <= ttl_s)
    return known.withColumns({"age_s": age, "in_view": F.coalesce(view, F.lit(False))}).drop("_side", "_msg", "_last")


def tracking_error_stream(
    goals: DataFrame, states: DataFrame, longest_s: float, key: str = "goal_id", ts: str = "ts", goal_delay: str = "10 seconds", state_delay: str = "10 seconds",
    path: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Desired minus actual joint values of every state that falls into a goal's time; the stream twin of ``tracking_error``.

    ``goals``: key, start time and ``points`` (see ``resample``); or other columns, of which ``path`` makes the points where a state
    meets its goal, so that not the whole path waits in state.  ``states``: key, time, ``position``, ``velocity``.  A state meets the goal of its key from its start on for ``longest_s`` at most.  Both sides have a watermark, so with this bound a goal is let
    go once no state can meet it, a state once no goal can; what comes later than a watermark is dropped and counted
    (``run.late_rows``).
    """
    made_of = ["points"] if path is None else [c for c in goals.columns if c not in (key, ts)]
    start = goals.select(key, F.col(ts).alias("goal_ts"), F.struct(*made_of).alias("_goal")).withWatermark("goal_ts", goal_delay)
    actual = states.withColumnRenamed(key, "state_key").withWatermark(ts, state_delay)
    reach = F.make_interval(secs=F.lit(longest_s))
    meets = (F.col("state_key") == F.col(key)) & (F.col(ts) >= F.col("goal_ts")) & (F.col(ts) <= F.col("goal_ts") + reach)
    both = start.join(actual, meets).drop("state_key")
    t = (F.unix_micros(ts) - F.unix_micros("goal_ts")) / 1e6
    points = F.col("_goal.points") if path is None else path(F.col("_goal"))
    timed = both.withColumns({"t": t, "_points": points})
    return errors_of(timed.withColumn("desired", arm.interp_at(F.col("_points"), F.col("t"))).drop("_points", "_goal", "goal_ts"))


def arbitrate_stream(
    commands: DataFrame, states: DataFrame, keys: Sequence[str] = ("robot_id",), policy: str = "reject", ts: str = "ts", delay: str | None = None,
    state: str = "state_machine", idle_s: float | None = None, slot_s: float = 60.0,
) -> DataFrame:
    """Decision per command from the arm state last reported at or before it, as a stream; see ``arbitrate``."""
    known = [state, "enabled"]
    asks = commands.withColumn("is_pose", F.lit(False))
    told = states.select(*keys, ts, *known, F.lit(True).alias("is_pose"))
    both = asks.unionByName(told, allowMissingColumns=True)
    out = [c for c in commands.columns if c not in (*keys, ts)]
    return decide(asof_pose_stream(both, keys, known, out, ts, idle_s, delay, slot_s).drop("tf_ok"), policy, state)
