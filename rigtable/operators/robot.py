"""Arm telemetry and picking: angles, stalls, attempts, choices, goals and arbitration."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.functions import arm, vec
from rigtable.scale import running

# Gripper tolerance, stall motion, motion-lock speeds, wrap limit.
GRIPPER_TOLERANCE_RAD = 0.12
STALL_MOVE = 1e-4
LOCK_LINEAR = 0.04
LOCK_ANGULAR = 0.08
MAX_WRAP_DELTA = 3.0


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


# --- telemetry -------------------------------------------------------------------


def unnest_joints(states: DataFrame, drop_prefix: str | None = "gripper_") -> DataFrame:
    """One row per joint; unpaired array tails are ignored."""
    zipped = F.arrays_zip(F.col("name"), F.col("position"), F.col("velocity"), F.col("effort"))
    n = F.least(F.size("name"), F.size("position"))
    rows = states.select("robot_id", "ts", F.explode(F.slice(zipped, 1, n)).alias("_j")).select(
        "robot_id", "ts", F.col("_j.name").alias("joint"), "_j.position", "_j.velocity", "_j.effort"
    )
    return rows.filter(~F.col("joint").startswith(drop_prefix)) if drop_prefix else rows


def gripper_joints(states: DataFrame) -> DataFrame:
    """The two finger joints derived from a gripper motor row (position, velocity, torque)."""
    at = arm.motor_to_joint(F.col("position"))
    speed = arm.motor_to_joint(F.col("position") + F.col("velocity")) - at
    names = F.array(F.lit("gripper_joint1"), F.lit("gripper_joint2"))
    return states.select(
        "robot_id", "ts", F.explode(names).alias("joint"), at.alias("position"), speed.alias("velocity"), F.col("torque").alias("effort")
    )


def unwrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], angle: str, bucket: Column, out: str = "unwrapped") -> DataFrame:
    """Each angle moved by whole turns to within half a turn of the one before it.

    The whole turns add up along the key, so this is a running sum and no fold.
    """
    prev = running(df, keys, bucket, _cols(order), {"_prev": ("last", F.col(angle))}, exclusive=True)
    step = F.col(angle) - F.col("_prev")
    turns = F.coalesce(F.floor((step + math.pi) / (2 * math.pi)), F.lit(0))
    summed = running(prev.withColumn("_t", turns), keys, bucket, _cols(order), {"_sum": ("sum", F.col("_t"))})
    return summed.withColumn(out, F.col(angle) - F.col("_sum") * (2 * math.pi)).drop("_prev", "_t", "_sum")


def gripper_stall(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, max_effort: Column | float, target: Column | None = None) -> DataFrame:
    """``stalled``: hardly moved since the previous sample while pushing; ``reached``: near the target."""
    limit = F.lit(float(max_effort)) if isinstance(max_effort, (int, float)) else max_effort
    prev = running(df, keys, bucket, _cols(order), {"_prev": ("last", F.col("position"))}, exclusive=True)
    still = F.abs(F.col("position") - F.coalesce("_prev", F.col("position"))) < STALL_MOVE
    out = prev.withColumn("stalled", still & (F.abs("effort") >= limit)).drop("_prev")
    reached = F.lit(True) if target is None else F.coalesce(F.abs(F.col("position") - target) < GRIPPER_TOLERANCE_RAD, F.lit(True))
    return out.withColumn("reached", reached)


def motion_lock(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, linear: str = "linear", angular: str = "angular") -> DataFrame:
    """Number of still samples since the last motion."""
    moving = (F.col(linear) > LOCK_LINEAR) | (F.col(angular) > LOCK_ANGULAR)
    base = df.withColumn("_m", F.coalesce(moving, F.lit(False)))
    n = running(base, keys, bucket, _cols(order), {"_n": ("count", F.lit(1))})
    last = running(n, keys, bucket, _cols(order), {"_at": ("max", F.when(F.col("_m"), F.col("_n")))})
    return last.withColumn("still", F.col("_n") - F.coalesce("_at", F.lit(0))).drop("_m", "_n", "_at")


def attempts(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, limit: int = 3, success: Column | None = None) -> DataFrame:
    """Running attempt number per object; ``given_up`` on a failure that uses up the limit."""
    out = running(df, keys, bucket, _cols(order), {"attempt": ("count", F.lit(1))})
    failed = F.lit(True) if success is None else ~success
    return out.withColumn("given_up", failed & (F.col("attempt") >= max(1, limit)))


def latest_state(samples: DataFrame, required: Sequence[str], fallback: Sequence[float], robots: DataFrame | None = None) -> DataFrame:
    """Newest position per required joint; robots missing any of them use the fallback."""
    newest = (
        samples.filter(F.col("joint").isin(list(required)))
        .groupBy("robot_id", "joint")
        .agg(F.max_by("position", F.struct("ts", "position")).alias("position"))
    )
    seen = newest.groupBy("robot_id").agg(F.map_from_entries(F.collect_list(F.struct("joint", "position"))).alias("_m"))
    base = (robots if robots is not None else samples).select("robot_id").distinct().join(seen, "robot_id", "left")
    picked = F.array(*[F.try_element_at("_m", F.lit(j)) for j in required])
    whole = F.coalesce(F.size("_m") == len(required), F.lit(False))
    return base.select(
        "robot_id",
        F.when(whole, picked).otherwise(F.array(*[F.lit(float(v)) for v in fallback])).alias("positions"),
        (~whole).alias("used_fallback"),
    )


def latest_status(status: DataFrame) -> DataFrame:
    rest = [c for c in status.columns if c != "robot_id"]
    return status.groupBy("robot_id").agg(F.max_by(F.struct(*rest), "ts").alias("_s")).select("robot_id", "_s.*")


# --- choosing and shaping targets --------------------------------------------------


def flatten_published(messages: DataFrame) -> DataFrame:
    """Identity, centre, size and first class of each published detection."""
    cls = F.coalesce(F.get("results", F.lit(0))["class_id"], F.lit("unknown"))
    keep = [c for c in ("session_id", "frame_index", "ts") if c in messages.columns]
    return messages.select(*keep, F.col("id").cast("string").alias("id"), F.col("position").alias("center"), "size", cls.alias("class_name"))


def nearest(dets: DataFrame, by: Sequence[str], reference: vec.Vec, done: DataFrame | None = None, id_col: str = "id", center: str = "center") -> DataFrame:
    """Closest detection per group whose id is not done yet; of distances equal to twelve digits the smaller id."""
    by = list(by)
    open_ = dets if done is None else dets.join(done.select(*by, id_col).distinct(), by + [id_col], "left_anti")
    rest = [c for c in open_.columns if c not in by]
    dist = vec.distance(vec.parts(center), reference)
    best = F.min_by(F.struct(*rest, dist.alias("dist")), F.struct(F.round(dist, 12), F.col(id_col)))
    return open_.groupBy(*by).agg(best.alias("_d")).select(*by, "_d.*")


def least_motion(cands: DataFrame, by: Sequence[str], wrap_joints: Sequence[int] = (), limit: float = MAX_WRAP_DELTA, order: str = "option_no") -> DataFrame:
    """Candidate ``target`` with the smallest total move from ``seed``; wrap flips are out.

    Wrap joints of both are first brought into one turn, the target next to the seed.
    """
    flags = F.array(*[F.lit(i in set(wrap_joints)) for i in range(max(list(wrap_joints) + [0]) + 1)])
    is_wrap = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    seed = F.transform("seed", lambda v, i: F.when(is_wrap(i), arm.wrap_near(v, 0.0)).otherwise(v))
    pairs = F.transform(
        F.arrays_zip(F.col("_seed").alias("s"), F.col("target").alias("t")),
        lambda p, i: F.struct(
            p["s"].alias("s"),
            F.when(is_wrap(i), arm.wrap_near(p["t"], p["s"])).otherwise(p["t"]).alias("t"),
            is_wrap(i).alias("w"),
        ),
    )
    shaped = cands.withColumn("_seed", seed).withColumn("_p", pairs)
    flip = F.exists("_p", lambda p: p["w"] & (F.abs(p["t"] - p["s"]) > limit))
    cost = F.aggregate(F.transform("_p", lambda p: F.abs(p["t"] - p["s"])), F.lit(0.0), lambda a, v: a + v)
    ok = shaped.filter(~flip).withColumn("cost", cost).withColumn("target", F.transform("_p", lambda p: p["t"]))
    best = F.min_by(F.struct(order, "target", "cost"), F.struct("cost", order))
    return ok.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def collision_primitive(cls: Column, size: vec.Vec) -> Column:
    """STRUCT<kind, dimensions> by class: upright cylinder, sphere of mean size, else a box."""
    sx, sy, sz = size
    name = F.lower(cls)
    shape = lambda kind, *dims: F.struct(F.lit(kind).alias("kind"), F.array(*dims).alias("dimensions"))
    return (
        F.when(name == "cork", shape("cylinder", sz, F.greatest(sx, sy) / 2.0))
        .when(name == "pompom", shape("sphere", (sx + sy + sz) / 6.0))
        .otherwise(shape("box", sx, sy, sz))
    )


# How far, how high and in which orientation each approach phase looks.
APPROACH_PHASES = (
    ("prehover", (-0.10, 0.0), 0.20, (0.862, 0.036, -0.503, 0.045)),
    ("hover", (0.0, 0.0), 0.10, (0.934, 0.006, -0.358, -0.003)),
)


def approach_targets(dets: DataFrame, center: str = "center", ref_deg: float = 0.0, align: bool = True, phases=APPROACH_PHASES) -> DataFrame:
    """One pose per detection and phase: offset turned by the azimuth, raised, orientation turned."""
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("phase"), F.lit(float(off[0])).alias("dx"), F.lit(float(off[1])).alias("dy"), F.lit(float(h)).alias("h"),
                F.array(*[F.lit(float(q)) for q in quat]).alias("q"),
            )
            for name, off, h, quat in phases
        ]
    )
    each = dets.withColumn("_ph", F.explode(table))
    x, y, z = vec.parts(center)
    theta = arm.azimuth(x, y, ref_deg, align)
    dx, dy = arm.rotate_xy(F.col("_ph.dx"), F.col("_ph.dy"), theta)
    q = arm.yaw_quat(tuple(F.col("_ph.q")[i] for i in range(4)), theta)
    quat = F.struct(*[c.alias(n) for c, n in zip(q, "xyzw")])
    return each.withColumns(
        {"phase": F.col("_ph.phase"), "azimuth": theta, "position": vec.pack((x + dx, y + dy, z + F.col("_ph.h"))), "orientation": quat}
    ).drop("_ph")


# --- trajectories and commands ------------------------------------------------------


def resample(goals: DataFrame, start: str, goal: str, duration: str, steps: int = 30) -> DataFrame:
    return goals.withColumn("points", arm.resample(F.col(start), F.col(goal), F.col(duration), steps))


def sample_trajectory(goals: DataFrame, times: DataFrame, key: str = "goal_id") -> DataFrame:
    """Positions of each trajectory at the requested times."""
    return times.join(goals.select(key, "points"), key).withColumn("desired", arm.interp_at(F.col("points"), F.col("t"))).drop("points")


def tracking_error(desired: DataFrame, actual: DataFrame, keys: Sequence[str] = ("goal_id", "t")) -> DataFrame:
    """Desired minus actual, positions and velocities (desired velocity zero where absent)."""
    return errors_of(desired.join(actual, list(keys)))


def errors_of(both: DataFrame) -> DataFrame:
    """Errors of rows that hold ``desired``, ``position`` and ``velocity``."""
    gap = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    want = F.coalesce(F.col("desired_velocity"), F.transform("velocity", lambda v: v * 0.0)) if "desired_velocity" in both.columns else F.transform("velocity", lambda v: v * 0.0)
    return both.withColumns({"error": gap(F.col("desired"), F.col("position")), "velocity_error": gap(want, F.col("velocity"))})


def validate_goals(goals: DataFrame, joint_names: Sequence[str]) -> DataFrame:
    """``problem`` is null for an acceptable goal."""
    names = F.array(*[F.lit(n) for n in joint_names])
    problem = (
        F.when((F.coalesce(F.size("joint_names"), F.lit(0)) <= 0) | (F.coalesce(F.size("points"), F.lit(0)) <= 0), "empty")
        .when(F.col("joint_names") != names, "joint names differ")
        .when(~F.forall("points", lambda p: F.size(p["positions"]) == len(joint_names)), "positions length differs")
    )
    return goals.withColumn("problem", problem)


def arbitrate(
    commands: DataFrame, states: DataFrame, keys: Sequence[str] = ("robot_id",), policy: str = "reject", bucket_s: int = 3600, state: str = "state_machine"
) -> DataFrame:
    """Decision per command from the arm state last reported at or before it.

    ``target`` "gripper" is never preempting; a disabled arm takes nothing.
    """
    from rigtable.operators.tracking import asof_pose

    return decide(asof_pose(commands, states, keys, [state, "enabled"], bucket_s=bucket_s).drop("tf_ok", "pose_ts"), policy, state)


def decide(known: DataFrame, policy: str = "reject", state: str = "state_machine") -> DataFrame:
    """Decision of commands beside the arm state in force."""
    running_ = F.col(state) == "TRAJ_RUNNING"
    gripper = F.col("target") == "gripper"
    stop = (F.lit(policy) == "reject") | ~F.coalesce("allow_preempt", F.lit(False)) | gripper
    verdict = (
        F.when(~F.coalesce("enabled", F.lit(True)), "reject: disabled")
        .when(F.col(state) == "GRAVITY_COMP", "reject: gravity compensation")
        .when(running_ & stop, "reject: trajectory running")
        .when(running_, "preempt")
        .otherwise("accept")
    )
    return known.withColumn("decision", verdict)


def idle_gaps(events: DataFrame, keys: Sequence[str], ts: str = "ts", gap_s: float = 3.0, bucket_s: int = 86_400) -> DataFrame:
    """Stretches of activity closed by ``gap_s`` without an eligible event."""
    bucket = F.floor(F.unix_micros(ts) / F.lit(bucket_s * 1_000_000))
    prev = running(events, keys, bucket, [F.col(ts)], {"_prev": ("last", F.col(ts))}, exclusive=True)
    fresh = F.when(F.col("_prev").isNull() | (F.unix_micros(ts) - F.unix_micros("_prev") >= gap_s * 1e6), 1).otherwise(0)
    runs = running(prev.withColumn("_n", fresh), keys, bucket, [F.col(ts)], {"run_no": ("sum", F.col("_n"))})
    return runs.groupBy(*keys, "run_no").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


