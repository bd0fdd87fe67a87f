"""Scalar, telemetry, calibration and arbitration queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rigtable.catalog.bind import DETS, day, detections, r, rs, sql, table
from rigtable.functions import arm, vec
from rigtable.functions import text as tx
from rigtable.operators import calib
from rigtable.operators import robot as rb

QUERIES: dict = {}
SQL: dict = {}
BY_TIME = ["ts_us", "det_idx"]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


# --- vectors and rotations ------------------------------------------------------------


@query("F3_vector_helpers", f"""SELECT o_orderkey, {rs('x / n')} AS ux, {rs('y / n')} AS uy, {rs('x - (x + y + z) / 3', 9)} AS px, {rs('y * 3 - z * 2', 9)} AS cx FROM
  (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (SELECT o_orderkey, o_custkey % 7 + 1e0 AS x, o_custkey % 5 - 2e0 AS y, o_totalprice / 1e5 AS z FROM orders))""")
def _(spark, d):
    p = ((F.col("o_custkey") % 7) + 1.0, (F.col("o_custkey") % 5) - 2.0, F.col("o_totalprice") / 1e5)
    u = vec.normalize(p, vec.lits((1, 0, 0)))
    third = 3**-0.5
    flat = vec.onto_plane(p, vec.lits((third, third, third)))
    c = vec.cross(p, vec.lits((1, 2, 3)))
    return table(spark, d, "orders").select("o_orderkey", r(u[0]).alias("ux"), r(u[1]).alias("uy"), r(flat[0], 9).alias("px"), r(c[0], 9).alias("cx"))


@query("F4_wrap_half_turn", f"SELECT l_orderkey, l_linenumber, {rs('a - pi() * floor((a + pi() / 2) / pi())')} AS w FROM (SELECT l_orderkey, l_linenumber, l_quantity - 2 * l_linenumber * l_quantity AS a FROM lineitem)")
def _(spark, d):
    a = F.col("l_quantity") - F.col("l_linenumber") * 2 * F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(vec.wrap_half_turn(a)).alias("w"))


@query("F5_plane_basis", f"""SELECT o_orderkey, {rs('ux / un', 5)} AS ux, {rs('uy / un', 5)} AS uy, {rs('(nz * ux - nx * uz) / un', 5)} AS vy FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS un FROM
  (SELECT *, 1 - nx * nx AS ux, -nx * ny AS uy, -nx * nz AS uz FROM (SELECT o_orderkey, x / n AS nx, y / n AS ny, z / n AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM
  (SELECT o_orderkey, o_custkey % 7 - 3e0 AS x, o_custkey % 5 + 1e0 AS y, o_totalprice / 1e5 AS z FROM orders)))))""")
def _(spark, d):
    rows = table(spark, d, "orders").withColumn("n", vec.pack(((F.col("o_custkey") % 7) - 3.0, (F.col("o_custkey") % 5) + 1.0, F.col("o_totalprice") / 1e5)))
    b = vec.with_basis(rows, F.col("n"), "basis")
    return b.select("o_orderkey", r(F.col("basis.u.x"), 5).alias("ux"), r(F.col("basis.u.y"), 5).alias("uy"), r(F.col("basis.v.y"), 5).alias("vy"))


QUAT_SQL = """SELECT o_orderkey, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM
  (SELECT o_orderkey, o_custkey % 11 - 5e0 AS x, o_custkey % 7 - 3e0 AS y, o_custkey % 13 - 6e0 AS z, o_custkey % 5 + 5e-1 AS w FROM orders))"""


def quat(spark, d):
    k = F.col("o_custkey")
    raw = ((k % 11) - 5.0, (k % 7) - 3.0, (k % 13) - 6.0, (k % 5) + 0.5)
    n = F.sqrt(sum((c * c for c in raw), F.lit(0.0)))
    return table(spark, d, "orders").select("o_orderkey", *[(c / n).alias(a) for c, a in zip(raw, "xyzw")])


def q_cols():
    return tuple(F.col(a) for a in "xyzw")


@query("F7_quat_round_trip", f"SELECT o_orderkey, {rs('x', 5)} AS x, {rs('y', 5)} AS y, {rs('z', 5)} AS z, {rs('w', 5)} AS w FROM ({QUAT_SQL})")
def _(spark, d):
    rot = quat(spark, d).withColumn("m", vec.rigid_from_quat(vec.lits((0, 0, 0)), q_cols()))
    back = vec.rot_to_quat(vec.rigid_parts("m")[0])
    sign = F.when(back[3] < 0, -1.0).otherwise(1.0)
    return rot.select("o_orderkey", *[r(c * sign, 5).alias(a) for c, a in zip(back, "xyzw")])


@query("F8_compose_angle", f"SELECT o_orderkey, {rs('degrees(acos(greatest(-1, least(1, (4 * w * w - 2) / 2))))', 3)} AS deg, {rs('2 * (x * z + y * w) + 1', 5)} AS tx FROM ({QUAT_SQL})")
def _(spark, d):
    rot = quat(spark, d).withColumn("m", vec.rigid_from_quat(vec.lits((1, 0, 0)), q_cols()))
    both = rot.withColumn("c", vec.compose("m", vec.rigid_lit([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1]])))
    return both.select("o_orderkey", r(vec.rot_angle_deg(vec.rigid_parts("c")[0]), 3).alias("deg"), r(F.col("c.tx"), 5).alias("tx"))


@query("F15_quat_to_rpy", f"""SELECT o_orderkey, {rs('atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))', 4)} AS roll, {rs('asin(greatest(-1, least(1, 2 * (w * y - z * x))))', 4)} AS pitch,
  {rs('atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))', 4)} AS yaw FROM ({QUAT_SQL})""")
def _(spark, d):
    rpy = vec.quat_to_rpy(*q_cols())
    return quat(spark, d).select("o_orderkey", *[r(c, 4).alias(n) for c, n in zip(rpy, ("roll", "pitch", "yaw"))])


# --- arm maths ----------------------------------------------------------------------------


@query("F11_azimuth_rotate", sql(DETS, f"""SELECT det_idx, {rs('atan2(cy, cx) - radians(30)', 5)} AS az, {rs('cos(atan2(cy, cx) - radians(30)) * -1e-1', 5)} AS dx, {rs('sin((atan2(cy, cx) - radians(30)) / 2)', 5)} AS qz FROM dets"""))
def _(spark, d):
    az = arm.azimuth(F.col("center.x"), F.col("center.y"), 30.0)
    dx, _ = arm.rotate_xy(-0.1, 0.0, az)
    q = arm.yaw_quat(tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)), az)
    return detections(spark, d).select("det_idx", r(az, 5).alias("az"), r(dx, 5).alias("dx"), r(q[2], 5).alias("qz"))


@query("F12_descent_z", sql(DETS, f"SELECT det_idx, {rs('greatest(cz + k / 1000e0 - 8e-2, cz - 1962e-5 / 2 + 1e-2)')} AS z FROM dets"))
def _(spark, d):
    z = arm.descent_z(F.col("center.z") + F.col("k") / 1000.0, F.col("center.z"), 0.08, 0.01962, 0.010)
    return detections(spark, d).select("det_idx", r(z).alias("z"))


@query("F13_gripper", sql(DETS, f"""SELECT det_idx, {rs('greatest(0, least(45e-3, (k / 1000e0 + 2e-3) * 5e-1))')} AS half, {rs('greatest(0, least(1, 2 * greatest(0, least(45e-3, (k / 1000e0 + 2e-3) * 5e-1)) / 9e-2)) * -3')} AS motor,
  {rs('greatest(0, least(45e-3, k / 40e0 / 5 * 45e-3))')} AS joint FROM dets"""))
def _(spark, d):
    half = arm.grasp_width(F.col("k") / 1000.0, 0.002, 0.0, 0.045)
    return detections(spark, d).select(
        "det_idx", r(half).alias("half"), r(arm.width_to_motor(half, open_=-3.0)).alias("motor"), r(arm.motor_to_joint(F.col("k") / -40.0)).alias("joint")
    )


@query("F14_object_center", sql(DETS, f"SELECT det_idx, {rs('cz + 1e-2')} AS z, {rs('-cy')} AS place_y FROM dets"))
def _(spark, d):
    return detections(spark, d).select("det_idx", r(arm.lift_center(F.col("center.z"), 0.02)).alias("z"), r(-F.col("center.y")).alias("place_y"))


@query("F17_units", "SELECT p_partkey, " + rs("p_size * 1e-3") + " AS metres, " + rs("(p_partkey % 256) / 255e0") + " AS c FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", r(tx.to_metres(F.col("p_size"), 0.001)).alias("metres"), r(tx.rgb01(F.col("p_partkey") % 256)).alias("c"))


@query("F18_trajectory", sql(DETS, f"""SELECT det_idx, {rs('k + (value - k) * 15 / 30')} AS mid, {rs('CASE WHEN k / 50e0 >= 1 THEN value ELSE k + (value - k) * (k / 50e0) END', 5)} AS at_t FROM dets"""))
def _(spark, d):
    start, goal = F.array(F.col("k").cast("double")), F.array("value")
    pts = detections(spark, d).withColumn("points", arm.resample(start, goal, 1.0, 30))
    at = arm.interp_at(F.col("points"), F.col("k") / 50.0)
    return pts.select("det_idx", r(F.col("points")[15]["positions"][0]).alias("mid"), r(at[0], 5).alias("at_t"))


def states(spark, d):
    """One joint-state message per event: two arm joints and a gripper joint."""
    k, v = F.col("k").cast("double"), F.col("value")
    return detections(spark, d).select(
        F.col("session_id").cast("string").alias("robot_id"), "ts", "det_idx",
        F.array(F.lit("joint1"), F.when(F.col("k") % 2 == 0, "joint2").otherwise("joint3"), F.lit("gripper_joint1")).alias("name"),
        F.array(v / 100, k / 50, k / 1000).alias("position"), F.array(k, v, k).alias("velocity"), F.array(v, k, v).alias("effort"),
    )


JOINTS = """joints AS (SELECT CAST(session_id AS VARCHAR) AS robot_id, ts_us, det_idx, 'joint1' AS joint, value / 100 AS position, CAST(k AS DOUBLE) AS velocity FROM dets
  UNION ALL SELECT CAST(session_id AS VARCHAR), ts_us, det_idx, CASE WHEN k % 2 = 0 THEN 'joint2' ELSE 'joint3' END, k / 50e0, value FROM dets)"""


@query("F19_unnest_joints", sql([DETS, JOINTS], f"SELECT robot_id, joint, count(*) AS n, {rs('sum(position)', 4)} AS position, {rs('sum(velocity)', 3)} AS velocity FROM joints GROUP BY 1, 2"))
def _(spark, d):
    rows = rb.unnest_joints(states(spark, d))
    return rows.groupBy("robot_id", "joint").agg(F.count("*").alias("n"), r(F.sum("position"), 4).alias("position"), r(F.sum("velocity"), 3).alias("velocity"))


def _channel(shift: int) -> str:
    """A colour channel of a hue, at a saturation of 0.65."""
    k = f"(({shift}e0 + hue / 60e0) % 6e0)"
    return f"CAST(floor((1e0 - 65e-2 * greatest(0e0, least({k}, 4e0 - {k}, 1e0))) * 255e0) AS INTEGER)"


@query("F20_class_color", """SELECT p_type, CASE WHEN p_type = 'ECONOMY' THEN 255 ELSE c(5) END AS r, CASE WHEN p_type = 'ECONOMY' THEN 128 ELSE c(3) END AS g, CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE c(1) END AS b
  FROM (SELECT DISTINCT p_type, ('0x' || substr(md5(p_type), 1, 8))::BIGINT % 360 AS hue FROM part)""".replace("c(5)", _channel(5)).replace("c(3)", _channel(3)).replace("c(1)", _channel(1)))
def _(spark, d):
    types = table(spark, d, "part").select("p_type").distinct()
    fixed = spark.createDataFrame([("ECONOMY", (255, 128, 0))], "p_type STRING, rgb STRUCT<r: INT, g: INT, b: INT>")
    made = tx.hue_rgb(tx.hue_of(F.col("p_type")))
    return types.join(fixed, "p_type", "left").select("p_type", F.coalesce("rgb", made).alias("rgb")).select("p_type", "rgb.*")


@query("F21_age", sql(DETS, f"SELECT det_idx, {rs('(1706745600000000 - ts_us) / 1e6', 6)} AS age_s FROM dets"))
def _(spark, d):
    now = tx.stamp_from_ms(F.lit(1_706_745_600_000))
    return detections(spark, d).select("det_idx", r(tx.age_s(now, F.col("ts")), 6).alias("age_s"))


@query("F22_approach_targets", sql(DETS, f"""SELECT det_idx, phase, {rs('cx + cos(atan2(cy, cx)) * dx', 8)} AS px, {rs('cy + sin(atan2(cy, cx)) * dx', 8)} AS py, {rs('cz + h', 8)} AS pz,
  {rs('cos(atan2(cy, cx) / 2) * qx - sin(atan2(cy, cx) / 2) * qy', 5)} AS qx FROM dets, (VALUES ('prehover', -1e-1, 2e-1, 862e-3, 36e-3), ('hover', 0e0, 1e-1, 934e-3, 6e-3)) t(phase, dx, h, qx, qy)"""))
def _(spark, d):
    t = rb.approach_targets(detections(spark, d).select("det_idx", "center"))
    return t.select("det_idx", "phase", *[r(F.col("position")[a], 8).alias(f"p{a}") for a in "xyz"], r(F.col("orientation.x"), 5).alias("qx"))


@query("P19_collision_primitive", sql(DETS, f"""SELECT det_idx, CASE class_name WHEN 'cork' THEN 'cylinder' WHEN 'pompom' THEN 'sphere' ELSE 'box' END AS kind,
  {rs("CASE class_name WHEN 'cork' THEN ez WHEN 'pompom' THEN (ex + ey + ez) / 6 ELSE ex END")} AS first_dim FROM dets"""))
def _(spark, d):
    p = rb.collision_primitive(F.col("class_name"), vec.parts("extent"))
    return detections(spark, d).select("det_idx", p["kind"].alias("kind"), r(p["dimensions"][0]).alias("first_dim"))


@query("P21_flatten_published", sql(DETS, f"SELECT session_id, CAST(k AS VARCHAR) AS id, {rs('cx + 1', 5)} AS x, class_name FROM dets WHERE k % 3 = 0 AND in_workspace"))
def _(spark, d):
    from rigtable.catalog.tracking import published

    flat = rb.flatten_published(published(spark, d))
    return flat.select("session_id", "id", r(F.col("center.x"), 5).alias("x"), "class_name")


@query("P22_valid_joints", sql(DETS, "SELECT det_idx, k % 4 <> 0 AND k % 3 <> 0 AS ok FROM dets"))
def _(spark, d):
    k = F.col("k")
    zero = F.when(k % 3 == 0, 0.0).otherwise(0.5)
    joints = F.when(k % 4 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0), zero))
    return detections(spark, d).select("det_idx", arm.valid_joints(joints, 2).alias("ok"))


# --- telemetry windows ----------------------------------------------------------------------


@query("W6_unwrap", sql(DETS, f"""SELECT session_id, det_idx, {rs('a - 2 * pi() * sum(coalesce(floor((a - prev + pi()) / (2 * pi())), 0)) OVER (PARTITION BY session_id ORDER BY ts_us, det_idx ROWS UNBOUNDED PRECEDING)', 5)} AS unwrapped FROM
  (SELECT *, lag(a) OVER (PARTITION BY session_id ORDER BY ts_us, det_idx) AS prev FROM (SELECT *, radians(k * 36e-1 - 180) AS a FROM dets))"""))
def _(spark, d):
    det = detections(spark, d).withColumn("a", F.radians(F.col("k") * 3.6 - 180))
    return rb.unwrap(det, ["session_id"], BY_TIME, "a", day()).select("session_id", "det_idx", r("unwrapped", 5).alias("unwrapped"))


@query("W7_gripper_stall", sql(DETS, """SELECT session_id, det_idx, abs(p - coalesce(lag(p) OVER (PARTITION BY session_id ORDER BY ts_us, det_idx), p)) < 1e-4 AND value >= 50 AS stalled, abs(p - 5e-1) < 12e-2 AS reached
  FROM (SELECT *, (k % 3) / 10e0 AS p FROM dets)"""))
def _(spark, d):
    det = detections(spark, d).withColumns({"position": (F.col("k") % 3) / 10.0, "effort": F.col("value")})
    out = rb.gripper_stall(det, ["session_id"], BY_TIME, day(), 50.0, F.lit(0.5))
    return out.select("session_id", "det_idx", "stalled", "reached")


@query("W8_attempts", sql(DETS, """SELECT session_id, det_idx, row_number() OVER w AS attempt, k % 2 = 1 AND row_number() OVER w >= 3 AS given_up FROM dets WINDOW w AS (PARTITION BY session_id, class_name ORDER BY ts_us, det_idx)"""))
def _(spark, d):
    out = rb.attempts(detections(spark, d), ["session_id", "class_name"], BY_TIME, day(), 3, F.col("k") % 2 == 0)
    return out.select("session_id", "det_idx", "attempt", "given_up")


@query("T13_motion_lock", sql(DETS, """SELECT session_id, det_idx, rn - coalesce(max(CASE WHEN moving THEN rn END) OVER (PARTITION BY session_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS still FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, det_idx) AS rn, value / 1000 > 4e-2 OR k / 1000e0 > 8e-2 AS moving FROM dets)"""))
def _(spark, d):
    det = detections(spark, d).withColumns({"linear": F.col("value") / 1000, "angular": F.col("k") / 1000.0})
    return rb.motion_lock(det, ["session_id"], BY_TIME, day()).select("session_id", "det_idx", "still")


@query("T7_joint_stream", sql(DETS, f"""SELECT CAST(session_id AS VARCHAR) AS robot_id, count(*) AS n, {rs('sum(greatest(0, least(45e-3, k / 40e0 / 5 * 45e-3)))', 8)} AS position FROM dets, range(2) GROUP BY 1"""))
def _(spark, d):
    from rigtable.catalog.tracking import stream_detections
    from rigtable.streaming.run import drain

    motor = stream_detections(spark, d).select(
        F.col("session_id").cast("string").alias("robot_id"), "ts", (F.col("k") / -40.0).alias("position"), F.lit(0.1).alias("velocity"), F.lit(0.0).alias("torque")
    )
    out = drain(rb.gripper_joints(motor))
    return out.groupBy("robot_id").agg(F.count("*").alias("n"), r(F.sum("position"), 8).alias("position"))


_ERROR_SQL = sql(DETS, f"""SELECT goal_id, {rs('CASE WHEN k / 50e0 >= 1 THEN value ELSE k + (value - k) * (k / 50e0) END - value / 2', 5)} AS error, {rs('0 - k / 10e0', 5)} AS velocity_error FROM (SELECT *, det_idx AS goal_id FROM dets)""")


@query("T8_tracking_error", _ERROR_SQL)
def _(spark, d):
    det = detections(spark, d).withColumns({"goal_id": F.col("det_idx"), "t": F.col("k") / 50.0})
    goals = det.select("goal_id", arm.resample(F.array(F.col("k").cast("double")), F.array("value"), 1.0, 10).alias("points"))
    want = rb.sample_trajectory(goals, det.select("goal_id", "t"))
    actual = det.select("goal_id", "t", F.array(F.col("value") / 2).alias("position"), F.array(F.col("k") / 10.0).alias("velocity"))
    err = rb.tracking_error(want, actual)
    return err.select("goal_id", r(F.col("error")[0], 5).alias("error"), r(F.col("velocity_error")[0], 5).alias("velocity_error"))


@query("T8_tracking_error_stream", _ERROR_SQL)
def _(spark, d):
    from rigtable.catalog.tracking import stream_detections
    from rigtable.streaming.run import drain
    from rigtable.streaming.windows import tracking_error_stream

    det = lambda: stream_detections(spark, d).withColumn("goal_id", F.col("det_idx"))
    goals = det().select("goal_id", "ts", F.array(F.col("k").cast("double")).alias("from"), F.array("value").alias("to"))
    path = lambda goal: arm.resample(goal["from"], goal["to"], 1.0, 10)
    later = F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 20_000)
    states = det().select("goal_id", later.alias("ts"), F.array(F.col("value") / 2).alias("position"), F.array(F.col("k") / 10.0).alias("velocity"))
    err = drain(tracking_error_stream(goals, states, 3.0, path=path))
    return err.select("goal_id", r(F.col("error")[0], 5).alias("error"), r(F.col("velocity_error")[0], 5).alias("velocity_error"))


def _arbitrate_sql(policy: str) -> str:
    stop = "TRUE" if policy == "reject" else "(NOT pre OR gripper)"
    return sql(DETS, f"""SELECT det_idx, CASE WHEN enabled = FALSE THEN 'reject: disabled' WHEN state = 'GRAVITY_COMP' THEN 'reject: gravity compensation'
  WHEN state = 'TRAJ_RUNNING' AND {stop} THEN 'reject: trajectory running' WHEN state = 'TRAJ_RUNNING' THEN 'preempt' ELSE 'accept' END AS decision
  FROM (SELECT session_id, det_idx, ts_us, k % 2 = 0 AS pre, k % 5 = 0 AS gripper FROM dets WHERE event_type <> 'error') c
  ASOF LEFT JOIN (SELECT session_id, ts_us, CASE k % 3 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'TRAJ_RUNNING' ELSE 'GRAVITY_COMP' END AS state, k % 7 <> 0 AS enabled FROM dets WHERE event_type = 'error') s
  ON c.session_id = s.session_id AND c.ts_us >= s.ts_us""")


def _arbitrate(spark, d, policy):
    det = detections(spark, d)
    k = F.col("k")
    cmds = det.filter("event_type <> 'error'").select(
        "session_id", "det_idx", "ts", (k % 2 == 0).alias("allow_preempt"), F.when(k % 5 == 0, "gripper").otherwise("arm").alias("target")
    )
    state = F.when(k % 3 == 0, "IDLE").when(k % 3 == 1, "TRAJ_RUNNING").otherwise("GRAVITY_COMP")
    st = det.filter("event_type = 'error'").select("session_id", "ts", state.alias("state_machine"), (k % 7 != 0).alias("enabled"))
    return rb.arbitrate(cmds, st, ["session_id"], policy, 86_400).select("det_idx", "decision")


@query("T9_arbitrate", _arbitrate_sql("reject"))
def _(spark, d):
    return _arbitrate(spark, d, "reject")


@query("T9_arbitrate_preempt", _arbitrate_sql("preempt"))
def _(spark, d):
    return _arbitrate(spark, d, "preempt")


@query("T9_arbitrate_stream", _arbitrate_sql("preempt"))
def _(spark, d):
    from rigtable.catalog.tracking import DAY_S, stream_detections
    from rigtable.streaming.run import closed, drain
    from rigtable.streaming.windows import arbitrate_stream

    k = F.col("k")
    det = lambda: closed(stream_detections(spark, d).select("session_id", "det_idx", "ts", "event_type", "k"))
    cmds = det().filter("event_type <> 'error'").select(
        "session_id", "det_idx", "ts", (k % 2 == 0).alias("allow_preempt"), F.when(k % 5 == 0, "gripper").otherwise("arm").alias("target")
    )
    state = F.when(k % 3 == 0, "IDLE").when(k % 3 == 1, "TRAJ_RUNNING").otherwise("GRAVITY_COMP")
    told = det().filter("event_type = 'error' OR event_type IS NULL").select("session_id", "ts", state.alias("state_machine"), (k % 7 != 0).alias("enabled"))
    return drain(arbitrate_stream(cmds, told, ["session_id"], "preempt", delay="1 day", slot_s=DAY_S)).select("det_idx", "decision")


@query("T10_validate_goals", sql(DETS, "SELECT det_idx, CASE WHEN k % 4 = 0 THEN 'empty' WHEN k % 3 = 0 THEN 'joint names differ' WHEN k % 5 = 0 THEN 'positions length differs' END AS problem FROM dets"))
def _(spark, d):
    k = F.col("k")
    point = lambda *p: F.struct(F.array(*[F.lit(v) for v in p]).alias("positions"), F.lit(0.0).alias("t"))
    goals = detections(spark, d).select(
        "det_idx", F.when(k % 3 == 0, F.array(F.lit("j2"), F.lit("j1"))).otherwise(F.array(F.lit("j1"), F.lit("j2"))).alias("joint_names"),
        F.when(k % 4 == 0, F.filter(F.array(point(0.0)), lambda p: F.lit(False))).when(k % 5 == 0, F.array(point(0.0, 1.0), point(0.0))).otherwise(F.array(point(0.0, 1.0))).alias("points"),
    )
    return rb.validate_goals(goals, ["j1", "j2"]).select("det_idx", "problem")


@query("T11_joints_close", sql(DETS, "SELECT det_idx, abs(value / 100 - k / 50e0) <= 5e-1 AS close FROM dets"))
def _(spark, d):
    a, b = F.array(F.col("value") / 100, F.lit(0.0)), F.array(F.col("k") / 50.0, F.lit(0.1))
    return detections(spark, d).select("det_idx", arm.joints_close(a, b, 0.5).alias("close"))


# --- choices ------------------------------------------------------------------------------------


@query("O5_nearest", sql(DETS, """SELECT session_id, det_idx FROM dets d WHERE NOT EXISTS (SELECT 1 FROM dets e WHERE e.session_id = d.session_id AND e.det_idx = d.det_idx AND e.k % 4 = 0)
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(sqrt(pow(cx - 5e-2, 2) + pow(cy - 5e-3, 2) + pow(cz - 28e-2, 2)), 12), det_idx) = 1"""))
def _(spark, d):
    det = detections(spark, d).select("session_id", "det_idx", "k", vec.pack(tuple(F.round(F.col("center")[a], 9) for a in "xyz")).alias("center"))
    done = det.filter("k % 4 = 0")
    near = rb.nearest(det.drop("k"), ["session_id"], vec.lits((0.05, 0.005, 0.28)), done, "det_idx")
    return near.select("session_id", "det_idx")


@query("O6_best_of_burst", sql(DETS, "SELECT session_id, class_name, det_idx, k AS n_corners FROM dets WHERE k % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY session_id, class_name ORDER BY k DESC, det_idx) = 1"))
def _(spark, d):
    f = detections(spark, d).select("session_id", "class_name", "det_idx", F.col("k").alias("n_corners"))
    return calib.best_of_burst(f, ["session_id", "class_name"], "n_corners", F.col("n_corners") % 5 != 0, "det_idx")


@query("O8_least_motion", sql(DETS, f"""SELECT session_id, frame_index, det_idx AS option_no, {rs('cost', 5)} AS cost FROM (SELECT *, abs(a) + value / 1000 AS cost FROM (SELECT *, k / 99e0 * 6 - 3 AS a FROM dets)) WHERE abs(a) <= 2
  QUALIFY row_number() OVER (PARTITION BY session_id, frame_index ORDER BY round(cost, 9), det_idx) = 1"""))
def _(spark, d):
    a = F.col("k") / 99.0 * 6 - 3
    c = detections(spark, d).select(
        "session_id", "frame_index", F.col("det_idx").alias("option_no"), F.array(F.lit(0.0), F.lit(0.0)).alias("seed"), F.array(a, F.round(F.col("value") / 1000, 9)).alias("target")
    )
    best = rb.least_motion(c, ["session_id", "frame_index"], [0], 2.0)
    return best.select("session_id", "frame_index", "option_no", r("cost", 5).alias("cost"))


@query("O12_latest_state", sql([DETS, JOINTS], f"""SELECT robot_id, {rs("coalesce(max(CASE WHEN n = 2 AND joint = 'joint1' THEN position END), 9)", 5)} AS p1, max(n) < 2 AS used_fallback FROM (SELECT *, count(*) OVER (PARTITION BY robot_id) AS n FROM
  (SELECT robot_id, joint, arg_max(position, (ts_us, position)) AS position FROM joints WHERE joint IN ('joint1', 'joint2') GROUP BY 1, 2)) GROUP BY 1"""))
def _(spark, d):
    rows = rb.unnest_joints(states(spark, d))
    out = rb.latest_state(rows, ["joint1", "joint2"], [9.0, 9.0])
    return out.select("robot_id", r(F.col("positions")[0], 5).alias("p1"), "used_fallback")


# --- calibration -----------------------------------------------------------------------------------


def calib_rows(spark, d):
    """Samples whose target is fixed but for a small, event-driven offset."""
    det = detections(spark, d)
    flat = lambda rows: [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in rows]
    angle = F.radians(F.col("k") / 10.0)
    base = vec.pack_rigid(flat([[F.cos(angle), -F.sin(angle), 0], [F.sin(angle), F.cos(angle), 0], [0, 0, 1]]), (F.col("k") / 100.0, F.lit(0.0), F.lit(0.0)))
    cam = vec.pack_rigid(flat([[1, 0, 0], [0, 1, 0], [0, 0, 1]]), (F.lit(0.5) - F.col("k") / 100.0 + F.col("value") / 1e5, F.lit(0.1), F.lit(0.4)))
    samples = det.select("session_id", "det_idx", base.alias("base_T_ee"), cam.alias("cam_T_target"))
    c, s = 0.9998476951563913, 0.01745240643728351  # one degree about z
    turned = [[c, -s, 0, 0.0], [s, c, 0, 0.0], [0, 0, 1, 0.1]]
    exact = [[1, 0, 0, 0.0], [0, 1, 0, 0.0], [0, 0, 1, 0.1]]
    items = F.array(
        F.struct(F.lit("exact").alias("method"), vec.rigid_lit(exact).alias("ee_T_cam")), F.struct(F.lit("turned").alias("method"), vec.rigid_lit(turned).alias("ee_T_cam"))
    )
    cands = det.select("session_id").distinct().select("session_id", F.explode(items).alias("_c")).select("session_id", "_c.*")
    return samples, cands


@query("A13_calibration_spread", sql(DETS, f"""SELECT session_id, method, n_samples, {rs('trans', 6)} AS trans_mm, {rs('rot', 7)} AS rot_std_deg, {rs('trans + rot', 6)} AS score,
  method = arg_min(method, (round(trans + rot, 9), method)) OVER (PARTITION BY session_id) AS best FROM (SELECT session_id, method, count(*) AS n_samples,
    1000 * sqrt(var_pop(k / 100e0 + cos(a) * q - sin(a) * 1e-1) + var_pop(sin(a) * q + cos(a) * 1e-1)) AS trans, avg(abs(degrees(a) - mid)) AS rot
  FROM (SELECT *, degrees(atan2(avg(sin(a)) OVER w, avg(cos(a)) OVER w)) AS mid FROM (SELECT *, 5e-1 - k / 100e0 + value / 1e5 AS q, radians(k / 1e1 + turn) AS a FROM dets, (VALUES ('exact', 0e0), ('turned', 1e0)) t(method, turn))
    WINDOW w AS (PARTITION BY session_id, method)) GROUP BY 1, 2)"""))
def _(spark, d):
    samples, cands = calib_rows(spark, d)
    out = calib.calibration_spread(samples, cands)
    mm = F.col("trans_std_m") * 1000
    return out.select("session_id", "method", "n_samples", r(mm, 6).alias("trans_mm"), r("rot_std_deg", 7).alias("rot_std_deg"), r("score", 6).alias("score"), "best")


@query("J19_candidates_per_sample", sql(DETS, "SELECT session_id, count(*) * 2 AS n FROM dets GROUP BY 1"))
def _(spark, d):
    samples, cands = calib_rows(spark, d)
    return samples.join(cands, "session_id").groupBy("session_id").agg(F.count("*").alias("n"))


@query("A14_base_consistency", sql(DETS, f"""SELECT session_id, class_name, n, {rs('mx', 5)} AS mean_x, {rs('sd', 3)} AS std_norm_mm, {rs('coalesce(d, 0)', 3)} AS max_pair_mm, CASE WHEN n < 2 THEN 'too few' WHEN sd <= 7 THEN 'GOOD' ELSE 'HIGH' END AS verdict FROM
  (SELECT session_id, class_name, count(*) AS n, avg(cx) AS mx, 1000 * sqrt(var_pop(cx) + var_pop(cy) + var_pop(cz)) AS sd FROM dets GROUP BY 1, 2) JOIN
  (SELECT a.session_id, a.class_name, 1000 * max(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2))) AS d FROM dets a JOIN dets b USING (session_id, class_name) GROUP BY 1, 2) USING (session_id, class_name)"""))
def _(spark, d):
    pts = detections(spark, d).select("session_id", "class_name", *[F.col("center")[a].alias(a) for a in "xyz"])
    out = calib.base_consistency(pts, ["session_id", "class_name"])
    return out.select("session_id", "class_name", "n", r("mean_x", 5).alias("mean_x"), r("std_norm_mm", 3).alias("std_norm_mm"), r("max_pair_mm", 3).alias("max_pair_mm"), "verdict")
