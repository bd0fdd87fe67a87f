"""Detection, pose and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigtable import schemas
from rigtable.catalog.bind import DETS, day, detections, detections_of, r, rs, sql, table
from rigtable.functions import vec
from rigtable.functions.angles import circ_mean_deg, circ_std_deg
from rigtable.operators import calib
from rigtable.operators import tracking as tk
from rigtable.plans import perception
from rigtable.sources.readers import explode_detections
from rigtable.streaming import stateful as st
from rigtable.streaming import windows as wn
from rigtable.streaming.run import closed, drain, stream_table

QUERIES: dict = {}
SQL: dict = {}
ORDER = ["frame_index", "det_idx"]
CFG = tk.TrackerConfig()
DAY_S = 86_400.0


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def recursive(body: str) -> str:
    return sql(DETS, body).replace("WITH ", "WITH RECURSIVE ", 1).replace("FROM evk)\nr AS", "FROM evk),\nr AS")


def stream_events(spark, d):
    return stream_table(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def stream_detections(spark, d):
    return detections_of(stream_events(spark, d))


# --- circular statistics and windows ---------------------------------------------------


@query("A15_circular_stats", sql(DETS, f"""SELECT session_id, class_name, {rs('degrees(atan2(s, c)) / 2', 4)} AS mean_deg, {rs('CASE WHEN n < 2 THEN 0 WHEN least(1, sqrt(s * s + c * c)) <= 1e-9 THEN 90 ELSE degrees(sqrt(-2 * ln(least(1, sqrt(s * s + c * c))))) / 2 END', 4)} AS std_deg FROM (SELECT session_id, class_name, count(*) AS n, avg(sin(radians(2 * yaw_deg))) AS s, avg(cos(radians(2 * yaw_deg))) AS c
  FROM dets GROUP BY 1, 2)"""))
def _(spark, d):
    yaw = F.col("yaw_deg")
    return detections(spark, d).groupBy("session_id", "class_name").agg(r(circ_mean_deg(yaw), 4).alias("mean_deg"), r(circ_std_deg(yaw), 4).alias("std_deg"))


@query("X3_circular_per_class", sql(DETS, f"SELECT class_name, {rs('degrees(atan2(avg(sin(radians(2 * yaw_deg))), avg(cos(radians(2 * yaw_deg))))) / 2', 4)} AS mean_deg FROM dets GROUP BY 1"))
def _(spark, d):
    return detections(spark, d).groupBy("class_name").agg(r(circ_mean_deg(F.col("yaw_deg")), 4).alias("mean_deg"))


W10 = "WINDOW w AS (PARTITION BY session_id, class_name ORDER BY frame_index, det_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
WINDOWED = f"""win AS (SELECT *, count(*) OVER w AS hits, median(cx) OVER w AS fx, median(cy) OVER w AS fy, median(cz) OVER w AS fz, median(ex) OVER w AS fex,
  avg(sin(radians(2 * yaw_deg))) OVER w AS s, avg(cos(radians(2 * yaw_deg))) OVER w AS c, sqrt(pow(stddev_pop(cx) OVER w, 2) + pow(stddev_pop(cy) OVER w, 2) + pow(stddev_pop(cz) OVER w, 2)) AS pos_std,
  avg(confidence) OVER w AS conf, avg(CAST(yaw_reliable AS DOUBLE)) OVER w >= 5e-1 AS rel FROM dets {W10}),
stat AS (SELECT *, CASE WHEN hits < 2 THEN 0 WHEN least(1, sqrt(s * s + c * c)) <= 1e-9 THEN 90 ELSE abs(degrees(sqrt(-2 * ln(least(1, sqrt(s * s + c * c))))) / 2) END AS yaw_std FROM win)"""


@query("W1_track_window", sql([DETS, WINDOWED], f"""SELECT session_id, det_idx, hits, {rs('fx', 8)} AS fx, {rs('fy', 8)} AS fy, {rs('fz', 8)} AS fz, {rs('fex', 8)} AS fex,
  {rs('CASE WHEN rel THEN degrees(atan2(s, c)) / 2 ELSE 0 END', 3)} AS yaw, {rs('yaw_std', 3)} AS yaw_std, {rs('pos_std', 5)} AS pos_std, {rs('conf', 5)} AS conf, rel FROM stat"""))
def _(spark, d):
    w = tk.track_window(detections(spark, d), ["session_id", "class_name"], ORDER, F.floor(F.col("frame_index") / 10))
    return w.select(
        "session_id", "det_idx", "hits", *[r(F.col("center_filtered")[a], 8).alias(f"f{a}") for a in "xyz"], r(F.col("extent_filtered.x"), 8).alias("fex"),
        r("yaw_filtered_deg", 3).alias("yaw"), r("yaw_std_deg", 3).alias("yaw_std"), r("position_std_m", 5).alias("pos_std"), r("confidence_mean", 5).alias("conf"),
        F.col("window_reliable").alias("rel"),
    )


@query("W2_smooth_normals")
def _(spark, d):
    n = normals(spark, d)
    out = tk.smooth_normals(n, ["session_id"], ["frame_index", "det_idx"], 0.3)
    return out.select("session_id", "det_idx", *[r(c, 4).alias(c) for c in ("sx", "sy", "sz")])


def normals(spark, d):
    raw = (F.col("center.x") - 0.05, F.lit(-0.2) - F.col("value") / 1000.0, F.col("center.z") - 0.284)
    size = vec.length(raw)
    return detections(spark, d).select("session_id", "frame_index", "det_idx", *[(c / size).alias(n) for c, n in zip(raw, ("nx", "ny", "nz"))])


@query("W3_stability", sql([DETS, WINDOWED, """flags AS (SELECT *, row_number() OVER o AS rn, hits >= 6 AND pos_std <= 2e-2 AND (NOT rel OR yaw_std <= 10) AND conf >= 8e-1 AND in_workspace AS en,
  hits >= 6 AND pos_std <= 3e-2 AND (NOT rel OR yaw_std <= 15) AND conf >= 75e-2 AND in_workspace AS st FROM stat WINDOW o AS (PARTITION BY session_id, class_name ORDER BY frame_index, det_idx))""",
  """walk AS (SELECT *, max(CASE WHEN NOT en THEN rn END) OVER o AS brk, max(CASE WHEN NOT st THEN rn END) OVER o AS off_at FROM flags
  WINDOW o AS (PARTITION BY session_id, class_name ORDER BY rn ROWS UNBOUNDED PRECEDING))"""],
  """SELECT session_id, det_idx, coalesce(max(CASE WHEN en AND rn - coalesce(brk, 0) >= 3 THEN rn END) OVER (PARTITION BY session_id, class_name ORDER BY rn ROWS UNBOUNDED PRECEDING) > coalesce(off_at, 0), FALSE) AS stable FROM walk"""))
def _(spark, d):
    bucket = F.floor(F.col("frame_index") / 10)
    w = tk.track_window(detections(spark, d), ["session_id", "class_name"], ORDER, bucket)
    cfg = tk.TrackerConfig(max_position_std_m=0.02)
    return tk.stability(w, ["session_id", "class_name"], ORDER, bucket, cfg).select("session_id", "det_idx", "stable")


@query("W5_significant_moves", recursive("""r AS (SELECT session_id, class_name, min({'f': frame_index, 'i': det_idx, 'x': cx, 'y': cy, 'z': cz}) AS at FROM dets GROUP BY 1, 2
  UNION ALL SELECT d.session_id, d.class_name, min({'f': d.frame_index, 'i': d.det_idx, 'x': d.cx, 'y': d.cy, 'z': d.cz}) FROM r JOIN dets d
  ON d.session_id = r.session_id AND d.class_name = r.class_name AND (d.frame_index, d.det_idx) > (r.at.f, r.at.i)
  AND sqrt((d.cx - r.at.x) ** 2 + (d.cy - r.at.y) ** 2 + (d.cz - r.at.z) ** 2) > 2e-2 GROUP BY 1, 2)
  SELECT session_id, class_name, r.at.i AS det_idx FROM r"""))
def _(spark, d):
    det = detections(spark, d).select("session_id", "class_name", "frame_index", "det_idx", *[F.col("center")[a].alias(a) for a in "xyz"])
    return tk.significant_moves(det, ["session_id", "class_name"], ORDER, min_move=0.02).select("session_id", "class_name", "det_idx")


@query("A23_rolling_fps", sql(DETS, f"""SELECT session_id, det_idx, {rs('count(*) OVER w / sum(1e-2 + value / 1000) OVER w', 5)} AS fps FROM dets
  WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, det_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def _(spark, d):
    det = detections(spark, d).withColumn("loop_s", F.lit(0.01) + F.col("value") / 1000)
    return tk.rolling_fps(det, ["session_id"], ["ts_us", "det_idx"], "loop_s", day()).select("session_id", "det_idx", r("fps", 5).alias("fps"))


# --- tracker -----------------------------------------------------------------------------


@query("T1_track")
def _(spark, d):
    t = tk.track(detections(spark, d))
    return t.select(
        "session_id", "frame_index", "det_idx", "class_name", "track_id", "hits", r("confidence_mean", 4).alias("confidence_mean"),
        r(F.col("center_filtered.x"), 5).alias("fx"), r("yaw_filtered_deg", 3).alias("yaw"), r("position_std_m", 5).alias("pos_std"), "stable",
    )


def frame_stream(spark, d):
    """Each event is one frame with a single detection, numbered by its half second.

    A class of a session is a camera of its own, and numbers leave out one frame more than a track survives, so that no two half seconds meet.
    """
    det = stream_detections(spark, d)
    names = ["class_name", "confidence", "center", "extent", "yaw_deg", "point_count", "in_workspace", "yaw_reliable"]
    return det.select(
        F.concat_ws(":", "session_id", "class_name").alias("session_id"), (F.floor(F.col("ts_us") / F.lit(500_000)) * (CFG.max_misses + 2)).alias("frame_index"), "ts",
        F.array(F.struct(*names)).alias("detections"),
    )


@query("T1_track_stream", sql(DETS, """SELECT CAST(session_id AS VARCHAR) AS session_id, class_name, count(*) AS n, count(*) AS n_tracks FROM
  (SELECT DISTINCT session_id, class_name, ts_us // 500000 AS f FROM dets) GROUP BY 1, 2"""))
def _(spark, d):
    # Every half second opens its own track, however dense the events are.
    out = drain(st.track_stream(frame_stream(spark, d))).withColumn("session_id", F.substring_index("session_id", ":", 1))
    return out.groupBy("session_id", "class_name").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("n_tracks"))


@query("T1_track_stream_frames")
def _(spark, d):
    """The frames of T1_track as a stream, two detections or more in most; the same rows as the batch plan."""
    from rigtable.session import scratch_path

    path = scratch_path(spark, "frames")
    frame_rows(detections(spark, d)).write.parquet(path)
    t = drain(st.track_stream(spark.readStream.schema(schemas.FRAMES).parquet(path)))
    return t.select(
        "session_id", "frame_index", "class_name", "track_id", "hits", r("confidence_mean", 4).alias("confidence_mean"),
        r(F.col("center_filtered.x"), 5).alias("fx"), r("yaw_filtered_deg", 3).alias("yaw"), r("position_std_m", 5).alias("pos_std"), "stable",
    )


EE_CAM = [[1, 0, 0, 0.0], [0, 1, 0, 0.05], [0, 0, 1, 0.1], [0, 0, 0, 1]]
POSE_SQL = """poses AS (SELECT session_id, ts_us, value / 1000 AS tx, k / 100e0 AS ty FROM evk WHERE event_type = 'signup'),
asks AS (SELECT session_id, det_idx, ts_us FROM evk WHERE event_type <> 'signup')"""


def pose_table(det):
    return det.filter("event_type = 'signup'").select(
        "session_id", "ts", (F.col("value") / 1000).alias("tx"), (F.col("k") / 100.0).alias("ty"), F.lit(0.3).alias("tz"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"),
    )


BOUNDS = {"x": (0.0, 1.0), "y": (-1.0, 1.0), "z": (0.0, 2.0)}
PUBLISH_CFG = tk.TrackerConfig(min_hits=3, max_position_std_m=0.05, min_confidence=0.7, max_yaw_std_deg=60.0)


@query("T2_perception_publish")
def _(spark, d):
    det = detections(spark, d)
    msgs = perception.publish(det.drop("ts_us"), pose_table(det), vec.rigid_lit(EE_CAM), BOUNDS, PUBLISH_CFG)
    return message_rows(msgs)


def message_rows(msgs):
    return msgs.select("session_id", "frame_index", "id", r(F.col("position.x"), 4).alias("bx"), r(F.col("position.z"), 4).alias("bz"), F.col("results")[0]["class_id"].alias("class_id"))


def frame_rows(det):
    """Frames with all their detections, at the time of the last one."""
    names = ["class_name", "confidence", "center", "extent", "yaw_deg", "point_count", "in_workspace", "yaw_reliable"]
    held = det.groupBy(F.col("session_id").cast("string").alias("session_id"), "frame_index").agg(
        F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("det_idx", F.struct(*names).alias("d")))).alias("all")
    )
    return held.select("session_id", "frame_index", "ts", F.transform("all", lambda x: x["d"]).alias("detections"))


@query("T2_perception_stream")
def _(spark, d):
    from rigtable.session import scratch_path

    det = detections(spark, d)
    path = scratch_path(spark, "frames")
    frame_rows(det).write.parquet(path)
    poses = pose_table(det).withColumn("session_id", F.col("session_id").cast("string"))
    frames = spark.readStream.schema(schemas.FRAMES).parquet(path)
    return message_rows(drain(perception.perception_stream(frames, poses, vec.rigid_lit(EE_CAM), BOUNDS, PUBLISH_CFG)))


@query("J12_asof_pose", sql([DETS, POSE_SQL], f"""SELECT a.session_id, a.det_idx, p.ts_us IS NOT NULL AS tf_ok, {rs('p.tx')} AS tx, {rs('p.ty')} AS ty
  FROM asks a ASOF LEFT JOIN poses p ON a.session_id = p.session_id AND a.ts_us >= p.ts_us"""))
def _(spark, d):
    det = detections(spark, d)
    asks = det.filter("event_type <> 'signup'").select("session_id", "det_idx", "ts")
    out = tk.asof_pose(asks, pose_table(det), ["session_id"], ["tx", "ty"], bucket_s=86_400)
    return out.select("session_id", "det_idx", "tf_ok", r("tx").alias("tx"), r("ty").alias("ty"))


@query("J12_asof_pose_tolerance", sql([DETS, POSE_SQL], f"""SELECT a.session_id, a.det_idx, coalesce(a.ts_us - p.ts_us <= 43200000000, FALSE) AS tf_ok, {rs('CASE WHEN a.ts_us - p.ts_us <= 43200000000 THEN p.tx END')} AS tx
  FROM asks a ASOF LEFT JOIN poses p ON a.session_id = p.session_id AND a.ts_us >= p.ts_us"""))
def _(spark, d):
    det = detections(spark, d)
    asks = det.filter("event_type <> 'signup'").select("session_id", "det_idx", "ts")
    out = tk.asof_pose(asks, pose_table(det), ["session_id"], ["tx", "ty"], tolerance_s=43_200, bucket_s=86_400)
    return out.select("session_id", "det_idx", "tf_ok", r("tx").alias("tx"))


@query("T6_asof_pose_stream", sql([DETS, POSE_SQL], f"""SELECT CAST(a.session_id AS VARCHAR) AS session_id, a.det_idx, p.ts_us IS NOT NULL AS tf_ok, {rs('p.tx')} AS tx
  FROM asks a ASOF LEFT JOIN poses p ON a.session_id = p.session_id AND a.ts_us >= p.ts_us"""))
def _(spark, d):
    det = stream_detections(spark, d)
    is_pose = F.col("event_type") == "signup"
    both = det.select(
        F.col("session_id").cast("string").alias("session_id"), "ts", "det_idx", is_pose.alias("is_pose"), F.when(is_pose, F.col("value") / 1000).alias("tx")
    )
    out = drain(st.asof_pose_stream(closed(both), ["session_id"], ["tx"], ["det_idx"], delay="1 day", slot_s=DAY_S))
    return out.select("session_id", "det_idx", "tf_ok", r("tx").alias("tx"))


@query("J14_retag_workspace", sql(DETS, """SELECT session_id, det_idx, CASE WHEN k % 10 = 0 THEN cx WHEN k % 2 = 0 THEN cx + 1e-2 ELSE cx END BETWEEN 4e-2 AND 105e-3 AND cy BETWEEN 0 AND 1e-2 OR k % 10 = 0 AND k % 4 = 0 AS in_workspace FROM dets"""))
def _(spark, d):
    det = detections(spark, d)
    k = F.col("k")
    raw = F.when(~((k % 10 == 0) & (k % 4 == 0)), F.col("center"))
    moved = F.when((k % 10 != 0) & (k % 2 == 0), vec.pack((F.col("center.x") + 0.01, F.col("center.y"), F.col("center.z"))))
    rows = det.withColumns({"center_filtered": moved, "center": raw})
    return tk.retag_workspace(rows, {"x": (0.04, 0.105), "y": (0.0, 0.01), "z": (0.0, 1.0)}).select("session_id", "det_idx", "in_workspace")


@query("P16_to_published", sql(DETS, f"SELECT session_id, frame_index, CAST(k AS VARCHAR) AS id, class_name, {rs('confidence', 5)} AS score, {rs('cx + 1', 5)} AS bx, {rs('CASE WHEN k % 2 = 0 THEN ex ELSE 0 END', 5)} AS sx FROM dets WHERE k % 3 = 0 AND in_workspace"))
def _(spark, d):
    return published(spark, d).select(
        "session_id", "frame_index", "id", F.col("results")[0]["class_id"].alias("class_name"), r(F.col("results")[0]["score"], 5).alias("score"),
        r(F.col("position.x"), 5).alias("bx"), r(F.col("size.x"), 5).alias("sx"),
    )


def published(spark, d):
    k = F.col("k")
    rows = detections(spark, d).withColumns(
        {
            "stable": k % 3 == 0, "bx": F.col("center.x") + 1.0, "by": F.col("center.y"), "bz": F.col("center.z"), "track_id": k,
            "confidence_mean": F.col("confidence"), "extent_filtered": F.when(k % 2 == 0, F.col("extent")),
        }
    )
    return tk.to_published(rows)


@query("O4_pick_target", sql(DETS, """SELECT session_id, det_idx, class_name FROM dets WHERE k % 3 = 0 AND in_workspace AND class_name = 'cork'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, det_idx) = 1"""))
def _(spark, d):
    rows = detections(spark, d).withColumns({"stable": F.col("k") % 3 == 0, "confidence_mean": F.col("confidence")})
    rows = rows.select("session_id", "det_idx", "class_name", "stable", "in_workspace", "confidence_mean")
    return calib.pick_target(rows, ["session_id"], "cork", tie=["det_idx"]).select("session_id", "det_idx", "class_name")


@query("F16_detection_json", sql(DETS, "SELECT session_id, count(*) AS n, CAST(sum(k * 7) AS BIGINT) AS points FROM dets WHERE in_workspace GROUP BY 1"))
def _(spark, d):
    recs = tk.frame_records(detections(spark, d))
    text = recs.withColumn("json", F.to_json("detection"))
    back = F.get_json_object("json", "$.point_count").cast("bigint")
    return text.groupBy("session_id").agg(F.count("json").alias("n"), F.sum(back).alias("points"))


# --- stream windows ------------------------------------------------------------------------


@query("S11_frames_roundtrip", sql(DETS, "SELECT class_name, count(*) AS n, CAST(sum(point_count) AS BIGINT) AS points FROM dets GROUP BY 1"))
def _(spark, d):
    from rigtable.session import scratch_path
    from rigtable.sources.readers import stream_frames

    names = ["class_name", "confidence", "center", "extent", "yaw_deg", "point_count", "in_workspace", "yaw_reliable"]
    path = scratch_path(spark, "frames")
    det = detections(spark, d)
    # A frame holds the detections of one exposure: at most the detector's cap.
    det.select(
        F.col("session_id").cast("string").alias("session_id"), F.floor(F.col("ts_us") / 1000).alias("frame_index"), "ts", F.array(F.struct(*names)).alias("detections")
    ).write.json(path)
    out = drain(explode_detections(stream_frames(spark, path)))
    return out.groupBy("class_name").agg(F.count("*").alias("n"), F.sum("point_count").alias("points"))


@query("T3_fresh_at", sql(DETS, f"""SELECT t.session_id, t.det_idx, {rs('(t.ts_us - m.ts_us) / 1e6', 3)} AS age_s, coalesce(m.n > 0 AND (t.ts_us - m.ts_us) / 1e6 <= 36000, FALSE) AS in_view
  FROM (SELECT * FROM dets WHERE event_type = 'error') t ASOF LEFT JOIN (SELECT session_id, ts_us, k % 4 AS n FROM dets WHERE event_type <> 'error') m ON t.session_id = m.session_id AND t.ts_us >= m.ts_us"""))
def _(spark, d):
    det = detections(spark, d)
    ticks = det.filter("event_type = 'error'").select("session_id", "det_idx", "ts")
    msgs = det.filter("event_type <> 'error'").select("session_id", "ts", (F.col("k") % 4).alias("n_detections"))
    out = wn.fresh_at(ticks, msgs, ["session_id"], 36_000.0, bucket_s=86_400)
    return out.select("session_id", "det_idx", r("age_s", 3).alias("age_s"), "in_view")


@query("T3_fresh_stream", sql(DETS, """SELECT CAST(session_id AS VARCHAR) AS topic, count(*) FILTER (NOT was) AS n_on FROM (SELECT *, coalesce(lag(ts_us) OVER w + 36000000000 >= ts_us, FALSE) AS was
  FROM dets WINDOW w AS (PARTITION BY session_id ORDER BY ts_us)) GROUP BY 1"""))
def _(spark, d):
    msgs = stream_detections(spark, d).select(F.col("session_id").cast("string").alias("topic"), "ts", F.lit(1).alias("n_detections")).withWatermark("ts", "1 day")
    out = drain(st.fresh_stream(msgs, 36_000.0))
    return out.groupBy("topic").agg(F.count_if("in_view").alias("n_on"))


@query("T3_fresh_changes", sql(DETS, """SELECT topic, at_us, in_view FROM (SELECT CAST(session_id AS VARCHAR) AS topic, ts_us, n > 0 AS now, coalesce(lag(n > 0) OVER w AND ts_us - lag(ts_us) OVER w <= 36000000000, FALSE) AS before,
  coalesce(lead(ts_us) OVER w - ts_us > 36000000000, TRUE) AS lapses FROM (SELECT *, k % 4 AS n FROM dets) WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, det_idx)),
  LATERAL (SELECT ts_us AS at_us, now AS in_view WHERE now <> before UNION ALL SELECT ts_us + 36000000000, FALSE WHERE now AND lapses)"""))
def _(spark, d):
    msgs = stream_detections(spark, d).select(F.col("session_id").cast("string").alias("topic"), "ts", "det_idx", (F.col("k") % 4).alias("n_detections"))
    out = drain(st.fresh_stream(closed(msgs), 36_000.0, delay="1 day", slot_s=DAY_S, tie=["det_idx"]))
    return out.select("topic", F.unix_micros("ts").alias("at_us"), "in_view")


@query("T4_idle_sessions", sql(DETS, """SELECT session_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts_us - prev >= 21600000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY session_id ORDER BY ts_us) AS run FROM (SELECT *, lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us) AS prev FROM dets WHERE in_workspace)) GROUP BY session_id, run"""))
def _(spark, d):
    from rigtable.operators.robot import idle_gaps

    gaps = idle_gaps(detections(spark, d).filter("in_workspace"), ["session_id"], gap_s=21_600.0)
    return gaps.select("session_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


CLOSED = "21600000000"


@query("T4_idle_sessions_stream", sql(DETS, f"""SELECT session_id, first_us, n FROM (SELECT session_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts_us - prev >= {CLOSED} THEN 1 ELSE 0 END)
  OVER (PARTITION BY session_id ORDER BY ts_us) AS run FROM (SELECT *, lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us) AS prev FROM dets WHERE in_workspace)) GROUP BY session_id, run)
  """))
def _(spark, d):
    det = stream_detections(spark, d).filter("in_workspace").select("session_id", "ts")
    out = drain(wn.idle_sessions(closed(det), ["session_id"], "6 hours"))
    return out.select("session_id", F.unix_micros("first_ts").alias("first_us"), "n")


@query("T5_publish_stats", sql(DETS, """SELECT class_name, s AS start_us, n, n_stable, n_published FROM (SELECT class_name, ts_us // 3600000000 * 3600000000 AS s, count(*) AS n, count(*) FILTER (k % 3 = 0) AS n_stable,
  count(*) FILTER (k % 3 = 0 AND k % 2 = 0) AS n_published FROM dets GROUP BY 1, 2)"""))
def _(spark, d):
    det = stream_detections(spark, d).withColumns({"stable": F.col("k") % 3 == 0, "tf_ok": F.col("k") % 2 == 0}).select("class_name", "ts", "stable", "tf_ok")
    out = drain(wn.publish_stats(closed(det), ["class_name"], "1 hour"))
    return out.select("class_name", F.unix_micros("start").alias("start_us"), "n", "n_stable", "n_published")


@query("T12_drop_repeated_frames", sql(DETS, "SELECT session_id, class_name, frame_index, 1 AS n FROM dets GROUP BY 1, 2, 3"))
def _(spark, d):
    det = stream_detections(spark, d).select("session_id", "class_name", "frame_index", "ts")
    out = drain(wn.drop_repeated_frames(det, ["session_id", "class_name", "frame_index"], "60 days"))
    return out.groupBy("session_id", "class_name", "frame_index").agg(F.count("*").cast("int").alias("n"))


def _throttle_sql(session: str) -> str:
    return recursive(f"""r AS (SELECT session_id, min({{'t': ts_us, 'i': det_idx}}) AS at FROM dets GROUP BY 1
  UNION ALL SELECT d.session_id, min({{'t': d.ts_us, 'i': d.det_idx}}) FROM r JOIN dets d ON d.session_id = r.session_id AND d.ts_us - r.at.t >= 43200000000 GROUP BY 1)
  SELECT {session} AS session_id, r.at.i AS det_idx FROM r""")


@query("T14_throttle", _throttle_sql("session_id"))
def _(spark, d):
    det = detections(spark, d).select("session_id", "ts", "det_idx")
    return tk.throttle(det, ["session_id"], ["ts", "det_idx"], gap_s=43_200.0).select("session_id", "det_idx")


@query("T14_throttle_stream", _throttle_sql("CAST(session_id AS VARCHAR)"))
def _(spark, d):
    det = stream_detections(spark, d).select(F.col("session_id").cast("string").alias("session_id"), "ts", "det_idx")
    return drain(st.throttle_stream(closed(det), ["session_id"], 43_200.0, tie=["det_idx"], delay="1 day", slot_s=DAY_S)).select("session_id", "det_idx")
