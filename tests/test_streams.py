"""Streams in small steps, with rows out of order, against batch twins and plain rules; state and late rows."""

import pytest
from pyspark.sql import functions as F

from rigtable.functions import arm
from rigtable.operators import robot as rb
from rigtable.operators import tracking as tk
from rigtable.streaming import stateful as st
from rigtable.streaming import windows as wn
from rigtable.streaming.run import drain, late_rows, state_rows

START = 1_700_000_000


def steps(spark, path, schema, batches):
    """A stream of one micro-batch a list of rows; ``s`` (seconds) becomes ``ts``."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n:03d}")
    typed = spark.read.parquet(f"{path}/000").schema
    stream = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    at = F.timestamp_micros((F.lit(START * 1_000_000) + F.col("s") * 1_000_000).cast("long"))
    return stream.withColumn("ts", at).drop("s")


def rel(col="ts"):
    return ((F.unix_micros(col) - START * 1_000_000) / 1e6).alias("s")


END = [("end", 10_000.0, 1)]


@pytest.mark.parametrize("slot_s", [0.5, 60.0])
def test_freshness_changes_and_timers(spark, tmp_path, slot_s):
    batches = [
        [("a", 1.0, 2), ("a", 0.0, 1), ("b", 0.5, 0)],
        [("a", 3.5, 1), ("b", 1.0, 3), ("b", 1.4, 0)],
        [("a", 3.0, 0), ("a", 6.0, 0)],
        [("c", 40.0, 1)],
        END,
    ]
    stream = steps(spark, str(tmp_path / "in"), "topic string, s double, n_detections long", batches)
    seen = []
    out = drain(st.fresh_stream(stream, 1.0, delay="5 seconds", slot_s=slot_s), str(tmp_path / "out"), seen=seen)
    got = sorted((r.topic, r.s, r.in_view) for r in out.select("topic", rel(), "in_view").collect() if r.topic != "end")
    assert got == [("a", 0.0, True), ("a", 2.0, False), ("a", 3.5, True), ("a", 4.5, False), ("b", 1.0, True), ("b", 1.4, False), ("c", 40.0, True), ("c", 41.0, False)]
    # Only the last topic, whose time is not over, holds state and timers.
    assert state_rows(seen[0]) <= 6


def test_throttle_in_any_order(spark, tmp_path):
    times = [0.0, 0.3, 0.5, 0.9, 1.0, 3.0, 3.4, 3.5]
    batches = [[("k", 0.5, 2), ("k", 0.0, 0)], [("k", 0.9, 3), ("k", 0.3, 1), ("k", 3.0, 5)], [("k", 1.0, 4), ("k", 3.5, 7), ("k", 3.4, 6)], [("end", 10_000.0, 8)]]
    stream = steps(spark, str(tmp_path / "in"), "k string, s double, n long", batches)
    got = drain(st.throttle_stream(stream, ["k"], 0.5, delay="5 seconds", slot_s=1.0, idle_s=1.0), str(tmp_path / "out"))
    batch = spark.createDataFrame([("k", s, n) for n, s in enumerate(times)], "k string, s double, n long").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in tk.throttle(batch, ["k"], ["ts", "n"], gap_s=0.5).collect()) == [0, 2, 4, 5, 7]


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_many_rows_of_one_key_in_small_arrow_batches(spark, tmp_path, delay):
    """A key with more rows than an Arrow batch holds waits in state, slot by slot."""
    rows = [("r", float(s), s % 7 == 0, f"state {s}" if s % 7 == 0 else None, s) for s in range(900)]
    mixed = [rows[k] for k in range(1, 900, 2)] + [rows[k] for k in range(0, 900, 2)]
    batches = [mixed, [("end", 1e6, True, "x", None)]]
    stream = steps(spark, str(tmp_path / "in"), "robot_id string, s double, is_pose boolean, mode string, n long", batches)
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = drain(st.asof_pose_stream(stream, ["robot_id"], ["mode"], ["n"], delay=delay, slot_s=100.0), str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch")
    assert {r.n: r.mode for r in out} == {s: f"state {s - s % 7}" for s in range(900) if s % 7}
    assert all(r.tf_ok for r in out)


def test_tracking_error_joins_two_streams(spark, tmp_path):
    goals = [[("g1", 0.0)], [("g2", 20.0)], [("g3", 60.0)], [("end", 10_000.0)]]
    states = [[("g1", 0.25, 0.1), ("g1", 0.5, 0.2)], [("g2", 20.5, 0.3), ("g1", 9.0, 0.9)], [("g3", 60.0, 0.5), ("g3", 61.0, 0.6)], [("end", 10_000.0, 0.0)], [("g1", 0.75, 0.7)]]
    a = steps(spark, str(tmp_path / "goals"), "goal_id string, s double", goals)
    a = a.withColumns({"start": F.array(F.lit(0.0)), "goal": F.array(F.lit(1.0)), "d": F.lit(1.0)})
    a = rb.resample(a, "start", "goal", "d", 10).select("goal_id", "ts", "points")
    b = steps(spark, str(tmp_path / "states"), "goal_id string, s double, p double", states)
    b = b.select("goal_id", "ts", F.array("p").alias("position"), F.array(F.lit(0.5)).alias("velocity"))
    seen = []
    out = drain(wn.tracking_error_stream(a, b, 2.0), str(tmp_path / "out"), seen=seen)
    got = {(r.goal_id, r.s): (round(r.error[0], 6), r.velocity_error[0]) for r in out.select("goal_id", rel(), "error", "velocity_error").collect() if r.goal_id != "end"}
    # A state 9 s after its goal's start is no part of it; the one that comes last is late.
    assert got == {("g1", 0.25): (0.15, -0.5), ("g1", 0.5): (0.3, -0.5), ("g2", 20.5): (0.2, -0.5), ("g3", 60.0): (-0.5, -0.5), ("g3", 61.0): (0.4, -0.5)}
    assert late_rows(seen[0]) == 1
    assert state_rows(seen[0]) <= 2


def test_tracker_lets_idle_sessions_go(spark, tmp_path):
    det = "array<struct<class_name:string,confidence:double,center:struct<x:double,y:double,z:double>,extent:struct<x:double,y:double,z:double>,yaw_deg:double,point_count:int,in_workspace:boolean,yaw_reliable:boolean>>"
    one = [("cork", 0.9, (0.1, 0.0, 0.3), (0.02, 0.02, 0.01), 0.0, 200, True, False)]
    batches = [[("s", float(i), i, one) for i in range(0, 8, 2)], [("s", float(i), i, one) for i in (7, 1, 3, 5)], [("s", 500.0, 500, one)], [("end", 10_000.0, 1, one)]]
    stream = steps(spark, str(tmp_path / "in"), f"session_id string, s double, frame_index long, detections {det}", batches)
    out = drain(st.track_stream(stream, delay="20 seconds", idle_s=100.0), str(tmp_path / "out"))
    got = {r.frame_index: (r.track_id, r.hits) for r in out.collect() if r.session_id == "s"}
    # Frames come in order of time although they arrived out of order; the session starts anew after its state went.
    assert got == {**{i: (0, i + 1) for i in range(8)}, 500: (0, 1)}


def test_slots_of_few_rows_share_a_chunk():
    import pandas as pd

    class Map(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

        def iterator(self):
            return iter(self.items())

    class Timers:
        def registerTimer(self, ms):
            self.ms = ms

    class Echo(st.InOrder):
        def _played(self, key, rows):
            yield rows.sort_values(self.order, ignore_index=True)

    work = Echo([st.US, "n"], [st.US, "n"], 1000, True, None, True)
    work.slots, work.chunks, work.handle = Map(), Map(), Timers()
    rows = pd.DataFrame({st.US: [(i * 7919) % 5000 * 1000 + 5 for i in range(5000)], "n": range(5000)})
    for part in (rows[::2], rows[1::2]):
        work._keep(part, work._pending())
    # One chunk a slot and batch before: 5000.
    assert len(work.chunks) <= 8 and sum(n for n, _ in work.slots.values()) == len(work.chunks)
    first = list(work._ready(("k",), work._pending(), 1234.0))
    assert pd.concat(first)[st.US].tolist() == [i * 1000 + 5 for i in range(1234)] and work.handle.ms == 1236
    second = list(work._ready(("k",), work._pending(), 9999.0))
    assert pd.concat(second)[st.US].tolist() == [i * 1000 + 5 for i in range(1234, 5000)] and not work.chunks and not work.slots


def test_every_half_second_of_a_class_opens_a_track(spark, tmp_path):
    import datetime

    from rigtable.catalog import tracking as queries

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    # Two classes in one half second, then the same place again within the frames that a track survives.
    rows = [(1, at(0.1), 7, "click"), (2, at(0.2), 7, "view"), (3, at(1.1), 7, "click"), (4, at(1.2), 7, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").selectExpr(
        "event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "1.5D AS value", "'{\"k\": 3}' AS props"
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["T1_track_stream"](spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.class_name, r.n, r.n_tracks) for r in got) == [("7", "cork", 2, 2), ("7", "pompom", 1, 1)]


def test_neighbouring_half_seconds_of_a_class_open_two_tracks(spark, tmp_path):
    import datetime

    from rigtable.catalog import tracking as queries

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0.1), 7, "click"), (2, at(0.6), 7, "click"), (3, at(0.7), 7, "click"), (4, at(1.0), 7, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").selectExpr(
        "event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "1.5D AS value", "'{\"k\": 3}' AS props"
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["T1_track_stream"](spark, str(tmp_path)).collect()
    assert [(r.session_id, r.class_name, r.n, r.n_tracks) for r in got] == [("7", "cork", 3, 3)]


def test_a_path_is_made_where_a_state_meets_its_goal(spark, tmp_path):
    goals, states = [[("g1", 0.0)], [("end", 10_000.0)]], [[("g1", 0.25, 0.1), ("g1", 0.5, 0.2)], [("end", 10_000.0, 0.0)]]
    a = steps(spark, str(tmp_path / "goals"), "goal_id string, s double", goals).withColumns({"start": F.array(F.lit(0.0)), "goal": F.array(F.lit(1.0))})
    b = steps(spark, str(tmp_path / "states"), "goal_id string, s double, p double", states)
    b = b.select("goal_id", "ts", F.array("p").alias("position"), F.array(F.lit(0.5)).alias("velocity"))
    made = lambda goal: arm.resample(goal["start"], goal["goal"], 1.0, 10)
    out, held = [], []
    for name, given, path in (("late", a.drop("s"), made), ("early", a.withColumn("points", arm.resample(F.col("start"), F.col("goal"), 1.0, 10)), None)):
        seen = []
        got = drain(wn.tracking_error_stream(given, b, 2.0, path=path), str(tmp_path / name), seen=seen)
        assert "points" not in got.columns and "_goal" not in got.columns
        out.append(sorted((r.goal_id, r.s, round(r.error[0], 6)) for r in got.select("goal_id", rel(), "error").collect() if r.goal_id != "end"))
        held.append(max(o["customMetrics"]["stateOnCurrentVersionSizeBytes"] for p in seen[0].recentProgress for o in p["stateOperators"]) if "stateOnCurrentVersionSizeBytes" in seen[0].recentProgress[0]["stateOperators"][0]["customMetrics"] else None)
    assert out[0] == out[1] == [("g1", 0.25, 0.15), ("g1", 0.5, 0.3)]
    assert held[0] is None or held[0] < held[1]


def test_points_of_a_path_are_made_once_a_row(spark):
    df = spark.range(20).select(F.array(F.col("id") * 1.0).alias("a"), F.array(F.col("id") * 2.0).alias("b"), (F.col("id") / 20).alias("t"))
    got = df.select("a", "t", arm.interp_at(arm.resample(F.col("a"), F.col("b"), 1.0, 10), F.col("t")).alias("at"))
    assert got._jdf.queryExecution().analyzed().toString().count("sequence(0, 10") == 1
    assert all(abs(r["at"][0] - r["a"][0] * (1 + r["t"])) < 1e-9 for r in got.collect())
