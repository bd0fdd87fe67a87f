"""Views, visible pixels and composites against plain sets."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rigtable.operators import views as vw
from rigtable.plans import synth


def drawn(rng, captures=5):
    """Pixels of 40 x 30 images, some captures wholly under their occluder."""
    px = {(c, w, u, v) for c in range(captures) for w in "ab" for u, v in zip(rng.integers(0, 40, 90).tolist(), rng.integers(0, 30, 90).tolist())}
    cover = {(c, u, v) for c in range(captures) for u in range(40) for v in range(30) if c == 1 or u >= 17 and c != 2}
    return px, cover


def test_views_leave_no_sine_to_take_point_by_point(spark):
    pts = spark.range(3).select(F.col("id").alias("capture_id"), *[(F.rand(i) + 0.1).alias(c) for i, c in enumerate("xyz")])
    each = vw.expand_views(pts)
    assert "COS(" not in each._jdf.queryExecution().optimizedPlan().toString().upper()
    for r in each.collect():
        y, p = math.radians(r.yaw_deg), math.radians(r.pitch_deg)
        want = (math.cos(y) * r.x + math.sin(y) * math.sin(p) * r.y + math.sin(y) * math.cos(p) * r.z, math.cos(p) * r.y - math.sin(p) * r.z,
                -math.sin(y) * r.x + math.cos(y) * math.sin(p) * r.y + math.cos(y) * math.cos(p) * r.z)
        assert np.allclose((r.vx, r.vy, r.vz), want, atol=1e-12)


def test_pixels_left_of_every_view(spark):
    px, cover = drawn(np.random.default_rng(3))
    inst = spark.createDataFrame(pd.DataFrame(sorted(px), columns=["capture_id", "view_id", "u", "v"]))
    occ = spark.createDataFrame(pd.DataFrame(sorted(cover), columns=["capture_id", "u", "v"]))
    want = {(c, w): sum((c, u, v) not in cover for a, b, u, v in px if (a, b) == (c, w)) for c, w, _, _ in px}
    assert 0 in want.values()
    shared = ["capture_id", "u", "v"]
    got = vw.pixels_left(inst, occ, ["capture_id", "view_id"], shared)
    assert {(r.capture_id, r.view_id): r.n_left for r in got.collect()} == want
    left, dropped = vw.visible_views(inst, occ, ["capture_id", "view_id"], shared)
    assert left.count() == sum(want.values())
    assert {tuple(r) for r in dropped.collect()} == {k for k, n in want.items() if not n}
    # The instances are read once for the counts, however they were made.
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert dropped._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    everything = vw.pixels_left(inst, None, ["capture_id", "view_id"])
    assert sum(r.n_left for r in everything.collect()) == len(px)


def test_points_of_a_capture_meet_before_they_are_multiplied(spark):
    pts = spark.range(200).select(
        (F.col("id") % 3).alias("capture_id"), F.col("id").alias("point_id"), *[(F.rand(i) * 0.2).alias(c) for i, c in enumerate("xy")],
        F.lit(0.5).alias("z"), *[F.lit(1).alias(c) for c in ("instance_id", "r", "g", "b")],
    )
    px, _ = synth.render_views(pts, (10.0, 10.0, 3.5, 3.5), 8, 8)
    plan = px.groupBy("capture_id", "view_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_one_native_occluder_serves_all_views(spark):
    px, cover = drawn(np.random.default_rng(4))
    rows = sorted(px)
    objects = spark.createDataFrame(pd.DataFrame([(*k, 7) for k in rows], columns=["capture_id", "view_id", "u", "v", "r"]))
    ground = spark.createDataFrame(pd.DataFrame([(c, w, u, v, 1) for c in range(5) for w in "ab" for u in range(40) for v in range(30)], columns=["capture_id", "view_id", "u", "v", "r"]))
    occ = spark.createDataFrame(pd.DataFrame(sorted(cover), columns=["capture_id", "u", "v"]))
    got = vw.composite(ground, objects, occ, ["capture_id", "view_id", "u", "v"], ["r"], pixel=["capture_id", "u", "v"]).collect()
    seen = {k for k in px if (k[0], k[2], k[3]) not in cover}
    assert len(got) == 5 * 2 * 40 * 30
    assert {(r.capture_id, r.view_id, r.u, r.v) for r in got if r.pasted} == seen == {(r.capture_id, r.view_id, r.u, r.v) for r in got if r.r == 7}
