"""Boxes, filters, rotations and text against numpy and plain Python."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rigtable.functions import arm, text, vec
from rigtable.operators import geometry as g


def frame(normal):
    n = np.array(normal, float) / np.linalg.norm(normal)
    u = np.array([1.0, 0, 0]) - n[0] * n
    u /= np.linalg.norm(u)
    return u, np.cross(n, u), n


def test_box_matches_eigen_decomposition(spark):
    rng = np.random.default_rng(2)
    normal = (0.1, -0.8, -0.5)
    parts = []
    for k in range(6):
        a = rng.random() * np.pi
        pts = rng.random((200, 3)) * [0.3, 0.05, 0.1] - 0.1
        rot = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        parts.append(pd.DataFrame(pts @ rot.T @ np.stack(frame(normal)), columns=["x", "y", "z"]).assign(k=k))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf)
    fixed = {r["k"]: r for r in g.table_obb(df, ["k"], normal).collect()}
    column = df.withColumn("n", vec.pack(vec.lits(normal)))
    per_row = {r["k"]: r for r in g.table_obb(column, ["k"], "n").collect()}
    u, v, n = frame(normal)
    for k, part in pdf.groupby("k"):
        p = part[["x", "y", "z"]].to_numpy()
        plane = np.stack([p @ u, p @ v], axis=1)
        w, e = np.linalg.eigh(np.cov(plane, rowvar=False))
        major = e[:, np.argmax(w)]
        yaw = (math.atan2(major[1], major[0]) + np.pi / 2) % np.pi - np.pi / 2
        long, short = np.cos(yaw) * u + np.sin(yaw) * v, np.cos(yaw) * v - np.sin(yaw) * u
        local = np.stack([p @ long, p @ short, p @ n], axis=1)
        center = np.stack([long, short, n], axis=1) @ ((local.min(0) + local.max(0)) / 2)
        for row in (fixed[k], per_row[k]):
            assert abs(row["yaw_rad"] - yaw) < 1e-9
            assert np.allclose([row["center"][a] for a in "xyz"], center)
            assert np.allclose([row["extent"][a] for a in "xyz"], local.max(0) - local.min(0))
            corners = np.array([[c[a] for a in "xyz"] for c in row["corners"]])
            assert np.allclose(corners.mean(0), center) and np.allclose(corners.min(0), [row["bbox_min"][a] for a in "xyz"])


def test_mad_filter_guards(spark):
    z = {"flat": [0.4] * 9 + [9.0], "spread": [0.40, 0.41, 0.42, 0.43, 0.44, 5.0], "one": [0.3]}
    df = spark.createDataFrame([(k, v) for k, vs in z.items() for v in vs], "k string, z double")
    kept = g.mad_filter(df, ["k"]).groupBy("k").count().collect()
    assert dict(map(tuple, kept)) == {"flat": 10, "spread": 5, "one": 1}


def test_depth_stats_leave_missing_depth_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 0.0), (1, 3.0)], "k int, depth_m double")
    row = g.depth_stats(df, ["k"]).first()
    assert (row.n, row.n_valid, row.z_min, row.z_max, row.z_median) == (4, 2, 1.0, 3.0, 2.0)


def test_too_few_points_leave_no_pose(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.4)] * 3, "k int, x double, y double, z double")
    dets = spark.createDataFrame([(1, "cork"), (2, "cork")], "k int, class_name string")
    out = {r["k"]: r for r in g.build_detections(pts, dets, ["k"], min_points=4).collect()}
    assert out[1]["center"] is None and out[1]["point_count"] == 3 and out[2]["point_count"] == 0
    assert out[1]["in_workspace"] and not out[1]["yaw_reliable"]


def test_workspace_text():
    assert g.parse_workspace("1,0, 2,3,5,4") == {"x": (0.0, 1.0), "y": (2.0, 3.0), "z": (4.0, 5.0)}
    assert g.parse_workspace("1,2,3") is None and g.parse_workspace("") is None and g.parse_workspace("a,b,c,d,e,f") is None


def test_depth_band_is_strict(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (0.5,), (float("nan"),), (float("inf"),), (-1.0,)], "z double")
    assert [r["z"] for r in df.filter(g.valid_depth("z", 0.3, 0.7)).collect()] == [0.5]


def test_rotations_round_trip(spark):
    rng = np.random.default_rng(8)
    q = rng.normal(0, 1, (200, 4))
    q[:4] = np.eye(4)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame(q, columns=list("xyzw"))).withColumn("m", vec.rigid_from_quat(vec.lits((1, 2, 3)), tuple(F.col(c) for c in "xyzw")))
    back = vec.rot_to_quat(vec.rigid_parts("m")[0])
    got = df.select("x", "y", "z", "w", *[c.alias(f"b{n}") for c, n in zip(back, "xyzw")], vec.rot_angle_deg(vec.rigid_parts(vec.compose("m", "m"))[0]).alias("deg")).toPandas()
    a, b = got[list("xyzw")].to_numpy(), got[["bx", "by", "bz", "bw"]].to_numpy()
    assert np.allclose(np.abs((a * b).sum(1)), 1)
    turn = np.degrees(2 * np.arccos(np.clip(np.abs(a[:, 3]), 0, 1)))
    twice = np.minimum(2 * turn, 360 - 2 * turn)
    assert np.allclose(got["deg"], twice, atol=1e-4)


def test_project_undoes_backproject(spark):
    df = spark.createDataFrame([(3.0, 5.0, 0.7)], "u double, v double, z double")
    k = [F.lit(c) for c in (600.0, 610.0, 320.0, 240.0)]
    p = vec.backproject(F.col("u"), F.col("v"), F.col("z"), *k)
    row = df.select(*[c.alias(n) for c, n in zip(vec.project(p, *k), "abc")]).first()
    assert np.allclose(list(row), [3.0, 5.0, 0.7])


def test_six_digit_text_like_python(spark):
    values = [i / 640 for i in range(641)] + [i / 480 for i in range(481)] + [k / 128 for k in range(129)] + np.random.default_rng(1).random(500).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(text.fixed6(F.col("v"))).collect()]
    assert got == [f"{v:.6f}" for v in values]


def test_trajectory_interpolation(spark):
    pts = [([0.0, 0.0], 0.5), ([1.0, 2.0], 1.0), ([3.0, 0.0], 2.0)]
    df = spark.createDataFrame([(pts, t) for t in (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 9.0)], "p array<struct<positions:array<double>,t:double>>, t double")
    full = arm.with_start(F.col("p"), F.array(F.lit(-1.0), F.lit(0.0)))
    got = [r[0] for r in df.select(arm.interp_at(full, F.col("t"))).collect()]
    assert np.allclose(got, [[-1, 0], [-0.5, 0], [0, 0], [0.5, 1], [1, 2], [2, 1], [3, 0]])


def test_label_anchor_takes_first_lowest(spark):
    corner = [(float(i), 1.0 if i < 2 else 0.5, 0.0) for i in range(8)]
    df = spark.createDataFrame([(corner, (9.0, 9.0, 9.0)), (None, (9.0, 9.0, 9.0))], "corners array<struct<x:double,y:double,z:double>>, center struct<x:double,y:double,z:double>")
    assert [r[0]["x"] for r in df.select(g.label_anchor()).collect()] == [2.0, 9.0]


def test_plane_normal(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((400, 2))
    tilt = np.stack([xy[:, 0], 0.5 + 0.2 * xy[:, 0] + rng.normal(0, 0.001, 400), xy[:, 1]], axis=1)
    noise = rng.random((100, 3))
    pdf = pd.DataFrame(np.vstack([tilt, noise]), columns=["x", "y", "z"]).assign(f=1, v=range(500), u=0)
    few = pd.DataFrame(rng.random((20, 3)), columns=["x", "y", "z"]).assign(f=2, v=range(20), u=0)
    out = {r["f"]: r for r in g.table_normal(spark.createDataFrame(pd.concat([pdf, few])), ["f"], seed=1).collect()}
    want = np.array([0.2, -1, 0]) / np.hypot(0.2, 1)
    got = np.array([out[1]["nx"], out[1]["ny"], out[1]["nz"]])
    assert np.degrees(np.arccos(np.clip(got @ want, -1, 1))) < 1.0
    assert (out[2]["nx"], out[2]["ny"], out[2]["nz"]) == (0.0, -1.0, 0.0)
