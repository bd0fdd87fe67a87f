"""Depth pixels to points, robust filtering, oriented boxes and scene summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.functions import vec
from rigtable.functions.text import parse_names
from rigtable.scale import group_quantiles, median_and_mad, number_rows, with_stats

# Consistency factor and width of the robust depth band.
MAD_SIGMA = 1.4826
MAD_SCALE = 2.5

Bounds = dict[str, tuple[float, float]]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- predicates ------------------------------------------------------------------


def valid_depth(depth: Column | str, low: float, high: float) -> Column:
    """Strictly inside the band; NaN and infinities sort above the upper bound."""
    d = _col(depth)
    return (d > low) & (d < high)


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_WORKSPACE = re.compile(",".join(f"(?P<{axis}{end}>{_NUMBER})" for axis in "xyz" for end in "01"))


def parse_workspace(text: str | None) -> Bounds | None:
    """Bounds of x, y and z from text such as ``0,1,-1,1,0,2``, either end of an axis first; any other text means no workspace."""
    found = _WORKSPACE.fullmatch(re.sub(r"\s", "", text or ""))
    if found is None:
        return None
    ends = {axis: (float(found[f"{axis}0"]), float(found[f"{axis}1"])) for axis in "xyz"}
    return {axis: (min(e), max(e)) for axis, e in ends.items()}


def in_workspace(center: vec.Vec, bounds: Bounds | None) -> Column:
    """Closed box; true without bounds or without a centre."""
    if bounds is None:
        return F.lit(True)
    inside = F.lit(True)
    for c, axis in zip(center, "xyz"):
        inside = inside & c.between(*bounds[axis])
    return F.coalesce(inside, F.lit(True))


def yaw_reliable(class_name: Column | str, non_symmetric: str | Sequence[str]) -> Column:
    names = parse_names(non_symmetric) if isinstance(non_symmetric, str) else list(non_symmetric)
    return _col(class_name).isin(names) if names else F.lit(False)


def stride_pixels(pixels: DataFrame, k: int) -> DataFrame:
    k = max(1, k)
    return pixels.filter((F.col("u") % k == 0) & (F.col("v") % k == 0))


def good_view(center: vec.Vec) -> Column:
    """25 to 35 cm away and less than 6 cm off axis."""
    far = center[2] * 100.0
    off = F.sqrt(center[0] * center[0] + center[1] * center[1]) * 100.0
    return far.between(25.0, 35.0) & (off < 6.0)


# --- lifting ---------------------------------------------------------------------


def backproject(pixels: DataFrame, fx, fy, ppx, ppy, depth: str = "depth_m") -> DataFrame:
    """Adds x, y, z; colours and pixel positions simply ride along."""
    x, y, z = vec.backproject(F.col("u"), F.col("v"), F.col(depth), *[F.lit(c) if isinstance(c, (int, float)) else _col(c) for c in (fx, fy, ppx, ppy)])
    return pixels.withColumns({"x": x, "y": y, "z": z})


def cap_even(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], m: int, bucket: Column | None = None
) -> DataFrame:
    """Evenly spaced m of n rows per key, first and last included; all rows when n <= m.

    ``bucket`` is any coarse, non-decreasing function of the order and spreads large keys.
    """
    if m <= 0:
        return df
    keys = list(keys)
    numbered = number_rows(df, keys, F.lit(0) if bucket is None else bucket, order, "_i")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    at, n = F.col("_i") - 1, F.col("_n")
    if m == 1:
        chosen = at == 0
    else:
        # row `at` is chosen when some k in 0..m-1 has k*(n-1) div (m-1) = at
        k = F.ceil(at * (m - 1) / (n - 1))
        chosen = F.floor(k * (n - 1) / (m - 1)) == at
    return numbered.join(sizes, keys).filter((n <= m) | chosen).drop("_i", "_n")


def scene_cloud(
    pixels: DataFrame, keys: Sequence[str], intrinsics: tuple, stride: int, low: float, high: float, max_points: int
) -> DataFrame:
    """Strided, depth-banded, back-projected and evenly capped points of each frame."""
    kept = stride_pixels(pixels, stride).filter(valid_depth("depth_m", low, high))
    cloud = backproject(kept, *intrinsics)
    return cap_even(cloud, keys, [F.col("v"), F.col("u")], max_points, bucket=F.floor(F.col("v") / 64))


def dim_outside(points: DataFrame, bounds: Bounds | None, colors: Sequence[str] = ("r", "g", "b"), factor: float = 0.25) -> DataFrame:
    if bounds is None:
        return points
    inside = in_workspace((F.col("x"), F.col("y"), F.col("z")), bounds)
    return points.withColumns({c: F.when(inside, F.col(c)).otherwise(F.col(c) * factor) for c in colors})


def normalize_depth(
    pixels: DataFrame,
    keys: Sequence[str],
    mode: str = "minmax",
    low: float | None = None,
    high: float | None = None,
    depth: str = "depth_m",
) -> DataFrame:
    """Adds ``norm`` in [0, 1] for preview; null on invalid pixels.

    ``minmax`` scales by the valid range (each end may be given), ``percentile`` by p2
    and p98 with a 5 cm margin around the middle when these nearly agree, ``manual`` by
    two given ends (percentile rules apply when they are not a positive, rising pair).
    """
    keys = list(keys)
    d = F.col(depth)
    good = (d > 0) & (d < float("inf"))
    if mode == "manual" and not (low and high and 0 < low < high):
        mode = "percentile"
    if mode == "manual":
        lo, hi, floor = F.lit(float(low)), F.lit(float(high)), 1e-3
        joined = pixels
    elif mode == "percentile":
        stats = group_quantiles(pixels.filter(good), keys, depth, {"_p2": 0.02, "_p98": 0.98})
        joined = pixels.join(stats, keys, "left")
        close = F.col("_p98") - F.col("_p2") < 0.05
        mid = (F.col("_p2") + F.col("_p98")) * 0.5
        lo = F.when(close, F.greatest(F.lit(0.01), mid - 0.05)).otherwise(F.col("_p2"))
        hi = F.when(close, mid + 0.05).otherwise(F.col("_p98"))
        floor = 1e-3
    else:
        stats = pixels.filter(good).groupBy(*keys).agg(F.min(d).alias("_p2"), F.max(d).alias("_p98"))
        joined = pixels.join(stats, keys, "left")
        lo = F.lit(float(low)) if low is not None else F.col("_p2")
        hi = F.lit(float(high)) if high is not None else F.col("_p98")
        hi = F.when(hi <= lo, lo + 1e-6).otherwise(hi)
        floor = 0.0
    span = F.greatest(hi - lo, F.lit(floor))
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - lo) / span))
    return joined.withColumn("norm", F.when(good, norm)).drop("_p2", "_p98")


# --- statistics ------------------------------------------------------------------


def depth_stats(pixels: DataFrame, keys: Sequence[str], depth: str = "depth_m") -> DataFrame:
    keys = list(keys)
    good = (F.col(depth) > 0) & ~F.isnan(depth)
    base = pixels.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(good).alias("n_valid"),
        F.min(F.when(good, F.col(depth))).alias("z_min"),
        F.max(F.when(good, F.col(depth))).alias("z_max"),
    )
    mid = group_quantiles(pixels.filter(good), keys, depth, {"z_median": 0.5})
    return base.join(mid, keys, "left").withColumn("valid_pct", F.col("n_valid") * 100.0 / F.col("n"))


def mad_filter(points: DataFrame, keys: Sequence[str], value: str = "z", scale: float = MAD_SCALE) -> DataFrame:
    """Keep points within scale * 1.4826 * MAD of the median; a flat group keeps everything.

    With a positive MAD at least half of the group lies within one MAD, so the band is
    never empty while scale * 1.4826 >= 1; below that the group's count decides.
    """
    keys = list(keys)
    judged = with_stats(points, median_and_mad(points, keys, value), keys).withColumn(
        "_in", (F.col("_mad") < 1e-6) | (F.abs(F.col(value) - F.col("_med")) <= F.lit(scale * MAD_SIGMA) * F.col("_mad"))
    )
    if scale * MAD_SIGMA < 1:
        some = judged.groupBy(*keys).agg(F.max(F.col("_in").cast("int")).alias("_some"))
        judged = with_stats(judged, some, keys).withColumn("_in", F.col("_in") | (F.col("_some") == 0)).drop("_some")
    return judged.filter("_in").drop("_in", "_med", "_mad")


def lift_report(points: DataFrame, masks: DataFrame, keys: Sequence[str], low_pct: float = 95.0) -> DataFrame:
    """Per instance: points, mask pixels, share with usable depth, z range and median.

    ``points`` holds one row per usable mask pixel, ``masks`` one per mask pixel.
    """
    keys = list(keys)
    mask = masks.groupBy(*keys).agg(F.count("*").alias("mask_pixels"))
    pts = points.groupBy(*keys).agg(F.count("*").alias("point_count"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    mid = group_quantiles(points, keys, "z", {"z_median": 0.5})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    pct = F.when(F.col("mask_pixels") > 0, F.lit(100.0) * F.coalesce("point_count", F.lit(0)) / F.col("mask_pixels")).otherwise(0.0)
    return (
        mask.join(pts, keys, "left")
        .join(mid, keys, "left")
        .select(
            *keys, "mask_pixels", F.coalesce("point_count", F.lit(0)).alias("point_count"),
            pct.alias("depth_ok_pct"), zero("z_min"), zero("z_median"), zero("z_max"), (pct < low_pct).alias("has_holes"),
        )
    )


def scene_summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centroid, extent (box diagonal, at least 0.5) and the eye point 1.2 extents in front."""
    keys = list(keys)
    agg = points.groupBy(*keys).agg(
        *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        *[(F.max(c) - F.min(c)).alias(f"_d{c}") for c in "xyz"],
    )
    diag = F.sqrt(sum((F.col(f"_d{c}") * F.col(f"_d{c}") for c in "xyz"), F.lit(0.0)))
    return (
        agg.withColumn("extent", F.greatest(diag, F.lit(0.5)))
        .withColumn("eye_z", F.col("cz") - F.col("extent") * 1.2)
        .drop("_dx", "_dy", "_dz")
    )


# --- oriented boxes --------------------------------------------------------------

UNIT_NORMAL = vec.DEFAULT_NORMAL


def table_obb(
    points: DataFrame,
    keys: Sequence[str],
    normal: Sequence[float] | str = UNIT_NORMAL,
    force_yaw_zero: Column | bool = False,
    xyz: Sequence[str] = ("x", "y", "z"),
) -> DataFrame:
    """Box aligned to the table plane per group, from two combinable aggregations.

    ``normal`` is fixed, or names a STRUCT<x,y,z> column or a ready frame STRUCT<u,v,n>
    (cheaper when many points share it: see ``vec.with_basis``).  The planar covariance
    gives the yaw, then extremes along the turned axes give centre and extent.
    """
    keys = list(keys)
    force = F.lit(force_yaw_zero) if isinstance(force_yaw_zero, bool) else force_yaw_zero
    given = [F.col(normal).alias("_normal")] if isinstance(normal, str) else []
    src = points.select(*keys, *[F.col(c).alias(f"_{a}") for c, a in zip(xyz, "xyz")], *given, force.alias("_flat"))
    if given and "u" in points.schema[normal].dataType.fieldNames():
        src = src.withColumn("_basis", F.col("_normal"))
    elif given:
        src = vec.with_basis(src, F.col("_normal"), "_basis")
    else:
        src = src.withColumn("_basis", vec.fixed_basis(normal))
    p = (F.col("_x"), F.col("_y"), F.col("_z"))
    u, v, w = (vec.parts(F.col("_basis")[k]) for k in ("u", "v", "n"))
    planar = src.withColumns({"_pu": vec.dot(p, u), "_pv": vec.dot(p, v), "_pn": vec.dot(p, w)})
    turn = vec.wrap_half_turn(F.atan2(F.col("_c") * 2.0, F.col("_vu") - F.col("_vv")) * 0.5)
    finite = F.abs(F.col("_c") + F.col("_vu") + F.col("_vv")) < float("inf")
    yaw = F.when((F.col("point_count") < 3) | F.col("_zero") | ~finite, F.lit(0.0)).otherwise(turn)
    moments = {
        "point_count": F.count("*"), "_c": F.covar_samp("_pu", "_pv"), "_vu": F.var_samp("_pu"), "_vv": F.var_samp("_pv"),
    }
    shape = planar.groupBy(*keys).agg(*[c.alias(n) for n, c in moments.items()], F.first("_flat").alias("_zero"))
    turned = with_stats(planar, shape.withColumn("yaw_rad", yaw).select(*keys, "point_count", "yaw_rad"), keys)
    c, s = F.cos("yaw_rad"), F.sin("yaw_rad")
    local = turned.select(
        *keys, "point_count", "yaw_rad", "_basis",
        (c * F.col("_pu") + s * F.col("_pv")).alias("_l"),
        (c * F.col("_pv") - s * F.col("_pu")).alias("_s"),
        F.col("_pn"),
    )
    ends = local.groupBy(*keys).agg(
        F.first("point_count").alias("point_count"), F.first("yaw_rad").alias("yaw_rad"), F.first("_basis").alias("_frame"),
        *[f(c).alias(f"{c}_{tag}") for c in ("_l", "_s", "_pn") for f, tag in ((F.min, "lo"), (F.max, "hi"))],
    )
    joined = ends.withColumns(
        {
            **{f"_e{a}": F.col(f"{c}_hi") - F.col(f"{c}_lo") for a, c in zip("xyz", ("_l", "_s", "_pn"))},
            **{f"_m{a}": (F.col(f"{c}_hi") + F.col(f"{c}_lo")) * 0.5 for a, c in zip("xyz", ("_l", "_s", "_pn"))},
        }
    )
    fu, fv, fn = (vec.parts(F.col("_frame")[k]) for k in ("u", "v", "n"))
    long, short = vec.turned_axes(fu, fv, F.col("yaw_rad"))
    mid = (F.col("_mx"), F.col("_my"), F.col("_mz"))
    world = tuple(mid[0] * long[i] + mid[1] * short[i] + mid[2] * fn[i] for i in range(3))
    joined = joined.withColumns(
        {
            "center": vec.pack(world),
            "extent": vec.pack((F.col("_ex"), F.col("_ey"), F.col("_ez"))),
            "axes": F.array(vec.pack(long), vec.pack(short), vec.pack(fn)),
        }
    )
    corners = vec.box_corners(
        vec.parts("center"), vec.parts("extent"), [vec.parts(F.col("axes")[i]) for i in range(3)]
    )
    reach = lambda a, f: f(F.transform("corners", lambda q: q[a]))
    return joined.withColumn("corners", corners).select(
        *keys,
        "point_count",
        "center",
        "extent",
        "yaw_rad",
        F.degrees("yaw_rad").alias("yaw_deg"),
        "axes",
        "corners",
        vec.pack([reach(a, F.array_min) for a in "xyz"]).alias("bbox_min"),
        vec.pack([reach(a, F.array_max) for a in "xyz"]).alias("bbox_max"),
    )


def build_detections(
    points: DataFrame,
    detections: DataFrame,
    keys: Sequence[str],
    normal: Sequence[float] | str = UNIT_NORMAL,
    min_points: int = 50,
    non_symmetric: str | Sequence[str] = (),
    bounds: Bounds | None = None,
    cls: str = "class_name",
) -> DataFrame:
    """Filtered points to located detections; too few points leave the pose null.

    ``detections`` has one row per key with the class; a detection without points stays.
    """
    keys = list(keys)
    classes = detections.select(*keys, cls)
    tagged = points.join(classes, keys)
    clean = mad_filter(tagged, keys)
    reliable = yaw_reliable(cls, non_symmetric)
    boxes = table_obb(clean, keys, normal, force_yaw_zero=~reliable)
    enough = F.coalesce(F.col("point_count"), F.lit(0)) >= min_points
    pose = ["center", "extent", "yaw_rad", "yaw_deg", "axes", "corners", "bbox_min", "bbox_max"]
    out = detections.join(boxes, keys, "left").withColumns({c: F.when(enough, F.col(c)) for c in pose})
    return out.withColumns(
        {
            "point_count": F.coalesce("point_count", F.lit(0)),
            "in_workspace": in_workspace(vec.parts("center"), bounds),
            "yaw_reliable": F.when(enough, reliable).otherwise(False),
        }
    )


def points_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    palette: Sequence[Sequence[float]],
    cell: float = 0.05,
    id_col: str = "point_id",
    box_no: str = "box_no",
) -> DataFrame:
    """Blend box colours into the points they hold, later boxes on top.

    Boxes are listed under the grid cells they reach, so a point meets only the boxes of
    its own cell; the blend is a fold over the hits of a point in box order.
    """
    keys = list(keys)
    eps = 1e-4
    reach = lambda a: sum(
        (F.abs(F.col("axes")[i][a]) * (F.col("extent")[e] * 0.5 + eps) for i, e in enumerate("xyz")), F.lit(0.0)
    )
    span = lambda a: F.sequence(
        F.floor((F.col("center")[a] - reach(a)) / cell), F.floor((F.col("center")[a] + reach(a)) / cell)
    )
    listed = boxes.filter(F.col("center").isNotNull())
    for a in "xyz":
        listed = listed.withColumn(f"_g{a}", F.explode(span(a)))
    listed = listed.select(*keys, box_no, "center", "extent", "axes", "_gx", "_gy", "_gz")
    spots = points.select(*keys, id_col, "x", "y", "z").withColumns({f"_g{a}": F.floor(F.col(a) / cell) for a in "xyz"})
    p = (F.col("x"), F.col("y"), F.col("z"))
    off = vec.sub(p, vec.parts("center"))
    inside = F.lit(True)
    for i, e in enumerate("xyz"):
        inside = inside & (F.abs(vec.dot(off, vec.parts(F.col("axes")[i]))) <= F.col("extent")[e] * 0.5 + eps)
    hits = (
        spots.join(listed, keys + ["_gx", "_gy", "_gz"])
        .filter(inside)
        .groupBy(*keys, id_col)
        .agg(F.array_sort(F.collect_list(box_no)).alias("_boxes"))
    )
    colors = F.array(*[F.array(*[F.lit(float(c)) for c in rgb]) for rgb in palette])
    blend = lambda c, i: F.when(
        F.col("_boxes").isNotNull(),
        F.aggregate(
            "_boxes",
            F.col(c).cast("double"),
            lambda acc, b: acc * 0.55 + F.element_at(F.element_at(colors, (b % len(palette)).cast("int") + 1), i + 1) * 0.45,
        ),
    ).otherwise(F.col(c))
    return points.join(hits, keys + [id_col], "left").withColumns(
        {c: blend(c, i) for i, c in enumerate("rgb")} | {"n_boxes": F.coalesce(F.size("_boxes"), F.lit(0))}
    ).drop("_boxes")


def label_anchor(corners: Column | str = "corners", center: Column | str = "center") -> Column:
    """Corner with the smallest y (the first such one), else the centre, else the origin."""
    ranked = F.transform(_col(corners), lambda c, i: F.struct(c["y"].alias("y"), i.alias("i"), c.alias("c")))
    top = F.when(F.size(_col(corners)) == 8, F.array_min(ranked)["c"])
    return F.coalesce(top, _col(center), vec.pack(vec.lits((0, 0, 0))))


# --- table plane -----------------------------------------------------------------


def table_normal(
    points: DataFrame,
    keys: Sequence[str],
    seed: int = 0,
    distance: float = 0.01,
    tries: int = 120,
    min_points: int = 128,
    order: Sequence[str] = ("v", "u"),
    draw: Column | None = None,
) -> DataFrame:
    """Normal of the plane with most inliers per frame, facing the default normal.

    A trial plane goes through three of the points that a seeded hash puts first (or the
    expression ``draw`` over ``order``).  One aggregate counts each point for all trials in
    place, map-side combined; the best trial (of equals the first) is refined to the direction
    of least spread of its inliers, from their covariances, in a second pass.  Frames of
    fewer than ``min_points`` keep the default normal.
    """
    keys = list(keys)
    pts = points.select(*keys, *order, *[F.col(a).cast("double").alias(a) for a in "xyz"])
    first = F.xxhash64(*order, F.lit(seed)) if draw is None else draw
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(first, *order))
    drawn = pts.withColumn("_i", place).filter(F.col("_i") <= 3 * tries)
    drawn = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "x", "y", "z"))).alias("_p"))  # at most 3 * tries
    m = F.size("_p")

    def corner(t: Column, j: int) -> tuple[Column, Column, Column]:
        # Past the end the triples go on with a wider stride, so that they differ.
        at = F.get("_p", ((3 * t + j * (1 + F.floor(3 * t / m))) % m).cast("int"))
        return at["x"], at["y"], at["z"]

    def plane(t: Column) -> Column:
        first = corner(t, 0)
        normal = vec.cross(vec.sub(corner(t, 1), first), vec.sub(corner(t, 2), first))
        size = F.sqrt(vec.dot(normal, normal))
        unit = tuple(c / size for c in normal)
        return F.array(*[F.when(size > 1e-12, c) for c in (*unit, -vec.dot(unit, first))])

    trials = drawn.select(*keys, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), plane)).alias("_ws"))

    def near(ws: str, t: int) -> str:
        # SQL text keeps the many counters cheap to build; a trial without a plane is null and counts nothing.
        nx, ny, nz, d = (f"get({ws}, {4 * t + i})" for i in range(4))
        return f"abs(x * {nx} + y * {ny} + z * {nz} + {d}) < {float(distance)!r}D"

    tally = F.expr(f"array({', '.join(f'count_if({near("_ws", t)})' for t in range(tries))})")
    counted = with_stats(pts, trials, keys).groupBy(*keys).agg(F.count("*").alias("_n"), tally.alias("_c"))
    won = counted.select(*keys, "_n", F.array_max("_c").alias("inliers"), (4 * F.array_position("_c", F.array_max("_c")) - 3).cast("int").alias("_t"))
    best = with_stats(won, trials, keys).select(*keys, "_n", "inliers", F.slice("_ws", F.col("_t"), 4).alias("_w"))
    inlier = lambda c: F.when(F.expr(near("_w", 0)), F.col(c))
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    spread = with_stats(pts, best, keys).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("inliers").alias("inliers"), F.array(*[F.covar_pop(inlier(a), inlier(b)) for a, b in pairs]).alias("_c")
    )

    @F.pandas_udf("array<double>")
    def least_spread(c: pd.Series) -> pd.Series:
        out = []
        for cov in c:
            if cov is None:
                out.append(None)
                continue
            xx, xy, xz, yy, yz, zz = cov
            normal = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))[1][:, 0]
            out.append(normal if normal @ np.array(UNIT_NORMAL) >= 0 else -normal)
        return pd.Series(out, dtype=object)

    enough = (F.col("_n") >= min_points) & (F.col("inliers") > 0)
    fitted = spread.withColumn("_u", least_spread(F.when(enough, F.col("_c"))))
    return fitted.select(
        *keys, *[F.coalesce(F.col("_u")[i], F.lit(float(UNIT_NORMAL[i]))).alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
        F.when(enough, F.col("inliers")).otherwise(0).alias("inliers"),
    )


# --- display text ----------------------------------------------------------------


def format_label(tracked: bool = True) -> Column:
    """Multi-line text of a detection; the filtered pose wins where present."""
    prefix = F.lit("")
    if tracked:
        state = F.when(F.col("stable"), F.lit("STABLE")).otherwise(F.concat(F.col("hits").cast("string"), F.lit("/win")))
        prefix = F.when(
            F.col("track_id").isNotNull(), F.format_string("#%d [%s] ", F.col("track_id"), state)
        ).otherwise("")
    center = F.coalesce(F.col("center_filtered"), F.col("center")) if tracked else F.col("center")
    yaw = F.coalesce(F.col("yaw_filtered_deg"), F.col("yaw_deg")) if tracked else F.col("yaw_deg")
    yaw_text = (
        F.when(yaw.isNull(), "n/a").when(~F.coalesce("yaw_reliable", F.lit(True)), "n/a (sym)").otherwise(F.format_string("%.1f deg", yaw))
    )
    head = F.format_string("%s%s %.2f\n", prefix, F.col("class_name"), F.col("confidence"))
    tail = F.format_string("pts=%d", F.col("point_count"))
    pose = F.format_string("xyz=(%.3f, %.3f, %.3f) m\nyaw=%s\n", center["x"], center["y"], center["z"], yaw_text)
    return F.concat(head, F.when(F.col("center").isNull(), "").otherwise(pose), tail)

