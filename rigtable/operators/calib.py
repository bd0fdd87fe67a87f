"""Calibration spread, base-frame consistency and target choice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.functions import vec
from rigtable.scale import with_stats
from rigtable.session import staged

# Fixed value: accepted spread of a fixed object in the base frame.
GOOD_SPREAD_MM = 7.0


def calibration_spread(samples: DataFrame, candidates: DataFrame, session: str = "session_id", candidate: str = "method") -> DataFrame:
    """Spread of a fixed target per candidate, ``best`` marking the lowest score.

    ``samples`` carry rigid structs ``base_T_ee`` and ``cam_T_target``, candidates
    ``ee_T_cam``.  Rotations are averaged as nine sums; only the 3x3 average of each
    candidate goes through a small SVD.
    """
    key = [session, candidate]
    posed = samples.join(candidates, session).withColumn(
        "_t", vec.compose(vec.compose("base_T_ee", "ee_T_cam"), "cam_T_target")
    )
    cells = [f"r{i}{j}" for i in range(3) for j in range(3)]
    mean = posed.groupBy(*key).agg(
        F.count("*").alias("n_samples"),
        F.sqrt(sum((F.var_pop(F.col("_t")[c]) for c in ("tx", "ty", "tz")), F.lit(0.0))).alias("trans_std_m"),
        *[F.avg(F.col("_t")[c]).alias(f"m_{c}") for c in cells],
    )

    @F.pandas_udf("array<double>")
    def nearest_rotation(m: pd.Series) -> pd.Series:
        if not len(m):
            return pd.Series([], dtype=object)
        u, _, vt = np.linalg.svd(np.stack(m.to_numpy()).reshape(-1, 3, 3))
        return pd.Series(list((u @ vt).reshape(-1, 9)))

    ref = mean.withColumn("_ref", nearest_rotation(F.array(*[F.col(f"m_{c}") for c in cells])))
    r, _ = vec.rigid_parts("_t")
    q = [[F.col("_ref")[3 * i + j] for j in range(3)] for i in range(3)]
    deviation = (
        posed.select(*key, "_t")
        .join(ref.select(*key, "_ref"), key)
        .groupBy(*key)
        .agg(F.avg(vec.rot_angle_deg(vec.matmul(vec.transpose(r), q))).alias("rot_std_deg"))
    )
    scored = mean.select(*key, "n_samples", "trans_std_m").join(deviation, key).withColumn(
        "score", F.col("trans_std_m") * 1000.0 + F.col("rot_std_deg")
    )
    best = scored.groupBy(session).agg(F.min(F.struct("score", candidate)).alias("_b"))
    return scored.join(best, session).withColumn("best", F.col(candidate) == F.col(f"_b.{candidate}")).drop("_b")


# Pairs of cap points that are measured rather than refined any further, beside those per point.
CAP_PAIRS = 4_000_000


def cube_cell(k: Column, i: Column, j: Column, m: int) -> tuple[vec.Vec, Column]:
    """Unit vector through the middle of cell (i, j) of an m x m grid on cube face k, and the cosine to its farthest corner."""
    half = 1.0 / m
    a, b = ((2 * c + 1) * half - 1.0 for c in (i, j))
    size = F.sqrt(1.0 + a * a + b * b)
    corners = [(a + s * half, b + t * half) for s in (-1, 1) for t in (-1, 1)]
    near = F.least(*[(1.0 + a * c + b * d) / (size * F.sqrt(1.0 + c * c + d * d)) for c, d in corners])
    one = F.lit(1.0)
    turned = [F.when(k == 0, p).when(k == 1, q).otherwise(r) for p, q, r in ((one, a, a), (a, one, b), (b, b, one))]
    return tuple(c / size for c in turned), near


def max_pairwise(df: DataFrame, keys: Sequence[str], xyz: Sequence[str], m: int = 3, max_levels: int = 8, cap_pairs: int = CAP_PAIRS) -> DataFrame:
    """Largest distance between two points of a group, exact, without forming all pairs.

    The directions of space (opposites are one) are cells of a grid on three cube faces.
    A widest pair points into one of them; with c the cosine of the cell's half-angle, L the
    largest extent found so far and w the extent along the cell's middle, both its ends lie
    within w - L c of the ends of that extent: its caps.  The extents along the first cells are
    one row a group, and only points in a cap become rows (point, cell); cells are halved with only their caps
    going on, until opposite caps form no more than ``cap_pairs`` pairs and a few per point.
    Then opposite caps meet.  A round costs one job and sends its counts to the driver; caps
    lie in the shared folder.  On a sphere, the worst case, a point stays in a few cells.
    """
    keys, axes = list(keys), ["_x0", "_x1", "_x2"]
    key_names = [f"_k{i}" for i in range(len(keys))]
    pts = df.select(*[F.col(k).alias(n) for k, n in zip(keys, key_names)], *[F.col(c).cast("double").alias(a) for c, a in zip(xyz, axes)])
    grid = [(k, i, j) for k in range(3) for i in range(m) for j in range(m)]
    cell = ["_c.k", "_c.i", "_c.j"]

    def caps(rows: DataFrame, m: int, floor: DataFrame) -> DataFrame:
        """Rows in the caps of their cells, with their group's largest extent so far (``_L``)."""
        middle, near = cube_cell(*[F.col(c) for c in cell], m)
        rows = rows.withColumns({"_p": vec.dot(tuple(F.col(a) for a in axes), middle), "_near": near})
        spans = rows.groupBy(*key_names, "_c").agg(
            F.min(F.when(F.col("_low"), F.col("_p"))).alias("_lo"), F.max(F.when(F.col("_top"), F.col("_p"))).alias("_hi")
        )
        extent = spans.groupBy(*key_names).agg(F.max(F.col("_hi") - F.col("_lo")).alias("_L"))
        extent = extent.unionByName(floor).groupBy(*key_names).agg(F.max("_L").alias("_L"))
        ends = with_stats(spans, extent, key_names)
        reach = F.col("_L") * F.col("_near") * (1 - 1e-12)
        kept = with_stats(rows, ends, key_names + ["_c"]).withColumns(
            {"_top": F.col("_top") & (F.col("_p") >= F.col("_lo") + reach), "_low": F.col("_low") & (F.col("_p") <= F.col("_hi") - reach)}
        )
        return staged(kept.filter(F.col("_top") | F.col("_low")).select(*key_names, *axes, "_c", "_top", "_low", "_L"))

    # The first cells are literals: one row of extents a group, and a point is listed only under the cells whose caps it is in.
    along, width = zip(*[cube_cell(*map(F.lit, c), m) for c in grid])
    spot = [vec.dot(tuple(F.col(a) for a in axes), middle) for middle in along]
    spans = pts.groupBy(*key_names).agg(
        F.count("*").alias("n"), *[f(p).alias(f"{tag}{t}") for t, p in enumerate(spot) for f, tag in ((F.min, "_lo"), (F.max, "_hi"))]
    )
    spans = spans.withColumn("_L", F.greatest(*[F.col(f"_hi{t}") - F.col(f"_lo{t}") for t in range(len(grid))]))
    sizes = spans.select(*key_names, "n")
    reach = [F.col("_L") * near * (1 - 1e-12) for near in width]
    bounds = spans.select(
        *key_names, "_L", *[c for t, r in enumerate(reach) for c in ((F.col(f"_lo{t}") + r).alias(f"_a{t}"), (F.col(f"_hi{t}") - r).alias(f"_b{t}"))]
    )
    top, low = ([p >= F.col(f"_a{t}") for t, p in enumerate(spot)], [p <= F.col(f"_b{t}") for t, p in enumerate(spot)])
    held = top[0] | low[0]
    for flag in [*top[1:], *low[1:]]:
        held = held | flag
    listed = F.filter(
        F.array(*[
            F.struct(F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "kij")]).alias("c"), up.alias("top"), down.alias("low")) for c, up, down in zip(grid, top, low)
        ]),
        lambda s: s["top"] | s["low"],
    )
    ends = with_stats(pts, bounds, key_names).filter(held).select(*key_names, *axes, "_L", listed.alias("_s")).distinct()
    rows = staged(
        ends.withColumn("_s", F.explode("_s")).select(*key_names, *axes, F.col("_s.c").alias("_c"), F.col("_s.top").alias("_top"), F.col("_s.low").alias("_low"), "_L")
    )
    for _ in range(max_levels):
        met = rows.groupBy(*key_names, "_c").agg(F.count_if("_top").alias("_a"), F.count_if("_low").alias("_b"), F.count("*").alias("_r"))
        count = met.agg(F.sum(F.col("_a").cast("double") * F.col("_b")), F.sum("_r")).first()
        if not count[1] or count[0] <= cap_pairs + 16.0 * count[1]:
            break
        m *= 2
        halves = F.array(*[
            F.struct(F.col("_c.k").alias("k"), (2 * F.col("_c.i") + a).alias("i"), (2 * F.col("_c.j") + b).alias("j")) for a in (0, 1) for b in (0, 1)
        ])
        floor = rows.groupBy(*key_names).agg(F.max("_L").alias("_L"))
        rows = caps(rows.drop("_L").withColumn("_c", F.explode(halves)), m, floor)
    side = lambda flag, tag: rows.filter(flag).select(*[F.col(n).alias(f"{tag}{n}") for n in key_names], F.col("_c").alias(f"{tag}_c"), *[F.col(a).alias(f"{tag}{a}") for a in axes])
    top, low = side("_top", "a"), side("_low", "b")
    same = top["a_c"] == low["b_c"]
    for n in key_names:
        same = same & top[f"a{n}"].eqNullSafe(low[f"b{n}"])
    gap = vec.distance(tuple(F.col(f"a{a}") for a in axes), tuple(F.col(f"b{a}") for a in axes))
    wide = top.join(low, same).groupBy(*[F.col(f"a{n}").alias(n) for n in key_names]).agg(F.max(gap).alias("_d"))
    met = sizes.join(wide.withColumnsRenamed({n: f"r{n}" for n in key_names}), [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in key_names], "left")
    return met.select(*[F.col(n).alias(k) for n, k in zip(key_names, keys)], "n", F.coalesce("_d", F.lit(0.0)).alias("max_pair"))


def base_consistency(samples: DataFrame, keys: Sequence[str], xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mean, per-axis spread, its norm, widest pair and verdict; groups below two samples get no verdict."""
    keys, xyz = list(keys), list(xyz)
    stats = samples.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in xyz], *[(F.stddev_pop(c) * 1000.0).alias(f"std_{c}_mm") for c in xyz]
    )
    norm = F.sqrt(sum((F.col(f"std_{c}_mm") * F.col(f"std_{c}_mm") for c in xyz), F.lit(0.0)))
    verdict = F.when(F.col("n") < 2, "too few").when(F.col("std_norm_mm") <= GOOD_SPREAD_MM, "GOOD").otherwise("HIGH")
    return (
        stats.withColumn("std_norm_mm", norm)
        .join(max_pairwise(samples, keys, xyz), keys)
        .withColumn("max_pair_mm", F.col("max_pair") * 1000.0)
        .drop("max_pair")
        .withColumn("verdict", verdict)
    )


def pick_target(tracked: DataFrame, by: Sequence[str], class_name: str = "", tie: Sequence[str] = ("track_id",)) -> DataFrame:
    """Most confident stable detection inside the workspace per frame."""
    ok = tracked.filter(F.col("stable") & F.coalesce("in_workspace", F.lit(True)))
    if class_name:
        ok = ok.filter(F.col("class_name") == class_name)
    rest = [c for c in ok.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence_mean"), *[-F.col(t) for t in tie]))
    return ok.groupBy(*by).agg(best.alias("_t")).select(*by, "_t.*")


def best_of_burst(frames: DataFrame, by: Sequence[str], corners: str = "n_corners", has_pose: Column | None = None, order: str = "frame_index") -> DataFrame:
    """Frame with most corners among those with a valid pose; the earlier one on a tie."""
    ok = frames if has_pose is None else frames.filter(has_pose)
    rest = [c for c in ok.columns if c not in by]
    return ok.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(corners), -F.col(order))).alias("_f")).select(*by, "_f.*")


def latest(df: DataFrame, by: Sequence[str], value: str, mtime: str) -> DataFrame:
    """Most recent artifact; equal times go to the larger name."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(mtime, value)).alias(value), F.max(mtime).alias(mtime))
