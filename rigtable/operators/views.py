"""Multi-view work: view expansion, point splats, compositing, labelled point tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.functions import vec
from rigtable.operators.masks import disc, offsets_column, subtract_mask

# The default virtual cameras as (id, yaw, pitch) in degrees.
DEFAULT_VIEWS = (
    ("view_000", 0.0, 0.0),
    ("view_001", 15.0, 0.0),
    ("view_002", -15.0, 0.0),
    ("view_003", 0.0, 10.0),
    ("view_004", 0.0, -10.0),
)

# Initial scale, opacity and rotation of a labelled point.
POINT_SCALE_M = 0.003
POINT_OPACITY = 0.85


def to_gaussians(points: DataFrame, scale_m: float = POINT_SCALE_M, opacity: float = POINT_OPACITY) -> DataFrame:
    """Initial parameters as constant columns; positions and ids ride along."""
    log_scale = F.lit(math.log(max(scale_m, 1e-6))).cast("float")
    return points.withColumns(
        {
            "scale_log": F.array(log_scale, log_scale, log_scale),
            "quat_wxyz": F.array(*[F.lit(v).cast("float") for v in (1, 0, 0, 0)]),
            "opacity": F.lit(opacity).cast("float"),
        }
    )


def instance_manifest(points: DataFrame) -> DataFrame:
    return points.groupBy("capture_id", "instance_id", "class_id").agg(F.count("*").alias("point_count"))


def renderable(captures: DataFrame, points: DataFrame, key: str = "capture_id") -> tuple[DataFrame, DataFrame]:
    """(labelled captures that have points, the skipped rest)."""
    have = points.select(key).distinct()
    return captures.join(have, key, "left_semi"), captures.join(have, key, "left_anti")


def cap(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key (all when k <= 0); the rank filter runs before the shuffle too."""
    if k <= 0:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def views_column(views: Sequence[tuple[str, float, float]] = DEFAULT_VIEWS) -> Column:
    """Cameras with their rotation, all constants: no sine or cosine is left to be taken point by point."""

    def camera(name: str, yaw: float, pitch: float) -> Column:
        rot = vec.yaw_pitch_rot(F.lit(yaw), F.lit(pitch))
        cells = [cell.alias(f"r{i}{j}") for i, row in enumerate(rot) for j, cell in enumerate(row)]
        return F.struct(F.lit(name).alias("view_id"), F.lit(yaw).alias("yaw_deg"), F.lit(pitch).alias("pitch_deg"), *cells)

    return F.array(*[camera(*v) for v in views])


def expand_views(points: DataFrame, views: Sequence[tuple[str, float, float]] = DEFAULT_VIEWS) -> DataFrame:
    """Each point once per view, turned into that camera; a map-side generator, no join."""
    each = points.withColumn("_w", F.explode(views_column(views)))
    r = [[F.col(f"_w.r{i}{j}") for j in range(3)] for i in range(3)]
    x, y, z = vec.rotate(r, (F.col("x"), F.col("y"), F.col("z")))
    return each.select(*points.columns, "_w.view_id", "_w.yaw_deg", "_w.pitch_deg", x.alias("vx"), y.alias("vy"), z.alias("vz"))


def project_views(points: DataFrame, fx: float, fy: float, ppx: float, ppy: float) -> DataFrame:
    u, v, z = vec.project((F.col("vx"), F.col("vy"), F.col("vz")), F.lit(fx), F.lit(fy), F.lit(ppx), F.lit(ppy))
    return points.withColumns({"pu": u, "pv": v, "pz": z})


def splat(
    projected: DataFrame,
    keys: Sequence[str],
    width: int,
    height: int,
    radius: int = 1,
    payload: Sequence[str] = ("instance_id",),
    tie: str = "point_id",
) -> DataFrame:
    """Nearest point of every covered pixel.

    Centres must lie in the frame with positive depth; discs are cut at the border.
    The nearest point is a combinable min over (depth, tie).
    """
    keys = list(keys)
    centred = projected.withColumns({"_u": F.rint("pu").cast("int"), "_v": F.rint("pv").cast("int")}).filter(
        F.col("_u").between(0, width - 1) & F.col("_v").between(0, height - 1) & (F.col("pz") > 0)
    )
    spread = (
        centred.withColumn("_o", F.explode(offsets_column(disc(max(1, radius)))))
        .withColumns({"u": F.col("_u") + F.col("_o.du"), "v": F.col("_v") + F.col("_o.dv")})
        .filter(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    )
    near = F.min(F.struct("pz", tie, *payload)).alias("_near")
    return spread.groupBy(*keys, "u", "v").agg(near).select(
        *keys, "u", "v", F.col("_near.pz").alias("z"), *[F.col(f"_near.{p}").alias(p) for p in payload]
    )


def composite(
    background: DataFrame,
    objects: DataFrame,
    occluder: DataFrame | None,
    keys: Sequence[str],
    colors: Sequence[str] = ("r", "g", "b"),
    pixel: Sequence[str] | None = None,
) -> DataFrame:
    """Object pixels over the background except below the occluder; keys include u and v.

    ``pixel`` are the columns the occluder shares; one native mask may serve all views.
    """
    keys = list(keys)
    front = objects if occluder is None else subtract_mask(objects, occluder, pixel or keys)
    over = front.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in colors], F.lit(True).alias("_hit"))
    return background.join(over, keys, "left").select(
        *keys,
        *[F.when(F.col("_hit"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in colors],
        F.coalesce("_hit", F.lit(False)).alias("pasted"),
    )


def visible_views(
    instances: DataFrame, occluder: DataFrame | None, view: Sequence[str], pixel: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(instance pixels left after the occluder, views that keep none).

    ``pixel`` are the columns the occluder shares; one native mask may serve all views.
    """
    view = list(view)
    left = instances if occluder is None else subtract_mask(instances, occluder, pixel or (view + ["u", "v"]))
    return left, pixels_left(instances, occluder, view, pixel).filter("n_left = 0").select(*view)


def pixels_left(
    instances: DataFrame, occluder: DataFrame | None, view: Sequence[str], pixel: Sequence[str] | None = None
) -> DataFrame:
    """Every view with ``n_left``, its different instance pixels not under the occluder; see ``visible_views``.

    Blocks of 8 x 8 pixels are one word of bits, united map-side, so that blocks meet instead of pixels.
    """
    view, shared = list(view), [c for c in (pixel or view) if c not in ("u", "v")]
    drawn = _block_bits(instances, view)
    if occluder is not None:
        drawn = drawn.join(_block_bits(occluder, shared).withColumnRenamed("_bits", "_under"), shared + ["_ty", "_tx"], "left")
        drawn = drawn.withColumn("_bits", F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce("_under", F.lit(0).cast("bigint")))))
    return drawn.groupBy(*view).agg(F.coalesce(F.sum(F.bit_count("_bits").cast("bigint")), F.lit(0).cast("bigint")).alias("n_left"))


def _block_bits(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pixels of blocks (``_ty``, ``_tx``) of 8 lines and 8 columns as bits of one word."""
    block = lambda c: F.floor(F.col(c) / 8)
    bit = F.expr("shiftleft(1L, cast(pmod(v, 8) * 8 + pmod(u, 8) AS INT))")
    return pixels.groupBy(*keys, block("v").alias("_ty"), block("u").alias("_tx")).agg(F.bit_or(bit).alias("_bits"))


def resize_image(pixels: DataFrame, keys: Sequence[str], from_size: tuple[int, int], to_size: tuple[int, int], channels=("r", "g", "b")) -> DataFrame:
    """Area average onto a smaller grid: each target cell weighs source pixels by overlap."""
    keys = list(keys)
    if from_size == to_size:
        return pixels
    (sw, sh), (dw, dh) = from_size, to_size

    def cells(pos: Column, s: int, d: int) -> Column:
        lo, hi = pos * d / s, (pos + 1) * d / s
        last = F.greatest(F.ceil(hi) - 1, F.floor(lo))
        return F.transform(
            F.sequence(F.floor(lo), F.least(last, F.lit(d - 1))),
            lambda c: F.struct(c.cast("int").alias("at"), (F.least(hi, c + 1) - F.greatest(lo, c)).alias("w")),
        )

    spread = pixels.withColumn("_cu", F.explode(cells(F.col("u"), sw, dw))).withColumn("_cv", F.explode(cells(F.col("v"), sh, dh)))
    weight = F.col("_cu.w") * F.col("_cv.w")
    return (
        spread.withColumn("_wt", weight)
        .groupBy(*keys, F.col("_cu.at").alias("u"), F.col("_cv.at").alias("v"))
        .agg(*[(F.sum(F.col(c) * F.col("_wt")) / F.sum("_wt")).alias(c) for c in channels])
    )
