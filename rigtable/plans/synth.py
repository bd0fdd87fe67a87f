"""Labelled points to rendered views, composites and review documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.operators.labels import only_new, resolve_background
from rigtable.operators.masks import close_mask, mask_to_polygons
from rigtable.operators.views import DEFAULT_VIEWS, composite, expand_views, project_views, splat, visible_views
from rigtable.session import settle


def render_views(
    points: DataFrame,
    intrinsics: tuple[float, float, float, float],
    width: int,
    height: int,
    radius: int = 1,
    views: Sequence = DEFAULT_VIEWS,
    payload: Sequence[str] = ("instance_id", "r", "g", "b"),
) -> tuple[DataFrame, DataFrame]:
    """(nearest-point pixels of every capture and view, one meta row per view).

    The points of a capture meet before views and discs multiply them, so that only points are shuffled.
    """
    projected = project_views(expand_views(points.repartition("capture_id"), views), *intrinsics)
    pixels = splat(projected, ["capture_id", "view_id"], width, height, radius, payload)
    table = F.explode(
        F.array(*[F.struct(F.lit(n).alias("view_id"), F.lit(y).alias("yaw_deg"), F.lit(p).alias("pitch_deg")) for n, y, p in views])
    )
    meta = points.select("capture_id").distinct().select("capture_id", table.alias("_v")).select(
        "capture_id", "_v.*", F.lit("points").alias("backend"), F.lit(width).alias("width"), F.lit(height).alias("height")
    )
    return pixels, meta


def composite_views(
    rendered: DataFrame,
    captures: DataFrame,
    backgrounds: DataFrame,
    occluder: DataFrame | None,
    override: str = "",
    self_background: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(composited pixels, visible instance pixels, views dropped or skipped with a reason).

    ``backgrounds`` are pixels per ``background_id``; ``occluder`` native mask pixels per capture.
    """
    ids = backgrounds.select(F.col("background_id").alias("capture_id")).distinct()
    chosen = resolve_background(captures.select("capture_id").distinct(), ids, override, self_background)
    usable = chosen.join(backgrounds.select("background_id").distinct(), "background_id", "left_semi")
    view = ["capture_id", "view_id"]
    inside = rendered.join(usable.select("capture_id", "background_id", "source"), "capture_id")
    left, dropped = visible_views(inside, occluder, view, ["capture_id", "u", "v"])
    kept = left.select(*view, "background_id", "source").distinct()
    base = kept.join(backgrounds, "background_id").select(*view, "background_id", "source", "u", "v", "r", "g", "b")
    image = composite(base, left, None, view + ["u", "v"])
    lost = dropped.withColumn("reason", F.lit("no visible object")).unionByName(
        rendered.select(*view).distinct().join(usable.select("capture_id"), "capture_id", "left_anti").withColumn("reason", F.lit("no background"))
    )
    return image, left.drop("background_id", "source"), lost


def export_review(
    instances: DataFrame,
    classes: DataFrame,
    existing: DataFrame,
    width: int,
    height: int,
    min_area: float = 50.0,
    kernel: int = 5,
    epsilon_ratio: float = 0.005,
    overwrite: bool = False,
    view: Sequence[str] = ("capture_id", "view_id"),
) -> tuple[DataFrame, DataFrame]:
    """(review shapes of new views, status per view: exported, kept or skipped).

    ``classes`` maps (capture_id, instance_id) to a label; existing reviews stay untouched
    unless overwriting.
    """
    view = list(view)
    instances = settle(instances)  # rendered once, read several times below
    fresh = only_new(instances, existing, view, overwrite)
    named = fresh.join(classes.select("capture_id", "instance_id", "label"), ["capture_id", "instance_id"])
    closed = close_mask(named, view + ["instance_id", "label"], kernel, width, height)
    polygons = mask_to_polygons(closed, view + ["instance_id", "label"], min_area, epsilon_ratio)
    shapes = polygons.select(*view, "label", "points", F.col("instance_id").alias("group_id"), F.lit("polygon").alias("shape_type"), "part")
    counts = shapes.groupBy(*view).agg(F.count("*").alias("shapes"))
    done = fresh.select(*view).distinct().withColumn("_new", F.lit(True))
    status = (
        instances.select(*view).distinct().join(done, view, "left").join(counts, view, "left")
        .select(
            *view,
            F.when(F.col("_new").isNull(), "kept").when(F.col("shapes").isNull(), "skipped").otherwise("exported").alias("status"),
            F.coalesce("shapes", F.lit(0)).alias("shapes"),
        )
    )
    return shapes, status
