"""Captures and polygons to labelled 3D points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.operators.geometry import backproject, lift_report, valid_depth
from rigtable.operators.labels import is_occluder, number_instances, valid_shape
from rigtable.operators.masks import rasterize, run_pixels


def lift_captures(
    pixels: DataFrame,
    shapes: DataFrame,
    classes: DataFrame,
    intrinsics: Sequence[Column | float],
    size: tuple[Column | int, Column | int],
    low: float = 0.1,
    high: float = 1.0,
    order: Sequence[str] = ("line_no",),
    key: str = "capture_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points per instance with colours, mask pixels per instance, unknown labels).

    Occluders and unknown labels never get an instance id.
    """
    good = shapes.filter(valid_shape() & ~is_occluder())
    names = classes.select(F.col("name").alias("label"), "class_id")
    unknown = good.join(names, "label", "left_anti").groupBy(key, "label").agg(F.count("*").alias("n"))
    known = number_instances(good.join(names, "label"), key, order)
    runs = rasterize(known.select(key, "instance_id", "class_id", "points"), "points", *size, truncate=True)
    mask = run_pixels(runs)
    seen = mask.join(pixels, [key, "u", "v"])
    points = backproject(seen.filter(valid_depth("depth_m", low, high)), *intrinsics)
    return points, mask, unknown


def capture_report(points: DataFrame, mask: DataFrame, key: str = "capture_id") -> DataFrame:
    return lift_report(points, mask, [key, "instance_id", "class_id"])
