"""Label quality checks over converted (normalised) polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.operators.masks import mask_overlap, polygon_overlap, raster_areas, rasterize

# The report's default thresholds.
CANVAS = 512
DUPLICATE_IOU = 0.7
DUPLICATE_CONT = 0.8
CROSS_IOU = 0.15
CROSS_CONT = 0.6
EMPTY_AREA = 9
COORD_SLACK = 0.01


def defect(poly: Column | str = "poly") -> Column:
    """Why a polygon is degenerate, or null."""
    poly = F.col(poly) if isinstance(poly, str) else poly
    n = F.size(poly)
    low, high = -COORD_SLACK, 1 + COORD_SLACK
    out = F.exists(poly, lambda p: (p["x"] < low) | (p["x"] > high) | (p["y"] < low) | (p["y"] > high))
    return F.when(n < 3, F.concat(F.lit("poly<3pts("), n.cast("string"), F.lit(")"))).when(out, "coords_out_of_[0,1]")


def degenerate(labels: DataFrame) -> DataFrame:
    return labels.withColumn("why", defect()).filter(F.col("why").isNotNull())


def _on_canvas(labels: DataFrame, canvas: int, carry: Sequence[str] = ()) -> DataFrame:
    pts = F.transform("poly", lambda p: F.array(p["x"] * canvas, p["y"] * canvas))
    return labels.select("split", "stem", "line_no", "class_id", *carry, pts.alias("pts"))


def label_runs(labels: DataFrame, canvas: int = CANVAS) -> DataFrame:
    """Rasterised labels on the canvas; needs ``split, stem, line_no, class_id, poly``."""
    return rasterize(_on_canvas(labels, canvas), "pts", canvas, canvas)


def near_empty(labels: DataFrame, canvas: int = CANVAS, limit: int = EMPTY_AREA) -> DataFrame:
    """Polygons of three points or more whose raster area stays below the limit (zero included); rows of one line count together."""
    keys = ["split", "stem", "line_no"]
    sized = raster_areas(_on_canvas(labels.filter(F.size("poly") >= 3), canvas), "pts", canvas, canvas)
    return sized.withColumn("area", F.sum("area").over(Window.partitionBy(*keys))).filter(F.col("area") < limit)


def _overlap_check() -> Column:
    """What is wrong with a pair that carries ``class_id``, or null."""
    same = F.col("class_id_i") == F.col("class_id_j")
    return F.when(same & ((F.col("iou") >= DUPLICATE_IOU) | (F.col("cont") >= DUPLICATE_CONT)), "duplicate").when(
        ~same & ((F.col("iou") >= CROSS_IOU) | (F.col("cont") >= CROSS_CONT)), "cross"
    )


def _with_check(pairs: DataFrame) -> DataFrame:
    found = pairs.withColumn("check", _overlap_check()).filter(F.col("check").isNotNull())
    return found.withColumnsRenamed({f"class_id_{i}": f"class_{i}" for i in "ij"})


def overlap_issues(runs: DataFrame) -> DataFrame:
    """Same-class duplicates and cross-class overlaps with their ``check`` name; runs carry ``class_id``."""
    return _with_check(mask_overlap(runs, ["split", "stem"], "line_no", carry=["class_id"]))


def label_issues(labels: DataFrame, canvas: int = CANVAS) -> DataFrame:
    """``overlap_issues`` of the rasterised labels, which meet as polygons."""
    pairs = polygon_overlap(_on_canvas(labels, canvas), "pts", canvas, canvas, ["split", "stem"], "line_no", ["class_id"], where=_overlap_check().isNotNull())
    return _with_check(pairs)


def split_leakage(labels: DataFrame, key: str = "stem", split: str = "split") -> DataFrame:
    """Keys present in more than one split."""
    return (
        labels.select(key, split).distinct().groupBy(key).agg(F.count("*").alias("n_splits")).filter("n_splits > 1")
    )


def qc_report(labels: DataFrame, canvas: int = CANVAS) -> DataFrame:
    """Issues per split and check plus the overall verdict row (split null).

    Overlaps, small and degenerate labels come from one pass over the labels of an image.
    """
    marked = _on_canvas(labels.withColumns({"_bad": defect().isNotNull(), "_full": F.size("poly") >= 3}), canvas, ["_bad", "_full"])
    small = F.col("_full_i") & (F.col("area_i") < EMPTY_AREA)
    single = F.when(F.col("_bad_i"), "degenerate"), F.when(small, "near_empty")
    checks = F.array_compact(F.when(F.col("j").isNull(), F.array(*single)).otherwise(F.array(_overlap_check())))
    met = polygon_overlap(marked, "pts", canvas, canvas, ["split", "stem"], "line_no", ["class_id", "_bad", "_full"], alone=True, where=F.size(checks) > 0)
    found = met.select("split", F.explode(checks).alias("check")).unionByName(
        split_leakage(labels).select(F.lit("all").alias("split"), F.lit("leakage").alias("check"))
    )
    counts = found.groupBy("split", "check").agg(F.count("*").alias("n"))
    verdict = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(None).cast("string").alias("split"),
        F.when(F.col("n") == 0, "CLEAN").otherwise("ISSUES").alias("check"),
        "n",
    )
    return counts.unionByName(verdict)


def top_offenders(issues: DataFrame, n: int = 25, by: Sequence[str] = ("split", "check")) -> DataFrame:
    """Worst pairs of each check: by IoU, cross-class ones by the larger of IoU and containment.

    The rank filter is pushed below the shuffle, so only n rows per task leave a group.
    """
    weight = F.when(F.col("check") == "cross", F.greatest("iou", "cont")).otherwise(F.col("iou"))
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "stem", "i", "j")
    return issues.withColumn("weight", weight).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
