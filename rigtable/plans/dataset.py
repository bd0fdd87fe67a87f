"""Annotation pools to a converted dataset, and the consistency check behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.operators.labels import clean_label, compose_pools, normalize_polygon, reconcile, split_dataset, valid_shape


def label_lines(shapes: DataFrame, classes: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Label line per usable shape of a registered class."""
    names = classes.select(F.col("name").alias("label"), "class_id")
    good = shapes.filter(valid_shape()).withColumn("label", clean_label(F.col("label")))
    return good.join(names, "label").select(
        *keys, order, "class_id",
        F.concat_ws(" ", F.col("class_id").cast("string"), normalize_polygon("points", "width", "height")).alias("line"),
    )


def convert(
    real: DataFrame,
    synthetic: dict[str, DataFrame],
    shapes: DataFrame,
    classes: DataFrame,
    mode: str = "real",
    ratio: float = 0.2,
    seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """``split, stem, line_no, line`` for every image; a null line stands for an empty label file.

    ``shapes`` carries ``origin`` next to ``stem`` so that pools stay apart; synthetic
    images all train.
    """
    pools = compose_pools(real, synthetic, mode)
    split = split_dataset(real, shapes.filter("origin = 'real'"), ratio, seed, order=order).withColumnRenamed("split", "_split")
    images = (
        pools.join(split.withColumn("origin", F.lit("real")), ["stem", "origin"], "left")
        .select("origin", "stem", "out_stem", F.coalesce("_split", F.lit("train")).alias("split"))
    )
    lines = label_lines(shapes, classes, ["origin", "stem"])
    return images.join(lines, ["origin", "stem"], "left").select("split", F.col("out_stem").alias("stem"), "line_no", "class_id", "line")


def conversion_delta(shapes: DataFrame, lines: DataFrame) -> DataFrame:
    """Images whose converted instance count differs from their valid shapes."""
    return reconcile(shapes.filter(valid_shape()).select("stem"), lines.filter("line IS NOT NULL").select("stem"), ["stem"]).filter("delta <> 0")
