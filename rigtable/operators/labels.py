"""Annotation tables: validity, pairing, reconciliation, promotion, pools and splits.

``images`` rows are one per picture, ``shapes`` rows one per polygon with columns
``label, shape_type, points`` and the image key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.functions.text import clean_label, fixed6, tagged_stem
from rigtable.scale import running
from rigtable.session import settle

OCCLUDER_PREFIX = "_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- predicates -----------------------------------------------------------------


def n_points(points: Column | str = "points") -> Column:
    return F.coalesce(F.when(_col(points).isNotNull(), F.size(_col(points))), F.lit(0))


def valid_shape(label="label", shape_type="shape_type", points="points") -> Column:
    """A usable polygon: right type, a label after trimming, three points or more."""
    return (
        F.coalesce(_col(shape_type) == "polygon", F.lit(False))
        & (clean_label(_col(label)) != "")
        & (n_points(points) >= 3)
    )


def skipped_shape(label="label", shape_type="shape_type", points="points") -> Column:
    """Not usable, yet not blank either."""
    return ~valid_shape(label, shape_type, points) & ((clean_label(_col(label)) != "") | (n_points(points) > 0))


def is_occluder(label="label") -> Column:
    return clean_label(_col(label)).startswith(OCCLUDER_PREFIX)


def split_occluders(shapes: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    return shapes.filter(~is_occluder(label)), shapes.filter(is_occluder(label))


def normalize_polygon(points: Column | str, width: Column | str, height: Column | str) -> Column:
    """``x y x y ...`` text: divided by the image size, clamped to [0, 1], six digits."""
    def unit(v: Column, size: Column) -> Column:
        return fixed6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)))

    w, h = _col(width), _col(height)
    return F.array_join(F.transform(_col(points), lambda p: F.concat_ws(" ", unit(p[0], w), unit(p[1], h))), " ")


def size_known(width="width", height="height") -> Column:
    return (F.coalesce(_col(width), F.lit(0)) > 0) & (F.coalesce(_col(height), F.lit(0)) > 0)


def require_size(df: DataFrame, width="width", height="height", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with a positive size, rejected rows with a reason); strict raises instead."""
    ok = size_known(width, height)
    if strict:
        checked = F.when(ok, _col(width)).otherwise(F.raise_error("image width and height must be positive"))
        return df.withColumn(width, checked), df.limit(0).withColumn("reason", F.lit(""))
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.lit("invalid image size"))


def check_labels(
    shapes: DataFrame, classes: DataFrame, mode: str = "strict", label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """(shapes of known classes, unknown labels with counts); strict raises on any unknown label."""
    named = shapes.withColumn(label, clean_label(F.col(label)))
    known = classes.select(F.col("name").alias(label)).distinct()
    unknown = (
        named.filter(F.col(label) != "").join(known, label, "left_anti").groupBy(label).agg(F.count("*").alias("n"))
    )
    if mode == "strict":
        rejects = settle(unknown)
        n, first = rejects.agg(F.count("*"), F.min(label)).first()
        if n:
            raise ValueError(f"{n} labels are missing from the class registry, the first is {first!r}; mode 'warn' returns them all")
    return named.join(known, label, "left_semi"), unknown


def filter_detections(df: DataFrame, min_score: float = 0.0, class_name: str | None = None, score="score", cls="class") -> DataFrame:
    kept = df.filter(F.coalesce(F.col(score), F.lit(1.0)) >= min_score)
    return kept.filter(F.col(cls) == class_name) if class_name else kept


def scope_captures(df: DataFrame, key: str = "capture_id", exact: str = "", prefix: str = "") -> DataFrame:
    """One id, or all ids under a prefix; empty options leave the table as it is."""
    if exact:
        df = df.filter(F.col(key) == exact)
    return df.filter(F.col(key).startswith(prefix)) if prefix else df


# --- pairing and comparison -----------------------------------------------------


def pair_images(images: DataFrame, labels: DataFrame, keys: Sequence[str] = ("pool", "stem")) -> DataFrame:
    """Every key of either side with its pairing status."""
    keys = list(keys)
    left = images.select(*keys).distinct().withColumn("_i", F.lit(True))
    right = labels.select(*keys).distinct().withColumn("_l", F.lit(True))
    status = (
        F.when(F.col("_i").isNull(), "label without image").when(F.col("_l").isNull(), "image without label").otherwise("paired")
    )
    return left.join(right, keys, "full_outer").select(*keys, status.alias("status"))


def coverage(a: DataFrame, b: DataFrame, key: str = "stem") -> DataFrame:
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left only").when(F.col("_a").isNull(), "right only").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key on both sides and the difference b - a."""
    keys = list(keys)
    left = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    return left.join(right, keys, "full_outer").select(
        *keys, n_a.alias("n_a"), n_b.alias("n_b"), (n_b - n_a).alias("delta")
    )


def attach_class(df: DataFrame, classes: DataFrame, class_id: str = "class_id", out: str = "class_name") -> DataFrame:
    """Registry name of an id; ids outside the registry read ``id_<n>``."""
    names = classes.select(F.col("class_id").alias(class_id), F.col("name").alias("_name"))
    fallback = F.concat(F.lit("id_"), F.col(class_id).cast("string"))
    return df.join(names, class_id, "left").withColumn(out, F.coalesce("_name", fallback)).drop("_name")


def class_option(df: DataFrame, options: DataFrame, default: Column, cls: str = "class_name", out: str = "option") -> DataFrame:
    """Option declared for the class (case-insensitive), else the default."""
    table = options.select(F.lower("class_name").alias("_c"), F.col("option").alias("_opt"))
    return (
        df.withColumn("_c", F.lower(F.col(cls)))
        .join(table, "_c", "left")
        .withColumn(out, F.coalesce("_opt", default))
        .drop("_c", "_opt")
    )


def resolve_background(
    captures: DataFrame, backgrounds: DataFrame, override: str = "", self_background: bool = False
) -> DataFrame:
    """Background of each capture: forced one, own dedicated one, itself, or missing."""
    if override:
        forced = captures.withColumn("background_id", F.lit(override))
        return forced.withColumn("source", F.lit("override"))
    own = backgrounds.select("capture_id").distinct().withColumn("_own", F.lit(True))
    fallback = F.col("capture_id") if self_background else F.lit(None)
    return (
        captures.join(own, "capture_id", "left")
        .withColumn("background_id", F.when(F.col("_own"), F.col("capture_id")).otherwise(fallback))
        .withColumn(
            "source",
            F.when(F.col("_own"), "dedicated").when(F.col("background_id").isNotNull(), "self").otherwise("missing"),
        )
        .drop("_own")
    )


def pending_background(captures: DataFrame, backgrounds: DataFrame, key: str = "capture_id", by: Sequence[str] = ()) -> DataFrame:
    """Lowest capture still without a background (new objects wait for it), and how many there are."""
    bare = captures.join(backgrounds.select(key).distinct(), key, "left_anti")
    return bare.groupBy(*by).agg(F.min(key).alias("pending_id"), F.count("*").alias("n_pending"))


def only_new(source: DataFrame, target: DataFrame, keys: Sequence[str], overwrite: bool = False, labeled: DataFrame | None = None) -> DataFrame:
    """Source rows whose key is neither staged nor labeled yet."""
    if overwrite:
        return source
    keys = list(keys)
    fresh = source.join(target.select(*keys).distinct(), keys, "left_anti")
    return fresh if labeled is None else fresh.join(labeled.select(*keys).distinct(), keys, "left_anti")


def promote(
    review: DataFrame,
    pool: DataFrame,
    captures: DataFrame | None = None,
    key: str = "stem",
    content: Sequence[str] = ("content",),
    overwrite: bool = False,
    scope: str = "",
    scope_mode: str = "prefix",
) -> DataFrame:
    """Merge plan of reviewed labels into a pool, with the content that wins per key.

    ``action`` is promoted, updated, same, kept, missing (no capture) or pool (no review).
    """
    inside = review
    if scope:
        inside = review.filter(F.col(key) == scope if scope_mode == "exact" else F.col(key).startswith(scope))
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in content])), 256)
    new = inside.select(key, digest.alias("_new"), F.struct(*content).alias("_new_row"))
    old = pool.select(key, digest.alias("_old"), F.struct(*content).alias("_old_row"))
    joined = new.join(old, key, "full_outer")
    has_capture = F.lit(True)
    if captures is not None:
        joined = joined.join(captures.select(key).distinct().withColumn("_cap", F.lit(True)), key, "left")
        has_capture = F.col("_cap").isNotNull()
    action = (
        F.when(F.col("_new").isNull(), "pool")
        .when(~has_capture, "missing")
        .when(F.col("_old").isNull(), "promoted")
        .when(F.col("_old") == F.col("_new"), "same")
        .otherwise("updated" if overwrite else "kept")
    )
    takes_new = F.col("action").isin("promoted", "updated")
    return (
        joined.withColumn("action", action)
        .withColumn("_row", F.when(takes_new, F.col("_new_row")).otherwise(F.col("_old_row")))
        .select(key, "action", "_row.*")
    )


def repair_paths(rows: DataFrame, files: DataFrame, path: str = "path", by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Stored path where the file exists, else the file of the same name in the session folder."""
    by = list(by)
    base = F.element_at(F.split(F.col(path), "/"), -1)
    exact = files.select(F.col("path").alias(path)).distinct().withColumn("_there", F.lit(True))
    local = (
        files.groupBy(*by, F.element_at(F.split("path", "/"), -1).alias("_base")).agg(F.min("path").alias("_local"))
    )
    return (
        rows.withColumn("_base", base)
        .join(exact, path, "left")
        .join(local, by + ["_base"], "left")
        .withColumn("resolved", F.when(F.col("_there"), F.col(path)).otherwise(F.col("_local")))
        .drop("_base", "_there", "_local")
    )


# --- counting -------------------------------------------------------------------


def instance_counts(shapes: DataFrame, image: str = "stem", label: str = "label", split: str | None = None) -> DataFrame:
    """Valid instances per image, per class, (per split) and in total, in one pass.

    ``level`` names the grouping; columns not part of it are null.
    """
    good = shapes.filter(valid_shape(label)).withColumn(label, clean_label(F.col(label)))
    dims = [image, label] + ([split] if split else [])
    sets = [[image, label], [image], [label], []] + ([[split], [split, label]] if split else [])
    combos = [[F.col(c) for c in s] for s in sets]
    level = F.lit("total")
    for name in dims:
        level = F.when(F.grouping(name) == 0, F.concat_ws("+", F.when(level != "total", level), F.lit(name))).otherwise(level)
    return good.groupingSets(combos, *[F.col(d) for d in dims]).agg(level.alias("level"), F.count("*").alias("n"))


def size_frequency(images: DataFrame) -> DataFrame:
    return (
        images.filter(size_known())
        .groupBy("width", "height")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "width", "height")
    )


def shape_types(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy(F.coalesce("shape_type", F.lit("?")).alias("shape_type")).agg(
        F.count("*").alias("n"), F.count_if(skipped_shape()).alias("n_skipped")
    )


def instances_per_image(images: DataFrame, shapes: DataFrame, key: str = "stem") -> DataFrame:
    counts = shapes.filter(valid_shape()).groupBy(key).agg(F.count("*").alias("n"))
    return images.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def per_image_stats(images: DataFrame, shapes: DataFrame, key: str = "stem") -> DataFrame:
    return instances_per_image(images, shapes, key).agg(
        F.count_if(F.col("n") == 0).alias("n_empty"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.avg("n").alias("mean_n"),
    )


def per_image_histogram(images: DataFrame, shapes: DataFrame, key: str = "stem") -> DataFrame:
    return instances_per_image(images, shapes, key).groupBy("n").agg(F.count("*").alias("images")).orderBy("n")


def class_combos(images: DataFrame, shapes: DataFrame, key: str = "stem") -> DataFrame:
    """Sorted distinct classes of each image (empty images too), and how often each set occurs."""
    pairs = shapes.filter(valid_shape()).select(key, clean_label(F.col("label")).alias("label")).distinct()
    sets = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("classes"))
    return (
        images.select(key)
        .join(sets, key, "left")
        .groupBy(F.coalesce("classes", F.lit("")).alias("classes"))
        .agg(F.count("*").alias("images"))
    )


def discover_classes(shapes: DataFrame, label: str = "label") -> DataFrame:
    name = clean_label(F.col(label))
    return shapes.select(name.alias("name")).filter(F.col("name") != "").distinct().orderBy("name")


def dedup_stem(df: DataFrame, keys: Sequence[str] = ("pool", "stem"), path: str = "path") -> DataFrame:
    """Flags the first path of each stem; the others are the reported duplicates."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(F.min(path).alias("_first"))
    return df.join(first, keys).withColumn("kept", F.col(path) == F.col("_first")).drop("_first")


def job_summary(status: DataFrame, status_col: str = "status", shapes_col: str | None = None) -> DataFrame:
    total = [F.sum(shapes_col).alias("shapes")] if shapes_col else []
    return status.groupBy(status_col).agg(F.count("*").alias("n"), *total)


def number_instances(shapes: DataFrame, key: str = "stem", order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Instance ids 1..n of the liftable shapes of each image, in label order.

    Ids are counts within (image, block of lines) plus the earlier blocks, so one
    image with very many shapes is still spread.
    """
    bucket = F.floor(F.col(order[0]) / 10_000)
    numbered = running(shapes, [key], bucket, [F.col(c) for c in order], {"instance_id": ("count", F.lit(1))})
    return numbered.withColumn("instance_id", F.col("instance_id").cast("int"))


def next_capture_no(captures: DataFrame, number: Column, by: Sequence[str] = ()) -> DataFrame:
    return captures.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def preview(df: DataFrame, order: Sequence[Column], n: int = 8) -> DataFrame:
    """First n rows with the number left out in ``more``."""
    total = df.agg(F.count("*").alias("_t"))
    # ``total`` is a single row by construction.
    top = df.orderBy(*order).limit(n)
    return top.join(total).withColumn("more", F.greatest(F.col("_t") - n, F.lit(0))).drop("_t")


# --- pools and splits -----------------------------------------------------------

# Which synthetic pools each composition includes.
COMPOSITIONS = {"real": (), "point": ("point",), "3dgs": ("3dgs",), "all": ("point", "3dgs")}


def compose_pools(real: DataFrame, synthetic: dict[str, DataFrame], mode: str, stem: str = "stem") -> DataFrame:
    """Real pool plus the chosen synthetic pools, whose stems carry their tag."""
    out = real.withColumn("out_stem", F.col(stem)).withColumn("origin", F.lit("real"))
    for tag in COMPOSITIONS[mode]:
        if tag in synthetic:
            part = synthetic[tag].withColumn("out_stem", tagged_stem(F.col(stem), tag)).withColumn("origin", F.lit(tag))
            out = out.unionByName(part)
    return out


def set_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of a column tagged as common, left only or right only."""
    left, right = a.select(column), b.select(column)
    return (
        left.intersect(right).withColumn("side", F.lit("common"))
        .unionByName(left.subtract(right).withColumn("side", F.lit("left only")))
        .unionByName(right.subtract(left).withColumn("side", F.lit("right only")))
    )


def shuffle_key(stem: Column, seed: int) -> Column:
    return F.xxhash64(stem, F.lit(seed))


def split_dataset(
    images: DataFrame, shapes: DataFrame, ratio: float = 0.2, seed: int = 42, key: str = "stem",
    order: Column | None = None, blocks: int = 4096,
) -> DataFrame:
    """``split`` per real image: the first max(1, round(n * ratio)) in hash order validate.

    Classes absent from validation each pull their first training image, in one plan.  The cut is
    found from block counts of the hash, so no task ranks the whole pool.
    """
    rank_key = shuffle_key(F.col(key), seed) if order is None else order
    block = F.pmod(F.shiftright(rank_key, 40), F.lit(blocks))
    # order by (block, hash, key): still a seeded shuffle, and blocks are counted first
    keyed = settle(images.select(key).distinct().select(key, rank_key.alias("_h")).withColumn("_blk", block))
    counts = keyed.groupBy("_blk").agg(F.count("*").alias("c"))
    ordered = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # at most ``blocks`` rows
    starts = counts.withColumn("_before", F.coalesce(F.sum("c").over(ordered), F.lit(0)))
    total = F.sum("c").over(Window.partitionBy())
    size = F.greatest(F.lit(1), F.rint(F.col("_n") * ratio).cast("long"))
    starts = starts.withColumn("_n", total).withColumn("_v", F.when(F.col("_n") > 1, F.least(size, F.col("_n") - 1)).otherwise(size))
    placed = (
        keyed.join(F.broadcast(starts.select("_blk", "_before", "_v")), "_blk")
        .withColumn("_i", F.row_number().over(Window.partitionBy("_blk").orderBy("_h", key)) + F.col("_before"))
        .withColumn("split", F.when(F.col("_i") <= F.col("_v"), "val").otherwise("train"))
    )
    placed = settle(placed.select(key, "_i", "split"))
    labels = shapes.select(key, clean_label(F.col("label")).alias("label")).filter(F.col("label") != "")
    seen = labels.join(placed, key)
    in_val = F.max((F.col("split") == "val").cast("int"))
    missing = seen.groupBy("label").agg(in_val.alias("_in")).filter("_in = 0").select("label", F.count("*").over(Window.partitionBy()).alias("_k"))
    pulled = class_pulls(seen.filter(F.col("split") == "train").select("label", "_i", key), missing, key)
    moved = placed.join(pulled.withColumn("_pulled", F.lit(True)), key, "left")
    return moved.select(key, F.when(F.col("_pulled"), "val").otherwise(F.col("split")).alias("split"))


def class_pulls(seen: DataFrame, missing: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Images (``key``) that classes pull: in order of ``label``, each takes its first image by ``_i`` that none has taken.

    ``missing`` has a row (label, _k) a class, _k their number.  The classes before take fewer than _k images, so the first
    _k of each class decide; they are found inside buckets of positions first, so no task ranks a class.  What remains is a
    square of the number of classes, folded in one expression.
    """
    kind = seen.schema[key].dataType.simpleString()
    near = seen.join(missing, "label").distinct().withColumn("_b", F.pmod("_i", F.lit(buckets)))
    for by in (("label", "_b"), ("label",)):
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_i", key))).filter("_r <= _k")
    per_class = near.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", key))), lambda c: c[key]).alias("c"))
    turns = F.sort_array(F.collect_list(F.struct("label", "c")))
    free = lambda taken, turn: F.slice(F.filter(turn["c"], lambda c: ~F.array_contains(taken, c)), 1, 1)
    taken = F.aggregate(turns, F.array().cast(f"array<{kind}>"), lambda taken, turn: F.concat(taken, free(taken, turn)))
    return per_class.agg(taken.alias("_t")).select(F.explode("_t").alias(key))
