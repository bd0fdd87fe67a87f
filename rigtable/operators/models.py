"""Scoring hook, record post-processing, evaluation and ranking of segmentation models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.operators.masks import (
    RunTable, by_group, dedup_masks, flat_lines, flat_points, group_starts, mask_overlap, named, nested_points, places, rasterize, whole_groups,
)
from rigtable.session import staged

DETECTION_LIST = "ARRAY<STRUCT<class: STRING, score: DOUBLE, bbox: ARRAY<DOUBLE>, polygon: ARRAY<ARRAY<DOUBLE>>>>"


def score_images(
    images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], Iterable[list[dict]]]], keep: Sequence[str] = ("image", "width", "height")
) -> DataFrame:
    """Run a predictor over image rows in Arrow batches; ``load`` runs once per task.

    The predictor gets a pandas frame and returns one list of detections per row.
    """
    fields = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in keep) + f", detections {DETECTION_LIST}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield batch[list(keep)].assign(detections=list(predict(batch)))

    return images.mapInPandas(run, schema)


def tidy_records(records: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Detections of three points or more and known class, rounded to the record format."""
    two = lambda v: F.round(v, 2)
    shaped = F.transform(
        F.filter("detections", lambda d: F.size(d["polygon"]) >= 3),
        lambda d: F.struct(
            d["class"].alias("class"),
            F.round(d["score"], 4).alias("score"),
            F.transform(d["bbox"], two).alias("bbox"),
            F.transform(d["polygon"], lambda p: F.transform(p, two)).alias("polygon"),
        ),
    )
    rows = records.withColumn("detections", shaped)
    flat = rows.select("*", F.posexplode("detections").alias("det_no", "_d")).drop("detections").select("*", "_d.*").drop("_d")
    if classes is not None:
        flat = flat.join(classes.select(F.col("name").alias("class")).distinct(), "class", "left_semi")
    return flat


def postprocess(flat: DataFrame, runs: DataFrame, iou: float = 0.7, image: Sequence[str] = ("image",)) -> DataFrame:
    """Remaining near-duplicate masks of a class removed by score."""
    return dedup_masks(flat, runs, iou, image, "det_no", "class", "score")


# --- evaluation --------------------------------------------------------------------

IOU_STEPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def box_overlap(preds: DataFrame, truth: DataFrame, image: Sequence[str], cell: float = 64.0) -> DataFrame:
    """IoU of overlapping prediction and truth boxes (x0, y0, x1, y1) of one image and class.

    Boxes meet in the grid cell that holds the top-left corner of their overlap.
    """
    image = list(image)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    listed = lambda df, tag, id_: (
        df.withColumn("_gx", F.explode(span("x0", "x1"))).withColumn("_gy", F.explode(span("y0", "y1")))
        .select(*image, "class_name", "_gx", "_gy", id_, *[F.col(c).alias(f"{tag}{c}") for c in ("x0", "y0", "x1", "y1")])
    )
    both = listed(preds, "p", "pred_id").join(listed(truth, "t", "truth_id"), image + ["class_name", "_gx", "_gy"])
    left, top = F.greatest("px0", "tx0"), F.greatest("py0", "ty0")
    w, h = F.least("px1", "tx1") - left, F.least("py1", "ty1") - top
    area = lambda t: (F.col(f"{t}x1") - F.col(f"{t}x0")) * (F.col(f"{t}y1") - F.col(f"{t}y0"))
    home = (F.floor(left / cell) == F.col("_gx")) & (F.floor(top / cell) == F.col("_gy"))
    return both.filter((w > 0) & (h > 0) & home).select(
        *image, "class_name", "pred_id", "truth_id", (w * h / (area("p") + area("t") - w * h)).alias("iou")
    )


def mask_matches(pred_runs: DataFrame, truth_runs: DataFrame, image: Sequence[str]) -> DataFrame:
    """IoU of overlapping prediction and truth masks of one image and class (one run overlap join)."""
    image = list(image)
    tag = lambda df, side, id_: df.select(*image, "class_name", F.struct(F.lit(side).alias("side"), F.col(id_).alias("id")).alias("_m"), "v", "u0", "u1")
    both = tag(pred_runs, 0, "pred_id").unionByName(tag(truth_runs, 1, "truth_id"))
    pairs = mask_overlap(both, image, "_m", ["class_name"])
    return pairs.filter("i.side = 0 and j.side = 1").select(
        *image, "class_name", F.col("i.id").alias("pred_id"), F.col("j.id").alias("truth_id"), "iou"
    )


def evaluate(
    preds: DataFrame, truth: DataFrame, pairs: DataFrame, image: Sequence[str], model: str = "model", steps: Sequence[float] = IOU_STEPS
) -> DataFrame:
    """Precision, recall, AP50 and AP50-95 per model.

    Our definition: a prediction claims the truth it overlaps most; of several claims on
    one truth the most confident at or above the IoU step counts, the rest are false.
    AP is the area under the interpolated precision-recall curve per class, averaged.
    ``preds`` has model, image, class_name, pred_id (unique), score; ``truth`` image,
    class_name, truth_id.
    """
    hits = staged(_claimed(preds, pairs, model, steps).select(model, "class_name", "score", F.col("pred_id").alias("_name"), "_hit"))
    return _scores(hits, truth, model, steps)


def evaluate_boxes(
    preds: DataFrame, truth: DataFrame, image: Sequence[str], cell: float = 64.0, digits: int | None = None, name: Column | str = "pred_id",
    by_text: bool = False, model: str = "model", steps: Sequence[float] = IOU_STEPS,
) -> DataFrame:
    """``evaluate`` with the pairs of ``box_overlap``, rounded to ``digits``, found and claimed where the boxes of an image and class lie together.

    ``pred_id`` is unique in a model and image and ``truth_id`` in an image; ``by_text`` orders them as text.  ``name`` orders equal scores of a model.
    """
    box = ["x0", "y0", "x1", "y1"]

    def meet(data: pa.RecordBatch, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        x0, y0, x1, y1 = (data.column(c).to_numpy(zero_copy_only=False).astype(float) for c in box)
        w = np.minimum(x1[p], x1[t]) - np.maximum(x0[p], x0[t])
        h = np.minimum(y1[p], y1[t]) - np.maximum(y0[p], y0[t])
        some = (w > 0) & (h > 0)
        p, t, shared = p[some], t[some], (w * h)[some]
        area = (x1 - x0) * (y1 - y0)
        iou = shared / (area[p] + area[t] - shared)
        return p, t, iou if digits is None else np.round(iou, digits)

    def apart(preds: DataFrame, truth: DataFrame) -> DataFrame:
        pairs = box_overlap(preds, truth, image, cell)
        return pairs if digits is None else pairs.withColumn("iou", F.round("iou", digits))

    cut = lambda df, *c: df.select(*image, "class_name", *c, *[F.col(b).cast("double").alias(b) for b in box])
    hits = _matched(cut(preds, model, "pred_id", "score"), cut(truth, "truth_id"), image, meet, apart, by_text, model, steps)
    return _scores(hits.withColumn("_name", F.col(name) if isinstance(name, str) else name), truth, model, steps)


def evaluate_masks(
    preds: DataFrame, truth: DataFrame, points: str, width: int, height: int, image: Sequence[str], name: Column | str = "pred_id",
    by_text: bool = False, model: str = "model", steps: Sequence[float] = IOU_STEPS,
) -> DataFrame:
    """``evaluate`` with the pairs of ``mask_matches`` for masks given as polygons, one a prediction or truth; see ``evaluate_boxes``."""

    def meet(data: pa.RecordBatch, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        runs = RunTable(*flat_lines(data.column("_xy"), width, height), data.num_rows)
        near = runs.meeting(p, t)
        p, t = p[near], t[near]
        inter = runs.common(p, t)
        some = inter > 0
        p, t, inter = p[some], t[some], inter[some]
        return p, t, inter / (runs.area[p] + runs.area[t] - inter)

    def apart(preds: DataFrame, truth: DataFrame) -> DataFrame:
        runs = lambda df, key: rasterize(df.select(*image, "class_name", key, nested_points("_xy").alias("_pts")), "_pts", width, height)
        return mask_matches(runs(preds, "pred_id"), runs(truth, "truth_id"), image)

    cut = lambda df, *c: df.select(*image, "class_name", *c, flat_points(points).alias("_xy"))
    hits = _matched(cut(preds, model, "pred_id", "score"), cut(truth, "truth_id"), image, meet, apart, by_text, model, steps)
    return _scores(hits.withColumn("_name", F.col(name) if isinstance(name, str) else name), truth, model, steps)


def _claimed(preds: DataFrame, pairs: DataFrame, model: str, steps: Sequence[float]) -> DataFrame:
    """``preds`` with ``_hit``, a bit for each step at which a prediction counts."""
    claim = (
        pairs.groupBy("pred_id").agg(F.max(F.struct("iou", F.col("truth_id").alias("tid"))).alias("_c"))
        .select("pred_id", F.col("_c.tid").alias("_tid"), F.col("_c.iou").alias("_iou"))
    )
    scored = preds.select(model, "pred_id", "score").join(claim, "pred_id")
    strongest = [F.max(F.when(F.col("_iou") >= s, F.struct("score", "pred_id")))["pred_id"] for s in steps]
    won = scored.filter(F.col("_iou") >= min(steps)).groupBy(model, "_tid").agg(F.array(*strongest).alias("_w"))
    bits = sum((F.coalesce((F.get("_w", F.lit(k)) == F.col("pred_id")).cast("int"), F.lit(0)) * (1 << k) for k in range(len(steps))), F.lit(0))
    first = won.select(model, "_w", F.explode(F.array_distinct("_w")).alias("pred_id")).filter("pred_id IS NOT NULL").select(model, "pred_id", bits.alias("_hit"))
    return preds.join(first, [model, "pred_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))


def _matched(
    preds: DataFrame, truth: DataFrame, image: Sequence[str], meet: Callable, apart: Callable, by_text: bool, model: str, steps: Sequence[float]
) -> DataFrame:
    """Predictions (image, class_name, model, pred_id, score) with ``_hit``: claims never leave an image and class, so one shuffle serves them all.

    ``meet`` gives pairs of rows of a batch, which holds whole images; rows of images and classes with more than ``LOCAL`` of them come out of
    that pass unchanged and meet by ``apart``.
    """
    image = list(image)
    key = [*image, "class_name"]
    both = by_group(preds.unionByName(truth, allowMissingColumns=True), key)
    fields = [f for f in both.schema.fields if f.name != "_large"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _hit INT"
    shape = [f.name for f in fields if f.name not in (*key, model, "pred_id", "score", "truth_id")]
    least = min(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(data: pa.RecordBatch, hit: pa.Array, bare: bool) -> pa.RecordBatch:
            columns = [pa.nulls(data.num_rows, data.column(f.name).type) if bare and f.name in shape else data.column(f.name) for f in fields]
            return pa.RecordBatch.from_arrays([*columns, hit], names=[*[f.name for f in fields], "_hit"])

        for data, group in whole_groups(batches, key):
            if group is None:
                yield told(data, pa.nulls(data.num_rows, pa.int32()), False)
                continue
            true = pc.is_valid(data.column("truth_id")).to_numpy(zero_copy_only=False)
            order = np.lexsort((true, group))
            data, group, true = data.take(pa.array(order)), group[order], true[order]
            whole = named(data, key)
            preds, truths = np.flatnonzero(~true & whole), np.flatnonzero(true & whole)
            low, high = (np.searchsorted(group[truths], group[preds], side) for side in ("left", "right"))
            met = high - low
            p = np.repeat(preds, met)
            t = truths[np.repeat(low, met) + np.arange(len(p)) - np.repeat(np.cumsum(met) - met, met)]
            p, t, iou = meet(data, p, t)
            ranks = lambda c: places(pc.cast(data.column(c), pa.string()) if by_text else data.column(c))
            best = np.lexsort((ranks("truth_id")[t], iou, p))
            best = best[np.append(p[best][1:] != p[best][:-1], True)[: len(best)]]
            best = best[iou[best] >= least]
            p, t, iou = p[best], t[best], iou[best]
            side = pc.dictionary_encode(data.column(model), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            known = named(data, [model])
            score = pc.fill_null(data.column("score"), -np.inf).to_numpy(zero_copy_only=False)
            order = np.lexsort((ranks("pred_id")[p], score[p], side[p], t))
            order = order[known[p[order]]]
            p, t, iou = p[order], t[order], iou[order]
            hit = np.zeros(data.num_rows, np.int32)
            for k, s in enumerate(steps):
                at = np.flatnonzero(iou >= s)
                of, by = t[at], side[p[at]]
                last = np.append((of[1:] != of[:-1]) | (by[1:] != by[:-1]), True)[: len(at)]
                hit[p[at[last]]] |= 1 << k
            own = pa.array(np.flatnonzero(~true))
            yield told(data.take(own), pa.array(hit).take(own), True)

    held = staged(both.mapInArrow(run, schema))
    few, many = held.filter("_hit IS NOT NULL"), held.filter("_hit IS NULL")
    # Ids that are unique among all images and models, in the order of those in one image.
    unique = lambda c, side: F.struct(side, *image, F.col(c).cast("string").alias("id") if by_text else F.col(c).alias("id"))
    wide = many.filter("truth_id IS NULL").withColumn("_id", F.col("pred_id")).withColumn("pred_id", unique("pred_id", F.col(model)))
    kind = held.schema[model].dataType
    far = many.filter("truth_id IS NOT NULL").withColumn("truth_id", unique("truth_id", F.lit(None).cast(kind).alias(model)))
    claimed = _claimed(wide.drop("_hit"), apart(wide, far), model, steps).withColumn("pred_id", F.col("_id"))
    kept = [*key, model, "pred_id", "score", "_hit"]
    return few.select(*kept).unionByName(staged(claimed.select(*kept)))


def _scores(hits: DataFrame, truth: DataFrame, model: str, steps: Sequence[float]) -> DataFrame:
    """Metrics of predictions (model, class_name, score, ``_name``) that count at the steps of ``_hit``.

    Predictions are dealt by score band and shuffled once; both passes read them from the lowest score on, as interpolation looks ahead.
    The first finds the best precision of a band, the second sums the area; what bands know of each other is one row a model, class and band.
    """
    n = len(steps)
    keys = [model, "class_name"]
    spot = [*keys, "_b"]
    hit = [F.shiftright("_hit", k).bitwiseAND(1).cast("bigint") for k in range(n)]
    rows = hits.select(*keys, F.floor((F.lit(1.0) - F.col("score")) * 200).alias("_b"), "score", "_name", "_hit")
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = rows.groupBy(*spot).agg(F.count("*").alias("_n"), *[F.sum(h).alias(f"_c{k}") for k, h in enumerate(hit)])
    known = bands.select(*spot, F.array(*[F.sum(c).over(upto) for c in ["_n", *[f"_c{k}" for k in range(n)]]]).alias("_upto"))
    dealt = rows.repartition(*spot)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def read(table: DataFrame, out: str, work: Callable) -> DataFrame:
        # One small row a band is sent to all tasks: a join by shuffle would deal the predictions again.
        placed = dealt.join(F.broadcast(table), spot).sortWithinPartitions(*spot, F.col("score").asc(), F.col("_name").desc())
        schema = ", ".join(f"`{c}` {fields[c]}" for c in spot) + ", " + ", ".join(f"{out}{k} double" for k in range(n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, tail, best = None, np.zeros(n + 1, np.int64), np.full(n, -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                first = np.flatnonzero(group_starts(batch, spot))
                ends = np.append(first[1:], batch.num_rows)
                bits = batch.column("_hit").to_numpy(zero_copy_only=False)[:, None] >> np.arange(n) & 1
                ones = np.concatenate([np.ones((len(bits), 1), np.int64), bits], axis=1)
                at = pa.array(first)
                heads = list(zip(*[batch.column(c).take(at).to_pylist() for c in spot]))
                upto = np.array(batch.column("_upto").take(at).to_pylist(), dtype=np.int64)
                above = np.array(batch.column("_above").take(at).to_pylist(), dtype=float) if "_above" in batch.schema.names else None
                sums = []
                for i, (lo, hi, head) in enumerate(zip(first.tolist(), ends.tolist(), heads)):
                    if head != last:
                        last, tail, best = head, np.zeros(n + 1, np.int64), np.full(n, -np.inf)
                    seen = np.cumsum(ones[lo:hi], axis=0)
                    left = upto[i] - tail - seen + ones[lo:hi]
                    precision = np.where(bits[lo:hi] > 0, left[:, 1:] / left[:, :1], -np.inf)
                    tail = tail + seen[-1]
                    total, best = work(precision, best, None if above is None else above[i])
                    sums.append(total)
                columns = [pa.array([h[j] for h in heads], batch.column(c).type) for j, c in enumerate(spot)]
                columns += [pa.array(c) for c in np.array(sums, dtype=float).T]
                yield pa.RecordBatch.from_arrays(columns, names=[*spot, *[f"{out}{k}" for k in range(n)]])

        return placed.mapInArrow(run, schema)

    def peak(precision: np.ndarray, best: np.ndarray, above: None) -> tuple[np.ndarray, np.ndarray]:
        return precision.max(axis=0), best

    def area(precision: np.ndarray, best: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead = np.maximum(np.maximum.accumulate(precision, axis=0), np.maximum(best, above))
        return np.where(precision >= 0, ahead, 0.0).sum(axis=0), ahead[-1]

    below = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    peaks = read(known, "_p", peak).groupBy(*spot).agg(*[F.max(f"_p{k}").alias(f"_p{k}") for k in range(n)])
    ahead = peaks.select(*spot, F.array(*[F.coalesce(F.max(f"_p{k}").over(below), F.lit(-1.0)) for k in range(n)]).alias("_above"))
    positives = truth.groupBy("class_name").agg(F.count("*").alias("n_pos"))
    areas = (
        read(known.join(ahead, spot), "_s", area).groupBy(*keys).agg(*[F.sum(f"_s{k}").alias(f"_a{k}") for k in range(n)])
        .join(positives, "class_name").select(*keys, *[(F.col(f"_a{k}") / F.col("n_pos")).alias(f"_a{k}") for k in range(n)])
    )
    # A class without hits adds zero, so the mean over classes is a sum over the registry size.
    totals = positives.agg(F.sum("n_pos").alias("n_truth"), F.count("*").alias("n_cls")).withColumn("_one", F.lit(1))
    sums = areas.groupBy(model).agg(F.sum("_a0").alias("_s50"), F.sum(sum((F.col(f"_a{k}") for k in range(n)), F.lit(0.0))).alias("_sall"))
    base = hits.groupBy(model).agg(F.sum(hit[0]).alias("_tp"), F.count("*").alias("_n"))
    return (
        base.join(sums, model, "left").withColumn("_one", F.lit(1)).join(totals, "_one")
        .select(
            model,
            (F.col("_tp") / F.col("_n")).alias("precision"),
            (F.col("_tp") / F.col("n_truth")).alias("recall"),
            (F.coalesce("_s50", F.lit(0.0)) / F.col("n_cls")).alias("ap50"),
            (F.coalesce("_sall", F.lit(0.0)) / n / F.col("n_cls")).alias("ap50_95"),
        )
    )


def rank_models(metrics: DataFrame, by: str = "mask_map50_95", columns: Sequence[str] | None = None) -> DataFrame:
    """Best first, missing values last, four digits; one row per model, so the sort is small."""
    cols = list(columns) if columns else [f.name for f in metrics.schema.fields if f.dataType.typeName() == "double"]
    missing = F.isnan(by) | F.col(by).isNull()
    top = metrics.filter(~missing).agg(F.max(F.struct(F.col(by), F.col("model"))).alias("_top"))
    # ``top`` is a single row.
    flagged = metrics.join(F.broadcast(top)).withColumn("best", F.coalesce(F.col("model") == F.col("_top.model"), F.lit(False)))
    return (
        flagged.withColumn("_missing", missing)
        .withColumns({c: F.round(c, 4) for c in cols})
        .orderBy("_missing", F.desc(by), F.desc("model"))
        .drop("_top", "_missing")
    )
