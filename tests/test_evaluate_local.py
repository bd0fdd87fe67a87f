"""Claims found inside an image and class against those of joined pairs, and what is shuffled for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigtable.operators import masks as mk
from rigtable.operators import models as md
from rigtable.session import settle

COLUMNS = "image string, class_name string, x0 double, y0 double, x1 double, y1 double, no int"


def scene(seed: int):
    rng = np.random.default_rng(seed)
    box = lambda: (lambda x, y: (x, y, x + float(rng.integers(4, 12)), y + float(rng.integers(4, 12))))(*map(float, rng.integers(0, 14, 2)))
    place = lambda: (f"im{rng.integers(0, 6)}", "ab"[rng.integers(0, 2)])
    truth = [(*place(), *box(), i) for i in range(60)] + [("im0", "only", 1.0, 1.0, 5.0, 5.0, 60)]
    preds = []
    for i in range(150):
        im, cls, x0, y0, x1, y1, _ = truth[rng.integers(0, 60)]
        at = float(rng.integers(0, 3))
        preds.append((im, cls, x0 + at, y0, x1 + at, y1, i, "mn"[rng.integers(0, 2)], float(rng.integers(0, 12)) / 11))
    return truth, [*preds, (None, "a", 1.0, 1.0, 9.0, 9.0, 150, "m", 1.0), ("im1", None, 1.0, 1.0, 9.0, 9.0, 151, "m", 0.5)]


def frames(spark, seed: int):
    truth, preds = scene(seed)
    corners = F.array(*[F.array(a, b) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]).alias("points")
    truth, preds = spark.createDataFrame(truth, COLUMNS), spark.createDataFrame(preds, COLUMNS + ", model string, score double")
    return preds.withColumnRenamed("no", "pred_id").select("*", corners), truth.withColumnRenamed("no", "truth_id").select("*", corners)


def near(got, want):
    got, want = ({r.model: tuple(r)[1:] for r in df.collect()} for df in (got, want))
    assert set(got) == {"m", "n"} and all(got[m] == pytest.approx(want[m]) for m in want)
    return got


@pytest.mark.parametrize("local", [500, 8])
def test_masks_are_claimed_inside_an_image(spark, monkeypatch, local):
    preds, truth = frames(spark, 4)
    named = [preds.withColumn("pred_id", F.format_string("%04d", "pred_id")), truth.withColumn("truth_id", F.format_string("%04d", "truth_id"))]
    cut = lambda df, key: mk.rasterize(df.select("image", "class_name", key, "points"), "points", 32, 32)
    want = md.evaluate(*named, md.mask_matches(cut(named[0], "pred_id"), cut(named[1], "truth_id"), ["image"]), ["image"])
    monkeypatch.setattr(mk, "LOCAL", local)
    written = []
    monkeypatch.setattr(md, "staged", lambda df: written.append(settle(df)) or written[-1])
    got = near(md.evaluate_masks(preds, truth, "points", 32, 32, ["image"], F.format_string("%04d", "pred_id")), want)
    assert all(0 < v < 1 for row in got.values() for v in row)
    if local == 500:  # a row a prediction, no run
        assert [w.count() for w in written] == [152, 0] and written[0].filter("_xy IS NOT NULL").isEmpty()


def test_predictions_are_dealt_once(spark):
    hits = spark.range(500).selectExpr("'m' AS model", "'a' AS class_name", "(id % 50) / 50 AS score", "cast(id AS string) AS _name", "cast(id % 3 = 0 AS int) AS _hit")
    truth = spark.range(300).selectExpr("'a' AS class_name")
    out = md._scores(hits, truth, "model", [0.5])
    rows = sorted(((r.score, r._name, r._hit) for r in hits.collect()), key=lambda r: (-r[0], r[1]))
    flags = np.array([h for *_, h in rows])
    precision = np.cumsum(flags) / np.arange(1, len(flags) + 1)
    assert out.first().ap50 == pytest.approx(sum(precision[i:].max() for i in np.flatnonzero(flags)) / 300)
    out.collect()
    # Both passes over the predictions read one exchange of five narrow columns; before, each step's counts and precisions were shuffled.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_tp0" not in plan and plan.count("REPARTITION_BY_COL") >= 1


@pytest.mark.parametrize("local", [500, 8])
def test_boxes_are_claimed_inside_an_image(spark, monkeypatch, local):
    preds, truth = frames(spark, 7)
    named = [preds.withColumn("pred_id", F.col("pred_id").cast("string")), truth.withColumn("truth_id", F.col("truth_id").cast("string"))]
    want = md.evaluate(*named, md.box_overlap(*named, ["image"], 8.0).withColumn("iou", F.round("iou", 12)), ["image"])
    monkeypatch.setattr(mk, "LOCAL", local)
    written = []
    monkeypatch.setattr(md, "staged", lambda df: written.append(settle(df)) or written[-1])
    near(md.evaluate_boxes(preds, truth, ["image"], 8.0, 12, F.col("pred_id").cast("string"), by_text=True), want)
    if local == 500:
        assert [w.count() for w in written] == [152, 0] and written[0].filter("x0 IS NOT NULL").isEmpty()
