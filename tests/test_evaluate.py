"""Evaluation against a plain loop; one written row a prediction."""

import numpy as np
import pytest

from rigtable.operators import models as md
from rigtable.session import settle


def test_evaluate_against_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(8)
    truth = [("im", "c", f"t{i}") for i in range(12)]
    preds = [("m", "im", "c", f"p{i:02d}", round(float(rng.integers(0, 9)) / 9, 3)) for i in range(40)]
    pairs = [("im", "c", p[3], f"t{rng.integers(0, 12)}", round(float(rng.random()), 2)) for p in preds if rng.random() < 0.9]
    seen = []
    monkeypatch.setattr(md, "staged", lambda df: seen.append(settle(df)) or seen[-1])
    got = md.evaluate(
        spark.createDataFrame(preds, "model string, image string, class_name string, pred_id string, score double"),
        spark.createDataFrame(truth, "image string, class_name string, truth_id string"),
        spark.createDataFrame(pairs, "image string, class_name string, pred_id string, truth_id string, iou double"), ["image"],
    ).first()
    assert seen[0].count() == len(preds)
    claim = {p: (t, iou) for _, _, p, t, iou in pairs}
    aps, hits = [], []
    for step in md.IOU_STEPS:
        best = {}
        for _, _, _, p, score in preds:
            if p in claim and claim[p][1] >= step:
                best[claim[p][0]] = max(best.get(claim[p][0], (-1.0, "")), (score, p))
        true = {p for _, p in best.values()}
        flags = [p[3] in true for p in sorted(preds, key=lambda p: (-p[4], p[3]))]
        prec = np.cumsum(flags) / np.arange(1, len(flags) + 1)
        aps.append(sum(prec[i:].max() for i, f in enumerate(flags) if f) / len(truth))
        hits.append(len(true))
    assert got.precision == pytest.approx(hits[0] / len(preds)) and got.recall == pytest.approx(hits[0] / len(truth))
    assert got.ap50 == pytest.approx(aps[0]) and got.ap50_95 == pytest.approx(sum(aps) / 10)
