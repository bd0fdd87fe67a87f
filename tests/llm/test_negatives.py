"""Hard negatives against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigtable.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v string, id int, block int, mark long"


def plain(rows, positives=5, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score), in Python's whole numbers."""
    good = set()
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in good:
        if i % 100:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        near = sorted((s, j) for s, j, m in others if m == label)[:positives]
        for s, j in near:
            far = sorted((t, n) for t, n, m in others if m != label and low * -s <= 100 * -t <= high * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(far, 1)]
    return Counter(out)


def rows(seed=2, dim=24, n=900, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim)) * 2
    out = []
    for k in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.6])
        out.append((k, v.tolist(), int(rng.integers(labels)) if rng.random() < 0.6 else 0))
    odd = [None, [], [1.0] * (dim - 1) + [None], [math.nan] * dim, [-math.inf] * dim, [0.0] * dim, [1.0, 2.0], [1.5, 2.5]]
    out += [(1000 + 100 * j, v, 1) for j, v in enumerate(odd)] + [(3000 + j, v, 2) for j, v in enumerate(odd)]
    return out + [(None, out[0][1], 1), (5000, out[1][1], None), out[100], out[100], out[3], out[7]]


def frame(spark, data, parts=3):
    return spark.createDataFrame([(i, v, m, "v", 1, 2, 3) for i, v, m in data], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [2, 3])
def test_query_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK", 24 * 60)
    data = rows(seed)
    assert Counter(map(tuple, negatives.op13(frame(spark, data)).collect())) == plain(data)


def test_one_hot_label_and_small_integers_with_ties(spark):
    rng = np.random.default_rng(8)
    data = [(k, rng.integers(-1, 2, 6).astype(float).tolist(), 0 if k % 3 else int(k % 5)) for k in range(700)]
    assert Counter(map(tuple, negatives.op13(frame(spark, data)).collect())) == plain(data)


def test_other_windows(spark):
    data = rows(5, n=400)
    df = frame(spark, data).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), negatives.whole(F.col("embedding")).alias("v"))
    got = negatives.mine(df, F.col("id") % 100 == 0, positives=3, negatives=7, low=50, high=90)
    assert Counter(map(tuple, got.collect())) == plain(data, 3, 7, 50, 90)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-400, 400, (40, 37)).astype(float) for _ in range(2))
    a[:10] = np.repeat(rng.integers(-50, 50, (10, 1)), 37, axis=1)
    exact, last = a @ b.T, np.inf
    for level in negatives.LEVELS:
        low, high = negatives.bounds(negatives.summary(a, level), negatives.summary(b, level))
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).sum() <= last
        last = (high - low).sum()


def test_large_components_are_exact_or_left_out(spark):
    big = [2.0**21, 1.0, 3.0, -(2.0**20)]
    data = [(0, big, 1), (1, big, 1), (2, [2.0**21, 0.5, 3.0, -(2.0**20)], 2), (3, [1e300] * 4, 2), (4, [2.0**21, 1.5, 3.0, -(2.0**20)], 2)]
    got = negatives.op13(frame(spark, data)).collect()
    assert Counter(map(tuple, got)) == plain([r for r in data if r[0] != 3])


def test_blocks_without_wanted_scores_are_not_paired(spark):
    rng = np.random.default_rng(4)
    far = [(k, (rng.standard_normal(16) * 0.01 + (5.0 if k < 200 else -5.0)).tolist(), k % 4) for k in range(400)]
    df = frame(spark, far).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), negatives.whole(F.col("embedding")).alias("v"))
    df = df.withColumn("mark", F.xxhash64("v")).withColumn("dim", F.size("v")).withColumn("block", (F.col("id") / 50).cast("int"))
    asking = df.where("id % 100 = 0 AND id < 200").withColumn("low", F.array(F.lit(1000).cast("long"))).withColumn("high", F.array(F.lit(10**12).cast("long")))
    pairs = negatives.block_pairs(negatives.block_table(asking, windows=True), negatives.block_table(df), False).collect()
    assert {p.r for p in pairs} == {0, 1, 2, 3}


def test_empty_table(spark):
    assert negatives.op13(spark.createDataFrame([], SCHEMA)).count() == 0
