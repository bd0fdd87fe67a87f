"""The spread-out building blocks against plain loops, with the large-group paths forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rigtable import scale
from rigtable.operators import calib
from rigtable.operators import tracking as tk
from rigtable.session import settle


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat and include far outliers."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 20, 3000))
    pdf = pd.DataFrame({"key": key, "t": rng.permutation(3000), "v": np.round(rng.normal(0, 1, 3000), 2)})
    pdf.loc[pdf.index % 500 == 0, "v"] = 1e9
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("grid", [30, scale.GRID])
def test_quantiles_of_large_groups(skewed, monkeypatch, grid):
    monkeypatch.setattr(scale, "GRID", grid)
    pdf, df = skewed
    probs = {"a": 0.02, "m": 0.5, "z": 0.98}
    got = scale.group_quantiles(df, ["key"], "v", probs).toPandas().set_index("key")
    spread = scale.median_and_mad(df, ["key"], "v").toPandas().set_index("key")
    for key, part in pdf.groupby("key"):
        want = [np.percentile(part["v"], 100 * p) for p in probs.values()]
        assert np.allclose(got.loc[key, list(probs)].astype(float), want), key
        mid = np.median(part["v"])
        assert np.allclose(spread.loc[key].astype(float), [mid, np.median(np.abs(part["v"] - mid))]), key


def test_small_groups_are_bracketed_too(spark):
    """Groups of every small size, ties included, give what sorting gives, and a group of 5,000 counts few of its values."""
    rng = np.random.default_rng(8)
    pdf = pd.concat([pd.DataFrame({"k": n, "v": np.round(rng.normal(0, 1, n), 1 + n % 3)}) for n in [*range(1, 40), 499, 500, 501, 1999, 5000]])
    df = spark.createDataFrame(pdf).repartition(7)
    probs = {"a": 0.0, "b": 0.02, "c": 0.37, "m": 0.5, "z": 1.0}
    got = scale.group_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    spread = scale.median_and_mad(df, ["k"], "v").toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        want = np.percentile(part["v"], [100 * p for p in probs.values()])
        assert np.allclose(got.loc[k, list(probs)].astype(float), want), k
        mid = np.median(part["v"])
        assert np.allclose(spread.loc[k].astype(float), [mid, np.median(np.abs(part["v"] - mid))]), k
    even = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    low, high = scale.bracket(F.col("g"), F.col("n"), 0.5)
    ends = even.groupBy("k").agg(F.count("*").alias("n"), scale.rank_grid(F.col("v")).alias("g")).select(low.alias("lo"), high.alias("hi")).first()
    assert ends.lo <= 2499 and ends.hi >= 2500 and ends.hi - ends.lo < 100


def test_quantiles_with_infinite_missing_and_null_values(spark, monkeypatch):
    monkeypatch.setattr(scale, "GRID", 30)
    inf, nan = float("inf"), float("nan")
    rows = [(1, float(v)) for v in range(1000)] + [(1, inf)] * 3 + [(1, -inf), (1, None), (None, 2.0), (None, 4.0)] + [(2, nan)] * 700 + [(2, 1.0)] * 600
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r for r in scale.group_quantiles(df, ["k"], "v", {"lo": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    assert (got[1].lo, got[1].mid, got[1].top) == (249.75, 500.5, inf)
    assert got[None].mid == 3.0 and got[2].lo == 1.0 and np.isnan(got[2].mid) and np.isnan(got[2].top)


def test_no_job_runs_before_the_result(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    spark.sparkContext.setJobGroup("quantiles", "none expected")
    scale.group_quantiles(df, ["k"], "v", {"m": 0.5})
    scale.median_and_mad(df, ["k"], "v")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    spark.sparkContext.setJobGroup("", "")


def test_running_values(skewed):
    pdf, df = skewed
    cols = {
        "s": ("sum", F.col("t")), "n": ("count", F.lit(1)), "m": ("max", F.col("v")),
        "l": ("last", F.when(F.col("t") % 7 == 0, F.col("t"))),
    }
    got = scale.running(df, ["key"], F.floor(F.col("t") / 100), [F.col("t")], cols).toPandas().sort_values(["key", "t"])
    want = pdf.sort_values(["key", "t"])
    g = want.groupby("key")
    assert (got["s"].to_numpy() == g["t"].cumsum().to_numpy()).all()
    assert (got["n"].to_numpy() == (g.cumcount() + 1).to_numpy()).all()
    assert np.allclose(got["m"].to_numpy(), g["v"].cummax().to_numpy())
    last = want["t"].where(want["t"] % 7 == 0).groupby(want["key"]).ffill()
    assert got["l"].fillna(-1).tolist() == last.fillna(-1).tolist()


def test_exclusive_running_is_a_lag(skewed):
    pdf, df = skewed
    got = scale.running(df, ["key"], F.floor(F.col("t") / 64), [F.col("t")], {"p": ("last", F.col("t"))}, exclusive=True)
    got = got.toPandas().sort_values(["key", "t"])
    want = pdf.sort_values(["key", "t"]).groupby("key")["t"].shift()
    assert got["p"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_sliding_across_chunks(skewed):
    pdf, df = skewed
    values = lambda w: {"m": F.avg("v").over(w), "n": F.count("*").over(w)}
    got = scale.sliding(df, ["key"], [F.col("t")], F.floor(F.col("t") / 50), 10, values, chunk=16)
    got = got.toPandas().sort_values(["key", "t"])
    roll = pdf.sort_values(["key", "t"]).groupby("key")["v"].rolling(10, min_periods=1)
    assert len(got) == len(pdf)
    assert np.allclose(got["m"].to_numpy(), roll.mean().to_numpy())
    assert (got["n"].to_numpy() == roll.count().to_numpy()).all()


def test_latch_matches_the_step_by_step_rule(spark):
    rng = np.random.default_rng(5)
    stay = rng.random(600) < 0.8
    enter = stay & (rng.random(600) < 0.7)
    pdf = pd.DataFrame({"k": np.arange(600) // 200, "t": np.arange(600), "en": enter, "st": stay})
    want = []
    for _, part in pdf.groupby("k"):
        on, streak = False, 0
        for e, s in zip(part["en"], part["st"]):
            if on:
                if not s:
                    on, streak = False, 0
            else:
                streak = streak + 1 if e else 0
                on = streak >= 3
            want.append(on)
    got = tk.latch(spark.createDataFrame(pdf), ["k"], ["t"], F.floor(F.col("t") / 30), F.col("en"), F.col("st"), 3)
    assert got.toPandas().sort_values("t")["stable"].tolist() == want


def test_fold_crosses_arrow_batches(spark):
    pdf = pd.DataFrame({"k": [0] * 500 + [1] * 30, "t": list(range(530)), "x": np.arange(530) * 0.002, "y": 0.0, "z": 0.0})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = tk.significant_moves(spark.createDataFrame(pdf), ["k"], ["t"], min_move=0.005).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got["t"]) == list(range(0, 500, 3)) + list(range(500, 530, 3))


@pytest.mark.parametrize("shape", ["blob", "line", "same", "pair", "one", "ring"])
def test_max_pairwise(spark, shape):
    rng = np.random.default_rng(11)
    a = rng.random(60) * 2 * np.pi
    pts = {
        "blob": rng.normal(0, 1, (60, 3)), "line": np.outer(rng.random(40), [1, 2, 3]), "same": np.ones((5, 3)),
        "pair": rng.random((2, 3)), "one": rng.random((1, 3)), "ring": np.stack([np.cos(a), np.sin(a), 0 * a], axis=1),
    }[shape]
    pdf = pd.DataFrame(pts, columns=["x", "y", "z"]).assign(k=1)
    got = calib.max_pairwise(spark.createDataFrame(pdf), ["k"], ["x", "y", "z"]).first()
    want = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)).max()
    assert got["n"] == len(pts) and abs(got["max_pair"] - want) < 1e-9


def test_max_pairwise_refines_to_the_same_pairs(spark):
    """Cells halved as far as they go lose no widest pair; null keys are a group."""
    rng = np.random.default_rng(4)
    ball = rng.normal(0, 1, (500, 3))
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    groups = {"ball": ball, "flat": rng.random((300, 3)) * [1, 1, 0], None: rng.random((50, 3))}
    rows = [(k, *map(float, p)) for k, ps in groups.items() for p in ps]
    got = calib.max_pairwise(spark.createDataFrame(rows, "k string, x double, y double, z double"), ["k"], ["x", "y", "z"], max_levels=3, cap_pairs=-10**9)
    got = {r["k"]: r["max_pair"] for r in got.collect()}
    for k, ps in groups.items():
        assert abs(got[k] - np.sqrt(((ps[:, None] - ps[None]) ** 2).sum(-1)).max()) < 1e-12, k


def test_max_pairwise_of_a_sphere_forms_few_pairs(spark):
    """200,000 points on a sphere, the worst case, with one pair exactly opposite."""
    n = 200_000
    pts = spark.range(n).select(F.lit(1).alias("k"), *[F.randn(seed).alias(a) for seed, a in enumerate("xyz")])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    pts = pts.select("k", *[(F.col(a) / size * 0.999).alias(a) for a in "xyz"])
    pair = spark.createDataFrame([(1, 0.48, 0.6, 0.64), (1, -0.48, -0.6, -0.64)], "k int, x double, y double, z double")
    got = calib.max_pairwise(pts.unionByName(pair), ["k"], ["x", "y", "z"])
    row = got.first()
    assert row["n"] == n + 2 and abs(row["max_pair"] - 2.0) < 1e-12


def test_cap_even_is_linspace(spark):
    for n, m in ((10, 4), (100, 7), (5, 9), (33, 1), (50, 49)):
        df = spark.range(n).withColumn("k", F.lit(0))
        from rigtable.operators.geometry import cap_even

        got = sorted(r["id"] for r in cap_even(df, ["k"], [F.col("id")], m, F.floor(F.col("id") / 8)).collect())
        want = list(range(n)) if n <= m else np.linspace(0, n - 1, m, dtype=int).tolist()
        assert got == want, (n, m)


def test_ties_are_counted_not_gathered(spark):
    """One value on most rows of a hot key, NaN and null keys among the rest; no list of rows in the plan."""
    import numpy as np

    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.lit("hot")).alias("k"),
        F.when(F.col("id") % 5 == 0, F.rand(3) * 100).when(F.col("id") % 97 == 1, F.lit(float("nan"))).otherwise(50.0).alias("x"),
    ).localCheckpoint()
    quantiles = scale.group_quantiles(df, ["k"], "x", {"a": 0.05, "b": 0.5, "c": 0.9})
    spread = scale.median_and_mad(df, ["k"], "x")
    for made in (quantiles, spread):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan
    values = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["x"])
    for r in quantiles.collect():
        own = np.sort(np.array(values[r["k"]]))
        for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.9)):
            at = p * (len(own) - 1)
            low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert abs(r[name] - (low + (high - low) * (at - np.floor(at)))) < 1e-9
    assert {r["k"]: r["_med"] for r in spread.collect()} == {"hot": 50.0, None: 50.0}


def test_widest_pair_lists_only_points_in_caps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(calib, "staged", lambda df: seen.append(settle(df)) or seen[-1])
    pts = spark.range(4000).select((F.col("id") % 2).alias("k"), *[F.rand(s).alias(a) for s, a in enumerate("xyz")])
    pts = settle(pts.unionByName(pts))
    got = {r.k: (r.n, r.max_pair) for r in calib.max_pairwise(pts, ["k"], ["x", "y", "z"]).collect()}
    # 27 cells a point were written before; copies are listed once.
    assert seen[0].count() < 4000 and seen[0].count() == seen[0].distinct().count()
    for k, part in pts.toPandas().groupby("k"):
        p = part[["x", "y", "z"]].to_numpy()
        assert got[k] == (len(p), pytest.approx(max(((p - q) ** 2).sum(axis=1).max() for q in p) ** 0.5))
