"""Annotation merging, splits, masks and files against brute force."""

import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigtable.operators import labels as lb
from rigtable.operators import masks as mk
from rigtable.operators import models as md
from rigtable.operators import views as vw
from rigtable.sources import readers as rd
from rigtable.sources import sinks as sk


def test_promote_is_idempotent(spark):
    review = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "stem string, content string")
    pool = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "9")], "stem string, content string")
    first = lb.promote(review, pool)
    assert {r["stem"]: r["action"] for r in first.collect()} == {"a": "promoted", "b": "same", "c": "kept", "d": "pool"}
    again = lb.promote(review, first.select("stem", "content"))
    assert {r["action"] for r in again.collect()} == {"same", "kept", "pool"}
    over = lb.promote(review, pool, overwrite=True, scope="c", scope_mode="exact")
    assert {r["stem"]: r["content"] for r in over.collect()} == {"b": "2", "c": "3", "d": "9"}


def test_raster_runs_from_sql(spark):
    """The table function gives the rows of ``rasterize``; shapes without an area or a size give none."""
    rows = [(1, [[1.0, 1.0], [9.5, 2.0], [6.0, 8.0]], 12), (2, [[0.0, 0.0], [30.0, 0.0], [30.0, 30.0], [0.0, 30.0]], 12), (3, [[1.0, 1.0], [2.0, 2.0]], 12), (4, None, 12), (5, [[1.0, 1.0], [5.0, 1.0], [3.0, 4.0]], None)]
    shapes = spark.createDataFrame(rows, "k int, points array<array<double>>, w int")
    mk.register_raster_runs(spark)
    got = spark.sql("SELECT s.k, r.* FROM {s} s, LATERAL raster_runs(s.points, s.w, 10) r", s=shapes).collect()
    want = mk.rasterize(shapes.filter("k < 4").drop("w"), "points", 12, 10).select("k", "v", "u0", "u1").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["k"] for r in got} == {1, 2}


@pytest.mark.parametrize("buckets", [1, 3, 256])
def test_class_pulls_follow_the_turns(spark, buckets):
    """Rare classes share their few images, one class is on every image, and repeated labels of an image count once."""
    rng = np.random.default_rng(12)
    rows = [(label, int(i), f"im{i}") for k, label in enumerate("fcadbeg") for i in rng.integers(0, 6 + 2 * k, 5)]
    rows += [("z", i, f"im{i}") for i in range(60)] + [("y", 0, "im0")]
    seen = spark.createDataFrame(rows, "label string, _i int, stem string")
    labels = sorted({r[0] for r in rows} - {"g"})
    missing = spark.createDataFrame([(x, len(labels)) for x in labels], "label string, _k long")
    taken = []
    for label in labels:
        free = sorted({(i, s) for x, i, s in rows if x == label and s not in taken})
        taken += [free[0][1]] if free else []
    got = [r["stem"] for r in lb.class_pulls(seen, missing, "stem", buckets).collect()]
    assert sorted(got) == sorted(taken) and len(set(got)) == len(got)
    assert lb.class_pulls(seen, missing.limit(0), "stem", buckets).count() == 0


def test_split_runs_no_job_a_class(spark):
    images = spark.createDataFrame([(f"s{i}",) for i in range(60)], "stem string")
    jobs = []
    for classes in (2, 40):
        shapes = spark.createDataFrame([(f"s{i}", f"c{i}") for i in range(classes)] + [("s1", "all")], "stem string, label string")
        spark.sparkContext.setJobGroup(f"split{classes}", "counted")
        plan = lb.split_dataset(images, shapes, 0.2, 42)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"split{classes}")))
        spark.sparkContext.setJobGroup("", "")
        held = {r["stem"] for r in plan.filter("split = 'val'").collect()}
        assert {f"s{i}" for i in range(classes)} <= held
    assert jobs[0] == jobs[1]


def test_captures_of_one_folder_name_stay_apart(spark):
    parts = {"rgb.png": b"r", "depth.npy": b"d", "intrinsics.yaml": b"i", "rgb.json": b"l"}
    rows = [(f"/pool/{pool}/cap1/{n}", c + pool.encode()) for pool in "ab" for n, c in parts.items() if (pool, n) != ("b", "depth.npy")]
    rows += [(f"/pool/c/cap1/{n}", c + b"c") for n, c in parts.items()]
    ok, bad = rd.gather_captures(spark.createDataFrame(rows, "path string, content binary"))
    assert {(r["capture_id"], r["folder"], bytes(r["depth"])) for r in ok.collect()} == {("cap1", "/pool/a/cap1", b"da"), ("cap1", "/pool/c/cap1", b"dc")}
    assert [(r["folder"], r["reason"]) for r in bad.collect()] == [("/pool/b/cap1", "missing depth")]


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_split_is_complete_and_covers_classes(spark, n):
    images = spark.range(n).select(F.col("id").cast("string").alias("stem"))
    shapes = images.select("stem", F.when(F.col("stem").cast("int") % 2 == 0, "even").otherwise("odd").alias("label"))
    rare = images.filter("stem = '0'").select("stem", F.lit("rare").alias("label"))
    out = {r["stem"]: r["split"] for r in lb.split_dataset(images, shapes.unionByName(rare), 0.2, 42).collect()}
    val = {s for s, side in out.items() if side == "val"}
    base = max(1, round(n * 0.2))
    assert len(out) == n and base <= len(val) <= base + 3 or n == 1
    if n > 7:
        assert "0" in val and {int(s) % 2 for s in val} == {0, 1}
    assert out == {r["stem"]: r["split"] for r in lb.split_dataset(images, shapes.unionByName(rare), 0.2, 42).collect()}


def test_strict_label_gate(spark):
    shapes = spark.createDataFrame([("a", "cork"), ("a", "mug")], "stem string, label string")
    reg = rd.classes_frame(spark, ["cork", {"name": "lighter", "prompt": "a lighter"}])
    with pytest.raises(ValueError, match="mug"):
        lb.check_labels(shapes, reg, "strict")
    assert [r["prompt"] for r in reg.orderBy("class_id").collect()] == ["cork", "a lighter"]
    with pytest.raises(ValueError):
        rd.classes_frame(spark, [])


def inside(poly, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def random_polygons(count, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [[float(x), float(y)] for x, y in rng.uniform(-4, 28, (int(rng.integers(3, 8)), 2))]) for i in range(count)]


def grids(runs, w=24, h=20):
    out = {}
    for r in runs.collect():
        out.setdefault(r["id"], np.zeros((h, w), bool))[r["v"], r["u0"] : r["u1"] + 1] = True
    return out


def test_raster_is_even_odd_at_pixel_centres(spark):
    polys = random_polygons(40)
    df = spark.createDataFrame(polys, "id int, points array<array<double>>")
    got = grids(mk.rasterize(df, "points", 24, 20))
    for i, poly in polys:
        want = np.array([[inside(poly, u + 0.5, v + 0.5) for u in range(24)] for v in range(20)])
        assert (got.get(i, np.zeros_like(want)) == want).all(), i


def test_overlap_dedup_and_union(spark):
    polys = random_polygons(30, 7)
    df = spark.createDataFrame([(0, i, p, float(i * 37 % 11), "a" if i % 2 else "b") for i, p in polys], "image_id int, id int, points array<array<double>>, score double, class_name string")
    runs = mk.rasterize(df.select("image_id", "id", "points"), "points", 24, 20)
    g = grids(runs)
    pairs = {(r["i"], r["j"]): r["iou"] for r in mk.mask_overlap(runs, ["image_id"], "id").collect()}
    for i in g:
        for j in g:
            if i < j:
                both = (g[i] & g[j]).sum()
                want = both / (g[i] | g[j]).sum()
                assert abs(pairs.get((i, j), 0.0) - want) < 1e-12
    kept = []
    for i in sorted((i for i, _ in polys), key=lambda i: (-(i * 37 % 11), i)):
        iou = lambda j: (g[i] & g[j]).sum() / max(1, (g[i] | g[j]).sum()) if i in g and j in g else 0
        if not any(i % 2 == j % 2 and iou(j) >= 0.3 for j in kept):
            kept.append(i)
    got = mk.dedup_masks(df, runs, 0.3, ["image_id"], "id")
    assert sorted(r["id"] for r in got.collect()) == sorted(kept) and len(kept) < 30
    union = mk.union_masks(runs, ["image_id"]).withColumn("id", F.lit(0))
    assert (grids(union)[0] == np.any(list(g.values()), axis=0)).all()


def test_suppression_along_a_chain_of_100_000(spark):
    """Each detection overlaps the next; scores rise along stretches, so decisions run through whole stretches."""
    n = 100_000
    score = lambda x: x % 1000
    links = spark.range(n - 1).select(F.lit("img").alias("image_id"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    first = score(F.col("i")) > score(F.col("j"))
    edges = links.select("image_id", F.when(first, F.col("i")).otherwise(F.col("j")).alias("strong"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("weak"))
    out = {r.weak for r in mk.suppress(edges.withColumn("score", score(F.col("strong"))), ["image_id"]).collect()}
    kept = set()
    for x in sorted(range(n), key=lambda x: (-score(x), x)):
        if x - 1 not in kept and x + 1 not in kept:
            kept.add(x)
    assert set(range(n)) - out == kept


def test_closing_and_contours(spark):
    rng = np.random.default_rng(1)
    mask = rng.random((12, 15)) < 0.35
    px = spark.createDataFrame([(0, int(u), int(v)) for v, u in zip(*np.nonzero(mask))], "id int, u int, v int")
    offs = mk.ellipse(5)
    assert len(offs) == 17

    def shift(m, fill, sign, comb):
        out = np.full_like(m, not comb)
        for du, dv in offs:
            moved = np.full_like(m, fill)
            for v in range(12):
                for u in range(15):
                    if 0 <= v + sign * dv < 12 and 0 <= u + sign * du < 15:
                        moved[v, u] = m[v + sign * dv, u + sign * du]
            out = out | moved if comb else out & moved
        return out

    want = shift(shift(mask, False, -1, True), True, 1, False)
    got = np.zeros_like(mask)
    for r in mk.close_mask(px, ["id"], 5, 15, 12).collect():
        got[r["v"], r["u"]] = True
    assert (got == want).all()
    square = spark.createDataFrame([(1, u, v) for u in range(3, 13) for v in range(2, 11)], "id int, u int, v int")
    poly = mk.mask_to_polygons(square, ["id"]).first()
    assert sorted(map(tuple, poly["points"])) == [(3, 2), (3, 10), (12, 2), (12, 10)] and poly["area"] == 72
    assert mk.mask_to_polygons(square.filter("u < 6"), ["id"], 50).count() == 0


def test_area_resize_of_any_ratio(spark):
    img = np.arange(35, dtype=float).reshape(5, 7)
    px = spark.createDataFrame([(0, u, v, float(img[v, u])) for v in range(5) for u in range(7)], "id int, u int, v int, r double")
    got = vw.resize_image(px, ["id"], (7, 5), (3, 2), ["r"]).toPandas()
    assert len(got) == 6
    fine = img.repeat(2, 0).repeat(3, 1)  # 10 x 21 splits evenly into 2 x 3
    want = fine.reshape(2, 5, 3, 7).mean(axis=(1, 3))
    assert all(abs(want[v, u] - r) < 1e-9 for u, v, r in got[["u", "v", "r"]].itertuples(index=False))


def test_equal_depth_goes_to_the_lower_point(spark):
    rows = [(0, 7, 3, 2.0, 2.0, 0.5), (0, 5, 4, 2.0, 2.0, 0.5), (0, 9, 5, 3.0, 2.0, 0.4), (0, 1, 6, 2.0, 2.0, -0.1)]
    df = spark.createDataFrame(rows, "capture_id int, point_id int, instance_id int, pu double, pv double, pz double")
    got = {(r["u"], r["v"]): r["instance_id"] for r in vw.splat(df, ["capture_id"], 6, 6, 1).collect()}
    assert got[(1, 2)] == 4 and got[(2, 2)] == 5 and got[(4, 2)] == 5 and len(got) == 8


def test_files_one_per_image(spark, tmp_path):
    flags = F.create_map().cast("map<string,boolean>")
    one = F.struct(F.lit("cork").alias("label"), F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (4, 0), (4, 4))]).alias("points"), F.lit(None).cast("int").alias("group_id"), F.lit("polygon").alias("shape_type"), flags.alias("flags"))
    docs = spark.range(5).select(
        F.concat(F.lit("p"), F.col("id") % 2).alias("pool"), F.concat(F.lit("img"), "id").alias("stem"), F.lit("5.5.0").alias("version"), flags.alias("flags"),
        F.array(one).alias("shapes"), F.concat(F.lit("img"), "id", F.lit(".png")).alias("imagePath"), F.lit(None).cast("string").alias("imageData"), F.lit(4).alias("imageHeight"), F.lit(8).alias("imageWidth"),
    )
    sk.write_labelme(docs, str(tmp_path / "lm"), "files")
    raw = json.loads((tmp_path / "lm/p0/img2.json").read_text())
    assert raw["imageData"] is None and raw["shapes"][0]["group_id"] is None and raw["imageWidth"] == 8
    back = rd.read_labelme(spark, str(tmp_path / "lm"))
    assert sorted((r["pool"], r["stem"]) for r in back.collect()) == [("p0", "img0"), ("p0", "img2"), ("p0", "img4"), ("p1", "img1"), ("p1", "img3")]
    assert rd.usable_shapes(back).count() == 5
    lines = spark.createDataFrame([("train", "a", 1, "1 0 0 1 0 1 1"), ("train", "a", 0, "0 0 0 1 0 1 1 0.5"), ("val", "b", None, None)], "split string, stem string, line_no int, line string")
    done = sk.write_yolo(lines, str(tmp_path / "y"), "files")
    assert {r["file"]: r["lines"] for r in done.collect()} == {"labels/train/a.txt": 2, "labels/val/b.txt": 0}
    assert pathlib.Path(tmp_path / "y/labels/val/b.txt").read_text() == ""
    got = {r["line_no"]: (r["class_id"], r["skipped"]) for r in rd.read_yolo(spark, str(tmp_path / "y")).collect()}
    assert got == {0: (0, True), 1: (1, False)}
    pts = spark.createDataFrame([("c1", i, 0.1 * i, 0.0, 0.5, 255, 0, 9) for i in range(3)], "capture_id string, point_id int, x double, y double, z double, r int, g int, b int")
    sk.write_ply(pts, str(tmp_path / "ply"))
    text = (tmp_path / "ply/c1.ply").read_text().splitlines()
    assert text[2] == "element vertex 3" and text[-1] == "0.200000 0.000000 0.500000 255 0 9"


def test_captures_from_disk(spark, tmp_path):
    depth = np.linspace(0.2, 0.9, 12, dtype="float32").reshape(3, 4)
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (4).to_bytes(4, "big") + (3).to_bytes(4, "big")
    for name in ("capture_1", "capture_2"):
        folder = tmp_path / "caps" / name
        folder.mkdir(parents=True)
        (folder / "rgb.png").write_bytes(png)
        (folder / "rgb.json").write_text("{}")
        (folder / "intrinsics.yaml").write_text("width: 4\nheight: 3\nfx: 5.0\nfy: 5.0\nppx: 1.5\nppy: 1.0\nmodel: none\ncoeffs: [0, 0]\n")
        if name == "capture_1":
            (folder / "depth.npy").write_bytes(rd.npy_bytes(depth))
    ok, bad = rd.read_captures(spark, str(tmp_path / "caps"))
    assert [(r["capture_id"], r["reason"]) for r in bad.collect()] == [("capture_2", "missing depth")]
    px = rd.explode_depth(ok).orderBy("v", "u").toPandas()
    assert np.allclose(px["depth_m"], depth.ravel()) and px["shape_ok"].all()
    sizes = rd.fill_sizes(
        spark.createDataFrame([("capture_1", "rgb", None, None)], "pool string, stem string, imageWidth int, imageHeight int"), rd.image_bytes(spark, str(tmp_path / "caps"))
    ).first()
    assert (sizes["imageWidth"], sizes["imageHeight"]) == (4, 3)


def test_box_ap_of_perfect_and_empty_models(spark):
    truth = spark.createDataFrame([(i, "a", f"t{i}", 0.0, 0.0, 10.0, 10.0) for i in range(4)], "image int, class_name string, truth_id string, x0 double, y0 double, x1 double, y1 double")
    shift = lambda m, dx: truth.select(F.lit(m).alias("model"), "image", "class_name", F.concat(F.lit(m), "truth_id").alias("pred_id"), (F.lit(0.5) + F.col("image") / 10).alias("score"), (F.col("x0") + dx).alias("x0"), "y0", (F.col("x1") + dx).alias("x1"), "y1")
    preds = shift("good", 0.0).unionByName(shift("bad", 50.0))
    out = {r["model"]: r for r in md.evaluate(preds, truth, md.box_overlap(preds, truth, ["image"]), ["image"]).collect()}
    assert out["good"]["ap50_95"] == 1.0 and out["good"]["recall"] == 1.0 and out["bad"]["ap50"] == 0.0 and out["bad"]["precision"] == 0.0


def test_ranking_puts_missing_last(spark):
    rows = [("a", 0.5, 0.1), ("b", float("nan"), 0.2), ("c", 0.61239, 0.3)]
    out = md.rank_models(spark.createDataFrame(rows, "model string, mask_map50_95 double, mask_map50 double")).collect()
    assert [r["model"] for r in out] == ["c", "a", "b"] and out[0]["best"] and out[0]["mask_map50_95"] == 0.6124


def test_a_second_export_replaces_the_first(spark, tmp_path):
    lines = spark.createDataFrame([("train", "a", 0, "0 1"), ("val", "b", 0, "0 2")], "split string, stem string, line_no int, line string")
    sk.write_yolo(lines, f"{tmp_path}/yolo")
    sk.write_yolo(lines.filter("split = 'train'"), f"{tmp_path}/yolo")
    assert [r.split for r in spark.read.json(f"{tmp_path}/yolo").collect()] == ["train"]
    points = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "capture_id string, x double")
    sk.write_points(points, f"{tmp_path}/points")
    sk.write_points(points.filter("capture_id = 'c1'"), f"{tmp_path}/points")
    assert sk.read_points(spark, f"{tmp_path}/points").count() == 1


def test_unknown_labels_are_counted_in_full(spark):
    shapes = spark.createDataFrame([(f"odd{k:03}",) for k in range(60)] + [("cork",)], "label string")
    known = spark.createDataFrame([(0, "cork")], "class_id int, name string")
    with pytest.raises(ValueError, match="60 labels .* 'odd000'"):
        lb.check_labels(shapes, known)
    assert lb.check_labels(shapes, known, "warn")[1].count() == 60
