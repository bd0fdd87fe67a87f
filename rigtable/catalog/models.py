"""Model scoring, evaluation, ranking and file round trips over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rigtable.catalog.bind import CLASSES, DETS, GOOD, HEIGHT, IMAGES, PIXELS, SHAPES, VALID, WIDTH, detections, images, pixels, r, rs, shapes, sql, table
from rigtable.catalog.labels import CLASS_ROWS, good_shapes
from rigtable.operators import labels as lb
from rigtable.operators import masks as mk
from rigtable.operators import models as md
from rigtable.plans import dataset as ds
from rigtable.session import scratch_path
from rigtable.sources import readers as rd
from rigtable.sources import sinks as sk
from rigtable.streaming.run import drain

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


# --- evaluation ------------------------------------------------------------------------


def truth_boxes(spark, d):
    g = good_shapes(spark, d)
    end = lambda f, i: f(F.transform("points", lambda p: p[i]))
    return g.select(
        "stem", F.col("label").alias("class_name"), F.col("line_no").alias("truth_id"), F.concat_ws(":", "stem", "line_no").alias("key"),
        end(F.array_min, 0).alias("x0"), end(F.array_min, 1).alias("y0"), end(F.array_max, 0).alias("x1"), end(F.array_max, 1).alias("y1"), "points",
    )


def predictions(spark, d):
    """Two models: one predicts shifted truth boxes, the other also misses some."""
    t = truth_boxes(spark, d)
    m = F.explode(F.array(F.lit("a"), F.lit("b")))
    shift = (F.col("truth_id") % 4).cast("double")
    rows = t.withColumn("model", m).filter((F.col("model") == "a") | (F.col("truth_id") % 3 != 0))
    moved = lambda c, s: (F.col(c) + s).alias(c)
    return rows.select(
        "model", "stem", "class_name", F.col("truth_id").alias("line_no"), F.concat_ws(":", "model", "key").alias("pred_id"), ((F.col("truth_id") % 89) / 89.0).alias("score"),
        moved("x0", shift), moved("y0", 0.0), moved("x1", shift), moved("y1", 0.0),
        F.transform("points", lambda p: F.array(p[0] + shift, p[1])).alias("points"),
    )


BOX_SQL = f"""truth AS (SELECT stem, label AS class_name, stem || ':' || line_no AS truth_id, line_no, list_min(list_transform(points, lambda p: p[1])) AS x0, list_min(list_transform(points, lambda p: p[2])) AS y0,
  list_max(list_transform(points, lambda p: p[1])) AS x1, list_max(list_transform(points, lambda p: p[2])) AS y1 FROM good),
preds AS (SELECT m AS model, stem, class_name, m || ':' || truth_id AS pred_id, (line_no % 89) / 89e0 AS score, x0 + line_no % 4 AS x0, y0, x1 + line_no % 4 AS x1, y1
  FROM truth, (VALUES ('a'), ('b')) t(m) WHERE m = 'a' OR line_no % 3 <> 0),
ov AS (SELECT p.model, p.class_name, p.pred_id, p.score, t.truth_id, (least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS i,
  (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS s FROM preds p JOIN truth t ON p.stem = t.stem AND p.class_name = t.class_name
  AND least(p.x1, t.x1) > greatest(p.x0, t.x0) AND least(p.y1, t.y1) > greatest(p.y0, t.y0))"""


@query("A22_box_overlap", sql([SHAPES, GOOD, BOX_SQL], f"SELECT model, pred_id, truth_id, {rs('i / (s - i)')} AS iou FROM ov"))
def _(spark, d):
    # Numbers go through the join; names of an image are made from them afterwards.
    preds = predictions(spark, d).withColumn("pred_id", F.col("line_no") * 2 + F.when(F.col("model") == "b", 1).otherwise(0))
    pairs = md.box_overlap(preds, truth_boxes(spark, d), ["stem"], 16.0).withColumn("model", F.when(F.col("pred_id") % 2 == 1, "b").otherwise("a"))
    named = lambda *parts: F.concat_ws(":", *parts)
    return pairs.select("model", named("model", "stem", F.shiftright("pred_id", 1)).alias("pred_id"), named("stem", "truth_id").alias("truth_id"), r("iou").alias("iou"))


def pred_name():
    """A prediction's full name; numbers go through the matching."""
    return F.concat_ws(":", "model", "stem", "pred_id")


EVAL = """claims AS (SELECT pred_id, arg_max(truth_id, (i / (s - i), truth_id)) AS truth_id, max(i / (s - i)) AS iou FROM ov GROUP BY 1),
steps AS (SELECT (50 + 5 * k) / 100e0 AS step FROM range(10) t(k)),
sc AS (SELECT p.model, p.class_name, p.pred_id, p.score, truth_id, step, coalesce(round(iou, 12) >= step, FALSE) AS ok FROM preds p LEFT JOIN claims USING (pred_id), steps),
tp AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY model, step, truth_id, ok ORDER BY score DESC, pred_id DESC) = 1 THEN 1 ELSE 0 END AS t FROM sc),
cur AS (SELECT *, sum(t) OVER w / count(*) OVER w AS prec FROM tp WINDOW w AS (PARTITION BY model, class_name, step ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)),
best AS (SELECT *, max(prec) OVER (PARTITION BY model, class_name, step ORDER BY score, pred_id DESC ROWS UNBOUNDED PRECEDING) AS b FROM cur),
npos AS (SELECT class_name, count(*) AS n FROM truth GROUP BY 1),
ap AS (SELECT model, class_name, step, sum(t * b) / any_value(n) AS ap FROM best JOIN npos USING (class_name) GROUP BY 1, 2, 3)"""


@query("A22_evaluate_boxes", sql([SHAPES, GOOD, BOX_SQL, EVAL], f"""SELECT model, {rs('(SELECT sum(t) / count(*) FROM tp WHERE tp.model = ap.model AND step = 5e-1)', 5)} AS precision,
  {rs('(SELECT sum(t) FROM tp WHERE tp.model = ap.model AND step = 5e-1) / (SELECT count(*) FROM truth)', 5)} AS recall, {rs('sum(CASE WHEN step = 5e-1 THEN ap END) / (SELECT count(*) FROM npos)', 5)} AS ap50,
  {rs('sum(ap) / 10 / (SELECT count(*) FROM npos)', 5)} AS ap50_95 FROM ap GROUP BY model"""))
def _(spark, d):
    preds = predictions(spark, d).withColumn("pred_id", F.col("line_no"))
    out = md.evaluate_boxes(preds, truth_boxes(spark, d), ["stem"], 16.0, 12, pred_name(), by_text=True)
    return out.select("model", *[r(c, 5).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")])


@query("A22_evaluate_masks")
def _(spark, d):
    preds = predictions(spark, d).withColumn("pred_id", F.col("line_no"))
    out = md.evaluate_masks(preds, truth_boxes(spark, d), "points", WIDTH, HEIGHT, ["stem"], pred_name(), by_text=True)
    return out.select("model", *[r(c, 4).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")])


RANK = """WITH m AS (SELECT 'run_' || o_orderpriority AS model, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE avg(o_totalprice) / 1e6 END AS m1, avg(o_custkey) / 1e5 AS m2 FROM orders GROUP BY o_orderpriority)"""


def run_metrics(spark, d):
    o = table(spark, d, "orders").groupBy(F.concat(F.lit("run_"), F.col("o_orderpriority")).alias("model"))
    m = o.agg((F.avg("o_totalprice") / 1e6).alias("mask_map50_95"), (F.avg("o_custkey") / 1e5).alias("mask_map50"))
    nan = F.when(F.col("model") == "run_5-LOW", float("nan")).otherwise(F.col("mask_map50_95"))
    return m.withColumn("mask_map50_95", nan)


@query("O1_rank_models", RANK + f" SELECT model, {rs('m1', 4)} AS mask_map50_95, {rs('m2', 4)} AS mask_map50, coalesce(m1 = (SELECT max(m1) FROM m), FALSE) AS best FROM m")
def _(spark, d):
    ranked = md.rank_models(run_metrics(spark, d))
    return ranked.select("model", F.nanvl("mask_map50_95", F.lit(None).cast("double")).alias("mask_map50_95"), "mask_map50", "best")


@query("K6_ranking_csv", RANK + f" SELECT model, {rs('m2', 4)} AS mask_map50 FROM m")
def _(spark, d):
    path = scratch_path(spark, "ranking")
    m = run_metrics(spark, d)
    rest = ("box_map50_95", "box_map50", "mask_p", "mask_r")
    sk.write_ranking(md.rank_models(m.select("model", "mask_map50_95", "mask_map50", *[F.lit(0.0).alias(c) for c in rest])), path)
    return rd.read_run_metrics(spark, path).select("model", "mask_map50")


@query("S10_run_metrics_long", RANK + f" SELECT model, 'mask_map50' AS metric, {rs('m2', 4)} AS value FROM m")
def _(spark, d):
    path = scratch_path(spark, "metrics")
    run_metrics(spark, d).drop("mask_map50_95").write.json(path)
    long = rd.read_run_metrics(spark, path, "json").unpivot(["model"], ["mask_map50", "box_map50"], "metric", "value")
    return long.filter("value IS NOT NULL").withColumn("value", r("value", 4))


# --- scoring hook ----------------------------------------------------------------------------


def ink_predictor():
    """Stand-in predictor: one box per document, sized by its text length."""

    def predict(batch: pd.DataFrame) -> list[list[dict]]:
        out = []
        for n in batch["n_chars"].astype(float):
            box = [0.0, 0.0, n % 50 + 1, n % 30 + 1]
            poly = [[0.0, 0.0], [box[2], 0.0], [box[2], box[3]]]
            out.append([{"class": CLASSES[int(n) % 3], "score": (n % 97) / 97, "bbox": box, "polygon": poly}])
        return out

    return predict


def scored(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("image"), "n_chars", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return md.score_images(docs, ink_predictor, ["image", "width", "height"])


@query("X1_score_images", "SELECT doc_id AS image, CASE n_chars % 3 WHEN 0 THEN 'cork' WHEN 1 THEN 'lighter' ELSE 'pompom' END AS class, CAST(n_chars % 50 + 1 AS DOUBLE) AS w FROM documents")
def _(spark, d):
    return scored(spark, d).select("image", F.col("detections")[0]["class"].alias("class"), F.col("detections")[0]["bbox"][2].alias("w"))


@query("X2_postprocess", f"SELECT doc_id AS image, {rs('(n_chars % 97) / 97e0', 4)} AS score FROM documents WHERE n_chars % 3 <> 2")
def _(spark, d):
    reg = rd.classes_frame(spark, CLASSES[:2])
    flat = md.tidy_records(scored(spark, d), reg)
    runs = mk.rasterize(flat.select("image", "det_no", "polygon"), "polygon", WIDTH, HEIGHT)
    return md.postprocess(flat, runs).select("image", r("score", 4).alias("score"))


@query("S6_prelabel_records", "SELECT CASE n_chars % 3 WHEN 0 THEN 'cork' WHEN 1 THEN 'lighter' ELSE 'pompom' END AS label, count(*) AS n FROM documents WHERE (n_chars % 97) / 97e0 >= 25e-2 GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "prelabels")
    scored(spark, d).withColumn("image", F.concat(F.col("image").cast("string"), F.lit(".png"))).write.json(path)
    docs = rd.prelabel_documents(rd.read_prelabels(spark, path), 0.25)
    return rd.explode_shapes(docs).filter(lb.valid_shape()).groupBy("label").agg(F.count("*").alias("n"))


# --- documents to disk and back ------------------------------------------------------------------


def documents(spark, d):
    """One annotation document per image, shapes in line order (the document is one image)."""
    one = F.struct("line_no", "label", "points", "shape_type")
    nested = shapes(spark, d).groupBy("stem").agg(F.array_sort(F.collect_list(one)).alias("_s"))
    img = images(spark, d).select("stem", "pool", "width", "height")
    body = F.transform(
        "_s",
        lambda s: F.struct(
            s["label"].alias("label"), s["points"].alias("points"), F.lit(None).cast("int").alias("group_id"),
            s["shape_type"].alias("shape_type"), F.create_map().cast("map<string,boolean>").alias("flags"),
        ),
    )
    return img.join(nested, "stem", "left").select(
        "pool", "stem", F.concat("pool", F.lit("/"), "stem", F.lit(".json")).alias("path"), F.lit("5.5.0").alias("version"),
        F.create_map().cast("map<string,boolean>").alias("flags"), F.coalesce(body, F.array().cast(body_type())).alias("shapes"),
        F.concat("stem", F.lit(".png")).alias("imagePath"), F.lit(None).cast("string").alias("imageData"), F.col("height").alias("imageHeight"), F.col("width").alias("imageWidth"),
    )


def body_type() -> str:
    return "array<struct<label:string,points:array<array<double>>,group_id:int,shape_type:string,flags:map<string,boolean>>>"


@query("S1_read_labelme", sql([IMAGES, SHAPES], f"SELECT pool, trim(label) AS label, count(*) AS n, count(*) FILTER ({VALID}) AS n_valid FROM shapes JOIN images USING (stem) GROUP BY 1, 2"))
def _(spark, d):
    path = scratch_path(spark, "labelme")
    sk.write_labelme(documents(spark, d), path)
    back = rd.explode_shapes(rd.read_labelme(spark, path, "lines"))
    return back.groupBy("pool", "label").agg(F.count("*").alias("n"), F.count_if(lb.valid_shape()).alias("n_valid"))


@query("K1_labelme_documents", sql([IMAGES, SHAPES], "SELECT stem, coalesce(n, 0) AS n_shapes, width FROM images LEFT JOIN (SELECT stem, count(*) AS n FROM shapes GROUP BY 1) USING (stem)"))
def _(spark, d):
    text = documents(spark, d).select("stem", sk.labelme_document().alias("text"))
    back = F.from_json("text", rd.schemas.LABELME)
    return text.withColumn("_b", back).select("stem", F.size("_b.shapes").cast("bigint").alias("n_shapes"), F.col("_b.imageWidth").alias("width"))


@query("K2_write_yolo", sql([IMAGES, SHAPES, CLASS_ROWS], f"SELECT split, class_id, count(*) AS n FROM images LEFT JOIN (SELECT stem, class_id FROM shapes JOIN classes ON name = trim(label) WHERE {VALID}) USING (stem) GROUP BY 1, 2"))
def _(spark, d):
    path = scratch_path(spark, "yolo")
    sized = shapes(spark, d).withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
    lines = ds.label_lines(sized, rd.classes_frame(spark, CLASSES), ["stem"])
    sk.write_yolo(images(spark, d).select("split", "stem").join(lines, "stem", "left"), path)
    back = spark.read.schema("split STRING, stem STRING, line_no BIGINT, class_id INT, line STRING").json(path)
    return back.groupBy("split", "class_id").agg(F.count("*").alias("n"))


@query("K3_manifest", """SELECT n_nationkey AS class_id, n_name AS name FROM nation""")
def _(spark, d):
    path = scratch_path(spark, "manifest")
    reg = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    sk.write_manifest(reg, path)
    return rd.read_classes(spark, path).select("class_id", "name")


@query("S5_class_registry", "SELECT n_nationkey AS class_id, n_name AS name, n_name AS prompt FROM nation")
def _(spark, d):
    names = [row[0] for row in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]  # the registry itself
    return rd.classes_frame(spark, names)


@query("K5_points_table", sql(PIXELS, f"SELECT class_id, count(*) AS n, {rs('sum(depth_m)', 4)} AS depth FROM pixels WHERE inst_id > 0 GROUP BY 1"))
def _(spark, d):
    path = scratch_path(spark, "points")
    pts = pixels(spark, d).filter("inst_id > 0").withColumn("capture_id", F.concat(F.lit("capture_"), F.col("class_id")))
    sk.write_points(pts.repartition("capture_id"), path, pts.groupBy("capture_id").agg(F.count("*").alias("point_count")))
    return sk.read_points(spark, path).groupBy("class_id").agg(F.count("*").alias("n"), r(F.sum("depth_m"), 4).alias("depth"))


@query("K8_overwrite_captures", "SELECT p_brand AS capture_id, count(*) AS n, CAST(sum(CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 2 ELSE 1 END) AS BIGINT) AS version FROM part GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "captures")
    part = table(spark, d, "part").select(F.col("p_brand").alias("capture_id"), "p_partkey")
    sk.overwrite_captures(part.withColumn("version", F.lit(1)).repartition("capture_id"), path)
    sk.overwrite_captures(part.filter("capture_id IN ('Brand#1', 'Brand#2')").withColumn("version", F.lit(2)).repartition("capture_id"), path)
    back = spark.read.schema("p_partkey BIGINT, version INT, capture_id STRING").parquet(path)
    return back.groupBy("capture_id").agg(F.count("*").alias("n"), F.sum("version").alias("version"))


@query("K7_ply_lines", sql(PIXELS, "SELECT capture_id, count(*) + 1 AS n_lines FROM pixels WHERE inst_id > 0 GROUP BY 1"))
def _(spark, d):
    pts = pixels(spark, d).filter("inst_id > 0").withColumns({"x": F.col("u") / 8.0, "y": F.col("v") / 8.0, "z": F.col("depth_m"), "point_id": F.col("v") * 8 + F.col("u")})
    return sk.ply_lines(pts).groupBy("capture_id").agg(F.count("line").alias("n_lines"))


@query("K4_frame_records", sql(DETS, f"""SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS n, {rs('sum(round_even(confidence, 6))', 4)} AS confidence, {rs('sum(round_even(cy, 6))', 4)} AS y FROM dets WHERE in_workspace GROUP BY 1"""))
def _(spark, d):
    from rigtable.catalog.tracking import stream_detections
    from rigtable.operators.tracking import frame_records

    dets = stream_detections(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    path = scratch_path(spark, "frames")
    sk.write_frames(dets, path, f"{path}.state", once=True).awaitTermination()
    seen = spark.read.schema(frame_records(dets).schema).json(path).select("session_id", "detection.*")
    return seen.groupBy("session_id").agg(F.count("class_name").alias("n"), r(F.sum("confidence"), 4).alias("confidence"), r(F.sum(F.col("center_camera_xyz_m")[1]), 4).alias("y"))


@query("S2_image_inventory", "SELECT source AS pool, CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS suffix, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    root = scratch_path(spark, "pool")
    name = F.concat("source", F.lit("/"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".JPG").otherwise(".png"))
    rows = table(spark, d, "documents").select(name.alias("file"), F.lit("x").alias("text"))
    notes = rows.select(F.concat("file", F.lit(".txt")).alias("file"), "text")
    sk.write_text_files(rows.unionByName(notes), root).agg(F.sum("lines")).first()
    return rd.list_images(spark, root).groupBy("pool", "suffix").agg(F.countDistinct("stem").alias("n"))


# --- captures --------------------------------------------------------------------------------------


def capture_files(spark, d):
    """The files of a capture folder, written as path and content rows."""

    def make(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for vec_id, emb in zip(batch["vec_id"], batch["embedding"]):
                base = f"/captures/{vec_id}"
                depth = (np.asarray(emb, dtype="float32").reshape(8, 8) + np.float32(0.5))[: 7 if vec_id % 9 == 0 else 8]
                intr = b"width: 8\nheight: 8\nfx: 10.0\nfy: 10.0\nppx: 3.5\nppy: 3.5\nmodel: none\ncoeffs: [0, 0, 0, 0, 0]\n"
                png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (8).to_bytes(4, "big") + (8).to_bytes(4, "big")
                parts = {"rgb.png": png, "depth.npy": rd.npy_bytes(depth), "intrinsics.yaml": intr, "rgb.json": b"{}"}
                if vec_id % 7 == 0:
                    parts.pop("depth.npy")
                rows += [(f"{base}/{n}", c) for n, c in parts.items()]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(make, "path STRING, content BINARY")


@query("S7_gather_captures", "SELECT CAST(vec_id AS VARCHAR) AS capture_id, CASE WHEN vec_id % 7 = 0 THEN 'missing depth' ELSE 'ok' END AS reason FROM embeddings")
def _(spark, d):
    ok, bad = rd.gather_captures(capture_files(spark, d))
    return ok.select("capture_id", F.lit("ok").alias("reason")).unionByName(bad.drop("folder"))


@query("S8_explode_depth", f"""SELECT CAST(vec_id AS VARCHAR) AS capture_id, vec_id % 9 <> 0 AS shape_ok, CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 64 END AS n,
  CASE WHEN vec_id % 9 <> 0 THEN {rs('list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 5e-1))', 3)} END AS depth FROM embeddings WHERE vec_id % 7 <> 0""")
def _(spark, d):
    ok, _ = rd.gather_captures(capture_files(spark, d))
    px = rd.explode_depth(ok.withColumn("intrinsics", rd.parse_intrinsics("intrinsics")))
    return px.groupBy("capture_id", "shape_ok").agg(F.count("*").cast("int").alias("n"), r(F.sum(F.col("depth_m").cast("double")), 3).alias("depth"))


@query("S13_fill_sizes", "SELECT CAST(vec_id AS VARCHAR) AS stem, CASE WHEN vec_id % 2 = 0 THEN 64 ELSE 8 END AS width FROM embeddings")
def _(spark, d):
    files = capture_files(spark, d).filter(F.col("path").endswith(".png")).select(F.element_at(F.split("path", "/"), -2).alias("stem"), "content")
    docs = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("stem"), F.when(F.col("vec_id") % 2 == 0, 64).alias("imageWidth"), F.when(F.col("vec_id") % 2 == 0, 48).alias("imageHeight")
    )
    return rd.fill_sizes(docs, files, ["stem"]).select("stem", F.col("imageWidth").alias("width"))


@query("S9_sessions", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) + 1 AS n, count(*) AS top FROM events GROUP BY 1")
def _(spark, d):
    det = detections(spark, d)
    eye = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(4)]) for i in range(4)])
    one = det.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.min("ts").alias("taken_at"))
    sample = lambda index: F.struct(index.alias("index"), F.lit("f.png").alias("image"), eye.alias("base_T_ee"), F.lit(9).alias("n_corners"))
    head = ["session_id", F.lit("base").alias("base_frame"), F.lit("ee").alias("ee_frame"), F.lit("board.json").alias("board")]
    path = scratch_path(spark, "sessions")
    sk.write_sessions(one.select(*head, F.array(sample(F.lit(0))).alias("samples")), path)
    old = rd.read_sessions(spark, path, "lines")
    new = det.withColumn("session_id", F.col("session_id").cast("string")).select(
        *head, F.lit(None).cast("int").alias("index"), F.lit("f.png").alias("image"), eye.alias("base_T_ee"), F.lit(9).alias("n_corners"), F.col("ts").alias("taken_at")
    )
    return rd.resume_session(old, new).groupBy("session_id").agg(F.count("*").alias("n"), F.max("index").cast("bigint").alias("top"))


@query("S12_joint_states_stream", "SELECT CAST(user_id AS VARCHAR) AS robot_id, 2 * count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    from rigtable.catalog.robot import states
    from rigtable.operators.robot import unnest_joints

    path = scratch_path(spark, "joints")
    states(spark, d).drop("det_idx").write.json(path)
    out = drain(unnest_joints(rd.stream_joint_states(spark, path)))
    return out.groupBy("robot_id").agg(F.count("*").alias("n"))


@query("S14_arm_status_stream", "SELECT CAST(user_id AS VARCHAR) AS robot_id, count(*) * 2 AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS codes FROM events GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "status")
    det = detections(spark, d)
    det.select(
        F.col("session_id").cast("string").alias("robot_id"), "ts", F.lit("pos").alias("mode"), F.lit(True).alias("enabled"), F.lit(True).alias("control_loop_active"),
        F.lit("IDLE").alias("state_machine"), F.array(F.lit("j1"), F.lit("j2")).alias("joint_names"), F.array(F.col("k"), F.lit(0)).alias("per_joint_status_code"),
        F.array().cast("array<string>").alias("error_codes"),
    ).write.json(path)
    out = drain(rd.unnest_status(rd.stream_arm_status(spark, path)))
    return out.groupBy("robot_id").agg(F.count("*").alias("n"), F.sum("status_code").alias("codes"))


