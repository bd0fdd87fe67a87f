"""Annotation queries: counting, pairing, merging, pools, splits, quality and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigtable.catalog.bind import (
    CLASSES, GOOD, HEIGHT, IMAGES, OVERLAP, SHAPES, VALID, WIDTH, images, r, rs, runs_sql, shapes, sql, table,
)
from rigtable.functions import text as tx
from rigtable.operators import calib
from rigtable.operators import labels as lb
from rigtable.operators import masks as mk
from rigtable.operators import quality as qc
from rigtable.plans import dataset as ds
from rigtable.sources.readers import classes_frame, parse_yolo

QUERIES: dict = {}
SQL: dict = {}
SIZED = [IMAGES, SHAPES]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def classes(spark):
    return classes_frame(spark, CLASSES)


CLASS_ROWS = "classes AS (SELECT * FROM (VALUES (0, 'cork'), (1, 'lighter'), (2, 'pompom')) t(class_id, name))"


# --- predicates ---------------------------------------------------------------------


@query("P1_valid_shape", sql(SHAPES, f"""SELECT stem, count(*) AS n, count(*) FILTER ({VALID}) AS n_valid,
  count(*) FILTER (NOT ({VALID}) AND (trim(label) <> '' OR len(points) > 0)) AS n_skipped FROM shapes GROUP BY stem"""))
def _(spark, d):
    return shapes(spark, d).groupBy("stem").agg(
        F.count("*").alias("n"), F.count_if(lb.valid_shape()).alias("n_valid"), F.count_if(lb.skipped_shape()).alias("n_skipped")
    )


@query("P2_split_occluders", sql(SHAPES, "SELECT starts_with(trim(label), '_') AS occluder, label, count(*) AS n FROM shapes GROUP BY ALL"))
def _(spark, d):
    objects, occluders = lb.split_occluders(shapes(spark, d))
    both = objects.withColumn("occluder", F.lit(False)).unionByName(occluders.withColumn("occluder", F.lit(True)))
    return both.groupBy("occluder", "label").agg(F.count("*").alias("n"))


@query("P3_normalize_polygon", sql([*SIZED, CLASS_ROWS], f"""SELECT stem, line_no, class_id || ' ' || list_aggregate(list_transform(points, lambda p:
  printf('%.6f %.6f', greatest(0e0, least(1e0, p[1] / width)), greatest(0e0, least(1e0, p[2] / height)))), 'string_agg', ' ') AS line
  FROM shapes JOIN images USING (stem) JOIN classes ON name = trim(label) WHERE {VALID} AND width > 0"""))
def _(spark, d):
    sized, _ = lb.require_size(images(spark, d).select("stem", "width", "height"))
    return ds.label_lines(shapes(spark, d).join(sized, "stem"), classes(spark), ["stem"]).select("stem", "line_no", "line")


@query("P4_require_size", sql(IMAGES, "SELECT pool, CASE WHEN width > 0 AND height > 0 THEN 'ok' ELSE 'invalid image size' END AS reason, count(*) AS n FROM images GROUP BY ALL"))
def _(spark, d):
    ok, bad = lb.require_size(images(spark, d))
    return ok.withColumn("reason", F.lit("ok")).unionByName(bad).groupBy("pool", "reason").agg(F.count("*").alias("n"))


@query("P5_check_labels", sql([SHAPES, CLASS_ROWS], """SELECT trim(label) AS label, trim(label) IN (SELECT name FROM classes) AS known, count(*) AS n FROM shapes
  WHERE trim(label) <> '' GROUP BY ALL"""))
def _(spark, d):
    known, unknown = lb.check_labels(shapes(spark, d), classes(spark), "warn")
    counts = known.groupBy("label").agg(F.count("*").alias("n")).withColumn("known", F.lit(True))
    return counts.unionByName(unknown.withColumn("known", F.lit(False)))


@query("P6_filter_detections", "SELECT p_partkey, p_type, p_size FROM part WHERE coalesce(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 50e0 END, 1) >= 4e-1 AND p_type = 'ECONOMY'")
def _(spark, d):
    scored = table(spark, d, "part").withColumn("score", F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50.0))
    return lb.filter_detections(scored, 0.4, "ECONOMY", "score", "p_type").select("p_partkey", "p_type", "p_size")


@query("P17_scope_captures", "SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def _(spark, d):
    return lb.scope_captures(table(spark, d, "customer"), "c_name", prefix="Customer#0000001").select("c_name")


# --- joins ----------------------------------------------------------------------------


@query("J1_pair_images", sql(SIZED, """SELECT coalesce(i.pool, l.pool) AS pool, coalesce(i.stem, l.stem) AS stem,
  CASE WHEN i.stem IS NULL THEN 'label without image' WHEN l.stem IS NULL THEN 'image without label' ELSE 'paired' END AS status
  FROM images i FULL JOIN (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS pool, CAST(l_orderkey AS VARCHAR) AS stem
  FROM lineitem) l ON i.pool = l.pool AND i.stem = l.stem"""))
def _(spark, d):
    labels = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("pool"), F.col("l_orderkey").cast("string").alias("stem")
    )
    return lb.pair_images(images(spark, d), labels)


@query("J2_coverage", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left only' WHEN d.doc_id IS NULL THEN 'right only' ELSE 'both' END AS side
  FROM documents d FULL JOIN (SELECT DISTINCT doc_id + 100 * quality AS doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def _(spark, d):
    right = table(spark, d, "labels").select((F.col("doc_id") + F.col("quality") * 100).alias("doc_id"))
    return lb.coverage(table(spark, d, "documents"), right, "doc_id")


@query("J3_reconcile", sql([*SIZED, GOOD], """SELECT stem, label, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_b, 0) - coalesce(n_a, 0) AS delta FROM
  (SELECT stem, trim(label) AS label, count(*) AS n_a FROM shapes GROUP BY ALL) FULL JOIN (SELECT stem, label, count(*) AS n_b FROM good GROUP BY ALL) USING (stem, label)"""))
def _(spark, d):
    all_ = shapes(spark, d).withColumn("label", F.trim("label"))
    return lb.reconcile(all_, all_.filter(lb.valid_shape()), ["stem", "label"])


@query("J4_attach_class", "SELECT c_custkey, coalesce(n_name, 'id_' || (c_nationkey + c_custkey % 3)) AS class_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + c_custkey % 3")
def _(spark, d):
    reg = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("int").alias("class_id"))
    return lb.attach_class(rows, reg).select("c_custkey", "class_name")


@query("J5_class_option", "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 15e-1 WHEN 'standard' THEN 2e0 ELSE 1e0 END AS option FROM part")
def _(spark, d):
    opts = spark.createDataFrame([("Economy", 1.5), ("STANDARD", 2.0)], "class_name STRING, option DOUBLE")
    return lb.class_option(table(spark, d, "part"), opts, F.lit(1.0), "p_type").select("p_partkey", "option")


@query("J6_resolve_background", """SELECT c_custkey AS capture_id, c_custkey AS background_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  THEN 'dedicated' ELSE 'self' END AS source FROM customer""")
def _(spark, d):
    bg = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("capture_id"))
    caps = table(spark, d, "customer").select(F.col("c_custkey").alias("capture_id"))
    return lb.resolve_background(caps, bg, self_background=True)


@query("J7_pending_background", """SELECT c_nationkey, min(c_custkey) AS pending_id, count(*) AS n_pending FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_nationkey""")
def _(spark, d):
    bg = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lb.pending_background(table(spark, d, "customer").select("c_custkey", "c_nationkey"), bg, "c_custkey", ["c_nationkey"])


@query("J8_only_new", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, d):
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source")
    return lb.only_new(docs, lab.filter("quality = 1"), ["doc_id"], labeled=lab.filter("toxic = 1"))


def _promote_sql(overwrite: bool) -> str:
    differs = "updated" if overwrite else "kept"
    takes = "'promoted', 'updated'"
    return f"""WITH review AS (SELECT CAST(o_custkey AS VARCHAR) AS stem, max(o_orderstatus) AS content FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
  pool AS (SELECT CAST(o_custkey AS VARCHAR) AS stem, max(o_orderstatus) AS content FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
  caps AS (SELECT CAST(c_custkey AS VARCHAR) AS stem FROM customer WHERE c_acctbal > 0),
  m AS (SELECT coalesce(n.stem, o.stem) AS stem, n.content AS nc, o.content AS oc, c.stem IS NOT NULL AS cap FROM review n FULL JOIN pool o ON n.stem = o.stem
    LEFT JOIN caps c ON c.stem = coalesce(n.stem, o.stem)),
  a AS (SELECT *, CASE WHEN nc IS NULL THEN 'pool' WHEN NOT cap THEN 'missing' WHEN oc IS NULL THEN 'promoted' WHEN oc = nc THEN 'same' ELSE '{differs}' END AS action FROM m)
  SELECT stem, action, CASE WHEN action IN ({takes}) THEN nc ELSE oc END AS content FROM a"""


def _promote(spark, d, overwrite):
    o = table(spark, d, "orders")
    side = lambda cond: o.filter(cond).groupBy(F.col("o_custkey").cast("string").alias("stem")).agg(F.max("o_orderstatus").alias("content"))
    caps = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("stem"))
    return lb.promote(side("o_orderpriority <> '5-LOW'"), side("o_orderstatus <> 'P'"), caps, overwrite=overwrite)


@query("J9_promote", _promote_sql(False))
def _(spark, d):
    return _promote(spark, d, False)


@query("J9_promote_overwrite", _promote_sql(True))
def _(spark, d):
    return _promote(spark, d, True)


@query("J22_repair_paths", """WITH files AS (SELECT 's' || o_custkey AS session_id, '/data/s' || o_custkey || '/' || o_orderkey || '.png' AS path FROM orders WHERE o_orderstatus <> 'P'),
  want AS (SELECT o_orderkey AS no, 's' || o_custkey AS session_id, CASE WHEN o_orderkey % 2 = 0 THEN '/data/s' || o_custkey ELSE '/old/home' END || '/' || o_orderkey || '.png' AS path FROM orders)
  SELECT no, coalesce(e.path, l.path) AS resolved FROM want w LEFT JOIN files e ON e.path = w.path LEFT JOIN files l ON l.session_id = w.session_id
  AND split_part(l.path, '/', -1) = split_part(w.path, '/', -1)""")
def _(spark, d):
    o = table(spark, d, "orders")
    sess = F.concat(F.lit("s"), F.col("o_custkey"))
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".png"))
    files = o.filter("o_orderstatus <> 'P'").select(sess.alias("session_id"), F.concat(F.lit("/data/"), sess, F.lit("/"), name).alias("path"))
    home = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/data/"), sess)).otherwise("/old/home")
    rows = o.select(F.col("o_orderkey").alias("no"), sess.alias("session_id"), F.concat(home, F.lit("/"), name).alias("path"))
    return lb.repair_paths(rows, files).select("no", "resolved")


# --- counting ----------------------------------------------------------------------------


@query("A1_instance_counts", sql([*SIZED, GOOD], """SELECT CASE WHEN grouping(stem) = 0 AND grouping(label) = 0 THEN 'stem+label' WHEN grouping(stem) = 0 THEN 'stem'
  WHEN grouping(split) = 0 AND grouping(label) = 0 THEN 'label+split' WHEN grouping(label) = 0 THEN 'label' WHEN grouping(split) = 0 THEN 'split' ELSE 'total' END AS level,
  stem, label, split, count(*) AS n FROM good JOIN images USING (stem) GROUP BY GROUPING SETS ((stem, label), (stem), (label), (), (split), (split, label))"""))
def _(spark, d):
    joined = shapes(spark, d).join(images(spark, d).select("stem", "split"), "stem")
    return lb.instance_counts(joined, split="split")


@query("A2_size_frequency", sql(IMAGES, "SELECT width, height, count(*) AS n FROM images WHERE width > 0 GROUP BY ALL"))
def _(spark, d):
    return lb.size_frequency(images(spark, d))


@query("A3_shape_types", sql(SHAPES, f"SELECT shape_type, count(*) AS n, count(*) FILTER (NOT ({VALID}) AND (trim(label) <> '' OR len(points) > 0)) AS n_skipped FROM shapes GROUP BY ALL"))
def _(spark, d):
    return lb.shape_types(shapes(spark, d))


PER_IMAGE = "per AS (SELECT i.stem, count(g.stem) AS n FROM images i LEFT JOIN good g ON g.stem = i.stem GROUP BY 1)"


@query("A4_per_image_stats", sql([*SIZED, GOOD, PER_IMAGE], f"SELECT count(*) FILTER (n = 0) AS n_empty, min(n) AS min_n, max(n) AS max_n, {rs('avg(n)')} AS mean_n FROM per"))
def _(spark, d):
    return lb.per_image_stats(images(spark, d), shapes(spark, d)).withColumn("mean_n", r("mean_n"))


@query("A4_per_image_histogram", sql([*SIZED, GOOD, PER_IMAGE], "SELECT n, count(*) AS images FROM per GROUP BY n"))
def _(spark, d):
    return lb.per_image_histogram(images(spark, d), shapes(spark, d))


@query("A5_class_combos", sql([*SIZED, GOOD], """SELECT coalesce(classes, '') AS classes, count(*) AS images FROM images LEFT JOIN
  (SELECT stem, string_agg(label, ',' ORDER BY label) AS classes FROM (SELECT DISTINCT stem, label FROM good) GROUP BY stem) USING (stem) GROUP BY 1"""))
def _(spark, d):
    return lb.class_combos(images(spark, d), shapes(spark, d))


@query("A6_dedup_stem", """WITH f AS (SELECT l_suppkey AS pool, l_partkey AS stem, l_orderkey * 10 + l_linenumber AS path FROM lineitem)
  SELECT pool, stem, path, path = min(path) OVER (PARTITION BY pool, stem) AS kept FROM f""")
def _(spark, d):
    files = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("pool"), F.col("l_partkey").alias("stem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path")
    )
    return lb.dedup_stem(files)


@query("A7_discover_classes", sql(SHAPES, "SELECT DISTINCT trim(label) AS name FROM shapes WHERE trim(label) <> ''"))
def _(spark, d):
    return lb.discover_classes(shapes(spark, d))


@query("A17_job_summary", sql([*SIZED, GOOD, PER_IMAGE], """SELECT CASE WHEN width = 0 THEN 'failed' WHEN n = 0 THEN 'skipped' ELSE 'exported' END AS status, count(*) AS n, CAST(sum(n) AS BIGINT) AS shapes
  FROM per JOIN images USING (stem) GROUP BY 1"""))
def _(spark, d):
    per = lb.instances_per_image(images(spark, d), shapes(spark, d)).join(images(spark, d).select("stem", "width"), "stem")
    status = per.withColumn("status", F.when(F.col("width") == 0, "failed").when(F.col("n") == 0, "skipped").otherwise("exported"))
    return lb.job_summary(status.withColumnRenamed("n", "k"), "status", "k")


@query("W4_number_instances", sql([SHAPES, GOOD], "SELECT stem, line_no, CAST(row_number() OVER (PARTITION BY stem ORDER BY line_no) AS INTEGER) AS instance_id FROM good WHERE label NOT LIKE '\\_%' ESCAPE '\\'"))
def _(spark, d):
    good = shapes(spark, d).filter(lb.valid_shape() & ~lb.is_occluder())
    return lb.number_instances(good.select("stem", "line_no"))


@query("W4_next_capture_no", "SELECT c_nationkey, coalesce(max(CAST(substr(c_name, 10) AS BIGINT)), 0) + 1 AS next_no FROM customer GROUP BY 1")
def _(spark, d):
    no = tx.capture_no(F.replace("c_name", F.lit("Customer#"), F.lit("capture_")))
    return lb.next_capture_no(table(spark, d, "customer"), no, ["c_nationkey"])


@query("O3_latest", "SELECT o_custkey, arg_max(p, (o_orderdate, p)) AS path, max(o_orderdate)::DATE::VARCHAR AS mtime FROM (SELECT *, 'runs/' || lpad(o_orderkey::VARCHAR, 9, '0') || '/best.pt' AS p FROM orders) GROUP BY 1")
def _(spark, d):
    path = F.concat(F.lit("runs/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("/best.pt"))
    files = table(spark, d, "orders").select("o_custkey", path.alias("path"), F.col("o_orderdate").alias("mtime"))
    return calib.latest(files, ["o_custkey"], "path", "mtime").withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd"))


@query("O7_preview", "SELECT stem, (SELECT count(*) FROM orders) - 8 AS more FROM (SELECT CAST(o_orderkey AS VARCHAR) AS stem FROM orders ORDER BY 1 LIMIT 8)")
def _(spark, d):
    return lb.preview(images(spark, d).select("stem"), [F.col("stem")], 8)


# --- pools, sets, splits --------------------------------------------------------------------


@query("U1_compose_pools", """SELECT out_stem, origin, source FROM (SELECT CAST(doc_id AS VARCHAR) AS out_stem, 'real' AS origin, source FROM documents
  UNION ALL SELECT 'point__' || item_id, 'point', 'benchmark' FROM benchmark UNION ALL SELECT '3dgs__' || page_id, '3dgs', 'pages' FROM pages)""")
def _(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), "source")
    point = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("stem"), F.lit("benchmark").alias("source"))
    dgs = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("stem"), F.lit("pages").alias("source"))
    return lb.compose_pools(doc, {"point": point, "3dgs": dgs}, "all").select("out_stem", "origin", "source")


@query("U2_set_diff", """SELECT doc_id, CASE WHEN b.k IS NULL THEN 'left only' WHEN a.k IS NULL THEN 'right only' ELSE 'common' END AS side FROM
  (SELECT DISTINCT doc_id, 1 AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id + 3 AS doc_id, 1 AS k FROM labels) b USING (doc_id)""")
def _(spark, d):
    return lb.set_diff(table(spark, d, "documents"), table(spark, d, "labels").select((F.col("doc_id") + 3).alias("doc_id")), "doc_id")


MIX = "(no * 2654435761 + 12345) % 1125899906842597"


@query("U4_split_dataset", sql([*SIZED], f"""SELECT stem, CASE WHEN row_number() OVER (ORDER BY ((h >> 40) % 4096 + 4096) % 4096, h, stem) <= least(greatest(1, round_even(n * 2e-1, 0)), n - 1)
  THEN 'val' ELSE 'train' END AS split FROM (SELECT stem, {MIX} AS h, count(*) OVER () AS n FROM images)"""))
def _(spark, d):
    img = images(spark, d).withColumn("no", F.col("stem").cast("long"))
    return lb.split_dataset(img, shapes(spark, d), 0.2, 42, order=F.expr(MIX.replace("no", "cast(stem as bigint)")))


@query("convert_dataset", sql([*SIZED, CLASS_ROWS, f"""sp AS (SELECT stem, width, height, CASE WHEN row_number() OVER (ORDER BY ((h >> 40) % 4096 + 4096) % 4096, h, stem)
  <= least(greatest(1, round_even(n * 2e-1, 0)), n - 1) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, {MIX} AS h, count(*) OVER () AS n FROM images))""",
  f"li AS (SELECT stem, line_no, class_id FROM shapes JOIN classes ON name = trim(label) WHERE {VALID})"],
  "SELECT split, class_id, count(*) AS n_lines, count(DISTINCT stem) AS n_images FROM sp LEFT JOIN li USING (stem) GROUP BY ALL"))
def _(spark, d):
    img = images(spark, d)
    shp = shapes(spark, d).join(img.select("stem", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")), "stem").withColumn("origin", F.lit("real"))
    lines = ds.convert(img.select("stem"), {}, shp, classes(spark), "real", order=F.expr(MIX.replace("no", "cast(stem as bigint)")))
    return lines.groupBy("split", "class_id").agg(F.count("*").alias("n_lines"), F.countDistinct("stem").alias("n_images"))


# --- masks --------------------------------------------------------------------------------------

RUNS = runs_sql("good", "runs", "stem, line_no, label", WIDTH, HEIGHT)


def good_shapes(spark, d):
    return shapes(spark, d).filter(lb.valid_shape()).select("stem", "line_no", F.trim("label").alias("label"), "points")


def shape_runs(spark, d):
    return mk.rasterize(good_shapes(spark, d), "points", WIDTH, HEIGHT)


@query("M1_rasterize", sql([SHAPES, GOOD, RUNS], "SELECT stem, line_no, v, u0, u1 FROM runs"))
def _(spark, d):
    return shape_runs(spark, d).drop("label")


@query("X4_raster_table_function", sql([SHAPES, GOOD, RUNS], """SELECT stem, line_no, count(*) AS n_runs, CAST(sum(u1 - u0 + 1) AS BIGINT) AS area, CAST(sum(v * (u0 + u1)) AS BIGINT) AS moment
  FROM runs GROUP BY 1, 2"""))
def _(spark, d):
    mk.register_raster_runs(spark)
    # The calls are the work, not the bytes: a small file would be one task.
    spread = good_shapes(spark, d).repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(
        "SELECT s.stem, s.line_no, count(*) AS n_runs, sum(r.u1 - r.u0 + 1) AS area, sum(r.v * (r.u0 + r.u1)) AS moment"
        " FROM {shapes} s, LATERAL raster_runs(s.points, {width}, {height}) r GROUP BY s.stem, s.line_no",
        shapes=spread, width=WIDTH, height=HEIGHT,
    )


@query("X4_raster_runs_per_image", sql([SHAPES, GOOD, RUNS], "SELECT stem, count(*) AS n_runs, CAST(sum(u1 - u0 + 1) AS BIGINT) AS area FROM runs GROUP BY 1"))
def _(spark, d):
    return shape_runs(spark, d).groupBy("stem").agg(F.count("*").alias("n_runs"), F.sum(F.col("u1") - F.col("u0") + 1).alias("area"))


@query("U3_union_masks", sql([SHAPES, GOOD, RUNS], """SELECT stem, CAST(count(*) AS BIGINT) AS area FROM (SELECT DISTINCT stem, v, unnest(range(u0, u1 + 1)) AS u FROM runs) GROUP BY 1"""))
def _(spark, d):
    return mk.mask_area(mk.union_masks(shape_runs(spark, d), ["stem"]), ["stem"])


PIX = "pix AS (SELECT stem, label, v, unnest(range(u0, u1 + 1)) AS u FROM runs)"


@query("U3_subtract_mask", sql([SHAPES, GOOD, RUNS, PIX], """SELECT stem, count(*) AS area FROM (SELECT DISTINCT stem, u, v FROM pix WHERE label <> '_gripper' EXCEPT
  SELECT DISTINCT stem, u, v FROM pix WHERE label = '_gripper') GROUP BY 1"""))
def _(spark, d):
    runs = shape_runs(spark, d)
    return mk.mask_area(mk.subtract_runs(runs.filter("label <> '_gripper'"), runs.filter("label = '_gripper'"), ["stem"]), ["stem"])


@query("M2_resize_mask", sql([SHAPES, GOOD, RUNS, "pixel AS (SELECT stem, line_no, v, unnest(range(u0, u1 + 1)) AS u FROM runs)"], f"""SELECT stem, line_no, count(*) AS area, CAST(sum(du) AS BIGINT) AS su FROM
  (SELECT du, dv, du * {WIDTH} // 40 AS u, dv * {HEIGHT} // 36 AS v FROM range(40) a(du), range(36) b(dv)) g JOIN pixel p ON p.u = g.u AND p.v = g.v GROUP BY 1, 2"""))
def _(spark, d):
    small = mk.resize_runs(shape_runs(spark, d).drop("label"), (WIDTH, HEIGHT), (40, 36))
    n = F.col("u1") - F.col("u0") + 1
    return small.groupBy("stem", "line_no").agg(F.sum(n).cast("bigint").alias("area"), F.sum(((F.col("u0") + F.col("u1")) * n / 2).cast("bigint")).alias("su"))


@query("J10_mask_overlap", sql([SHAPES, GOOD, RUNS, OVERLAP], f"SELECT stem, i, j, inter, {rs('iou')} AS iou, {rs('cont')} AS cont FROM pairs"))
def _(spark, d):
    pairs = mk.mask_overlap(shape_runs(spark, d), ["stem"], "line_no")
    return pairs.select("stem", "i", "j", "inter", r("iou").alias("iou"), r("cont").alias("cont"))


# One step a detection, from the strongest of its image and label on: it stays unless one that stayed overlaps it.
_DEDUP_SQL = sql([SHAPES, GOOD, RUNS, OVERLAP], """near AS (SELECT p.stem, p.i, p.j FROM pairs p JOIN good x ON x.stem = p.stem AND x.line_no = p.i JOIN good y ON y.stem = p.stem AND y.line_no = p.j
  WHERE x.label = y.label AND iou >= 3e-1),
both_ways AS (SELECT stem, i AS line_no, j AS other FROM near UNION ALL SELECT stem, j, i FROM near),
ranked AS (SELECT g.stem, g.line_no, g.label, row_number() OVER (PARTITION BY g.stem, g.label ORDER BY (g.line_no % 97) / 97e0 DESC, g.line_no) AS n,
  coalesce(others, []) AS others FROM good g LEFT JOIN (SELECT stem, line_no, list(other) AS others FROM both_ways GROUP BY ALL) b ON b.stem = g.stem AND b.line_no = g.line_no),
walk AS (SELECT stem, label, 0::BIGINT AS n, []::BIGINT[] AS kept FROM ranked GROUP BY ALL
  UNION ALL SELECT w.stem, w.label, r.n, CASE WHEN list_has_any(r.others, w.kept) THEN w.kept ELSE list_append(w.kept, r.line_no) END
  FROM walk w JOIN ranked r ON r.stem = w.stem AND r.label = w.label AND r.n = w.n + 1)
SELECT stem, label, unnest(kept) AS line_no FROM (SELECT stem, label, arg_max(kept, n) AS kept FROM walk GROUP BY ALL)""")
_DEDUP_SQL = _DEDUP_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("y.stem = s.stem AND y.line_no = s.j)\nnear AS", "y.stem = s.stem AND y.line_no = s.j),\nnear AS")


@query("O9_dedup_masks", _DEDUP_SQL)
def _(spark, d):
    dets = good_shapes(spark, d).withColumn("score", (F.col("line_no") % 97) / 97.0)
    kept = mk.dedup_masks(dets, shape_runs(spark, d).drop("label"), 0.3, ["stem"], "line_no", "label")
    return kept.select("stem", "line_no", "label")


# --- quality ----------------------------------------------------------------------------------------

CANVAS = 96
YOLO = [
    *SIZED, CLASS_ROWS,
    f"""labels AS (SELECT split, stem, line_no, coalesce(class_id, 9) AS class_id, list_transform(points, lambda p: [p[1] / 60, p[2] / 45]) AS poly
  FROM shapes LEFT JOIN classes ON name = trim(label) JOIN images USING (stem))""",
]
YOLO_RUNS = [
    f"polys AS (SELECT split, stem, line_no, class_id, list_transform(poly, lambda p: [p[1] * {CANVAS}, p[2] * {CANVAS}]) AS points FROM labels WHERE len(poly) >= 3)",
    runs_sql("polys", "runs", "split, stem, line_no, class_id", CANVAS, CANVAS),
]
ISSUES = """issues AS (SELECT x.split, p.*, x.class_id AS class_i, y.class_id AS class_j, CASE WHEN x.class_id = y.class_id THEN 'duplicate' ELSE 'cross' END AS chk
  FROM pairs p JOIN labels x ON x.stem = p.stem AND x.line_no = p.i JOIN labels y ON y.stem = p.stem AND y.line_no = p.j
  WHERE CASE WHEN x.class_id = y.class_id THEN iou >= 7e-1 OR cont >= 8e-1 ELSE iou >= 15e-2 OR cont >= 6e-1 END)"""
WHY = """CASE WHEN len(poly) < 3 THEN 'poly<3pts(' || len(poly) || ')' WHEN len(list_filter(poly, lambda p: p[1] < -1e-2 OR p[1] > 101e-2 OR p[2] < -1e-2 OR p[2] > 101e-2)) > 0
  THEN 'coords_out_of_[0,1]' END"""
EMPTY = "empty AS (SELECT l.split, l.stem, l.line_no, l.class_id, coalesce(area, 0) AS area FROM labels l LEFT JOIN areas a ON a.stem = l.stem AND a.line_no = l.line_no WHERE len(poly) >= 3 AND coalesce(area, 0) < 60)"
LEAKS = "leaks AS (SELECT CAST(o_custkey AS VARCHAR) AS stem, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)"


def yolo_labels(spark, d):
    # The registry is a fixed list; without the hint all shapes are shuffled by name before its size is known.
    reg = F.broadcast(classes(spark).select(F.col("name").alias("_n"), "class_id"))
    s = shapes(spark, d).withColumn("_n", F.trim("label")).join(reg, "_n", "left").join(images(spark, d).select("stem", "split"), "stem")
    poly = F.transform("points", lambda p: F.struct((p[0] / 60).alias("x"), (p[1] / 45).alias("y")))
    return s.select("split", "stem", "line_no", F.coalesce("class_id", F.lit(9)).alias("class_id"), poly.alias("poly"))


@query("A18_degenerate", sql(YOLO, f"SELECT split, stem, line_no, class_id, {WHY} AS why FROM labels WHERE ({WHY}) IS NOT NULL"))
def _(spark, d):
    return qc.degenerate(yolo_labels(spark, d)).drop("poly")


@query("A19_near_empty", sql([*YOLO, *YOLO_RUNS, OVERLAP.split(",\nshared")[0], EMPTY], "SELECT split, stem, line_no, class_id, CAST(area AS BIGINT) AS area FROM empty"))
def _(spark, d):
    return qc.near_empty(yolo_labels(spark, d), CANVAS, 60)


@query("A20_qc_report", sql([*YOLO, *YOLO_RUNS, OVERLAP, ISSUES, EMPTY.replace("< 60", "< 9"), f"""found AS (SELECT split, chk AS c FROM issues UNION ALL
  SELECT split, 'degenerate' FROM labels WHERE ({WHY}) IS NOT NULL UNION ALL SELECT split, 'near_empty' FROM empty)""",
  "counts AS (SELECT split, c, count(*) AS n FROM found GROUP BY ALL)"],
  """SELECT split, c AS "check", n FROM counts UNION ALL SELECT NULL, CASE WHEN coalesce(sum(n), 0) = 0 THEN 'CLEAN' ELSE 'ISSUES' END, CAST(coalesce(sum(n), 0) AS BIGINT) FROM counts"""))
def _(spark, d):
    return qc.qc_report(yolo_labels(spark, d), CANVAS)


@query("O2_top_offenders", sql([*YOLO, *YOLO_RUNS, OVERLAP, ISSUES], f"""SELECT split, chk AS "check", stem, i, j, {rs('w')} AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY split, chk ORDER BY w DESC, stem, i, j) AS rank
  FROM (SELECT *, CASE WHEN chk = 'cross' THEN greatest(iou, cont) ELSE iou END AS w FROM issues)) WHERE rank <= 25"""))
def _(spark, d):
    lab = yolo_labels(spark, d)
    top = qc.top_offenders(qc.label_issues(lab, CANVAS), 25)
    return top.select("split", "check", "stem", "i", "j", r("weight").alias("weight"), "rank")


@query("J20_split_leakage", sql(LEAKS, "SELECT stem, n_splits FROM leaks"))
def _(spark, d):
    lab = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("stem"), F.col("o_orderstatus").alias("split"))
    return qc.split_leakage(lab)


# --- label text ------------------------------------------------------------------------------------------

RAW = """CASE l_linenumber WHEN 1 THEN '' ELSE CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1.0' ELSE 'x' END END || repeat(' 0.' || (l_partkey % 90 + 10), CAST(l_quantity AS INTEGER) % 9)
  || CASE WHEN l_linenumber = 2 THEN ' ' || chr(9) || ' 0.5' ELSE '' END"""
PARSED = f"lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter(string_split_regex(trim({RAW}), '\\s+'), lambda t: t <> '') AS t FROM lineitem)"


def raw_lines(spark, d):
    raw = F.concat(
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "N", "1.0").otherwise("x")),
        F.repeat(F.concat(F.lit(" 0."), F.col("l_partkey") % 90 + 10), F.col("l_quantity").cast("int") % 9),
        F.when(F.col("l_linenumber") == 2, " \t 0.5").otherwise(""),
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))


OK3 = "len(t) >= 7 AND len(t) % 2 = 1 AND regexp_full_match(t[1], '[+-]?\\d+')"


@query("S3_parse_yolo", sql(PARSED, f"""SELECT l_orderkey, count(*) FILTER (NOT ({OK3})) AS n_skipped, CAST(coalesce(sum(CASE WHEN {OK3} THEN len(t) // 2 END), 0) AS BIGINT) AS n_points,
  count(CASE WHEN regexp_full_match(t[1], '[+-]?\\d+') THEN 1 END) AS n_class FROM lines WHERE len(t) > 0 GROUP BY 1"""))
def _(spark, d):
    return parse_yolo(raw_lines(spark, d)).groupBy("l_orderkey").agg(
        F.count_if("skipped").alias("n_skipped"), F.coalesce(F.sum(F.size("poly").cast("bigint")), F.lit(0)).alias("n_points"), F.count("class_id").alias("n_class")
    )


@query("S4_parse_yolo_qc", sql(PARSED, f"""SELECT l_orderkey, count(*) AS n, CAST(sum((len(t) - 1) // 2) AS BIGINT) AS n_points, count(TRY_CAST(t[1] AS DOUBLE)) AS n_class,
  {rs('coalesce(sum(list_sum(list_transform(range(1, (len(t) - 1) // 2 + 1), lambda i: CAST(t[i * 2] AS DOUBLE)))), 0)', 4)} AS sum_x FROM lines WHERE len(t) > 0 GROUP BY 1"""))
def _(spark, d):
    total = F.aggregate("poly", F.lit(0.0), lambda a, p: a + p["x"])
    return parse_yolo(raw_lines(spark, d), dialect="qc").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum(F.size("poly").cast("bigint")).alias("n_points"), F.count("class_id").alias("n_class"), r(F.sum(total), 4).alias("sum_x")
    )


# --- names ---------------------------------------------------------------------------------------------------


@query("F1_stem", r"""SELECT page_id, regexp_replace(split_part(url, '/', -1), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(split_part(url, '/', -1), '.(\.[^.]*)$', 1)) AS suffix FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.stem(F.col("url")).alias("stem"), tx.suffix(F.col("url")).alias("suffix"))


@query("F2_name_list", "SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' , ') || ',,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '') AS names FROM part")
def _(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(",,"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", tx.name_list(raw).alias("names"))
