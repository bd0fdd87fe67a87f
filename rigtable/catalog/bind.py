"""The given tables read as perception data, in Spark and as the same SQL text.

``embeddings`` are 8x8 depth tiles, ``lineitem`` point clouds and polygon shapes of the
images in ``orders``, ``events`` detections and telemetry, ``documents`` an inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 8
WIDTH, HEIGHT = 64, 48
FX, FY, PPX, PPY = 10.0, 10.0, 3.5, 3.5
CLASSES = ["cork", "lighter", "pompom"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def rs(expr: str, n: int = 6) -> str:
    return f"(round({expr}, {n}) + 0.0)"


def sql(ctes: list[str] | str, body: str) -> str:
    parts = [ctes] if isinstance(ctes, str) else ctes
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- depth tiles -----------------------------------------------------------------


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    u, v = F.col("i") % TILE, F.floor(F.col("i") / TILE).cast("int")
    return e.select(
        F.col("vec_id").alias("capture_id"),
        F.col("label").alias("class_id"),
        u.alias("u"),
        v.alias("v"),
        (x + 0.5).alias("depth_m"),
        ((u * 31 + v * 7) % 256).alias("r"),
        ((v * 17 + F.col("label")) % 256).alias("g"),
        (((u + v) * 13) % 256).alias("b"),
        F.when(x > 0.05, 1).when(x < -0.05, 2).otherwise(0).alias("inst_id"),
    )


PIXELS = """tiles AS (SELECT vec_id, label, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings),
pixels AS (SELECT vec_id AS capture_id, label AS class_id, CAST(i % 8 AS INTEGER) AS u, CAST(i // 8 AS INTEGER) AS v,
  CAST(embedding[i + 1] AS DOUBLE) + 5e-1 AS depth_m,
  CAST(((i % 8) * 31 + (i // 8) * 7) % 256 AS INTEGER) AS r, CAST(((i // 8) * 17 + label) % 256 AS INTEGER) AS g,
  CAST(((i % 8 + i // 8) * 13) % 256 AS INTEGER) AS b,
  CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > 5e-2 THEN 1 WHEN CAST(embedding[i + 1] AS DOUBLE) < -5e-2 THEN 2 ELSE 0 END AS inst_id
  FROM tiles)"""

LIFTED = f"""lifted AS (SELECT *, (u - {PPX}e0) * depth_m / {FX}e0 AS x, (v - {PPY}e0) * depth_m / {FY}e0 AS y, depth_m AS z FROM pixels
  WHERE depth_m > 3e-1 AND depth_m < 7e-1)"""


def point_id() -> Column:
    return F.col("capture_id") * 64 + F.col("v") * 8 + F.col("u")


# --- point clouds ----------------------------------------------------------------


def cloud(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cloud_id"),
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_quantity") / 50.0 - 0.5).alias("x"),
        (F.col("l_discount") + F.col("l_quantity") / 200.0).alias("y"),
        (F.col("l_extendedprice") / 200000.0 + 0.3).alias("z"),
        (F.col("l_quantity") / 50.0).alias("r"),
        (F.col("l_discount") * 10.0).alias("g"),
        (F.col("l_tax") * 10.0).alias("b"),
    )


CLOUD = """cloud AS (SELECT l_suppkey AS cloud_id, l_orderkey, l_linenumber, l_partkey, l_quantity / 50e0 - 5e-1 AS x,
  l_discount + l_quantity / 200e0 AS y, l_extendedprice / 200000e0 + 3e-1 AS z,
  l_quantity / 50e0 AS r, l_discount * 10e0 AS g, l_tax * 10e0 AS b FROM lineitem)"""


# --- annotations -----------------------------------------------------------------


def images(spark: SparkSession, d: str) -> DataFrame:
    blank = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 10 == 0)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("stem"),
        F.col("o_orderpriority").alias("pool"),
        F.when(blank, 0).otherwise(F.when(F.col("o_orderstatus") == "F", WIDTH).otherwise(2 * WIDTH)).alias("width"),
        F.when(blank, 0).otherwise(F.when(F.col("o_orderstatus") == "F", HEIGHT).otherwise(2 * HEIGHT)).alias("height"),
        F.when(F.col("o_orderstatus") == "F", "train").otherwise("val").alias("split"),
        F.col("o_orderkey").alias("no"),
    )


IMAGES = """images AS (SELECT CAST(o_orderkey AS VARCHAR) AS stem, o_orderpriority AS pool,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 64 ELSE 128 END AS width,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 48 ELSE 96 END AS height,
  CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'val' END AS split, o_orderkey AS no FROM orders)"""


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes with a unique, increasing ``line_no`` per image."""
    q = F.col("l_quantity").cast("int")
    x0, y0 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double")
    w, h = (q % 20 + 4).cast("double"), (F.col("l_partkey") % 13 + 4).cast("double")
    a, b = (F.col("l_linenumber") % 3).cast("double"), (F.col("l_partkey") % 3).cast("double")
    quad = F.array(F.array(x0 + a, y0), F.array(x0 + w, y0 + b), F.array(x0 + w - a, y0 + h), F.array(x0, y0 + h - b))
    flag = F.col("l_returnflag")
    label = (
        F.when(F.col("l_tax") > 0.075, "  ")
        .when(F.col("l_linenumber") == 7, "_gripper")
        .when(flag == "A", " cork ")
        .when(flag == "N", "lighter")
        .otherwise(F.when(F.col("l_linenumber") == 6, "mug").otherwise("pompom"))
    )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("stem"),
        (((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_suppkey")) * 100 + q).alias("line_no"),
        label.alias("label"),
        F.when(F.col("l_discount") > 0.095, "rectangle").otherwise("polygon").alias("shape_type"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_tax") < 0.005), F.slice(quad, 1, 2)).otherwise(quad).alias("points"),
    )


SHAPES = """quads AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax, l_discount, l_returnflag,
  CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 30 AS DOUBLE) AS y0, CAST(CAST(l_quantity AS INTEGER) % 20 + 4 AS DOUBLE) AS w,
  CAST(l_partkey % 13 + 4 AS DOUBLE) AS h, CAST(l_linenumber % 3 AS DOUBLE) AS a, CAST(l_partkey % 3 AS DOUBLE) AS b FROM lineitem),
shapes AS (SELECT CAST(l_orderkey AS VARCHAR) AS stem,
  ((l_partkey * 10 + l_linenumber) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS INTEGER) AS line_no,
  CASE WHEN l_tax > 75e-3 THEN '  ' WHEN l_linenumber = 7 THEN '_gripper' WHEN l_returnflag = 'A' THEN ' cork '
       WHEN l_returnflag = 'N' THEN 'lighter' WHEN l_linenumber = 6 THEN 'mug' ELSE 'pompom' END AS label,
  CASE WHEN l_discount > 95e-3 THEN 'rectangle' ELSE 'polygon' END AS shape_type,
  CASE WHEN l_linenumber = 1 AND l_tax < 5e-3 THEN [[x0 + a, y0], [x0 + w, y0 + b]]
       ELSE [[x0 + a, y0], [x0 + w, y0 + b], [x0 + w - a, y0 + h], [x0, y0 + h - b]] END AS points FROM quads)"""

VALID = "shape_type = 'polygon' AND trim(label) <> '' AND len(points) >= 3"
GOOD = f"good AS (SELECT stem, line_no, trim(label) AS label, points FROM shapes WHERE {VALID})"


def runs_sql(source: str, out: str, keys: str, width: int, height: int) -> str:
    """Scan-line rasterisation of ``source(points, keys..)`` written with plain joins and windows."""
    return f"""{out}_e AS (SELECT {keys}, points, unnest(range(1, len(points) + 1)) AS i,
  list_min(list_transform(points, lambda p: p[2])) AS ylo, list_max(list_transform(points, lambda p: p[2])) AS yhi FROM {source}),
{out}_s AS (SELECT {keys}, ylo, yhi, points[i][1] AS x1, points[i][2] AS y1,
  points[i % len(points) + 1][1] AS x2, points[i % len(points) + 1][2] AS y2 FROM {out}_e),
{out}_v AS (SELECT *, unnest(range(CAST(greatest(floor(ylo), 0) AS BIGINT), CAST(least(ceil(yhi), {height}) AS BIGINT))) AS v FROM {out}_s),
{out}_x AS (SELECT {keys}, v, x1 + ((v + 5e-1) - y1) * (x2 - x1) / (y2 - y1) AS x FROM {out}_v
  WHERE (y1 <= v + 5e-1) <> (y2 <= v + 5e-1)),
{out}_n AS (SELECT {keys}, v, x, lead(x) OVER w AS x_next, row_number() OVER w AS n FROM {out}_x
  WINDOW w AS (PARTITION BY {keys}, v ORDER BY x)),
{out} AS (SELECT {keys}, CAST(v AS INTEGER) AS v, CAST(greatest(ceil(x - 5e-1), 0) AS INTEGER) AS u0,
  CAST(least(ceil(x_next - 5e-1) - 1, {width} - 1) AS INTEGER) AS u1 FROM {out}_n
  WHERE n % 2 = 1 AND greatest(ceil(x - 5e-1), 0) <= least(ceil(x_next - 5e-1) - 1, {width} - 1))"""


OVERLAP = """areas AS (SELECT stem, line_no, sum(u1 - u0 + 1) AS area FROM runs GROUP BY ALL),
shared AS (SELECT a.stem, a.line_no AS i, b.line_no AS j, sum(least(a.u1, b.u1) - greatest(a.u0, b.u0) + 1) AS inter
  FROM runs a JOIN runs b ON a.stem = b.stem AND a.v = b.v AND a.line_no < b.line_no AND a.u0 <= b.u1 AND b.u0 <= a.u1 GROUP BY ALL),
pairs AS (SELECT s.stem, s.i, s.j, CAST(s.inter AS BIGINT) AS inter, CAST(x.area AS BIGINT) AS area_i, CAST(y.area AS BIGINT) AS area_j,
  s.inter / (x.area + y.area - s.inter) AS iou, s.inter / least(x.area, y.area) AS cont
  FROM shared s JOIN areas x ON x.stem = s.stem AND x.line_no = s.i JOIN areas y ON y.stem = s.stem AND y.line_no = s.j)"""


# --- detections and telemetry ------------------------------------------------------


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def detections_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("det_idx"), "event_type", "value",
        micros().alias("ts_us"), k.alias("k"),
    )
    k = F.col("k")
    name = F.when(F.col("event_type") == "click", "cork").when(F.col("event_type") == "view", "pompom").otherwise("lighter")
    point = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    return base.select(
        "session_id", "det_idx", "event_type", "value", "ts_us", "k",
        F.timestamp_micros("ts_us").alias("ts"),
        F.floor(F.col("ts_us") / F.lit(43_200_000_000)).alias("frame_index"),
        name.alias("class_name"),
        (F.lit(0.7) + (k % 30) / 100.0).alias("confidence"),
        point((k % 3) * 0.05, F.col("value") * 1e-4, F.lit(0.28) + (k % 5) * 0.002).alias("center"),
        point(F.lit(0.03) + (k % 4) * 0.001, F.lit(0.02) + F.lit(0.0) * k, F.lit(0.015) + (k % 2) * 0.001).alias("extent"),
        (k * 1.8 - 90.0).alias("yaw_deg"),
        (k * 7).alias("point_count"),
        (F.col("value") < 200).alias("in_workspace"),
        (name == "lighter").alias("yaw_reliable"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    return detections_of(table(spark, d, "events"))


DETS = """evk AS (SELECT user_id AS session_id, event_id AS det_idx, event_type, value, epoch_us(ts) AS ts_us,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
dets AS (SELECT session_id, det_idx, event_type, value, ts_us, k, ts_us // 43200000000 AS frame_index,
  CASE event_type WHEN 'click' THEN 'cork' WHEN 'view' THEN 'pompom' ELSE 'lighter' END AS class_name,
  7e-1 + (k % 30) / 100e0 AS confidence, (k % 3) * 5e-2 AS cx, value * 1e-4 AS cy, 28e-2 + (k % 5) * 2e-3 AS cz,
  3e-2 + (k % 4) * 1e-3 AS ex, 2e-2 AS ey, 15e-3 + (k % 2) * 1e-3 AS ez, k * 18e-1 - 90e0 AS yaw_deg, k * 7 AS point_count,
  value < 200 AS in_workspace, event_type NOT IN ('click', 'view') AS yaw_reliable FROM evk)"""

DAY_US = 86_400_000_000


def day(ts_us: str = "ts_us") -> Column:
    return F.floor(F.col(ts_us) / F.lit(DAY_US))
