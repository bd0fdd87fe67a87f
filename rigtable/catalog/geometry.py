"""Depth, point and box queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.catalog.bind import (
    CLOUD, FX, FY, LIFTED, PIXELS, PPX, PPY, cloud, pixels, point_id, r, rs, sql, table,
)
from rigtable.functions import vec
from rigtable.operators import calib
from rigtable.operators import geometry as g
from rigtable.operators import views as vw

QUERIES: dict = {}
SQL: dict = {}
INTR = (FX, FY, PPX, PPY)
BAND = (0.3, 0.7)
BOX = "-0.1,0.1,-0.1,0.1,0.4,0.6"
CLOUD_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "z"]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def lifted(spark, d) -> DataFrame:
    return g.backproject(pixels(spark, d).filter(g.valid_depth("depth_m", *BAND)), *INTR)


# --- predicates and projections -----------------------------------------------------


@query("P7_valid_depth", sql(PIXELS, "SELECT capture_id, count(*) AS n, sum(CASE WHEN depth_m > 3e-1 AND depth_m < 7e-1 THEN 1 ELSE 0 END)::BIGINT AS n_ok FROM pixels GROUP BY capture_id"))
def _(spark, d):
    ok = g.valid_depth("depth_m", *BAND)
    return pixels(spark, d).groupBy("capture_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))


@query("P8_backproject", sql([PIXELS, LIFTED], f"SELECT capture_id, u, v, {rs('x')} AS x, {rs('y')} AS y, {rs('z')} AS z FROM lifted"))
def _(spark, d):
    return lifted(spark, d).select("capture_id", "u", "v", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"))


@query("P9_backproject_color", sql([PIXELS, LIFTED], f"SELECT capture_id, u, v, r, g, b, {rs('x')} AS x, {rs('z')} AS z FROM lifted WHERE inst_id = 1"))
def _(spark, d):
    seen = lifted(spark, d).filter("inst_id = 1")
    return seen.select("capture_id", "u", "v", "r", "g", "b", r("x").alias("x"), r("z").alias("z"))


@query("P10_in_workspace", sql([PIXELS, LIFTED], """SELECT capture_id, count(*) AS n, CAST(sum(CASE WHEN x BETWEEN -1e-1 AND 1e-1
  AND y BETWEEN -1e-1 AND 1e-1 AND z BETWEEN 4e-1 AND 6e-1 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside FROM lifted GROUP BY capture_id"""))
def _(spark, d):
    inside = g.in_workspace((F.col("x"), F.col("y"), F.col("z")), g.parse_workspace(BOX))
    return lifted(spark, d).groupBy("capture_id").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


@query("P11_yaw_reliable", "SELECT p_partkey, p_type IN ('ECONOMY', 'STANDARD') AS yaw_reliable FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", g.yaw_reliable("p_type", " ECONOMY, STANDARD,").alias("yaw_reliable"))


@query("P12_stride_pixels", sql(PIXELS, "SELECT capture_id, u, v FROM pixels WHERE u % 3 = 0 AND v % 3 = 0"))
def _(spark, d):
    return g.stride_pixels(pixels(spark, d), 3).select("capture_id", "u", "v")


@query("P13_cap_even", sql(CLOUD, """, numbered AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY l_orderkey, l_linenumber, l_partkey, z) - 1 AS i,
  count(*) OVER (PARTITION BY cloud_id) AS n FROM cloud), picks AS (SELECT DISTINCT cloud_id, n, k * (n - 1) // 49 AS i FROM
  (SELECT DISTINCT cloud_id, n FROM numbered), range(50) t(k))
  SELECT a.cloud_id, l_orderkey, l_linenumber, l_partkey FROM numbered a LEFT JOIN picks p ON p.cloud_id = a.cloud_id AND p.i = a.i
  WHERE a.n <= 50 OR p.i IS NOT NULL""".lstrip(", ")).replace("FROM lineitem)\nnumbered", "FROM lineitem), numbered"))
def _(spark, d):
    pts = cloud(spark, d)
    kept = g.cap_even(pts, ["cloud_id"], [F.col(c) for c in CLOUD_ORDER], 50, bucket=F.floor(F.col("l_orderkey") / 1000))
    return kept.select("cloud_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("P14_dim_outside", sql(CLOUD, f"""SELECT cloud_id, {rs('sum(r * f)', 4)} AS r, {rs('sum(g * f)', 4)} AS g FROM (SELECT *, CASE WHEN x BETWEEN -2e-1 AND 3e-1
  AND y BETWEEN 0 AND 2e-1 AND z BETWEEN 4e-1 AND 6e-1 THEN 1e0 ELSE 25e-2 END AS f FROM cloud) GROUP BY cloud_id"""))
def _(spark, d):
    dim = g.dim_outside(cloud(spark, d), g.parse_workspace("-0.2,0.3,0,0.2,0.6,0.4"))
    return dim.groupBy("cloud_id").agg(r(F.sum("r"), 4).alias("r"), r(F.sum("g"), 4).alias("g"))


@query("P15_normalize_depth", sql(PIXELS, f"""SELECT p.capture_id, u, v, {rs('CASE WHEN depth_m > 0 THEN greatest(0, least(1, (depth_m - lo) / greatest(hi - lo, 1e-3))) END')} AS norm
  FROM pixels p JOIN (SELECT capture_id, CASE WHEN p98 - p2 < 5e-2 THEN greatest(1e-2, (p2 + p98) * 5e-1 - 5e-2) ELSE p2 END AS lo,
    CASE WHEN p98 - p2 < 5e-2 THEN (p2 + p98) * 5e-1 + 5e-2 ELSE p98 END AS hi FROM
    (SELECT capture_id, quantile_cont(depth_m, 2e-2) AS p2, quantile_cont(depth_m, 98e-2) AS p98 FROM pixels WHERE depth_m > 0 GROUP BY 1)) s USING (capture_id)"""))
def _(spark, d):
    return g.normalize_depth(pixels(spark, d), ["capture_id"], "percentile").select("capture_id", "u", "v", r("norm").alias("norm"))


@query("P15_normalize_depth_minmax", sql(PIXELS, f"""SELECT capture_id, u, v, CASE WHEN depth_m > 0 THEN {rs('(depth_m - lo) / (hi - lo)')} END AS norm FROM pixels JOIN
  (SELECT capture_id, min(depth_m) AS lo, max(depth_m) AS hi FROM pixels WHERE depth_m > 0 GROUP BY 1) USING (capture_id)"""))
def _(spark, d):
    return g.normalize_depth(pixels(spark, d), ["capture_id"], "minmax").select("capture_id", "u", "v", r("norm").alias("norm"))


@query("P18_format_label", sql([PIXELS, LIFTED], """SELECT capture_id, CASE WHEN n < 30 THEN printf('c%d %.2f' || chr(10) || 'pts=%d', class_id, 5e-1, n)
  ELSE printf('c%d %.2f' || chr(10) || 'xyz=(%.3f, %.3f, %.3f) m' || chr(10) || 'yaw=%s' || chr(10) || 'pts=%d', class_id, 5e-1, x, y, z,
    CASE WHEN class_id % 2 = 0 THEN 'n/a (sym)' ELSE printf('%.1f deg', yaw) END, n) END AS label FROM
  (SELECT capture_id, class_id, count(*) AS n, min(u) * 125e-3 AS x, max(v) * 125e-3 AS y, max(u) * 25e-2 AS z, min(v) + 5e-1 AS yaw FROM lifted GROUP BY 1, 2)"""))
def _(spark, d):
    agg = lifted(spark, d).groupBy("capture_id", "class_id").agg(
        F.count("*").alias("point_count"), (F.min("u") * 0.125).alias("x"), (F.max("v") * 0.125).alias("y"),
        (F.max("u") * 0.25).alias("z"), (F.min("v") + 0.5).alias("yaw_deg"),
    )
    rows = agg.select(
        "capture_id", "point_count", "yaw_deg", F.concat(F.lit("c"), F.col("class_id")).alias("class_name"), F.lit(0.5).alias("confidence"),
        F.when(F.col("point_count") >= 30, vec.pack((F.col("x"), F.col("y"), F.col("z")))).alias("center"),
        (F.col("class_id") % 2 == 1).alias("yaw_reliable"),
    )
    return rows.select("capture_id", g.format_label(tracked=False).alias("label"))


@query("P20_good_view", sql(CLOUD, """SELECT cloud_id, CAST(sum(CASE WHEN z * 100 BETWEEN 25 AND 35 AND sqrt(x * x + y * y) * 100 < 6 THEN 1 ELSE 0 END) AS BIGINT) AS n_good
  FROM cloud GROUP BY cloud_id"""))
def _(spark, d):
    good = g.good_view((F.col("x"), F.col("y"), F.col("z")))
    return cloud(spark, d).groupBy("cloud_id").agg(F.count_if(good).alias("n_good"))


# --- statistics ------------------------------------------------------------------------


@query("A8_lift_report", sql([PIXELS, LIFTED], f"""SELECT m.capture_id, m.inst_id, m.n AS mask_pixels, coalesce(p.n, 0) AS point_count,
  {rs('100e0 * coalesce(p.n, 0) / m.n', 4)} AS depth_ok_pct, {rs('coalesce(lo, 0)')} AS z_min, {rs('coalesce(mid, 0)')} AS z_median,
  {rs('coalesce(hi, 0)')} AS z_max, 100e0 * coalesce(p.n, 0) / m.n < 95 AS has_holes
  FROM (SELECT capture_id, inst_id, count(*) AS n FROM pixels WHERE inst_id > 0 GROUP BY 1, 2) m LEFT JOIN
  (SELECT capture_id, inst_id, count(*) AS n, min(z) AS lo, max(z) AS hi, median(z) AS mid FROM lifted WHERE inst_id > 0 GROUP BY 1, 2) p USING (capture_id, inst_id)"""))
def _(spark, d):
    rep = g.lift_report(lifted(spark, d).filter("inst_id > 0"), pixels(spark, d).filter("inst_id > 0"), ["capture_id", "inst_id"])
    return rep.withColumns({c: r(c) for c in ("z_min", "z_median", "z_max")} | {"depth_ok_pct": r("depth_ok_pct", 4)})


@query("A9_depth_stats", sql(PIXELS, f"""SELECT capture_id, count(*) AS n, count(*) FILTER (depth_m > 0) AS n_valid, {rs('min(depth_m) FILTER (depth_m > 0)')} AS z_min,
  {rs('max(depth_m) FILTER (depth_m > 0)')} AS z_max, {rs('median(depth_m) FILTER (depth_m > 0)')} AS z_median,
  {rs('100e0 * count(*) FILTER (depth_m > 0) / count(*)', 4)} AS valid_pct FROM pixels GROUP BY capture_id"""))
def _(spark, d):
    s = g.depth_stats(pixels(spark, d), ["capture_id"])
    return s.withColumns({c: r(c) for c in ("z_min", "z_max", "z_median")} | {"valid_pct": r("valid_pct", 4)})


MAD = """med AS (SELECT cloud_id, median(z) AS m FROM cloud GROUP BY 1),
dev AS (SELECT c.*, abs(z - m) AS dv FROM cloud c JOIN med USING (cloud_id)),
spread AS (SELECT cloud_id, median(dv) AS mad FROM dev GROUP BY 1),
kept AS (SELECT * FROM dev JOIN spread USING (cloud_id) WHERE mad < 1e-6 OR dv <= 25e-1 * 14826e-4 * mad)"""


@query("A10_mad_filter", sql([CLOUD, MAD.replace("25e-1", "1e0")], f"SELECT cloud_id, count(*) AS n, {rs('min(z)')} AS z_min, {rs('max(z)')} AS z_max FROM kept GROUP BY cloud_id"))
def _(spark, d):
    kept = g.mad_filter(cloud(spark, d).select("cloud_id", "z"), ["cloud_id"], scale=1.0)
    return kept.groupBy("cloud_id").agg(F.count("*").alias("n"), r(F.min("z")).alias("z_min"), r(F.max("z")).alias("z_max"))


OBB_NORMAL = (0.0, -0.6, -0.8)


def obb_sql(source: str, keys: str, flat: str, min_points: int | None = None) -> list[str]:
    """Table frame of the fixed normal: u = x axis, v = n x u, n = (0, -0.6, -0.8)."""
    return [
        f"planar AS (SELECT *, x AS pu, -8e-1 * y + 6e-1 * z AS pv, -6e-1 * y - 8e-1 * z AS pn, {flat} AS flat FROM {source})",
        f"""turned AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) < 3 OR bool_or(flat) THEN 0e0 ELSE
  (atan2(2 * covar_samp(pu, pv), var_samp(pu) - var_samp(pv)) * 5e-1) END AS yaw FROM planar GROUP BY ALL)""",
        f"""ends AS (SELECT {keys}, n, yaw, min(cos(yaw) * pu + sin(yaw) * pv) AS l0, max(cos(yaw) * pu + sin(yaw) * pv) AS l1,
  min(cos(yaw) * pv - sin(yaw) * pu) AS s0, max(cos(yaw) * pv - sin(yaw) * pu) AS s1, min(pn) AS n0, max(pn) AS n1
  FROM planar JOIN turned USING ({keys}) GROUP BY ALL)""",
        f"""box AS (SELECT {keys}, n, yaw, l1 - l0 AS ex, s1 - s0 AS ey, n1 - n0 AS ez,
  (l0 + l1) / 2 * cos(yaw) - (s0 + s1) / 2 * sin(yaw) AS cu, (l0 + l1) / 2 * sin(yaw) + (s0 + s1) / 2 * cos(yaw) AS cv, (n0 + n1) / 2 AS cn FROM ends)""",
        f"world AS (SELECT *, cu AS cx, -8e-1 * cv - 6e-1 * cn AS cy, 6e-1 * cv - 8e-1 * cn AS cz FROM box)",
    ]


OBB_OUT = ", ".join([f"{rs('yaw', 5)} AS yaw_rad"] + [f"{rs(c, 5)} AS {c}" for c in ("cx", "cy", "cz", "ex", "ey", "ez")])


def flat_box(df, *keys):
    return df.select(
        *keys, "point_count", r("yaw_rad", 5).alias("yaw_rad"),
        *[r(F.col("center")[a], 5).alias(f"c{a}") for a in "xyz"], *[r(F.col("extent")[a], 5).alias(f"e{a}") for a in "xyz"],
    )


@query("A11_table_obb", sql([CLOUD, *obb_sql("cloud", "cloud_id", "FALSE")], f"SELECT cloud_id, n AS point_count, {OBB_OUT} FROM world"))
def _(spark, d):
    return flat_box(g.table_obb(cloud(spark, d), ["cloud_id"], OBB_NORMAL), "cloud_id")


@query("A11_table_obb_symmetric", sql([CLOUD, *obb_sql("cloud", "cloud_id", "TRUE")], f"SELECT cloud_id, n AS point_count, {OBB_OUT} FROM world"))
def _(spark, d):
    return flat_box(g.table_obb(cloud(spark, d), ["cloud_id"], OBB_NORMAL, force_yaw_zero=True), "cloud_id")


@query("robust_box_per_cloud", sql([CLOUD, MAD, *obb_sql("kept", "cloud_id", "FALSE")], f"SELECT cloud_id, n AS point_count, {OBB_OUT} FROM world"))
def robust_box(spark, d):
    pts = cloud(spark, d).select("cloud_id", "x", "y", "z")
    return flat_box(g.table_obb(g.mad_filter(pts, ["cloud_id"]), ["cloud_id"], OBB_NORMAL), "cloud_id")


DET_SQL = [
    PIXELS, LIFTED.replace("WHERE", "WHERE inst_id > 0 AND"),
    """med AS (SELECT capture_id, inst_id, median(z) AS m FROM lifted GROUP BY 1, 2),
dev AS (SELECT c.*, abs(z - m) AS dv FROM lifted c JOIN med USING (capture_id, inst_id)),
spread AS (SELECT capture_id, inst_id, median(dv) AS mad FROM dev GROUP BY 1, 2),
kept AS (SELECT * FROM dev JOIN spread USING (capture_id, inst_id) WHERE mad < 1e-6 OR dv <= 25e-1 * 14826e-4 * mad)""",
    *obb_sql("kept", "capture_id, inst_id", "class_id % 2 = 0"),
]


@query("A12_build_detections", sql(DET_SQL, f"""SELECT capture_id, inst_id, coalesce(n, 0) AS point_count,
  {', '.join(f"CASE WHEN n >= 20 THEN {rs(e, 5)} END AS {c}" for e, c in (('yaw', 'yaw_rad'), ('cx', 'cx'), ('cy', 'cy'), ('cz', 'cz'), ('ex', 'ex'), ('ey', 'ey'), ('ez', 'ez')))},
  coalesce(n < 20 OR (cx BETWEEN -1e-1 AND 1e-1 AND cy BETWEEN -1e-1 AND 1e-1 AND cz BETWEEN 4e-1 AND 6e-1), TRUE) AS in_workspace,
  coalesce(n >= 20, FALSE) AND class_id % 2 = 1 AS yaw_reliable
  FROM (SELECT DISTINCT capture_id, inst_id, class_id FROM pixels WHERE inst_id > 0) LEFT JOIN world USING (capture_id, inst_id)"""))
def _(spark, d):
    names = F.concat(F.lit("c"), F.col("class_id"))
    dets = pixels(spark, d).filter("inst_id > 0").select("capture_id", "inst_id", names.alias("class_name")).distinct()
    out = g.build_detections(
        lifted(spark, d).filter("inst_id > 0").select("capture_id", "inst_id", "x", "y", "z"), dets, ["capture_id", "inst_id"],
        OBB_NORMAL, 20, "c1,c3,c5,c7,c9", g.parse_workspace(BOX),
    )
    return flat_box(out, "capture_id", "inst_id", "in_workspace", "yaw_reliable")


@query("A16_scene_summary", sql(CLOUD, f"""SELECT cloud_id, {rs('cx')} AS cx, {rs('cy')} AS cy, {rs('cz')} AS cz, {rs('extent')} AS extent, {rs('cz - extent * 12e-1')} AS eye_z
  FROM (SELECT cloud_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, greatest(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 5e-1) AS extent
  FROM cloud GROUP BY cloud_id)"""))
def _(spark, d):
    s = g.scene_summary(cloud(spark, d), ["cloud_id"])
    return s.select("cloud_id", *[r(c).alias(c) for c in ("cx", "cy", "cz", "extent", "eye_z")])


# Trial planes, their inliers and the least eigenvector in closed form.
PLANE = """pts AS (SELECT class_id AS f, capture_id, v, u, x, y, z FROM lifted),
drawn AS (SELECT f, x, y, z, row_number() OVER (PARTITION BY f ORDER BY md5(concat_ws(',', 7, capture_id, v, u)), capture_id, v, u) - 1 AS i FROM pts QUALIFY i < 360),
sized AS (SELECT f, count(*) AS m FROM drawn GROUP BY f),
turns AS (SELECT f, m, unnest(range(120)) AS t FROM sized),
picks AS (SELECT f, t, 3 * t % m AS a, (3 * t + 1 + 3 * t // m) % m AS b, (3 * t + 2 * (1 + 3 * t // m)) % m AS c FROM turns),
corners AS (SELECT f, t, p.x AS px, p.y AS py, p.z AS pz, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az, s.x - p.x AS bx, s.y - p.y AS by_, s.z - p.z AS bz
  FROM picks JOIN drawn p USING (f) JOIN drawn q USING (f) JOIN drawn s USING (f) WHERE p.i = a AND q.i = b AND s.i = c),
crossed AS (SELECT f, t, px, py, pz, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz FROM corners),
scaled AS (SELECT f, t, px, py, pz, cx / s AS nx, cy / s AS ny, cz / s AS nz FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS s FROM crossed) WHERE s > 1e-12),
planes AS (SELECT f, t, nx, ny, nz, -(nx * px + ny * py + nz * pz) AS d FROM scaled),
counts AS (SELECT f, t, count(*) FILTER (abs(x * nx + y * ny + z * nz + d) < 5e-2) AS inliers FROM pts JOIN planes USING (f) GROUP BY f, t),
best AS (SELECT * FROM counts JOIN planes USING (f, t) QUALIFY row_number() OVER (PARTITION BY f ORDER BY inliers DESC, t) = 1),
cov AS (SELECT f, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d2, covar_pop(y, z) AS e, covar_pop(z, z) AS g
  FROM pts JOIN best USING (f) WHERE abs(x * nx + y * ny + z * nz + d) < 5e-2 GROUP BY f),
mid AS (SELECT *, (a + d2 + g) / 3 AS q FROM cov),
wide AS (SELECT *, sqrt((pow(a - q, 2) + pow(d2 - q, 2) + pow(g - q, 2) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM mid),
least AS (SELECT *, q + 2 * p * cos(acos(greatest(-1e0, least(1e0, ((a - q) * ((d2 - q) * (g - q) - e * e) - b * (b * (g - q) - e * c) + c * (b * e - (d2 - q) * c))
  / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS w FROM wide),
ways AS (SELECT f, unnest([{'x': b * e - c * (d2 - w), 'y': c * b - (a - w) * e, 'z': (a - w) * (d2 - w) - b * b},
  {'x': b * (g - w) - c * e, 'y': c * c - (a - w) * (g - w), 'z': (a - w) * e - b * c},
  {'x': (d2 - w) * (g - w) - e * e, 'y': e * c - b * (g - w), 'z': b * e - (d2 - w) * c}]) AS r FROM least),
way AS (SELECT f, r.x AS x, r.y AS y, r.z AS z, sqrt(r.x * r.x + r.y * r.y + r.z * r.z) * (CASE WHEN r.y > 0 THEN -1 ELSE 1 END) AS s FROM ways
  QUALIFY row_number() OVER (PARTITION BY f ORDER BY r.x * r.x + r.y * r.y + r.z * r.z DESC) = 1),
frames AS (SELECT f, count(*) AS n FROM pts GROUP BY f)"""


@query("A24_table_normal", sql([PIXELS, LIFTED, PLANE], f"""SELECT f AS frame_id, CASE WHEN n < 128 THEN 0e0 ELSE {rs('x / s', 4)} END AS nx, CASE WHEN n < 128 THEN -1e0 ELSE {rs('y / s', 4)} END AS ny,
  CASE WHEN n < 128 THEN 0e0 ELSE {rs('z / s', 4)} END AS nz, CASE WHEN n < 128 THEN 0 ELSE inliers END AS inliers FROM frames JOIN best USING (f) JOIN way USING (f)"""))
def _(spark, d):
    frames = lifted(spark, d).withColumn("frame_id", F.col("class_id"))
    drawn = F.md5(F.concat_ws(",", F.lit("7"), "capture_id", "v", "u"))
    fit = g.table_normal(frames, ["frame_id"], distance=0.05, order=("capture_id", "v", "u"), draw=drawn)
    return fit.select("frame_id", r("nx", 4).alias("nx"), r("ny", 4).alias("ny"), r("nz", 4).alias("nz"), "inliers")


# --- boxes and points --------------------------------------------------------------------

BOXES = f"""obj AS (SELECT capture_id, inst_id AS box_no, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1
  FROM lifted WHERE inst_id > 0 GROUP BY 1, 2)"""


def axis_boxes(spark, d):
    agg = lifted(spark, d).filter("inst_id > 0").groupBy("capture_id", F.col("inst_id").alias("box_no")).agg(
        *[f(a).alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))]
    )
    unit = F.array(*[vec.pack(vec.lits(row)) for row in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    return agg.select(
        "capture_id", "box_no",
        vec.pack(tuple((F.col(f"{a}0") + F.col(f"{a}1")) * 0.5 for a in "xyz")).alias("center"),
        vec.pack(tuple(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz")).alias("extent"), unit.alias("axes"),
    )


# One entry a box, box 0 first: red falls and blue rises.
PALETTE = [[0.9, 0.5, 0.1], [0.7, 0.5, 0.3], [0.5, 0.5, 0.5], [0.3, 0.5, 0.7], [0.1, 0.5, 0.9]]


def _inside(n: int) -> str:
    tests = [f"abs(p.{a} - (o.{a}0 + o.{a}1) * 5e-1) <= (o.{a}1 - o.{a}0) * 5e-1 + 1e-4" for a in "xyz"]
    return f"coalesce(bool_or(o.box_no = {n} AND " + " AND ".join(tests) + "), FALSE)"


@query("J11_points_in_boxes", sql([PIXELS, LIFTED, BOXES], f"""SELECT capture_id, point_id, CAST(i1 AS INTEGER) + CAST(i2 AS INTEGER) AS n_boxes,
  {rs('CASE WHEN i2 THEN c1 * 55e-2 + 5e-1 * 45e-2 ELSE c1 END')} AS r FROM (SELECT *, CASE WHEN i1 THEN r0 * 55e-2 + 7e-1 * 45e-2 ELSE r0 END AS c1 FROM
  (SELECT p.capture_id, p.capture_id * 64 + v * 8 + u AS point_id, any_value(p.r / 255e0) AS r0, {_inside(1)} AS i1, {_inside(2)} AS i2
   FROM lifted p LEFT JOIN obj o ON o.capture_id = p.capture_id GROUP BY 1, 2))"""))
def _(spark, d):
    pts = lifted(spark, d).select("capture_id", point_id().alias("point_id"), "x", "y", "z", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    hit = g.points_in_boxes(pts, axis_boxes(spark, d), ["capture_id"], PALETTE, cell=0.2)
    return hit.select("capture_id", "point_id", "n_boxes", r("r").alias("r"))


@query("J13_to_base", sql(CLOUD, f"""SELECT cloud_id, {rs('avg(6e-1 * z + 8e-1 * x + 1e-1)', 5)} AS bx, {rs('avg(y + 2e-1)', 5)} AS by_, {rs('avg(6e-1 * -x + 8e-1 * z + 5e-1)', 5)} AS bz
  FROM cloud GROUP BY cloud_id"""))
def _(spark, d):
    from rigtable.operators.tracking import to_base

    base_ee = vec.rigid_lit([[1, 0, 0, 0.1], [0, 1, 0, 0.2], [0, 0, 1, 0.3]])
    ee_cam = vec.rigid_lit([[0.8, 0, 0.6, 0.0], [0, 1, 0, 0.0], [-0.6, 0, 0.8, 0.2]])
    out = to_base(cloud(spark, d), ["x", "y", "z"], base_ee, ee_cam)
    return out.groupBy("cloud_id").agg(r(F.avg("bx"), 5).alias("bx"), r(F.avg("by"), 5).alias("by_"), r(F.avg("bz"), 5).alias("bz"))


@query("J18_max_pairwise", sql(CLOUD, f"""SELECT cloud_id, l_returnflag, n, {rs('d')} AS max_pair FROM (SELECT a.l_suppkey AS cloud_id, a.l_returnflag, count(DISTINCT a.rid) AS n,
  max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d
  FROM (SELECT rowid_ AS rid, * FROM pts) a JOIN (SELECT * FROM pts) b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag GROUP BY 1, 2)""").replace(
    "\nSELECT cloud_id, l_ret", """, pts AS (SELECT row_number() OVER () AS rowid_, l_suppkey, l_returnflag, l_quantity / 50e0 - 5e-1 AS x, l_discount + l_quantity / 200e0 AS y,
  l_extendedprice / 200000e0 + 3e-1 AS z FROM lineitem) SELECT cloud_id, l_ret""", 1))
def _(spark, d):
    li = table(spark, d, "lineitem")
    pts = li.select(
        F.col("l_suppkey").alias("cloud_id"), "l_returnflag", (F.col("l_quantity") / 50.0 - 0.5).alias("x"),
        (F.col("l_discount") + F.col("l_quantity") / 200.0).alias("y"), (F.col("l_extendedprice") / 200000.0 + 0.3).alias("z"),
    )
    return calib.max_pairwise(pts, ["cloud_id", "l_returnflag"], ["x", "y", "z"]).withColumn("max_pair", r("max_pair"))


@query("O11_label_anchor", sql([PIXELS, LIFTED, BOXES], f"SELECT capture_id, box_no, {rs('round(x0, 9)')} AS ax, {rs('round(y0, 9)')} AS ay, {rs('round(z0, 9)')} AS az FROM obj"))
def _(spark, d):
    b = axis_boxes(spark, d)
    corners = vec.box_corners(vec.parts("center"), vec.parts("extent"), [vec.parts(F.col("axes")[i]) for i in range(3)])
    # round first: equal corners must tie exactly for "first one wins"
    grid = F.transform(corners, lambda c: F.struct(*[r(c[a], 9).alias(a) for a in "xyz"]))
    return b.withColumn("corners", grid).withColumn("_a", g.label_anchor()).select("capture_id", "box_no", *[r(F.col("_a")[a]).alias(f"a{a}") for a in "xyz"])


@query("O10_cap", sql(CLOUD, "SELECT cloud_id, l_orderkey, l_linenumber, l_partkey FROM cloud QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY l_orderkey, l_linenumber, l_partkey, z) <= 12"))
def _(spark, d):
    return vw.cap(cloud(spark, d), ["cloud_id"], [F.col(c) for c in CLOUD_ORDER], 12).select("cloud_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("M10_scene_cloud", sql([PIXELS, LIFTED], f"""SELECT capture_id, u, v, {rs('x')} AS x, {rs('z')} AS z FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY v, u) - 1 AS i,
  count(*) OVER (PARTITION BY capture_id) AS n FROM lifted WHERE u % 2 = 0 AND v % 2 = 0) WHERE n <= 10 OR i IN (SELECT k * (n - 1) // 9 FROM range(10) t(k))"""))
def _(spark, d):
    out = g.scene_cloud(pixels(spark, d), ["capture_id"], INTR, 2, *BAND, 10)
    return out.select("capture_id", "u", "v", r("x").alias("x"), r("z").alias("z"))

