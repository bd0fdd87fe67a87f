"""Hard negatives of anchors: exact search that rules rows out by segment summaries before it scores them.

A vector is cut into segments; each keeps its mean m and deviation s (root mean square about the mean).  For segments
of length L the inner product of two vectors is the sum of L * m * m' and a rest that no segment's L * s * s'
exceeds, so the sum of L * (m * m' +- s * s') bounds a score from both sides.  Rows that these bounds leave are looked
at again with finer segments (``LEVELS``), and only then scored, exactly, in integers.

Spark partitions both sides into blocks by (dimension, label, signs of coarse means), a hot label over several blocks.
Blocks have summaries of their own (the span of their segment means, their largest deviations): pairs of an anchor
block and a row block whose bounds, labels or dimensions leave nothing to find are not formed, and every other pair is
one piece of work.  First the positives: the highest scores of an anchor among rows of its label.  These give each anchor the
score windows its negatives must lie in, which then bound blocks and rows.  A piece of work gives the best of each
window; the best of all pieces are ranked in one window an anchor.

Rows that take no part: a null id, label or vector, an empty vector, null or non-finite components, and components so
large that a score would not fit a long (dimension * component ** 2 beyond 2 ** 62).  Rows that agree in id, label and
vector are one.  Rows that share an anchor's id are not "other" rows.  Vectors of different lengths have no score.
Ties go to the smaller id, then to the smaller label and vector hash.  An anchor without positives has no negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.llm.common import shuffle_parts, stage

#: Components of a block, about; anchors scored at once; segments of each level of row summaries and of a block's.
BLOCK, ANCHORS = 1 << 20, 256
LEVELS, COARSE = (1, 4, 16), 8
EXACT = 1 << 53
#: Below and above all scores.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def whole(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers, floor(scale * x); null if the vector takes no part."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.lit(float(scale)) * v)
    limit = F.sqrt(F.lit(2.0**62) / F.size(x))
    fits = (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < limit), F.lit(False)))
    return F.when(fits, F.transform(x, lambda v: F.floor(v)))


def cuts(dim: int, segments: int) -> np.ndarray:
    """Where segments begin; no more segments than components."""
    return np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int)[:-1])


def summary(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means and deviations, both times the root of the segment's length."""
    begin = cuts(m.shape[1], segments)
    length = np.diff(np.append(begin, m.shape[1]))
    mean = np.add.reduceat(m, begin, axis=1) / length
    apart = m - np.repeat(mean, length, axis=1)
    dev = np.sqrt(np.add.reduceat(apart * apart, begin, axis=1))
    return mean * np.sqrt(length), dev


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of all pairs, widened by what rounding may cost."""
    centre, rest = a[0] @ b[0].T, a[1] @ b[1].T
    size = np.sqrt((a[0] ** 2 + a[1] ** 2).sum(axis=1))[:, None] * np.sqrt((b[0] ** 2 + b[1] ** 2).sum(axis=1))
    rest += 1e-9 * size + 1e-6
    return centre - rest, centre + rest


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; a and b hold longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def at_least(values: np.ndarray, k: int, none: float) -> np.ndarray:
    """The k-th largest of each row, ``none`` where it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), none, values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Side:
    """One side of a piece of work: ids, labels, tie hashes and vectors of one dimension."""

    def __init__(self, rows: pa.Table, dim: int):
        self.rows, self.dim = rows, dim
        self.id, self.label, self.mark = (rows.column(c).to_numpy() for c in ("id", "label", "mark"))
        self.v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dim)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) wanted scores: anchor x window, padded by empty ones."""
        held = [self.rows.column(c).combine_chunks() for c in ("low", "high")]
        ends = np.asarray(held[0].offsets, dtype=np.int64)
        ends, width = ends - ends[0], int(np.diff(ends).max(initial=0))
        low, high = np.full((len(self.rows), width), HIGHEST), np.full((len(self.rows), width), LOWEST)
        at = np.repeat(np.arange(len(self.rows)), np.diff(ends)), np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        low[at], high[at] = held[0].flatten().to_numpy(), held[1].flatten().to_numpy()
        return low, high


def search(a: Side, b: Side, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor index, window, row index, score) of the ``k`` best rows in every window of every anchor.

    same: rows of the anchor's label, else of others.  Windows are closed; rows of the anchor's id are left out.
    """
    found = []
    order = np.lexsort((b.mark, b.label, b.id))
    ids, labels, v = b.id[order], b.label[order], b.v[order]
    real = v.astype(np.float64)
    fine = [summary(real, s) for s in LEVELS]
    for start in range(0, len(a.id), ANCHORS):
        mine = slice(start, start + ANCHORS)
        lo, hi = low[mine], high[mine]
        av = a.v[mine]
        live = np.arange(len(ids))
        allowed = ((a.label[mine, None] == labels) == same) & (a.id[mine, None] != ids)
        mean_dev = [summary(av.astype(np.float64), s) for s in LEVELS]
        floor = lo.astype(np.float64)
        for left, right in zip(mean_dev, fine, strict=True):
            below, above = bounds(left, (right[0][live], right[1][live]))
            useful = np.zeros_like(allowed)
            for j in range(lo.shape[1]):
                # k rows certain to lie in the window raise what a further row must reach.
                sure = allowed & (above <= hi[:, j, None]) & (below >= lo[:, j, None])
                floor[:, j] = np.maximum(floor[:, j], at_least(np.where(sure, below, -np.inf), k, -np.inf))
                useful |= allowed & (above >= floor[:, j, None]) & (below <= hi[:, j, None])
            keep = useful.any(axis=0)
            live, allowed = live[keep], useful[:, keep]
            if not len(live):
                break
        if not len(live):
            continue
        exact = scores(av, v[live])
        for j in range(lo.shape[1]):
            inside = allowed & (exact >= lo[:, j, None]) & (exact <= hi[:, j, None])
            worst = at_least(np.where(inside, exact, LOWEST), k, LOWEST)
            who, what = np.nonzero(inside & (exact >= worst[:, None]))
            best = np.lexsort((what, -exact[who, what], who))  # rows are in the order of ties
            who, what = who[best], what[best]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            who, what = who[rank < k], what[rank < k]
            found.append((who + start, np.full(len(who), j), order[live[what]], exact[who, what]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- blocks -----------------------------------------------------------------


def sizes(rows: DataFrame, least: int) -> int:
    """Blocks of about ``BLOCK`` components."""
    return max(least, -(-(rows.agg(F.sum("dim")).first()[0] or 0) // BLOCK))


def blocked(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``block``: ranges of (dimension, label, signs of coarse means, id), written once so that they stay; number of blocks."""
    n = sizes(rows, shuffle_parts(rows.sparkSession))
    width = F.greatest(F.floor(F.size("v") / COARSE), F.lit(1))
    part = lambda i: F.aggregate(F.slice("v", (i * width + 1).cast("int"), width.cast("int")), F.lit(0).cast("long"), lambda s, x: s + F.signum(x).cast("long"))
    signs = sum(((part(i) > 0).cast("int") * 2**i for i in range(COARSE)), F.lit(0))
    ranged = rows.withColumn("signs", signs).repartitionByRange(n, "dim", "label", "signs", "id", "mark")
    return stage(ranged.withColumn("block", F.spark_partition_id()).drop("signs"), "negative-rows"), n


def block_table(rows: DataFrame, windows: bool = False) -> DataFrame:
    """One row a block and dimension: labels, spans of segment means, largest deviations and, with windows, the scores wanted."""

    def fold(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        side = Side(group, dim)
        mean, dev = summary(side.v.astype(np.float64), COARSE)
        low, high = side.windows() if windows else (np.array([[LOWEST]]), np.array([[HIGHEST]]))
        wrap = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
        names = ["block", "dim", "label_low", "label_high", "mean_low", "mean_high", "dev", "low", "high"]
        values = [pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([dim], pa.int32()), pa.array([side.label.min()], pa.int64()), pa.array([side.label.max()], pa.int64())]
        values += [wrap(mean.min(axis=0)), wrap(mean.max(axis=0)), wrap(dev.max(axis=0)), pa.array([float(low.min(initial=HIGHEST))]), pa.array([float(high.max(initial=LOWEST))])]
        return pa.table(dict(zip(names, values, strict=True)))

    schema = "block int, dim int, label_low long, label_high long, mean_low array<double>, mean_high array<double>, dev array<double>, low double, high double"
    return rows.groupBy("block", "dim").applyInArrow(fold, schema)


def block_pairs(anchors: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """Pairs (a, r) of blocks that may hold a wanted score; one row a block on either side."""
    a = anchors.select("dim", *[F.col(c).alias(f"a_{c}") for c in ("block", "label_low", "label_high", "mean_low", "mean_high", "dev", "low", "high")])
    r = rows.drop("low", "high")
    labels = (F.col("a_label_low") <= F.col("label_high")) & (F.col("label_low") <= F.col("a_label_high"))
    if not same:
        labels = ~((F.col("a_label_low") == F.col("a_label_high")) & (F.col("label_low") == F.col("label_high")) & (F.col("label_low") == F.col("a_label_low")))
    parts = F.arrays_zip("a_mean_low", "a_mean_high", "a_dev", "mean_low", "mean_high", "dev")
    products = lambda x: [x[p] * x[q] for p in ("a_mean_low", "a_mean_high") for q in ("mean_low", "mean_high")]
    total = lambda part: F.aggregate(parts, F.lit(0.0), lambda s, x: s + part(x))
    above = total(lambda x: F.greatest(*products(x)) + x["a_dev"] * x["dev"])
    below = total(lambda x: F.least(*products(x)) - x["a_dev"] * x["dev"])
    size = total(lambda x: F.greatest(*[F.abs(p) for p in products(x)]) + x["a_dev"] * x["dev"])
    slack = 1e-9 * size + 1e-6
    pairs = a.join(r, "dim").where(labels).where((above + slack >= F.col("a_low")) & (below - slack <= F.col("a_high")))
    return pairs.select("dim", F.col("a_block").alias("a"), F.col("block").alias("r"))


def compared(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """Rows (anchor_id, anchor_label, anchor_mark, window, id, label, mark, score): the ``k`` best of each piece of work."""
    left = anchors.join(pairs.withColumnRenamed("a", "block"), ["dim", "block"])
    right = rows.join(pairs.withColumnRenamed("r", "block"), ["dim", "block"])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int32() if c == "window" else pa.int64()) for c in ("anchor_id", "anchor_label", "anchor_mark", "window", "id", "label", "mark", "score")])
        if not len(a) or not len(b):
            return schema.empty_table()
        dim = a.column("dim")[0].as_py()
        a, b = Side(a, dim), Side(b, dim)
        low, high = (np.full((len(a.id), 1), LOWEST), np.full((len(a.id), 1), HIGHEST)) if same else a.windows()
        who, window, what, score = search(a, b, same, low, high, k)
        columns = (a.id[who], a.label[who], a.mark[who], window, b.id[what], b.label[what], b.mark[what], score)
        return pa.table([pa.array(x.astype(np.int64)).cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    out = "anchor_id long, anchor_label long, anchor_mark long, window int, id long, label long, mark long, score long"
    left, right = left.withColumnRenamed("block", "a"), right.withColumnRenamed("block", "r")
    return left.groupBy("dim", "a", "r").cogroup(right.groupBy("dim", "a", "r")).applyInArrow(meet, out)


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "label", "mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: id long, label, v array<long> (see ``whole``; null takes no part); is_anchor: a condition on these columns.
    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    usable = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v", is_anchor.alias("anchor")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    usable = usable.distinct().withColumn("mark", F.xxhash64("v")).withColumn("dim", F.size("v"))
    pool, n = blocked(stage(usable, "negative-usable"))
    anchors = pool.where("anchor").drop("anchor")
    # Anchors of neighbouring row blocks are one block.
    few = min(sizes(anchors, 1), n)
    anchors = stage(anchors.withColumn("block", F.least(F.floor(F.col("block") * few / n), F.lit(few - 1)).cast("int")), "negative-anchors")
    pool = pool.drop("anchor")
    table = stage(block_table(pool), "negative-blocks")
    pairs = stage(block_pairs(block_table(anchors), table, True), "negative-pairs")
    me = ["anchor_id", "anchor_label", "anchor_mark"]
    near = stage(best(compared(anchors, pool, pairs, True, positives), me, positives), "negative-positives")
    # Windows in the order of positives: rank j is window j - 1.  At most ``positives`` a row.
    score = F.col("score").cast("decimal(20,0)")
    window = F.struct("rank", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    windows = near.groupBy(*me).agg(F.sort_array(F.collect_list(window)).alias("w"))
    windows = windows.select(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"), F.col("anchor_mark").alias("mark"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asking = stage(anchors.join(windows, ["id", "label", "mark"]), "negative-windows")
    pairs = stage(block_pairs(block_table(asking, windows=True), table, False), "negative-pairs")
    far = best(compared(asking, pool, pairs, False, negatives), [*me, "window"], negatives)
    told = near.select(*me, (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(told, [*me, "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), whole(F.col("embedding")).alias("v"))
    return mine(rows, F.col("id") % 100 == 0)


#: ``op13`` in DuckDB's SQL.
ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
