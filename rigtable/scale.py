"""Building blocks that keep one hot key from landing in one task.

Everything here is exact.  Running values are computed inside (key, bucket) and
completed with what earlier buckets hold, so a key is spread over its buckets;
order statistics bracket the wanted ranks by a sketch and read what lies inside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigtable.session import settle

# Points of a group's rank grid; the grid steps that a rank may be off by (sketch: a tenth; deviations: both ends, each by a step and a tenth).
GRID, SLACK, SLACK_APART = 500, 2, 4
# Rows by which a rank may be off besides.
NEAR = 4
LARGEST = 1.7976931348623157e308


# --- order statistics -------------------------------------------------------


def ordered(x: Column) -> Column:
    """Finite stand-in with the same order: NaN above all, as Spark sorts it."""
    return F.when(F.isnan(x), LARGEST).otherwise(F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST)))


def rank_grid(x: Column) -> Column:
    """Aggregate: values of ``x`` at ``GRID`` + 1 evenly spaced ranks, from a mergeable sketch."""
    return F.percentile_approx(ordered(x), [i / GRID for i in range(GRID + 1)], 10 * GRID)


def bracket(grid: Column, n: Column, p: float, slack: int = SLACK) -> tuple[Column, Column]:
    """Values that the two rows around quantile ``p`` lie between, for groups of every size.

    The sketch is right to one row in 10 * ``GRID``, a tenth of a grid step; ``NEAR`` rows more, counted in grid steps of the
    group, cover rounding of ranks where a step is less than a row.  A bracket so holds about 2 * ``NEAR`` rows of a small group.
    """
    spot, near = p * GRID, F.lit(slack) + F.ceil(F.lit(float(NEAR * GRID)) / n)
    low, high = F.lit(math.floor(spot)) - near, F.lit(math.ceil(spot)) + near
    return (
        F.when(low < 0, -LARGEST).otherwise(F.get(grid, F.greatest(low, F.lit(0)).cast("int"))),
        F.when(high > GRID, LARGEST).otherwise(F.get(grid, F.least(high, F.lit(GRID)).cast("int"))),
    )


def picked(rows: DataFrame, keys: Sequence[str], value: Column, wanted: Sequence[tuple[str, str, str, float]], carry: Sequence[str] = ()) -> DataFrame:
    """One row per key with ``carry`` and the exact, linearly interpolated quantiles (name, low column, high column, p) of ``value``.

    The columns of brackets, ``carry`` and ``_n`` are constant in a key.  Values in a bracket are counted, so ties are one row, and ranks
    are running counts over distinct values; no group becomes an array.
    """
    keys, edges = list(keys), [c for _, low, high, _ in wanted for c in (low, high)]
    src = rows.select(*keys, *dict.fromkeys(["_n", *carry, *edges]), value.alias("_y")).withColumn("_spot", ordered(F.col("_y")))
    inside = [(F.col("_spot") >= F.col(low)) & (F.col("_spot") <= F.col(high)) for _, low, high, _ in wanted]
    held = inside[0]
    for more in inside[1:]:
        held = held | more
    # The row of null holds what is in no bracket and comes first; values under a bracket come before those inside.
    counted = src.withColumn("_v", F.when(held, F.col("_y"))).groupBy(*keys, "_v").agg(
        F.first("_n").alias("_n"), *[F.first(c).alias(c) for c in carry],
        *[F.count_if(F.col("_spot") < F.col(low)).alias(f"_b{i}") for i, (_, low, _, _) in enumerate(wanted)],
        *[F.count_if(x).alias(f"_c{i}") for i, x in enumerate(inside)],
    )
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({f"_r{i}": F.sum(F.col(f"_b{i}") + F.col(f"_c{i}")).over(upto) for i in range(len(wanted))})
    found = []
    for i, (_, _, _, p) in enumerate(wanted):
        spot = F.lit(p) * (F.col("_n") - 1)
        for side, rank in (("l", F.floor(spot)), ("h", F.ceil(spot))):
            here = (rank < F.col(f"_r{i}")) & (rank >= F.col(f"_r{i}") - F.col(f"_c{i}"))
            found.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
    ends = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *[F.first(c).alias(c) for c in carry if c != "_n"], *found)
    out = []
    for i, (name, _, _, p) in enumerate(wanted):
        spot = F.lit(p) * (F.col("_n") - 1)
        low, high, share = F.col(f"_l{i}"), F.col(f"_h{i}"), spot - F.floor(spot)
        out.append(F.when((share == 0) | (low == high), low).otherwise(low + (high - low) * share).alias(name))
    return ends.select(*keys, *dict.fromkeys(["_n", *carry]), *out)


def with_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beside their group's values; null keys match each other."""
    named = stats.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(named[f"_s_{k}"])
    return df.join(named, same).drop(*[f"_s_{k}" for k in keys])


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles named by ``probs``; null values are left out.

    One plan for groups of any size, from two map-side combined passes: a rank sketch per group brackets each
    quantile to about one per cent of the rows and a few (more where values are tied), then the rows below and each value inside are counted.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    sketch = data.groupBy(*keys).agg(F.count("*").alias("_n"), rank_grid(F.col("_x")).alias("_grid"))
    for i, p in enumerate(probs.values()):
        low, high = bracket(F.col("_grid"), F.col("_n"), p)
        sketch = sketch.withColumns({f"_lo{i}": low, f"_hi{i}": high})
    wanted = [(name, f"_lo{i}", f"_hi{i}", p) for i, (name, p) in enumerate(probs.items())]
    return picked(with_stats(data, sketch.drop("_grid"), keys), keys, F.col("_x"), wanted).drop("_n")


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (keys, _med, _mad): exact median and median absolute deviation of each group.

    The grid that brackets the median also brackets the deviations, so the rows are read three times and never
    ranked as a whole.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    sketch = data.groupBy(*keys).agg(F.count("*").alias("_n"), rank_grid(F.col("_x")).alias("_grid"))
    low, high = bracket(F.col("_grid"), F.col("_n"), 0.5)
    ready = sketch.withColumns({"_lo": low, "_hi": high})
    centre = picked(with_stats(data, ready.drop("_grid"), keys), keys, F.col("_x"), [("_med", "_lo", "_hi", 0.5)])
    centre = with_stats(centre, sketch.select(*keys, "_grid"), keys)
    centre = centre.withColumn("_grid", F.sort_array(F.transform("_grid", lambda g: ordered(F.abs(g - F.col("_med"))))))
    low, high = bracket(F.col("_grid"), F.col("_n"), 0.5, SLACK_APART)
    ready = centre.withColumns({"_lo": low, "_hi": high}).drop("_grid")
    apart = F.abs(F.col("_x") - F.col("_med"))
    return picked(with_stats(data, ready, keys), keys, apart, [("_mad", "_lo", "_hi", 0.5)], ["_med"]).drop("_n")


# --- running values over (key, bucket) --------------------------------------


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: dict[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum`` / ``count`` / ``max`` / ``min`` / ``last`` (last non-null) per key.

    ``bucket`` must not decrease along ``order``.  Rows meet only inside their
    (key, bucket); what came before is one small row per bucket.
    """
    keys = list(keys)
    cols = df.columns
    src = df.withColumn("_b", bucket).withColumn("_o", F.struct(*order))
    per_bucket, carry, inside, final = [], [], [], []
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow
    )
    for name, (kind, col) in values.items():
        src = src.withColumn(f"_v_{name}", col)
        value = F.col(f"_v_{name}")
        if kind in ("sum", "count"):
            fold = F.sum if kind == "sum" else F.count
            per_bucket.append(fold(value).alias(f"_p_{name}"))
            carry.append(F.sum(f"_p_{name}").over(before).alias(f"_c_{name}"))
            inside.append(fold(value).over(here))
            final.append(
                lambda c, i: F.when(c.isNull() & i.isNull(), F.lit(None)).otherwise(
                    F.coalesce(c, F.lit(0)) + F.coalesce(i, F.lit(0))
                )
            )
        elif kind in ("max", "min"):
            fold = F.max if kind == "max" else F.min
            both = F.greatest if kind == "max" else F.least
            per_bucket.append(fold(value).alias(f"_p_{name}"))
            carry.append(fold(f"_p_{name}").over(before).alias(f"_c_{name}"))
            inside.append(fold(value).over(here))
            final.append(lambda c, i, both=both: both(c, i))
        elif kind == "last":
            per_bucket.append(
                F.max_by(value, F.when(value.isNotNull(), F.col("_o"))).alias(f"_p_{name}")
            )
            carry.append(F.last(f"_p_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
            inside.append(F.last(value, ignorenulls=True).over(here))
            final.append(lambda c, i: F.coalesce(i, c))
        else:
            raise ValueError(f"unknown running value {kind!r}")
    carried = src.groupBy(*keys, "_b").agg(*per_bucket).select(*keys, "_b", *carry)
    joined = src.join(carried, keys + ["_b"])
    done = joined.select(
        *cols,
        *[fin(F.col(f"_c_{n}"), ins).alias(n) for n, ins, fin in zip(values, inside, final)],
    )
    return done


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, bucket, order, {out: ("count", F.lit(1))})


def with_halo(df: DataFrame, keys: Sequence[str], position: str, halo: int, chunk: int = 100_000) -> DataFrame:
    """Cut each key into equal chunks; every chunk also gets the ``halo`` rows before it.

    Adds ``_chunk`` and ``_extra`` (true on the borrowed rows, to be dropped after
    the frame function).  Windows then run over keys + ``_chunk``.
    """
    if chunk < halo:
        raise ValueError("chunk must hold at least halo rows")
    at = F.col(position) - 1
    home = F.floor(at / chunk)
    tail = (at % chunk) >= chunk - halo
    spots = F.when(
        tail,
        F.array(
            F.struct(home.alias("c"), F.lit(False).alias("x")),
            F.struct((home + 1).alias("c"), F.lit(True).alias("x")),
        ),
    ).otherwise(F.array(F.struct(home.alias("c"), F.lit(False).alias("x"))))
    return (
        df.withColumn("_s", F.explode(spots))
        .withColumn("_chunk", F.col("_s.c"))
        .withColumn("_extra", F.col("_s.x"))
        .drop("_s")
    )


def sliding(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, rows: int, values: Callable[[Window], dict[str, Column]], chunk: int = 100_000
) -> DataFrame:
    """Columns over the last ``rows`` rows of each key, which is cut into chunks that borrow the rows before."""
    keys = list(keys)
    cols = df.columns
    numbered = number_rows(df, keys, bucket, order, "_rn")
    cut = with_halo(numbered, keys, "_rn", rows - 1, chunk)
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(-(rows - 1), 0)
    return (
        cut.select(*cols, "_extra", *[c.alias(n) for n, c in values(frame).items()])
        .filter(~F.col("_extra"))
        .drop("_extra")
    )


# --- ordered folds -----------------------------------------------------------


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: T.StructType | str,
    start: Callable[[tuple], object],
    step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]],
) -> DataFrame:
    """Fold a true recurrence along each key, holding one Arrow batch and one state.

    Rows are shuffled by key, sorted inside the partition (spilling as needed) and
    passed through in batches, so no group is ever held whole.  Use it only where the
    next value depends on the previous result; split keys further where the
    recurrence restarts.
    """
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy()
            marks[0] = True
            bounds = [i for i, m in enumerate(marks) if m] + [len(batch)]
            heads = list(zip(*[batch[k] for k in keys]))
            outs = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                key = heads[lo]
                if current is None or key != current:
                    current, state = key, start(key)
                state, out = step(state, batch.iloc[lo:hi])
                if len(out):
                    outs.append(out)
            if outs:
                yield pd.concat(outs, ignore_index=True)

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    )


# --- connected components ------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes of undirected links (a, b); root is the smallest node that can be reached.

    Stars alternate: every node hangs its greater neighbours, then its smaller ones, under the smallest neighbour it knows,
    until nothing changes.  The rounds, each one written table, grow with the logarithm of the longest chain.
    """
    cur = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        cur = settle(down.where(F.col("a") != F.col("b")).distinct())
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
