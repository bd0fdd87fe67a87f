"""Detections over time: windows, latch, poses as of a moment, tracking, publishing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.functions import vec
from rigtable.functions.angles import circ_mean_deg, circ_std_deg
from rigtable.operators.geometry import Bounds, in_workspace
from rigtable.scale import number_rows, ordered_fold, running, sliding
from rigtable.session import staged


@dataclass(frozen=True)
class TrackerConfig:
    """Default thresholds of the tracker."""

    window_size: int = 10
    min_hits: int = 6
    max_misses: int = 5
    max_position_std_m: float = 0.008
    max_yaw_std_deg: float = 10.0
    min_confidence: float = 0.8
    assoc_max_dist_m: float = 0.04
    stable_enter_frames: int = 3
    stable_hysteresis: float = 1.5
    stable_conf_margin: float = 0.05


# --- windows ---------------------------------------------------------------------


def middle(values: Column) -> Column:
    """Median of an array, the mean of the two middle values when even."""
    s = F.sort_array(values)
    n = F.size(s)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (lo + hi) / 2.0


def _window_stats(frame: Window, lead: str = "") -> dict[str, Column]:
    over = lambda c: c.over(frame)
    axes = ("x", "y", "z")
    med = lambda s: vec.pack([middle(over(F.collect_list(F.col(f"{lead}{s}")[a]))) for a in axes])
    spread = [over(F.stddev_pop(F.col(f"{lead}center")[a])) for a in axes]
    return {
        "hits": over(F.count("*")),
        "center_filtered": med("center"),
        "extent_filtered": med("extent"),
        "yaw_mean_deg": circ_mean_deg(F.col("yaw_deg"), over),
        "yaw_std_deg": circ_std_deg(F.col("yaw_deg"), over),
        "position_std_m": F.sqrt(spread[0] * spread[0] + spread[1] * spread[1] + spread[2] * spread[2]),
        "confidence_mean": over(F.avg("confidence")),
        "window_reliable": over(F.avg(F.col("yaw_reliable").cast("double"))) >= 0.5,
    }


def track_window(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, n: int = 10, chunk: int = 100_000
) -> DataFrame:
    """Statistics over the last n detections of each track."""
    out = sliding(df, keys, [F.col(o) for o in order], bucket, n, _window_stats, chunk)
    return out.withColumn("yaw_filtered_deg", F.when(F.col("window_reliable"), F.col("yaw_mean_deg")).otherwise(0.0)).drop("yaw_mean_deg")


def rolling_fps(frames: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: str, bucket: Column, n: int = 30, chunk: int = 100_000) -> DataFrame:
    """Frames per second over the last n loop times."""
    over = lambda w: {"fps": F.when(F.sum(seconds).over(w) > 0, F.count(seconds).over(w) / F.sum(seconds).over(w)).otherwise(0.0)}
    return sliding(frames, keys, [F.col(o) for o in order], bucket, n, over, chunk)


def strict_ok(cfg: TrackerConfig) -> Column:
    """Enter condition of the stability flag on one windowed row."""
    yaw = ~F.col("window_reliable") | (F.col("yaw_std_deg") <= cfg.max_yaw_std_deg)
    return (
        (F.col("hits") >= cfg.min_hits)
        & (F.col("position_std_m") <= cfg.max_position_std_m)
        & yaw
        & (F.col("confidence_mean") >= cfg.min_confidence)
        & F.coalesce("in_workspace", F.lit(True))
    )


def loose_ok(cfg: TrackerConfig) -> Column:
    """Stay condition."""
    h = cfg.stable_hysteresis
    yaw = ~F.col("window_reliable") | (F.col("yaw_std_deg") <= cfg.max_yaw_std_deg * h)
    return (
        (F.col("hits") >= cfg.min_hits)
        & (F.col("position_std_m") <= cfg.max_position_std_m * h)
        & yaw
        & (F.col("confidence_mean") >= cfg.min_confidence - cfg.stable_conf_margin)
        & F.coalesce("in_workspace", F.lit(True))
    )


def latch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, enter: Column, stay: Column, k: int = 3, out: str = "stable"
) -> DataFrame:
    """Hysteresis flag: on after k entering rows in a row, off when a row may not stay.

    A row failing ``stay`` leaves the flag off whatever came before, and k entering rows
    in a row leave it on (or it was on), given that entering implies staying.  So
    the flag is whether the last completed streak is later than the last failed stay:
    running maxima, no fold.
    """
    numbered = number_rows(df.withColumns({"_en": enter & stay, "_st": stay}), keys, bucket, [F.col(o) for o in order], "_rn")
    rn = F.col("_rn")
    cut = F.floor(rn / 100_000)
    streak = running(numbered, keys, cut, [rn], {"_brk": ("max", F.when(~F.col("_en"), rn))})
    full = F.col("_en") & (rn - F.coalesce("_brk", F.lit(0)) >= k)
    done = running(streak.withColumn("_full", full), keys, cut, [rn], {"_on": ("max", F.when(F.col("_full"), rn)), "_off": ("max", F.when(~F.col("_st"), rn))})
    flag = F.coalesce(F.col("_on") > F.coalesce("_off", F.lit(0)), F.lit(False))
    return done.withColumn(out, flag).drop("_en", "_st", "_rn", "_brk", "_full", "_on", "_off")


def stability(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    return latch(df, keys, order, bucket, strict_ok(cfg), loose_ok(cfg), cfg.stable_enter_frames)


def smooth_normals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alpha: float = 0.3, every: int = 1, initial: Sequence[float] = vec.DEFAULT_NORMAL
) -> DataFrame:
    """Blended and renormalised normals per frame; every n-th frame takes a new estimate."""
    start_normal = np.array(initial, dtype=float)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {t}" for c, t in fields.items()) + ", sx DOUBLE, sy DOUBLE, sz DOUBLE"

    def step(state, part: pd.DataFrame):
        normal, seen = state
        fresh = part[["nx", "ny", "nz"]].to_numpy(float)
        out = np.empty_like(fresh)
        for i, new in enumerate(fresh):
            if every > 0 and seen % every == 0:
                mixed = (1 - alpha) * normal + alpha * new
                size = np.sqrt((mixed * mixed).sum())
                normal = new if size < 1e-6 else mixed / size
            seen += 1
            out[i] = normal
        return (normal, seen), part.assign(sx=out[:, 0], sy=out[:, 1], sz=out[:, 2])

    return ordered_fold(df, keys, order, schema, lambda key: (start_normal, 0), step)


def significant_moves(df: DataFrame, keys: Sequence[str], order: Sequence[str], xyz: Sequence[str] = ("x", "y", "z"), min_move: float = 0.005) -> DataFrame:
    """Rows farther than ``min_move`` from the last kept row of their key; the first is kept."""
    cols = list(xyz)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def step(last, part: pd.DataFrame):
        keep = np.zeros(len(part), dtype=bool)
        for i, p in enumerate(part[cols].to_numpy(float)):
            if last is None or np.sqrt(((p - last) ** 2).sum()) > min_move:
                last, keep[i] = p, True
        return last, part[keep]

    return ordered_fold(df, keys, order, schema, lambda key: None, step)


def throttle(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts", gap_s: float = 0.5) -> DataFrame:
    """At most one row per key and gap, measured from the last row let through; rows without a key or time are left out.

    A pause of at least one gap restarts the rule.  A busy key is cut where such a pause ends a day; a piece is
    streamed through one state, whole batches at a time, however many keys they hold.
    """
    keys, order, gap_us, cols = list(keys), list(order), round(gap_s * 1e6), df.columns
    timed = df.filter(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(ts)).withColumn("_b", F.floor(F.col("_us") / F.lit(86_400_000_000)))
    days = Window.partitionBy(*keys).orderBy("_b")
    fresh = F.col("_lo") - F.lag("_hi").over(days) >= gap_us
    spans = timed.groupBy(*keys, "_b").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi")).withColumn("_new", F.coalesce(fresh, F.lit(True)))
    pieces = spans.select(*keys, "_b", F.max(F.when(F.col("_new"), F.col("_b"))).over(days).alias("_piece"))
    marks = [*keys, "_piece"]
    placed = timed.join(pieces, [*keys, "_b"]).select(*cols, "_us", "_piece").repartition(*marks).sortWithinPartitions(*marks, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last = None, 0
        for batch in batches:
            keep = []
            for i, (t, mark) in enumerate(zip(batch.column("_us").to_pylist(), zip(*[batch.column(c).to_pylist() for c in marks]))):
                if mark != piece or t - last >= gap_us:
                    piece, last = mark, t
                    keep.append(i)
            if keep:
                yield batch.select(cols).take(pa.array(keep))

    return placed.mapInArrow(run, df.schema)


# --- poses as of -----------------------------------------------------------------


def asof_pose(
    dets: DataFrame,
    poses: DataFrame,
    keys: Sequence[str],
    value: Sequence[str],
    ts: str = "ts",
    tolerance_s: float | None = None,
    bucket_s: int = 3600,
) -> DataFrame:
    """Latest pose at or before each detection; ``tf_ok`` tells whether there is one.

    Both sides are stacked and read in time order inside (key, time bucket); what earlier
    buckets last knew comes in as one row per bucket, so a long session is spread.
    """
    keys, value = list(keys), list(value)
    left = dets.withColumn("_side", F.lit(1)).withColumn("_pose", F.lit(None).cast(_pose_type(poses, value, ts)))
    right = poses.select(
        *keys, F.col(ts), F.lit(0).alias("_side"), F.struct(F.col(ts).alias("pose_ts"), *value).alias("_pose")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    bucket = F.floor(F.unix_micros(ts) / F.lit(bucket_s * 1_000_000))
    known = running(both, keys, bucket, [F.col(ts), F.col("_side")], {"_last": ("last", F.col("_pose"))})
    out = known.filter("_side = 1").drop("_side", "_pose")
    age = (F.unix_micros(ts) - F.unix_micros(F.col("_last.pose_ts"))) / 1e6
    ok = F.col("_last").isNotNull() if tolerance_s is None else F.coalesce(age <= tolerance_s, F.lit(False))
    out = out.withColumn("tf_ok", ok)
    return out.withColumns({c: F.when(F.col("tf_ok"), F.col("_last")[c]) for c in ["pose_ts", *value]}).drop("_last")


def _pose_type(poses: DataFrame, value: Sequence[str], ts: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in poses.schema.fields}
    return "struct<" + ",".join([f"pose_ts:{types[ts]}"] + [f"{v}:{types[v]}" for v in value]) + ">"


def to_base(df: DataFrame, point: Sequence[str], base_T_ee: Column | str, ee_T_cam: Column | str, out: Sequence[str] = ("bx", "by", "bz")) -> DataFrame:
    """Camera point to base frame."""
    p = vec.apply_rigid(base_T_ee, vec.apply_rigid(ee_T_cam, tuple(F.col(c) for c in point)))
    return df.withColumns(dict(zip(out, p)))


def retag_workspace(df: DataFrame, bounds: Bounds | None) -> DataFrame:
    """Workspace flag from the filtered centre, else from the raw one."""
    center = F.coalesce("center_filtered", "center")
    return df.withColumn("in_workspace", in_workspace(vec.parts(center), bounds))


def to_published(tracked: DataFrame, frame_id: str = "base_link") -> DataFrame:
    """Stable detections inside the workspace as messages; needs the base position bx, by, bz."""
    zero = vec.pack(vec.lits((0, 0, 0)))
    identity = F.struct(*[F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("z", 0.0), ("w", 1.0))])
    hypothesis = F.struct(F.col("class_name").alias("class_id"), F.coalesce("confidence_mean", F.lit(0.0)).alias("score"))
    keep = [c for c in ("session_id", "frame_index", "ts") if c in tracked.columns]
    return tracked.filter(
        F.coalesce("stable", F.lit(False)) & F.coalesce("in_workspace", F.lit(True)) & F.col("bx").isNotNull()
    ).select(
        *keep,
        F.lit(frame_id).alias("frame_id"),
        F.coalesce(F.col("track_id").cast("string"), F.lit("-1")).alias("id"),
        vec.pack((F.col("bx"), F.col("by"), F.col("bz"))).alias("position"),
        identity.alias("orientation"),
        F.coalesce("extent_filtered", zero).alias("size"),
        F.array(hypothesis).alias("results"),
    )


def frame_records(tracked: DataFrame, stable_only: bool = False) -> DataFrame:
    """Rounded detection records; only located ones inside the workspace."""
    r6 = lambda c: F.bround(c, 6)
    xyz = lambda s: F.array(*[r6(F.col(s)[a]) for a in "xyz"])
    has = set(tracked.columns)
    fields = [
        F.col("class_name"),
        r6("confidence").alias("confidence"),
        xyz("center").alias("center_camera_xyz_m"),
        xyz("extent").alias("extent_xyz_m"),
        r6(F.radians("yaw_deg")).alias("yaw_rad"),
        F.bround("yaw_deg", 4).alias("yaw_deg"),
        F.coalesce("yaw_reliable", F.lit(False)).alias("yaw_reliable"),
        F.col("point_count").cast("int").alias("point_count"),
    ]
    if "stable" in has:
        fields += [
            F.col("track_id"),
            F.col("hits"),
            r6("confidence_mean").alias("confidence_mean"),
            xyz("center_filtered").alias("center_filtered_camera_xyz_m"),
            F.bround("yaw_filtered_deg", 4).alias("yaw_filtered_deg"),
            r6("position_std_m").alias("position_std_m"),
            F.bround("yaw_std_deg", 4).alias("yaw_std_deg"),
            F.col("stable"),
        ]
    rows = tracked.filter(F.col("center").isNotNull() & F.coalesce("in_workspace", F.lit(True)))
    if stable_only and "stable" in has:
        rows = rows.filter("stable")
    return rows.select("session_id", "frame_index", F.struct(*fields).alias("detection"))


# --- multi-object tracker --------------------------------------------------------

# Flat result columns of a tracked detection, in the order a book reports them.
REPORT = (
    "track_no BIGINT, hits INT, confidence_mean DOUBLE, fcx DOUBLE, fcy DOUBLE, fcz DOUBLE, fex DOUBLE, fey DOUBLE, fez DOUBLE, "
    "yaw_filtered_deg DOUBLE, position_std_m DOUBLE, yaw_std_deg DOUBLE, track_reliable BOOLEAN, stable BOOLEAN"
)
REPORT_NAMES = [part.split()[0] for part in REPORT.split(", ")]


def _median(values: list[float]) -> float:
    s = sorted(values)
    n = len(s)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def _totals(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums along the last axis of what is held (from its start on), compensated step by step as ``sum`` does."""
    high, low = 0.0 + x[..., 0], np.zeros(x.shape[:-1])
    for j in range(1, x.shape[-1]):
        v = x[..., j]
        t = high + v
        lost = np.where(np.abs(high) >= np.abs(v), (high - t) + v, (v - t) + high)
        high, low = np.where(held[:, j], t, high), np.where(held[:, j], low + lost, low)
    return np.where((low != 0) & np.isfinite(low), high + low, high)


class TrackBook:
    """Live tracks of one object class in one session.

    The book is the whole state of the recurrence: its size depends on how many objects
    are in view and on the window, never on how long the session runs.  A sample is
    (x, y, z, ex, ey, ez, yaw, confidence, reliable).
    """

    def __init__(self, cfg: TrackerConfig, next_no: int = 0, tracks: list[dict] | None = None):
        self.cfg, self.next_no, self.tracks = cfg, next_no, tracks or []

    def frame(self, index: int, samples: list[tuple], inside: list[bool]) -> list[tuple]:
        """Reports for the samples of one frame, in input order."""
        play = Play(self.cfg)
        play.take(self)
        self.follow(play, index, samples, inside)
        return list(zip(*play.reports()))

    def follow(self, play: "Play", index: int, samples: Sequence[tuple], inside: Sequence[bool]) -> list[dict]:
        """The tracks that the samples of one frame go to, in input order; ``play`` reports on them."""
        cfg = self.cfg
        self.tracks = [t for t in self.tracks if index - t["last"] - 1 <= cfg.max_misses]
        free = list(self.tracks)
        out = []
        for sample, in_workspace in zip(samples, inside):
            choice, reach, place = None, cfg.assoc_max_dist_m, sample[:3]
            for t in free:
                gap = math.dist(t["mid"], place)
                if gap <= reach:  # equal distances go to the newest track
                    choice, reach = t, gap
            if choice is None:
                choice = {"no": self.next_no, "win": [], "at": [], "streak": 0, "on": False}
                self.next_no += 1
                self.tracks.append(choice)
            else:
                free = [t for t in free if t is not choice]
            win = choice["win"] = (choice["win"] + [sample])[-cfg.window_size :]
            choice["at"] = (choice["at"] + [len(play.samples)])[-cfg.window_size :]
            choice["last"] = index
            choice["mid"] = [_median([s[i] for s in win]) for i in range(3)]
            play.samples.append(sample)
            play.said.append((choice, choice["at"], choice["mid"], in_workspace))
            out.append(choice)
        return out


class Play:
    """Windows that the samples of many frames came to, of any number of books, so that their statistics are taken at once.

    Which track a sample goes to follows from places alone; all else is a report and needs no order but that of the flag.
    """

    def __init__(self, cfg: TrackerConfig):
        self.cfg, self.samples, self.said = cfg, [], []

    def take(self, book: TrackBook) -> None:
        """Rows for the windows that a book brings along."""
        for t in book.tracks:
            t["at"] = list(range(len(self.samples), len(self.samples) + len(t["win"])))
            self.samples += t["win"]

    def reports(self) -> list[list]:
        """The columns of REPORT, a value a followed sample."""
        cfg = self.cfg
        if not self.said:
            return [[] for _ in REPORT_NAMES]
        tracks, wins, mids, inside = zip(*self.said)
        table = np.array(self.samples, dtype=float)
        hits = np.array([len(w) for w in wins])
        held = np.arange(cfg.window_size) < hits[:, None]
        at = np.zeros(held.shape, dtype=np.int64)
        at[held] = [i for w in wins for i in w]
        turned = [math.radians(y) for y in (2.0 * table[:, 6]).tolist()]
        lines = np.stack([list(map(math.sin, turned)), list(map(math.cos, turned)), table[:, 7], table[:, 8], *table[:, :3].T])[:, at]
        with np.errstate(all="ignore"):
            means = _totals(lines, held) / hits
            spread = _totals(np.float_power(lines[4:] - means[4:, :, None], 2.0), held) / hits
            pos_std = np.sqrt(_totals(spread.T, np.ones((1, 3), dtype=bool)))
        reliable = means[3] >= 0.5
        yaw, yaw_std = [], []
        for s, c, n, trusted in zip(means[0].tolist(), means[1].tolist(), hits.tolist(), reliable.tolist()):
            size = min(1.0, math.hypot(s, c))
            yaw_std.append(0.0 if n < 2 else 90.0 if size <= 1e-9 else abs(math.degrees(math.sqrt(-2.0 * math.log(size))) / 2))
            yaw.append(math.degrees(math.atan2(s, c)) / 2 if trusted else 0.0)

        def fits(slack: float, margin: float) -> list[bool]:
            steady = ~reliable | (np.array(yaw_std) <= cfg.max_yaw_std_deg * slack)
            placed = np.array(inside, dtype=bool) & (hits >= cfg.min_hits) & (pos_std <= cfg.max_position_std_m * slack)
            return (placed & steady & (means[2] >= cfg.min_confidence - margin)).tolist()

        stable = []
        for track, enters, stays in zip(tracks, fits(1.0, 0.0), fits(cfg.stable_hysteresis, cfg.stable_conf_margin)):
            if track["on"]:
                track["on"] = stays
                track["streak"] = track["streak"] if stays else 0
            else:
                track["streak"] = track["streak"] + 1 if enters else 0
                track["on"] = track["streak"] >= cfg.stable_enter_frames
            stable.append(track["on"])
        sizes = table[:, 3:6].T[:, at]
        ranked = np.sort(np.where(held, sizes, np.inf), axis=2)
        row = np.arange(len(hits))
        extents = np.where(hits % 2 == 1, ranked[:, row, hits // 2], (ranked[:, row, hits // 2 - 1] + ranked[:, row, hits // 2 % cfg.window_size]) / 2)
        for k in np.flatnonzero(np.isnan(np.where(held, sizes, 0.0)).any(axis=(0, 2))).tolist():
            extents[:, k] = [_median(sizes[i, k, : hits[k]].tolist()) for i in range(3)]
        return [
            [t["no"] for t in tracks], hits.tolist(), means[2].tolist(), *[list(m) for m in zip(*mids)], *extents.tolist(),
            yaw, pos_std.tolist(), yaw_std, reliable.tolist(), stable,
        ]


# What the fold reads of a detection, flat so that Arrow hands over plain arrays.
SAMPLE = {
    **{f"_c{a}": f"center.{a}" for a in "xyz"},
    **{f"_e{a}": f"extent.{a}" for a in "xyz"},
    "_yaw": "yaw_deg",
    "_conf": "confidence",
}


def apart(df: DataFrame, keys: Sequence[str], xyz: Sequence[Column], gate: float, out: str = "_region") -> DataFrame:
    """Rows with the number of their region: along some axis, regions of a key lie more than ``gate`` apart.

    A track's centre is a median per axis, so it stays between its detections on every
    axis and never comes within the gate of another region: regions can be tracked alone.
    Rows are reduced map-side to occupied cells of gate size; x, y and z are cut in turn at
    empty slabs, by windows over one key's occupied cells, whose number follows from
    the space in view and not from the length of a session.  Places that are not finite
    are within the gate of nothing; they share region 0.
    """
    keys = list(keys)
    # A margin for rounding: a distance just over the gate may be computed as the gate itself.
    wide = gate * (1 + 1e-9)
    finite = F.lit(True)
    for c in xyz:
        finite = finite & (F.abs(c) < 1e12)
    cells = [f"_q{i}" for i in range(3)]
    placed = df.withColumns({q: F.when(finite, F.floor(c / gate)) for q, c in zip(cells, xyz)})
    ends = [f(c).alias(f"_{n}{i}") for i, c in enumerate(xyz) for n, f in (("lo", F.min), ("hi", F.max))]
    # One exchange by key serves all windows.
    found = placed.filter(finite).groupBy(*keys, *cells).agg(*ends).repartition(*keys)
    cuts = []
    for i in range(3):
        slab = Window.partitionBy(*keys, *cuts, f"_q{i}")
        along = Window.partitionBy(*keys, *cuts).orderBy(f"_q{i}")
        empty = F.min(f"_lo{i}").over(slab) - F.max(f"_hi{i}").over(along.rangeBetween(Window.unboundedPreceding, -1))
        found = found.withColumn("_cut", F.when(empty > wide, F.col(f"_q{i}")))
        found = found.withColumn(f"_cut{i}", F.max("_cut").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_cut")
        cuts.append(f"_cut{i}")
    found = found.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*cuts)).cast("long"))
    found = found.select(*[F.col(k).alias(f"_r{j}") for j, k in enumerate(keys + cells)], out)
    same = F.lit(True)
    for j, k in enumerate(keys + cells):
        same = same & (placed[k].eqNullSafe(found[f"_r{j}"]) if k in keys else placed[k] == found[f"_r{j}"])
    return placed.join(found, same, "left").drop(*cells, *[f"_r{j}" for j in range(len(keys) + 3)]).withColumn(out, F.coalesce(out, F.lit(0)))


def track(dets: DataFrame, cfg: TrackerConfig = TrackerConfig(), session: str = "session_id", frame_block: int = 10_000) -> DataFrame:
    """Greedy tracking over a stored detection table (``det_idx`` is the input order of a frame).

    Classes never compete, nor do regions of space farther apart than the gate (``apart``),
    and no track survives ``max_misses`` empty frames, so each (session, class, region) is
    cut at such gaps and the pieces run in parallel.  Inside a piece the recurrence needs
    only the live tracks.  Track ids count creations per session.
    """
    located = dets.filter(F.col("center").isNotNull())
    located = apart(located, [session, "class_name"], [F.col("center")[a].cast("double") for a in "xyz"], cfg.assoc_max_dist_m)
    key = [session, "class_name", "_region"]
    # Steps of as many frames as end a track hold no gap that ends one, so pieces are found on one row a step.
    step = F.floor(F.col("frame_index") / (cfg.max_misses + 1))
    stepped = located.withColumn("_step", step)
    steps = stepped.groupBy(*key, "_step").agg(F.min("frame_index").alias("_from"), F.max("frame_index").alias("_to"))
    block, order = F.floor(F.col("_from") / frame_block), [F.col("_step")]
    gap = running(steps, key, block, order, {"_prev": ("last", F.col("_to"))}, exclusive=True)
    fresh = F.col("_prev").isNull() | (F.col("_from") - F.col("_prev") - 1 > cfg.max_misses)
    cut = running(gap.withColumn("_new", fresh.cast("int")), key, block, order, {"_piece": ("sum", F.col("_new"))})
    pieces = stepped.join(cut.select(*key, "_step", "_piece"), key + ["_step"]).drop("_step")
    flat = pieces.withColumns({n: F.col(c).cast("double") for n, c in SAMPLE.items()}).withColumns(
        {"_rel": F.coalesce("yaw_reliable", F.lit(False)), "_in": F.coalesce("in_workspace", F.lit(True))}
    )
    tracked = _fold_frames(flat, key + ["_piece"], cfg)
    tracked = staged(tracked.drop(*SAMPLE, "_rel", "_in"))  # read twice
    creators = tracked.groupBy(*key, "_piece", "track_no").agg(F.min(F.struct("frame_index", "det_idx")).alias("_f"))
    ids = number_rows(
        creators.withColumns({"_ff": F.col("_f.frame_index"), "_fd": F.col("_f.det_idx")}),
        [session], F.floor(F.col("_ff") / frame_block), [F.col("_ff"), F.col("_fd")], "_no",
    ).select(*key, "_piece", "track_no", (F.col("_no") - 1).alias("track_id"))
    return (
        nest_report(tracked).join(ids, key + ["_piece", "track_no"])
        .drop("_piece", "_region", "track_no")
        .withColumn("yaw_filtered_rad", F.radians("yaw_filtered_deg"))
    )


def nest_report(df: DataFrame) -> DataFrame:
    point = lambda p: vec.pack(tuple(F.col(f"{p}{a}") for a in "xyz"))
    return df.withColumns({"center_filtered": point("fc"), "extent_filtered": point("fe")}).drop(
        *[f"{p}{a}" for p in ("fc", "fe") for a in "xyz"]
    )


def _fold_frames(pieces: DataFrame, keys: Sequence[str], cfg: TrackerConfig) -> DataFrame:
    """Plays sorted rows through a book; the last frame of a batch waits for its remaining rows."""
    keys = list(keys)
    marks_of = keys + ["frame_index"]
    kinds = [{"BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_()}[part.split()[1]] for part in REPORT.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", " + REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, current, held = None, None, None

        def play(data: pa.RecordBatch, heads: list[tuple], starts: list[int]) -> pa.RecordBatch:
            nonlocal book, current
            plain = lambda c: data.column(c).to_numpy(zero_copy_only=False).tolist()
            samples, inside = list(zip(*[plain(c) for c in (*SAMPLE, "_rel")])), plain("_in")
            now = Play(cfg)
            if book is not None:
                now.take(book)
            for lo, hi in zip(starts, [*starts[1:], data.num_rows]):
                *key, frame = heads[lo]
                if key != current:
                    current, book = key, TrackBook(cfg)
                book.follow(now, math.nan if frame is None else frame, samples[lo:hi], inside[lo:hi])
            told = [pa.array(c, k) for c, k in zip(now.reports(), kinds)]
            return pa.RecordBatch.from_arrays([*data.columns, *told], names=[*data.schema.names, *REPORT_NAMES])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            heads = list(zip(*[data.column(k).to_pylist() for k in marks_of]))
            # A null frame is one of its own.
            starts = [i for i, h in enumerate(heads) if not i or h[-1] is None or h != heads[i - 1]]
            held = data.slice(starts[-1])
            if starts[-1]:
                yield play(data.slice(0, starts[-1]), heads, starts[:-1])
        if held is not None:
            yield play(held, [tuple(held.column(k)[0].as_py() for k in marks_of)], [0])

    return (
        pieces.repartition(*keys)
        .sortWithinPartitions(*keys, "frame_index", "det_idx")
        .mapInArrow(run, schema)
    )
