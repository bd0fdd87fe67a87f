"""Keyed state over detection and telemetry streams, on Spark's arbitrary stateful operator with typed state and timers.

Rows of a key are played in event order.  With ``delay`` a row waits until the watermark has passed its time slot, so the
result does not depend on how the input was cut into micro-batches; without it the rows of a micro-batch are played when they
arrive.  Waiting rows lie in map state in chunks of an Arrow batch: a slot of many rows is a chunk, neighbouring slots of few rows share
one, and slots that are due are played together up to ``MANY`` rows.  So calls grow with the rows, not with the slots, and a key holds no
more than one slot and ``MANY`` rows for each chunk that overlaps it.  Rows without a key are left out.  What an operator remembers is typed value and map state; with ``idle_s`` a timer lets idle keys go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rigtable.operators.tracking import REPORT, Play, TrackBook, TrackerConfig, nest_report

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Names with a leading underscore do not reach a processor.
US = "event_us"
# Rows up to which neighbouring slots share a chunk, or a call of ``play``.
MANY = 2000
# A time after all others.
_ALL_MS = 2**52


class InOrder(StatefulProcessor):
    """Plays the rows of a key by time slot; subclasses keep their own state.

    Hooks: ``open`` declares state, ``play`` takes sorted rows, ``due`` tells when (ms) silence means something, ``lapse`` what,
    ``forget`` clears.  ``alone``: whether slots are played one by one if idle keys go, since ``play`` does not see to silence itself.
    """

    alone = True

    def __init__(self, columns: Sequence[str], order: Sequence[str], slot_us: int, waits: bool, idle_s: float | None, timed: bool):
        self.columns, self.order, self.slot_us = list(columns), list(order), slot_us
        self.waits, self.idle_ms, self.timed = waits, None if idle_s is None else int(idle_s * 1000), timed

    # --- hooks

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def play(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def due(self) -> int | None:
        return None

    def lapse(self, key: tuple) -> pd.DataFrame | None:
        return None

    def forget(self) -> None:
        raise NotImplementedError

    # --- machinery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot BIGINT", "chunks INT, last BIGINT")
        self.chunks = handle.getMapState("chunks", "slot BIGINT, no INT", "rows BINARY")
        self.newest = handle.getValueState("newest", "ms BIGINT")
        self.open(handle)

    def close(self) -> None:
        pass

    def _pending(self) -> dict[int, tuple[int, int]]:
        """Chunks that wait and the last slot they reach, by their first slot, in order."""
        return dict(sorted((k[0], (v[0], v[1])) for k, v in self.slots.iterator()))

    def _keep(self, rows: pd.DataFrame, pending: dict[int, tuple[int, int]]) -> None:
        slot = rows[US].to_numpy() // self.slot_us
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        starts = np.append(np.flatnonzero(np.diff(slot, prepend=slot[:1] - 1)), len(slot)).tolist()
        low = 0
        for here, end in zip(starts[1:], [*starts[2:], None]):
            # The next slot joins while all stays small.
            if end is not None and end - low <= MANY:
                continue
            at, last = int(slot[low]), int(slot[here - 1])
            part = pa.RecordBatch.from_pandas(rows.iloc[order[low:here]], preserve_index=False)
            low = here
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            no, reach = pending.get(at, (0, at))
            self.chunks.updateValue((at, no), (sink.getvalue().to_pybytes(),))
            pending[at] = (no + 1, max(reach, last))
            self.slots.updateValue((at,), pending[at])

    def _take(self, at: int, chunks: int) -> pd.DataFrame:
        held = []
        for no in range(chunks):
            held.append(pa.ipc.open_stream(bytes(self.chunks.getValue((at, no))[0])).read_all())
            self.chunks.removeKey((at, no))
        self.slots.removeKey((at,))
        return pa.concat_tables(held, promote_options="permissive").to_pandas()

    def _in_slots(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows to play at once: all, or slot by slot where silence between them has to be told."""
        if self.idle_ms is None or not self.alone:
            yield rows
        else:
            yield from (part for _, part in rows.groupby(rows[US] // self.slot_us))

    def _played(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = _sorted(rows, self.order)
        if self.timed:  # without time nothing asks for the newest row
            ms = int(rows[US].max()) // 1000
            if self.newest.exists():
                newest = self.newest.get()[0]
                if self.idle_ms is not None and int(rows[US].min()) // 1000 > newest + self.idle_ms:
                    yield from self._lapsed(key, newest + self.idle_ms)
                    self.forget()
                ms = max(ms, newest)
            self.newest.update((ms,))
        out = self.play(key, rows)
        if len(out):
            yield out[self.columns]

    def _lapsed(self, key: tuple, known_ms: int) -> Iterator[pd.DataFrame]:
        due = self.due()
        if due is not None and due <= known_ms:
            out = self.lapse(key)
            if out is not None and len(out):
                yield out[self.columns]

    def _ready(self, key: tuple, pending: dict[int, tuple[int, int]], limit_ms: float) -> Iterator[pd.DataFrame]:
        """Plays the slots that end by ``limit_ms``; a timer waits for the next."""
        after = limit_ms * 1000 // self.slot_us  # the first slot that is not over
        held: list[pd.DataFrame] = []
        rest: list[pd.DataFrame] = []
        due = [at for at in sorted(pending) if at < after]
        for at, follow in zip(due, [*due[1:], None]):
            chunks, last = pending.pop(at)
            rows = self._take(at, chunks)
            if last >= after:
                slot = rows[US] // self.slot_us
                rest.append(rows[slot >= after])
                rows = rows[slot < after]
            held.append(rows)
            if follow is None:
                now, held = held, []
            elif sum(map(len, held)) < MANY:
                continue
            else:
                # What starts before the next chunk is complete.
                every = pd.concat(held, ignore_index=True)
                done = every[US] // self.slot_us < follow
                now, held = [every[done]], [every[~done]]
            now = pd.concat(now, ignore_index=True)
            for part in self._in_slots(now) if len(now) else ():
                yield from self._played(key, part)
        for rows in rest:
            self._keep(rows, pending)
        if pending:
            self.handle.registerTimer((min(pending) + 1) * self.slot_us // 1000 + 1)

    def _silence(self, key: tuple, pending: dict[int, tuple[int, int]], now_ms: int) -> Iterator[pd.DataFrame]:
        """What the lack of rows up to the watermark means; sets timers for what is still open."""
        if not self.timed or not self.newest.exists():
            return
        # Silence is known up to the watermark or to the first slot that waits.
        known = min([now_ms, *(at * self.slot_us // 1000 - 1 for at in pending)])
        yield from self._lapsed(key, known)
        due = self.due()
        if due is not None:
            self.handle.registerTimer(max(due, now_ms + 1))
        if self.idle_ms is not None:
            end = self.newest.get()[0] + self.idle_ms
            if end <= known:
                self.newest.clear()
                self.forget()
            else:
                self.handle.registerTimer(max(end, now_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.timed else 0
        pending = self._pending() if self.waits else {}
        alone = None
        for batch in rows:
            if alone is None and not self.waits:
                alone = batch
                continue
            if alone is not None and len(alone):
                self._keep(alone, pending)
                alone = batch.iloc[:0]
            self._keep(batch, pending)
        if alone is not None and len(alone):
            yield from self._played(key, alone)
        yield from self._ready(key, pending, now if self.waits else _ALL_MS)
        yield from self._silence(key, pending, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pending = self._pending() if self.waits else {}
        yield from self._ready(key, pending, now)
        yield from self._silence(key, pending, now)


def _split_fields(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return parts + [schema[start:]]


def _sorted(rows: pd.DataFrame, order: Sequence[str]) -> pd.DataFrame:
    """Rows in order, ties as they came."""
    if all(rows[c].dtype.kind in "iuf" for c in order):
        return rows.take(np.lexsort([rows[c].to_numpy() for c in reversed(order)])).reset_index(drop=True)
    return rows.sort_values(list(order), kind="stable", ignore_index=True)


def keyed(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, processor: type[InOrder], ts: str = "ts",
    delay: str | None = None, idle_s: float | None = None, slot_s: float = 60.0, timed: bool = False, **options,
) -> DataFrame:
    """``processor`` over the stream; ``delay`` sets the watermark and makes rows wait for it (see above).

    ``timed`` processors and ``idle_s`` need a watermark: that of ``delay``, or one the stream already has.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = timed or delay is not None or idle_s is not None
    if delay is not None:
        stream = stream.withWatermark(ts, delay)
    # Null keys belong to no one, but move the watermark: the condition reads the time, so it stays above it.
    named = F.col(ts).isNotNull()
    for k in keys:
        named = F.when(named, F.col(k).isNotNull()).otherwise(False)
    rows = stream.where(named).withColumn(US, F.unix_micros(ts))
    columns = [c.strip().split()[0] for c in _split_fields(schema)]
    work = processor(columns, order, int(slot_s * 1e6), delay is not None, idle_s, timed, **options)
    return rows.groupBy(*keys).transformWithStateInPandas(work, schema, "Append", "EventTime" if timed else "None")


# --- tracker -----------------------------------------------------------------------

TRACKED_STREAM = (
    "session_id STRING, frame_index BIGINT, ts TIMESTAMP, det_idx INT, class_name STRING, confidence DOUBLE, "
    "center STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>, extent STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>, yaw_deg DOUBLE, "
    "point_count INT, in_workspace BOOLEAN, yaw_reliable BOOLEAN, track_id BIGINT, "
) + REPORT.split(", ", 1)[1]

TRACKS = "ARRAY<STRUCT<no: BIGINT, id: BIGINT, streak: INT, on: BOOLEAN, last: BIGINT, mid: ARRAY<DOUBLE>, win: ARRAY<ARRAY<DOUBLE>>>>"
TRACK_FIELDS = ("no", "id", "streak", "on", "last", "mid", "win")
_RAW = ["class_name", "confidence", "center", "extent", "yaw_deg", "point_count", "in_workspace", "yaw_reliable"]
# What a call tells, packed: a column of a call costs as much as its rows, so calls send one value and columns are made of many.
_POINT = pa.struct([(a, pa.float64()) for a in "xyz"])
_KINDS = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_(), "TIMESTAMP": pa.int64()}
_TOLD = pa.schema([(name, _KINDS.get(kind, _POINT)) for name, kind in (f.strip().split(" ", 1) for f in _split_fields(TRACKED_STREAM))])


class Tracker(InOrder):
    """One book of live tracks a class, as one value; ids count over the session."""

    def __init__(self, *args, cfg: TrackerConfig):
        super().__init__(*args)
        self.cfg = cfg

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", f"next_id BIGINT, last BIGINT, books ARRAY<STRUCT<class_name: STRING, next_no: BIGINT, tracks: {TRACKS}>>")

    def forget(self) -> None:
        self.session.clear()

    def _book(self, next_no: int, tracks: Sequence) -> TrackBook:
        tracks = [dict(zip(TRACK_FIELDS, t)) for t in tracks]
        return TrackBook(self.cfg, next_no, [{**t, "mid": list(t["mid"]), "win": [tuple(w) for w in t["win"]]} for t in tracks])

    def play(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        next_id, last, held = self.session.get() or (0, None, [])
        books = {name: self._book(next_no, tracks) for name, next_no, tracks in held}
        now = Play(self.cfg)
        for book in books.values():
            now.take(book)
        told = []
        for index, us, dets in zip(map(int, rows["frame_index"]), rows[US].tolist(), rows["detections"]):
            if last is not None and index <= last:
                continue
            last = index
            dets = [(i, d) for i, d in enumerate(dets if dets is not None else []) if d["center"] is not None]
            first, place, found = len(now.said), {}, []
            for name in dict.fromkeys(d["class_name"] for _, d in dets):
                mine = [(i, d) for i, d in dets if d["class_name"] == name]
                inside = [d["in_workspace"] is None or bool(d["in_workspace"]) for _, d in mine]
                found += books.setdefault(name, TrackBook(self.cfg)).follow(now, index, [_sample(d) for _, d in mine], inside)
                place.update((i, len(place)) for i, _ in mine)
            for i, d in dets:
                track = found[place[i]]
                if "id" not in track:
                    track["id"], next_id = next_id, next_id + 1
                told.append((first + place[i], (index, us, i, *[d[c] for c in _RAW], track["id"])))
        reports = now.reports()
        live = {name: [t for t in book.tracks if last - t["last"] <= self.cfg.max_misses] for name, book in books.items()}
        kept = [(name, books[name].next_no, [tuple(t[f] for f in TRACK_FIELDS) for t in tracks]) for name, tracks in live.items() if tracks]
        self.session.update((next_id, last, kept))
        if not told:
            return pd.DataFrame({"packed": []})
        at, seen = zip(*told)
        columns = [[key[0]] * len(told), *zip(*seen), *[[column[i] for i in at] for column in reports[1:]]]
        packed = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOLD)], schema=_TOLD).serialize()
        return pd.DataFrame({"packed": [packed.to_pybytes()]})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[pa.RecordBatch] = []
        for no, packed in enumerate(batch.column(0)):
            parts.append(pa.ipc.read_record_batch(packed.as_buffer(), _TOLD))
            if no + 1 == batch.num_rows or sum(p.num_rows for p in parts) >= MANY:
                yield from pa.Table.from_batches(parts, _TOLD).combine_chunks().to_batches()
                parts = []


def track_stream(frames: DataFrame, cfg: TrackerConfig = TrackerConfig(), idle_s: float | None = None, delay: str | None = None) -> DataFrame:
    """Tracker over frame rows (``detections`` nested, so a frame is never torn apart).

    Frames at or before the last one seen are late or repeated and are dropped.
    """
    told = keyed(frames, ["session_id"], ["frame_index", US], "packed BINARY", Tracker, delay=delay, idle_s=idle_s, cfg=cfg)
    rows = told.mapInArrow(_unpacked, TRACKED_STREAM.replace("ts TIMESTAMP", "ts BIGINT"))
    return nest_report(rows.withColumn("ts", F.timestamp_micros("ts")))


def _sample(d: dict) -> tuple:
    c, e = d["center"], d["extent"]
    numbers = (c["x"], c["y"], c["z"], e["x"], e["y"], e["z"], d["yaw_deg"], d["confidence"], bool(d["yaw_reliable"]))
    return tuple(map(float, numbers))


# --- last known values --------------------------------------------------------------


class LastKnown(InOrder):
    """The last row of values, such as a pose, as typed state."""

    def __init__(self, *args, pose: dict[str, str]):
        super().__init__(*args)
        self.pose, self.types = list(pose), pose

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("pose", ", ".join(f"{c} {t}" for c, t in self.types.items()))

    def forget(self) -> None:
        self.known.clear()

    def play(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = [tuple(self.known.get())] if self.known.exists() else []
        is_pose = rows["is_pose"].to_numpy(bool)
        at = (np.cumsum(is_pose) + len(table) - 1)[~is_pose].tolist()
        new = rows.loc[is_pose, self.pose].astype(object)
        table += new.where(new.notna(), None).itertuples(index=False, name=None)
        if table:
            self.known.update(table[-1])
        asks = rows[~is_pose].copy()
        for i, c in enumerate(self.pose):
            asks[c] = pd.Series([table[k][i] if k >= 0 else None for k in at], index=asks.index, dtype=object)
        asks["tf_ok"] = np.array(at, dtype=int) >= 0
        return asks


def asof_pose_stream(
    events: DataFrame, keys: Sequence[str], pose: Sequence[str], out: Sequence[str], ts: str = "ts", idle_s: float | None = None, delay: str | None = None,
    slot_s: float = 60.0,
) -> DataFrame:
    """Detections with the last pose seen at or before them.

    ``events`` stacks both kinds: rows with ``is_pose`` carry the pose columns, the
    others ask for it.  The last good pose stays in force.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    pose_cols = list(pose)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, ts, *out, *pose_cols]) + ", tf_ok BOOLEAN"
    # poses come first at equal times
    sided = events.withColumn("is_ask", F.when(F.col("is_pose"), 0).otherwise(1))
    return keyed(sided, keys, [US, "is_ask"], schema, LastKnown, ts, delay, idle_s, slot_s, pose={c: types[c] for c in pose_cols})


class Throttle(InOrder):
    """When the last row went through."""

    alone = False

    def __init__(self, *args, gap_us: int):
        super().__init__(*args)
        self.gap_us = gap_us

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us BIGINT")

    def forget(self) -> None:
        self.last.clear()

    def play(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        last = self.last.get()[0] if self.last.exists() else None
        keep = np.zeros(len(rows), dtype=bool)
        for i, t in enumerate(rows[US].tolist()):
            if last is None or t - last >= self.gap_us:
                last, keep[i] = t, True
        self.last.update((last,))
        return rows[keep]


def throttle_stream(
    stream: DataFrame, keys: Sequence[str], gap_s: float = 0.5, ts: str = "ts", tie: Sequence[str] = (), delay: str | None = None, idle_s: float | None = None,
    slot_s: float = 60.0,
) -> DataFrame:
    """At most one row per key and gap, measured from the last row let through; idle keys may go after a gap."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    if idle_s is not None:
        idle_s = max(idle_s, gap_s)
    return keyed(stream, keys, [US, *tie], schema, Throttle, ts, delay, idle_s, slot_s, gap_us=round(gap_s * 1e6))


class Freshness(InOrder):
    """Whether a topic is in view and since when nothing came; a timer at the end of its time to live tells that it went stale."""

    alone = False

    def __init__(self, *args, ttl_us: int, topic: str, at: str):
        super().__init__(*args)
        self.ttl_us, self.key, self.ts = ttl_us, topic, at

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.view = handle.getValueState("view", "seen BOOLEAN, us BIGINT")

    def forget(self) -> None:
        self.view.clear()

    def _table(self, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[self.key, self.ts, "in_view"])
        out[self.ts] = out[self.ts].astype("int64").to_numpy().astype("datetime64[us]")
        return out

    def play(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen, at = self.view.get() if self.view.exists() else (False, None)
        out = []
        for t, n in zip(rows[US].tolist(), rows["n_detections"].tolist()):
            if seen and t - at > self.ttl_us:
                out.append((*key, at + self.ttl_us, False))
                seen = False
            if (n > 0) != seen:
                seen = bool(n > 0)
                out.append((*key, t, seen))
            at = t
        self.view.update((seen, at))
        return self._table(out)

    def due(self) -> int | None:
        seen, at = self.view.get() if self.view.exists() else (False, None)
        return (at + self.ttl_us) // 1000 + 1 if seen else None

    def lapse(self, key: tuple) -> pd.DataFrame:
        at = self.view.get()[1]
        self.view.update((False, at))
        return self._table([(*key, at + self.ttl_us, False)])


def fresh_stream(
    messages: DataFrame, ttl_s: float = 1.0, key: str = "topic", ts: str = "ts", delay: str | None = None, tie: Sequence[str] = (), idle_s: float | None = None,
    slot_s: float = 60.0,
) -> DataFrame:
    """A row when a topic comes into view and one when it goes stale or empty.

    ``messages`` has ``n_detections`` per array, and a watermark on the time unless ``delay`` sets it.  The state of a topic goes
    ``idle_s`` after its last message, by default with its time to live.
    """
    schema = f"{key} STRING, {ts} TIMESTAMP, in_view BOOLEAN"
    idle_s = max(ttl_s if idle_s is None else idle_s, ttl_s) + 0.002
    return keyed(messages, [key], [US, *tie], schema, Freshness, ts, delay, idle_s, slot_s, timed=True, ttl_us=int(ttl_s * 1e6), topic=key, at=ts)
