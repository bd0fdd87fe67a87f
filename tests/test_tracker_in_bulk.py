"""Reports of many frames at once are those of frames one by one; a call of the stream tracker sends one row."""

import random

import pandas as pd

from rigtable.operators import tracking as tk
from rigtable.streaming import stateful as st


def frames(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for index in range(n):
        if rng.random() < 0.2:
            continue
        samples = [
            (rng.choice([0.0, 0.05, 0.1]), rng.random() * 0.05, 0.28, 0.03, 0.02, float("nan") if rng.random() < 0.05 else 0.015, rng.randrange(100) * 1.8 - 90,
             0.7 + rng.randrange(30) / 100, rng.random() < 0.5)
            for _ in range(rng.choice([1, 1, 2, 3]))
        ]
        out.append((index, samples, [rng.random() < 0.9 for _ in samples]))
    return out


def test_reports_at_once_are_those_of_single_frames():
    cfg = tk.TrackerConfig(min_hits=3, max_position_std_m=0.05, min_confidence=0.7, max_yaw_std_deg=60.0)
    one, many, play, want, got = tk.TrackBook(cfg), tk.TrackBook(cfg), tk.Play(cfg), [], []
    for n, frame in enumerate(frames(3, 500)):
        want += one.frame(*frame)
        many.follow(play, *frame)
        if n % 90 == 89:
            got += zip(*play.reports())
            play = tk.Play(cfg)
            play.take(many)
    got += zip(*play.reports())
    assert [repr(x) for x in got] == [repr(x) for x in want] and any(x[-1] for x in want)


class Value:
    value = None
    calls = 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Handle:
    def __init__(self):
        self.held = {}

    def getValueState(self, name, *schemas):
        return self.held.setdefault(name, Value())

    getMapState = getValueState


def test_call_of_the_stream_tracker_is_one_row_and_two_of_state():
    point = lambda x, y, z: {"x": x, "y": y, "z": z}
    rows = [
        (index, [
            {"class_name": "ab"[i % 2], "confidence": s[7], "center": point(*s[:3]), "extent": point(*s[3:6]), "yaw_deg": s[6], "point_count": 1, "in_workspace": ok,
             "yaw_reliable": s[8]}
            for i, (s, ok) in enumerate(zip(samples, inside))
        ], index * 1_000_000)
        for index, samples, inside in frames(4, 40)
    ]
    handle = Handle()
    tracker = st.Tracker(["packed"], ["frame_index", st.US], 60_000_000, False, None, False, cfg=tk.TrackerConfig())
    tracker.init(handle)
    out = list(tracker.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["frame_index", "detections", st.US])]), None))
    assert [len(o) for o in out] == [1]
    assert {name: v.calls for name, v in handle.held.items() if v.calls} == {"session": 2}
