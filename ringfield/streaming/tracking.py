"""The tracker as a stateful stream: one state for each sequence, or one for each track with frames that may come in pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..config import DEFAULT, Config
from ..operators.iterative import TRACK_DDL, Tracker

COLUMNS = ["sequence", "frame_id", "track_id", "x", "y", "vx", "vy", "age", "n_cells", "predicted"]


def track_stream(clusters: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks from a stream of clusters (sequence, frame_id, cx, cy, n_cells); the state is the tracker's, a few hundred bytes a track.

    A frame's clusters must arrive in one micro-batch; frames between batches may be missing and count as empty.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"tracker": None, "last": None}
        tracker, last, out = Tracker(cfg, saved["tracker"]), saved["last"], []
        rows = pd.concat(parts)
        by = dict(tuple(rows.groupby("frame_id")))
        for frame in range(int(rows["frame_id"].min()) if last is None else last + 1, int(rows["frame_id"].max()) + 1):
            got = by.get(frame)
            found = [] if got is None else list(zip(got["cx"].tolist(), got["cy"].tolist(), got["n_cells"].tolist(), strict=True))
            out += [{"sequence": key[0], "frame_id": frame, **t} for t in tracker.step(found, cfg.frame_dt)]
            last = frame
        state.update((json.dumps({"tracker": tracker.state(), "last": last}),))
        yield pd.DataFrame(out, columns=COLUMNS)

    return clusters.select("sequence", "frame_id", "cx", "cy", "n_cells").groupBy("sequence").applyInPandasWithState(run, TRACK_DDL, "state string", "append", GroupStateTimeout.NoTimeout)


ONE_TRACK = "x array<double>, p array<double>, age long, hits long, misses long, born boolean, n_cells long"
ONE_STATE = "sequence string, next_id long, last long, tracks array<struct<id: long, x: array<double>, p: array<double>, age: long, hits: long, misses: long, born: boolean, n_cells: long>>"
_VALUES = ("x", "p", "age", "hits", "misses", "born", "n_cells")


def track_state(clusters: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The tracker's state after the last frame of each sequence of a table of clusters: where ``track_keyed`` may begin."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tracker = Tracker(cfg)
        by = dict(tuple(g.groupby("frame_id")))
        for frame in range(int(g["frame_id"].min()), int(g["frame_id"].max()) + 1):
            rows = by.get(frame)
            tracker.step([] if rows is None else list(zip(rows["cx"].tolist(), rows["cy"].tolist(), rows["n_cells"].tolist(), strict=True)), cfg.frame_dt)
        tracks = [{"id": t["id"], **{k: t[k] for k in _VALUES}} for t in tracker.tracks]
        return pd.DataFrame([{"sequence": g["sequence"].iloc[0], "next_id": tracker.next_id, "last": int(g["frame_id"].max()), "tracks": tracks}])

    return clusters.select("sequence", "frame_id", "cx", "cy", "n_cells").groupBy("sequence").applyInPandas(run, ONE_STATE)


class TrackProcessor(StatefulProcessor):
    """State of a sequence: its tracks by id, clusters of frames that may still grow, the last frame that was stepped."""

    def __init__(self, cfg: Config, idle_ms: int, lag: int):
        self.cfg, self.idle_ms, self.lag = cfg, idle_ms, lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next_id long, last long")
        self.tracks = handle.getMapState("tracks", "id long", ONE_TRACK)
        self.waiting = handle.getMapState("waiting", "frame_id long", "cx array<double>, cy array<double>, n_cells array<long>")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: TimerValues) -> None:
        self.head.update((initialState["next_id"], initialState["last"]))
        for t in initialState["tracks"]:
            self.tracks.updateValue((t["id"],), tuple(t[k] for k in _VALUES))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.head.get()[1] if self.head.exists() else None
        new: dict[int, list] = {}
        for r in rows:
            if last is None or r["frame_id"] > last:
                new.setdefault(r["frame_id"], []).append((r["cx"], r["cy"], r["n_cells"]))
        for frame, found in new.items():
            old = self.waiting.getValue((frame,)) if self.waiting.containsKey((frame,)) else ([], [], [])
            self.waiting.updateValue((frame,), tuple([*a, *b] for a, b in zip(old, zip(*found, strict=True), strict=True)))
        frames = sorted(k[0] for k in self.waiting.keys())
        yield from self._step(key, [f for f in frames if f < frames[-1] - self.lag] if frames else [])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._step(key, sorted(k[0] for k in self.waiting.keys()))

    def _step(self, key: Any, frames: list[int]) -> Iterator[Row]:
        if not frames:
            return
        next_id, last = self.head.get() if self.head.exists() else (1, None)
        before = sorted(((k[0], v) for k, v in self.tracks.iterator()), key=lambda t: t[0])
        tracker = Tracker(self.cfg, {"next_id": next_id, "tracks": [{"id": i, "seen": False, **{k: list(c) if k in ("x", "p") else c for k, c in zip(_VALUES, v, strict=True)}} for i, v in before]})
        for frame in frames:
            # Frames without clusters let tracks die; where none is left there is nothing to step.
            at = frame if last is None else last + 1
            while at < frame and tracker.tracks:
                yield from self._told(key, at, tracker.step([], self.cfg.frame_dt))
                at += 1
            found = list(zip(*self.waiting.getValue((frame,)), strict=True))
            yield from self._told(key, frame, tracker.step(found, self.cfg.frame_dt))
            self.waiting.removeKey((frame,))
            last = frame
        for i in {i for i, _ in before} - {t["id"] for t in tracker.tracks}:
            self.tracks.removeKey((i,))
        for t in tracker.tracks:
            self.tracks.updateValue((t["id"],), tuple(t[k] for k in _VALUES))
        self.head.update((tracker.next_id, last))

    def _told(self, key: Any, frame: int, tracks: list[dict]) -> Iterator[Row]:
        for t in tracks:
            row = {"sequence": key[0], "frame_id": frame, **t}
            yield Row(**{c: row[c] for c in COLUMNS})

    def close(self) -> None:
        pass


def track_keyed(clusters: DataFrame, cfg: Config = DEFAULT, idle_ms: int = 2000, lag: int = 0, first: DataFrame | None = None) -> DataFrame:
    """Tracks from a stream of clusters whose frames may come in pieces: the same rows as ``track`` gives for the whole table.

    A frame is stepped when a frame more than ``lag`` later has come, or when its sequence was silent for ``idle_ms``; clusters of
    a frame stepped before are late and left out. ``first`` (from ``track_state``) lets the stream go on from a batch run. State is kept track by track in RocksDB, which
    the session must name as its state store; what is held grows with the tracks and the ``lag`` frames, not with the stream. Rows with a null in any of the columns are left out.
    """
    rows = clusters.select("sequence", F.col("frame_id").cast("long").alias("frame_id"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), F.col("n_cells").cast("long").alias("n_cells")).dropna()
    state = None if first is None else first.groupBy("sequence")
    return rows.groupBy("sequence").transformWithState(TrackProcessor(cfg, idle_ms, lag), TRACK_DDL, "Append", "ProcessingTime", state)
