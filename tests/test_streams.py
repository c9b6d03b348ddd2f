"""Streams: the frame log as a source, tracks with state that Spark keeps."""

import time

import numpy as np
import pandas as pd
import pytest

from ringfield.operators.iterative import track
from ringfield.sources import replay as L
from ringfield.sources.logstream import LogReader, log_stream
from ringfield.streaming.tracking import track_keyed, track_state


def written(spark, root, n=25):
    L.write_log(spark.createDataFrame([(k, bytes([k]) * k) for k in range(n)], "frame_id int, message binary").repartition(5), root)
    return root


def drained(stream, tmp_path, name, **trigger):
    """Rows of a stream that ends by itself, kept as files, with a checkpoint."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(**(trigger or {"availableNow": True})).start(str(tmp_path / name))
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_a_second_log_replaces_the_first(spark, tmp_path):
    root = written(spark, str(tmp_path / "log"), 40)
    written(spark, root, 3)
    assert [bytes(r.message) for r in L.read_log(spark, root).orderBy("part", "pos").collect()] == [b"", b"\1", b"\2\2"]
    with pytest.raises(FileNotFoundError):
        L.read_log(spark, str(tmp_path / "none"))
    assert L.write_log(spark.createDataFrame([], "frame_id int, message binary"), root) == 0 and L.read_log(spark, root).count() == 0


def test_log_stream_goes_on_at_the_next_message(spark, tmp_path):
    root = written(spark, str(tmp_path / "log"))
    seen = []
    for k in range(1, 5):
        rows = drained(log_stream(spark, root, perBatch=8), tmp_path, "out").orderBy("index").collect()
        seen.append(len(rows))
        assert [(r["index"], bytes(r.message)) for r in rows] == [(i, bytes([i]) * i) for i in range(min(25, 8 * k))]
    assert seen == [8, 16, 24, 25]
    assert drained(log_stream(spark, root), tmp_path, "whole").count() == 25


def test_log_stream_loops_and_repeats_nothing_after_a_restart(spark, tmp_path):
    root = written(spark, str(tmp_path / "log"))
    for k in (1, 2):
        rows = drained(log_stream(spark, root, perBatch=40, loop="true"), tmp_path, "loop").orderBy("index").collect()
        assert [(r["index"], bytes(r.message)) for r in rows] == [(i, bytes([i % 25]) * (i % 25)) for i in range(40 * k)]
    with pytest.raises(ValueError, match="without end"):
        LogReader({"path": root, "loop": "true"})


def test_latest_frame_only(spark, tmp_path, monkeypatch):
    reader = LogReader({"path": written(spark, str(tmp_path / "log")), "rate": "10", "latest": "true", "loop": "true"})
    now = [100.0]
    monkeypatch.setattr(time, "monotonic", lambda: now[0])
    assert reader.latestOffset() == {"index": 0}
    now[0] += 3.05
    assert reader.latestOffset() == {"index": 30}
    (part,) = reader.partitions({"index": 0}, {"index": 30})
    got = [b.to_pylist() for b in reader.read(part)]
    assert len(got) == 1 and [(m["index"], m["message"]) for m in got[0]] == [(29, b"\4" * 4)]
    assert reader.partitions({"index": 30}, {"index": 30}) == []


KEY = ["sequence", "frame_id", "track_id", "x", "y", "vx", "vy", "age", "n_cells"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def moving(spark, frames=14):
    """Clusters of two sequences: some move, one vanishes and another comes back after a gap of frames."""
    rng, rows = np.random.default_rng(3), []
    for f in range(frames):
        for s, k in (("a", 3), ("b", 2)):
            if s == "b" and 5 <= f < 10:
                continue
            for c in range(k):
                if not (c == 2 and f > 6):
                    rows.append((s, f, 10.0 * c + 0.5 * f + rng.normal(0, 0.05), 4.0 * c - 0.3 * f, 9 + c))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["sequence", "frame_id", "cx", "cy", "n_cells"]))


def in_pieces(spark, rows, folder, edges):
    """A stream with a file a micro-batch; row r goes to the piece in which ``2 * frame + r % 2`` falls, so frames are cut in two."""
    spot = rows.collect()
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        some = [r for i, r in enumerate(spot) if lo <= 2 * r.frame_id + i % 2 < hi]
        if some:
            spark.createDataFrame(some, rows.schema).coalesce(1).write.parquet(f"{folder}/{k:02d}")
            time.sleep(0.02)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def settled(stream, tmp_path, name, want):
    """Rows of a stream in processing time once as many have come as are wanted and it has been silent."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.monotonic() + 60
        while stream.sparkSession.table(name).count() < want and time.monotonic() < until and q.isActive:
            time.sleep(0.5)
        time.sleep(2)  # anything more would come now
        assert q.exception() is None
    finally:
        q.stop()
    return sorted(map(tuple, stream.sparkSession.table(name).select(*KEY).collect()))


def test_tracks_of_frames_in_pieces_equal_the_batch(rocks, tmp_path):
    rows = moving(rocks)
    want = sorted(map(tuple, track(rows).select(*KEY).collect()))
    got = settled(track_keyed(in_pieces(rocks, rows, tmp_path / "in", [0, 9, 10, 17, 28]), idle_ms=4000), tmp_path, "pieces", len(want))
    assert got == want and len(want) > 30


def test_tracks_go_on_from_a_batch_run(rocks, tmp_path):
    rows = moving(rocks)
    told = set(map(tuple, track(rows.where("frame_id < 8")).select(*KEY).collect()))
    want = sorted(set(map(tuple, track(rows).select(*KEY).collect())) - told)
    first = track_state(rows.where("frame_id < 8"))
    got = settled(track_keyed(in_pieces(rocks, rows.where("frame_id >= 8"), tmp_path / "in", [16, 21, 28]), idle_ms=4000, first=first), tmp_path, "onward", len(want))
    # The batch run of sequence b ends at frame 4; its tracks die in the gap up to frame 9, which the stream tells.
    assert got == want and {t[1] for t in want if t[0] == "b"} >= {5, 6}
