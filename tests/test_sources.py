import json

import numpy as np
import pytest

from ringfield.operators import raycast as R
from ringfield.operators import store as S
from ringfield.operators.iterative import track, warm_speed
from ringfield.sources import files as W
from ringfield.sources import registry as G
from ringfield.sources import replay as L
from ringfield.sources import results as T


def test_scan_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    for seq, frame in (("00", 0), ("00", 3), ("01", 0)):
        for kind in ("velodyne", "labels"):
            (tmp_path / seq / kind).mkdir(parents=True, exist_ok=True)
        v = rng.normal(size=(5 + frame, 4)).astype("<f4")
        (tmp_path / seq / "velodyne" / f"{frame:06d}.bin").write_bytes(v.tobytes())
        (tmp_path / seq / "labels" / f"{frame:06d}.label").write_bytes((np.arange(len(v), dtype="<u4") | (7 << 16) | (1 << 31)).astype("<u4").tobytes())
    (tmp_path / "00" / "velodyne" / "notes.txt").write_text("x")
    scans = W.read_scans(spark, str(tmp_path))
    assert scans.count() == 18 and scans.select("sequence", "frame_id").distinct().count() == 3
    assert min(r.word for r in W.read_labels(spark, str(tmp_path)).collect()) >= 1 << 31
    packed = {(r["sequence"], r.frame_id): bytes(r.content) for r in W.pack_scans(scans).collect()}
    assert packed["00", 3] == (tmp_path / "00" / "velodyne" / "000003.bin").read_bytes()
    (tmp_path / "01" / "velodyne" / "000001.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        W.read_scans(spark, str(tmp_path)).collect()


def test_scene_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# a scene\n# frames: 40\ntype,x,y,z,sx,sy,sz,class\nplane,0,0,0,200,200,0,1\nbox,25,-16,1.6,7,2.5,3.2,4,0,8,track,\n")
    rows, frames = W.read_scene(spark, str(tmp_path / "s.csv"))
    got = rows.orderBy("k").collect()
    assert frames == 40 and [r.kind for r in got] == ["plane", "box"] and got[1].vy == 8.0 and got[1].hazard == "track" and got[0].hazard == ""


def test_wire_frames_reject_cut_input():
    cells = {n: np.arange(3) for n, _ in W.CELL_FIELDS}
    data = W.encode_frame({"frame_id": 1}, cells)
    header, back = W.decode_frame(data)
    assert header["n_cells"] == 3 and all((back[n] == cells[n]).all() for n in cells)
    for cut in (b"", data[:3], data[:20], data[:-1]):
        with pytest.raises(ValueError):
            W.decode_frame(cut)


def test_cache_of_another_mode_is_refused(spark):
    want = spark.createDataFrame([("00", 1), ("00", 2)], "sequence string, frame_id int")
    have = spark.createDataFrame([("00", 1, "network")], "sequence string, frame_id int, mode string")
    assert [r.frame_id for r in S.still_missing(want, have, "network").collect()] == [2]
    with pytest.raises(ValueError):
        S.still_missing(want, have, "geometric")


def test_scan_and_label_files_round_trip(spark, tmp_path):
    rows = [("00", f, k, f + k * 0.5, 1.0, -k * 0.25, 0.5, (k << 16) | 40 | (1 << 31 if k % 2 else 0)) for f in (0, 7) for k in range(20)]
    points = spark.createDataFrame(rows, "sequence string, frame_id int, point_idx int, x float, y float, z float, intensity float, word long")
    assert L.write_files(W.pack_scans(points), str(tmp_path), "velodyne", "bin") == 2 and L.write_files(L.pack_labels(points), str(tmp_path), "labels", "label") == 2
    back = W.read_scans(spark, str(tmp_path)).join(W.read_labels(spark, str(tmp_path)), ["sequence", "frame_id", "point_idx"])
    assert sorted(tuple(r) for r in back.select(points.columns).collect()) == sorted(rows)
    assert L.write_files(W.pack_scans(points.limit(0)), str(tmp_path), "velodyne", "bin") == 0


def test_frame_log_and_replay(spark, tmp_path):
    want = [(k, bytes([k]) * k) for k in range(25)]
    root = str(tmp_path / "log")
    assert L.write_log(spark.createDataFrame(want, "frame_id int, message binary").repartition(5), root) == 25
    log = L.read_log(spark, root)
    assert [bytes(r.message) for r in log.orderBy("part", "pos").collect()] == [m for _, m in want]
    ticks = L.at_ticks(spark.range(60).withColumnRenamed("id", "value"), log)
    assert all(bytes(r.message) == want[r.value % 25][1] for r in ticks.collect()) and ticks.count() == 60
    last = sorted((tmp_path / "log").glob("*.log"))[-1]
    last.write_bytes(last.read_bytes()[:-1])
    assert L.read_log(spark, root).count() == 24
    assert L.replay(spark, root).isStreaming


def test_results_show_what_is_missing(spark, tmp_path):
    table = spark.createDataFrame([("b", 1.23456, 1234, True), ("a|c", None, None, None)], "name string, score double, n long, ok boolean")
    got = T.collected({"scores": table, "none": None, "empty": table.limit(0)})
    text = T.as_markdown(got, {"scores": "Scores", "none": "None", "gone": "Gone", "empty": "Empty"})
    assert "| a\\|c | — | — | — |" in text and "| b | 1.235 | 1,234 | yes |" in text and text.count(T.NOT_MEASURED) == 3
    assert list(json.loads(T.as_json(got))) == ["empty", "none", "scores"]
    T.save_text(spark, T.as_json(got), str(tmp_path / "r"))
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())) == json.loads(T.as_json(got))


def test_scene_registry(spark, tmp_path):
    head = "# x\n# frames: 3\ntype,x,y,z,sx,sy,sz,class,vx,vy,hazard,note\nplane,0,0,0,9,9,0,1\n"
    (tmp_path / "a.csv").write_text(head + "pit,3,4,-0.1,1,1,0.22,2,0,0,pothole,deep\nbox,1,0,1,1,1,1,4,2,0,track,\n")
    (tmp_path / "b.csv").write_text("type,x\nplane,0,0,0,9,9,0,1\n")
    docs = G.documents(G.read_scenes(spark, str(tmp_path)))
    got = {r.name: json.loads(r.document) for r in docs.collect()}
    assert got["a"]["groundTruth"] == {"potholeDepth": 0.22, "clearance": None, "curbHeight": None, "truckSpeed": 2.0} and got["a"]["nFrames"] == 3 and not got["a"]["expectNoHazards"]
    assert got["b"]["expectNoHazards"] and got["b"]["nFrames"] == 1 and len(got["a"]["source"]["sha256"]) == 64 and got["a"]["primitives"][1]["note"] == "deep"
    back = {r.tag: r for r in G.hazards_of(docs).collect()}
    assert back["pothole"].instance == 1 and back["pothole"].range_m == 5.0 and back["track"].x == [1.0, 1.2, 1.4]
    (tmp_path / "c.csv").write_text(head + "pit,3,4,-0.1,1,1,0.22,2,0,0,pothole,\n" * 2)
    with pytest.raises(Exception, match="two hazards"):
        G.documents(G.read_scenes(spark, str(tmp_path))).collect()


def test_noise_and_track_speed(spark):
    hits = spark.range(4000).selectExpr("cast(id as int) AS beam", "0 AS azimuth", "20.0D AS t", "1 AS prim", "4 AS cls", "20.0D AS x", "0.0D AS y", "1.7D AS z")
    scene = spark.createDataFrame([(1, 3, 0.0, 8.0)], "prim int, instance int, vx double, vy double")
    rows = R.measured(hits, scene, 5, 0.02, 0.25, 0.01).collect()
    t = np.array([r.t for r in rows])
    assert 2850 < len(rows) < 3150 and abs(t.mean() - 20) < 0.002 and 0.018 < t.std() < 0.022 and {r.word for r in rows} == {3 << 16 | 258}
    assert rows[0].x == pytest.approx(rows[0].t) and rows[0].z == pytest.approx(1.7) and abs(np.mean([r.intensity for r in rows]) - 0.44) < 0.002
    assert sorted(rows) == sorted(R.measured(hits.repartition(7), scene, 5, 0.02, 0.25, 0.01).collect())
    path = spark.range(40).selectExpr("'s' AS sequence", "id AS frame_id", "25.0D AS cx", "-16 + 0.8D * id AS cy", "9L AS n_cells")
    got = warm_speed(track(path)).first()
    assert abs(got.speed - 8) < 0.3 and got.n_ids == 1
