"""Scan data source, label cache and stored stream scores: commit, abort, resume and replay."""

import os
import re
import struct

import pytest
from pyspark.sql import functions as F

from helpers import SF
from ringfield.operators import metrics as M
from ringfield.sources.labelcache import LabelCache
from ringfield.sources.scanstore import read_points, write_scans
from ringfield.sources.views import pts_wide
from ringfield.streaming.scores import score_stream, stored_counts


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def points(spark, n=6, labels=True):
    rows = [("04" if f % 2 else "05", f, k, k + 0.5, -float(k), f / 2, 0.25, (k << 16) + 40 if labels else None) for f in range(n) for k in range(3 + f)]
    return spark.createDataFrame(rows, "sequence string, frame_id int, point_idx int, x float, y float, z float, intensity float, word long")


def test_scans_round_trip(spark, tmp_path):
    root, p = str(tmp_path / "a"), points(spark)
    write_scans(p.repartition(5), root)
    assert files(root) == sorted(f"sequences/{s}/{k}" for f in range(6) for s in ["04" if f % 2 else "05"] for k in (f"velodyne/{f:06d}.bin", f"labels/{f:06d}.label"))
    with open(f"{root}/sequences/05/velodyne/000000.bin", "rb") as f:
        assert f.read() == b"".join(struct.pack("<4f", k + 0.5, -float(k), 0, 0.25) for k in range(3))
    back = read_points(spark, root)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))
    # The root may also be the folder of the sequences or one sequence; limits and sequences choose files.
    assert read_points(spark, f"{root}/sequences").count() == p.count() and read_points(spark, f"{root}/sequences/04").select("sequence").distinct().first()[0] == "04"
    assert sorted(r[0] for r in read_points(spark, root, limit="2").select("frame_id").distinct().collect()) == [0, 1, 2, 3]
    assert read_points(spark, root, sequence="05").where("frame_id > 2").select("frame_id").distinct().collect() == [(4,)]
    with pytest.raises(Exception, match="no sequence"):
        read_points(spark, str(tmp_path / "none")).count()


def test_pushed_comparisons_choose_files(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    from ringfield.sources.scanstore import PushedScanReader

    write_scans(points(spark), str(tmp_path))
    reader = PushedScanReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([GreaterThan(("frame_id",), 1), EqualTo(("sequence",), "04"), IsNull(("x",)), GreaterThan(("x",), 0.0)]))
    assert [type(f).__name__ for f in rest] == ["IsNull", "GreaterThan"]
    assert [f[:2] for part in reader.partitions() for f in part.frames] == [("04", 3), ("04", 5)]
    monkeypatch.setattr("ringfield.sources.scanstore.PARTITION_BYTES", 100)
    assert [len(part.frames) for part in reader.partitions()] == [1, 1]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read_points(spark, str(tmp_path)).where("frame_id > 1 AND sequence = '04' AND x > 1")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"frame_id#\d+ >|sequence#\d+ =", plan) and got.count() == 5 + 7
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_writes_append_overwrite_and_leave_nothing_on_failure(spark, tmp_path):
    root, p = str(tmp_path / "a"), points(spark)
    write_scans(p, root)
    before = files(root)
    with pytest.raises(Exception, match="lost"):
        write_scans(p.withColumn("frame_id", F.col("frame_id") + 100).withColumn("x", F.when(F.col("frame_id") == 105, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.col("x"))), root)
    assert files(root) == before
    half = p.withColumn("word", F.when(F.col("point_idx") > 0, F.col("word")))
    with pytest.raises(Exception, match="no label"):
        write_scans(half, root)
    assert files(root) == before
    write_scans(p.where("frame_id = 0").withColumn("frame_id", F.lit(9)).drop("word"), root)
    assert files(root) == sorted([*before, "sequences/05/velodyne/000009.bin"])
    assert read_points(spark, root).where("frame_id = 9 AND word IS NULL").count() == 3
    write_scans(p.where("frame_id = 1"), root, "overwrite")
    assert files(root) == ["sequences/04/labels/000001.label", "sequences/04/velodyne/000001.bin"]
    write_scans(p.limit(0), str(tmp_path / "empty"))
    assert files(tmp_path / "empty") == [] if os.path.isdir(tmp_path / "empty") else True


def test_labels_must_fit_their_scan(spark, tmp_path):
    write_scans(points(spark), str(tmp_path))
    with open(tmp_path / "sequences/04/labels/000003.label", "ab") as f:
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="7 labels for 6 points"):
        read_points(spark, str(tmp_path)).count()
    assert read_points(spark, str(tmp_path), sequence="05").count() > 0


def frames_of(spark, n=10):
    return spark.range(n).select(F.format_string("04/%06d", "id").alias("key"), (F.col("id") + 1).alias("n_points"), F.format_string("/d/%06d.bin", "id").alias("file"))


def constant(frames):
    return frames.select("key", F.unhex(F.repeat(F.lit("03"), F.col("n_points").cast("int"))).alias("labels"))


def test_a_killed_build_resumes(spark, tmp_path):
    cache, asked = LabelCache(spark, str(tmp_path)), []

    def dies(frames):
        asked.append(sorted(r.key[3:] for r in frames.collect()))
        if len(asked) == 3:
            raise RuntimeError("killed")
        return constant(frames)

    with pytest.raises(RuntimeError):
        cache.build(frames_of(spark), dies, "geometric", per_part=3)
    assert cache.index().count() == 6 and cache.parts() == [0, 1]
    assert cache.build(frames_of(spark), constant, "geometric", per_part=3) == 4
    assert cache.build(frames_of(spark), constant, "geometric") == 0
    rows = [(r.position, r.key, r.offset, r.n_points) for r in cache.index().orderBy("position").collect()]
    assert rows == [(k, f"04/{k:06d}", k * (k + 1) // 2, k + 1) for k in range(10)]
    assert [(r.position, bytes(r.labels)) for r in cache.at(2, 4).orderBy("position").collect()] == [(k, b"\3" * (k + 1)) for k in (2, 3, 4)]
    assert [bytes(r.labels) for r in cache.of(frames_of(spark).where("n_points = 8")).collect()] == [b"\3" * 8]
    with pytest.raises(KeyError, match="04/000010"):
        cache.of(frames_of(spark, 11))
    with pytest.raises(IndexError):
        cache.at(5, 10)
    with pytest.raises(ValueError, match="mode 'geometric'"):
        cache.build(frames_of(spark, 12), constant, "network")


def test_labels_of_a_wrong_size_are_not_committed(spark, tmp_path):
    cache = LabelCache(spark, str(tmp_path))
    with pytest.raises(ValueError, match="04/000001: 3 labels for 2 points"):
        cache.build(frames_of(spark, 3), lambda f: constant(f.withColumn("n_points", F.when(F.col("n_points") == 2, 3).otherwise(F.col("n_points")))), "m")
    with pytest.raises(ValueError, match="None labels"):
        cache.build(frames_of(spark, 3), lambda f: constant(f.where("n_points < 3")), "m")
    with pytest.raises(ValueError, match="twice"):
        cache.build(frames_of(spark, 3).union(frames_of(spark, 1)), constant, "m")
    assert cache.parts() == [] and cache.index().count() == 0
    assert cache.build(frames_of(spark, 3), constant, "m") == 3
    assert cache.of(frames_of(spark, 0)).count() == 0
    spark.createDataFrame([("04/000000", bytearray(b"\1\1"))], "key string, labels binary").write.mode("overwrite").parquet(f"{tmp_path}/parts/0")
    with pytest.raises(Exception, match="truncated or stale"):
        cache.at(0, 0).collect()


def test_stream_scores_equal_the_batch_and_survive_a_replay(spark, tmp_path):
    p = pts_wide(spark, SF).select("frame_id", "cls", "pred" if "pred" in pts_wide(spark, SF).columns else F.col("raw").alias("pred"), "l_suppkey").withColumn("pred", (F.col("l_suppkey") % 5).cast("int"))
    p = p.select((F.col("l_suppkey") % 3).cast("int").alias("part"), "cls", "pred")
    for k in range(3):
        p.where(F.col("part") == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = score_stream(stream, f"{tmp_path}/scores", ["part"]).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    want = sorted(map(tuple, M.confusion(p, ["part"]).collect()))
    assert sorted(map(tuple, stored_counts(spark, f"{tmp_path}/scores").select("part", "truth", "pred", "n").collect())) == want
    # The last batch runs again: its commit is lost, its counts are there already.
    commits = sorted(f for f in os.listdir(f"{tmp_path}/scores/checkpoint/commits") if f.isdigit())
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{tmp_path}/scores/checkpoint/commits/{f}"):
            os.remove(f"{tmp_path}/scores/checkpoint/commits/{f}")
    run()
    assert sorted(map(tuple, stored_counts(spark, f"{tmp_path}/scores").select("part", "truth", "pred", "n").collect())) == want
    got = sorted(map(tuple, M.miou(stored_counts(spark, f"{tmp_path}/scores"), ["part"]).collect()))
    assert got == sorted(map(tuple, M.miou(M.confusion(p, ["part"]), ["part"]).collect()))
    assert len(os.listdir(f"{tmp_path}/scores/totals")) == 2
