"""Scan folders as a data source of Spark: planned by files, checked against their labels, written with commit and abort."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

POINT_DDL = "sequence string, frame_id int, point_idx int, x float, y float, z float, intensity float, word long"
#: Bytes of scans in one partition.
PARTITION_BYTES = 64 << 20
_FRAME = re.compile(r"^(\d{6})\.bin$")


def store(root: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or address (local or mounted, hdfs, s3, gs) and the path in it."""
    root = re.sub(r"^file:/+", "/", root)
    return pfs.FileSystem.from_uri(root) if "://" in root else (pfs.LocalFileSystem(), root)


def listed(fs: pfs.FileSystem, path: str) -> list[pfs.FileInfo]:
    return sorted(fs.get_file_info(pfs.FileSelector(path, allow_not_found=True)), key=lambda f: f.base_name)


@dataclass
class Frames(InputPartition):
    """Some frames: (sequence, frame, path of the scan, path of its labels or None)."""

    frames: list[tuple[str, int, str, str | None]]


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]]


class ScanReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.limit, self.only = options["path"], options.get("limit"), options.get("sequence")
        self.tests: list = []

    def _sequences(self, fs: pfs.FileSystem, root: str) -> list[tuple[str, str]]:
        """Folders with ``velodyne``: the root itself, those below ``root/sequences``, or those below the root."""
        has = lambda p: fs.get_file_info(f"{p}/velodyne").type == pfs.FileType.Directory
        if has(root):
            return [(root.rstrip("/").rsplit("/", 1)[-1], root)]
        for top in (f"{root}/sequences", root):
            found = [(d.base_name, d.path) for d in listed(fs, top) if d.type == pfs.FileType.Directory and has(d.path)]
            if found:
                return found
        raise FileNotFoundError(f"{root} has no sequence with a folder velodyne")

    def partitions(self) -> list[Frames]:
        fs, root = store(self.root)
        parts, held, size = [], [], 0
        for name, folder in self._sequences(fs, root):
            scans = [f for f in listed(fs, f"{folder}/velodyne") if _FRAME.match(f.base_name)]
            labels = {f.base_name: f.path for f in listed(fs, f"{folder}/labels")}
            for f in scans[: None if self.limit is None else max(0, int(self.limit))]:
                row = {"sequence": name, "frame_id": int(f.base_name[:6])}
                if (self.only is None or name == self.only) and all(test(row[c], v) for c, test, v in self.tests):
                    if held and size + f.size > PARTITION_BYTES:
                        parts.append(Frames(held))
                        held, size = [], 0
                    held.append((name, row["frame_id"], f.path, labels.get(f"{f.base_name[:6]}.label")))
                    size += f.size
        return [*parts, Frames(held)] if held or not parts else parts

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.root)
        for name, frame, scan, label in partition.frames:
            raw = fs.open_input_file(scan).read()
            if len(raw) % 16:
                raise ValueError(f"{scan}: {len(raw)} bytes are no whole number of points")
            v = np.frombuffer(raw, "<f4").reshape(-1, 4)
            words = pa.nulls(len(v), pa.int64())
            if label is not None:
                got = np.frombuffer(fs.open_input_file(label).read(), "<u4")
                if len(got) != len(v):
                    raise ValueError(f"{label}: {len(got)} labels for {len(v)} points")
                words = pa.array(got.astype(np.int64))
            cols = [pa.array([name] * len(v), pa.string()), pa.array(np.full(len(v), frame, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), *[pa.array(v[:, k]) for k in range(4)], words]
            yield pa.RecordBatch.from_arrays(cols, ["sequence", "frame_id", "point_idx", "x", "y", "z", "intensity", "word"])


class PushedScanReader(ScanReader):
    """Where the session pushes filters to Python sources (Spark refuses a reader that takes filters anywhere else)."""

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of the sequence or frame with a constant choose files; Spark need not test them again."""
        way = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in way and f.attribute in (("sequence",), ("frame_id",)) and f.value is not None:
                self.tests.append((f.attribute[0], way[type(f)], f.value))
            else:
                yield f


class ScanWriter(DataSourceArrowWriter):
    """Tasks write their frames to a staging folder; the commit renames them, an abort removes the folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.stage = options["path"], overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = store(self.root)
        folder = f"{root}/{self.stage}/{TaskContext.get().taskAttemptId()}"
        staged, seen, now, held = [], set(), None, []

        def close() -> None:
            if now is None:
                return
            if now in seen:
                raise ValueError(f"the points of {now[0]}/{now[1]:06d} do not come together")
            seen.add(now)
            table = pa.Table.from_batches(held)
            words = table.column("word")
            if 0 < words.null_count < len(words):
                raise ValueError(f"{now[0]}/{now[1]:06d}: {words.null_count} of {len(words)} points have no label")
            files = [("velodyne", "bin", np.stack([table.column(c).to_numpy() for c in ("x", "y", "z", "intensity")], axis=1).astype("<f4"))]
            if not words.null_count:
                files.append(("labels", "label", words.to_numpy().astype("<u4")))
            fs.create_dir(folder, recursive=True)
            for kind, suffix, data in files:
                path = f"{folder}/{len(staged)}"
                with fs.open_output_stream(path) as out:
                    out.write(data.tobytes())
                staged.append((path, f"{root}/sequences/{now[0]}/{kind}/{now[1]:06d}.{suffix}"))

        for b in iterator:
            key = list(zip(b.column("sequence").to_pylist(), b.column("frame_id").to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)] if key else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if key[lo] != now:
                    close()
                    now, held = key[lo], []
                held.append(b.slice(lo, hi - lo))
        close()
        return Written(staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = store(self.root)
        moves = [move for m in messages if m is not None for move in m.staged]
        if len({to for _, to in moves}) != len(moves):
            self.abort(messages)
            raise ValueError("two tasks wrote one frame")
        if self.overwrite:
            for d in listed(fs, f"{root}/sequences"):
                fs.delete_dir(d.path)
        for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
            fs.create_dir(folder, recursive=True)
        for path, to in moves:
            fs.move(path, to)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = store(self.root)
        if fs.get_file_info(f"{root}/{self.stage}").type == pfs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.stage}")


class ScanSource(DataSource):
    """``spark.read.format("scans")`` and ``.write.format("scans")`` for folders of binary scans with labels.

    Options: ``path``; ``sequence`` (one only) and ``limit`` (the first frames of each) choose files before anything is read; with ``pushed`` = true
    so do comparisons of ``sequence`` and ``frame_id`` (``read_points`` sets it where ``spark.sql.python.filterPushdown.enabled`` is true). A partition has about 64 MB of scans. ``word`` is the packed label, null
    where a frame has no label file; a label file whose count is not the scan's is an error. Written points need the columns of the schema, a frame's
    together and in order in one task (``write_scans`` sees to that). Appending replaces frames of the same name, overwriting
    removes all others. Files are staged and appear only when all tasks have ended well.
    """

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return POINT_DDL

    def reader(self, schema) -> ScanReader:
        return (PushedScanReader if self.options.get("pushed") == "true" else ScanReader)(self.options)

    def writer(self, schema, overwrite: bool) -> ScanWriter:
        return ScanWriter(self.options, overwrite)


def read_points(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Points of the scans below the root with their labels."""
    spark.dataSource.register(ScanSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("scans").options(path=root, pushed=pushed, **options).load()


def write_scans(points: DataFrame, root: str, mode: str = "append") -> None:
    """Write the points (columns of the schema; ``word`` may be missing) as scan and label files, whole or not at all."""
    from pyspark.sql import functions as F

    points.sparkSession.dataSource.register(ScanSource)
    full = points if "word" in points.columns else points.withColumn("word", F.lit(None).cast("long"))
    kinds = [c.split() for c in POINT_DDL.split(", ")]
    rows = full.select(*[F.col(c).cast(t).alias(c) for c, t in kinds]).repartition("sequence", "frame_id").sortWithinPartitions("sequence", "frame_id", "point_idx")
    rows.write.format("scans").option("path", root).mode(mode).save()
