"""Sinks of frames: scan and label files, and the frame log with its replay.

Scan and label files go to folders that every executor mounts, under another name first, so a task that runs twice leaves
one whole file. The frame log goes to any store that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scanstore import listed, store

#: Bytes of messages that a task holds at a time.
BATCH_BYTES = 16 << 20


def _put(path: str, data: bytes) -> None:
    from pyspark import TaskContext

    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def pack_labels(points: DataFrame) -> DataFrame:
    """One row for each frame with the bytes of its label file (``word``, 32 bits, in order of ``point_idx``)."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_idx")
        return pd.DataFrame([{"sequence": g["sequence"].iloc[0], "frame_id": g["frame_id"].iloc[0], "content": g["word"].to_numpy("<u4").tobytes()}])

    return points.select("sequence", "frame_id", "point_idx", "word").groupBy("sequence", "frame_id").applyInPandas(run, "sequence string, frame_id int, content binary")


def write_files(packed: DataFrame, root: str, kind: str, suffix: str) -> int:
    """Write each frame's content to ``root/<sequence>/<kind>/NNNNNN.<suffix>``; returns the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seq, frame, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                _put(f"{root}/{seq}/{kind}/{frame:06d}.{suffix}", data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return packed.select("sequence", "frame_id", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: The list of a log's parts; a log is what this file names.
INDEX = "_parts.json"


def write_log(messages: DataFrame, root: str) -> int:
    """Record messages (``frame_id``, ``message``) as a log: each behind its length as u32, in order of the frames.

    The log is the part files that its list names, one for each range of frames. Every task writes a file of its own; the
    list is written at the end, so a second log in the same folder replaces the first, and a job that dies leaves the old one. Returns the number of messages.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = store(root)
        context, out, n, file = TaskContext.get(), None, 0, None
        for b in batches:
            for m in b.column(1):
                if out is None:
                    file = f"{name}-{context.taskAttemptId()}-{context.partitionId():06d}.log"
                    out = fs.open_output_stream(f"{base}/{file}")
                data = m.as_buffer()
                out.write(struct.pack("<I", data.size))
                out.write(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], ["file", "n"])

    fs, base = store(root)
    fs.create_dir(base, recursive=True)
    ranges = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = messages.select("frame_id", "message").repartitionByRange(ranges, "frame_id").sortWithinPartitions("frame_id")
    parts = sorted(((r["file"], r["n"]) for r in ordered.mapInArrow(run, "file string, n long").collect()), key=lambda r: r[0].rsplit("-", 1)[1])
    with fs.open_output_stream(f"{base}/{INDEX}.{name}") as out:
        out.write(json.dumps(parts).encode())
    fs.move(f"{base}/{INDEX}.{name}", f"{base}/{INDEX}")
    for f in listed(fs, base):
        if f.base_name.endswith(".log") and f.base_name not in {file for file, _ in parts}:
            fs.delete_file(f.path)
    return sum(n for _, n in parts)


def log_parts(root: str) -> list[tuple[str, int]]:
    """Files of a log in their order and how many messages each holds: one small entry for each part."""
    fs, base = store(root)
    if fs.get_file_info(f"{base}/{INDEX}").type == pfs.FileType.NotFound:
        raise FileNotFoundError(f"{root} holds no whole frame log")
    return [(f"{base}/{file}", n) for file, n in json.loads(fs.open_input_file(f"{base}/{INDEX}").read())]


def part_messages(root: str, file: str, first: int, last: int) -> Iterator[bytes]:
    """The messages ``first`` to ``last`` (exclusive) of a part, read one at a time; a message that is cut off ends it."""
    fs, _ = store(root)
    with fs.open_input_stream(file, buffer_size=1 << 20) as f:
        for k in range(last):
            head = f.read(4)
            if len(head) < 4:
                return
            data = f.read(struct.unpack("<I", head)[0])
            if len(data) < struct.unpack("<I", head)[0]:
                return
            if k >= first:
                yield data


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The messages of a log with their place (``part``, ``pos``); a message cut off at the end of a part is left out."""
    parts = [(k, file, n) for k, (file, n) in enumerate(log_parts(root))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pos, held, size = 0, [], 0
                for m in part_messages(root, file, 0, n):
                    held.append(m)
                    size += len(m)
                    if size > BATCH_BYTES:
                        yield _placed(part, pos, held)
                        pos, held, size = pos + len(held), [], 0
                yield _placed(part, pos, held)

    files = spark.createDataFrame(parts, "part int, file string, n long")
    return files.repartition(max(1, len(parts)), "part").mapInArrow(run, "part int, pos long, message binary")


def _placed(part: int, pos: int, held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array(range(pos, pos + len(held)), pa.int64()), pa.array(held, pa.binary())], ["part", "pos", "message"])


def numbered(log: DataFrame) -> tuple[DataFrame, int]:
    """The messages by their number in the whole log (``index``), and how many there are: one small row for each part is summed."""
    begins, total = [], 0
    for r in sorted(log.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        begins.append((r["part"], total))
        total += r["n"]
    offsets = log.sparkSession.createDataFrame(begins or [(-1, 0)], "part int, begin long")
    return log.join(F.broadcast(offsets), "part").select((F.col("begin") + F.col("pos")).alias("index"), "message"), total


def at_ticks(ticks: DataFrame, log: DataFrame) -> DataFrame:
    """The message of every tick (``value`` counts from 0); after the last one the log starts again. An empty log gives nothing."""
    messages, n = numbered(log)
    return ticks.withColumn("index", F.pmod("value", F.lit(max(n, 1)))).join(messages, "index")


def replay(spark: SparkSession, root: str, rate: int = 30) -> DataFrame:
    """A stream of the log's messages, ``rate`` a second, without end."""
    return at_ticks(spark.readStream.format("rate").option("rowsPerSecond", rate).load(), read_log(spark, root))
