"""The frame log as a stream source: offsets count messages, the log may start again at its end, and slow readers may skip to the latest frame."""

from __future__ import annotations

import bisect
import itertools
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .replay import BATCH_BYTES, log_parts, part_messages

LOG_DDL = "index long, part int, pos long, message binary"


@dataclass
class Slice(InputPartition):
    """The messages ``first`` to ``last`` (exclusive) of a part; the first one has the number ``index`` in the stream."""

    index: int
    part: int
    file: str
    first: int
    last: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.parts = log_parts(self.root)
        self.ends = list(itertools.accumulate(n for _, n in self.parts))
        self.total = self.ends[-1] if self.ends else 0
        self.loop, self.latest = options.get("loop", "false") == "true", options.get("latest", "false") == "true"
        self.per_batch = int(options["perBatch"]) if "perBatch" in options else None
        self.rate = float(options["rate"]) if "rate" in options else None
        if self.latest and self.rate is None:
            raise ValueError("latest needs the option rate")
        if self.loop and self.rate is None and self.per_batch is None:
            raise ValueError("a log without end needs the option rate or perBatch")
        self.at: int | None = None
        self.began: tuple[float, int] | None = None

    def initialOffset(self) -> dict:
        return {"index": 0}

    def latestOffset(self) -> dict:
        """The number after the last message that is due: some more at every trigger, or those that the rate has reached."""
        at = self.at or 0
        if self.rate is not None:
            if self.began is None:
                self.began = (time.monotonic(), at)
            due = self.began[1] + int((time.monotonic() - self.began[0]) * self.rate)
            due = due if self.latest or self.per_batch is None else min(due, at + self.per_batch)
        else:
            due = self.total if self.per_batch is None else at + self.per_batch
        self.at = max(at, due if self.loop and self.total else min(due, self.total))
        return {"index": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Slices of the parts between the offsets. Spark asks for the last planned batch when a query starts again, and the stream goes on behind it."""
        if self.at is None:
            self.at = end["index"]
        lo, hi, out = start["index"], end["index"], []
        if self.latest:
            lo = max(lo, hi - 1)
        while lo < hi:
            place = lo % self.total
            k = bisect.bisect_right(self.ends, place)
            first = place - (self.ends[k - 1] if k else 0)
            n = min(hi - lo, self.ends[k] - place)
            out.append(Slice(lo, k, self.parts[k][0], first, first + n))
            lo += n
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        held, size, pos = [], 0, partition.first

        def batch() -> pa.RecordBatch:
            n, index = len(held), partition.index + pos - partition.first
            return pa.RecordBatch.from_arrays([pa.array(range(index, index + n), pa.int64()), pa.array([partition.part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), pa.array(held, pa.binary())], ["index", "part", "pos", "message"])

        for m in part_messages(self.root, partition.file, partition.first, partition.last):
            held.append(m)
            size += len(m)
            if size > BATCH_BYTES:
                yield batch()
                held, size, pos = [], 0, pos + len(held)
        if pos + len(held) < partition.last:
            raise ValueError(f"{partition.file} ends before message {partition.last - 1}")
        if held:
            yield batch()


class LogSource(DataSource):
    """``spark.readStream.format("framelog")`` for a log written by ``write_log``.

    Options: ``path``; ``perBatch`` (messages of a micro-batch at most); ``rate`` (messages a second since the start of the query, else
    as fast as batches go); ``loop`` = true (the log starts again at its end; an empty one gives nothing); ``latest`` = true (of the messages due since the last trigger only the newest,
    needs ``rate``). Offsets are numbers of messages, so a query with a checkpoint goes on at the next message. A
    log that is replaced while a query reads it is an error. Without ``perBatch`` and ``loop`` a batch is all that is left.
    """

    @classmethod
    def name(cls) -> str:
        return "framelog"

    def schema(self) -> str:
        return LOG_DDL

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def log_stream(spark: SparkSession, root: str, **options: str | int | float) -> DataFrame:
    """A stream of (index, part, pos, message); options as in ``LogSource``."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("framelog").options(path=root, **options).load()
