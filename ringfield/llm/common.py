"""Helpers shared by the training-data operators: checkpoints, global ranks, byte-level text scanning."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; beyond this every operator here uses a shuffle join.
BROADCAST_ROWS = 200_000
#: Bytes of text that one vectorised step looks at; a longer single text makes its own step.
BLOCK_BYTES = 1 << 20

_WHITE = bytes([0x20, *range(0x09, 0x0E)])


def fresh(table: DataFrame, prefix: str) -> str:
    """A column name that the table does not have (names are compared without case)."""
    have = {c.lower() for c in table.columns}
    name, k = prefix, 0
    while name.lower() in have:
        k += 1
        name = f"{prefix}_{k}"
    return name


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    It is read from the session; only where the setting is absent and Spark runs on this machine alone (tests, a
    laptop) a temporary folder is taken. On a cluster the missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def saved(table: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``checkpoint_folder``."""
    checkpoint_folder(table.sparkSession)
    return table.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python 8 MB at a time.

    A batch exists several times at once (in the JVM, on its way, in the worker), and Spark's 64 MB a batch are too
    much for small executors. The session's setting is changed only where it has its default value.
    """
    if spark.conf.get(_BATCH_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH_BYTES, "8m")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished phases now: its cleaner acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def maybe_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the table has at most ``limit`` rows (counted); else leave the join to a shuffle."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(table: DataFrame, order: list[Column], name: str = "rank", sums: dict[str, str] | None = None) -> tuple[DataFrame, int, dict[str, int]]:
    """Sort the whole table and number its rows 0, 1, 2, ... without putting them in one task.

    A range shuffle deals the rows out, each partition is sorted, and the counts of the partitions
    (as many small rows as there are partitions) give every partition its first number. ``sums`` adds
    running totals: ``{"new column": "long column"}`` gives the sum over all rows up to and with this one.
    Returns the table (checkpointed), the number of rows and the grand totals. ``order`` must be total
    wherever the caller needs reruns to agree.
    """
    sums = sums or {}
    spark = table.sparkSession
    part, local = fresh(table, "part__"), fresh(table, "local__")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    extra = "".join(f", `{c}` bigint" for c in sums)
    source = list(sums.items())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, totals, pid = 0, [0] * len(source), TaskContext.get().partitionId()
        for b in batches:
            cols, names = list(b.columns), list(b.schema.names)
            cols += [pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(seen, seen + b.num_rows))]
            names += [part, local]
            for k, (new, old) in enumerate(source):
                run = np.cumsum(b.column(b.schema.get_field_index(old)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + totals[k]
                totals[k] = int(run[-1]) if len(run) else totals[k]
                cols.append(pa.array(run))
                names.append(new)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names)

    dealt = table.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    numbered = saved(dealt.mapInArrow(number, f"{fields}, `{part}` int, `{local}` bigint{extra}"))
    ends = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(f"s{k}") for k, c in enumerate(sums)]).orderBy(part).collect()
    first, before, rows = 0, [0] * len(sums), []
    for r in ends:
        rows.append((r[part], first, *before))
        first += r["n"]
        before = [b + (r[f"s{k}"] or 0) for k, b in enumerate(before)]
    starts = spark.createDataFrame(rows or [(-1, 0, *before)], f"{part} int, first__ bigint" + "".join(f", s{k}__ bigint" for k in range(len(sums))))
    joined = numbered.join(F.broadcast(starts), part)
    out = joined.select(*[joined[c] for c in table.columns], (F.col(local) + F.col("first__")).alias(name), *[(F.col(f"`{c}`") + F.col(f"s{k}__")).alias(c) for k, c in enumerate(sums)])
    return out, first, {c: before[k] for k, c in enumerate(sums)}


class Texts:
    """The texts of an Arrow column as one array of bytes with offsets; null counts as empty."""

    def __init__(self, column: pa.Array):
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        column = column.fill_null("")
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size and len(off) else np.zeros(0, np.uint8)
        self.offsets = (off - off[0]) if len(off) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes together; a longer text stays whole, alone."""
    lens = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n, base = 0, batch.num_rows, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(lens, base + size, "right")))
        yield batch.slice(at, end - at)
        base, at = int(lens[end - 1]), end


def table_of(words: str) -> np.ndarray:
    """A 256-entry table that folds A-Z and maps every byte outside the word class to 0.

    ``"white"``: words are runs without the six ASCII white-space characters.
    ``"alnum"``: words are runs of ASCII letters, digits and non-ASCII characters.
    """
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if words == "white":
        t[list(_WHITE)] = 0
        t[0] = 255  # a NUL is an ordinary character there; 255 is no byte of UTF-8
    else:
        for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
            t[lo : hi + 1] = 0
    return t


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a text's offset."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    cut = np.unique(inner[mask[inner] & mask[inner - 1]])
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, r in enumerate((_R, _RINV)):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every word, from prefix sums, piece by piece so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        s, e = starts[at:end] - base, ends[at:end] - base
        up, down = _power(int(e[-1]) + 1)
        run = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(folded[base : base + int(e[-1])] * up[: int(e[-1])], out=run[1:])
        out[at:end] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words of the array (empty if it is shorter)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * _R + words[k : k + m]
    return mix(h + np.uint64(n))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under that of ``checkpoint_folder``."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, folder: str) -> DataFrame:
    """Write the table as Parquet below a shared folder and read it back.

    Unlike a checkpoint this also drops what the optimiser knows of the old plan: in loops those
    constraints pile up, and planning takes longer every round.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
