"""Media columns: chroma audio fingerprints and their alignment (operator 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: Samples a second of the recordings, samples of a frame and between two frames.
RATE, FRAME, HOP = 4096, 1024, 512
#: Pitch range that is folded into the 12 pitch classes, in Hz.
LOWEST, HIGHEST = 110.0, 1760.0
#: Frames under one set of filters.
SPAN = 8
#: Postings (frames of queries) that one broadcast index holds; more queries are taken in several blocks.
INDEX_FRAMES = 1 << 20


def pitch_map(rate: int = RATE) -> np.ndarray:
    """Which of the 12 pitch classes each frequency bin belongs to (-1: none), 440 Hz being class 9."""
    hz = np.arange(FRAME // 2 + 1) * rate / FRAME
    out = np.full(len(hz), -1)
    inside = (hz >= LOWEST) & (hz <= HIGHEST)
    out[inside] = np.round(12 * np.log2(hz[inside] / 440.0) + 9).astype(int) % 12
    return out


@lru_cache(maxsize=8)
def _folding(rate: int) -> tuple[int, int, np.ndarray]:
    """The frequency bins in use (first, end) and the 0/1 matrix that folds them into pitch classes."""
    bins = pitch_map(rate)
    inside = np.flatnonzero(bins >= 0)
    if not len(inside):
        return 0, 0, np.zeros((0, 12))
    lo, hi = int(inside[0]), int(inside[-1]) + 1
    return lo, hi, (bins[lo:hi, None] == np.arange(12)).astype(float)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy of the 12 pitch classes in every whole frame, each frame scaled to a sum of 1 (silence: zeros)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    lo, hi, fold = _folding(rate)
    wave = np.fft.rfft(frames * np.hanning(FRAME), axis=1)[:, lo:hi]
    out = (wave.real**2 + wave.imag**2) @ fold
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-9)


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters by rule: kind, first pitch class, number of classes, number of frames.

    Kinds: 0 all, 1 upper against lower half, 2 later against earlier half, 3 crossed quarters, 4 the middle
    third of the classes against the rest, 5 the middle third of the frames against the rest.
    """
    return [(k % 6, (5 * k) % 9 if k % 6 else (5 * k) % 10, 3 if k % 6 in (0, 4) else 4 if k % 2 else 3, (SPAN, 4, 6)[k % 3]) for k in range(16)]


#: Bounds of the four values of a filter, on the logarithm of the ratio of its two areas.
BOUNDS = np.array([-0.6, 0.0, 0.6])


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each position of ``SPAN`` frames: sixteen filters of two bits (Gray code)."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    table = np.zeros((len(image) + 1, 13))
    table[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(f0: int, f1: int, p0: int, p1: int) -> np.ndarray:
        return table[at + f1, p1] - table[at + f0, p1] - table[at + f1, p0] + table[at + f0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, high, wide in filters():
        whole = area(0, wide, p, p + high)
        if kind == 0:
            a, b = whole, area(0, wide, 0, 12) * (high / 12)
        elif kind == 1:
            a = area(0, wide, p + high // 2, p + high)
            b = whole - a
        elif kind == 2:
            a = area(wide // 2, wide, p, p + high)
            b = whole - a
        elif kind == 3:
            a = area(0, wide // 2, p, p + high // 2) + area(wide // 2, wide, p + high // 2, p + high)
            b = whole - a
        elif kind == 4:
            a = area(0, wide, p + high // 3, p + 2 * high // 3)
            b = (whole - a) / 2
        else:
            a = area(wide // 3, 2 * wide // 3, p, p + high)
            b = (whole - a) / 2
        value = np.digitize(np.log((np.maximum(a, 0) + 0.01) / (np.maximum(b, 0) + 0.01)), BOUNDS)
        out = out << np.uint32(2) | (value ^ value >> 1).astype(np.uint32)
    return out


def pcm(value: bytes) -> np.ndarray:
    """Samples of 16-bit little-endian mono sound; a last odd byte is left out."""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2")


def fingerprints(media: DataFrame, id_col: str, media_col: str, rate: int = RATE, decode: Callable[[object], np.ndarray] = pcm) -> DataFrame:
    """Add ``print`` (binary: little-endian 32-bit integers) to the id of every recording.

    ``decode`` gives the 16-bit samples of a value of the media column (by default: of raw PCM), in the same task.
    Null, empty and short recordings have an empty print; repeated rows stay. Memory is that of one recording.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(chroma(decode(x) / 32768.0, rate)).astype("<u4").tobytes() if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary())], [id_col, "print"])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, print binary")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frame and length of every stretch of equal integers."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


class Index:
    """The packed integers of some queries: their stretches of equal integers, sorted by the integer."""

    def __init__(self, queries: list[tuple[object, bytes]]):
        self.ids = [q for q, _ in queries]
        self.prints = [np.frombuffer(p, "<u4") for _, p in queries]
        runs = [_runs(p) for p in self.prints]
        first, length = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in runs)]).astype(np.int64) for k in (0, 1))
        values = np.concatenate([np.zeros(0, np.uint32), *(p[f] for p, (f, _) in zip(self.prints, runs, strict=True))])
        query = np.repeat(np.arange(len(runs)), [len(f) for f, _ in runs])
        order = np.argsort(values, kind="stable")
        self.values, self.query, self.first, self.length = values[order], query[order], first[order], length[order]

    def votes(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every query with an equal integer: its number, its offset with most votes (the smallest of equal ones) and the votes.

        Two stretches of one integer, of lengths a and b, vote for a + b - 1 offsets: a trapezoid with four corners.
        Votes are sums of trapezoids, so they are kept as corners (second differences): silence or a
        standing tone costs one meeting of stretches, not one of every two frames. A sum of trapezoids is
        greatest just before a corner, and first there.
        """
        first, length = _runs(own)
        value = own[first]
        lo, hi = np.searchsorted(self.values, value, "left"), np.searchsorted(self.values, value, "right")
        n = hi - lo
        none = np.zeros(0, np.int64)
        if not n.sum():
            return none, none, none
        place = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        a, b = np.repeat(length, n), self.length[place]
        start = self.first[place] - np.repeat(first, n) - a + 1
        at = np.concatenate([start, start + a, start + b, start + a + b])
        keys, which = np.unique(np.tile(self.query[place] << 32, 4) | (at + (1 << 31)), return_inverse=True)
        slope = np.cumsum(np.bincount(which, np.repeat([1.0, -1.0, -1.0, 1.0], len(place))).astype(np.int64))
        query, corner = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
        # Slopes and votes of a query end at 0, so one running sum serves all queries.
        same = query[1:] == query[:-1]
        count = np.concatenate([[0], np.cumsum(np.where(same, slope[:-1] * (corner[1:] - corner[:-1]), 0))])
        order = np.lexsort((corner, -count, query))
        top = order[np.flatnonzero(np.diff(query[order], prepend=-1))]
        return query[top], corner[top] - 1, count[top]

    def align(self, own: np.ndarray, votes: int, errors: float, overlap: int) -> list[tuple[object, int, int, float]]:
        """Queries that align with a print: query, offset (query frame less own frame), votes, bit error rate.

        Equal integers vote for their offset. For every query the offset with most votes (the smallest of equal
        ones) is verified by the share of differing bits over all frames that overlap there.
        """
        out = []
        for q, o, n in zip(*(x.tolist() for x in self.votes(own)), strict=True):
            if n < votes:
                continue
            p = self.prints[q]
            a, b = max(0, o), min(len(p), len(own) + o)
            if b - a >= overlap:
                rate = float(np.bitwise_count(p[a:b] ^ own[a - o : b - o]).sum()) / (32 * (b - a))
                if rate <= errors:
                    out.append((self.ids[q], o, n, rate))
        return out


def align(prints: DataFrame, queries: DataFrame, id_col: str, votes: int = 3, errors: float = 0.25, overlap: int = 12) -> DataFrame:
    """Align every print with the queries: id, query, offset, votes, errors; both tables have the id and ``print``.

    The query set is taken in blocks of about ``INDEX_FRAMES`` frames, each broadcast as an index to one pass over
    the prints; nothing is emitted but verified alignments. No limit on partners. With several blocks the result of a
    pass is stored and its index released before the next block is read. Empty prints align with nothing; repeated
    rows give repeated alignments; other columns of both tables are left out.
    """
    spark = prints.sparkSession
    sized = queries.select(F.col(id_col).alias("q"), "print", (F.octet_length("print") / 4).cast("long").alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices, out = max(1, -(-total // INDEX_FRAMES)), None
    kind = prints.schema[id_col].dataType.simpleString()
    for s in range(slices):
        part = sized.where(F.pmod(F.xxhash64("q"), F.lit(slices)) == s) if slices > 1 else sized
        index = spark.sparkContext.broadcast(Index(sorted((r["q"], bytes(r["print"])) for r in part.collect())))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, *m) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in index.value.align(np.frombuffer(p, "<u4"), votes, errors, overlap)]
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], b.column(0).type), *[pa.array(c, t) for c, t in zip(cols[2:], (pa.int64(), pa.int64(), pa.float64()), strict=True)]], [id_col, "query", "offset", "votes", "errors"])

        one = prints.select(id_col, "print").mapInArrow(run, f"`{id_col}` {kind}, query {kind}, offset long, votes long, errors double")
        if slices > 1:
            one = saved(one)
            index.unpersist()
        out = one if out is None else out.unionByName(one)
    return out


@lru_cache(maxsize=4)
def _tones(step: float) -> np.ndarray:
    n = int(RATE * step)
    time = np.arange(n) / RATE
    fade = np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / 64)
    return np.stack([np.round(12000 * fade * np.sin(2 * np.pi * 110 * 2 ** (k / 12) * time)) for k in range(48)]).astype("<i2")


def sounding(vector: list[float | None], step: float = 0.25) -> np.ndarray:
    """Samples from a vector: each component sounds for ``step`` seconds at one of 48 semitones (null: the lowest)."""
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in vector]))
    return _tones(step)[np.floor(x * 20).astype(np.int64) % 48].reshape(-1)


def sonify(vectors: DataFrame, id_col: str, vector_col: str, step: float = 0.25) -> DataFrame:
    """A media column from vectors, as ``sounding`` gives it.

    The tables hold no recordings; this gives each vector one, alike for like vectors. Null vectors give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = [None if v is None else sounding(v, step).tobytes() for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], [id_col, "pcm"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, pcm binary")


def align_every(prints: DataFrame, id_col: str, is_query: object) -> DataFrame:
    """Each recording with its class (smallest id with the same print) and the query classes that align with it.

    Recordings with equal prints are one class, aligned once; a class with any query id is a query. Adds
    ``class_id``, ``frames`` and ``matches`` (query class, offset, votes, errors in 1/10000 of the bits, sorted by query).
    Every class but that of the empty print takes part; repeated ids stay repeated rows.
    """
    prints = saved(prints.withColumn("key", F.sha2("print", 256)))
    classes = saved(prints.groupBy("key").agg(F.min(id_col).alias("class_id"), F.max(is_query).alias("asks"), F.first("print").alias("print")))
    some = classes.where(F.octet_length("print") > 0).select(F.col("class_id").alias(id_col), "print", "asks")
    found = align(some, some.where("asks"), id_col)
    lists = found.groupBy(F.col(id_col).alias("class_id")).agg(F.sort_array(F.collect_list(F.struct("query", "offset", "votes", F.round(F.col("errors") * 10000).cast("long").alias("errors")))).alias("matches"))
    told = classes.select("key", "class_id", (F.octet_length("print") / 4).cast("long").alias("frames")).join(lists, "class_id", "left")
    none = F.array().cast(f"array<struct<query:{prints.schema[id_col].dataType.simpleString()},offset:bigint,votes:bigint,errors:bigint>>")
    return prints.select(id_col, "key").join(told, "key").select(id_col, "class_id", "frames", F.coalesce("matches", none).alias("matches"), F.col("key").alias("print_sha256"))


def op10_audio_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return align_every(fingerprints(vectors, "vec_id", "embedding", decode=sounding), "vec_id", F.col("vec_id") % 100 == 0)
