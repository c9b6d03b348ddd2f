"""Pages: stretches of documents coded by a dictionary of their own, so that a global look-up moves each word once a page."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame

from .common import Texts, blocks, partitions

#: Bytes of text of a page. A larger page repeats fewer words, and its codes and dictionary must fit a task several times.
PAGE_BYTES = 8 << 20
#: Bytes of text in one vectorised step.
STEP_BYTES = 1 << 20
#: Entries that ``gather`` handles at once.
GATHERED = 1 << 18


def paged(batches: Iterator[pa.RecordBatch], text: str, size: int = PAGE_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of a task as numbered pages, each a list of steps; a longer text makes its own step."""
    from pyspark import TaskContext

    number, held, room = TaskContext.get().partitionId() << 33, [], 0
    for whole in batches:
        for b in blocks(whole, text, STEP_BYTES):
            held.append(b)
            room += b.column(b.schema.get_field_index(text)).nbytes
            if room >= size:
                yield number, held
                number, held, room = number + 1, [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield number, held


def coded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct pieces of (bytes, piece starts) parts and the number of each piece in them."""
    arrays = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(b)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b))]) for b, s in parts if len(s)]
    if not arrays:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32)
    chunks = pa.chunked_array(arrays).dictionary_encode().chunks
    return chunks[-1].dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in chunks]).astype(np.int32)


def flat(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of binaries without nulls."""
    t = Texts(pa.LargeStringArray.from_buffers(len(words), words.buffers()[1], words.buffers()[2], None, 0, words.offset) if len(words) else pa.array([], pa.large_string()))
    return t.bytes, t.offsets


def gather(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of a list array (data, offsets), one after the other, and their offsets; some at a time, so that little is held besides them."""
    run = np.zeros(len(which) + 1, np.int64)
    np.cumsum(offsets[which + 1] - offsets[which], out=run[1:])
    out = np.empty(int(run[-1]), data.dtype)
    for at in range(0, len(which), GATHERED):
        first, edge = offsets[which[at : at + GATHERED]], run[at : at + GATHERED + 1]
        out[edge[0] : edge[-1]] = data[np.arange(edge[0], edge[-1]) + np.repeat(first - edge[:-1], np.diff(edge))]
    return out, run


def squeezed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(np.ascontiguousarray(a).tobytes())


def unsqueezed(b: bytes, dtype: str | type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def squeezed_codes(codes: np.ndarray) -> bytes:
    """Codes as a stream of bytes: frequent ones (small numbers) in one byte, others as 253 to 255 and two bytes or four."""
    one, more = codes.astype(np.uint32), codes >= 253
    wide = bool(len(codes)) and int(codes.max()) >= 3 << 16
    head = np.where(more, 253 if wide else 253 + (one >> 16), one).astype(np.uint8)
    tail = one[more].astype("<u4" if wide else "<u2")
    return b"%d,%d,%d;" % (wide, len(a := squeezed(head)), len(codes)) + a + squeezed(tail)


def unsqueezed_codes(b: bytes) -> np.ndarray:
    at = b.index(b";")
    wide, n, _ = map(int, b[:at].split(b","))
    head = unsqueezed(b[at + 1 : at + 1 + n], np.uint8)
    codes, more = head.astype(np.int64), head >= 253
    tail = unsqueezed(b[at + 1 + n :], "<u4" if wide else "<u2").astype(np.int64)
    codes[more] = tail if wide else tail + ((codes[more] - 253) << 16)
    return codes


def stored_by_page(table: DataFrame, path: str) -> DataFrame:
    """Write a table bucketed by its column ``page`` to a shared folder and read it back: a join by page need not shuffle it again."""
    spark = table.sparkSession
    name = f"pages_{uuid.uuid4().hex}"
    table.write.option("compression", "none").option("path", path).bucketBy(partitions(spark), "page").saveAsTable(name)
    back = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    return back
