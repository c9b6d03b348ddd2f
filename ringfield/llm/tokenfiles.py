"""Token-ID / binary output: canonical length-limited Huffman files with block-wise decoding (operator 8)."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, blocks, maybe_broadcast, partitions, remove_folder, shared_folder, small_batches

#: Longest code in bits; at least log2 of the number of different ids.
LIMIT = 18
#: Tokens between two bit-offset checkpoints, and tokens after which a block is closed.
EVERY, BLOCK_TOKENS = 256, 1 << 20
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Pieces in one call of the library.
ENCODED_AT_ONCE = 8192

# -- tokenising ------------------------------------------------------------------------------------


def piece_starts(b: np.ndarray, offsets: np.ndarray, added: list[tuple[int, int]] = ()) -> np.ndarray:
    """Offsets at which the byte-level pattern always splits, so that the pieces can be encoded one by one.

    ``added`` has the first and last offsets of the added tokens in the texts; each is a piece of its own.

    Such places are: a letter before ASCII punctuation, a visible character before a space or line feed
    that opens a white-space run, and a visible character after a lone line feed. Elsewhere pieces stay
    joined, which costs repeats, never correctness.
    """
    kind = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 4 punctuation, of ASCII
    kind[33:127] = 4
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 1
    n = len(b)
    flag = np.zeros(n, bool)
    if n > 1:
        k = kind[b]
        latin = np.zeros(n, bool)  # the second byte of a Latin-1 letter
        np.logical_and(b[:-1] == 0xC3, (b[1:] != 0x97) & (b[1:] != 0xB7), out=latin[1:])
        letter = (k == 1) | latin
        seen = (k > 0) | latin
        flag[1:] = seen[:-1] & ((b[1:] == 32) | (b[1:] == 10)) | letter[:-1] & (k[1:] == 4)
        flag[2:] |= (b[1:-1] == 10) & seen[:-2] & ((k[2:] > 0) | (b[2:] == 0xC3))
    for begin, end in added:
        flag[begin:end] = False
        flag[begin] = True
        flag[end : end + 1] = True
    flag[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(flag)


class Encoder:
    """Ids of texts by the tokenizers library; a piece that occurs again is not encoded again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        #: The library takes added tokens out of a text before its pattern splits the rest; the longest at the first place wins.
        self.added = re.compile(b"|".join(re.escape(x.content.encode()) for x in sorted(tokens, key=lambda x: -len(x.content.encode())))) if tokens else None
        self.whole = any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in tokens)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end_id`` after every text, and the offsets of the texts in them."""
        t = Texts(column)
        starts = piece_starts(t.bytes, t.offsets, self.added_in(t))
        bounds = np.append(starts, len(t.bytes)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(t.bytes))).dictionary_encode()
        words, which = pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False)
        if len(self.known) + len(words) > REMEMBERED and len(self.known):
            self.clear()
        place = pc.index_in(words, value_set=self.known)
        if place.null_count:
            new = words.filter(place.is_null())
            lens, flat = self._encode(new)
            at = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
            full = place.to_numpy(zero_copy_only=False)
            place = np.where(np.isnan(full), 0, full).astype(np.int64) if full.dtype.kind == "f" else full.astype(np.int64)
            place[np.flatnonzero(np.isnan(full))] = np.arange(at, at + len(new))
        else:
            place = place.to_numpy(zero_copy_only=False).astype(np.int64)
        use = place[which] if len(which) else np.zeros(0, np.int64)
        first, count = self.ends[use], self.ends[use + 1] - self.ends[use]
        run = np.concatenate([[0], np.cumsum(count)])
        gather = np.arange(run[-1]) + np.repeat(first - run[:-1], count)
        at = run[np.searchsorted(starts, t.offsets)]  # ids before each text, without end ids
        out = np.full(run[-1] + len(t), end_id, self.dtype)
        out[np.arange(run[-1]) + np.repeat(np.arange(len(t)), np.diff(at))] = self.ids[gather]
        return out, at + np.arange(len(t) + 1)

    def added_in(self, t: Texts) -> list[tuple[int, int]]:
        """First and last offsets of the added tokens in the texts; if some tokens depend on what is beside them, of whole texts instead."""
        if self.added is None or not self.added.search(t.bytes):
            return []
        texts = [(a, b) for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True) if b > a]
        if self.whole:
            return [(a, b) for a, b in texts if self.added.search(t.bytes, a, b)]
        return [m.span() for a, b in texts for m in self.added.finditer(t.bytes, a, b)]

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of the pieces, some thousand at a time: the library's results are large objects."""
        lens, flat = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        for at in range(0, len(pieces), ENCODED_AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.slice(at, ENCODED_AT_ONCE).to_pylist(), add_special_tokens=False)]
            lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((x for y in ids for x in y), self.dtype, int(lens[-1].sum())))
        return np.concatenate(lens), np.concatenate(flat)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- the code --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, or as few more as the number of ids needs (package-merge); 0 for an id that does not occur."""
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    lengths = np.zeros(len(counts), np.uint8)
    n = len(order)
    if n <= 1:
        lengths[order] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    weight = counts[order].astype(np.float64)
    level, leaves = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        leaves.append(sort < n)
    take, own = 2 * n - 2, np.zeros(n, np.uint8)
    for flags in reversed(leaves):
        k = int(flags[:take].sum())
        own[:k] += 1
        take = 2 * (take - k)
    lengths[order] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - before
        before = bits
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, first bit highest, and the bit offset of every ``EVERY``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    word, free = begin >> 6, 64 - (begin & 63) - size  # free < 0: the code runs on into the next word
    value = codes[ids].astype(np.uint64)
    over = np.flatnonzero(free < 0)
    high = value << np.maximum(free, 0).astype(np.uint64)
    high[over] = value[over] >> (-free[over]).astype(np.uint64)
    out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(high, first)
    out[word[over] + 1] += value[over] << (64 + free[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) >> 3], begin[::EVERY]


def unpack(bits: bytes, marks: np.ndarray, n: int, symbol: np.ndarray, length: np.ndarray, limit: int) -> np.ndarray:
    """The n ids of a block; all stretches between checkpoints are decoded side by side by table look-up."""
    if not n:
        return np.zeros(0, symbol.dtype)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = marks.astype(np.int64)
    out = np.empty((min(EVERY, n), len(at)), symbol.dtype)
    last = len(window) - 1
    for k in range(len(out)):
        v = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - limit)
        out[k] = symbol[v]
        at += length[v]
    return out.T.reshape(-1)[:n]


def decode_tables(lengths: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``limit`` bits: the id and the length of its code."""
    limit = max(1, int(lengths.max(initial=0)))
    codes = canonical_codes(lengths)
    symbol, length = np.zeros(1 << limit, dtype), np.zeros(1 << limit, np.uint8)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(codes[ids].astype(np.uint64) << (np.uint64(limit) - lengths[ids].astype(np.uint64)))]
    room = 1 << (limit - lengths[ids].astype(np.int64))
    symbol[: int(room.sum())] = np.repeat(ids, room)
    length[: int(room.sum())] = np.repeat(lengths[ids], room)
    return symbol, length, limit


# -- files -----------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise all documents and write their ids under ``path`` in ascending order of the id column.

    Format. ``path/code`` is a Parquet table of one row: the code length of every token id (bytes) and the
    width of an id. ``path/blocks`` is a Parquet table with one row for each block: ``part`` and ``block`` give the
    order, ``doc_ids`` and ``doc_tokens`` its documents and their numbers of tokens (with the end id),
    ``tokens`` their sum, ``marks`` the bit offset of every 256th token, ``bits`` the canonical Huffman codes. A block
    holds whole documents and can be decoded alone. Parquet keeps the files readable on any store of the cluster.

    The library encodes each distinct piece of text once per worker. Global counts give one length-limited
    canonical code. The ids are kept compressed between the two passes, so nothing is tokenised twice, and a range
    shuffle of these compressed ids puts the documents in order. Null texts count as empty; each document has
    at least its end id; a null document id comes first; rows with equal ids are ordered by their ids'
    bytes. An empty table gives a code table without codes and no blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stage = shared_folder(spark, "token-ids")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = _encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in blocks(whole, "text__", 4 << 20):
                ids, at = enc.encode(b.column(1), end_id)
                raw, w = ids.tobytes(), ids.itemsize
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze.compress(raw[at[i] * w : at[i + 1] * w]) for i in range(b.num_rows)], pa.binary())], ["doc_id", "ids"])

    width = _encoder(tokenizer).dtype().itemsize
    dtype = np.dtype(f"<u{width}")
    vocabulary = max(_encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text__"))
    source.mapInArrow(tokenise, "doc_id long, ids binary").write.option("compression", "none").parquet(stage)
    staged = spark.read.parquet(stage)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, expand = np.zeros(vocabulary, np.int64), zstandard.ZstdDecompressor()
        for b in batches:
            for x in b.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(expand.decompress(x), dtype), minlength=vocabulary)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], ["id", "n"])

    # At most one row for each id of the vocabulary reaches the driver.
    found = staged.select("ids").mapInArrow(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), width)], "lengths binary, width int").write.parquet(f"{path}/code")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, expand = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
        names, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            bits, marks = pack(np.concatenate(held), lengths, codes)
            row = {"part": [part], "block": [block], "doc_ids": [names], "doc_tokens": [[len(x) for x in held]], "tokens": [size], "marks": [marks], "bits": [bits]}
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], list(row))

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(expand.decompress(x), dtype)
                if held and size + len(ids) > BLOCK_TOKENS:
                    yield close()
                    names, held, size, block = [], [], 0, block + 1
                names.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            yield close()

    ordered = staged.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(write, "part int, block int, doc_ids array<long>, doc_tokens array<long>, tokens long, marks array<long>, bits binary").write.option("compression", "none").parquet(f"{path}/blocks")
    remove_folder(spark, stage)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens and the ids (binary, little-endian).

    With ``digest``, the CRC-32 of the ids as 32-bit little-endian numbers (``ids_crc32``) stands in place of the ids.
    Blocks are decoded independently, in any number of tasks. The starts come from the totals of
    the parts, one small row each, and running sums inside a part.
    """
    code = spark.read.parquet(f"{path}/code").first()
    lengths, dtype = np.frombuffer(code["lengths"], np.uint8), np.dtype(f"<u{code['width']}")
    table = spark.read.parquet(f"{path}/blocks")
    # The blocks' own sizes: one narrow row for about a million tokens, added up in order part by part.
    sizes = table.select("part", "block", "tokens")
    parts = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    begins, total = {}, 0
    for p, n in parts:
        begins[p], total = total, total + n
    offsets = spark.createDataFrame(list(begins.items()) or [(-1, 0)], "part int, begin long")
    before = F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")
    placed = sizes.withColumn("before", before).join(F.broadcast(offsets), "part").select("part", "block", (F.col("begin") + F.col("before")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, length, limit = decode_tables(lengths, dtype)
        for b in batches:
            for row in range(b.num_rows):
                start, names, sizes, n, marks, bits = (b.column(k)[row] for k in range(6))
                ids = unpack(bits.as_py(), marks.values.to_numpy(zero_copy_only=False), n.as_py(), symbol, length, limit)
                each = sizes.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(each)
                texts = [ids[e - s : e] for s, e in zip(each, ends, strict=True)]
                last = pa.array([zlib.crc32(x.astype("<u4")) for x in texts], pa.int64()) if digest else pa.array([x.tobytes() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([names.values, pa.array(ends - each + start.as_py()), pa.array(each), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    joined = table.join(maybe_broadcast(placed), ["part", "block"])  # one narrow row a block; the bits stay where they are
    return joined.select("start", "doc_ids", "doc_tokens", "tokens", "marks", "bits").mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' token files to a shared folder and return what is read back from them."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-files")
    write_token_files(docs, path, tokenizer or default_tokenizer())
    return read_token_files(spark, path, digest=True)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
