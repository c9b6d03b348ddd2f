"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (operator 12)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, fresh, partitions, shared_folder, small_batches, word_hashes
from .pages import coded, flat, gather, paged, squeezed, squeezed_codes, stored_by_page, unsqueezed, unsqueezed_codes

SPACE, LETTER, DIGIT, OTHER = range(4)


# -- pre-tokens ------------------------------------------------------------------------------------

_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point, as the tokenizer library's own patterns see them."""
    if not _classes:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
            found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={}).encode_ordinary(every)
            table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def pretoken_starts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the matches of the published pattern begin, for all texts of a block at once.

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: a run of one class is a match and takes a
    space before it along; white space before a visible character gives its last character away, and what is no
    space stands alone then; an apostrophe that begins a match takes one of the seven endings.
    """
    if not len(b):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((b & 0xC0) != 0x80)
    u = b if len(lead) == len(b) else np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)
    n, kind = len(u), char_classes()[u]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True  # also the end
    visible = kind != SPACE
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.zeros(n, bool)
    after[1:] = (u[:-1] == 32) & ~first[1:n]
    start &= ~(visible & after)
    gives = np.zeros(n, bool)  # white space before a visible character of the same text
    gives[:-1] = ~visible[:-1] & visible[1:] & ~first[1:n]
    start |= gives
    at = np.flatnonzero(start & (u == 39))
    if len(at):
        end = n - 1
        one, two = u[np.minimum(at + 1, end)], u[np.minimum(at + 2, end)]
        own = ~first[at + 1]
        short = own & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        both = own & ~first[np.minimum(at + 2, n)] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        start[at[short | both] + 1] = False
        rest = np.concatenate([at[short] + 2, at[both] + 3])
        rest = rest[(rest < n) & ~first[np.minimum(rest, n)]]
        start[rest[kind[rest] == LETTER]] = True
    return lead[start]


# -- ranks -----------------------------------------------------------------------------------------


class Ranks:
    """The token bytes of a rank file and a piece encoder: the whole of a string is one match."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(k) for a, k in map(bytes.split, f)}
        self.ranks, self.encoder = ranks, None
        size = max(ranks.values(), default=-1) + 1
        table = [b""] * size
        for word, k in ranks.items():
            table[k] = word
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in table])]).astype(np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the words, and their ids."""
        if self.encoder is None:
            self.encoder = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        ids = [self.encoder.encode_ordinary(w.decode()) for w in words]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return lens, np.fromiter((x for y in ids for x in y), np.uint32, int(lens.sum()))


_ranks: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


# -- encoding --------------------------------------------------------------------------------------


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte-level BPE ids of every row of ``docs``: the id column (as it is) and ``ids``, 32-bit little-endian numbers.

    1. Documents are cut into pages (``PAGE_BYTES`` of text). A page's pre-tokens are exploded with their positions: its
       distinct words, and for every position the number of its word. Both are written to the shared folder once, bucketed by page.
    2. The words are shuffled by a bucket of their hash, as packets: one row has the words of one page in one bucket,
       because a row for each word would cost several times its bytes. A bucket's task meets every word of
       the bucket and encodes each distinct one once.
    3. The ids are joined back by page (a cogroup of the positions with the packets of ids) and put at their positions.

    A frequent word costs one entry a page, so no key is hot; a page is bounded, but for a single longer text. A task holds one
    page, or the distinct words of one bucket (there are four buckets for each shuffle partition).
    Null and empty texts give no ids. Ids of documents may be null, repeated or of any type; every row gives one row.
    Other columns are ignored, whatever they are named. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = 4 * partitions(spark)
    stage = shared_folder(spark, "bpe-pages")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, steps in paged(batches, "text"):
            parts, lens = [], []
            for b in steps:
                t = Texts(b.column(1))
                starts = pretoken_starts(t.bytes, t.offsets)
                parts.append((t.bytes, starts))
                lens.append(np.diff(np.searchsorted(starts, t.offsets)))
            words, codes = coded(parts)
            data, off = flat(words)
            bucket = (word_hashes(data, off[:-1], off[1:]) % np.uint64(buckets)).astype(np.int64)
            # Codes by frequency are short; packets list their words in the order of the codes.
            seen = np.bincount(codes, minlength=len(words))
            order = np.argsort(-seen, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            names = pa.concat_arrays([b.column(0) for b in steps])
            by = np.lexsort((place, bucket))
            edge = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1)) if len(words) else np.zeros(1, np.int64)
            rows = [{"bucket": -1, "codes": squeezed_codes(place[codes]), "lens": squeezed(np.concatenate(lens)), "buckets": squeezed(bucket[order].astype("<u4"))}]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                own, run = gather(data, off, by[a:z])
                rows.append({"bucket": int(bucket[by[a]]), "words": squeezed(own), "sizes": squeezed(np.diff(run).astype("<u4"))})
            first = pa.ListArray.from_arrays(pa.array([0, len(names)] + [len(names)] * (len(rows) - 1), pa.int32()), names)
            cols = [pa.array([page] * len(rows), pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()), first]
            cols += [pa.array([r.get(c) for r in rows], pa.binary()) for c in ("codes", "lens", "buckets", "words", "sizes")]
            yield pa.RecordBatch.from_arrays(cols, ["page", "bucket", "names", "codes", "lens", "buckets", "words", "sizes"])

    source = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))
    schema = f"page long, bucket int, names array<{kind}>, codes binary, lens binary, buckets binary, words binary, sizes binary"
    staged = stored_by_page(source.mapInArrow(scan, schema), stage)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = ranks_of(ranks), None
        known, ids, ends = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        for b in batches:
            out = []
            for page, bucket, words, sizes in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now:
                    now, known, ids, ends = bucket, pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
                size = unsqueezed(sizes, "<u4")
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(unsqueezed(words, np.uint8))])
                place = pc.index_in(own, value_set=known)
                new = own.filter(place.is_null())
                if len(new):
                    lens, fresh_ids = table.encode(new.to_pylist())
                    ends = np.concatenate([ends, ends[-1] + np.cumsum(lens)])
                    ids, known = np.concatenate([ids, fresh_ids]), pa.concat_arrays([known, new])
                    at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    at[at < 0] = np.arange(len(known) - len(new), len(known))
                else:
                    at = place.to_numpy(zero_copy_only=False).astype(np.int64)
                got, run = gather(ids, ends, at)
                out.append((page, bucket, squeezed(got.astype("<u4")), squeezed(np.diff(run).astype("<u4"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["page", "bucket", "ids", "counts"])

    packets = staged.where("bucket >= 0").select("page", "bucket", "words", "sizes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(look_up, "page long, bucket int, ids binary, counts binary")
    pages = staged.where("bucket < 0").select("page", "names", "codes", "lens", "buckets")

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("names").combine_chunks().flatten()
        codes, lens, bucket = (left.column(c)[0].as_py() for c in ("codes", "lens", "buckets"))
        codes, lens, bucket = unsqueezed_codes(codes), unsqueezed(lens, np.int64), unsqueezed(bucket, "<u4")
        right = right.sort_by("bucket")
        counts = [unsqueezed(x, "<u4") for x in right.column("counts").to_pylist()]
        ids = [unsqueezed(x, "<u4") for x in right.column("ids").to_pylist()]
        got = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)
        # Packets come by bucket, and inside by code: the place of every code among them.
        place = np.empty(len(bucket), np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        out, run = gather(got, ends, place[codes])
        edges = run[np.concatenate([[0], np.cumsum(lens)])] * 4
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out.astype("<u4"))])
        return pa.table([names, binary.cast(pa.binary())], ["name", "ids"])

    return pages.groupBy("page").cogroup(packets.groupBy("page")).applyInArrow(rebuild, f"name {kind}, ids binary").select(F.col("name").alias(id_col), "ids")


# -- decoding --------------------------------------------------------------------------------------


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids (32-bit little-endian numbers) to every row: a broadcast join with the token-byte table.

    The table has one row for each rank of the vocabulary, some 50,000, whatever the size of the corpus; every worker reads it from the
    rank file. All ids of a batch meet it at once, position by position. Null ids give null; an id beyond
    the table is an error.
    """
    name = fresh(encoded, "decoded__")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    place = encoded.columns.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks_of(ranks)
        for b in batches:
            data, off = flat(b.column(place).cast(pa.large_binary()).fill_null(b""))
            words, run = gather(table.bytes, table.offsets, np.frombuffer(data.tobytes(), "<u4").astype(np.int64))
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(run[off // 4].astype(np.int64)), pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(b.column(place).is_null(), None, out).cast(pa.binary())], [*b.schema.names, name])

    return encoded.mapInArrow(join, f"{fields}, `{name}` binary").withColumnRenamed(name, out_col)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = default_ranks()
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
