"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, blocks, fresh, gram_hashes, shared_folder, small_batches, spans_of, stored, table_of, word_hashes

#: Bytes of benchmark text in one broadcast set; a larger benchmark is split over several passes of the same scan.
SET_BYTES = 32 << 20
#: Sets that scan in one pass; beyond them the documents are written and read back, so a task holds no more sets at once.
SETS_AT_ONCE = 2

_ALNUM = table_of("alnum")


class GramSet:
    """The windows of a slice of the benchmark: hashes to look up, words to verify with, items to report.

    The words of all items stand once in one string; a window is its hash, its place there and the items that hold it, all
    in flat arrays with a sieve of bits: some 35 bytes a word.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        self.names: list[str] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, at = [], 0
        for item, text in items:
            t = Texts(pa.array([text], pa.string()))
            folded = _ALNUM[t.bytes]
            starts, ends = spans_of(folded > 0, t.offsets)
            if not len(starts):
                continue
            k = min(n, len(starts))
            size = ends - starts
            begin = at + np.cumsum(size + 1) - size - 1
            texts.append(b" ".join([folded[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]) + b" ")
            at += len(texts[-1])
            first = begin[: len(begin) - k + 1]
            found.setdefault(k, []).append((gram_hashes(word_hashes(folded, starts, ends), k), first, (begin + size)[k - 1 :], np.full(len(first), len(self.names), np.int32)))
            self.names.append(item)
        self.text = b"".join(texts)
        for k, parts in found.items():
            self.windows[k] = self._index(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _index(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows in order of their hashes, equal ones once: hashes, sieve, first and last byte, and the items of each (ends and numbers)."""
        order = np.argsort(hashes, kind="stable")
        hashes, first, last, owner = hashes[order], first[order], last[order], owner[order]
        group = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
        size = np.diff(np.append(group, len(hashes)))
        keep, more, whose = np.ones(len(hashes), bool), [], []
        for g, n in zip(group[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            known: dict[bytes, tuple[int, set[int]]] = {}
            for i in range(g, g + n):
                at, have = known.setdefault(self.text[first[i] : last[i]], (i, {int(owner[i])}))
                keep[i] = at == i
                if int(owner[i]) not in have:
                    have.add(int(owner[i]))
                    more.append(at)
                    whose.append(int(owner[i]))
        kept = np.flatnonzero(keep)
        window, item = np.concatenate([kept, np.array(more, np.int64)]), np.concatenate([owner[kept], np.array(whose, np.int32)])
        by_window = np.argsort(window, kind="stable")
        ends = np.append(np.searchsorted(window[by_window], kept), len(window))
        bits = max(16, int(len(kept)).bit_length() + 4)
        sieve = np.zeros(1 << bits, bool)
        sieve[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        place = np.int32 if max(len(self.text), len(window)) < 1 << 31 else np.int64
        return hashes[kept], np.packbits(sieve, bitorder="little"), first[kept].astype(place), last[kept].astype(place), ends.astype(place), item[by_window]

    def scan(self, column: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]], tuple]:
        """Words of each text, verified runs of hit words by text, items by text, and where the words are."""
        t = Texts(column)
        folded = _ALNUM[t.bytes]
        starts, ends = spans_of(folded > 0, t.offsets)
        at = np.searchsorted(starts, t.offsets)
        counts = np.diff(at)
        runs: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        hashes = word_hashes(folded, starts, ends)
        text_of = np.repeat(np.arange(len(t)), counts)
        for k, (known, sieve, first_byte, last_byte, ends_of, owners) in self.windows.items():
            grams = gram_hashes(hashes, k)
            if not len(grams):
                continue
            top = (grams >> np.uint64(64 - (len(sieve).bit_length() + 2))).astype(np.int64)
            passed = (sieve[top >> 3] >> (top & 7).astype(np.uint8)) & 1
            hit = np.flatnonzero((passed == 1) & (text_of[: len(grams)] == text_of[k - 1 : k - 1 + len(grams)]))
            place = np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)
            sure = known[place] == grams[hit]
            for i, w in zip(hit[sure].tolist(), place[sure].tolist(), strict=True):
                words = b" ".join(folded[s:e].tobytes() for s, e in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist(), strict=True))
                # Different windows with one hash stand side by side.
                while w < len(known) and known[w] == grams[i] and self.text[first_byte[w] : last_byte[w]] != words:
                    w += 1
                if w < len(known) and known[w] == grams[i]:
                    d = int(text_of[i])
                    first = i - int(at[d])
                    own = runs.setdefault(d, [])
                    if own and own[-1][1] >= first >= own[-1][0]:
                        own[-1] = (own[-1][0], max(own[-1][1], first + k))
                    else:
                        own.append((first, first + k))
                    items.setdefault(d, set()).update(self.names[o] for o in owners[ends_of[w] : ends_of[w + 1]].tolist())
        return counts, runs, items, (t, starts, ends, at)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", set_bytes: int = SET_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """Add to every document its number of words, the runs of hit words and the items that occur in it.

    Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z folded. A window is ``n``
    consecutive words of an item, or the whole item where it has fewer (but some). The hash set of the
    windows is broadcast; its size is measured first, and a benchmark of more than ``set_bytes`` bytes is
    dealt over several sets, which the driver builds one after the other and which scan SETS_AT_ONCE to a pass
    over the documents; between passes the documents are written and read back, and the sets of the pass are released. No shuffle, no row left out. A hit by hash is verified on the words themselves.

    Returns the table and the names of the new columns: ``words`` (long), ``runs`` (array of first word and the
    word after the last), ``items`` (sorted ids as strings). Null and empty texts have no words. Rows
    with equal item ids count as one item with several texts; a null item id is the empty string. An empty
    benchmark hits nothing. Columns of the documents stay as they are, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = {k: fresh(docs, f"{k}__") for k in ("words", "runs", "items")}
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    slices = max(1, -(-size // set_bytes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{names['words']}` bigint, `{names['runs']}` array<array<bigint>>, `{names['items']}` array<string>"
    out = docs.withColumns({names["words"]: F.lit(0).cast("long"), names["runs"]: F.array().cast("array<array<bigint>>"), names["items"]: F.array().cast("array<string>")})
    shared: list = []
    for s in range(slices):
        part = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(slices)) == s) if slices > 1 else benchmark
        shared.append(spark.sparkContext.broadcast(GramSet([(r[0], r[1]) for r in part.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), item_text).collect()], n)))

        def scan(batches: Iterator[pa.RecordBatch], held: Broadcast = shared[-1]) -> Iterator[pa.RecordBatch]:
            grams = held.value
            for whole in batches:
                for b in blocks(whole, text_col):
                    counts, runs, items, _ = grams.scan(b.column(b.schema.get_field_index(text_col)))
                    old_runs, old_items = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                    for d, own in runs.items():
                        old_runs[d] = merged([*map(tuple, old_runs[d]), *own])
                        old_items[d] = sorted({*old_items[d], *items[d]})
                    yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(counts, pa.int64()), pa.array(old_runs, pa.list_(pa.list_(pa.int64()))), pa.array(old_items, pa.list_(pa.string()))], b.schema.names)

        out = out.mapInArrow(scan, schema)
        if (s + 1) % SETS_AT_ONCE == 0 and s + 1 < slices:
            out = stored(out, shared_folder(spark, "scanned"))
            while shared:
                shared.pop().unpersist()
    return out, names


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """Remove what the benchmark hits: whole documents, or only the spans of hit words.

    ``remove="spans"`` cuts the text from the first hit word to the end of the last word of each run and keeps the
    document. The columns are those of the input.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    scanned, names = scan_benchmark(docs, benchmark, text_col=text_col, **how)
    if remove == "documents":
        return scanned.where(F.size(names["runs"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = b.column(k).to_pylist()
            for d, runs in enumerate(b.column(b.num_columns - 2).to_pylist()):
                if runs:
                    raw = texts[d].encode()
                    starts, ends = spans_of(_ALNUM[np.frombuffer(raw, np.uint8)] > 0, np.array([0, len(raw)]))
                    kept, at = [], 0
                    for first, last in runs:
                        kept.append(raw[at : starts[first]])
                        at = ends[last - 1]
                    texts[d] = b"".join([*kept, raw[at:]]).decode()
            cols = list(b.columns)
            cols[k] = pa.array(texts, b.column(k).type)
            yield pa.RecordBatch.from_arrays(cols[:-3], b.schema.names[:-3])

    return scanned.mapInArrow(cut, schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned, names = scan_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate(names["runs"], F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return scanned.select(
        "doc_id", F.col(names["words"]).alias("n_words"), hit.alias("n_hit"), F.size(names["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names["items"], ","), 256).alias("items_sha256"), (F.size(names["runs"]) > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS MATERIALIZED (SELECT DISTINCT doc_id, k, i, item FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
