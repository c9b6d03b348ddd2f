"""Periodic run detection on words by branching tandem repeats of a suffix tree (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, blocks, fresh, small_batches, spans_of, table_of
from .pages import gather

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of text in one step; a longer text makes its own step.
STEP_BYTES = 1 << 20


class SuffixTree:
    """Suffix trees of many word sequences side by side, as arrays.

    ``names[k][i]`` is equal for two positions exactly if the 2^k words from there on are (the ranks of prefix doubling,
    which only goes on for suffixes that still have an equal). ``sa`` has the leaves in order, ``rank`` their places;
    ``lcp[p]`` is the string depth of the node that parts the leaves p - 1 and p. Sequences never share a word,
    so that every tree is a range of ``sa``.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, ends: np.ndarray):
        n = len(words)
        key = owner.astype(np.int64) << 32 | words
        self.sa = np.argsort(key, kind="stable")
        begins = np.diff(key[self.sa], prepend=-1) != 0
        self.rank = np.empty(n, np.int64)
        self.rank[self.sa] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        self.names = [np.append(self.rank, -1).astype(np.int32)]
        single = begins & np.append(begins[1:], True)
        slots, step = np.flatnonzero(~single), 1
        while len(slots):
            at = self.sa[slots]
            after = at + step
            second = np.where(after < ends[owner[at]], self.rank[np.minimum(after, n - 1)] + 1, 0)
            both = self.rank[at] * (n + 1) + second
            order = np.argsort(both, kind="stable")
            at, both = at[order], both[order]
            self.sa[slots] = at
            new = np.diff(both, prepend=-1) != 0
            self.rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.names.append(np.append(self.rank, -1).astype(np.int32))
            slots, step = slots[~(new & np.append(new[1:], True))], step * 2
        self.lcp = np.zeros(n, np.int64)
        p = np.flatnonzero(~begins)
        self.lcp[p] = self.common(self.sa[p - 1], self.sa[p])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            size += (name[a + size] == name[b + size]).astype(np.int64) << k
        return size

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words that end right before a and b (a < b)."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            i, j = a - size - (1 << k), b - size - (1 << k)
            name = self.names[k]
            size += ((i >= 0) & (name[np.maximum(i, 0)] == name[np.maximum(j, 0)])).astype(np.int64) << k
        return size

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every parting p (lcp > 0), the first and last leaf of its node: the nearest smaller depths on both sides, by doubled minima."""
        p = np.flatnonzero(self.lcp)
        if not len(p):
            return p, p, p
        depth, levels = self.lcp, [self.lcp]
        longest = int(np.diff(np.flatnonzero(np.concatenate([[True], depth == 0, [True]]))).max())
        while 1 << len(levels) <= longest:
            h = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-h], levels[-1][h:]))
        left, right, own = p.copy(), p.copy(), depth[p]
        for k in range(len(levels) - 1, -1, -1):
            least, h = levels[k], 1 << k
            i = left - h
            left = np.where((i >= 0) & (least[np.maximum(i, 0)] >= own), i, left)
            i = right + 1
            right = np.where((i < len(least)) & (least[np.minimum(i, len(least) - 1)] >= own), right + h, right)
        return p, left - 1, right


def branching(tree: SuffixTree, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Branching tandem repeats (first word, period), with a period of at most ``most`` (by leaf).

    A node of depth q parts the leaves i and i + q exactly if a square of period q is at i and the word after it does not go on.
    Only the leaves below all children but the largest are walked, looking for their partner q words on and q words back:
    a leaf lies in a smaller half at most log n times, so that n log n leaves are walked in all.
    """
    none = np.zeros(0, np.int64)
    p, left, right = tree.nodes()
    use = tree.lcp[p] <= most[tree.sa[p]] if len(p) else p.astype(bool)
    p, left, right = p[use], left[use], right[use]
    if not len(p):
        return none, none
    order = np.lexsort((p, right, left))
    p, left, right = p[order], left[order], right[order]
    head = np.diff(left, prepend=-1).astype(bool) | np.diff(right, prepend=-1).astype(bool)
    node = np.cumsum(head) - 1
    # Children of a node: from one parting to the next; the first begins at the node's first leaf.
    firsts, lasts = left[head], right[head]
    begin = np.concatenate([firsts, p])
    owner = np.concatenate([np.arange(len(firsts)), node])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.where(np.append(owner[1:] != owner[:-1], True), lasts[owner] + 1, np.append(begin[1:], 0))
    size = end - begin
    largest = np.lexsort((begin, -size, owner))[np.flatnonzero(np.diff(owner, prepend=-1))]
    small = np.ones(len(begin), bool)
    small[largest] = False
    begin, size, owner = begin[small], size[small], owner[small]
    depth = tree.lcp[p[np.flatnonzero(head)]]
    found_i, found_q = [none], [none]
    # The leaves of the smaller halves, some at a time.
    total = np.cumsum(size)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21), "right")))
        child = np.repeat(np.arange(at, to), size[at:to])
        run = np.concatenate([[0], np.cumsum(size[at:to])])
        leaf = tree.sa[np.arange(run[-1]) - np.repeat(run[:-1], size[at:to]) + begin[child]]
        q = depth[owner[child]]
        for i, other in ((leaf, leaf + q), (leaf - q, leaf - q)):
            place = np.where((other >= 0) & (other < len(tree.sa)), tree.rank[np.clip(other, 0, len(tree.sa) - 1)], -1)
            ok = (place >= firsts[owner[child]]) & (place <= lasts[owner[child]]) & ((place < begin[child]) | (place >= begin[child] + size[child]))
            found_i.append(i[ok])
            found_q.append(q[ok])
        at = to
    return np.concatenate(found_i), np.concatenate(found_q)


def find_runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the sequences ``words[offsets[d]:offsets[d + 1]]``: start (in ``words``), length and period, ordered by start and period."""
    lens = np.diff(offsets)
    owner = np.repeat(np.arange(len(lens)), lens)
    none = np.zeros(0, np.int64)
    if not len(words) or lens.max() < LEAST_WORDS:
        return none, none, none
    tree = SuffixTree(words, owner, offsets[1:])
    i, q = branching(tree, (lens // LEAST_PERIODS)[owner])
    # Rotate: a square may be moved back while the word before it equals the last of its first half; its run begins there.
    ok = (i > 0) & (words[np.maximum(i - 1, 0)] == words[np.maximum(i + q - 1, 0)])
    i, q = i[ok], q[ok]
    back = tree.common_before(i, i + q)
    start, length = i - back, back + 2 * q
    ok = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, length, q = start[ok], length[ok], q[ok]
    # Merge: squares of one run, found from either half or with a multiple of its period, have its start and end.
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.diff(start, prepend=-1).astype(bool) | np.diff(length, prepend=-1).astype(bool)
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def collapse_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed") -> DataFrame:
    """Adds to every row the periodic runs of its words and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte. ``runs`` is an array of (start, length, period) in words: every stretch
    with smallest period q and at least max(24, 3 q) words that no neighbouring word extends, by start, then period. ``collapsed``
    has the words, joined by one space, but for those that a run contains after its first period.

    Rows are worked on where they are, nothing is shuffled; a task holds a megabyte of text and its suffix trees (some 40 times
    that), or one longer text. Null and empty texts, and texts without words, have no runs and an empty collapsed text.
    Other columns, null and repeated ids pass through; a column that has a new one's name is replaced. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    runs, out = fresh(docs, "runs__"), fresh(docs, "collapsed__")
    place = docs.columns.index(text_col)
    white = table_of("white") != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, text_col, STEP_BYTES):
                t = Texts(b.column(place))
                starts, ends = spans_of(white[t.bytes], t.offsets)
                at = np.searchsorted(starts, t.offsets)
                # Words side by side without what parts them, numbered exactly.
                data, off = gather(t.bytes, np.stack([starts, ends], 1).ravel(), np.arange(len(starts)) * 2)
                number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                start, length, period = find_runs(number.astype(np.int64), at)
                doc = np.searchsorted(at, start, "right") - 1
                parts = [start - at[doc], length, period]
                dropped = np.zeros(len(starts) + 1, np.int64)
                np.add.at(dropped, start + period, 1)
                np.add.at(dropped, start + length, -1)
                kept = np.cumsum(dropped)[:-1] == 0
                # The kept words with one space after each but the last of a text.
                own = np.flatnonzero(kept)
                words, edge = gather(data, off, own)
                text_of = np.searchsorted(at, own, "right") - 1
                last = np.append(text_of[1:] != text_of[:-1], True) if len(own) else np.zeros(0, bool)
                room = np.diff(edge) + ~last
                to = np.concatenate([[0], np.cumsum(room)])
                joined = np.full(int(to[-1]), 32, np.uint8)
                joined[np.arange(edge[-1]) + np.repeat(to[:-1] - edge[:-1], np.diff(edge))] = words
                bounds = to[np.searchsorted(own, at)]
                text = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined)).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, text], [*b.schema.names, runs, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = docs.mapInArrow(run, f"{fields}, `{runs}` array<struct<start: long, length: long, period: long>>, `{out}` string")
    return found.drop(*[c for c in docs.columns if c.lower() in (runs_col.lower(), out_col.lower())]).withColumnsRenamed({runs: runs_col, out: out_col})


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of ties (runs come by start, then period)."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.reduce(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def planted(docs: DataFrame) -> DataFrame:
    """One document in ten (crc32 of its id) repeats a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), (F.floor((n - a) / p) + 1).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n), " ")

    long = F.when((h % 10 == 0) & (F.size(words) > 0), repeat(words)).otherwise(F.col("text"))
    return docs.select("doc_id", long.alias("text"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("text")
    best = found.withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
