"""Alignment of two tokenizers over the same text, with corpus-wide counts of linked ids (operator 11)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, fresh, shared_folder, small_batches
from .pages import coded, flat, gather, paged, squeezed, squeezed_codes, unsqueezed, unsqueezed_codes

#: Segments in one call of a library.
AT_ONCE = 4096
MARK = "▁"


class Tokens:
    """Token bytes of a vocabulary as one array, and the ids of segments."""

    def _table(self, table: list[bytes]) -> None:
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in table])]).astype(np.int64)

    def encode(self, segments: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after the other, and the offsets of the segments in them."""
        lens, ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(segments), AT_ONCE):
            got = self._ids(segments.slice(at, AT_ONCE).cast(pa.large_string()).to_pylist())
            lens.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((x for y in got for x in y), np.int64, int(lens[-1].sum())))
        return np.concatenate(ids), np.cumsum(np.concatenate(lens))


class ByteLevel(Tokens):
    """A byte-level BPE of the tokenizers library; strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # A byte is written as its own character if that is visible, else as the next one from 256 on.
        seen = [k for k in range(256) if 33 <= k < 127 or 161 <= k < 173 or k >= 174]
        char = {chr(k): k for k in seen} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in seen)}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(entries.values(), default=-1) + 1)
        for word, k in entries.items():
            table[k] = bytes(char[c] for c in word) if all(c in char for c in word) else word.encode()
        self._table(table)

    def _ids(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


class Pieces(Tokens):
    """A sentencepiece model that puts a space before every text: it is given the segments without their first space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        #: Whether some piece goes on over a space, so that texts cannot be cut there.
        self.crosses = any(MARK in p.lstrip(MARK) for p in pieces)
        self._table([bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)])

    def _ids(self, segments: list[str]) -> list[list[int]]:
        return self.model.encode([s[1:] for s in segments], num_threads=1)


_models: dict[str, Tokens] = {}


def _model(kind: type, path: str) -> Tokens:
    if path not in _models:
        _models[path] = kind(path)
    return _models[path]


def segment_starts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where tokens of both kinds surely end: before a space, after a visible character, not at a text's last place."""
    if not len(b):
        return np.zeros(0, np.int64)
    flag = np.zeros(len(b), bool)
    ascii_seen = (b > 32) & (b < 127)
    high = b >= 128
    high[1:] &= ~np.isin(b[:-1], (0x80, 0x81, 0x9A, 0xC2))  # the last two bytes of every white space beyond ASCII
    flag[1:] = (ascii_seen | high)[:-1] & (b[1:] == 32)
    inner = offsets[1:] - 1
    flag[inner[inner >= 0]] = False
    flag[offsets[:-1][offsets[:-1] < len(b)]] = True
    return np.flatnonzero(flag)


def _sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(x)])[edges])


class Alignment:
    """The alignment of a page: of each of its distinct segments, and which segments its texts have.

    A text is a space and its characters, cut into segments where neither tokenizer's tokens go across; so the tokens,
    groups and links of a text are those of its segments, one after the other. Segments whose tokens do not give their bytes
    again have none, and ``whole`` is false for texts with such a segment.
    """

    def __init__(self, steps: list[pa.RecordBatch], place: int, a: ByteLevel, b: Pieces):
        parts, lens = [], []
        for s in steps:
            text = s.column(place).cast(pa.large_string()).fill_null("")
            spaced = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
            t = Texts(spaced)
            starts = np.unique(t.offsets[:-1][t.offsets[:-1] < len(t.bytes)]) if b.crosses else segment_starts(t.bytes, t.offsets)
            parts.append((t.bytes, starts))
            lens.append(np.diff(np.searchsorted(starts, t.offsets)))
        words, self.codes = coded(parts)
        self.lens = np.concatenate(lens)
        self.edges = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        data, off = flat(words)
        sides = [side.encode(words) for side in (a, b)]
        ok = np.ones(len(words), bool)
        for side, (ids, at) in zip((a, b), sides, strict=True):
            got, run = gather(side.bytes, side.offsets, ids)
            same = np.diff(run[at]) == np.diff(off)
            # Where a segment's length agrees, its bytes are compared.
            mine, _ = gather(data, off, np.flatnonzero(same))
            theirs, edge = gather(got, run[at], np.flatnonzero(same))
            wrong = np.concatenate([[0], np.cumsum(mine != theirs)])
            same[same] = np.diff(wrong[edge]) == 0
            ok &= same
        self.ok = ok
        use = [gather(ids, at, np.flatnonzero(ok)) for ids, at in sides]
        self.offsets = []
        for _, at in sides:
            size = np.where(ok, np.diff(at), 0)
            self.offsets.append(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        self.a, self.b = use[0][0], use[1][0]
        a_end, b_end = np.cumsum(np.diff(a.offsets)[self.a]), np.cumsum(np.diff(b.offsets)[self.b])
        a_start, b_start = a_end - np.diff(a.offsets)[self.a], b_end - np.diff(b.offsets)[self.b]
        # The ends and starts of the B tokens are the static index; each A token stabs it twice by bisection.
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        count = high - low
        self.link_a = np.repeat(np.arange(len(self.a)), count)
        self.link_b = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        self.link_offsets = np.concatenate([[0], np.cumsum(count)])[self.offsets[0]]
        # A gap that no token of either kind spans ends a group.
        at = np.searchsorted(b_end, a_end)
        closes = b_end[np.minimum(at, max(len(b_end) - 1, 0))] == a_end if len(b_end) else np.zeros(len(a_end), bool)
        self.group_a, self.group_b = np.flatnonzero(closes), at[closes]
        self.group_offsets = np.searchsorted(self.group_a, self.offsets[0])
        self.whole = _sums(~ok[self.codes], self.edges) == 0

    def per_text(self, offsets: np.ndarray) -> np.ndarray:
        """Sums over the segments of every text of the lengths of lists; 0 for texts that are not whole."""
        return np.where(self.whole, _sums(np.diff(offsets)[self.codes], self.edges), 0)

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's groups as bytes ``a1,a2|b1;``, and the offsets of the segments in them."""
        most = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1
        table = [f"{k}{c}".encode() for c in ",|;" for k in range(most)]
        size = np.concatenate([[0], np.cumsum([len(x) for x in table])]).astype(np.int64)
        a_kind, b_kind = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_kind[self.group_a], b_kind[self.group_b] = 1, 2
        # A group's A tokens come after the B tokens of all groups before it, its B tokens after its own A tokens.
        own_a, own_b = np.searchsorted(self.group_a, np.arange(len(self.a))), np.searchsorted(self.group_b, np.arange(len(self.b)))
        before = np.concatenate([[0], self.group_b + 1])
        which = np.empty(len(self.a) + len(self.b), np.int64)
        which[np.arange(len(self.a)) + before[own_a]] = self.a + most * a_kind
        which[np.arange(len(self.b)) + self.group_a[own_b] + 1 if len(self.b) else []] = self.b + most * b_kind
        data, run = gather(np.frombuffer(b"".join(table), np.uint8), size, which)
        return data, run[self.offsets[0] + self.offsets[1]]

    def spelled_digests(self) -> list[str]:
        """The digest of every text's groups; an empty string for texts without tokens."""
        data, off = self.spelled()
        out, at = [], 0
        while at < len(self.lens):
            to = max(at + 1, int(np.searchsorted(self.edges, self.edges[at] + (1 << 17), "right")) - 1)
            got, run = gather(data, off, self.codes[self.edges[at] : self.edges[to]])
            raw, edge = got.tobytes(), run[self.edges[at : to + 1] - self.edges[at]]
            out += [hashlib.sha256(raw[x : y - 1]).hexdigest() if good and y > x else "" for x, y, good in zip(edge[:-1].tolist(), edge[1:].tolist(), self.whole[at:to].tolist(), strict=True)]
            at = to
        return out


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Adds to every row the ids of both tokenizers and how they align: ``a_ids``, ``b_ids``, ``a_ends``, ``b_ends`` (ends of the groups, in tokens).

    Links follow from the groups' tokens and their bytes. Nothing is shuffled. Null and empty texts, and texts that a tokenizer does not give back byte
    by byte, have empty arrays. Other columns pass through, those with the name of a new one are replaced; repeated rows and an empty table need no care.
    """
    small_batches(docs.sparkSession)
    new = ("a_ids", "b_ids", "a_ends", "b_ends")
    names = [fresh(docs, f"{c}__") for c in new]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _model(ByteLevel, a_path), _model(Pieces, b_path)
        for _, steps in paged(batches, text_col):
            found = Alignment(steps, place, a, b)
            at = 0
            for s in steps:
                edges = found.edges[at : at + s.num_rows + 1]
                codes = found.codes[edges[0] : edges[-1]].copy()
                good = np.repeat(found.whole[at : at + s.num_rows], np.diff(edges))
                codes, edges = codes[good], np.concatenate([[0], np.cumsum(np.where(found.whole[at : at + s.num_rows], np.diff(edges), 0))])
                cols = []
                base = []
                for values, offsets in ((found.a, found.offsets[0]), (found.b, found.offsets[1])):
                    got, off = gather(values, offsets, codes)
                    cols.append(_lists(got, off[edges]))
                    base.append(off)
                for side, ends in ((0, found.group_a), (1, found.group_b)):
                    got, off = gather(ends, found.group_offsets, codes)
                    # From places among the page's distinct segments to places in the text.
                    shift = base[side][:-1] - found.offsets[side][codes] - base[side][edges[:-1]].repeat(np.diff(edges))
                    cols.append(_lists(got + 1 + np.repeat(shift, np.diff(off)), off[edges]))
                yield pa.RecordBatch.from_arrays([*s.columns, *cols], [*s.schema.names, *names])
                at += s.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = docs.mapInArrow(run, f"{fields}, " + ", ".join(f"`{c}` array<int>" for c in names))
    return found.drop(*[c for c in docs.columns if c.lower() in new]).withColumnsRenamed(dict(zip(names, new, strict=True)))


def linked_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of every row and how frequent its links are in the whole corpus.

    Returns the id column (as it is), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``), ``count_sum`` (corpus-wide counts of the id
    pairs of its links, summed) and ``n_best`` (links whose pair has the highest count of its B id, ties included).

    One pass tokenises and aligns: every page of documents encodes each of its distinct segments once and is written to the
    shared folder with the numbers of its segments, their links, and its distinct id pairs with counts. The pairs are summed by a
    grouped aggregate, a window by B id (at most one row for each A id) finds the highest, and a join brings both back to the
    pages, where they are summed up. A frequent pair costs one row a page, so no key is hot. A task holds one page (8 MB of text,
    or a single longer one). Null and empty texts, and texts that a tokenizer does not give back byte by byte, have zeros and an empty
    ``groups_sha256`` and count nowhere. Ids may be null, repeated and of any type; every row gives one row, other columns are ignored.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    stage = shared_folder(spark, "token-links")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _model(ByteLevel, a_path), _model(Pieces, b_path)
        for page, steps in paged(batches, "text"):
            found = Alignment(steps, 1, a, b)
            lens = np.where(found.whole, found.lens, 0)
            codes = found.codes[np.repeat(found.whole, found.lens)]
            seen = np.bincount(codes, minlength=len(found.ok))
            order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
            place = np.zeros(len(seen), np.int64)
            place[order] = np.arange(len(order))
            pair = found.a[found.link_a] << 32 | found.b[found.link_b]
            links, edge = gather(pair, found.link_offsets, order)
            pairs, which = np.unique(links, return_inverse=True)
            n = np.bincount(which, weights=np.repeat(seen[order], np.diff(edge)), minlength=len(pairs)).astype(np.int64)
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t) if not isinstance(x, pa.Array) else x)
            cols = [pa.array([page], pa.int64()), one(pa.concat_arrays([s.column(0) for s in steps]), None)]
            cols += [one(found.per_text(o), pa.int64()) for o in (*found.offsets, found.group_offsets, found.link_offsets)]
            cols += [one(found.spelled_digests(), pa.string()), *(pa.array([x], pa.binary()) for x in (squeezed_codes(place[codes]), squeezed(lens), squeezed(which.astype("<u4")), squeezed(np.diff(edge).astype("<u4"))))]
            cols += [one(pairs, pa.int64()), one(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["page", "names", "n_a", "n_b", "n_groups", "n_links", "digests", "codes", "lens", "links", "link_lens", "pairs", "n"]
    schema = f"page long, names array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, codes binary, lens binary, links binary, link_lens binary, pairs array<long>, n array<long>"
    docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).mapInArrow(scan, schema).write.parquet(stage)
    staged = spark.read.schema(schema).parquet(stage)
    pages = spark.read.schema(schema).parquet(stage).select(*names[:11])

    low = F.col("pair").bitwiseAND(0xFFFFFFFF)
    met = staged.select("page", F.posexplode(F.arrays_zip("pairs", "n")).alias("place", "p")).select("page", "place", F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    counts = met.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(low)))
    back = met.select("page", "place", "pair").join(counts, "pair").select("page", "place", "count", "best")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("codes", "lens", "links", "link_lens")}
        codes, edges = unsqueezed_codes(row["codes"]), np.concatenate([[0], np.cumsum(unsqueezed(row["lens"], np.int64))])
        links, link_edges = unsqueezed(row["links"], "<u4"), np.concatenate([[0], np.cumsum(unsqueezed(row["link_lens"], "<u4").astype(np.int64))])
        place = right.column("place").to_numpy()
        cols = [left.column(c).combine_chunks().flatten() for c in names[1:7]]
        for c in ("count", "best"):
            value = np.zeros(len(place), np.int64)
            value[place] = right.column(c).cast(pa.int64()).to_numpy()
            cols.append(pa.array(_sums(_sums(value[links], link_edges)[codes], edges), pa.int64()))
        return pa.table(cols, ["name", *names[2:7], "count_sum", "n_best"])

    out = f"name {kind}, n_a long, n_b long, n_groups long, n_links long, digests string, count_sum long, n_best long"
    found = pages.groupBy("page").cogroup(back.groupBy("page")).applyInArrow(total, out)
    return found.select(F.col("name").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digests").alias("groups_sha256"))


def default_pair() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_pair())
