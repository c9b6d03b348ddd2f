"""Personal data: fixed patterns and a linear-chain conditional random field over word shapes (operator 4)."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, blocks, fresh, small_batches, spans_of, table_of

KINDS = ("email", "ip", "card", "phone")
#: What only the field finds, beside the four kinds: an assigned key or token of an account.
ADDED = ("secret",)
TAGS = ("O", *KINDS, *ADDED)

# -- fixed patterns --------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_KEY = re.compile(r"[A-Za-z0-9+/_-]{16,}")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    d = _digits(text)
    if kind == "secret":
        return _KEY.fullmatch(text) is not None and 0 < len(d) < sum(c.isalnum() for c in text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at every @, the whole run of local characters before it, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns: leftmost non-overlapping matches of each kind, then the failing ones dropped."""
    out = [("email", s, e) for s, e in emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# -- word shapes -----------------------------------------------------------------------------------

_WHITE = table_of("white")
_FLAGS = np.full(256, 32, np.uint8)  # 1 letter, 2 @, 4 hyphen, 8 parenthesis, 16 plus, 64 equals sign or colon, 32 other
_FLAGS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_FLAGS[list(range(48, 58)) + [9, 10, 11, 12, 13, 32, 46]] = 0
_FLAGS[64], _FLAGS[45], _FLAGS[[40, 41]], _FLAGS[43], _FLAGS[[58, 61]] = 2, 4, 8, 16, 64
_COUNTS = np.zeros(256, np.uint64)  # digits, and dots above bit 32
_COUNTS[48:58] = 1
_COUNTS[46] = 1 << 32
#: Buckets of the number of digits: 0, 1-2, 3, 4-6, 7, 8-9, 10-11, 12, 13-19, more.
_DIGITS = np.array([1, 3, 4, 7, 8, 10, 12, 13, 20])
#: Buckets of the changes between letter and digit: 0-1, 2-3, 4-7, more.
_CHANGES = np.array([2, 4, 8])
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit; neighbours of both kinds sum to 3
_CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[48:58] = 2
N_SHAPES = 10 * 5 * 128 * 4
EDGE = N_SHAPES  # the shape beyond the ends of a line


def shapes(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each word: buckets of its digits, its dots and its changes between letter and digit, and which other characters it has."""
    if not len(starts):
        return np.zeros(0, np.int64)
    flags = np.bitwise_or.reduceat(_FLAGS[b], starts).astype(np.int64)
    counts = np.add.reduceat(_COUNTS[b], starts)
    digits = np.searchsorted(_DIGITS, (counts & np.uint64(0xFFFFFFFF)).astype(np.int64), "right")
    dots = np.minimum((counts >> np.uint64(32)).astype(np.int64), 4)
    change = np.zeros(len(b), np.uint8)
    change[1:] = _CLASS[b[1:]] + _CLASS[b[:-1]] == 3
    changes = np.searchsorted(_CHANGES, np.add.reduceat(change, starts, dtype=np.int64), "right")
    return ((digits * 5 + dots) * 128 + flags) * 4 + changes


def _features(shape: int) -> list[int]:
    """Indicator features of a shape: its digits, its dots, each kind of character, its changes (the whole shape is one more)."""
    if shape == EDGE:
        return [0]
    flags, rest = shape // 4 % 128, shape // 512
    return [1 + rest // 5, 11 + rest % 5, *(16 + k for k in range(7) if flags >> k & 1), 23 + shape % 4]


N_PARTS = 27


def _parts_of(shapes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(shapes), N_PARTS), np.float32)
    for i, s in enumerate(shapes.tolist()):
        out[i, _features(s)] = 1
    return out


# -- the field -------------------------------------------------------------------------------------


def labelled_table(seed: int = 7, rows: int = 600) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: lines of words with the tag of each word, made by rule from a seed.

    Positive lines hold e-mail addresses, IP addresses, card and phone numbers in international and local
    writing, and assigned keys (``name = "value"``, ``name: value``, ``name=value``; values in hexadecimal digits or
    in mixed letters and digits); negative ones hold dates, times, prices, versions, amounts, codes, bare
    digests, file names, short quoted words and plain words.
    """
    rng = random.Random(seed)
    pick, digit = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(pick(letters) for _ in range(rng.randint(1, 12))) + pick(["", "", "", ",", ".", "!!", "###", "%%%"])
    part = lambda: str(rng.randint(0, 255))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice(letters + letters.upper() + "0123456789" * 3) for _ in range(n))
    value = lambda: pick([hexa(32), hexa(40), hexa(64), mixed(rng.randint(16, 40)), pick(["sk", "pk", "AK"]) + pick("-_") + mixed(24)])
    name = lambda: pick(["key", "secret", "password", "access", "credential", "auth", "api_key"])
    quoted = lambda x: pick(['"', "'"]).join(["", x, ""])
    positive = (
        lambda: ([f"{word().strip('.,!#%') or 'a'}.{digit(2)}@mail{digit(1)}.example.com"], "email"),
        lambda: ([f"{pick(letters)}{digit(1)}@{word().strip('.,!#%') or 'b'}.org"], "email"),
        lambda: ([f"{part()}.{part()}.{part()}.{part()}"], "ip"),
        lambda: ([digit(16)], "card"),
        lambda: ([digit(4) for _ in range(4)], "card"),
        lambda: (["-".join(digit(4) for _ in range(4))], "card"),
        lambda: (["+1", f"({digit(3)})", f"{digit(3)}-{digit(4)}"], "phone"),
        lambda: ([f"({digit(3)})", f"{digit(3)}-{digit(4)}"], "phone"),
        lambda: ([f"+{digit(2)}", digit(3), digit(7)], "phone"),
        lambda: ([f"{digit(3)}-{digit(3)}-{digit(4)}"], "phone"),
        lambda: ([name(), "=", quoted(value())], "secret"),
        lambda: ([name() + ":", value()], "secret"),
        lambda: ([name() + pick("=:") + pick([value(), quoted(value())])], "secret"),
    )
    negative = (
        lambda: f"{digit(4)}-{digit(2)}-{digit(2)}", lambda: f"{digit(2)}:{digit(2)}", lambda: f"${digit(2)}.{digit(2)}", lambda: f"{digit(1)}.{digit(1)}.{digit(1)}",
        lambda: digit(rng.randint(1, 9)), lambda: quoted(word().strip(".,!#%") + digit(2)), lambda: hexa(40), lambda: hexa(7), lambda: f"{word().strip('.,!#%')}{digit(4)}_{digit(1)}.jpg", lambda: f"{digit(4)}-{digit(2)}-{digit(2)}T{digit(2)}:{digit(2)}:{digit(2)}Z", lambda: quoted(word().strip(".,!#%")), lambda: f"({digit(1)})", lambda: f"{digit(2)}%", lambda: f"{digit(1)},{digit(3)},{digit(3)}",
        lambda: f"{word()}-{digit(2)}", lambda: f"#{digit(10)}", lambda: "=", lambda: f"@{word()}", lambda: "...", lambda: f"v{digit(1)}.{digit(2)}", lambda: "(see", lambda: digit(24), lambda: "+", lambda: "-",
    )
    out = []
    for k in range(rows):
        words, tags = [], []
        for _ in range(rng.randint(2, 5)):
            for _ in range(rng.randint(0, 4)):
                words.append(word())
                tags.append("O")
            if k % 4 and rng.random() < 0.5:
                own, kind = pick(positive)()
                if kind == "secret" and rng.random() < 0.3:  # keys also stand in a row
                    words.append(name() + pick("=:") + value())
                    tags.append(kind)
                if rng.random() < 0.3:
                    own[-1] += pick([".", ",", "%%%"])
                words += own
                # Of an assigned key only the word with the value is marked.
                tags += ["O"] * (len(own) - 1) + [kind] if kind == "secret" else [kind] * len(own)
            elif rng.random() < 0.7:
                words.append(pick(negative)())
                tags.append("O")
            words.append(word())
            tags.append("O")
        out.append((words, tags))
    return out


def _shape_of(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    b = np.frombuffer(raw, np.uint8)
    starts, _ = spans_of(_WHITE[b] > 0, np.array([0, len(b)]))
    return shapes(b, starts)


class Field:
    """Weights by shape for the word itself and its neighbours, and weights between tags."""

    def __init__(self, here: np.ndarray, before: np.ndarray, after: np.ndarray, trans: np.ndarray):
        self.here, self.before, self.after, self.trans = here, before, after, trans
        # Where the tag O leads by more than all transitions of a line can change, the best path is O throughout.
        lead = [(t[:, :1] - t[:, 1:]).min(axis=1) for t in (here, before, after)]
        self.lead, self.most = lead, float(2 * (trans.max() - trans.min()))

    def score(self, shape: np.ndarray, prev: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        return self.here[shape] + self.before[prev] + self.after[nxt]


def train(table: list[tuple[list[str], list[str]]], epochs: int = 120, rate: float = 0.4, ridge: float = 1e-3) -> Field:
    """Maximise the penalised conditional log-likelihood by full-batch Adagrad; forward-backward on a padded batch."""
    k = len(TAGS)
    lines = [(_shape_of(w), np.array([TAGS.index(t) for t in tags])) for w, tags in table]
    n, m = len(lines), max(len(s) for s, _ in lines)
    shape, tag, mask = np.full((n, m + 2), EDGE), np.zeros((n, m), int), np.zeros((n, m), bool)
    for i, (s, t) in enumerate(lines):
        shape[i, 1 : len(s) + 1], tag[i, : len(t)], mask[i, : len(t)] = s, t, True
    used = np.unique(shape)
    dense = np.hstack([_parts_of(used), np.eye(len(used), dtype=np.float32)])
    index = np.searchsorted(used, shape)
    weights, trans = [np.zeros((dense.shape[1], k)) for _ in range(3)], np.zeros((k, k))
    sums = [np.full_like(w, 1e-6) for w in weights], np.full_like(trans, 1e-6)
    gold = np.eye(k)[tag] * mask[..., None]
    pair_mask = mask[:, 1:]
    for _ in range(epochs):
        tables = [dense @ w for w in weights]
        e = tables[0][index[:, 1:-1]] + tables[1][index[:, :-2]] + tables[2][index[:, 2:]]
        alpha, beta = np.zeros((n, m, k)), np.zeros((n, m, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, m):
            x = alpha[:, t - 1, :, None] + trans
            top = x.max(axis=1, keepdims=True)
            step = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0] + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(m - 2, -1, -1):
            x = trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = x.max(axis=2, keepdims=True)
            beta[:, t] = np.where(mask[:, t + 1, None], np.log(np.exp(x - top).sum(axis=2)) + top[..., 0], 0)
        z = alpha[:, -1].max(axis=1, keepdims=True)
        z = np.log(np.exp(alpha[:, -1] - z).sum(axis=1)) + z[:, 0]
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        q = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_mask[..., None, None]
        g_trans = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1)) - q.sum((0, 1)) - ridge * trans
        diff = (gold - p).reshape(-1, k)
        for w, s, at in zip(weights, sums[0], (index[:, 1:-1], index[:, :-2], index[:, 2:]), strict=True):
            by = np.zeros((len(used), k))
            np.add.at(by, at.reshape(-1), diff)
            g = dense.T @ by - ridge * w
            s += g * g
            w += rate * g / np.sqrt(s)
        sums[1][...] += g_trans * g_trans
        trans += rate * g_trans / np.sqrt(sums[1])
    every = _parts_of(np.arange(N_SHAPES + 1))

    def by_shape(w: np.ndarray) -> np.ndarray:
        """A weight for every shape; one that no line has goes by its parts alone."""
        out = every @ w[:N_PARTS]
        out[used] += w[N_PARTS:]
        return out.astype(np.float32)

    return Field(*map(by_shape, weights), trans.astype(np.float32))


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def viterbi(field: Field, shape: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The best tags of all lines (``first`` word and number of words of each), many lines side by side."""
    n = len(shape)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    prev, nxt = np.empty(n, np.int64), np.empty(n, np.int64)
    prev[1:], nxt[:-1] = shape[:-1], shape[1:]
    prev[first], nxt[first + count - 1] = EDGE, EDGE
    margin = field.lead[0][shape] + field.lead[1][prev] + field.lead[2][nxt]
    open_ = np.minimum.reduceat(margin, first) <= field.most
    first, count = first[open_], count[open_]
    order = np.argsort(count, kind="stable")
    k = len(TAGS)
    at = 0
    while at < len(order):
        most = max(1, min(2048, (1 << 21) // max(1, int(count[order[min(at + 2047, len(order) - 1)]]))))
        rows = order[at : at + most]
        at += most
        m, f, c = int(count[rows].max()), first[rows], count[rows]
        back = np.zeros((m, len(rows), k), np.int8)
        i = f
        best = field.score(shape[i], prev[i], nxt[i])
        for t in range(1, m):
            live = t < c
            i = np.where(live, f + t, f)
            x = best[:, :, None] + field.trans
            back[t] = x.argmax(axis=1)
            best = np.where(live[:, None], x.max(axis=1) + field.score(shape[i], prev[i], nxt[i]), best)
        now = best.argmax(axis=1)
        each = np.arange(len(rows))
        for t in range(m - 1, -1, -1):
            live = t < c
            tags[(f + t)[live]] = now[live]
            now = np.where(live, back[t, each, now], now)
    return tags


_TRIM = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9])?", re.S)


def find_in(column: pa.Array, field: Field) -> list[list[dict]]:
    """All spans of the texts: the fixed ones, and those of the field that are valid and touch no fixed one."""
    t = Texts(column)
    b = t.bytes
    starts, ends = spans_of(_WHITE[b] > 0, t.offsets)
    shape = shapes(b, starts)
    out: list[list[dict]] = [[] for _ in range(len(t))]
    if not len(starts):
        return out
    # Lines: words without a line feed or the end of a text between them.
    feeds = np.flatnonzero(b == 10)
    gap = np.searchsorted(feeds, starts)
    of = np.searchsorted(t.offsets, starts, "right") - 1
    first = np.flatnonzero(np.diff(gap, prepend=-1) | np.diff(of, prepend=-1))
    tags = viterbi(field, shape, first, np.diff(np.append(first, len(shape))))
    cue = (shape >= 5 * 512) | (shape // 4 % 128 & 2 > 0)  # a digit or an @
    line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(shape))))
    for d in np.unique(of[cue | (tags > 0)]).tolist():
        raw = b[t.offsets[d] : t.offsets[d + 1]].tobytes()
        text = raw.decode()
        found = [(k, s, e, True) for k, s, e in base_spans(text)]
        lo, hi = np.searchsorted(of, [d, d + 1])
        own = np.flatnonzero(tags[lo:hi]) + lo
        if len(own):
            run = np.flatnonzero((np.diff(own, prepend=-2) != 1) | (np.diff(tags[own], prepend=-1) != 0) | (np.diff(line[own], prepend=-1) != 0) | (tags[own] > len(KINDS)))
            for a, z in zip(run, np.append(run[1:], len(own)), strict=True):
                s = len(raw[: starts[own[a]] - t.offsets[d]].decode())
                e = s + len(raw[starts[own[a]] - t.offsets[d] : ends[own[z - 1]] - t.offsets[d]].decode())
                kind = TAGS[tags[own[a]]]
                m = max(_KEY.finditer(text, s, e), key=lambda x: x.end() - x.start(), default=None) if kind == "secret" else _TRIM.search(text, s, e)
                if m and valid(kind, m[0]) and (kind != "email" or "@" in m[0]) and (kind != "ip" or _IP.fullmatch(m[0])) and not any(x < m.end() and m.start() < y for _, x, y, _ in found):
                    found.append((kind, m.start(), m.end(), False))
        out[d] = [{"kind": k, "start": s, "end": e, "fixed": f} for k, s, e, f in sorted(found, key=lambda x: (TAGS.index(x[0]), x[1]))]
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,fixed:boolean>>"


def find_pii(docs: DataFrame, text_col: str = "text", span_col: str = "spans", labelled: list | None = None) -> DataFrame:
    """Add the spans of personal data in every whole text: kind, start, end (code points, end exclusive), fixed.

    ``fixed`` spans come from the patterns of e-mail addresses, IP addresses, card and phone numbers. The
    conditional random field (word shapes of a word and its neighbours, one chain for each line, decoded
    by Viterbi over many lines at once) adds spans such as phone numbers in local writing and the kind ``secret``: keys and
    tokens that a name is given (at least 16 letters and digits, both present; the longest such run of each tagged word).
    What it adds has passed the check of its kind and overlaps no fixed span. Sorted by kind in the order of ``KINDS``
    and ``ADDED``, then start.

    The field is trained on a small labelled table (``labelled``: words and tags of some lines; by default
    ``labelled_table()``, 600 lines) on the driver. Null and empty texts have no spans, an empty table gives one with the same columns, repeated rows
    stay repeated, each with its spans; equal scores of two tag paths go to the earlier tag. Columns stay, but one named
    ``span_col`` is replaced. Of a very long text the whole is read; memory grows with the longest text.
    """
    small_batches(docs.sparkSession)
    field = train(labelled) if labelled else default_field()
    keep = [c for c in docs.columns if c.lower() != span_col.lower()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema) + f", `{span_col}` {SPAN_DDL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, text_col):
                spans = find_in(b.column(b.schema.get_field_index(text_col)), field)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _SPAN)], [*b.schema.names, span_col])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents with every found span replaced by its kind in angle brackets; overlapping spans go as one."""
    spans = fresh(docs, "spans__")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = b.column(k).to_pylist()
            for d, found in enumerate(b.column(b.num_columns - 1).to_pylist()):
                out, at = [], 0
                for s in sorted(found, key=lambda x: (x["start"], -x["end"])):
                    if s["start"] >= at:
                        out += [texts[d][at : s["start"]], f"<{s['kind']}>"]
                    at = max(at, s["end"])
                texts[d] = "".join([*out, texts[d][at:]]) if found else texts[d]
            cols = list(b.columns[:-1])
            cols[k] = pa.array(texts, b.column(k).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return find_pii(docs, text_col, spans, **how).mapInArrow(run, schema)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    fixed = F.filter("spans", lambda s: s["fixed"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["fixed"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(fixed), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["fixed"])).cast("long").alias("n_added"))
