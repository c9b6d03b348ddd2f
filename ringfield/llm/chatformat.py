"""Chat formatting in budgeted, turn-aligned windows (operator 5)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

#: The control strings of the template: a new turn, a repeated turn, the end of its role, the end of the turn.
TURN, SEEN, TEXT, END = "<|turn|>", "<|seen|>", "<|text|>", "<|end|>"

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = re.compile(r"<\|(turn|seen)\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """No control string can stand in the result, and ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def count_words(texts: list[str]) -> list[int]:
    return [sum(1 for _ in _WORD.finditer(t)) + 2 for t in texts]


class Windows:
    """The windows of one conversation, turn by turn; it holds the open window and the history that may be repeated."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str]] = []  # from the first turn that may still be repeated
        self.sums = [0]  # prefix sums of the tokens of self.turns
        self.fresh = 0  # turns before this one have been in a window
        self.number, self.at = 0, 0  # windows given out, turns read

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        if self.at == 0 and role == "system":
            self.system = (role, text, tokens)
        else:
            base = self.system[2] if self.system else 0
            first = bisect_left(self.sums, self.sums[self.fresh] - self.history, 0, self.fresh + 1) if self.number else self.fresh
            if len(self.turns) > self.fresh and base + self.sums[-1] + tokens - self.sums[first] > self.budget:
                yield self.close()
            self.turns.append((role, text))
            self.sums.append(self.sums[-1] + tokens)
        self.at += 1

    def close(self) -> dict:
        """The window with all fresh turns; afterwards they are history."""
        first = bisect_left(self.sums, self.sums[self.fresh] - self.history, 0, self.fresh + 1) if self.number else self.fresh
        parts, spans, size = [], [], 0

        def put(mark: str, role: str, text: str, learn: bool) -> None:
            nonlocal size
            head, body = f"{mark}{escape(role)}{TEXT}", escape(text)
            parts.append(f"{head}{body}{END}")
            if learn:
                spans.append((size + len(head), size + len(head) + len(body)))
            size += len(parts[-1])

        if self.system:
            put(TURN if self.number == 0 else SEEN, self.system[0], self.system[1], False)
        for k in range(first, len(self.turns)):
            role, text = self.turns[k]
            put(SEEN if k < self.fresh else TURN, role, text, k >= self.fresh and role == "assistant")
        out = {"window": self.number, "text": "".join(parts), "loss": spans}
        self.number += 1
        # Only what the next window can repeat stays in memory.
        drop = bisect_left(self.sums, self.sums[-1] - self.history)
        self.turns, self.sums = self.turns[drop:], [s - self.sums[drop] for s in self.sums[drop:]]
        self.fresh = len(self.turns)
        return out

    def rest(self) -> Iterator[dict]:
        if len(self.turns) > self.fresh or (self.system and self.number == 0):
            yield self.close()


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.list_(pa.int64())))])


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, count: Callable[[list[str]], list[int]] = count_words, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format conversations as training texts of about ``budget`` tokens with a loss mask.

    Prefix sums of the turns' tokens choose the spans: a window takes fresh turns while the system turn, the
    repeated history and the fresh turns fit; a single larger turn makes a window of its own, whole. Every later
    window repeats the system turn and the latest turns of at most ``history`` tokens, marked as seen. The loss
    covers the texts of fresh assistant turns only, so each is learnt exactly once. Control strings inside
    roles and texts are escaped reversibly.

    Returns ``conv_id``, ``window`` (0, 1, ...), ``text`` and ``loss`` (spans of code points, end exclusive), one
    row for each window. Rows are dealt out by conversation and sorted by turn; a task streams through its
    rows and holds one open window, however long a conversation is. Null texts and roles are empty; null turns come
    first; rows with equal turn are ordered by role and text, and repeated rows are turns of their own; a null
    conversation id is one conversation. An empty table gives no windows. ``count`` gives the tokens of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, begun, out, held = None, None, False, [], 0
        for b in batches:
            ids, roles, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for conv, role, text, tokens in zip(ids, roles, texts, count(texts), strict=True):
                if not begun or conv != now:
                    if begun:
                        out += [{"conv_id": now, **w} for w in windows.rest()]
                    now, windows, begun = conv, Windows(budget, history), True
                new = [{"conv_id": now, **w} for w in windows.add(role, text, tokens)]
                held += sum(len(w["text"]) for w in new)
                out += new
                if held > 1 << 22 or len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out, held = [], 0
        if begun:
            out += [{"conv_id": now, **w} for w in windows.rest()]
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(turn_col).alias("turn")
    )
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, window long, text string, loss array<array<long>>")


def parse_window(text: str) -> list[tuple[bool, str, str, int]]:
    """The turns of a formatted window: fresh or not, role, text, and where its escaped text begins."""
    return [(m[1] == "turn", unescape(m[2]), unescape(m[3]), m.start(3)) for m in _PIECE.finditer(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted output says: turns and learnt texts of each conversation, as counts and digests.

    The windows must come as ``format_windows`` gives them (a conversation in one partition, in order).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, out = None, False, []
        turns = chars = size = 0
        all_, loss = hashlib.sha256(), hashlib.sha256()

        def done() -> tuple:
            return now, turns, all_.hexdigest(), chars, loss.hexdigest(), size

        for b in batches:
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append(done())
                    now, begun, turns, chars, size = conv, True, 0, 0, 0
                    all_, loss = hashlib.sha256(), hashlib.sha256()
                size += len(text)
                for fresh, role, said, _ in parse_window(text):
                    if fresh:
                        turns += 1
                        all_.update(f"{role}\n{said}\n".encode())
                for start, end in spans:
                    learnt = unescape(text[start:end])
                    chars += len(learnt)
                    loss.update(learnt.encode())
        if begun:
            out.append(done())
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(table.unionByName(more)))


#: All columns but formatted_chars, which only the template decides.
OP5_PARTS_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
