"""Sharding: the minimax contiguous partition of ordered atomic groups (operator 9)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, saved

#: Group ends that the driver holds at once while it finishes the search.
WINDOW_ENDS = 200_000


def greedy(ends: Callable[[int], int], capacity: int, shards: int, total: int) -> tuple[list[int], bool]:
    """Greedy cut positions (bytes before each of the ``shards - 1`` cuts) and whether everything fits.

    ``ends(x)`` gives the largest group end that is at most x. The positions never fall as the capacity grows.
    """
    cuts = [0]
    for _ in range(shards - 1):
        cuts.append(total if total - cuts[-1] <= capacity else max(cuts[-1], ends(cuts[-1] + capacity)))
    return cuts[1:], total - cuts[-1] <= capacity


def minimax_cuts(groups: DataFrame, end: str, size: str, shards: int, total: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its greedy cuts, for groups with their running end and size.

    The answer is at least the mean shard and at least the largest group, and at most the mean plus the
    largest group, so every cut lies in a window between the cuts of two capacities. Where these windows
    hold few group ends, they are fetched once and the binary search runs on them; while they hold more,
    the interval is halved with look-ups on the distributed table (each reads only the ends near one sum).
    """
    if total == 0:
        return 0, [0] * (shards - 1)
    largest = groups.agg(F.max(size)).first()[0]
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest

    def far(x: int) -> int:
        return groups.where((F.col(end) > x - largest) & (F.col(end) <= x)).agg(F.max(end)).first()[0] or 0

    lower, upper = [max(0, k * (low - largest)) for k in range(1, shards)], [min(total, k * high) for k in range(1, shards)]
    tried = False
    while True:
        near = F.lit(False)
        for a, b in zip(lower, upper, strict=True):
            near = near | ((F.col(end) >= a) & (F.col(end) <= b))
        found = groups.where(near).select(end).limit(WINDOW_ENDS + 1).collect()
        if len(found) <= WINDOW_ENDS:
            have = np.sort(np.array([0, *(r[0] for r in found), total], np.int64))

            def close(x: int, have: np.ndarray = have) -> int:
                return int(have[np.searchsorted(have, x, "right") - 1])

            while low < high:
                mid = (low + high) // 2
                if greedy(close, mid, shards, total)[1]:
                    high = mid
                else:
                    low = mid + 1
            return high, greedy(close, high, shards, total)[0]
        capacity = (low + high) // 2 if tried else low  # one very large group often decides: its size first
        tried = True
        cuts, fits = greedy(far, capacity, shards, total)
        if fits:
            high, upper = capacity, [min(x) for x in zip(upper, cuts, strict=True)]
            if low == high:
                return high, cuts
        else:
            low, lower = capacity + 1, [max(x) for x in zip(lower, cuts, strict=True)]


def shard_minimax(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards so that the largest shard is as small as can be.

    Rows with equal texts are one atomic group. Groups are ordered by the SHA-256 digest of their text, an
    order that no source or length can skew; within a group rows go by id. The size of a row is the
    number of UTF-8 bytes of its text plus 1. The smallest feasible capacity is found by binary search with
    a greedy check, and the order is cut there.

    Adds ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1, ... in every shard) to the table's columns,
    of which only the id is kept. Null texts: no bytes, one group of their own; an empty text is another
    group. Repeated rows each get a slot. An empty table gives an empty result. If fewer groups than shards
    exist, the last shards stay empty.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("id__"),
        F.when(F.col(text_col).isNotNull(), F.unhex(F.sha2(body, 256))).otherwise(F.lit(b"")).alias("digest"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    rows = saved(rows)
    groups, _, totals = ranked(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), [F.col("digest")], "group_no", {"end": "bytes"})
    groups = saved(groups)
    capacity, cuts = minimax_cuts(groups, "end", "bytes", shards, totals["end"])
    # The first group after each cut; a cut at the very end leaves the later shards empty.
    firsts = {r["start"]: bytes(r["digest"]) for r in groups.where((F.col("end") - F.col("bytes")).isin(sorted(set(cuts)))).select((F.col("end") - F.col("bytes")).alias("start"), "digest").collect()} if cuts else {}
    shard = F.lit(0)
    for c in cuts:
        if c in firsts and c > 0:
            shard = shard + (F.col("digest") >= F.lit(firsts[c])).cast("int")
    placed, _, _ = ranked(rows.withColumn("shard", shard.cast("int")), [F.col("digest"), F.col("id__"), F.col("text_crc32")], "row_no")
    starts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("row_no").alias("first")).collect()}
    first = F.lit(0)
    for s, n in starts.items():
        first = F.when(F.col("shard") == s, F.lit(n)).otherwise(first)
    return placed.select(F.col("id__").alias(id_col), "size", "text_crc32", "shard", (F.col("row_no") - first).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_minimax(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
