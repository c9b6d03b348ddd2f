"""Exact quantiles of groups of any size, from a range shuffle with prefix counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import kept


def exact_quantiles(table: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the interpolated quantiles of its values: ``by`` and one double for each name in ``shares``.

    Equal values are counted before anything is shuffled. The counts are dealt out by range of (group, value), so that a single group is
    spread over all tasks, and each task adds up its own; the totals of the tasks (one small row for each task and group) give every row its ranks. A quantile at
    share q of n values lies at q (n - 1), between the values of the two ranks around it, which one join finds. Null values are left out, NaN is
    the greatest; null is a group like any other. A group without values has no row.
    """
    counts = table.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    kind = table.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = np.cumsum(b.column(2).to_numpy()) + total
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(upto)], ["g", "v", "n", "part", "upto"])

    dealt = counts.repartitionByRange("g", "v").sortWithinPartitions("g", "v")
    rows = kept(dealt.mapInArrow(run, f"g {kind}, v double, n long, part int, upto long"))
    group = Window.partitionBy("g")
    ends = rows.groupBy("g", "part").agg(F.min(F.col("upto") - F.col("n")).alias("base"), F.sum("n").alias("own"))
    placed = ends.select("g", "part", "base", "own", (F.sum("own").over(group.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(group).alias("all"))
    spots = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(q) * (F.col("all") - 1)).alias("at")) for k, q in shares.items()])).alias("q")
    wanted = placed.select("g", "part", "base", "own", "before", spots).select("*", "q.name", F.explode(F.array_distinct(F.array(F.floor("q.at"), F.ceil("q.at")))).alias("rank"))
    # Only the tasks that hold a wanted rank are left: at most two for each group and quantile.
    wanted = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("own"))).select(F.col("g").alias("wg"), F.col("part").alias("wpart"), "name", "q.at", "rank", (F.col("rank") - F.col("before") + F.col("base")).alias("local"))
    hit = rows.join(wanted, F.col("g").eqNullSafe(F.col("wg")) & (F.col("part") == F.col("wpart")) & (F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
    share = F.col("at") - F.floor("at")
    weight = F.when(share == 0, 1.0).when(F.col("rank") > F.col("at"), share).otherwise(1 - share)
    parts = hit.groupBy("g", "name").agg(F.sum(F.col("v") * weight).alias("v"))
    return parts.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in shares])
