"""The variable-resolution polar grid as column expressions: rings grow from 5 cm cells at 10 m to 50 cm at 100 m."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

RING_DDL = "ring int, r_in double, r_out double, s double, r_centre double, n_bins int, offset int"


@lru_cache(maxsize=8)
def rings(cfg: Config = DEFAULT) -> tuple[tuple, ...]:
    """All rings (662 by default): the edges come from adding the cell sizes up one by one."""
    out, r, offset = [], 0.0, 0
    while r < cfg.r_max:
        s = cfg.s_min if r <= cfg.r_knee else min(cfg.s_min * r / cfg.r_knee, cfg.s_max)
        n = max(1, round(2 * math.pi * r / s))
        out.append((len(out), r, r + s, s, r + s / 2, n, offset))
        r, offset = r + s, offset + n
    return tuple(out)


def ring_table(spark: SparkSession, cfg: Config = DEFAULT) -> DataFrame:
    """The ring dimension, a table of fixed size that every join may broadcast."""
    return spark.createDataFrame(list(rings(cfg)), RING_DDL).coalesce(1)


def n_inner(cfg: Config = DEFAULT) -> int:
    return round(cfg.r_knee / cfg.s_min)


def ring_of(r: Column, cfg: Config = DEFAULT) -> Column:
    """The ring of a radius in closed form; -1 for negative, too large, infinite, NaN or null radii."""
    inner = F.floor(r / F.lit(cfg.s_min))
    outer = n_inner(cfg) + F.floor(F.log(r / F.lit(cfg.r_knee)) / F.lit(math.log(1 + cfg.s_min / cfg.r_knee)))
    ring = F.when(r <= cfg.r_knee, inner).otherwise(outer)
    # Never null, so that no join adds a filter that computes it once more.
    return F.coalesce(F.when((r >= 0) & (r <= cfg.r_max) & ~F.isnan(r), F.least(ring, F.lit(len(rings(cfg)) - 1))).cast("int"), F.lit(-1))


def radius(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def turn(x: Column, y: Column) -> Column:
    """The share of a full turn of the direction, in [0, 1)."""
    a = F.atan2(y, x)
    return F.when(a < 0, a + F.lit(2 * math.pi)).otherwise(a) / F.lit(2 * math.pi)


def project(points: DataFrame, cfg: Config = DEFAULT, keep_outside: bool = False) -> DataFrame:
    """Add ``ring``, ``bin`` and ``cell_id``; points outside the envelope go (or keep -1).

    One broadcast join with the ring table; everything else stays inside one stage of generated code.
    """
    rows = points.withColumn("ring", ring_of(radius(F.col("x"), F.col("y")), cfg))
    dim = F.broadcast(ring_table(points.sparkSession, cfg).select("ring", "n_bins", "offset"))
    joined = rows.join(dim, "ring", "left" if keep_outside else "inner")
    bin_ = F.greatest(F.lit(0), F.least(F.floor(turn(F.col("x"), F.col("y")) * F.col("n_bins")), F.col("n_bins") - 1)).cast("int")
    out = joined.withColumn("bin", F.coalesce(bin_, F.lit(-1))).withColumn("cell_id", F.coalesce(F.col("offset") + F.col("bin"), F.lit(-1)).cast("int"))
    return out.select(*points.columns, "ring", "bin", "cell_id")


def neighbours(cells: DataFrame, cfg: Config = DEFAULT, parity: bool = False) -> DataFrame:
    """Four rows for each cell: its neighbour in the next and previous ring and in the next and previous bin.

    Bins wrap around; rings end at the edges with the cell itself. Inside the knee, where rings differ in
    their number of bins, the bin is scaled and rounded half to even. ``parity`` scales towards the previous ring
    with the next ring's ratio, as older maps did; by default the ratio is the geometric one.
    """
    last, inner = len(rings(cfg)) - 1, n_inner(cfg)
    around = [(k, rings(cfg)[k][5], rings(cfg)[min(k + 1, last)][5], rings(cfg)[min(k + 1, last)][6], rings(cfg)[max(k - 1, 0)][5], rings(cfg)[max(k - 1, 0)][6]) for k in range(last + 1)]
    dim = F.broadcast(cells.sparkSession.createDataFrame(around, "ring int, n int, n_next int, o_next int, n_prev int, o_prev int"))
    k, j, n = F.col("ring"), F.col("bin"), F.col("n")
    up = F.when(k < inner, F.least(F.rint(j * F.col("n_next") / n), F.col("n_next") - 1)).otherwise(j)
    ratio = F.col("n_next") / n if parity else F.col("n_prev") / n
    down = F.when(k <= inner, F.pmod(F.rint(j * ratio), F.col("n_prev")) if parity else F.least(F.rint(j * ratio), F.col("n_prev") - 1)).otherwise(j)
    own = F.col("cell_id")
    offset = own - j
    four = F.array(
        F.struct(F.lit("next").alias("side"), F.when(k == last, own).otherwise(F.col("o_next") + up).cast("int").alias("neighbour_id")),
        F.struct(F.lit("prev").alias("side"), F.when(k == 0, own).otherwise(F.col("o_prev") + down).cast("int").alias("neighbour_id")),
        F.struct(F.lit("left").alias("side"), (offset + F.pmod(j + 1, n)).cast("int").alias("neighbour_id")),
        F.struct(F.lit("right").alias("side"), (offset + F.pmod(j - 1, n)).cast("int").alias("neighbour_id")),
    )
    return cells.join(dim, "ring").select(*cells.columns, F.explode(four).alias("e")).select(*cells.columns, "e.side", "e.neighbour_id")
