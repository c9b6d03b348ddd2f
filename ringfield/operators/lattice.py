"""A uniform lattice over the footprint of a map, for comparison with the variable cells (OP-65)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.grid import project, ring_table
from .cells import kept


def lattice(cells: DataFrame, keep: tuple[str, ...] = ("class_id", "n"), size: float = 0.05, budget: int = 1_600_000, cfg: Config = DEFAULT) -> DataFrame:
    """The lattice sites that an occupied cell of their frame covers: frame_id, stride, ix, iy, x, y, cell_id and ``keep``.

    The footprint of a frame is the bounding box of the centres of its cells, clipped to the envelope and rounded to
    micrometres. Where its sites of ``size`` are more than ``budget``, every stride-th one along both axes is taken, with the
    smallest stride that fits. Each cell gives the sites around itself and keeps those that it covers, so the
    work grows with the occupied area, not with the box, and sites meet no table but that of the rings.

    Cells need frame_id, ring, bin and cell_id. A frame without cells has no sites; a cell smaller than the stride may have
    none; repeated cells give repeated sites; a null frame_id, ring or bin gives none.
    """
    dim = F.broadcast(ring_table(cells.sparkSession, cfg).select("ring", "r_centre", "s", "n_bins"))
    theta = (F.col("bin") + 0.5) * F.lit(2 * math.pi) / F.col("n_bins")
    reach = (F.col("s") + (F.col("r_centre") + F.col("s") / 2) * F.lit(2 * math.pi) / F.col("n_bins")) / 2 + size
    own = cells.where("frame_id IS NOT NULL AND bin IS NOT NULL").join(dim, "ring")
    placed = kept(own.select("frame_id", F.col("cell_id").alias("own_id"), *[F.col(c).alias(f"own_{c}") for c in keep], (F.col("r_centre") * F.cos(theta)).alias("cx"), (F.col("r_centre") * F.sin(theta)).alias("cy"), reach.alias("reach")))

    def edge(axis: str) -> list[Column]:
        return [F.round(F.greatest(F.min(axis), F.lit(-cfg.r_max)), 6).alias(f"{axis}0"), F.round(F.least(F.max(axis), F.lit(cfg.r_max)), 6).alias(f"{axis}1")]

    sites = lambda axis: F.greatest(F.lit(1), F.ceil((F.col(f"{axis}1") - F.col(f"{axis}0")) / F.lit(size))).cast("long").alias(f"n{axis}")
    foot = placed.groupBy("frame_id").agg(*edge("cx"), *edge("cy")).select("frame_id", "cx0", "cy0", sites("cx"), sites("cy"))
    foot = foot.withColumn("stride", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("ncx") * F.col("ncy") / F.lit(float(budget))))).cast("long"))

    def around(axis: str) -> Column:
        """Numbers of the taken sites within reach of a cell, counted in strides."""
        at = lambda side: (F.col(axis) + side * F.col("reach") - F.col(f"{axis}0")) / F.lit(size) - 0.5
        lo = F.ceil(F.greatest(at(-1), F.lit(0.0)) / F.col("stride"))
        hi = F.floor(F.least(at(1), (F.col(f"n{axis}") - 1).cast("double")) / F.col("stride"))
        return F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))

    held = ["frame_id", "stride", "cx0", "cy0", "own_id", *[f"own_{c}" for c in keep]]
    grown = placed.join(foot, "frame_id").withColumn("kx", around("cx")).withColumn("ky", around("cy"))
    numbered = grown.select(*held, (F.col("kx") * F.col("stride")).alias("ix"), (F.col("ky") * F.col("stride")).alias("iy"))
    points = numbered.select(*held, "ix", "iy", (F.col("cx0") + (F.col("ix") + 0.5) * size).alias("x"), (F.col("cy0") + (F.col("iy") + 0.5) * size).alias("y"))
    return project(points, cfg).where("cell_id = own_id").select("frame_id", "stride", "ix", "iy", "x", "y", "cell_id", *[F.col(f"own_{c}").alias(c) for c in keep])
