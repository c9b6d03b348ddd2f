"""Hazards of a map against their surroundings: road reference and estimators (OP-69, OP-70)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.grid import ring_table


def road_reference(cells: DataFrame, hazard: DataFrame, centre: float | Column, band: float = 8.0, cfg: Config = DEFAULT) -> DataFrame:
    """``road`` of each frame: median ground of the cells whose ring centre is at most ``band`` metres from ``centre``.

    ``centre`` is a radius, or a column of the cells where frames differ in it. The hazard's own cells (frame_id, cell_id) are left
    out, so that a wide hazard is not its own reference. A frame without cells in the band has no row.
    """
    rings = F.broadcast(ring_table(cells.sparkSession, cfg).select(F.col("ring").alias("ring__"), F.col("r_centre").alias("centre__")))
    at = F.lit(centre) if isinstance(centre, int | float) else centre
    near = cells.join(rings, cells["ring"] == F.col("ring__")).where(F.abs(F.col("centre__") - at) <= band)
    return near.join(hazard, ["frame_id", "cell_id"], "left_anti").groupBy("frame_id").agg(F.median("z_ground").alias("road"))


def estimators(cells: DataFrame, hazard: DataFrame, reference: DataFrame) -> DataFrame:
    """Depth, clearance and height of a hazard in each frame, from its occupied cells and the frame's ``road``.

    * ``depth``: from the road to the lowest flagged cell (where none is flagged, to the lowest); ``depth_p10``: to the tenth percentile.
    * ``sunk``: cells over 10 cm below the road; ``detection_rate``: the share of them that is flagged; ``flag_rate``: that of all cells.
    * ``clearance``: from the road to the lowest obstacle return; ``both``: median clearance inside the ``n_both`` cells with over 0.5 m of it.
    * ``step_p90``, ``step_p50``: percentiles of the ground above the road.

    A frame without the hazard or without a reference has no row; what cannot be measured is null.
    """
    h = cells.join(hazard, ["frame_id", "cell_id"], "left_semi").join(reference, "frame_id")
    road, ground, gap = F.first("road"), F.col("z_ground"), F.col("z_obstacle") - F.col("z_ground")
    sunk = F.col("road") - ground > 0.10
    return h.groupBy("frame_id").agg(
        (road - F.coalesce(F.min(F.when(F.col("pit"), ground)), F.min(ground))).alias("depth"), (road - F.percentile(ground, 0.1)).alias("depth_p10"), F.percentile(ground, 0.1).alias("p10"),
        F.count_if(sunk).alias("sunk"), F.avg(F.when(sunk, F.coalesce("pit", F.lit(False)).cast("int"))).alias("detection_rate"), F.avg(F.coalesce("pit", F.lit(False)).cast("int")).alias("flag_rate"),
        (F.min("z_obstacle") - road).alias("clearance"), F.median(F.when(gap > 0.5, gap)).alias("both"), F.count_if(gap > 0.5).alias("n_both"),
        (F.percentile(ground, 0.9) - road).alias("step_p90"), (F.percentile(ground, 0.5) - road).alias("step_p50"),
    )
