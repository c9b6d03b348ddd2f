"""Row rules of the geometric segmenter: plane bands and the box classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def band_class(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Signed distance ``h`` to the plane (nx, ny, nz, d) of the row, and its band: ground, skirt, below or above."""
    h = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    band = F.when(F.abs("h") <= cfg.ground_tol, "ground").when((r > cfg.fit_radius) & (F.abs("h") <= cfg.terrain_tol), "skirt").when(F.col("h") < -cfg.ground_tol, "below").otherwise("above")
    return points.withColumn("h", h).withColumn("band", band)


def bbox_class(clusters: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Class of each cluster from its size ``n``, extents (sx, sy, span) and the height ``base`` of its lowest point."""
    foot = F.greatest("sx", "sy")
    vehicle = F.col("span").between(0.8, 4.5) & foot.between(1.5, 9.0) & (foot >= F.col("span"))
    person = F.col("span").between(0.8, 2.2) & (foot <= 1.2)
    cls = F.when(F.col("n") < cfg.min_cluster_points, 0).when(F.col("base") > 0.6, 3).when((F.col("span") <= 0.35) & (foot >= 3.0), 2).when(vehicle | person, 4).otherwise(3)
    return clusters.withColumn("cls", cls)
