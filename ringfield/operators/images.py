"""Range images: spherical projection, nearest-wins pixels, range-aware voting."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# Means and deviations of range, x, y, z, intensity.
MEANS, STDS = (12.12, 10.88, 0.23, -1.04, 0.21), (12.32, 11.47, 6.91, 0.86, 0.16)

#: Pixels along a side of the tiles in which votes are looked up.
VOTE_TILE = 8


def pixels(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``range``, ``py`` and ``px``; directions beyond the field of view go to its edge, none is dropped."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    up, down = math.radians(cfg.fov_up), math.radians(cfg.fov_down)
    yaw = -F.atan2("y", "x")
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.col("z") / F.greatest(r, F.lit(1e-6)), F.lit(1.0))))
    u, v = 0.5 * (yaw / math.pi + 1.0), 1.0 - (pitch - down) / (up - down)
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c * n), F.lit(n - 1))).cast("int")
    return points.withColumns({"range": r, "px": clip(u, cfg.image_w), "py": clip(v, cfg.image_h)})


def normalised(image: DataFrame) -> DataFrame:
    """The five channels with mean 0 and deviation 1, as the network wants them."""
    return image.withColumns({f"{c}_n": (F.col(c) - m) / s for c, m, s in zip(("range", "x", "y", "z", "intensity"), MEANS, STDS, strict=True)})


def depth_test(image: DataFrame, order: list) -> DataFrame:
    """The nearest point of every pixel; of equally near ones the last by ``order`` (columns)."""
    w = Window.partitionBy("frame_id", "py", "px").orderBy(F.col("range"), *[F.desc(c) for c in order])
    return image.withColumn("k__", F.row_number().over(w)).where("k__ = 1").drop("k__")


def knn_vote(points: DataFrame, image: DataFrame, key: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """A class for each point from the pixels around it: the k nearest in range within the cutoff vote by distance.

    ``image`` has one row for a pixel (frame_id, py, px, range, cls). Rows do not wrap around in azimuth; empty
    pixels do not vote; ties go to the lowest class; without a vote the own pixel decides. The pixels of a tile of 8 x 8 and those within
    half a window of it are gathered in one array (a pixel is sent about twice, not window^2 times); a point looks up the array of its tile by an equi-join
    and takes its window from it.
    """
    half = cfg.knn_window // 2
    tile = lambda c: F.floor(c / VOTE_TILE).cast("int")
    reach = lambda c: F.explode(F.sequence(tile(F.col(c) - half), tile(F.col(c) + half)))
    met = image.select("frame_id", "py", "px", F.col("range").alias("there"), F.col("cls").alias("c"), reach("py").alias("ty")).select("*", reach("px").alias("tx"))
    gathered = met.groupBy("frame_id", "ty", "tx").agg(F.collect_list(F.struct("py", "px", "there", "c")).alias("tile"))
    near = lambda e: (F.abs(e["py"] - F.col("py")) <= half) & (F.abs(e["px"] - F.col("px")) <= half)
    seen = points.select(*key, "frame_id", F.col("range").alias("own"), "py", "px", tile(F.col("py")).alias("ty"), tile(F.col("px")).alias("tx")).join(gathered, ["frame_id", "ty", "tx"])
    shift = lambda e: F.struct((e["py"] - F.col("py")).alias("dy"), (e["px"] - F.col("px")).alias("dx"), e["there"].alias("there"), e["c"].alias("c"))
    seen = seen.select(*key, "own", F.transform(F.filter("tile", near), shift).alias("around")).where(F.size("around") > 0)
    # sort_array orders structs natively; array_sort would call its comparator row by row.
    sized = F.transform("around", lambda e: F.struct(F.round(F.abs(e["there"] - F.col("own")), 9).alias("d"), e["dy"].alias("dy"), e["dx"].alias("dx"), e["c"].alias("c")))
    centre = F.filter("around", lambda e: (e["dy"] == 0) & (e["dx"] == 0))
    best = seen.select(*key, F.slice(F.sort_array(sized), 1, cfg.knn).alias("near"), F.get(centre, F.lit(0))["c"].alias("own_cls"))
    near = [F.get("near", F.lit(i)) for i in range(cfg.knn)]
    # One weight for each of the k nearest, once a row; the sums run in the order of the ranks.
    weighed = best.select(*key, "own_cls", *[c for i, s in enumerate(near) for c in (s["c"].alias(f"c{i}__"), F.when(s["d"] <= cfg.knn_cutoff, F.exp(-s["d"] * s["d"] / (2 * cfg.knn_sigma**2))).otherwise(0.0).alias(f"w{i}__"))])
    score = lambda k: functools.reduce(operator.add, [F.when(F.col(f"c{i}__") == k, F.col(f"w{i}__")).otherwise(0.0) for i in range(cfg.knn)])
    scored = weighed.withColumn("votes", F.array(*[F.round(score(k), 9) for k in range(5)]))
    won = F.array_position("votes", F.array_max("votes")).cast("int") - 1
    return scored.select(*key, F.when(F.array_max("votes") > 0, won).otherwise(F.coalesce("own_cls", F.lit(0))).alias("vote"))
