"""Ground planes of frames of any size: drawn triples, votes and refits as aggregates over the points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .cells import kept

#: Points of a frame that triples are drawn from, and points that votes are counted on.
POOL, SCORED = 600, 20_000


def _drawn(seed: int, salt: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), "x", "y", "z")


def hypotheses(near: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Up to ``cfg.iterations`` planes of every frame: (frame_id, n, h), h an array of (nx, ny, nz, d), n the number of points.

    The pool of a frame is its 600 points of smallest hash: a ranked window with a limit, which Spark applies before the
    shuffle, so that a task sends at most 600 rows of a frame. Each triple takes three places of the pool by hash. Degenerate triples and
    planes that tilt too much are left out; a frame without any has no row.
    """
    order = Window.partitionBy("frame_id").orderBy("u", "x", "y", "z")
    pool = near.withColumn("u", _drawn(cfg.plane_seed, 1)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= POOL)
    drawn = pool.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("p"))
    place = lambda k, j: F.get("p", F.pmod(F.xxhash64(F.lit(cfg.plane_seed), k, F.lit(j)), F.size("p").cast("long")).cast("int"))
    tri = F.transform(F.sequence(F.lit(1), F.lit(cfg.iterations)), lambda k: F.struct(place(k, 0).alias("a"), place(k, 1).alias("b"), place(k, 2).alias("c")))

    def plane(t: Column) -> Column:
        u, v = ([t[e][c] - t["a"][c] for c in "xyz"] for e in "bc")
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return F.struct(*[c.alias(m) for c, m in zip(n, ("nx", "ny", "nz"), strict=True)], F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]).alias("size"), *[t["a"][c].alias(c) for c in "xyz"])

    def unit(h: Column) -> Column:
        s = h["size"] * F.when(h["nz"] < 0, -1.0).otherwise(1.0)
        n = [h[c] / s for c in ("nx", "ny", "nz")]
        return F.struct(*[c.alias(m) for c, m in zip(n, ("nx", "ny", "nz"), strict=True)], (-(n[0] * h["x"] + n[1] * h["y"] + n[2] * h["z"])).alias("d"))

    flat = math.cos(math.radians(cfg.max_tilt_deg))
    found = drawn.select("frame_id", F.filter(F.transform(F.filter(F.transform(tri, plane), lambda h: h["size"] > 1e-9), unit), lambda h: h["nz"] >= flat).alias("h"))
    return near.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).join(found, "frame_id").where((F.col("n") >= 3) & (F.size("h") > 0))


def _height(h: str = "") -> Column:
    return F.col(f"{h}nx") * F.col("x") + F.col(f"{h}ny") * F.col("y") + F.col(f"{h}nz") * F.col("z") + F.col(f"{h}d")


def with_least_direction(table: DataFrame, prefix: str = "f_n") -> DataFrame:
    """Adds the unit eigenvector of the least eigenvalue of a symmetric 3 x 3 matrix (columns xx, xy, xz, yy, yz, zz), in closed form, pointing up.

    Each step is a column of its own, as an expression that named them all again would grow without end.
    """
    c = F.col
    step = table.withColumn("q__", (c("xx") + c("yy") + c("zz")) / 3)
    p = sum((c(k) - c("q__")) * (c(k) - c("q__")) for k in ("xx", "yy", "zz")) + 2 * sum(c(k) * c(k) for k in ("xy", "xz", "yz"))
    step = step.withColumn("p__", F.sqrt(p / 6))
    step = step.withColumns({f"{k}__": F.try_divide(c(k) - c("q__"), c("p__")) for k in ("xx", "yy", "zz")} | {f"{k}__": F.try_divide(c(k), c("p__")) for k in ("xy", "xz", "yz")})
    xx, xy, xz, yy, yz, zz = (c(f"{k}__") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    half = (xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) / 2
    step = step.withColumn("h__", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half)))
    step = step.withColumn("l__", c("q__") + 2 * c("p__") * F.cos(F.acos("h__") / 3 + 2 * math.pi / 3))
    step = step.withColumns({"u__": c("xx") - c("l__"), "v__": c("yy") - c("l__"), "w__": c("zz") - c("l__")})
    rows = [[c("u__"), c("xy"), c("xz")], [c("xy"), c("v__"), c("yz")], [c("xz"), c("yz"), c("w__")]]
    cross = lambda a, b: F.struct(*[(a[i] * b[j] - a[j] * b[i]).alias(k) for i, j, k in ((1, 2, "x"), (2, 0, "y"), (0, 1, "z"))])
    step = step.withColumn("c__", F.array(*[cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]))
    sized = F.transform("c__", lambda v: F.struct((v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]).alias("s"), v.alias("v")))
    step = step.withColumn("b__", F.array_max(sized))
    step = step.withColumn("s__", F.sqrt("b__.s") * F.when(c("b__.v.z") < 0, -1.0).otherwise(1.0))
    return step.select(*table.columns, *[F.try_divide(c(f"b__.v.{k}"), c("s__")).alias(f"{prefix}{k}") for k in "xyz"])


def ransac_planes(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The ground plane of every frame (unit normal upward, offset, inliers); frames without one have no row.

    Points near the sensor vote for a frame's planes: rows of (point, plane) within the tolerance, counted by partial
    aggregates, so a frame of any size is spread over all tasks. Beyond 20,000 points, those whose hash falls below 20,000 / n vote, as
    scoring is a sample by definition; the refit and the inliers take all points. The refit sums nine moments of the inliers about
    a point of the plane and takes the least direction of their 3 x 3 matrix; where it tilts too much the voted plane stays. Equal votes go to the
    first plane. Points with a null coordinate are left out.
    """
    near = kept(points.select("frame_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") < cfg.fit_radius**2).where("z IS NOT NULL"))
    frames = kept(hypotheses(near, cfg))
    share = F.col("n") * (F.pmod(_drawn(cfg.plane_seed, 2), F.lit(1 << 30)) / float(1 << 30)) < SCORED
    votes = near.join(frames, "frame_id").where(share).select("frame_id", "x", "y", "z", F.posexplode("h").alias("k", "p")).select("frame_id", "k", "x", "y", "z", "p.*").where(F.abs(_height()) <= cfg.ground_tol).groupBy("frame_id", "k").agg(F.count(F.lit(1)).alias("votes"))
    won = votes.groupBy("frame_id").agg(F.max(F.struct("votes", (-F.col("k")).alias("k"))).alias("w"))
    first = kept(won.join(frames, "frame_id").select("frame_id", F.get("h", -F.col("w.k")).alias("p")).select("frame_id", *[F.col(f"p.{c}").alias(f"v_{c}") for c in ("nx", "ny", "nz", "d")]))
    inside = near.join(first, "frame_id").where(F.abs(_height("v_")) <= cfg.ground_tol)
    # Moments about the point of the voted plane below the sensor, for precision.
    about = {"x": -F.col("v_d") * F.col("v_nx"), "y": -F.col("v_d") * F.col("v_ny"), "z": -F.col("v_d") * F.col("v_nz")}
    moved = inside.withColumns({f"m{c}": F.col(c) - about[c] for c in "xyz"})
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    sums = moved.groupBy("frame_id").agg(F.count(F.lit(1)).alias("inside"), *[F.avg(f"m{c}").alias(f"a{c}") for c in "xyz"], *[F.avg(F.col(f"m{c[0]}") * F.col(f"m{c[1]}")).alias(c) for c in pairs])
    spread = sums.where("inside >= 3").withColumns({c: F.col(c) - F.col(f"a{c[0]}") * F.col(f"a{c[1]}") for c in pairs})
    fit = with_least_direction(spread.join(first, "frame_id"))
    fit = fit.withColumn("f_d", -(sum(F.col(f"f_n{c}") * (F.col(f"a{c}") + about[c]) for c in "xyz")))
    good = F.coalesce((F.col("f_nz") >= math.cos(math.radians(cfg.max_tilt_deg))) & ~F.isnan("f_nz"), F.lit(False))
    planes = kept(fit.select("frame_id", *[F.when(good, F.col(f"f_{c}")).otherwise(F.col(f"v_{c}")).alias(c) for c in ("nx", "ny", "nz", "d")]))
    return near.join(planes, "frame_id").groupBy("frame_id").agg(*[F.first(c).alias(c) for c in ("nx", "ny", "nz", "d")], F.count_if(F.abs(_height()) <= cfg.ground_tol).alias("inliers"))
