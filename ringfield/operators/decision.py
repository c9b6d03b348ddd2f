"""From the map to a decision: Cartesian raster, inflation, soft cost, risk, conflicts, reasons, log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.grid import project


def raster_size(cfg: Config = DEFAULT) -> int:
    return round(cfg.extent / cfg.res)


#: What a raster cell holds that no map cell covers (cost: after ``track_cost``).
UNKNOWN = {"trav": 0.5, "class_id": 0, "flags": 0, "cost": 0.5}


def raster_cells(spark: SparkSession, cfg: Config = DEFAULT) -> DataFrame:
    """The raster cells (ix, iy, of a fixed number) and the map cell (ring, bin, cell_id) that covers the centre of each."""
    n = raster_size(cfg)
    xy = spark.range(n * n).select((F.col("id") / n).cast("int").alias("ix"), (F.col("id") % n).cast("int").alias("iy"))
    xy = xy.withColumns({"x": (F.col("ix") + 0.5) * cfg.res, "y": (F.col("iy") + 0.5) * cfg.res - cfg.extent / 2})
    return project(xy, cfg).select("ix", "iy", "ring", "bin", "cell_id")


def known(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The raster cells that a map cell covers (frame_id, ix, iy, trav, class_id, flags), by a broadcast join with the fixed raster."""
    where = F.broadcast(raster_cells(cells.sparkSession, cfg).select("ix", "iy", "cell_id"))
    return cells.select("frame_id", "cell_id", "trav", "class_id", "flags").join(where, "cell_id").select(
        "frame_id", "ix", "iy", *[F.coalesce(c, F.lit(UNKNOWN[c])).alias(c) for c in ("trav", "class_id", "flags")])


def filled(some: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The whole raster of each frame (in ``frames`` once) from some of its cells: the others are unknown.

    Only the given cells are shuffled: in the order of their places each writes itself and the unknown cells up to the next one, and
    a mark of the frame those before the first.
    """
    n, values = raster_size(cfg), [c for c in UNKNOWN if c in some.columns]
    marks = some.where("frame_id IS NOT NULL").select("frame_id", (F.col("ix") * n + F.col("iy")).cast("int").alias("place"), F.struct(*values).alias("v"))
    kind = marks.schema["v"].dataType.simpleString()
    marks = marks.union(frames.select("frame_id", F.lit(-1).alias("place"), F.lit(None).cast(kind).alias("v")))
    order = Window.partitionBy("frame_id").orderBy("place")
    rows = marks.select("frame_id", "place", "v", F.coalesce(F.lead("place").over(order), F.lit(n * n)).alias("next"), F.first("place").over(order).alias("first")).where("first = -1")
    each = rows.select("frame_id", "place", "v", F.explode(F.expr("if(next > place, sequence(place, next - 1), array(place))")).alias("at")).where("at >= 0")
    own = F.col("at") == F.col("place")
    return each.select("frame_id", F.expr(f"at div {n}").cast("int").alias("ix"), (F.col("at") % n).alias("iy"), *[F.when(own, F.col(f"v.{c}")).otherwise(F.lit(UNKNOWN[c])).alias(c) for c in values])


def resample(cells: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The planning raster of each frame (in ``frames`` once): every raster cell takes the values of the map cell that covers its centre.

    ``cells`` has frame_id, cell_id, trav, class_id, flags. Unknown raster cells get 0.5, class 0, no flags. Frames times raster is the size of the output;
    what is shuffled are the known cells.
    """
    return filled(known(cells, cfg), frames, cfg)


def inflate(raster: DataFrame, cfg: Config = DEFAULT, block_obstacles: bool = False, sparse: bool = False) -> DataFrame:
    """Set the score to 0 within the vehicle's half width (L1 distance) of STATIC and DYNAMIC cells, but not on these cells.

    ``block_obstacles`` also blocks the obstacle cells themselves. ``sparse``: the raster has known cells only, and so has the result, with the unknown cells that become blocked.
    """
    n, k = raster_size(cfg), math.ceil(cfg.width / 2 / cfg.res)
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a) + abs(b) <= k])
    hard = F.col("class_id").isin(3, 4)
    halo = raster.where(hard).select("frame_id", "ix", "iy", F.explode(steps).alias("s")).select("frame_id", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy")).distinct().withColumn("halo", F.lit(True))
    if sparse:
        joined = _with_unknown(raster, halo.where(f"ix BETWEEN 0 AND {n - 1} AND iy BETWEEN 0 AND {n - 1}"))
    else:
        joined = raster.join(halo, ["frame_id", "ix", "iy"], "left")
    blocked = F.col("halo").isNotNull() & (F.lit(True) if block_obstacles else ~hard)
    return joined.withColumn("trav", F.when(blocked, 0.0).otherwise(F.col("trav"))).drop("halo")


def _with_unknown(raster: DataFrame, more: DataFrame) -> DataFrame:
    """A sparse raster with the columns of ``more`` (frame_id, ix, iy, ...), whose cells it takes on as unknown ones."""
    joined = raster.join(more, ["frame_id", "ix", "iy"], "full")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in UNKNOWN.items() if c in raster.columns})


def track_cost(raster: DataFrame, predicted: DataFrame, cfg: Config = DEFAULT, sparse: bool = False) -> DataFrame:
    """Lower the score by 0.3 for every predicted track point (frame_id, x, y) in a cell; cost is 1 less the score.

    ``sparse``: the raster has known cells only, and the result those that a point meets besides.
    """
    n = raster_size(cfg)
    hits = predicted.select("frame_id", F.floor(F.col("x") / cfg.res).cast("int").alias("ix"), F.floor((F.col("y") + cfg.extent / 2) / cfg.res).cast("int").alias("iy")).where(f"ix BETWEEN 0 AND {n - 1} AND iy BETWEEN 0 AND {n - 1}")
    counts = hits.groupBy("frame_id", "ix", "iy").agg(F.count(F.lit(1)).alias("hits"))
    joined = _with_unknown(raster, counts) if sparse else raster.join(counts, ["frame_id", "ix", "iy"], "left")
    soft = joined.withColumn("trav", F.when(F.col("hits").isNotNull(), F.greatest(F.lit(0.0), F.col("trav") - 0.3 * F.col("hits"))).otherwise(F.col("trav")))
    return soft.withColumn("cost", F.greatest(F.lit(0.0), F.least(1 - F.col("trav"), F.lit(1.0)))).drop("hits")


def risk(mean_cost: Column) -> Column:
    return F.when(mean_cost < 0.25, "LOW").when(mean_cost < 0.55, "MEDIUM").otherwise("HIGH")


def conflicts(predicted: DataFrame, waypoints: DataFrame, cfg: Config = DEFAULT, near: float = 3.0) -> DataFrame:
    """The first track, by its order, with a predicted point within 3 m of a waypoint, and the time of that point.

    ``predicted``: frame_id, track_order, step, x, y; ``waypoints``: frame_id, x, y. A distance join by buckets of 3 m: a
    point looks into nine buckets by an equi-join and then checks the distance.
    """
    cell = lambda c: F.floor(c / near).cast("int")
    probe = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    p = predicted.select("*", F.explode(probe).alias("o")).select("frame_id", "track_order", "step", "x", "y", (cell(F.col("x")) + F.col("o.a")).alias("bx"), (cell(F.col("y")) + F.col("o.b")).alias("by"))
    w = waypoints.select("frame_id", F.col("x").alias("wx"), F.col("y").alias("wy"), cell(F.col("x")).alias("bx"), cell(F.col("y")).alias("by"))
    dx, dy = F.col("x") - F.col("wx"), F.col("y") - F.col("wy")
    hit = p.join(w, ["frame_id", "bx", "by"]).where(dx * dx + dy * dy < near * near)
    first = hit.groupBy("frame_id").agg(F.min(F.struct("track_order", "step")).alias("f"))
    return first.select("frame_id", "f.track_order", (cfg.horizon / cfg.predict_steps * (F.col("f.step") + 1)).alias("t_conflict"))


# The sentences of a decision.
SAY_TRACK = "Rerouted: track #%d (DYNAMIC_OBJECT, %.1f m/s) predicted to intersect primary route at t+%.1f s."
SAY_CLEARANCE = "Primary route blocked: overhead clearance %.2f m below vehicle height %.2f m at %.0f m ahead."
SAY_HOLE = "Primary route blocked: negative obstacle depth %.2f m at %.0f m ahead."
SAY_CLEAR = "Primary route selected: mean traversability %.2f, max slope %.1f°, no dynamic conflicts within %.0f s."
SAY_LONGER, SAY_OTHER = " Alternative adds %.1f km at %s terrain risk.", " Alternative at %s terrain risk."


def reason(context: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The sentence for a decision, by priority: moving track, clearance, hole, else the measured means.

    Columns: track_id, track_speed, t_conflict; clearance, clearance_range; hole_depth, hole_range (a cause counts where its first
    and last column are not null); extra_km (null: none), alternative_risk, mean_trav, max_slope.
    """
    extra = F.when(F.col("extra_km") > 0.005, F.format_string(SAY_LONGER, "extra_km", "alternative_risk")).otherwise(F.format_string(SAY_OTHER, "alternative_risk"))
    there = lambda *c: F.col(c[0]).isNotNull() & F.col(c[1]).isNotNull()
    say = (
        F.when(there("track_id", "t_conflict"), F.concat(F.format_string(SAY_TRACK, "track_id", "track_speed", "t_conflict"), extra))
        .when(there("clearance", "clearance_range"), F.concat(F.format_string(SAY_CLEARANCE, "clearance", F.lit(cfg.height), "clearance_range"), extra))
        .when(there("hole_depth", "hole_range"), F.concat(F.format_string(SAY_HOLE, "hole_depth", "hole_range"), extra))
        .otherwise(F.format_string(SAY_CLEAR, "mean_trav", "max_slope", F.lit(cfg.horizon)))
    )
    return context.withColumn("reason", say)


def decide(routes: DataFrame, tracks: DataFrame, hazards: DataFrame | None = None, terrain: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The decision of every frame: which route, its risk, arrival and reason.

    ``routes`` are those of ``plan_routes`` (both kinds for each frame); ``tracks`` have frame_id, track_id, vx, vy, n_cells and ``predicted`` points. The first track, the largest
    first, that comes within 3 m of a waypoint of the primary route moves the vehicle to the alternative. ``hazards`` (frame_id, clearance, clearance_range,
    hole_depth, hole_range) and ``terrain`` (frame_id, mean_trav, max_slope) may be missing; a frame without terrain counts as 0.91 and 0 degrees.
    The risk is that of the selected route, the arrival that of the primary one. A frame without a primary route has no row.
    """
    # What a frame without measured terrain says.
    mean_trav, max_slope = 0.91, 0.0
    first = routes.where("kind = 'primary'").select("frame_id", F.col("length").alias("l1"), F.col("risk").alias("r1"), "eta", "waypoints")
    other = routes.where("kind = 'alternative'").select("frame_id", F.col("length").alias("l2"), F.col("risk").alias("alternative_risk"))
    ranked = tracks.select("frame_id", "track_id", "vx", "vy", "predicted", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("n_cells"), "track_id")).alias("track_order"))
    points = ranked.select("frame_id", "track_order", F.posexplode("predicted").alias("step", "p")).select("frame_id", "track_order", "step", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    way = first.select("frame_id", F.explode("waypoints").alias("p")).select("frame_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).cast("double")
    block = conflicts(points, way, cfg).join(ranked, ["frame_id", "track_order"]).select("frame_id", "track_id", speed.alias("track_speed"), F.round("t_conflict", 1).alias("t_conflict"))
    kinds = {"clearance": hazards, "clearance_range": hazards, "hole_depth": hazards, "hole_range": hazards, "mean_trav": terrain, "max_slope": terrain}
    rows = first.join(other, "frame_id", "left").join(block, "frame_id", "left")
    for table in (hazards, terrain):
        if table is not None:
            rows = rows.join(table.select("frame_id", *[c for c, t in kinds.items() if t is table]), "frame_id", "left")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c, t in kinds.items() if t is None})
    moved = F.col("track_id").isNotNull()
    told = reason(rows.withColumns({"extra_km": F.round(F.greatest(F.lit(0.0), F.col("l2") - F.col("l1")) / 1000, 3), "mean_trav": F.coalesce("mean_trav", F.lit(mean_trav)), "max_slope": F.coalesce("max_slope", F.lit(max_slope))}), cfg)
    return told.select("frame_id", F.when(moved, "alternative").otherwise("primary").alias("selected"), F.when(moved, F.col("alternative_risk")).otherwise(F.col("r1")).alias("risk"), F.col("eta"), "extra_km", "track_id", "t_conflict", "reason")


def decision_log(frames: DataFrame, by: list[str], order: list[str], fields: list[str], beat: int = 60) -> DataFrame:
    """The frames to record: every change of the fields, as which the first frame counts, and a heartbeat every ``beat`` frames."""
    w = Window.partitionBy(*by).orderBy(*order)
    now, before = F.struct(*fields), F.lag(F.struct(*fields)).over(w)
    new = before.isNull() | ~before.eqNullSafe(now)
    rows = frames.withColumn("frame_idx", F.row_number().over(w) - 1).withColumn("changed", new)
    return rows.where((F.col("frame_idx") % beat == 0) | F.col("changed"))
