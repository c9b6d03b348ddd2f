"""From points to the 2.5D map: accumulate, finalise, neighbours, flags."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DYNAMIC, LOW_CONF, MOVING, NEG_OBSTACLE, OCCUPIED, OVERHANG, REFINED, STEP, VOID_UNOBSERVED, Config
from ..functions.grid import neighbours, project, ring_table, rings

KEY = ["frame_id", "cell_id"]


def accumulate(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each occupied cell of a frame; a hash aggregate with map-side partial sums, so one shuffle of cells.

    Points need frame_id, x, y, z, cls and moving. Null z counts the point but not its height. Ground heights are summed as whole
    micrometres (``gz``) and their squares in two parts (``gzz`` = high * 2^20 + low), so that no order of the rows or of partial sums changes a result.
    """
    ground = F.col("cls").isin(1, 2)
    g = F.when(ground, F.col("z"))
    um = F.when(ground, F.round(F.col("z") * 1e6).cast("long"))
    square = um * um
    return (
        project(points.where("cls BETWEEN 0 AND 4"), cfg)
        .groupBy("frame_id", "cell_id", "ring", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("z").alias("z_min"), F.max(F.when(~ground, F.col("z"))).alias("z_high"), F.count(g).alias("n_ground"),
            F.min(g).alias("z_low"), F.sum(um).alias("gz"), F.sum(F.shiftright(square, 20)).alias("gzz_high"), F.sum(square.bitwiseAND((1 << 20) - 1)).alias("gzz_low"),
            *[F.count_if(F.col("cls") == k).alias(f"h{k}") for k in range(5)], F.bool_or("moving").alias("moving"),
        )
    )


def finalise(acc: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Heights, roughness, class (lowest id wins ties) and confidence of each cell."""
    low = F.coalesce("z_low", "z_min")
    mean = F.col("gz") / F.col("n_ground")
    squares = F.col("gzz_high") * float(1 << 20) + F.col("gzz_low")
    score = 255 * (0.7 * F.least(F.col("n") / 200.0, F.lit(1.0)) + 0.3 * F.col("n_ground") / F.col("n"))
    hist = [F.col(f"h{k}") for k in range(5)]
    cls = F.lit(4)
    for k in (3, 2, 1, 0):
        cls = F.when(hist[k] == F.greatest(*hist), k).otherwise(cls)
    conf = F.when(F.col("n_ground") == 0, F.least(score, F.lit(80.0))).otherwise(score)
    return acc.withColumns({
        "z_ground": low,
        "z_obstacle": F.when(F.col("z_high").isNotNull(), F.greatest(F.col("z_high"), low)),
        "roughness": F.when(F.col("n_ground") >= 2, F.greatest((squares / F.col("n_ground") - mean * mean) / 1e12, F.lit(0.0))).otherwise(F.lit(0.0)),
        "class_id": cls,
        "confidence": conf.cast("int"),
    })


def cell_map(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return finalise(accumulate(points, cfg), cfg)


def _checkpoints(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; only where none is set and Spark runs on this machine alone, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(table: DataFrame) -> DataFrame:
    """The table computed once for several uses: a checkpoint in the cluster's folder."""
    _checkpoints(table.sparkSession)
    return table.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def ring_medians(cells: DataFrame) -> DataFrame:
    return cells.groupBy("frame_id", "ring").agg(F.median("z_ground").alias("med"), F.count(F.lit(1)).alias("n_occ"))


def _middle(values: Column) -> Column:
    """The median of a short array."""
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def ground_reference(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """For every occupied ring of a frame: the median of the medians of up to nine usable rings around it.

    A ring is usable where enough of its cells are occupied. There are at most 662 rings in a frame, so the windows
    and the arrays of medians are small whatever the number of points.
    """
    bins = F.broadcast(ring_table(cells.sparkSession, cfg).select("ring", "n_bins"))
    med = ring_medians(cells).join(bins, "ring").withColumn("usable", F.col("n_occ") >= F.greatest(F.lit(1), F.ceil(F.lit(cfg.ref_fill) * F.col("n_bins"))))
    frame = Window.partitionBy("frame_id").orderBy("ring")
    whole = frame.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pool = F.collect_list(F.when(F.col("usable"), F.col("med"))).over(whole)
    before = F.coalesce(F.sum(F.col("usable").cast("int")).over(frame.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = med.select("frame_id", "ring", "med", "n_occ", "n_bins", "usable", pool.alias("pool"), before.cast("int").alias("before")).withColumn("w", F.least(F.lit(cfg.ref_rings), F.size("pool")))
    start = F.greatest(F.lit(0), F.least(F.col("before") - F.floor(F.col("w") / 2).cast("int"), F.size("pool") - F.col("w")))
    picked = F.slice(F.col("pool"), start + 1, F.greatest(F.col("w"), F.lit(1)))
    return rows.select("frame_id", "ring", "med", "n_occ", "usable", F.when(F.col("w") > 0, _middle(picked)).otherwise(F.col("med")).alias("reference"))


def neighbour_edges(cells: DataFrame, cfg: Config = DEFAULT, parity: bool = False) -> DataFrame:
    return neighbours(cells.select("frame_id", "cell_id", "ring", "bin"), cfg, parity)


def analyse(cells: DataFrame, cfg: Config = DEFAULT, parity: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Add reference, slope, clearance and the flags to the occupied cells.

    Neighbours come from one equi-join of four keys for each cell with the cells themselves; only occupied
    cells take part, never the whole grid. The cells are kept first: three branches read them. With ``among`` (ring, bin, cell_id, a table to
    broadcast) only these cells come out; their references and neighbours are those of the whole map.
    """
    cells = whole = kept(cells)
    beside = cells
    if among is not None:
        some = among.select("ring", "bin", "cell_id").distinct()
        cells = whole.join(F.broadcast(some.select("cell_id")), "cell_id", "left_semi")
        beside = whole.join(F.broadcast(neighbours(some, cfg, parity).select(F.col("neighbour_id").alias("cell_id")).distinct()), "cell_id", "left_semi")
    other = beside.select("frame_id", F.col("cell_id").alias("neighbour_id"), F.col("z_ground").alias("zn"), F.col("z_obstacle").alias("on"))
    sizes = F.broadcast(ring_table(cells.sparkSession, cfg).select("ring", "s"))
    edge = neighbours(cells.select("frame_id", "cell_id", "ring", "bin", "z_ground"), cfg, parity).join(other, ["frame_id", "neighbour_id"])
    drop = F.abs(F.col("z_ground") - F.col("zn"))
    near = edge.join(sizes, "ring").groupBy(*KEY).agg(F.max(drop).alias("jump"), F.max("on").alias("top"), F.max(F.when(F.col("side") == "next", F.degrees(F.atan(drop / F.col("s"))))).alias("slope"))
    refs = ground_reference(whole, cfg).select("frame_id", "ring", "reference")
    full = cells.join(near, KEY, "left").join(refs, ["frame_id", "ring"]).withColumns({"jump": F.coalesce("jump", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0)), "clearance": F.coalesce("z_obstacle", "top") - F.col("z_ground")})
    step, pit = F.col("jump") > cfg.tau_step, F.col("reference") - F.col("z_ground") > cfg.tau_pothole
    over = (F.col("class_id") == 1) & F.coalesce((F.col("clearance") > 0) & (F.col("clearance") < cfg.height), F.lit(False))
    full = full.withColumns({"step": step, "pit": pit, "overhang": over})
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return full.withColumn("flags", OCCUPIED + bit(F.col("overhang"), OVERHANG) + bit(F.col("pit"), NEG_OBSTACLE) + bit(F.col("step"), STEP) + bit(F.col("moving"), MOVING) + bit(F.col("confidence") < cfg.tau_conf, LOW_CONF)).drop("top")


def void_cells(cells: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The unobserved cells of the given frames, with their flag: the whole grid without the occupied cells."""
    last = rings(cfg)[-1]
    grid = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(last[6] + last[5] - 1))).alias("cell_id"))
    return grid.join(cells.select(*KEY), KEY, "left_anti").withColumn("flags", F.lit(VOID_UNOBSERVED))


def void_by_ring(cells: DataFrame, frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """For every ring of the given frames (each once) with unobserved cells: how many (``n_void``) and the sum of their ids (``id_sum``).

    These are the ring's cells less its occupied ones, of which a frame has no more than points, so the grid itself is never written out.
    """
    occupied = cells.where("frame_id IS NOT NULL").select("frame_id", "ring", "cell_id").distinct().groupBy("frame_id", "ring").agg(F.count(F.lit(1)).alias("seen"), F.sum("cell_id").alias("seen_sum"))
    every = frames.select("frame_id").crossJoin(F.broadcast(ring_table(cells.sparkSession, cfg).select("ring", "offset", "n_bins")))
    n, low = F.col("n_bins").cast("long"), F.col("offset").cast("long")
    void = n - F.coalesce("seen", F.lit(0))
    ids = n * low + F.expr("n_bins * (n_bins - 1L) div 2") - F.coalesce("seen_sum", F.lit(0))
    return every.join(occupied, ["frame_id", "ring"], "left").select("frame_id", "ring", void.alias("n_void"), ids.alias("id_sum")).where("n_void > 0")


def traversability(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A score from 0 to 1 for each analysed cell; low confidence pulls it towards 0.5."""
    part = lambda c, top: F.greatest(F.lit(0.0), F.least(c / F.lit(top), F.lit(1.0)))
    bad = (
        cfg.w_slope * part(F.col("slope"), cfg.max_slope_deg) + cfg.w_rough * part(F.col("roughness"), cfg.max_roughness)
        + cfg.w_step * F.col("step").cast("double") + cfg.w_class * F.when(F.col("class_id") == 1, 0.0).when(F.col("class_id") == 2, 0.5).otherwise(1.0) + cfg.w_overhang * F.col("overhang").cast("double")
    )
    t, c = F.greatest(F.lit(0.0), F.least(1 - bad, F.lit(1.0))), F.col("confidence") / 255.0
    return cells.withColumn("trav", F.when(F.col("confidence") < cfg.tau_conf, t * c + 0.5 * (1 - c)).otherwise(t))


def refine(cells: DataFrame, cfg: Config = DEFAULT, most: int | None = None) -> DataFrame:
    """The far cells worth splitting: moving, rough or steep ones, at most ``most`` of a frame by score (ties by cell)."""
    far = (F.col("ring") >= round(cfg.r_knee / cfg.s_min)) & (F.col("moving") | (F.col("roughness") > cfg.refine_roughness) | (F.col("slope") > cfg.refine_slope))
    score = F.round(F.col("roughness") + F.col("slope") / 10 + F.when(F.col("moving"), 1000.0).otherwise(0.0), 9)
    order = Window.partitionBy("frame_id").orderBy(F.desc("score"), "cell_id")
    picked = cells.where(far).withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return picked.where(F.col("rank") <= (most or cfg.refine_cells))


def quadrants(refined: DataFrame) -> DataFrame:
    """Four children for each refined cell, with the parent's values and flags (the parents themselves get REFINED)."""
    return refined.withColumn("quadrant", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("parent_flags", F.col("flags") + REFINED)


def dynamic_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("class_id") == DYNAMIC)
