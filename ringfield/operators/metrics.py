"""Scores: range bins, confusion and IoU, recall, latency, occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .quantiles import exact_quantiles


def range_bin(r: Column, cfg: Config = DEFAULT) -> Column:
    """Half-open bins, the last one closed; -1 outside."""
    b = cfg.range_bins
    out = F.when((r >= b[-2]) & (r <= b[-1]), len(b) - 2)
    for k in range(len(b) - 2):
        out = out.when((r >= b[k]) & (r < b[k + 1]), k)
    return out.otherwise(-1)


def confusion(points: DataFrame, by: list[str] | None = None, truth: str = "cls", pred: str = "pred") -> DataFrame:
    """Counts of truth and prediction; such tables add up across scans."""
    return points.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def iou(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Intersection over union of every class; rows with VOID truth are left out, VOID predictions count as misses.

    Null where a class occurs in neither truth nor prediction.
    """
    by = by or []
    scored = conf.where("truth <> 0")
    part = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    wide = scored.groupBy(*by).agg(*[part((F.col("truth") == k) & (F.col("pred") == k), f"tp{k}") for k in range(5)], *[part((F.col("truth") == k) | (F.col("pred") == k), f"any{k}") for k in range(5)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(f"tp{k}").alias("tp"), F.col(f"any{k}").alias("any")) for k in range(5)])).alias("e")
    return wide.select(*by, each).select(*by, "e.cls", F.col("e.tp").alias("tp"), F.col("e.any").alias("n_any"), F.round(F.try_divide(F.col("e.tp"), F.col("e.any")), 6).alias("iou"))


def miou(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean IoU over the classes but VOID, accuracy over the same rows, and the number of scored points."""
    by = by or []
    per = iou(conf, by).withColumn("raw_iou", F.try_divide(F.col("tp"), F.col("n_any")))
    mean = per.where("cls <> 0").groupBy(*by).agg(F.round(F.avg("raw_iou"), 6).alias("miou"))
    acc = conf.where("truth <> 0").groupBy(*by).agg(F.round(F.try_divide(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")), 6).alias("accuracy"), F.sum("n").alias("n_scored"))
    return mean.join(acc, by) if by else mean.crossJoin(F.broadcast(acc))


def object_recall(points: DataFrame, min_points: int = 5, share: float = 0.5) -> DataFrame:
    """Recall of objects: overall, by range bin and by class, from two levels of grouping.

    An object is an instance of a STATIC or DYNAMIC class in a frame; with fewer points it is only counted as
    dropped. It is recalled if its class is predicted on at least half of its points. Its bin is the
    truncated median of its points' bins.
    """
    objects = points.where("cls IN (3, 4) AND instance <> 0").groupBy("frame_id", "cls", "instance").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("cls")).alias("hit"), F.median("range_bin").cast("int").alias("bin"))
    big = F.col("n") >= min_points
    flat = objects.withColumn("sets", F.explode(F.array(F.struct(F.lit("overall").alias("block"), F.lit(0).alias("item")), F.struct(F.lit("bin").alias("block"), F.col("bin").alias("item")), F.struct(F.lit("class").alias("block"), F.col("cls").alias("item")))))
    return flat.groupBy(F.col("sets.block").alias("block"), F.col("sets.item").alias("item")).agg(
        F.count_if(big).alias("n_objects"), F.count_if(~big).alias("n_dropped"), F.count_if(big & (F.col("hit") / F.col("n") >= share)).alias("n_recalled"),
        F.round(F.try_divide(F.count_if(big & (F.col("hit") / F.col("n") >= share)).cast("double"), F.count_if(big)), 6).alias("recall"),
    )


def latency(samples: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Count, mean, exact median and 95th percentile, greatest and least of each group; groups may have any number of rows."""
    v = F.col(value)
    plain = samples.groupBy(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.max(v), 6).alias("max"), F.round(F.min(v), 6).alias("min"))
    exact = exact_quantiles(samples, by, value, {"median": 0.5, "p95": 0.95}).select(F.col(by).alias("g__"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))
    return plain.join(exact, F.col(by).eqNullSafe(F.col("g__")), "left").select(by, "n", "mean", "median", "p95", "max", "min")


def after_warmup(samples: DataFrame, by: str, order: list[str], most: int = 5) -> DataFrame:
    """Without the first min(most, n // 10) samples of every sequence.

    The dropped samples are the smallest few of their sequence by order, so they come from a bounded top-k (a ranked
    window with a limit), and the counts from an aggregate: no sequence is sorted as a whole.
    """
    counts = samples.groupBy(by).agg(F.least(F.lit(most), F.floor(F.count(F.lit(1)) / 10)).cast("int").alias("drop__"))
    first = samples.withColumn("k__", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("k__") <= most)
    gone = first.join(counts, by).where(F.col("k__") <= F.col("drop__")).select(by, *order)
    return samples.join(gone, [by, *order], "left_anti")


def spread(values: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    return values.groupBy(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.try_divide(100 * F.stddev_samp(v), F.avg(v)), 6).alias("percent"))


def inverse_frequency(points: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Class weights: 1/(share + eps), divided by the mean of all classes, VOID 0."""
    counts = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    all_ = F.broadcast(points.sparkSession.range(5).select(F.col("id").cast("int").alias("cls"))).join(counts, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
    total = Window.partitionBy()  # five rows
    w = F.when(F.col("cls") == 0, 0.0).otherwise(1 / (F.col("n") / F.sum("n").over(total) + eps))
    return all_.select("cls", "n", w.alias("w")).select("cls", "n", F.round(F.col("w") / F.avg(F.when(F.col("cls") != 0, F.col("w"))).over(total), 6).alias("weight"))


def occupancy(points: DataFrame, by: list[str], cell: float = 0.05, r_max: float = 100.0, low: float = -2.0, high: float = 8.0) -> DataFrame:
    """Distinct 5 cm columns and, in the height band, distinct 5 cm voxels within the envelope."""
    ix, iy, iz = (F.floor(c / F.lit(cell)) for c in (F.col("x"), F.col("y"), F.col("z") - low))
    inside = points.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= r_max**2)
    band = (F.col("z") >= low) & (F.col("z") < high)
    return inside.groupBy(*by).agg(F.count_distinct(ix, iy).alias("uniform"), F.count_distinct(F.when(band, ix), F.when(band, iy), F.when(band, iz)).alias("voxel"))


def unaccounted(times: DataFrame, by: str, stage: str = "stage", ms: str = "ms", whole: str = "frame") -> DataFrame:
    """Time of each frame that its stages do not explain; null where the frame's own time is missing."""
    is_whole = F.col(stage) == whole
    return times.groupBy(by).agg((F.sum(F.when(is_whole, F.col(ms))) - F.coalesce(F.sum(F.when(~is_whole, F.col(ms))), F.lit(0.0))).alias("unaccounted"))
