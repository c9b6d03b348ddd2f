"""Scan assembly, label cache and document store as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(points: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the labels of their file; points without a label are VOID and the scan says so."""
    has = labels.select("frame_id").distinct().withColumn("has_labels", F.lit(True))
    out = points.join(labels, keys, "left").join(has, "frame_id", "left")
    return out.withColumn("raw", F.coalesce("raw", F.lit(0))).withColumn("has_labels", F.coalesce("has_labels", F.lit(False)))


def first_frames(scans: DataFrame, limit: int, by: str = "sequence", frame: str = "frame_id") -> DataFrame:
    """The scans of the first ``limit`` frames of every sequence; the frames alone are ranked, not their points."""
    frames = scans.select(by, frame).distinct().withColumn("k__", F.row_number().over(Window.partitionBy(by).orderBy(frame))).where(F.col("k__") <= limit)
    return scans.join(frames.select(by, frame), [by, frame], "left_semi")


def still_missing(wanted: DataFrame, cached: DataFrame, mode: str) -> DataFrame:
    """Frames that a resumed cache build has yet to write; a cache of another mode is refused."""
    wrong = cached.where(F.col("mode") != mode).limit(1).count()
    if wrong:
        raise ValueError(f"the cache holds labels of another mode than {mode}")
    return wanted.join(cached, ["sequence", "frame_id"], "left_anti")


def cache_key(sequence: Column, frame: Column) -> Column:
    return F.format_string("%s/%06d", sequence, frame)


def latest_by(versions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert: the latest version of each key, by an aggregate of one struct for each key (no sort)."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max(F.struct(*order, F.struct(*rest).alias("row__"))).alias("m")).select(key, "m.row__.*")


def page(runs: DataFrame, uid: int, limit: int, most: int = 200) -> DataFrame:
    """A user's runs, newest first, at most the clamped limit."""
    return runs.where(F.col("uid") == uid).orderBy(F.desc("started_at"), F.desc("run_id")).limit(max(1, min(limit, most)))
