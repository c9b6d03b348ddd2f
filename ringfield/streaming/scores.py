"""Scores of a stream: confusion counts of all points so far, stored and merged once for every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.metrics import confusion


def _total(path: str, batch: int) -> str:
    return f"{path}/totals/{batch:019d}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def score_stream(points: DataFrame, path: str, by: list[str] | None = None, truth: str = "cls", pred: str = "pred") -> DataStreamWriter:
    """A writer that keeps the counts of truth and prediction of a stream of labelled points below ``path`` (any store of the cluster).

    Batch n adds its counts to those stored after batch n - 1 and writes them under its own number, so a batch that runs again finds the same
    counts before it and writes the same ones after it. Only the last two totals stay; a total has at most 25 rows for each value of
    ``by``. Start it as it is: the checkpoint lies beside the totals.
    """
    keys = [*(by or []), "truth", "pred"]

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        counts = confusion(batch, by, truth, pred)
        if n > 0:
            counts = spark.read.schema(counts.schema).parquet(_total(path, n - 1)).unionByName(counts).groupBy(*keys).agg(F.sum("n").alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(_total(path, n))
        fs, old = _folder(spark, _total(path, n - 2))
        if n > 1 and fs.exists(old):
            fs.delete(old, True)

    return points.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint")


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last whole batch; ``iou`` and ``miou`` take them as they are."""
    fs, place = _folder(spark, f"{path}/totals")
    done = sorted(f.getPath().getName() for f in fs.listStatus(place) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    if not done:
        raise FileNotFoundError(f"{path} has no whole batch yet")
    return spark.read.parquet(f"{path}/totals/{done[-1]}")
