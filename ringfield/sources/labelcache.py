"""Label cache: predicted labels of whole frames in append-only parts, with an index of positions and offsets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cells import kept

VERSION = 1
#: Frames of one part: what a build that dies has to do again at most.
PART_FRAMES = 1000
INDEX_DDL = "part int, place int, key string, n_points long, inner_offset long, file string"


class LabelCache:
    """The cache below a folder of any store of the cluster.

    ``parts/<k>`` is a Parquet table of (key, labels), one byte a point; ``index/<k>`` has for each frame of part k its place, number of points and offset in the part,
    and is written after it: a part without an index does not count and is written anew. Positions and offsets over
    the whole cache are prefix sums over the parts, one small row each. ``meta`` names version, mode and model.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def parts(self) -> list[int]:
        """Numbers of the whole parts."""
        if not self.fs.exists(self._place("index")):
            return []
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(self._place("index")) if self.fs.exists(self._place(f"index/{f.getPath().getName()}/_SUCCESS")))

    def meta(self) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first()[0]) if self.fs.exists(self._place("meta/_SUCCESS")) else None

    def index(self) -> DataFrame:
        """All frames: position, key, offset, n_points, part and file; offsets follow the order of the parts."""
        numbers = self.parts()
        if not numbers:
            return self.spark.createDataFrame([], "position long, key string, offset long, n_points long, part int, file string")
        rows = self.spark.read.schema(INDEX_DDL).parquet(*[f"{self.path}/index/{k}" for k in numbers])
        order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
        totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("frames"), F.sum("n_points").alias("points"))
        before = totals.select("part", F.coalesce(F.sum("frames").over(order), F.lit(0)).alias("frames"), F.coalesce(F.sum("points").over(order), F.lit(0)).alias("points"))
        return rows.join(F.broadcast(before), "part").select((F.col("frames") + F.col("place")).alias("position"), "key", (F.col("points") + F.col("inner_offset")).alias("offset"), "n_points", "part", "file")

    def build(self, frames: DataFrame, segment: Callable[[DataFrame], DataFrame], mode: str, model: str = "", per_part: int = PART_FRAMES) -> int:
        """Add the labels of all frames (key, n_points, file) that the cache lacks; returns how many were added.

        ``segment`` gets some of the frames and gives (key, labels), labels binary with one byte a point. Frames are taken in order of their keys, ``per_part`` to a part; each part
        is committed alone, so a build that was killed goes on where it stopped. Another mode than the cache's, labels of another length than the frame's
        points, frames without labels and keys that occur twice are errors, and the part is not committed.
        """
        have = self.meta()
        if have is not None and (have["mode"], have["version"]) != (mode, VERSION):
            raise ValueError(f"{self.path} holds labels of mode {have['mode']!r}, version {have['version']}; not extended with {mode!r}, version {VERSION}")
        if have is None:
            text = json.dumps({"version": VERSION, "mode": mode, "model": model})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        # Kept, as every part takes its frames from it: else a build of many parts would compute the frames for each anew.
        todo, added = kept(frames.select("key", "n_points", "file").join(self.index().select("key"), "key", "left_anti")), 0
        last = None
        while True:
            some = todo if last is None else todo.where(F.col("key") > last)
            keys = [r["key"] for r in some.select("key").orderBy("key").limit(per_part).collect()]  # a bounded top-k
            if not keys:
                return added
            last = keys[-1]
            if len(set(keys)) != len(keys):
                raise ValueError("a frame's key occurs twice")
            slice_ = some.where(F.col("key") <= last)
            self._commit(slice_, segment(slice_).select("key", "labels"), (self.parts() or [-1])[-1] + 1, len(keys))
            added += len(keys)

    def _commit(self, wanted: DataFrame, labels: DataFrame, part: int, n: int) -> None:
        labels.write.mode("overwrite").parquet(f"{self.path}/parts/{part}")
        got = self.spark.read.schema("key string, labels binary").parquet(f"{self.path}/parts/{part}").select("key", F.octet_length("labels").alias("have"))
        checked = wanted.join(got, "key", "full").select("key", "n_points", "file", "have")
        order = Window.orderBy("key")  # at most ``per_part`` narrow rows
        rows = checked.select(F.lit(part).alias("part"), (F.row_number().over(order) - 1).alias("place"), "key", F.col("n_points").cast("long").alias("n_points"), (F.sum("n_points").over(order) - F.col("n_points")).alias("inner_offset"), "file", "have")
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(draft)
        rows = self.spark.read.parquet(draft)
        wrong = rows.where("NOT have <=> n_points").first()
        count = rows.count()
        if wrong is None and count == n:
            rows.drop("have").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/{part}")
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(draft), True)
        if wrong is not None:
            raise ValueError(f"{wrong['key']}: {wrong['have']} labels for {wrong['n_points']} points")
        if count != n:
            raise ValueError(f"{count} rows of labels for {n} frames")

    def _labels(self, rows: DataFrame) -> DataFrame:
        """Adds the labels to rows of the index; only the parts that they lie in are read, and each length is checked again."""
        numbers = [r["part"] for r in rows.select("part").distinct().collect()]
        if not numbers:
            return rows.withColumn("labels", F.lit(None).cast("binary"))
        table = self.spark.read.schema("key string, labels binary").parquet(*[f"{self.path}/parts/{k}" for k in numbers])
        bad = F.raise_error(F.concat(F.lit("the cache is truncated or stale at "), "key")).cast("binary")
        found = rows.join(table, "key", "left")
        return found.withColumn("labels", F.when(F.octet_length("labels") == F.col("n_points"), F.col("labels")).otherwise(bad))

    def at(self, first: int, last: int) -> DataFrame:
        """The frames at the positions from first to last (inclusive); a position outside is an error."""
        index = self.index()
        if not 0 <= first <= last < index.count():
            raise IndexError(f"positions {first} to {last} of {index.count()} cached frames")
        return self._labels(index.where(F.col("position").between(first, last)))

    def of(self, keys: DataFrame) -> DataFrame:
        """The frames with the given keys (column ``key``); one that the cache lacks is an error that names it."""
        index = self.index()
        lost = keys.join(index, "key", "left_anti").first()
        if lost is not None:
            raise KeyError(f"{lost['key']!r} is not in this cache")
        return self._labels(index.join(keys.select("key").distinct(), "key", "left_semi"))
