"""Segmenters: anything that turns a table of points into their classes, and which one is taken."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.labels import CLASS_OF_LEARNING
from .cells import kept
from .images import MEANS, STDS, depth_test, knn_vote, pixels
from .iterative import segment_geometric

log = logging.getLogger(__name__)


class Segmenter(Protocol):
    """From points (frame_id int, point_id long, unique in a frame, x, y, z, intensity) to (frame_id, point_id, cls).

    Every point has one row in the result; ``mode`` says which kind of labels they are.
    """

    mode: str

    def __call__(self, points: DataFrame) -> DataFrame: ...


class Geometric:
    mode = "geometric"

    def __init__(self, cfg: Config = DEFAULT):
        self.cfg = cfg

    def __call__(self, points: DataFrame) -> DataFrame:
        return segment_geometric(points.select("frame_id", "point_id", "x", "y", "z"), "point_id", self.cfg)


class Cached:
    """Labels of a ``LabelCache``: the label of a point is the byte at its ``point_id`` in the entry of its frame."""

    mode = "cached"

    def __init__(self, cache: Any, key: Callable[[Column], Column]):
        self.cache, self.key = cache, key

    def __call__(self, points: DataFrame) -> DataFrame:
        frames = points.select("frame_id").distinct().withColumn("key", self.key(F.col("frame_id")))

        def run(batches):
            for b in batches:
                for frame, labels in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n = len(labels)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), pa.array(np.frombuffer(labels, np.uint8).astype(np.int32))], ["frame_id", "point_id", "found"])

        blobs = self.cache.of(frames.select("key")).select("key", "labels").join(frames, "key").select(F.col("frame_id").cast("int").alias("frame_id"), "labels")
        found = blobs.mapInArrow(run, "frame_id int, point_id long, found int")
        lost = F.raise_error(F.concat(F.lit("the cache has no label for point "), F.col("point_id").cast("string"), F.lit(" of frame "), F.col("frame_id").cast("string"))).cast("int")
        return points.select("frame_id", "point_id").join(found, ["frame_id", "point_id"], "left").select("frame_id", "point_id", F.coalesce("found", lost).alias("cls"))


_MODELS: dict[tuple[str, str], Callable[[np.ndarray], np.ndarray]] = {}


def _loaded(file: str, load: Callable) -> Callable[[np.ndarray], np.ndarray]:
    """The model of this worker."""
    mine = (file, f"{load.__module__}.{load.__qualname__}")
    if mine not in _MODELS:
        _MODELS[mine] = load(SparkFiles.get(file))
    return _MODELS[mine]


def load_onnx(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A network file as a function from [1, 5, rows, columns] to the scores of the 20 learning ids."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda image: session.run(None, {name: image})[0]


class Model:
    """A network over range images: the nearest point of every pixel is shown to it, its classes come back to all points by a vote.

    The file is sent to the workers once (``addFile``) and ``load`` turns it into a function once in each. A task holds one image at a time, whatever
    the number of points in a frame. Learning ids become classes before the vote.
    """

    mode = "live"

    def __init__(self, spark: SparkSession, path: str, load: Callable[[str], Callable[[np.ndarray], np.ndarray]] = load_onnx, cfg: Config = DEFAULT):
        spark.sparkContext.addFile(path)
        self.file, self.load, self.cfg = path.rstrip("/").rsplit("/", 1)[-1], load, cfg

    def image_classes(self, nearest: DataFrame) -> DataFrame:
        """The class of every occupied pixel (frame_id, py, px, range, x, y, z, intensity), with its range."""
        file, load, h, w = self.file, self.load, self.cfg.image_h, self.cfg.image_w
        classes = np.array(CLASS_OF_LEARNING, np.int32)

        def run(group: pa.Table) -> pa.Table:
            model = _loaded(file, load)
            image = np.zeros((1, 5, h, w), np.float32)
            py, px = group.column("py").to_numpy(), group.column("px").to_numpy()
            for k, c in enumerate(("range", "x", "y", "z", "intensity")):
                image[0, k, py, px] = (group.column(c).to_numpy() - MEANS[k]) / STDS[k]
            scores = model(image)
            if scores.shape != (1, len(classes), h, w):
                raise ValueError(f"{file} gives scores of shape {scores.shape}, not {(1, len(classes), h, w)}")
            return group.select(["frame_id", "py", "px", "range"]).append_column("cls", pa.array(classes[scores[0].argmax(axis=0)[py, px]]))

        columns = nearest.select("frame_id", "py", "px", *[F.col(c).cast("double").alias(c) for c in ("range", "x", "y", "z", "intensity")])
        return columns.groupBy("frame_id").applyInArrow(run, "frame_id int, py int, px int, range double, cls int")

    def __call__(self, points: DataFrame) -> DataFrame:
        rows = kept(pixels(points.select("frame_id", "point_id", "x", "y", "z", "intensity"), self.cfg))
        image = self.image_classes(depth_test(rows, ["point_id"]))
        votes = knn_vote(rows.withColumn("frame__", F.col("frame_id")), image, ["frame__", "point_id"], self.cfg)
        return votes.select(F.col("frame__").alias("frame_id"), "point_id", F.col("vote").alias("cls"))


def choose(spark: SparkSession, mode: str, model: str | None = None, cache: Any = None, key: Callable[[Column], Column] | None = None, load: Callable = load_onnx, cfg: Config = DEFAULT) -> Segmenter:
    """The segmenter of a mode: ``geometric``, ``cached`` or ``live``. Without the cache or the model's file it is the geometric one, and its mode says so."""
    if mode == "cached":
        if cache is not None and cache.meta() is not None:
            return Cached(cache, key or (lambda frame: frame.cast("string")))
        log.warning("no label cache: points are segmented geometrically")
    elif mode == "live":
        place = None if model is None else spark._jvm.org.apache.hadoop.fs.Path(model)
        if place is not None and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return Model(spark, model, load, cfg)
        log.warning("no model at %s: points are segmented geometrically", model)
    elif mode != "geometric":
        raise ValueError(f"unknown mode {mode!r}")
    return Geometric(cfg)
