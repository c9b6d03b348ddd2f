"""Segmenters: a model over range images, labels from a cache, and what is taken when either is missing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfield.functions.labels import CLASS_OF_LEARNING
from ringfield.operators import segmenters as S
from ringfield.operators.images import MEANS, STDS, depth_test, knn_vote, pixels
from ringfield.sources.labelcache import LabelCache


def cloud(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [(f, k, float(a), float(b), float(c), float(i)) for f in (0, 4) for k, (a, b, c, i) in enumerate(zip(rng.uniform(-30, 30, n), rng.uniform(-30, 30, n), rng.uniform(-2, 1, n), rng.uniform(0, 1, n), strict=True))]
    return spark.createDataFrame(rows, "frame_id int, point_id long, x double, y double, z double, intensity double")


def loader():
    # Made in a function, so that it reaches the workers by value: they cannot import the tests.
    def by_height(path):
        """A stand-in for a network: the learning id follows the height in steps of the file's number; every load leaves a line."""
        step, marks = open(path).read().split()
        with open(os.path.join(marks, str(os.getpid())), "a") as f:
            f.write("x")

        def scores(image):
            z = image[0, 3] * STDS[3] + MEANS[3]
            ids = np.clip(np.floor((z + 2) / float(step)), 0, 19).astype(int)
            return (np.arange(20)[None, :, None, None] == ids[None, None]).astype(np.float32)

        return scores

    return by_height


def test_model_votes_and_is_loaded_once_a_worker(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    (tmp_path / "height.model").write_text(f"0.15 {marks}")
    p = cloud(spark)
    model = S.choose(spark, "live", str(tmp_path / "height.model"), load=loader())
    assert model.mode == "live"
    for _ in range(2):
        got = {(r.frame_id, r.point_id): r.cls for r in model(p).collect()}
    rows = pixels(p)
    ids = F.least(F.greatest(F.floor((F.col("z").cast("float") + 2) / 0.15), F.lit(0)), F.lit(19)).cast("int")
    image = depth_test(rows, ["point_id"]).withColumn("cls", F.get(F.array(*map(F.lit, CLASS_OF_LEARNING)), ids))
    want = {(r.f, r.point_id): r.vote for r in knn_vote(rows.withColumn("f", F.col("frame_id")), image.select("frame_id", "py", "px", "range", "cls"), ["f", "point_id"]).collect()}
    assert len(got) == 1200 and set(got) == set(want) and sum(got[k] != want[k] for k in got) <= 2 and len(set(got.values())) == 5
    assert all(len(f.read_text()) == 1 for f in marks.iterdir())


def test_a_missing_model_or_cache_gives_geometric_labels(spark, tmp_path):
    p = cloud(spark, 80)
    want = sorted(map(tuple, S.Geometric()(p).collect()))
    for got in (S.choose(spark, "live", str(tmp_path / "none.onnx")), S.choose(spark, "live"), S.choose(spark, "cached", cache=LabelCache(spark, str(tmp_path / "none")))):
        assert got.mode == "geometric"
    assert sorted(map(tuple, got(p).collect())) == want and len(want) == 160
    with pytest.raises(ValueError, match="unknown mode"):
        S.choose(spark, "other")


def test_cached_labels_by_the_place_of_the_point(spark, tmp_path):
    p = cloud(spark, 50)
    cache = LabelCache(spark, str(tmp_path / "cache"))
    frames = p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_points")).select(F.format_string("s/%06d", "frame_id").alias("key"), "n_points", F.lit("f").alias("file"))
    labels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_points").cast("int") - 1), lambda k: F.concat(F.lit("0"), (k % 5).cast("string"))), ""))
    cache.build(frames, lambda f: f.select("key", labels.alias("labels")), "network")
    cached = S.choose(spark, "cached", cache=cache, key=lambda f: F.format_string("s/%06d", f))
    assert cached.mode == "cached" and sorted(map(tuple, cached(p).collect())) == [(f, k, k % 5) for f in (0, 4) for k in range(50)]
    with pytest.raises(Exception, match="no label for point 50"):
        cached(p.union(p.where("point_id = 0").withColumn("point_id", F.lit(50).cast("long")))).collect()
    with pytest.raises(KeyError):
        cached(p.withColumn("frame_id", F.lit(9)))
