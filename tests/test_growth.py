"""Steps that grew faster than their input: votes in a range image, clusters of many tiles, the label cache, leaks between splits."""

import math

import numpy as np

from helpers import SF
from ringfield.config import DEFAULT
from ringfield.operators import clusters
from ringfield.operators import images as I
from ringfield.operators import iterative as S
from ringfield.queries import QUERIES
from ringfield.sources.labelcache import LabelCache


def test_votes_by_brute_force(spark):
    """Pixels at the borders of tiles and of the image, empty and crowded windows, a point without any pixel around."""
    rng = np.random.default_rng(1)
    image = {(f, int(y), int(x)): (round(float(rng.uniform(1, 3)), 6), int(rng.integers(0, 5))) for f in (0, 1) for y, x in rng.integers(0, 30, (250, 2))}
    image[0, 63, 2047] = (2.0, 3)
    points = [(k, f, round(float(rng.uniform(1, 3)), 6), int(y), int(x)) for k, (f, y, x) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 31, 300), rng.integers(0, 31, 300), strict=True))]
    points = [(k, int(f), r, y, x) for k, f, r, y, x in points] + [(1000, 0, 2.1, 63, 2047), (1001, 0, 2.1, 50, 1000)]
    want = {}
    for k, f, own, y, x in points:
        near = sorted((round(abs(image[f, y + a, x + b][0] - own), 9), a, b, image[f, y + a, x + b][1]) for a in range(-2, 3) for b in range(-2, 3) if (f, y + a, x + b) in image)
        if not near:
            continue
        votes = [0.0] * 5
        for d, _, _, c in near[: DEFAULT.knn]:
            votes[c] += math.exp(-d * d / 2) if d <= DEFAULT.knn_cutoff else 0.0
        votes = [round(v, 9) for v in votes]
        want[k] = votes.index(max(votes)) if max(votes) > 0 else image.get((f, y, x), (0, 0))[1]
    table = spark.createDataFrame([(f, y, x, r, c) for (f, y, x), (r, c) in image.items()], "frame_id int, py int, px int, range double, cls int")
    found = I.knn_vote(spark.createDataFrame(points, "k int, frame_id int, range double, py int, px int"), table, ["k"])
    assert {r.k: r.vote for r in found.collect()} == want and 1001 not in want
    # A pixel goes to the tiles in reach, about two, not to every pixel of its window.
    assert "py#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Generate") == 2


def test_clusters_of_many_tiles_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    xyz = rng.uniform(-30, 30, (500, 2))
    rows = spark.createDataFrame([(f, i, *map(float, p)) for f in (0, 1, 2) for i, p in enumerate(xyz[f * 100 :])], "frame_id int, id long, x double, y double").repartition(3)
    roots = lambda: sorted((r.frame_id, r.id, r.root) for r in clusters.cluster_roots(rows, 1.5).collect())
    at_once = roots()
    monkeypatch.setattr(clusters, "ROWS", 5)
    assert roots() == at_once
    apart = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    a, b = np.nonzero((apart <= 1.5**2) & (apart > 0))
    assert [r for f, _, r in at_once if f == 0] == clusters.union(a, b, 500).tolist()


def test_nearest_of_crowded_points_come_from_a_part_of_the_radius(monkeypatch):
    rng = np.random.default_rng(11)
    xyz = np.vstack([rng.normal(0, 0.2, (600, 3)).round(2), rng.uniform(-4, 4, (200, 3))])
    ids, tile, looked = rng.permutation(800), np.zeros(800, np.int64), []
    whole = clusters._pairs
    monkeypatch.setattr(clusters, "_pairs", lambda *a: looked.append((a[3], len(a[1]))) or whole(*a))
    got = set(zip(*(k.tolist() for k in clusters.links(xyz, np.arange(800), ids, 0.5, 16, tile)), strict=True))
    assert got == set(zip(*(k.tolist() for k in whole(xyz, np.arange(800), ids, 0.5, 16, tile)), strict=True))
    assert [r for r, _ in looked] == [0.125, 0.25, 0.5] and looked[2][1] < 400


def test_gated_pairs_are_all_pairs_within(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-40, 40, (200, 2)), rng.uniform(-40, 40, (150, 2))
    got = set(S.within(a, b, 4.0))
    apart = np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1])
    assert set(zip(*(k.tolist() for k in np.nonzero(apart <= 4.0)), strict=True)) <= got and len(got) < 600
    assert S.within(a[:0], b, 4.0) == [] == S.within(a, b[:0], 4.0)


def test_a_build_of_many_parts_computes_its_frames_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    frames = spark.range(6).selectExpr("format_string('%02d', id) AS key", "2L AS n_points", "'f' AS file").mapInPandas(run, "key string, n_points long, file string")
    cache = LabelCache(spark, f"file://{tmp_path}/labels")
    assert cache.build(frames, lambda f: f.selectExpr("key", "unhex('0104') AS labels"), "test", per_part=2) == 6
    assert seen.value == 6 and cache.index().count() == 6


def test_a_leak_between_splits_keeps_no_frames(spark):
    plan = QUERIES["split_leak_intersect"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("o_orderkey" in line or "frame_id" in line for line in grouped)
