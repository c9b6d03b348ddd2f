"""Rasters of known cells only give the same as whole ones; the search of one raster."""

import math

import numpy as np
from pyspark.sql import functions as F

from helpers import SF
from ringfield.operators import cells as O
from ringfield.operators import decision as D
from ringfield.operators import routes
from ringfield.sources.views import pts_wide


def raster_rows(df, *cols):
    return sorted((r.frame_id, r.ix, r.iy, *[r[c] for c in cols]) for r in df.collect())


def sparse_raster(spark, seed=4, share=0.03):
    rng, n = np.random.default_rng(seed), D.raster_size()
    rows = [(f, i, j, float(rng.uniform()), int(rng.integers(0, 5)), int(rng.integers(0, 9))) for f in (1, 2) for i in range(n) for j in range(n) if rng.uniform() < share or (i, j) in ((0, 0), (n - 1, n - 1))]
    return spark.createDataFrame(rows, "frame_id int, ix int, iy int, trav double, class_id int, flags int").cache(), spark.createDataFrame([(1,), (2,), (3,)], "frame_id int")


def test_sparse_raster_equals_the_whole_one(spark):
    known, frames = sparse_raster(spark)
    n = D.raster_size()
    whole = frames.crossJoin(spark.range(n * n).selectExpr(f"cast(id div {n} AS int) AS ix", f"cast(id % {n} AS int) AS iy")).join(known, ["frame_id", "ix", "iy"], "left").select(
        "frame_id", "ix", "iy", F.coalesce("trav", F.lit(0.5)).alias("trav"), F.coalesce("class_id", F.lit(0)).alias("class_id"), F.coalesce("flags", F.lit(0)).alias("flags"))
    assert raster_rows(D.filled(known, frames), "trav", "class_id", "flags") == raster_rows(whole, "trav", "class_id", "flags")
    points = spark.createDataFrame([(1, 3.0, 2.0), (1, 3.1, 2.1), (3, 0.1, -19.9), (3, 99.0, 0.0), (1, 0.1, -19.9)], "frame_id int, x double, y double")
    for block in (False, True):
        sparse = D.track_cost(D.inflate(known, block_obstacles=block, sparse=True), points, sparse=True)
        full = D.track_cost(D.inflate(whole, block_obstacles=block), points)
        assert raster_rows(D.filled(sparse, frames), "trav", "class_id", "flags", "cost") == raster_rows(full, "trav", "class_id", "flags", "cost")
    # Cells of a frame that is not asked for and rows that meet twice.
    twice = known.union(known.where("ix = 0 AND iy = 0"))
    assert D.filled(twice, frames.where("frame_id > 1")).count() == 2 * n * n + 1


def test_analysis_among_some_cells_is_that_of_the_whole_map(spark):
    c = O.cell_map(pts_wide(spark, SF))
    some = D.raster_cells(spark)
    part = O.analyse(c, among=some).select("frame_id", "cell_id", "reference", "jump", "slope", "clearance", "flags")
    want = O.analyse(c).select(*part.columns).join(some.select("cell_id").distinct(), "cell_id", "left_semi").select(*part.columns)
    got = part.collect()
    assert len(got) > 100 and sorted(map(tuple, got), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_one_search_equals_the_relaxed_distances(spark):
    """Costs with many ties, closed cells, a goal out of reach and a closed one, against relaxation until nothing changes."""
    rng, n = np.random.default_rng(3), 24
    for share in (0.0, 0.3, 0.9):
        cost = np.where(rng.uniform(size=(n, n)) < 0.5, 0.5, np.round(rng.uniform(0, 0.9, (n, n)), 1))
        cost[rng.uniform(size=(n, n)) < share] = 1.0
        start, goal = 12, (n - 1) * n + 12
        cost.flat[goal] = 0.5
        dist = np.full((n + 2, n + 2), np.inf)
        dist[1, 13] = 0.0
        while True:
            best = dist.copy()
            for dx, dy in routes.AROUND:
                step = np.where(cost < 1, math.hypot(dx, dy) * (1 + cost), np.inf)
                best[1:-1, 1:-1] = np.minimum(best[1:-1, 1:-1], dist[1 - dx : n + 1 - dx, 1 - dy : n + 1 - dy] + step)
            if (best == dist).all():
                break
            dist = best
        found = routes.searched(cost, start, goal)
        if not np.isfinite(dist[n, 13]):
            assert found is None
            continue
        cells, far = found
        assert cells[0] == start and cells[-1] == goal and far[-1] == dist[n, 13] and all(d == dist[c // n + 1, c % n + 1] for c, d in zip(cells, far, strict=True))
        assert all(max(abs(a // n - b // n), abs(a % n - b % n)) == 1 for a, b in zip(cells, cells[1:], strict=False))
    cost.flat[goal] = 1.0
    assert routes.searched(cost, start, goal) is None


def test_routes_of_frames_without_known_cells(spark):
    known, frames = sparse_raster(spark, 9, 0.05)
    cost = known.select("frame_id", "ix", "iy", F.col("trav").alias("cost"))
    got = {(r.frame_id, r.kind): r for r in routes.plan_routes(cost, frames=frames, unknown=0.5).collect()}
    assert len(got) == 6 and got[3, "primary"].cost == 80.0 and got[3, "alternative"].length == got[3, "primary"].length
    assert got[1, "primary"].cost < 80.0
