"""Planes, clusters, routes, quantiles and the map for frames of any size, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF
from ringfield.config import DEFAULT
from ringfield.operators import cells as O
from ringfield.operators import clusters, iterative, planes, quantiles, routes
from ringfield.sources.views import pts_dense


def cloud(seed, n=4000, slope=0.0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-25, 25, (n, 2))
    ground = np.column_stack([xy, slope * xy[:, 0] - 1.7 + rng.normal(0, 0.01, n)])
    return np.vstack([ground, np.column_stack([rng.uniform(-20, 20, (n // 8, 2)), rng.uniform(-1, 3, n // 8)])])


def frame_rows(spark, clouds):
    return spark.createDataFrame([(f, *map(float, p)) for f, c in clouds.items() for p in c], "frame_id int, x double, y double, z double")


def test_planes_equal_the_fit_in_memory(spark):
    clouds = {f: cloud(f, slope=0.03 * f) for f in range(3)}
    clouds[7] = np.zeros((2, 3))  # too few
    clouds[8] = np.column_stack([np.linspace(0, 5, 50), np.zeros(50), np.zeros(50)])  # a line spans no plane
    clouds[9] = np.tile([[1.0, 2.0, 3.0]], (40, 1))
    got = {r.frame_id: r for r in planes.ransac_planes(frame_rows(spark, clouds).repartition(5)).collect()}
    assert sorted(got) == [0, 1, 2]
    for f in range(3):
        n, d, inside = iterative.fit_plane(clouds[f])
        assert np.allclose([got[f].nx, got[f].ny, got[f].nz], n, atol=1e-9) and abs(got[f].d - d) < 1e-9 and got[f].inliers == inside


def test_votes_and_refit_by_brute_force(spark, monkeypatch):
    pts = cloud(5, 600)
    near = pts[np.hypot(pts[:, 0], pts[:, 1]) < DEFAULT.fit_radius]
    table = frame_rows(spark, {0: pts}).where("x * x + y * y < 900")
    h = np.array([(p.nx, p.ny, p.nz, p.d) for p in planes.hypotheses(table).first().h])
    assert 0 < len(h) <= DEFAULT.iterations and np.allclose(np.linalg.norm(h[:, :3], axis=1), 1) and (h[:, 2] >= math.cos(math.radians(DEFAULT.max_tilt_deg))).all()
    k = int((np.abs(near @ h[:, :3].T + h[:, 3]) <= DEFAULT.ground_tol).sum(axis=0).argmax())
    inside = near[np.abs(near @ h[k, :3] + h[k, 3]) <= DEFAULT.ground_tol]
    n = np.linalg.svd(inside - inside.mean(axis=0), full_matrices=False)[2][2]
    got = planes.ransac_planes(frame_rows(spark, {0: pts})).first()
    assert np.allclose([got.nx, got.ny, got.nz], n * np.sign(n[2]), atol=1e-9)
    # With fewer scored points than there are, the votes are a drawn share of all, and the plane is about the same.
    monkeypatch.setattr(planes, "SCORED", 200)
    again = planes.ransac_planes(frame_rows(spark, {0: pts})).first()
    assert np.allclose([again.nx, again.ny, again.nz], n * np.sign(n[2]), atol=0.01)


def test_plane_of_odd_tables(spark):
    empty = frame_rows(spark, {0: cloud(1, 40)}).limit(0)
    assert planes.ransac_planes(empty).count() == 0
    odd = frame_rows(spark, {0: cloud(1, 400)}).union(spark.createDataFrame([(0, None, 1.0, 1.0), (0, 1.0, 1.0, None)], "frame_id int, x double, y double, z double"))
    assert planes.ransac_planes(odd).first().inliers > 380


def roots_by_brute_force(xyz, radius, nearest):
    apart = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    a, b = [], []
    for i in range(len(xyz)):
        js = sorted((j for j in range(len(xyz)) if j != i and apart[i, j] <= radius * radius), key=lambda j: (apart[i, j], j))[:nearest]
        a += [i] * len(js)
        b += js
    return clusters.union(np.array(a, int), np.array(b, int), len(xyz)).tolist()


@pytest.mark.parametrize(("most", "nearest"), [(50_000, None), (60, None), (60, 3)])
def test_clusters_across_tiles(spark, monkeypatch, most, nearest):
    """A snake through all tiles, a blob in one and points strewn about; with small tiles too."""
    monkeypatch.setattr(clusters, "MOST", most)
    rng = np.random.default_rng(2)
    t = np.linspace(0, 12, 300)
    xyz = np.vstack([np.column_stack([np.linspace(-20, 20, 300), 8 * np.sin(t), 0 * t]), rng.uniform(-12, 12, (400, 3)) * [1, 1, 0.1], rng.normal(0, 0.4, (200, 3))])
    rows = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)] + [(1, 5, 0.0, 0.0, 0.0), (1, 6, None, 0.0, 0.0)], "frame_id int, id long, x double, y double, z double")
    found = clusters.cluster_roots(rows.repartition(4), 0.5, nearest).collect()
    assert len(found) == len(xyz) + 2
    got = {(r.frame_id, r.id): r.root for r in found}
    assert [got[0, i] for i in range(len(xyz))] == roots_by_brute_force(xyz, 0.5, nearest) and got[1, 5] == 5 and got[1, 6] == 6
    spread = clusters.tiled(rows.where("frame_id = 0"), 0.5)
    assert spread.where("home").count() == len(xyz)
    if most == 60:
        assert spread.groupBy("tile").count().count() > 40
    assert clusters.cluster_roots(rows.limit(0), 0.5).count() == 0


def test_distances_equal_the_search_in_memory(spark):
    rng, n = np.random.default_rng(1), 70
    grids = []
    for f, share in enumerate((0.0, 0.25, 0.6)):
        c = rng.uniform(0, 0.9, (n, n))
        c[rng.uniform(size=(n, n)) < share] = 1.0
        if f == 1:
            c[35, : n - 1] = 1.0  # a wall with one gap, which an open border reaches
            c[0], c[n - 1], c[:, n - 1] = 0.2, 0.2, 0.2
        grids.append(c)
    rows = spark.createDataFrame([(f, i, j, float(c[i, j])) for f, c in enumerate(grids) for i in range(n) for j in range(n) if (i, j) != (3, 3)], "frame_id int, ix int, iy int, cost double")
    found = routes.distances(rows, (0, 35), n)
    got = {(r.frame_id, r.cell): r.dist for r in found.collect()}
    assert len(got) == 3 * n * n
    length = lambda c, p: sum(math.hypot(b[0] - a[0], b[1] - a[1]) * (1 + c[b]) for a, b in zip(p, p[1:], strict=False))
    for f, c in enumerate(grids):
        c[3, 3] = 0.0  # the raster lacks it
        for x, y in [*rng.integers(0, n, (25, 2)).tolist(), [n - 1, 35]]:
            path = iterative.shortest(c, (0, 35), (x, y))
            assert got[f, x * n + y] == pytest.approx(math.inf if path is None else length(c, path), abs=1e-9)
    way = {}
    for r in routes.way_back(found, (n - 1) * n + 35).collect():
        way.setdefault(r.frame_id, []).append((r.dist, divmod(r.cell, n)))
    for f, cells in way.items():
        path = [p for _, p in sorted(cells)]
        assert path[0] == (0, 35) and path[-1] == (n - 1, 35) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:], strict=False))
        assert length(grids[f], path) == pytest.approx(got[f, (n - 1) * n + 35], abs=1e-9)
    assert 0 in way and 1 in way


def test_routes_without_a_way_and_without_rows(spark):
    n = 160
    wall = spark.range(n * n).select(F.lit(4).alias("frame_id"), F.floor(F.col("id") / n).cast("int").alias("ix"), (F.col("id") % n).cast("int").alias("iy")).withColumn("cost", F.when(F.col("ix") == 80, 1.0).otherwise(0.0))
    got = {r.kind: r for r in routes.plan_routes(wall).collect()}
    assert got["primary"].length == 39.75 and got["primary"].cost == 1.0 and got["primary"].waypoints[-1] == [39.875, 0.125]
    assert got["alternative"].waypoints[0] == [0.125, 2.125] and got["alternative"].eta == 5.0
    assert routes.plan_routes(wall.limit(0)).count() == 0


def test_quantiles_equal_percentile(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 7).cast("string"))).alias("g"),
                                    F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(300)) / 7).alias("v"))
    rows = rows.union(spark.createDataFrame([("none", None), ("one", 2.5)], "g string, v double"))
    got = {r.g: (r.a, r.b, r.c, r.d) for r in quantiles.exact_quantiles(rows.repartition(6), "g", "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    want = {r.g: tuple(r.p) for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.5, 0.95, 1.0)))).alias("p")).collect() if r.p}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert quantiles.exact_quantiles(rows.limit(0), "g", "v", {"a": 0.5}).count() == 0


def test_the_map_does_not_depend_on_the_order_of_points(spark):
    p = pts_dense(spark, SF.replace("0.001", "0.01")).select("frame_id", "x", "y", "z", "cls", "moving")
    rows = [sorted(map(tuple, O.cell_map(q).select("frame_id", "cell_id", "gz", "gzz_high", "gzz_low", "roughness", "z_ground", "confidence").collect())) for q in (p.coalesce(1), p.repartition(8), p.orderBy(F.desc("z")))]
    assert rows[0] == rows[1] == rows[2] and len({r[5] for r in rows[0]}) > 100


def test_the_first_frame_is_a_change(spark):
    from ringfield.operators.decision import decision_log

    e = spark.createDataFrame([(1, k, "a" if k < 70 else "b", "r" if k < 75 else "s") for k in range(130)] + [(2, 0, None, None)], "u int, t int, selected string, reason string")
    got = [(r.u, r.frame_idx, r.changed) for r in decision_log(e, ["u"], ["t"], ["selected", "reason"]).orderBy("u", "frame_idx").collect()]
    assert got == [(1, 0, True), (1, 60, False), (1, 70, True), (1, 75, True), (1, 120, False), (2, 0, True)]
