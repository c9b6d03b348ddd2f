import math

import pytest
from pyspark.sql import functions as F

from ringfield.functions import grid as G
from ringfield.functions import labels as L
from ringfield.operators import cells as O


def test_constants():
    rings = G.rings()
    assert len(rings) == 662 and rings[-1][5] + rings[-1][6] == 705_771
    assert len([r for r in rings if r[0] >= 200]) == 462 and sum(r[5] for r in rings if r[0] >= 200) == 580_734
    assert rings[0][5] == 1 and G.n_inner() == 200


def test_ring_edges(spark):
    rows = [(0.0, 0), (-0.1, -1), (100.0, 661), (100.0001, -1), (float("nan"), -1), (float("inf"), -1), (None, -1), (0.049, 0), (0.051, 1), (9.99, 199), (10.02, 200)]
    got = spark.createDataFrame(rows, "r double, want int").select(G.ring_of(F.col("r")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_angles_and_conservation(spark):
    eps = 1e-9
    pts = [(5.0 * math.cos(a), 5.0 * math.sin(a)) for a in (0.0, eps, -eps, math.pi, 2 * math.pi - eps)] + [(0.0, 0.0), (200.0, 0.0)]
    got = G.project(spark.createDataFrame(pts, "x double, y double"), keep_outside=True).collect()
    assert len(got) == 7 and sum(r.cell_id < 0 for r in got) == 1
    n = G.rings()[100][5]
    assert all(0 <= r.bin < max(n, 1) for r in got if r.ring == 100)
    wide = spark.range(20_000).select((F.rand(1) * 240 - 120).alias("x"), (F.rand(2) * 240 - 120).alias("y"))
    inside = wide.where("x * x + y * y <= 10000").count()
    assert G.project(wide).count() == inside


def test_cell_ids_are_unique_and_centres_return(spark):
    cells = spark.createDataFrame([(k, b) for k in (0, 1, 50, 199, 200, 400, 661) for b in (0, 1, 7)], "ring int, bin int").join(G.ring_table(spark), "ring").where("bin < n_bins")
    a = (F.col("bin") + 0.5) / F.col("n_bins") * 2 * F.pi()
    back = G.project(cells.select((F.col("r_centre") * F.cos(a)).alias("x"), (F.col("r_centre") * F.sin(a)).alias("y"), (F.col("offset") + F.col("bin")).alias("want"))).collect()
    assert back and all(r.cell_id == r.want for r in back)


def test_neighbour_of_inner_ring_is_geometric(spark):
    one = spark.createDataFrame([(50, 313, G.rings()[50][6] + 313)], "ring int, bin int, cell_id int")
    got = {r.side: r.neighbour_id for r in G.neighbours(one).collect()}
    assert got["prev"] == G.rings()[49][6] + 307
    assert {r.side: r.neighbour_id for r in G.neighbours(one, parity=True).collect()}["prev"] == G.rings()[49][6] + 11


def test_unknown_label_is_void_and_out_of_range_fails(spark):
    rows = L.with_class(spark.createDataFrame([(7,), (40,), (258,), (None,)], "raw int")).select("cls", "moving").collect()
    assert [tuple(r) for r in rows] == [(0, False), (1, False), (4, True), (0, False)]
    with pytest.raises(Exception, match="out of range"):
        L.with_class(spark.createDataFrame([(260,)], "raw int")).collect()


def test_refine_is_bounded(spark):
    cells = spark.range(10_000).select(F.lit(0).alias("frame_id"), (F.col("id") + 200_000).cast("int").alias("cell_id"), F.lit(300).alias("ring"), F.lit(True).alias("moving"), F.lit(0.0).alias("roughness"), F.lit(0.0).alias("slope"), F.lit(1).alias("flags"))
    assert O.refine(cells).count() == 4096
    near = cells.withColumn("ring", F.lit(10))
    assert O.refine(near).count() == 0
    assert O.quadrants(O.refine(cells, most=3)).select("parent_flags").distinct().first()[0] == 65


def test_empty_points(spark):
    none = spark.createDataFrame([], "frame_id int, x double, y double, z double, cls int, moving boolean")
    assert O.analyse(O.cell_map(none)).count() == 0
