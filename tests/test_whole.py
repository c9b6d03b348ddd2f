"""Queries and their SQL work on every frame."""

from helpers import SF, same_rows
from ringfield.queries import ORACLES, QUERIES


def frames(spark, name):
    return {r.frame_id for r in QUERIES[name](spark, SF).select("frame_id").distinct().collect()}


def test_inflation_of_every_frame(spark, duck):
    assert same_rows(QUERIES["costmap_inflate"](spark, SF), duck, ORACLES["costmap_inflate"]) == 7 * 160 * 160


def test_lattice_and_unobserved_cells_of_every_frame(spark):
    for name in ("lattice_resample", "void_unobserved_anti_join"):
        assert frames(spark, name) == set(range(7))


def test_lattice_by_brute_force(spark):
    """Every site of the box against every cell, for strides from 1, cells at the edge and around the sensor, and odd input."""
    import math

    from ringfield.functions.grid import project, rings
    from ringfield.operators.lattice import lattice

    rings_ = rings()
    some = [(1, k, j, rings_[k][6] + j, "a", k) for k, j in ((0, 0), (1, 2), (5, 7), (40, 60), (41, 60))]
    some += [(2, k, j, rings_[k][6] + j, "b", k) for k, j in ((500, 0), (500, rings_[500][5] - 1), (520, 40), (661, 30))] + [(3, 7, 1, rings_[7][6] + 1, "c", 7)]
    cells = spark.createDataFrame([*some, (None, 1, 1, 1, "d", 1)], "frame_id int, ring int, bin int, cell_id int, x string, n long")
    for size, budget in ((0.05, 10**9), (0.05, 4000), (0.2, 500)):
        got = sorted((r.frame_id, r.stride, r.ix, r.iy, r.cell_id, r.n) for r in lattice(cells, ("n",), size, budget).collect())
        want = []
        for frame in (1, 2, 3):
            own = {c: n for f, _, _, c, _, n in some if f == frame}
            at = [(rings_[k][4] * math.cos((j + 0.5) * 2 * math.pi / rings_[k][5]), rings_[k][4] * math.sin((j + 0.5) * 2 * math.pi / rings_[k][5])) for f, k, j, *_ in some if f == frame]
            lo, hi = [[round(max(-100, min(100, g(p[a] for p in at))), 6) for a in (0, 1)] for g in (min, max)]
            nx, ny = (max(1, math.ceil((h - b) / size)) for b, h in zip(lo, hi, strict=True))
            stride = max(1, math.ceil(math.sqrt(nx * ny / budget)))
            sites = spark.range(math.ceil(nx / stride)).selectExpr(f"id * {stride} AS ix").crossJoin(spark.range(math.ceil(ny / stride)).selectExpr(f"id * {stride} AS iy"))
            points = project(sites.selectExpr("ix", "iy", f"{lo[0]}D + (ix + 0.5D) * {size}D AS x", f"{lo[1]}D + (iy + 0.5D) * {size}D AS y"))
            want += [(frame, stride, r.ix, r.iy, r.cell_id, own[r.cell_id]) for r in points.where(points.cell_id.isin(list(own))).collect()]
        assert got == sorted(want) and len({w[0] for w in want}) >= 1
    assert lattice(cells.limit(0), ("n",)).count() == 0
