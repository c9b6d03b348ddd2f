"""Unobserved cells of a ring, counted from the occupied ones."""

from ringfield.operators import cells as O


def test_unobserved_cells_by_ring_equal_the_listed_ones(spark):
    rows = O.rings()
    some = [(1, k, rows[k][6] + j) for k, j in ((0, 0), (5, 0), (5, 3), (200, 7), (661, rows[661][5] - 1))] + [(2, 3, rows[3][6] + j) for j in range(rows[3][5])]
    cells = spark.createDataFrame(some, "frame_id int, ring int, cell_id int")
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id int")
    want = {}
    for f in (1, 2, 3):
        own = {c for g, _, c in some if g == f}
        for k, r in enumerate(rows):
            free = [c for c in range(r[6], r[6] + r[5]) if c not in own]
            if free:
                want[f, k] = (len(free), sum(free))
    got = {(r.frame_id, r.ring): (r.n_void, r.id_sum) for r in O.void_by_ring(cells, frames).collect()}
    assert got == want and (2, 3) not in got
    assert O.void_cells(cells, frames).count() == sum(n for n, _ in want.values())
