"""Distance clusters by tiles: union inside a tile, borders merged by the labels of shared points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import kept

#: Finest tiles along a side of a coarse one; points of a tile beyond which it is split.
FINE, MOST = 8, 50_000
#: Candidate pairs looked at in one step, and rows from which on whole tiles are united together (thousands of tiles hold a few points each).
PAIRS, ROWS = 1 << 21, 1 << 16


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is linked with, directly or not."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def links(xyz: np.ndarray, sources: np.ndarray, ids: np.ndarray, radius: float, nearest: int | None, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (source, other) of one tile within the radius, at most the ``nearest`` of a source.

    A source with so many others within a part of the radius has its nearest there, so crowded places never look at all within the radius.
    """
    if nearest is None:
        return _pairs(xyz, sources, ids, radius, nearest, tile)
    out = []
    for part in (4, 2, 1):
        a, b = _pairs(xyz, sources, ids, radius / part, nearest, tile)
        if part > 1:
            full = np.bincount(a, minlength=len(xyz)) >= nearest
            a, b, sources = a[full[a]], b[full[a]], sources[~full[sources]]
        out.append((a, b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pairs(xyz: np.ndarray, sources: np.ndarray, ids: np.ndarray, radius: float, nearest: int | None, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (source, other) of one tile within the radius, at most the ``nearest`` of a source (ties by id); some candidates at a time.

    ``tile`` numbers the tiles from 0 on, in ascending order.
    """
    box = np.floor(xyz / radius).astype(np.int64)
    box -= np.minimum.reduceat(box, np.flatnonzero(np.diff(tile, prepend=-1)), axis=0)[tile] - 1
    size = box.max(axis=0) + 2
    key = ((tile * size[0] + box[:, 0]) * size[1] + box[:, 1]) * size[2] + box[:, 2]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    steps = np.array([(i * size[1] + j) * size[2] + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    around = key[sources][:, None] + steps
    low, high = np.searchsorted(sorted_key, around, "left"), np.searchsorted(sorted_key, around, "right")
    count = (high - low).sum(axis=1)
    total, at, out = np.cumsum(count), 0, [np.zeros((2, 0), np.int64)]
    while at < len(sources):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        each = (high[at:to] - low[at:to]).ravel()
        run = np.cumsum(each) - each
        other = order[np.arange(int(each.sum())) + np.repeat(low[at:to].ravel() - run, each)]
        source = np.repeat(sources[at:to], count[at:to])
        apart = ((xyz[source] - xyz[other]) ** 2).sum(axis=1)
        ok = (source != other) & (apart <= radius * radius)
        source, other, apart = source[ok], other[ok], apart[ok]
        if nearest is not None and len(source):
            by = np.lexsort((ids[other], apart, source))
            source, other = source[by], other[by]
            first = np.flatnonzero(np.diff(source, prepend=-1))
            rank = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source))))
            source, other = source[rank < nearest], other[rank < nearest]
        out.append(np.stack([source, other]))
        at = to
    return tuple(np.concatenate(out, axis=1))


def _levels(fine: DataFrame) -> DataFrame:
    """For every coarse tile an array with the level (0 whole, 3 finest) of each of its 64 finest tiles: the first that has at most ``MOST`` points."""
    q = lambda c: F.floor(F.col(c) / FINE).cast("int")
    spot = lambda c, big: F.col(c) - q(c) * FINE if big is None else big
    tiles = fine.groupBy("frame_id", q("fx").alias("cx"), q("fy").alias("cy")).agg(F.collect_list(F.struct(spot("fx", None).alias("i"), spot("fy", None).alias("j"), "n")).alias("t"))

    def within(o: Column, side: int) -> Column:
        i, j = F.floor(o / FINE), o % FINE
        same = lambda e: (F.floor(e["i"] / side) == F.floor(i / side)) & (F.floor(e["j"] / side) == F.floor(j / side))
        return F.reduce(F.filter("t", same), F.lit(0).cast("long"), lambda s, e: s + e["n"]) <= MOST

    level = F.transform(F.sequence(F.lit(0), F.lit(FINE * FINE - 1)), lambda o: F.when(within(o, 8), 0).when(within(o, 4), 1).when(within(o, 2), 2).otherwise(3))
    return tiles.select("frame_id", "cx", "cy", level.alias("levels"))


def tiled(points: DataFrame, radius: float) -> DataFrame:
    """Every point in its own tile and in all tiles within the radius of it: adds ``tile`` and ``home``.

    A tile has 8 x 8 squares with a side of two radii. Where it holds more than ``MOST`` points it is split into quarters, down to one square; a
    point's square of one radius around it touches no tile but those of its four corners, as no tile is smaller.
    """
    side = 2 * radius
    at = lambda c: F.floor(c / side).cast("int")
    fine = points.groupBy("frame_id", at(F.col("x")).alias("fx"), at(F.col("y")).alias("fy")).agg(F.count(F.lit(1)).alias("n"))
    corner = lambda dx, dy: F.struct(at(F.col("x") + dx * radius).alias("fx"), at(F.col("y") + dy * radius).alias("fy"))
    spots = points.withColumns({"own": corner(0, 0), "spots": F.array_distinct(F.array(*[corner(i, j) for i, j in ((0, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))]))})
    coarse = lambda e: F.struct(F.floor(e["fx"] / FINE).cast("int").alias("cx"), F.floor(e["fy"] / FINE).cast("int").alias("cy"))
    met = spots.select("*", F.explode(F.array_distinct(F.transform("spots", coarse))).alias("c")).select("*", "c.cx", "c.cy").join(_levels(fine), ["frame_id", "cx", "cy"])

    def leaf(e: Column) -> Column:
        i, j = (e[c] - F.col(k) * FINE for c, k in (("fx", "cx"), ("fy", "cy")))
        level = F.get("levels", i * FINE + j)
        cut = F.pow(F.lit(2), 3 - level)
        return F.struct(level.alias("level"), F.floor(e["fx"] / cut).cast("int").alias("tx"), F.floor(e["fy"] / cut).cast("int").alias("ty"))

    inside = lambda e: (F.floor(e["fx"] / FINE) == F.col("cx")) & (F.floor(e["fy"] / FINE) == F.col("cy"))
    # The tile of the point itself comes from its own square; it is home there and a guest in the others.
    home = F.when(inside(F.col("own")), leaf(F.col("own")))
    out = met.select(*points.columns, home.alias("own"), F.explode(F.array_distinct(F.transform(F.filter("spots", inside), leaf))).alias("tile"))
    return out.select(*points.columns, "tile", F.coalesce(F.col("tile") == F.col("own"), F.lit(False)).alias("home"))


def cluster_roots(points: DataFrame, radius: float, nearest: int | None = None) -> DataFrame:
    """The least id of each point's cluster: (frame_id, id, root). Points need frame_id, id (integer), x, y and may have z.

    Points of a frame are linked within the radius (with ``nearest``: each to at most so many of its nearest). A tile's task unites the links of its own
    points; guests are points of other tiles within one radius. A point that two tiles have seen ties their labels together,
    and the components of these few labels, found by joins, give the clusters. Rounds depend on how many tiles a cluster crosses, not on its points.
    Coordinates that are null put a point into a cluster of its own. Ids must be unique in a frame.
    """
    from .iterative import components

    kind = points.schema["id"].dataType.simpleString()
    flat = "z" not in points.columns
    table = points.select("frame_id", "id", "x", "y", F.lit(0.0).alias("z") if flat else F.col("z"))
    sound = table.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")

    def numbers(t: pa.Table) -> np.ndarray:
        """The tiles of sorted rows, numbered from 0."""
        new = np.zeros(len(t), bool)
        for c in (*t.column("tile").combine_chunks().flatten(), t.column("frame_id").combine_chunks()):
            v = c.cast(pa.int64()).fill_null(1 << 40).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        held, rows, limit = [], 0, ROWS
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                table = pa.Table.from_batches(held).combine_chunks()
                tile = numbers(table)
                cut = int(np.searchsorted(tile, tile[-1]))
                if cut:
                    yield table.slice(0, cut), tile[:cut]
                held, rows = table.slice(cut).to_batches(), len(table) - cut
                limit = max(ROWS, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, numbers(table)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tile in whole(batches):
            ids = table.column("id").to_numpy()
            order = np.lexsort((ids, tile))
            table, ids = table.take(order), ids[order]
            xyz = np.stack([table.column(c).to_numpy().astype(float) for c in "xyz"], axis=1)
            home = table.column("home").to_numpy()
            a, b = links(xyz, np.flatnonzero(home), ids, radius, nearest, tile)
            root = union(a, b, len(ids))
            seen = home.copy()
            seen[b] = True
            out = pa.table({"frame_id": table.column("frame_id").filter(pa.array(seen)), "id": pa.array(ids[seen]), "label": pa.array(ids[root[seen]]), "home": pa.array(home[seen])})
            yield from out.combine_chunks().to_batches()

    spread = tiled(sound, radius).repartition("frame_id", "tile").sortWithinPartitions("frame_id", "tile")
    local = kept(spread.select("frame_id", "tile", "id", "x", "y", "z", "home").mapInArrow(unite, f"frame_id int, id {kind}, label {kind}, home boolean"))
    # Labels of one point in several tiles belong together.
    shared = local.groupBy("frame_id", "id").agg(F.min("label").alias("a"), F.collect_set("label").alias("all")).where(F.size("all") > 1)
    ties = kept(shared.select("frame_id", "a", F.explode("all").alias("b")).where("a <> b").distinct())
    nodes = ties.select("frame_id", F.col("a").alias("id")).union(ties.select("frame_id", "b")).distinct()
    merged = components(nodes, ties).withColumnsRenamed({"id": "label"})
    found = local.where("home").select("frame_id", "id", "label").join(merged, ["frame_id", "label"], "left").select("frame_id", "id", F.coalesce("root", "label").alias("root"))
    return table.select("frame_id", "id").join(found, ["frame_id", "id"], "left").select("frame_id", "id", F.coalesce("root", "id").alias("root"))
