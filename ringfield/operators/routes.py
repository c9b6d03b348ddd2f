"""Routes over cost rasters: frames side by side where a raster is small, else delta-stepping over tiles and paths by pointer jumping."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .cells import kept
from .decision import raster_size

#: Cells along a side of a tile, and the width of a bucket of distances (a free step is 1).
TILE, BUCKET = 32, 64.0
#: Cells along a side of a raster up to which one search of a task covers a frame's raster (half a megabyte of costs); larger ones are cut into tiles.
WHOLE = 256
AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def _tiles(raster: DataFrame, n: int) -> DataFrame:
    """One row for each tile of a frame: its known costs by place; cells that the raster lacks cost nothing."""
    side = -(-n // TILE)
    frames = raster.select("frame_id").distinct()
    every = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("tx")).select("frame_id", "tx", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("ty"))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    known = raster.groupBy("frame_id", tile("ix").alias("tx"), tile("iy").alias("ty")).agg(F.collect_list(F.struct(((F.col("ix") % TILE) * TILE + F.col("iy") % TILE).cast("int").alias("place"), F.col("cost").cast("double").alias("cost"))).alias("c"))
    filled = known.select("frame_id", "tx", "ty", F.map_from_entries("c").alias("c"))
    cost = F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda k: F.coalesce(F.try_element_at("c", k), F.lit(0.0)))
    blank = lambda v: F.array_repeat(v, TILE * TILE)
    return every.join(filled, ["frame_id", "tx", "ty"], "left").select("frame_id", "tx", "ty", cost.alias("cost"), blank(F.lit(float("inf"))).alias("dist"), blank(F.lit(-1)).alias("up"))


TILE_DDL = "frame_id int, tx int, ty int, cost array<double>, dist array<double>, up array<int>"
NEWS_DDL = "array<struct<tx: int, ty: int, place: int, d: double, step: double, from: int>>"


def _relax(n: int):
    """Spreads the distances that reach a tile over it, and tells the tiles beside it of its border cells that improved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for frame, tx, ty, cost, dist, up, news in b.itertuples(index=False):
                if news is None:
                    rows.append((frame, tx, ty, cost, dist, up, []))
                    continue
                cost, dist, up, heap, better = list(cost), list(dist), list(up), [], set()
                for m in news:
                    place, d = m["place"], m["d"] + m["step"] * (1 + cost[m["place"]]) if m["step"] else m["d"]
                    if (cost[place] < 1.0 or not m["step"]) and d < dist[place]:
                        dist[place], up[place] = d, m["from"]
                        heapq.heappush(heap, (d, place))
                        better.add(place)
                while heap:
                    d, at = heapq.heappop(heap)
                    if d > dist[at]:
                        continue
                    i, j = divmod(at, TILE)
                    for dx, dy in AROUND:
                        x, y = i + dx, j + dy
                        if not (0 <= x < TILE and 0 <= y < TILE and tx * TILE + x < n and ty * TILE + y < n):
                            continue
                        to = x * TILE + y
                        g = d + math.hypot(dx, dy) * (1 + cost[to])
                        if cost[to] < 1.0 and g < dist[to]:
                            dist[to], up[to] = g, (tx * TILE + i) * n + ty * TILE + j
                            heapq.heappush(heap, (g, to))
                            better.add(to)
                out = []
                for at in better:
                    i, j = divmod(at, TILE)
                    if 0 < i < TILE - 1 and 0 < j < TILE - 1:
                        continue
                    for dx, dy in AROUND:
                        x, y = tx * TILE + i + dx, ty * TILE + j + dy
                        if 0 <= x < n and 0 <= y < n and (x // TILE, y // TILE) != (tx, ty):
                            out.append({"tx": x // TILE, "ty": y // TILE, "place": x % TILE * TILE + y % TILE, "d": dist[at], "step": math.hypot(dx, dy), "from": (tx * TILE + i) * n + ty * TILE + j})
                rows.append((frame, tx, ty, cost, dist, up, out))
            yield pd.DataFrame(rows, columns=["frame_id", "tx", "ty", "cost", "dist", "up", "news"])

    return run


def distances(raster: DataFrame, start: tuple[int, int], n: int) -> DataFrame:
    """The least cost from the start to every cell of each frame and the cell before it: (frame_id, cell, cost, dist, up), cell = ix * n + iy.

    Eight neighbours; a step costs its length times 1 + the cost of the cell it enters, cells that cost 1 or more are closed. Delta-stepping: distances that cross
    a tile's border wait until their bucket is the least; then the tiles they reach are joined with them, spread them inside, and
    pass on what improved. All frames step together; a row is a tile of 32 x 32 cells, and the rounds are those of the tiles that
    the longest way crosses. A frame without rows has none in the result.
    """
    spark = raster.sparkSession
    where = ["frame_id", "tx", "ty"]
    tiles = kept(_tiles(raster, n))
    i, j = start
    first = spark.createDataFrame([(i // TILE, j // TILE, i % TILE * TILE + j % TILE, 0.0, 0.0, -1)], "tx int, ty int, place int, d double, step double, `from` int")
    news = kept(raster.select("frame_id").distinct().join(F.broadcast(first)))
    while True:
        least = news.agg(F.min("d").alias("d")).first()["d"]
        if least is None:
            break
        bound = (math.floor(least / BUCKET) + 1) * BUCKET
        due = news.where(F.col("d") < bound).groupBy(*where).agg(F.collect_list(F.struct("tx", "ty", "place", "d", "step", "from")).alias("news"))
        step = kept(tiles.join(due, where, "left").select(*where, "cost", "dist", "up", "news").mapInPandas(_relax(n), f"{TILE_DDL}, news {NEWS_DDL}"))
        tiles = step.drop("news")
        told = step.select("frame_id", F.explode("news").alias("m")).select("frame_id", "m.*")
        news = kept(news.where(F.col("d") >= bound).union(told).groupBy("frame_id", "tx", "ty", "place", "step", "from").agg(F.min("d").alias("d")).select("frame_id", "tx", "ty", "place", "d", "step", "from"))
    cells = tiles.select("frame_id", "tx", "ty", F.posexplode(F.arrays_zip("cost", "dist", "up")).alias("place", "c"))
    x, y = F.col("tx") * TILE + F.floor(F.col("place") / TILE).cast("int"), F.col("ty") * TILE + F.col("place") % TILE
    return cells.where((x < n) & (y < n)).select("frame_id", (x * n + y).alias("cell"), "c.cost", "c.dist", "c.up")


def way_back(found: DataFrame, goal: int) -> DataFrame:
    """The cells of the shortest way to the goal: (frame_id, cell, dist); none for frames where it is out of reach.

    Pointer jumping: after k rounds every cell points 2^k cells back, and the cells found so far give as many again.
    """
    jump = kept(found.where("up >= 0").select("frame_id", "cell", "up"))
    way = kept(found.where((F.col("cell") == goal) & ~F.col("dist").isin(float("inf"))).select("frame_id", "cell"))
    before = 0
    while (count := way.count()) > before:
        before = count
        way = kept(way.union(way.join(jump, ["frame_id", "cell"]).select("frame_id", F.col("up").alias("cell"))).distinct())
        jump = kept(jump.join(jump.select("frame_id", F.col("cell").alias("up"), F.col("up").alias("far")), ["frame_id", "up"]).select("frame_id", "cell", F.col("far").alias("up")))
    return way.join(found.select("frame_id", "cell", "dist"), ["frame_id", "cell"])


def searched(cost: np.ndarray, start: int, goal: int) -> tuple[list[int], list[float]] | None:
    """The cells of the shortest way over a square raster of costs and their distances; None if there is none.

    Cells settle by distance, then number, and the first to give a cell its least distance stays before it.
    """
    n = cost.shape[0]
    # A closed border spares the look at the edges.
    side = n + 2
    padded = np.full((side, side), np.inf)
    padded[1:-1, 1:-1] = np.where(cost < 1.0, 1 + cost, np.inf)
    flat = padded.ravel().tolist()
    place = lambda c: (c // n + 1) * side + c % n + 1
    first, last = place(start), place(goal)
    if flat[last] == math.inf and first != last:
        return None
    around = [(dx * side + dy, math.hypot(dx, dy)) for dx, dy in AROUND]
    dist, up, heap = {first: 0.0}, {}, [(0.0, first)]
    while heap:
        d, at = heapq.heappop(heap)
        if at == last:
            way = [at]
            while at in up:
                at = up[at]
                way.append(at)
            way.reverse()
            return [(c // side - 1) * n + c % side - 1 for c in way], [dist[c] for c in way]
        if d > dist[at]:
            continue
        for by, length in around:
            to = at + by
            g = d + length * flat[to]
            if g < dist.get(to, math.inf):
                dist[to], up[to] = g, at
                heapq.heappush(heap, (g, to))
    return None


def whole_ways(raster: DataFrame, frames: DataFrame, start: tuple[int, int], goal: int, n: int, unknown: float) -> DataFrame:
    """The cells of the shortest way of each of the frames (frame_id, cell, dist); cells that the raster lacks cost ``unknown``.

    A row is a frame with its known costs: n * n numbers at most.
    """
    costs = raster.groupBy("frame_id").agg(F.collect_list(F.struct((F.col("ix") * n + F.col("iy")).alias("cell"), F.col("cost"))).alias("c"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cost, known = np.full(n * n, unknown), b.column(1)[k].values
                if known is not None:
                    cost[known.field("cell").to_numpy()] = known.field("cost").to_numpy()
                cells, dist = searched(cost.reshape(n, n), start[0] * n + start[1], goal) or ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(cells), pa.int32()), pa.array(cells, pa.int32()), pa.array(dist, pa.float64())], ["frame_id", "cell", "dist"])

    return frames.join(costs, "frame_id", "left").repartition("frame_id").mapInArrow(search, "frame_id int, cell int, dist double")


def _described(path: DataFrame, kind: str, cfg: Config) -> DataFrame:
    """Length, cost, risk, arrival and waypoints of each frame's path (frame_id, ix, iy, order, cost)."""
    rows = path.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("order", "ix", "iy", "cost"))).alias("p"), F.count(F.lit(1)).alias("n"))
    part = lambda a, b: F.sqrt(F.pow((a["ix"] - b["ix"]).cast("double"), 2) + F.pow((a["iy"] - b["iy"]).cast("double"), 2))
    add = lambda s, v: s + v
    length = F.reduce(F.zip_with(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), part), F.lit(0.0), add) * cfg.res
    total = F.reduce(F.transform("p", lambda e: e["cost"]), F.lit(0.0), add)
    told = rows.withColumns({"l": length, "total": total}).withColumn("mean", F.col("total") / F.col("n"))
    point = lambda e: F.array((e["ix"] + 0.5) * cfg.res, (e["iy"] + 0.5) * cfg.res - cfg.extent / 2)
    way = F.transform(F.filter("p", lambda e, k: (k % 4 == 0) | (k == F.col("n") - 1)), point)
    risk = F.when(F.col("mean") < 0.25, "LOW").when(F.col("mean") < 0.55, "MEDIUM").otherwise("HIGH")
    return told.select("frame_id", F.lit(kind).alias("kind"), F.round("l", 3).alias("length"), F.round("total", 3).alias("cost"), risk.alias("risk"), F.round(F.round("l", 9) / 8, 1).alias("eta"), way.alias("waypoints"))


def _all_cells(raster: DataFrame, frames: DataFrame, n: int, unknown: float) -> DataFrame:
    every = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ix")).select("frame_id", "ix", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("iy"))
    return every.join(raster, ["frame_id", "ix", "iy"], "left").select("frame_id", "ix", "iy", F.coalesce("cost", F.lit(unknown)).alias("cost"))


def plan_routes(raster: DataFrame, cfg: Config = DEFAULT, distinct_alternative: bool = False, frames: DataFrame | None = None, unknown: float = 0.0) -> DataFrame:
    """A primary and an alternative route for each frame's raster (frame_id, ix, iy, cost).

    Cells that the raster lacks cost ``unknown``; ``frames`` (frame_id, each once) are needed where the raster may lack all cells of one.

    Without a way the primary is the straight line. The alternative searches again with the corridor of the primary
    closed; as the goal lies in it, it usually becomes the primary moved by 2 m. ``distinct_alternative`` adds a
    finite penalty to the corridor instead.
    """
    n = raster_size(cfg)
    grid = kept(raster.select(F.col("frame_id").cast("int").alias("frame_id"), F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("cost").cast("double").alias("cost")))
    frames = kept((grid.select("frame_id").distinct() if frames is None else frames.select(F.col("frame_id").cast("int").alias("frame_id"))).where("frame_id IS NOT NULL"))
    goal = (n - 1) * n + n // 2

    def cells(way: DataFrame, order: Column, default: DataFrame) -> DataFrame:
        """The way, or the default one of frames that have none."""
        own = way.select("frame_id", F.floor(F.col("cell") / n).cast("int").alias("ix"), (F.col("cell") % n).cast("int").alias("iy"), order.alias("order"))
        return kept(own.union(default.join(own.select("frame_id").distinct(), "frame_id", "left_anti")))

    priced = lambda path: path.join(grid, ["frame_id", "ix", "iy"], "left").withColumn("cost", F.coalesce("cost", F.lit(unknown)))
    straight = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ix")).select("frame_id", "ix", F.lit(n // 2).alias("iy"), F.col("ix").cast("double").alias("order"))

    def shortest(costs: DataFrame) -> DataFrame:
        if n <= WHOLE:
            return kept(whole_ways(costs, frames, (0, n // 2), goal, n, unknown))
        return way_back(distances(_all_cells(costs, frames, n, unknown) if unknown else costs, (0, n // 2), n), goal)

    first = cells(shortest(grid), F.col("dist"), straight)
    wide = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    near = first.select("frame_id", "ix", "iy", wide.alias("dx")).select("frame_id", "ix", "iy", "dx", wide.alias("dy")).select("frame_id", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy")).distinct().withColumn("near", F.lit(True)).where(f"ix BETWEEN 0 AND {n - 1} AND iy BETWEEN 0 AND {n - 1}")
    more = F.least(F.col("cost") + 0.9, F.lit(0.999)) if distinct_alternative else F.least(F.col("cost") + 2.0, F.lit(1.0))
    closed = grid.join(near, ["frame_id", "ix", "iy"], "full").select("frame_id", "ix", "iy", F.coalesce("cost", F.lit(unknown)).alias("cost"), "near").select("frame_id", "ix", "iy", F.when(F.col("near"), more).otherwise(F.col("cost")).alias("cost"))
    moved = first.select("frame_id", "ix", F.least(F.lit(n - 1), F.col("iy") + 8).alias("iy"), "order")
    second = cells(shortest(closed), F.col("dist"), moved)
    return _described(priced(first), "primary", cfg).union(_described(priced(second), "alternative", cfg))
