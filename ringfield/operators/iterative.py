"""Operators that iterate: distance graphs and components, geometric segmentation, tracking.

Distance joins and components are joins; a tracker steps through the frames of a sequence in one Python function. ``fit_plane`` and ``shortest`` work on one
cloud or raster in memory; for tables see ``planes`` and ``routes``.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.grid import ring_table
from .cells import kept
from .clusters import cluster_roots
from .planes import ransac_planes


def cell_centres(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    d = F.broadcast(ring_table(cells.sparkSession, cfg).select("ring", "r_centre", "n_bins"))
    a = (F.col("bin") + 0.5) / F.col("n_bins") * 2 * F.pi()
    return cells.join(d, "ring").withColumns({"cx": F.col("r_centre") * F.cos(a), "cy": F.col("r_centre") * F.sin(a)}).select("frame_id", F.col("cell_id").alias("id"), "cx", "cy")


def radius_edges(nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs a < b of nodes (frame_id, id, cx, cy) of a frame within the radius: equi-join of nine buckets, then the distance."""
    cell = lambda c: F.floor(c / radius).cast("int")
    probe = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = nodes.select("frame_id", F.col("id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(probe).alias("o")).select("frame_id", "a", "ax", "ay", (cell(F.col("ax")) + F.col("o.i")).alias("bx"), (cell(F.col("ay")) + F.col("o.j")).alias("by"))
    right = nodes.select("frame_id", F.col("id").alias("b"), F.col("cx").alias("rx"), F.col("cy").alias("ry"), cell(F.col("cx")).alias("bx"), cell(F.col("cy")).alias("by"))
    dx, dy = F.col("ax") - F.col("rx"), F.col("ay") - F.col("ry")
    return left.join(right, ["frame_id", "bx", "by"]).where(F.col("a") < F.col("b")).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).select("frame_id", "a", "b", F.sqrt("d2").alias("dist"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every node (frame_id, id): least label of the neighbours, then its label, until nothing changes."""
    both = edges.select("frame_id", "a", "b").union(edges.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = nodes.select("frame_id", "id", F.col("id").alias("root")).checkpoint()
    while True:
        near = both.join(labels.select("frame_id", F.col("id").alias("b"), "root"), ["frame_id", "b"]).groupBy("frame_id", F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, ["frame_id", "id"], "left").select("frame_id", "id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        # All nodes with one label take the least that any of them met, and then the one that those took.
        least = step.groupBy("frame_id", "old").agg(F.min("root").alias("met"))
        jump = step.join(least, ["frame_id", "old"]).select("frame_id", "id", "old", "met").join(least.select("frame_id", F.col("old").alias("met"), F.col("met").alias("root")), ["frame_id", "met"]).select("frame_id", "id", "old", "root").checkpoint()
        labels = jump.select("frame_id", "id", "root")
        if not jump.where("old <> root").limit(1).count():
            return labels


def cluster_centroids(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Clusters of DYNAMIC cells: centre and size; small ones are dropped."""
    nodes = kept(cell_centres(cells, cfg))
    labels = cluster_roots(nodes.withColumnsRenamed({"cx": "x", "cy": "y"}), cfg.link)
    return labels.join(nodes, ["frame_id", "id"]).groupBy("frame_id", F.col("root").alias("cluster")).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy")).where(F.col("n_cells") >= cfg.min_cells)


def fit_plane(xyz: np.ndarray, cfg: Config = DEFAULT) -> tuple[np.ndarray, float, int] | None:
    """A ground plane by random triples from a fixed seed: unit normal (upward), offset, inliers; None if there is none."""
    near = xyz[np.hypot(xyz[:, 0], xyz[:, 1]) < cfg.fit_radius]
    if len(near) < 3:
        return None
    rng = np.random.default_rng(cfg.plane_seed)
    some = near if len(near) <= 20_000 else near[rng.choice(len(near), 20_000, replace=False)]
    tri = some[rng.integers(0, len(some), (cfg.iterations, 3))]
    normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    size = np.linalg.norm(normal, axis=1)
    good = size > 1e-9
    normal, base = normal[good] / size[good, None], tri[good, 0]
    normal *= np.where(normal[:, 2:3] < 0, -1.0, 1.0)
    flat = normal[:, 2] >= math.cos(math.radians(cfg.max_tilt_deg))
    normal, base = normal[flat], base[flat]
    if not len(normal):
        return None
    d = -(normal * base).sum(axis=1)
    votes = (np.abs(some @ normal.T + d) <= cfg.ground_tol).sum(axis=0)
    k = int(votes.argmax())
    inside = near[np.abs(near @ normal[k] + d[k]) <= cfg.ground_tol]
    if len(inside) < 3:
        return None
    centre = inside.mean(axis=0)
    n = np.linalg.svd(inside - centre, full_matrices=False)[2][2]
    n = n if n[2] >= 0 else -n
    if n[2] < math.cos(math.radians(cfg.max_tilt_deg)):
        return normal[k], float(d[k]), len(inside)  # the refit tilts too much: the voted plane stays
    off = float(-n @ centre)
    return n, off, int((np.abs(near @ n + off) <= cfg.ground_tol).sum())


def segment_geometric(points: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """Classes without a network: plane bands for the ground, boxes of clusters for the rest; frames without a plane are VOID.

    Points are clustered by their up to 16 nearest neighbours within 0.5 m. The key is an integer, unique in a frame. Returns
    frame_id, the key and ``cls``.
    """
    from .segment import band_class, bbox_class

    planes = ransac_planes(points, cfg)
    banded = kept(band_class(points.join(planes, "frame_id"), cfg))
    above = banded.where("band = 'above'").select("frame_id", F.col(key).alias("id"), "x", "y", "z", "h")
    labels = kept(cluster_roots(above, cfg.cluster_radius, cfg.cluster_knn))
    boxes = above.join(labels, ["frame_id", "id"]).groupBy("frame_id", "root").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"), (F.max("h") - F.min("h")).alias("span"), F.min("h").alias("base"))
    high = labels.join(bbox_class(boxes, cfg).select("frame_id", "root", "cls"), ["frame_id", "root"]).select("frame_id", F.col("id").alias(key), "cls")
    low = banded.where("band <> 'above'").select("frame_id", key, F.when(F.col("band") == "ground", 1).otherwise(2).alias("cls"))
    known = low.unionByName(high)
    return points.select("frame_id", key).join(known, ["frame_id", key], "left").select("frame_id", key, F.coalesce("cls", F.lit(0)).alias("cls"))


def within(a: np.ndarray, b: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Pairs (row of a, row of b) of points in the plane that may be within the radius: both coordinates are at most so far apart (and a little more)."""
    far = radius * (1 + 1e-9)
    order = np.argsort(b[:, 0], kind="stable")
    low, high = (np.searchsorted(b[order, 0], a[:, 0] + s * far, side) for s, side in ((-1, "left"), (1, "right")))
    out = []
    for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        some = order[lo:hi]
        out += [(i, j) for j in some[np.abs(b[some, 1] - a[i, 1]) <= far].tolist()]
    return out


class Tracker:
    """Constant-velocity Kalman tracks of cluster centres with greedy nearest association; state can be saved and restored."""

    def __init__(self, cfg: Config = DEFAULT, state: dict | None = None):
        self.cfg = cfg
        self.tracks: list[dict] = (state or {}).get("tracks", [])
        self.next_id: int = (state or {}).get("next_id", 1)

    def state(self) -> dict:
        return {"tracks": self.tracks, "next_id": self.next_id}

    def step(self, found: list[tuple[float, float, int]], dt: float) -> list[dict]:
        """One frame of (x, y, cells); returns the confirmed tracks, largest first, with their predicted paths."""
        c = self.cfg
        move = np.eye(4)
        move[0, 2] = move[1, 3] = dt
        noise = np.diag([c.q_pos, c.q_pos, c.q_vel, c.q_vel]) * dt
        found = sorted(found, key=lambda f: (-f[2], f[0], f[1]))
        # All tracks at once: one stack of states and one of covariances.
        x = np.array([t["x"] for t in self.tracks]).reshape(-1, 4) @ move.T
        p = move @ np.array([t["p"] for t in self.tracks]).reshape(-1, 4, 4) @ move.T + noise
        spots = np.array([f[:2] for f in found], float).reshape(-1, 2)
        gate = c.v_max * dt + c.gate_extra
        pairs = sorted((math.hypot(x[i, 0] - spots[j, 0], x[i, 1] - spots[j, 1]), i, j) for i, j in within(x[:, :2], spots, gate))
        met = {}
        used_f = set()
        for dist, i, j in pairs:
            if dist > gate or i in met or j in used_f:
                continue
            used_f.add(j)
            met[i] = j
        if met:
            i, j = np.array(list(met)), np.array(list(met.values()))
            gain = p[i][:, :, :2] @ np.linalg.inv(p[i][:, :2, :2] + np.eye(2) * c.r_meas)
            left = np.tile(np.eye(4), (len(i), 1, 1))
            left[:, :, :2] -= gain
            x[i] += (gain @ (spots[j] - x[i][:, :2])[:, :, None])[:, :, 0]
            p[i] = left @ p[i]
        for i, (t, state, spread) in enumerate(zip(self.tracks, x.tolist(), p.reshape(-1, 16).tolist(), strict=True)):
            t.update(x=state, p=spread, age=t["age"] + 1, seen=i in met)
            if i in met:
                t.update(hits=t["hits"] + 1, misses=0, n_cells=found[met[i]][2])
                t["born"] = t["born"] or t["hits"] >= c.birth_hits
        for t in self.tracks:
            if not t["seen"]:
                # A track is born by sightings in a row: a miss starts the count anew.
                t["misses"], t["hits"] = t["misses"] + 1, 0
        self.tracks = [t for t in self.tracks if t["misses"] < c.death_misses]
        for j, f in enumerate(found):
            if j not in used_f:
                self.tracks.append({"id": self.next_id, "x": [f[0], f[1], 0.0, 0.0], "p": np.diag([c.p0_pos, c.p0_pos, c.p0_vel, c.p0_vel]).ravel().tolist(), "age": 1, "hits": 1, "misses": 0, "born": c.birth_hits <= 1, "seen": True, "n_cells": f[2]})
                self.next_id += 1
        h = c.horizon / c.predict_steps
        return [{"track_id": t["id"], "x": round(t["x"][0], 3), "y": round(t["x"][1], 3), "vx": round(t["x"][2], 3), "vy": round(t["x"][3], 3), "age": t["age"], "n_cells": t["n_cells"],
                 "predicted": [[round(t["x"][0] + t["x"][2] * h * (k + 1), 3), round(t["x"][1] + t["x"][3] * h * (k + 1), 3)] for k in range(c.predict_steps)]} for t in sorted((t for t in self.tracks if t["born"]), key=lambda t: (-t["n_cells"], t["id"]))]


TRACK_DDL = "sequence string, frame_id long, track_id long, x double, y double, vx double, vy double, age long, n_cells long, predicted array<array<double>>"


def track(clusters: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks of all sequences; clusters need sequence, frame_id, cx, cy, n_cells. A sequence is stepped frame by frame in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(cfg), []
        by = dict(tuple(g.groupby("frame_id")))
        for frame in range(int(g["frame_id"].min()), int(g["frame_id"].max()) + 1):
            rows = by.get(frame)
            found = [] if rows is None else list(zip(rows["cx"], rows["cy"], rows["n_cells"], strict=True))
            out += [{"sequence": g["sequence"].iloc[0], "frame_id": frame, **t} for t in tracker.step(found, cfg.frame_dt)]
        return pd.DataFrame(out, columns=["sequence", "frame_id", "track_id", "x", "y", "vx", "vy", "age", "n_cells", "predicted"])

    return clusters.select("sequence", "frame_id", "cx", "cy", "n_cells").groupBy("sequence").applyInPandas(run, TRACK_DDL)


def shortest(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Best-first search on eight neighbours with the octile bound; a step costs its length times 1 + the target's cost."""
    n, m = cost.shape
    far = lambda a: max(abs(a[0] - goal[0]), abs(a[1] - goal[1])) + (math.sqrt(2) - 1) * min(abs(a[0] - goal[0]), abs(a[1] - goal[1]))
    best, came, heap = {start: 0.0}, {}, [(far(start), start)]
    done = set()
    while heap:
        _, at = heapq.heappop(heap)
        if at == goal:
            path = [at]
            while at in came:
                at = came[at]
                path.append(at)
            return path[::-1]
        if at in done:
            continue
        done.add(at)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                to = (at[0] + dx, at[1] + dy)
                if (dx or dy) and 0 <= to[0] < n and 0 <= to[1] < m and cost[to] < 1.0:
                    g = best[at] + math.hypot(dx, dy) * (1 + cost[to])
                    if g < best.get(to, math.inf):
                        best[to], came[to] = g, at
                        heapq.heappush(heap, (g + far(to), to))
    return None


def warm_speed(tracks: DataFrame, warmup: int = 10) -> DataFrame:
    """Median speed of each sequence's first track (the largest) from frame ``warmup`` on, and how many ids were first."""
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    first = tracks.groupBy("sequence", "frame_id").agg(F.min(F.struct((-F.col("n_cells")).alias("o"), "track_id", speed.alias("speed"))).alias("t"))
    return first.groupBy("sequence").agg(F.round(F.median(F.when(F.col("frame_id") >= warmup, F.col("t.speed"))), 4).alias("speed"), F.count_distinct("t.track_id").alias("n_ids"), F.count(F.lit(1)).alias("n_frames"))
