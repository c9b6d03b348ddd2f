"""Queries whose results SQL cannot check: plane fits, clusters, tracks, routes, binary frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import cells as O
from ..operators import decision as D
from ..operators import clusters as K
from ..operators import iterative as S
from ..operators import planes as P
from ..operators import routes as W
from ..sources.files import decode_frame, wire_frames
from ..sources.views import pts_dense, pts_wide
from .decide import frames, known


def ransac_plane(spark, d):
    return P.ransac_planes(pts_dense(spark, d))


def cluster_centroids(spark, d):
    found = S.cluster_centroids(O.dynamic_cells(O.cell_map(pts_dense(spark, d))))
    return found.select("frame_id", "cluster", "n_cells", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def cluster_cc(spark, d):
    nodes = O.kept(S.cell_centres(O.dynamic_cells(O.cell_map(pts_wide(spark, d)))).withColumnsRenamed({"cx": "x", "cy": "y"}))
    return K.cluster_roots(nodes, DEFAULT.link).groupBy("frame_id", "root").agg(F.count(F.lit(1)).alias("n"))


def segment_geometric(spark, d):
    """Classes of the points of the dense view; a point is named by a hash of its row, and rows that are alike are one point."""
    p = pts_dense(spark, d).withColumn("point_id", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).dropDuplicates(["frame_id", "point_id"])
    return S.segment_geometric(p.select("frame_id", "point_id", "x", "y", "z"), "point_id")


def tracker(spark, d):
    """Tracks of the clusters of DYNAMIC cells. Seven frames of the view are one sequence of 42, in six rounds by order key: more frames than speeds need to settle."""
    turn = F.pmod("l_orderkey", F.lit(6)) * 7 + F.pmod("frame_id", F.lit(7))
    p = pts_wide(spark, d).withColumn("frame_id", (F.floor(F.col("frame_id") / 7) * 42 + turn).cast("int"))
    found = S.cluster_centroids(O.dynamic_cells(O.cell_map(p)), replace(DEFAULT, min_cells=1))
    return S.track(found.select(F.floor(F.col("frame_id") / 42).cast("string").alias("sequence"), F.pmod("frame_id", F.lit(42)).alias("frame_id"), "cx", "cy", "n_cells"))


def track_speed(spark, d):
    return S.warm_speed(tracker(spark, d))


def plan_routes(spark, d):
    cost = D.track_cost(D.inflate(known(spark, d), sparse=True), pts_wide(spark, d).where("cls = 4").select("frame_id", "x", "y"), sparse=True)
    return W.plan_routes(cost, frames=frames(spark, d), unknown=D.UNKNOWN["cost"])


def wire_roundtrip(spark, d):
    """Cells of every frame, decoded from their wire frames, with the sums of some arrays."""
    message = wire_frames(O.analyse(O.cell_map(pts_dense(spark, d))))

    def read(batches):
        import pandas as pd

        for b in batches:
            out = []
            for frame, data in zip(b["frame_id"], b["message"], strict=True):
                _, c = decode_frame(data)
                out.append({"frame_id": frame, "n_cells": len(c["cell_id"]), "ids": int(c["cell_id"].sum(dtype="int64")), "flags": int(c["flags"].sum(dtype="int64")), "classes": int(c["class_id"].sum(dtype="int64"))})
            yield pd.DataFrame(out, columns=["frame_id", "n_cells", "ids", "flags", "classes"])

    return message.mapInPandas(read, "frame_id int, n_cells long, ids long, flags long, classes long")


QUERIES = {k: v for k, v in globals().items() if k in ("ransac_plane", "cluster_centroids", "cluster_cc", "segment_geometric", "tracker", "track_speed", "plan_routes", "wire_roundtrip")}

from .. import checks as C  # noqa: E402

_roots = """, ce AS MATERIALIZED (SELECT frame_id, cell_id AS id, r_centre * cos((bin + 5e-1) / n_bins * 2 * pi()) AS cx, r_centre * sin((bin + 5e-1) / n_bins * 2 * pi()) AS cy FROM fin WHERE class_id = 4),
link AS MATERIALIZED (SELECT p.frame_id, p.id AS a, q.id AS b FROM ce p JOIN ce q ON p.frame_id = q.frame_id AND p.id <> q.id AND pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2) <= 225e-2),
reach AS (SELECT frame_id, id, id AS root FROM ce UNION SELECT r.frame_id, l.b, r.root FROM reach r JOIN link l ON l.frame_id = r.frame_id AND l.a = r.id),
roots AS (SELECT frame_id, id, min(root) AS root FROM reach GROUP BY frame_id, id)"""
ORACLES = {
    "cluster_cc": C.sql(C.cells("wide") + _roots, "SELECT frame_id, root, count(*) AS n FROM roots GROUP BY frame_id, root"),
    "cluster_centroids": C.sql(C.cells("dense") + _roots, "SELECT frame_id, root AS cluster, count(*) AS n_cells, round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy FROM roots JOIN ce USING (frame_id, id) GROUP BY frame_id, root HAVING count(*) >= 4"),
    "wire_roundtrip": C.sql(C.analysed("dense"), "SELECT frame_id, count(*) AS n_cells, sum(cell_id)::BIGINT AS ids, sum(flags & 255)::BIGINT AS flags, sum(class_id)::BIGINT AS classes FROM ana GROUP BY frame_id")}
