"""Queries on scores: confusion, IoU, recall, latency, spread, occupancy, memory, hazards against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks as C
from ..config import DEFAULT
from ..functions.grid import radius, rings
from ..functions.labels import with_class
from ..operators import cells as O
from ..operators.hazards import estimators, road_reference
from ..operators import metrics as M
from ..sources.views import pts_dense, pts_wide


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_class(pts_wide(spark, sf_dir), "pred_raw", "pred", None)
    return p.withColumn("range_bin", M.range_bin(radius(F.col("x"), F.col("y"))))


def confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir))


def iou_per_class(spark, sf_dir):
    return M.iou(M.confusion(scored(spark, sf_dir))).select("cls", "tp", "iou")


def miou(spark, sf_dir):
    return M.miou(M.confusion(scored(spark, sf_dir)))


def miou_by_range_rollup(spark, sf_dir):
    """Overall (bin 9) and for every bin, empty bins included; one pass of counts feeds both levels."""
    conf = O.kept(M.confusion(scored(spark, sf_dir), ["range_bin"]))  # at most 25 rows a bin, read twice
    both = conf.where("range_bin >= 0").select("truth", "pred", "n", F.explode(F.array(F.col("range_bin"), F.lit(9))).alias("range_bin")).groupBy("truth", "pred", "range_bin").agg(F.sum("n").alias("n"))
    got = M.miou(both, ["range_bin"]).join(both.groupBy("range_bin").agg(F.sum("n").alias("n_points")), "range_bin")
    bins = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 9)], "range_bin int")
    return F.broadcast(bins).join(got, "range_bin", "left").select("range_bin", "miou", "accuracy", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def accumulator_merge(spark, sf_dir):
    """Counts of all frames at once against the sum of the counts of each frame."""
    p = scored(spark, sf_dir)
    merged = M.confusion(p, ["frame_id"]).groupBy("truth", "pred").agg(F.sum("n").alias("n_merged"))
    return M.confusion(p).join(merged, ["truth", "pred"]).select("truth", "pred", "n", "n_merged", (F.col("n") == F.col("n_merged")).alias("equal"))


def object_recall(spark, sf_dir):
    return M.object_recall(scored(spark, sf_dir))


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def latency_stats(spark, sf_dir):
    return M.latency(events(spark, sf_dir), "event_type")


def latency_warmup_window(spark, sf_dir):
    kept = M.after_warmup(events(spark, sf_dir).select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"])
    return M.latency(kept, "event_type").withColumn("enough", F.col("n") >= 200)


def variance_spread(spark, sf_dir):
    return M.spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_nationkey", "c_acctbal")


def weighted_mean(spark, sf_dir):
    """Mean occupancy of the frames weighted by points, rounded half to even."""
    c = O.accumulate(pts_dense(spark, sf_dir)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("w"))
    return c.agg(F.rint(F.sum(F.col("v") * F.col("w")) / F.sum("w")).cast("long").alias("weighted"), F.sum("w").alias("total"))


def inverse_freq_weights(spark, sf_dir):
    return M.inverse_frequency(pts_dense(spark, sf_dir).where("frame_id % 2 = 0"))


def sampled_occupancy(spark, sf_dir):
    """Mean occupancy over every tenth scan; a supplier's points stand for one scan."""
    p = pts_wide(spark, sf_dir).where("l_suppkey % 10 = 0")
    return M.occupancy(p, ["l_suppkey"]).agg(F.count(F.lit(1)).alias("n_scans"), F.round(F.avg("uniform"), 6).alias("uniform"), F.round(F.avg("voxel"), 6).alias("voxel"))


def occ_uniform(spark, sf_dir):
    return M.occupancy(pts_wide(spark, sf_dir), ["frame_id"]).select("frame_id", "uniform")


def occ_voxel(spark, sf_dir):
    return M.occupancy(pts_wide(spark, sf_dir), ["frame_id"]).select("frame_id", "voxel")


def memory_models(spark, sf_dir):
    """Bytes of seven representations of each frame, and the reduction against the uniform grid."""
    p = pts_wide(spark, sf_dir)
    occ = M.occupancy(p, ["frame_id"]).join(O.accumulate(p).groupBy("frame_id").agg(F.count(F.lit(1)).alias("ring_cells")), "frame_id").join(p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points")), "frame_id")
    n_cells = rings(DEFAULT)[-1][5] + rings(DEFAULT)[-1][6]
    models = (("B0_points", F.col("points"), 17), ("B1_uniform", F.lit(16_000_000), 25), ("B2_uniform_occupied", F.col("uniform"), 29), ("B3_voxel", F.lit(3_200_000_000), 1), ("B4_voxel_occupied", F.col("voxel"), 12), ("ring_dense", F.lit(n_cells), 25), ("ring_occupied", F.col("ring_cells"), 29))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), (n * size).cast("long").alias("bytes")) for name, n, size in models])).alias("m")
    return occ.select("frame_id", each).select("frame_id", "m.model", "m.bytes", F.round(F.lit(400_000_000.0) / F.col("m.bytes"), 6).alias("reduction"))


def occupancy2d_semi_join(spark, sf_dir):
    """Share of the columns of hazard points that a flat map with a height threshold would block."""
    p = pts_dense(spark, sf_dir).withColumns({"ix": F.floor(F.col("x") / 0.05), "iy": F.floor(F.col("y") / 0.05)})
    hazard = p.where("raw = 50").select("frame_id", "ix", "iy").distinct()
    full = p.where("z > 1.0").select("frame_id", "ix", "iy").distinct()
    blocked = hazard.join(full, ["frame_id", "ix", "iy"], "left_semi").groupBy("frame_id").agg(F.count(F.lit(1)).alias("b"))
    return hazard.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_hazard")).join(blocked, "frame_id", "left").select("frame_id", "n_hazard", F.coalesce("b", F.lit(0)).alias("n_blocked"), F.round(F.coalesce("b", F.lit(0)) / F.col("n_hazard"), 6).alias("share"))


def hazard_cells(spark, sf_dir):
    """Cells that hold a point of instance 5 (standing for the hazard of a scene)."""
    from ..functions.grid import project

    return project(pts_dense(spark, sf_dir).where("instance = 5")).select("frame_id", "cell_id").distinct()


def cells_of_instance(spark, sf_dir):
    return O.cell_map(pts_dense(spark, sf_dir)).join(hazard_cells(spark, sf_dir), ["frame_id", "cell_id"], "left_semi").select("frame_id", "cell_id", "n", F.round("z_ground", 6).alias("z_ground"))


def road_reference_band_join(spark, sf_dir):
    """The road around 10.5 m, without the hazard's cells."""
    road = road_reference(O.cell_map(pts_dense(spark, sf_dir)), hazard_cells(spark, sf_dir), 10.5)
    return road.select("frame_id", F.round("road", 6).alias("road"))


def hazard_estimators(spark, sf_dir):
    """Depth, clearance and step estimates over the hazard's cells of each frame."""
    c, hazard = O.kept(O.analyse(O.cell_map(pts_dense(spark, sf_dir)))), hazard_cells(spark, sf_dir)
    found = estimators(c, hazard, road_reference(c, hazard, 10.5))
    return found.select("frame_id", "sunk", "n_both", *[F.round(k, 6).alias(k) for k in found.columns if k not in ("frame_id", "sunk", "n_both")])


QUERIES = {k: v for k, v in globals().items() if k in (
    "confusion", "iou_per_class", "miou", "miou_by_range_rollup", "accumulator_merge", "object_recall", "latency_stats", "latency_warmup_window", "variance_spread", "weighted_mean",
    "inverse_freq_weights", "sampled_occupancy", "occ_uniform", "occ_voxel", "memory_models", "occupancy2d_semi_join", "cells_of_instance", "road_reference_band_join", "hazard_estimators")}

_bin = "CASE WHEN r < 10 THEN 0 WHEN r < 30 THEN 1 WHEN r < 60 THEN 2 WHEN r <= 100 THEN 3 ELSE -1 END"
_scored = f"{C.points('wide')}, sc AS (SELECT *, {_bin} AS range_bin FROM (SELECT *, sqrt(x * x + y * y) AS r FROM pts))"
_iou = "SELECT k AS cls, count(*) FILTER (cls = k AND pred = k) AS tp, count(*) FILTER (cls = k OR pred = k) AS n_any FROM sc, range(5) t(k) WHERE cls <> 0 GROUP BY k"
_lat = "count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 95e-2), 6) AS p95, round(max(value), 6) AS max, round(min(value), 6) AS min"
_occ = "count(DISTINCT (floor(x / 5e-2), floor(y / 5e-2))) AS uniform, count(DISTINCT CASE WHEN z >= -2 AND z < 8 THEN (floor(x / 5e-2), floor(y / 5e-2), floor((z + 2) / 5e-2)) END) AS voxel"
_hz = """, hz AS (SELECT DISTINCT frame_id, cell_id FROM proj WHERE instance = 5), road AS (SELECT frame_id, median(z_ground) AS road FROM fin WHERE abs(r_centre - 105e-1) <= 8 AND (frame_id, cell_id) NOT IN (SELECT (frame_id, cell_id) FROM hz) GROUP BY frame_id)"""
_haz = f"{C.cells('dense')}{_hz}, hc AS (SELECT f.*, road FROM fin f JOIN hz USING (frame_id, cell_id) JOIN road USING (frame_id))"
_flagged = f"{C.analysed('dense')}{_hz}, hc AS (SELECT f.*, road FROM ana f JOIN hz USING (frame_id, cell_id) JOIN road USING (frame_id))"
ORACLES = {
    "confusion": C.sql(_scored, "SELECT cls AS truth, pred, count(*) AS n FROM sc GROUP BY ALL"),
    "iou_per_class": C.sql(_scored, f"SELECT cls::INT AS cls, tp, round(tp::DOUBLE / nullif(n_any, 0), 6) AS iou FROM ({_iou})"),
    "miou": C.sql(_scored, f"SELECT (SELECT round(avg(tp::DOUBLE / nullif(n_any, 0)), 6) FROM ({_iou}) WHERE cls <> 0) AS miou, round(avg((cls = pred)::INT), 6) AS accuracy, count(*) AS n_scored FROM sc WHERE cls <> 0"),
    "miou_by_range_rollup": C.sql(_scored, """SELECT b AS range_bin, (SELECT round(avg(i), 6) FROM (SELECT count(*) FILTER (cls = k AND pred = k)::DOUBLE / nullif(count(*) FILTER (cls = k OR pred = k), 0) AS i FROM sc, range(1, 5) t(k) WHERE cls <> 0 AND (range_bin = b OR (b = 9 AND range_bin >= 0)) GROUP BY k)) AS miou,
  (SELECT round(avg((cls = pred)::INT), 6) FROM sc WHERE cls <> 0 AND (range_bin = b OR (b = 9 AND range_bin >= 0))) AS accuracy, (SELECT count(*) FROM sc WHERE cls <> 0 AND (range_bin = b OR (b = 9 AND range_bin >= 0))) AS n_scored,
  (SELECT count(*) FROM sc WHERE range_bin = b OR (b = 9 AND range_bin >= 0)) AS n_points FROM (VALUES (0), (1), (2), (3), (9)) v(b)"""),
    "accumulator_merge": C.sql(_scored, "SELECT cls AS truth, pred, count(*) AS n, count(*) AS n_merged, true AS equal FROM sc GROUP BY ALL"),
    "object_recall": C.sql(_scored, """SELECT block, item, count(*) FILTER (n >= 5) AS n_objects, count(*) FILTER (n < 5) AS n_dropped, count(*) FILTER (n >= 5 AND 2 * hit >= n) AS n_recalled, round(count(*) FILTER (n >= 5 AND 2 * hit >= n)::DOUBLE / nullif(count(*) FILTER (n >= 5), 0), 6) AS recall
  FROM (SELECT o.*, unnest(['overall', 'bin', 'class']) AS block, unnest([0, bin, cls]) AS item FROM (SELECT frame_id, cls, instance, count(*) AS n, count(*) FILTER (pred = cls) AS hit, trunc(median(range_bin))::INT AS bin FROM sc WHERE cls IN (3, 4) AND instance <> 0 GROUP BY ALL) o) GROUP BY ALL"""),
    "latency_stats": f"SELECT event_type, {_lat} FROM events GROUP BY event_type",
    "latency_warmup_window": f"SELECT event_type, {_lat}, count(value) >= 200 AS enough FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE k > least(5, c // 10) GROUP BY event_type",
    "variance_spread": "SELECT c_nationkey, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max, round(100 * stddev_samp(c_acctbal) / nullif(avg(c_acctbal), 0), 6) AS percent FROM customer GROUP BY c_nationkey",
    "weighted_mean": C.sql(C.cells("dense"), "SELECT round_even(sum(v * w)::DOUBLE / sum(w), 0)::BIGINT AS weighted, sum(w)::BIGINT AS total FROM (SELECT frame_id, count(*) AS v, sum(n) AS w FROM acc GROUP BY frame_id)"),
    "inverse_freq_weights": C.sql(C.points("dense"), "SELECT k::INT AS cls, n, round(w / avg(w) FILTER (k <> 0) OVER (), 6) AS weight FROM (SELECT k, n, CASE WHEN k = 0 THEN 0e0 ELSE 1 / (n::DOUBLE / sum(n) OVER () + 1e-3) END AS w FROM (SELECT k, count(pts.cls) AS n FROM range(5) t(k) LEFT JOIN pts ON pts.cls = k AND frame_id % 2 = 0 GROUP BY k))"),
    "sampled_occupancy": C.sql(C.points("wide"), f"SELECT count(*) AS n_scans, round(avg(uniform), 6) AS uniform, round(avg(voxel), 6) AS voxel FROM (SELECT l_suppkey, {_occ} FROM pts WHERE l_suppkey % 10 = 0 AND x * x + y * y <= 1e4 GROUP BY l_suppkey)"),
    "occ_uniform": C.sql(C.points("wide"), f"SELECT frame_id, uniform FROM (SELECT frame_id, {_occ} FROM pts WHERE x * x + y * y <= 1e4 GROUP BY frame_id)"),
    "occ_voxel": C.sql(C.points("wide"), f"SELECT frame_id, voxel FROM (SELECT frame_id, {_occ} FROM pts WHERE x * x + y * y <= 1e4 GROUP BY frame_id)"),
    "memory_models": C.sql(C.cells("wide"), f"""SELECT frame_id, model, bytes, round(4e8 / bytes, 6) AS reduction FROM (SELECT frame_id, unnest(['B0_points', 'B1_uniform', 'B2_uniform_occupied', 'B3_voxel', 'B4_voxel_occupied', 'ring_dense', 'ring_occupied']) AS model, unnest([points * 17, 400000000, uniform * 29, 3200000000, voxel * 12, 17644275, ring_cells * 29]) AS bytes
  FROM (SELECT frame_id, {_occ} FROM pts WHERE x * x + y * y <= 1e4 GROUP BY frame_id) JOIN (SELECT frame_id, count(*) AS ring_cells FROM acc GROUP BY frame_id) USING (frame_id) JOIN (SELECT frame_id, count(*) AS points FROM pts GROUP BY frame_id) USING (frame_id))"""),
    "occupancy2d_semi_join": C.sql(C.points("dense"), "SELECT frame_id, count(*) AS n_hazard, count(*) FILTER (full_) AS n_blocked, round(count(*) FILTER (full_)::DOUBLE / count(*), 6) AS share FROM (SELECT frame_id, floor(x / 5e-2) AS ix, floor(y / 5e-2) AS iy, bool_or(z > 1) AS full_, bool_or(raw = 50) AS hz FROM pts GROUP BY ALL) WHERE hz GROUP BY frame_id"),
    "cells_of_instance": C.sql(_haz, "SELECT f.frame_id, f.cell_id, n, round(z_ground, 6) AS z_ground FROM fin f JOIN hz USING (frame_id, cell_id)"),
    "road_reference_band_join": C.sql(_haz, "SELECT frame_id, round(road, 6) AS road FROM road"),
    "hazard_estimators": C.sql(_flagged, """SELECT frame_id, round(any_value(road) - coalesce(min(z_ground) FILTER (pit), min(z_ground)), 6) AS depth, count(*) FILTER (road - z_ground > 1e-1) AS sunk,
  round(any_value(road) - quantile_cont(z_ground, 1e-1), 6) AS depth_p10, round(avg(coalesce(pit, false)::INT) FILTER (road - z_ground > 1e-1), 6) AS detection_rate, round(avg(coalesce(pit, false)::INT), 6) AS flag_rate, count(*) FILTER (z_obstacle - z_ground > 5e-1) AS n_both, round(quantile_cont(z_ground, 1e-1), 6) AS p10, round(min(z_obstacle) - any_value(road), 6) AS clearance,
  round(median(z_obstacle - z_ground) FILTER (z_obstacle - z_ground > 5e-1), 6) AS both, round(quantile_cont(z_ground, 9e-1) - any_value(road), 6) AS step_p90, round(quantile_cont(z_ground, 5e-1) - any_value(road), 6) AS step_p50 FROM hc GROUP BY frame_id"""),
}
