"""Queries on images, raster, decisions, the document store and synthetic scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import checks as C
from ..config import DEFAULT
from ..functions.grid import project, rings
from ..functions.labels import with_class
from ..operators import cells as O
from ..operators import decision as D
from ..operators import images as I
from ..operators import metrics as M
from ..operators import raycast as R
from ..operators import store as S
from ..operators.lattice import lattice
from ..operators.segment import bbox_class
from ..sources import registry as G
from ..sources.results import shown
from ..sources.views import lineitem, pts_dense, pts_wide

# Primitives of the scenes S2, S3 and S5 (kind, centre, size, class, velocity, hazard).
SCENE = [(0, "plane", 0.0, 0.0, 0.0, 200.0, 200.0, 0.0, 1, 0.0, 0.0, ""), (1, "pit", 12.0, -0.5, -0.11, 1.4, 1.0, 0.22, 2, 0.0, 0.0, "pothole"), (2, "box", 38.0, 0.0, 3.85, 24.0, 20.0, 1.5, 3, 0.0, 0.0, "clearance"),
         (3, "cyl", 38.0, -9.0, 1.55, 1.2, 1.2, 3.1, 3, 0.0, 0.0, ""), (4, "cyl", 38.0, 9.0, 1.55, 1.2, 1.2, 3.1, 3, 0.0, 0.0, ""), (5, "box", 25.0, -16.0, 1.6, 7.0, 2.5, 3.2, 4, 0.0, 8.0, "track")]


def scene(spark):
    return spark.createDataFrame(SCENE, R.SCENE_DDL)


def image(spark, d):
    return I.pixels(pts_wide(spark, d).withColumn("z", F.col("z") - 1.0))


KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def range_pixel(spark, d):
    return I.normalised(image(spark, d)).select("l_orderkey", "l_linenumber", "x", "y", "py", "px", F.round("range", 6).alias("range"), F.round("range_n", 6).alias("range_n"), F.round("intensity_n", 6).alias("intensity_n"))


def depth(spark, d):
    rows = image(spark, d).withColumn("range", F.round("range", 6))
    return rows, I.depth_test(rows, KEYS)


def range_image_depth_test(spark, d):
    return depth(spark, d)[1].select("frame_id", "py", "px", "range", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def knn_vote(spark, d):
    rows, best = depth(spark, d)
    return I.knn_vote(rows, best.select("frame_id", "py", "px", "range", "cls"), [*KEYS, "x", "y", "z"]).select("l_orderkey", "l_linenumber", "x", "y", "vote")


def travelled(spark, d):
    """The map cells that the raster meets, with their scores. The others give the references and neighbours only."""
    c = O.cell_map(pts_wide(spark, d)).select("frame_id", "cell_id", "ring", "bin", "z_ground", "z_obstacle", "roughness", "class_id", "confidence", "moving")
    return O.traversability(O.analyse(c, among=D.raster_cells(spark))).select("frame_id", "cell_id", F.round("trav", 9).alias("trav"), "class_id", "flags")


def frames(spark, d):
    """The frames of the views."""
    return pts_wide(spark, d).select("frame_id").distinct()


def known(spark, d):
    """The known cells of the rasters."""
    return O.kept(D.known(travelled(spark, d)))


def costmap_resample(spark, d):
    return D.resample(travelled(spark, d), frames(spark, d)).select("frame_id", "ix", "iy", F.round("trav", 6).alias("trav"), "class_id", "flags")


def costmap_inflate(spark, d):
    return D.filled(D.inflate(known(spark, d), sparse=True), frames(spark, d)).select("frame_id", "ix", "iy", F.round("trav", 6).alias("trav"), "class_id")


def predicted(spark, d):
    """Track points from the DYNAMIC points of the view: five steps along a velocity that the keys give."""
    p = pts_wide(spark, d).where("cls = 4 AND x > 0").select("frame_id", "l_orderkey", "l_linenumber", F.dense_rank().over(_by_order()).cast("int").alias("track_order"), "x", "y", (F.col("l_partkey") % 5 - 2).alias("vx"), (F.col("l_suppkey") % 5 - 2).alias("vy"))
    return p.select("frame_id", "track_order", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"), "x", "y", "vx", "vy").withColumns({"x": F.col("x") + F.col("vx") * 0.8 * (F.col("step") + 1), "y": F.col("y") + F.col("vy") * 0.8 * (F.col("step") + 1)})


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("frame_id").orderBy("l_orderkey", "l_partkey", "l_suppkey", "x", "y")


def costmap_track_cost(spark, d):
    return D.filled(D.track_cost(known(spark, d), predicted(spark, d), sparse=True), frames(spark, d)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 4).alias("cost"), F.count_if(F.col("cost") >= 1).alias("closed"))


def risk_level(spark, d):
    c = lineitem(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_discount") * 8 + F.col("l_tax")).alias("c"))
    return c.select("l_orderkey", "l_linenumber", F.round("c", 6).alias("mean_cost"), D.risk(F.round("c", 6)).alias("risk"))


def track_route_conflict(spark, d):
    way = frames(spark, d).select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select("frame_id", F.col("k").cast("double").alias("x"), (F.col("k") * 0.25).alias("y"))
    return D.conflicts(predicted(spark, d), way).select("frame_id", "track_order", F.round("t_conflict", 6).alias("t_conflict"))


def decision_of_frame(spark, d):
    """Decisions of the frames: DYNAMIC points of the view as tracks, given routes whose lengths and risks follow the frame's number."""
    p = pts_wide(spark, d).where("cls = 4 AND x > 0").select("frame_id", F.dense_rank().over(_by_order()).alias("track_id"), "x", "y", (F.col("l_partkey") % 5 - 2).alias("vx"), (F.col("l_suppkey") % 5 - 2).alias("vy"), (F.col("l_partkey") % 7).alias("n_cells")).distinct()
    tracks = p.withColumn("predicted", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.array(F.col("x") + F.col("vx") * 0.8 * k, F.col("y") + F.col("vy") * 0.8 * k)))
    f = frames(spark, d).select("frame_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.array(k.cast("double"), k * 0.25)).alias("way"))
    risks = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"))
    route = lambda kind, length, turn: f.select("frame_id", F.lit(kind).alias("kind"), length.cast("double").alias("length"), F.get(risks, (F.col("frame_id") + turn) % 3).alias("risk"), F.round(length / 8, 1).alias("eta"), F.col("way").alias("waypoints"))
    base = F.lit(40) + F.col("frame_id") % 4 * 2
    return D.decide(route("primary", base, 0).union(route("alternative", base + (F.col("frame_id") % 5 - 1) * 7, 1)), tracks).select("frame_id", "selected", "risk", "eta", "extra_km", "track_id", "t_conflict", "reason")


def explain_reason(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.floor(F.col("value") * 10) / 10 + 0.02  # no value lies halfway between two printed ones
    low, hole, track = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0  # several causes hold in some rows
    ctx = e.select(
        "event_id", F.when(track, F.col("user_id")).alias("track_id"), (v / 10).alias("track_speed"), F.when(F.col("event_type") != "click", v).alias("t_conflict"), F.when(low, v).alias("clearance"), v.alias("clearance_range"),
        F.when(hole, v).alias("hole_depth"), v.alias("hole_range"), (v / 1000).alias("extra_km"), F.when(v < 20, "LOW").when(v < 60, "MEDIUM").otherwise("HIGH").alias("alternative_risk"), (v / 500).alias("mean_trav"), (v / 50).alias("max_slope"))
    return D.reason(ctx).select("event_id", "reason")


def decision_log_change(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", F.when(F.col("event_type").isin("error", "view"), "alternative").otherwise("primary").alias("selected"), F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("risk"), F.concat(F.lit("after "), "event_type").alias("reason"))
    return D.decision_log(e, ["user_id"], ["ts", "event_id"], ["selected", "risk", "reason"]).select("user_id", "event_id", "frame_idx", "selected", "risk", "reason", "changed")


def dynamic_cells_edges(spark, d):
    """Pairs of DYNAMIC cells with centres within 1.5 m, by a bucketed distance join."""
    from ..operators.iterative import cell_centres, radius_edges

    return radius_edges(cell_centres(O.dynamic_cells(O.cell_map(pts_wide(spark, d)))), DEFAULT.link).select("frame_id", "a", "b", F.round("dist", 6).alias("dist"))


def bbox_classify(spark, d):
    p = pts_wide(spark, d).where("instance > 0")
    g = p.groupBy("frame_id", "instance").agg(F.count(F.lit(1)).alias("n"), ((F.max("x") - F.min("x")) / 40).alias("sx"), ((F.max("y") - F.min("y")) / 40).alias("sy"), (F.max("z") - F.min("z")).alias("span"), (F.min("z") + 2.5).alias("base"))
    return bbox_class(g).select("frame_id", "instance", "n", "cls")


def lattice_resample(spark, d):
    """A 5 cm lattice over the footprint of every frame, 1.6 million sites a frame at most, each with the map cell that covers it."""
    return lattice(O.cell_map(pts_wide(spark, d))).select("frame_id", "stride", "ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cell_id", "class_id", "n")


def ray_grid(spark, d):
    return R.rays(spark).select("beam", "azimuth", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "dz")])


def scene_motion(spark, d):
    return R.at_frame(scene(spark), 40).select("frame_id", "prim", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


def raycast_nearest_hit(spark, d):
    return R.cast(R.rays(spark, 64, 360), scene(spark)).select("beam", "azimuth", "prim", "cls", *[F.round(c, 5).alias(c) for c in ("t", "x", "y", "z")])


def instance_ids(spark, d):
    return G.instance_ids(scene(spark)).select("prim", "kind", "instance")


def raycast_labels(spark, d):
    """Packed label and intensity of every return, without noise."""
    return R.measured(raycast_nearest_hit(spark, d), G.instance_ids(scene(spark))).select("beam", "azimuth", "word", F.round("intensity", 4).alias("intensity"))


def scene_registry(spark, d):
    """Hazards of the scene, read back from its document."""
    named = scene(spark).withColumns({"name": F.lit("mixed"), "n_frames": F.lit(40), "sha256": F.lit(None).cast("string"), "note": F.lit("")})
    return G.hazards_of(G.documents(named)).select("name", "n_frames", "instance", "tag", F.round("value", 6).alias("value"), F.round("range_m", 6).alias("range_m"), F.round(F.element_at("y", -1), 6).alias("last_y"))


def null_safe_format(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", shown(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), 2).alias("shown"))


def unaccounted_time(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return M.unaccounted(e, "user_id", "event_type", "value", "click").select("user_id", F.round("unaccounted", 4).alias("unaccounted"))


def scene_flat_ground_truth(spark, d):
    """One row for a scene with the four quantities that its hazards define."""
    s = scene(spark)
    pick = lambda tag, v: F.round(F.max(F.when(F.col("hazard") == tag, v)), 6)
    return s.agg(F.count(F.lit(1)).alias("primitives"), pick("pothole", F.col("sz")).alias("pothole_depth"), pick("clearance", F.col("pz") - F.col("sz") / 2).alias("clearance"), pick("step", F.col("pz") + F.col("sz") / 2).alias("curb_height"), pick("track", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).alias("truck_speed"))


def scene_ground_truth(spark, d):
    """Hazards of the scene with their positions in all frames."""
    return R.at_frame(scene(spark).where("hazard <> ''"), 40).groupBy("prim", "hazard").agg(F.sort_array(F.collect_list(F.struct("frame_id", "px", "py"))).alias("positions"))


def scan_left_join_labels(spark, d):
    p = pts_dense(spark, d)
    labels = p.where("frame_id % 3 <> 0 AND l_suppkey % 7 <> 0").groupBy("frame_id", *KEYS).agg(F.max("raw").alias("raw"))
    return S.assemble(p.select("frame_id", *KEYS, "x"), labels, ["frame_id", *KEYS]).groupBy("frame_id", "raw", "has_labels").agg(F.count(F.lit(1)).alias("n"))


def seq_frame_limit(spark, d):
    o = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("sequence"), F.col("l_orderkey").alias("frame_id"))
    return S.first_frames(o, 3).groupBy("sequence").agg(F.count_distinct("frame_id").alias("frames"), F.count(F.lit(1)).alias("n"), F.max("frame_id").alias("last"))


def _frames_of(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 20).alias("sequence"), F.col("o_orderkey").alias("frame_id"), "o_orderstatus").distinct()


def cache_resume_anti_join(spark, d):
    f = _frames_of(spark, d)
    return S.still_missing(f.select("sequence", "frame_id"), f.where("o_orderstatus = 'F'").select("sequence", "frame_id", F.lit("cached").alias("mode")), "cached")


def cache_lookup_join(spark, d):
    f = _frames_of(spark, d).select(S.cache_key(F.col("sequence").cast("string"), F.col("frame_id")).alias("key"), "o_orderstatus")
    want = lineitem(spark, d).groupBy((F.col("l_partkey") % 20).alias("sequence"), F.col("l_orderkey").alias("frame_id")).agg(F.count(F.lit(1)).alias("n"))
    return want.select(S.cache_key(F.col("sequence").cast("string"), F.col("frame_id")).alias("key"), "n").join(f, "key")


def runs(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("uid"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def runs_list_topk(spark, d):
    return S.page(runs(spark, d), 7, 5).select("run_id", "uid", "status")


def decisions_by_run(spark, d):
    return lineitem(spark, d).where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_linenumber", "l_partkey").limit(1000)


def scene_upsert_latest(spark, d):
    return S.latest_by(runs(spark, d).withColumn("name", F.col("uid") % 50), "name", [F.col("started_at"), F.col("run_id")]).select("name", "run_id", "status")


def user_set_on_insert(spark, d):
    r = runs(spark, d)
    return S.latest_by(r, "uid", [F.col("started_at"), F.col("run_id")]).select("uid", "status").join(r.groupBy("uid").agg(F.min("started_at").alias("created_at"), F.count(F.lit(1)).alias("n")), "uid")


def split_leak_intersect(spark, d):
    """Frames that stand in both the training and the validation split."""
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 20).alias("sequence"), F.col("o_orderkey").alias("frame_id"))
    split = lambda rule: o.where(rule).select("sequence").distinct()  # noqa: E731  # 20 sequences, whatever the number of frames
    return split("frame_id % 3 <> 0").intersect(split("frame_id % 3 = 0"))


QUERIES = {k: v for k, v in globals().items() if k in (
    "range_pixel", "range_image_depth_test", "knn_vote", "costmap_resample", "costmap_inflate", "costmap_track_cost", "risk_level", "track_route_conflict", "decision_of_frame", "explain_reason", "decision_log_change", "dynamic_cells_edges",
    "bbox_classify", "lattice_resample", "ray_grid", "scene_motion", "raycast_nearest_hit", "scene_flat_ground_truth", "scene_ground_truth", "scan_left_join_labels", "seq_frame_limit", "cache_resume_anti_join",
    "cache_lookup_join", "runs_list_topk", "decisions_by_run", "scene_upsert_latest", "user_set_on_insert", "split_leak_intersect",
    "instance_ids", "raycast_labels", "scene_registry", "null_safe_format", "unaccounted_time")}

_img = f"""{C.points('wide')}, shifted AS (SELECT * REPLACE (z - 1 AS z) FROM pts),
img AS (SELECT *, sqrt(x * x + y * y + z * z) AS range_, greatest(0, least(floor(5e-1 * (-atan2(y, x) / pi() + 1) * 2048), 2047))::INT AS px,
  greatest(0, least(floor((1 - (asin(greatest(-1, least(z / greatest(sqrt(x * x + y * y + z * z), 1e-6), 1))) - radians(-25)) / (radians(3) - radians(-25))) * 64), 63))::INT AS py FROM shifted),
small AS (SELECT * REPLACE (round(range_, 6) AS range_) FROM img),
best AS (SELECT * FROM small QUALIFY row_number() OVER (PARTITION BY frame_id, py, px ORDER BY range_, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) = 1)"""
_trav = "greatest(0e0, least(1 - (3e-1 * least(slope / 15e0, 1e0) + 2e-1 * least(roughness / 5e-2, 1e0) + 2e-1 * step::INT + 2e-1 * CASE class_id WHEN 1 THEN 0e0 WHEN 2 THEN 5e-1 ELSE 1e0 END + 1e-1 * overhang::INT), 1e0))"
_ras = f"""{C.analysed('wide')}, tr AS (SELECT frame_id, cell_id, class_id, flags, round(CASE WHEN confidence < 96 THEN t * (confidence / 255e0) + 5e-1 * (1 - confidence / 255e0) ELSE t END, 9) AS trav FROM (SELECT *, {_trav} AS t FROM ana)),
xy AS (SELECT ix::INT AS ix, iy::INT AS iy, x, y, sqrt(x * x + y * y) AS r FROM (SELECT ix, iy, (ix + 5e-1) * 25e-2 AS x, (iy + 5e-1) * 25e-2 - 2e1 AS y FROM range(160) a(ix), range(160) b(iy))),
cov AS (SELECT p.ix, p.iy, (d."offset" + greatest(0, least(floor({C.TURN} * d.n_bins), d.n_bins - 1)))::INT AS cell_id FROM (SELECT *, ({C.RING_OF})::INT AS ring FROM xy) p JOIN dim_ring d USING (ring)),
ras AS (SELECT f::INT AS frame_id, ix, iy, coalesce(trav, 5e-1) AS trav, coalesce(class_id, 0) AS class_id, coalesce(flags, 0) AS flags FROM cov CROSS JOIN (SELECT DISTINCT frame_id FROM pts) t(f) LEFT JOIN tr ON tr.frame_id = f AND tr.cell_id = cov.cell_id)"""
_pred = """pr AS (SELECT frame_id, track_order, s AS step, x + vx * 8e-1 * (s + 1) AS x, y + vy * 8e-1 * (s + 1) AS y FROM (SELECT frame_id, dense_rank() OVER (PARTITION BY frame_id ORDER BY l_orderkey, l_partkey, l_suppkey, x, y)::INT AS track_order, x, y, l_partkey % 5 - 2 AS vx, l_suppkey % 5 - 2 AS vy FROM pts WHERE cls = 4 AND x > 0), range(5) t(s))"""
_scene = "sc(prim, kind, px, py, pz, sx, sy, sz, cls, vx, vy, hazard) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v) for v in row) + ")" for row in SCENE) + ")"
_runs = "r AS (SELECT o_orderkey AS run_id, o_custkey AS uid, o_orderdate AS started_at, o_orderstatus AS status FROM orders)"
_fr = "f AS (SELECT DISTINCT o_custkey % 20 AS sequence, o_orderkey AS frame_id, o_orderstatus FROM orders)"


def _sdir(n):
    return f"(CASE WHEN abs({n}) < 1e-12 THEN 1e-12 ELSE {n} END)"


_lo = ["(px - sx / 2 - 0) / " + _sdir("dx"), "(py - sy / 2 - 0) / " + _sdir("dy"), "(pz - sz / 2 - 17e-1) / " + _sdir("dz")]
_hi = ["(px + sx / 2 - 0) / " + _sdir("dx"), "(py + sy / 2 - 0) / " + _sdir("dy"), "(pz + sz / 2 - 17e-1) / " + _sdir("dz")]
_near = "greatest(" + ", ".join(f"least({a}, {b})" for a, b in zip(_lo, _hi, strict=True)) + ")"
_far = "least(" + ", ".join(f"greatest({a}, {b})" for a, b in zip(_lo, _hi, strict=True)) + ")"


def _rays(beams, azimuths):
    return f"rays AS (SELECT b::INT AS beam, a::INT AS azimuth, cos(e) * cos(z) AS dx, cos(e) * sin(z) AS dy, sin(e) AS dz FROM (SELECT b, a, radians(3 - 28e0 * b / {beams - 1}) AS e, 2 * pi() * a / {azimuths} AS z FROM range({beams}) x(b), range({azimuths}) y(a)))"


def _cap(z):
    t = f"(({z} - 17e-1) / {_sdir('dz')})"
    return f"CASE WHEN {t} > 1e-6 AND pow({t} * dx - px, 2) + pow({t} * dy - py, 2) <= sx * sx / 4 THEN {t} END"


_cyl = "(-b - sqrt(greatest(q, 0))) / a"
ORACLES = {
    "range_pixel": C.sql(_img, "SELECT l_orderkey, l_linenumber, x, y, py, px, round(range_, 6) AS range, round((range_ - 12.12::DOUBLE) / 12.32::DOUBLE, 6) AS range_n, round((intensity - 0.21::DOUBLE) / 0.16::DOUBLE, 6) AS intensity_n FROM img"),
    "range_image_depth_test": C.sql(_img, "SELECT frame_id, py, px, range_ AS range, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM best"),
    "knn_vote": C.sql(_img, """SELECT l_orderkey, l_linenumber, x, y, CASE WHEN top > 0 THEN list_position(votes, top) - 1 ELSE coalesce(own_cls, 0) END::INT AS vote FROM (SELECT *, list_max(votes) AS top FROM (SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, any_value(x) AS x, any_value(y) AS y, max(c) FILTER (dy = 0 AND dx = 0) AS own_cls,
  [round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = v), 0), 9) for v in [0]] AS unused,
  [round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = 0), 0), 9), round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = 1), 0), 9), round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = 2), 0), 9), round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = 3), 0), 9), round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = 4), 0), 9)] AS votes
  FROM (SELECT p.rid, p.l_orderkey, p.l_linenumber, p.x, p.y, i.cls AS c, i.py - p.py AS dy, i.px - p.px AS dx, round(abs(i.range_ - p.range_), 9) AS d, row_number() OVER (PARTITION BY p.rid ORDER BY round(abs(i.range_ - p.range_), 9), i.py - p.py, i.px - p.px, i.cls) AS k
    FROM (SELECT *, unnest([py - 2, py - 1, py, py + 1, py + 2]) AS near_py FROM (SELECT *, row_number() OVER () AS rid FROM small)) p JOIN best i ON i.frame_id = p.frame_id AND i.py = p.near_py AND abs(i.px - p.px) <= 2) GROUP BY rid))""".replace("  [round(coalesce(sum(exp(-d * d / 2)) FILTER (k <= 5 AND d <= 1 AND c = v), 0), 9) for v in [0]] AS unused,\n", "")),
    "costmap_resample": C.sql(_ras, "SELECT frame_id, ix, iy, round(trav, 6) AS trav, class_id, flags FROM ras"),
    "costmap_inflate": C.sql(_ras + ", hard AS MATERIALIZED (SELECT frame_id, ix, iy FROM ras WHERE class_id IN (3, 4)), shifts AS MATERIALIZED (SELECT a, b FROM range(-5, 6) x(a), range(-5, 6) y(b) WHERE abs(a) + abs(b) <= 5)", """SELECT r.frame_id, r.ix, r.iy, round(CASE WHEN h.ix IS NOT NULL AND r.class_id NOT IN (3, 4) THEN 0 ELSE r.trav END, 6) AS trav, r.class_id FROM ras r LEFT JOIN (SELECT DISTINCT frame_id, ix + a AS ix, iy + b AS iy FROM hard, shifts) h ON h.frame_id = r.frame_id AND h.ix = r.ix AND h.iy = r.iy"""),
    "costmap_track_cost": C.sql(f"{_ras}, {_pred}", """SELECT frame_id, count(*) AS n, round(sum(cost), 4) AS cost, count(*) FILTER (cost >= 1) AS closed FROM (SELECT r.frame_id, greatest(0, least(1 - CASE WHEN hits IS NULL THEN trav ELSE greatest(0, trav - 3e-1 * hits) END, 1)) AS cost
  FROM ras r LEFT JOIN (SELECT frame_id, floor(x / 25e-2) AS ix, floor((y + 20) / 25e-2) AS iy, count(*) AS hits FROM pr GROUP BY ALL) h USING (frame_id, ix, iy)) GROUP BY frame_id"""),
    "risk_level": "SELECT l_orderkey, l_linenumber, round(l_discount * 8 + l_tax, 6) AS mean_cost, CASE WHEN round(l_discount * 8 + l_tax, 6) < 25e-2 THEN 'LOW' WHEN round(l_discount * 8 + l_tax, 6) < 55e-2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM lineitem",
    "track_route_conflict": C.sql(f"{C.points('wide')}, {_pred}", "SELECT frame_id, track_order, round(8e-1 * (step + 1), 6) AS t_conflict FROM (SELECT p.*, row_number() OVER (PARTITION BY frame_id ORDER BY track_order, step) AS k FROM pr p JOIN range(40) t(w) ON pow(p.x - w, 2) + pow(p.y - w * 25e-2, 2) < 9) WHERE k = 1"),
    "explain_reason": """SELECT event_id, CASE WHEN event_id % 5 = 0 AND user_id IS NOT NULL AND event_type <> 'click' THEN printf('Rerouted: track #%d (DYNAMIC_OBJECT, %.1f m/s) predicted to intersect primary route at t+%.1f s.', user_id, value / 10, value) || extra
  WHEN event_id % 2 = 0 THEN printf('Primary route blocked: overhead clearance %.2f m below vehicle height 3.50 m at %.0f m ahead.', value, value) || extra
  WHEN event_id % 3 = 0 THEN printf('Primary route blocked: negative obstacle depth %.2f m at %.0f m ahead.', value, value) || extra
  ELSE printf('Primary route selected: mean traversability %.2f, max slope %.1f°, no dynamic conflicts within 4 s.', value / 500, value / 50) END AS reason
  FROM (SELECT *, CASE WHEN value / 1000 > 5e-3 THEN printf(' Alternative adds %.1f km at ', value / 1000) ELSE ' Alternative at ' END || CASE WHEN value < 20 THEN 'LOW' WHEN value < 60 THEN 'MEDIUM' ELSE 'HIGH' END || ' terrain risk.' AS extra FROM (SELECT * REPLACE (floor(value * 10) / 10 + 2e-2 AS value) FROM events))""",
    "decision_log_change": """SELECT user_id, event_id, frame_idx::INT AS frame_idx, selected, risk, reason, changed FROM (SELECT *, row_number() OVER w - 1 AS frame_idx, coalesce(lag(selected) OVER w <> selected OR lag(risk) OVER w <> risk OR lag(reason) OVER w <> reason, true) AS changed FROM (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('error', 'view') THEN 'alternative' ELSE 'primary' END AS selected, CASE WHEN event_type = 'error' THEN 'HIGH' ELSE 'LOW' END AS risk, 'after ' || event_type AS reason FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE frame_idx % 60 = 0 OR changed""",
    "dynamic_cells_edges": C.sql(f"{C.cells('wide')}, ce AS (SELECT frame_id, cell_id, r_centre * cos((bin + 5e-1) / n_bins * 2 * pi()) AS cx, r_centre * sin((bin + 5e-1) / n_bins * 2 * pi()) AS cy FROM fin WHERE class_id = 4)", "SELECT p.frame_id, p.cell_id AS a, q.cell_id AS b, round(sqrt(pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2)), 6) AS dist FROM ce p JOIN ce q ON p.frame_id = q.frame_id AND p.cell_id < q.cell_id AND pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2) <= 225e-2"),
    "bbox_classify": C.sql(C.points("wide"), """SELECT frame_id, instance, n, CASE WHEN n < 12 THEN 0 WHEN base > 6e-1 THEN 3 WHEN span <= 35e-2 AND foot >= 3 THEN 2 WHEN (span BETWEEN 8e-1 AND 45e-1 AND foot BETWEEN 15e-1 AND 9e0 AND foot >= span) OR (span BETWEEN 8e-1 AND 22e-1 AND foot <= 12e-1) THEN 4 ELSE 3 END AS cls
  FROM (SELECT frame_id, instance, count(*) AS n, greatest((max(x) - min(x)) / 40, (max(y) - min(y)) / 40) AS foot, max(z) - min(z) AS span, min(z) + 25e-1 AS base FROM pts WHERE instance > 0 GROUP BY ALL)"""),
    "lattice_resample": C.sql(f"""{C.cells('wide')},
foot AS MATERIALIZED (SELECT frame_id, round(greatest(min(cx), -1e2), 6) AS x0, round(greatest(min(cy), -1e2), 6) AS y0, round(least(max(cx), 1e2), 6) AS x1, round(least(max(cy), 1e2), 6) AS y1
  FROM (SELECT frame_id, r_centre * cos((bin + 5e-1) * 2 * pi() / n_bins) AS cx, r_centre * sin((bin + 5e-1) * 2 * pi() / n_bins) AS cy FROM fin) GROUP BY frame_id),
sized_ AS (SELECT *, greatest(1, ceil(sqrt(nx * ny / 16e5)))::BIGINT AS stride FROM (SELECT *, greatest(1, ceil((x1 - x0) / 5e-2))::BIGINT AS nx, greatest(1, ceil((y1 - y0) / 5e-2))::BIGINT AS ny FROM foot)),
sites AS (SELECT frame_id, stride, ix, y0, x0 + (ix + 5e-1) * 5e-2 AS x, unnest(range(0, ny, stride)) AS iy FROM (SELECT *, unnest(range(0, nx, stride)) AS ix FROM sized_)),
xy AS (SELECT *, sqrt(x * x + y * y) AS r FROM (SELECT frame_id, stride, ix, iy, x, y0 + (iy + 5e-1) * 5e-2 AS y FROM sites))""", f"""SELECT frame_id, stride, ix, iy, round(x, 6) AS x, round(y, 6) AS y, cell_id, class_id, n FROM (SELECT p.frame_id, stride, ix, iy, x, y, (d."offset" + greatest(0, least(floor({C.TURN} * d.n_bins), d.n_bins - 1)))::INT AS cell_id FROM (SELECT *, ({C.RING_OF})::INT AS ring FROM xy) p JOIN dim_ring d USING (ring)) JOIN (SELECT frame_id, cell_id, class_id, n FROM fin) USING (frame_id, cell_id)"""),
    "ray_grid": C.sql(_rays(64, 1800), "SELECT beam, azimuth, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM rays"),
    "scene_motion": C.sql(_scene, "SELECT f::INT AS frame_id, prim, round(px + vx * f * 1e-1, 6) AS px, round(py + vy * f * 1e-1, 6) AS py FROM sc, range(40) t(f)"),
    "raycast_nearest_hit": C.sql(f"""{_scene}, {_rays(64, 360)},
h AS (SELECT *, CASE kind WHEN 'plane' THEN CASE WHEN tp > 1e-6 AND abs(tp * dx - px) <= sx / 2 AND abs(tp * dy - py) <= sy / 2 THEN tp END WHEN 'box' THEN CASE WHEN n <= f AND f > 1e-6 THEN CASE WHEN n > 1e-6 THEN n ELSE f END END WHEN 'pit' THEN CASE WHEN n <= f AND f > 1e-6 THEN f END
  ELSE least(CASE WHEN q >= 0 AND {_cyl} > 1e-6 AND abs(17e-1 + {_cyl} * dz - pz) <= sz / 2 THEN {_cyl} END, {_cap('(pz + sz / 2)')}, {_cap('(pz - sz / 2)')}) END AS t
  FROM (SELECT *, b * b - a * (px * px + py * py - sx * sx / 4) AS q FROM (SELECT *, {_near} AS n, {_far} AS f, (pz - 17e-1) / {_sdir('dz')} AS tp, greatest(dx * dx + dy * dy, 1e-12) AS a, -(dx * px + dy * py) AS b FROM rays, sc))),
k AS (SELECT * FROM h WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sc p WHERE p.kind = 'pit' AND p.prim <> h.prim AND abs(h.t * h.dx - p.px) <= p.sx / 2 + 1e-6 AND abs(h.t * h.dy - p.py) <= p.sy / 2 + 1e-6 AND abs(17e-1 + h.t * h.dz - p.pz) <= p.sz / 2 + 1e-6))""",
        "SELECT beam, azimuth, prim, cls, round(t, 5) AS t, round(t * dx, 5) AS x, round(t * dy, 5) AS y, round(17e-1 + t * dz, 5) AS z FROM (SELECT *, row_number() OVER (PARTITION BY beam, azimuth ORDER BY round(t, 9), prim) AS w FROM k) WHERE w = 1 AND t > 0 AND t <= 100"),
    "scene_flat_ground_truth": C.sql(_scene, "SELECT count(*) AS primitives, round(max(sz) FILTER (hazard = 'pothole'), 6) AS pothole_depth, round(max(pz - sz / 2) FILTER (hazard = 'clearance'), 6) AS clearance, round(max(pz + sz / 2) FILTER (hazard = 'step'), 6) AS curb_height, round(max(sqrt(vx * vx + vy * vy)) FILTER (hazard = 'track'), 6) AS truck_speed FROM sc"),
    "scan_left_join_labels": C.sql(C.points("dense"), "SELECT frame_id, CASE WHEN frame_id % 3 <> 0 AND l_suppkey % 7 <> 0 THEN m ELSE 0 END AS raw, frame_id % 3 <> 0 AS has_labels, count(*) AS n FROM (SELECT *, max(raw) OVER (PARTITION BY frame_id, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS m FROM pts) GROUP BY ALL"),
    "seq_frame_limit": "SELECT sequence, count(DISTINCT frame_id) AS frames, count(*) AS n, max(frame_id) AS last FROM (SELECT l_suppkey AS sequence, l_orderkey AS frame_id, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM lineitem) WHERE k <= 3 GROUP BY sequence",
    "cache_resume_anti_join": C.sql(_fr, "SELECT sequence, frame_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.sequence = a.sequence AND b.frame_id = a.frame_id AND b.o_orderstatus = 'F')"),
    "cache_lookup_join": C.sql(_fr, "SELECT key, n, o_orderstatus FROM (SELECT printf('%d/%06d', sequence, frame_id) AS key, o_orderstatus FROM f) JOIN (SELECT printf('%d/%06d', l_partkey % 20, l_orderkey) AS key, count(*) AS n FROM lineitem GROUP BY ALL) USING (key)"),
    "runs_list_topk": C.sql(_runs, "SELECT run_id, uid, status FROM r WHERE uid = 7 ORDER BY started_at DESC, run_id DESC LIMIT 5"),
    "decisions_by_run": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber, l_partkey LIMIT 1000",
    "scene_upsert_latest": C.sql(_runs, "SELECT name, run_id, status FROM (SELECT *, uid % 50 AS name, row_number() OVER (PARTITION BY uid % 50 ORDER BY started_at DESC, run_id DESC) AS k FROM r) WHERE k = 1"),
    "user_set_on_insert": C.sql(_runs, "SELECT uid, status, created_at, n FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY started_at DESC, run_id DESC) AS k, min(started_at) OVER (PARTITION BY uid) AS created_at, count(*) OVER (PARTITION BY uid) AS n FROM r) WHERE k = 1"),
    "split_leak_intersect": C.sql(_fr, "SELECT sequence FROM f WHERE frame_id % 3 <> 0 INTERSECT SELECT sequence FROM f WHERE frame_id % 3 = 0"),
}
_numbered = f"{_scene}, num AS (SELECT *, CASE WHEN kind = 'plane' THEN 0 ELSE sum((kind <> 'plane')::INT) OVER (ORDER BY prim) END::INT AS instance FROM sc)"
ORACLES |= {
    "instance_ids": C.sql(_numbered, "SELECT prim, kind, instance FROM num"),
    "raycast_labels": C.sql(_numbered, f"""SELECT beam, azimuth, (instance * 65536 + CASE WHEN h.cls = 4 AND (vx <> 0 OR vy <> 0) THEN 258 WHEN h.cls = 1 THEN 40 WHEN h.cls = 2 THEN 72 WHEN h.cls = 3 THEN 50 WHEN h.cls = 4 THEN 18 ELSE 0 END)::BIGINT AS word,
  round([10e-2, 18e-2, 30e-2, 45e-2, 55e-2][h.cls + 1] / (1 + pow(t / 40, 2)), 4) AS intensity FROM ({ORACLES["raycast_nearest_hit"]}) h JOIN num USING (prim)"""),
    "scene_registry": C.sql(_numbered, """SELECT 'mixed' AS name, 40 AS n_frames, instance, hazard AS tag, round(CASE hazard WHEN 'pothole' THEN sz WHEN 'clearance' THEN pz - sz / 2 WHEN 'step' THEN pz + sz / 2 ELSE sqrt(vx * vx + vy * vy) END, 6) AS value,
  round(sqrt(px * px + py * py), 6) AS range_m, round(py + vy * 39e-1, 6) AS last_y FROM num WHERE hazard <> ''"""),
    "null_safe_format": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN printf('%.2f', c_acctbal) ELSE '—' END AS shown FROM customer",
    "unaccounted_time": "SELECT user_id, round(sum(value) FILTER (event_type = 'click') - coalesce(sum(value) FILTER (event_type <> 'click'), 0), 4) AS unaccounted FROM events GROUP BY user_id",
}
ORACLES["decision_of_frame"] = C.sql(C.points("wide"), """SELECT f.frame_id, CASE WHEN track_id IS NULL THEN 'primary' ELSE 'alternative' END AS selected, ['LOW', 'MEDIUM', 'HIGH'][(f.frame_id + (track_id IS NOT NULL)::INT) % 3 + 1] AS risk, round((40 + f.frame_id % 4 * 2) / 8e0, 1) AS eta, extra_km, track_id, t_conflict,
  CASE WHEN track_id IS NULL THEN 'Primary route selected: mean traversability 0.91, max slope 0.0°, no dynamic conflicts within 4 s.' ELSE printf('Rerouted: track #%d (DYNAMIC_OBJECT, %.1f m/s) predicted to intersect primary route at t+%.1f s.', track_id, speed, t_conflict)
    || CASE WHEN extra_km > 5e-3 THEN printf(' Alternative adds %.1f km at ', extra_km) ELSE ' Alternative at ' END || ['LOW', 'MEDIUM', 'HIGH'][(f.frame_id + 1) % 3 + 1] || ' terrain risk.' END AS reason
  FROM (SELECT DISTINCT frame_id, round(greatest(0e0, (frame_id % 5 - 1) * 7e0) / 1000, 3) AS extra_km FROM pts) f LEFT JOIN (SELECT frame_id, track_id, sqrt(vx * vx + vy * vy) AS speed, round(8e-1 * (s + 1), 1) AS t_conflict FROM (
    SELECT t.*, s, row_number() OVER (PARTITION BY frame_id ORDER BY n_cells DESC, track_id, s) AS k FROM (SELECT DISTINCT frame_id, dense_rank() OVER (PARTITION BY frame_id ORDER BY l_orderkey, l_partkey, l_suppkey, x, y)::INT AS track_id, x, y, l_partkey % 5 - 2 AS vx, l_suppkey % 5 - 2 AS vy, l_partkey % 7 AS n_cells FROM pts WHERE cls = 4 AND x > 0) t, range(5) a(s), range(10) b(w)
    WHERE pow(x + vx * 8e-1 * (s + 1) - w, 2) + pow(y + vy * 8e-1 * (s + 1) - w * 25e-2, 2) < 9) WHERE k = 1) USING (frame_id)""")
