"""Queries that go through the stores: scan files, the label cache, stored scores of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import checks as C
from ..operators.cells import new_folder
from ..sources.doctable import KeyedTable, decision_rows
from ..sources.labelcache import LabelCache
from ..sources.logstream import log_stream
from ..sources.replay import write_log
from ..sources.scanstore import read_points, write_scans
from ..sources.views import pts_wide
from ..streaming.scores import score_stream, stored_counts
from . import scores


def scan_store_roundtrip(spark, d):
    """Points of the wide view as scan and label files and back: counts, label sums and extents of every frame."""
    place = F.row_number().over(_order())
    p = pts_wide(spark, d).select(F.lit("wide").alias("sequence"), "frame_id", (place - 1).alias("point_idx"), "x", "y", "z", "intensity", (F.col("instance") * 65536 + F.col("raw")).alias("word"))
    root = new_folder(spark, "scans")
    write_scans(p, root)
    back = read_points(spark, root)
    return back.groupBy("sequence", "frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("word").alias("words"), F.max("point_idx").alias("last"), *[F.round(f(c).cast("double"), 4).alias(f"{k}_{c}") for c in ("x", "y", "z") for k, f in (("min", F.min), ("max", F.max))])


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("frame_id").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")  # a frame is of bounded size


def label_cache_index(spark, d):
    """The classes of every frame's points in a cache of labels, looked up by key: where they lie and how many are DYNAMIC."""
    p = pts_wide(spark, d).select(F.format_string("wide/%06d", "frame_id").alias("key"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cls")

    own = p.groupBy("key").agg(F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_list(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cls"))).alias("c"))
    labelled = own.select("key", "n_points", F.unhex(F.array_join(F.transform("c", lambda e: F.concat(F.lit("0"), e["cls"].cast("string"))), "")).alias("labels"))
    # One pass over the points; a part of the cache then reads the files that hold its keys.
    root = new_folder(spark, "segmented")
    labelled.repartitionByRange("key").sortWithinPartitions("key").write.parquet(root)
    table = spark.read.schema(labelled.schema).parquet(root)

    def segment(frames):
        first, last = frames.agg(F.min("key"), F.max("key")).first()
        return table.where(F.col("key").between(first, last)).join(frames.select("key"), "key", "left_semi").select("key", "labels")

    cache = LabelCache(spark, new_folder(spark, "labels"))
    frames = table.select("key", "n_points", F.concat("key", F.lit(".bin")).alias("file"))
    cache.build(frames, segment, "view")
    return cache.of(frames.select("key")).select("position", "key", "offset", "n_points", F.length(F.regexp_replace(F.hex("labels"), "[^4]", "")).cast("long").alias("n_dynamic"))


def stream_confusion(spark, d):
    """Confusion counts of the points as a stream in micro-batches, read from the stored totals."""
    p = scores.scored(spark, d).select("cls", "pred")
    folder = new_folder(spark, "stream")
    p.write.parquet(f"{folder}/points")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/points")
    query = score_stream(stream, f"{folder}/scores").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored_counts(spark, f"{folder}/scores").select("truth", "pred", "n")


def runs_close_merge(spark, d):
    """All orders as runs of a stored table; finished ones are closed by update, a third of them with another user than theirs."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("uid"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    table = KeyedTable.create(spark, new_folder(spark, "runs"), "run_id long, uid long, started_at timestamp_ntz, status string, finished_at timestamp_ntz", ["run_id"], ["uid", "started_at", "run_id"], 16)
    table.insert(o)
    closed = o.where("status = 'F'").select("run_id", F.when(F.col("run_id") % 3 == 0, F.col("uid") + 1).otherwise(F.col("uid")).alias("uid"), F.expr("started_at + INTERVAL 1 DAY").alias("finished_at"))
    table.update(closed, ["finished_at"], ("uid",))
    return table.read().select("run_id", "uid", "status", "started_at", "finished_at")


def decisions_batch_insert(spark, d):
    """Events as decision records in requests of 400, some fields of a wrong type, stored by run and frame and read back."""
    e = spark.read.parquet(f"{d}/events.parquet")
    record = F.concat(
        F.lit('{"frameId":'), F.col("event_id").cast("string"), F.lit(',"tSec":'), F.when(F.col("event_type") == "click", '"late"').otherwise(F.coalesce(F.round("value", 3).cast("string"), F.lit("null"))),
        F.lit(',"selected":'), F.when(F.col("event_type") == "error", "7").otherwise('"primary"'), F.lit(',"trackIds":[1,"x",'), F.col("user_id").cast("string"), F.lit('],"changed":'), F.when(F.col("event_type") == "view", '"true"').otherwise("true"), F.lit("}"))
    rows = decision_rows(e.select(F.col("user_id").alias("run_id"), F.lit("u").alias("uid"), F.floor(F.col("event_id") / 400).alias("request"), record.alias("record")))
    table = KeyedTable.create(spark, new_folder(spark, "decisions"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), ["run_id", "frame_id"], buckets=16)
    table.insert(rows)
    return table.read().select("run_id", F.col("frame_id").cast("long").alias("frame_id"), F.round("t_sec", 3).alias("t_sec"), "selected", "risk", F.element_at("track_ids", -1).cast("long").alias("last_track"), F.size("track_ids").alias("n_tracks"), "changed")


def log_stream_replay(spark, d):
    """Orders as messages of a frame log, read back as a stream in micro-batches of which each takes what is left."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("frame_id"), F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").cast("binary").alias("message"))
    folder = new_folder(spark, "log")
    write_log(o, f"{folder}/log")
    query = log_stream(spark, f"{folder}/log").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema("index long, part int, pos long, message binary").parquet(f"{folder}/rows").select("index", F.length("message").alias("size"), F.md5("message").alias("digest"))


QUERIES = {"runs_close_merge": runs_close_merge, "decisions_batch_insert": decisions_batch_insert, "log_stream_replay": log_stream_replay, "scan_store_roundtrip": scan_store_roundtrip, "label_cache_index": label_cache_index, "stream_confusion": stream_confusion}
_ends = ", ".join(f"round({f}({c}::FLOAT)::DOUBLE, 4) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))
ORACLES = {
    "scan_store_roundtrip": C.sql(C.points("wide"), f"SELECT 'wide' AS sequence, frame_id, count(*) AS n, sum(instance * 65536 + raw)::BIGINT AS words, (count(*) - 1)::INT AS last, {_ends} FROM pts GROUP BY frame_id"),
    "label_cache_index": C.sql(C.points("wide"), "SELECT row_number() OVER (ORDER BY frame_id) - 1 AS position, printf('wide/%06d', frame_id) AS key, (sum(n) OVER (ORDER BY frame_id) - n)::BIGINT AS \"offset\", n AS n_points, n_dynamic FROM (SELECT frame_id, count(*) AS n, count(*) FILTER (cls = 4) AS n_dynamic FROM pts GROUP BY frame_id)"),
    "runs_close_merge": "SELECT o_orderkey AS run_id, o_custkey AS uid, o_orderstatus AS status, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS finished_at FROM orders",
    "decisions_batch_insert": "SELECT user_id AS run_id, event_id AS frame_id, CASE WHEN event_type = 'click' THEN 0e0 ELSE round(coalesce(value, 0), 3) END AS t_sec, CASE WHEN event_type = 'error' THEN '' ELSE 'primary' END AS selected, '' AS risk, user_id AS last_track, 2 AS n_tracks, event_type <> 'view' AS changed FROM events",
    "log_stream_replay": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, strlen(m) AS size, md5(m) AS digest FROM (SELECT o_orderkey, concat_ws('|', o_orderkey, o_custkey, o_orderstatus) AS m FROM orders)",
    "stream_confusion": scores.ORACLES["confusion"],
}
