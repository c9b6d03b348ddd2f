from pyspark.sql import functions as F

from ringfield.operators import metrics as M


def test_iou_by_hand(spark):
    rows = [(1, 1, 8), (1, 2, 2), (2, 2, 5), (2, 0, 5), (0, 1, 100)]
    conf = spark.createDataFrame(rows, "truth int, pred int, n long")
    got = {r.cls: r.iou for r in M.iou(conf).collect()}
    assert got[1] == 0.8 and got[2] == round(5 / 12, 6) and got[3] is None
    m = M.miou(conf).first()
    assert m.miou == round((0.8 + 5 / 12) / 2, 6) and m.accuracy == 0.65 and m.n_scored == 20


def test_recall_drops_small_objects(spark):
    rows = [(0, 4, 1, 4, 0)] * 5 + [(0, 4, 2, 3, 1)] * 5 + [(0, 3, 3, 3, 2)] * 4 + [(0, 3, 4, 3, 1)] * 3 + [(0, 3, 4, 0, 0)] * 3
    p = spark.createDataFrame(rows, "frame_id int, cls int, instance int, pred int, range_bin int")
    got = {(r.block, r["item"]): r for r in M.object_recall(p).collect()}
    assert (got["overall", 0].n_objects, got["overall", 0].n_recalled, got["overall", 0].n_dropped) == (3, 2, 1)
    assert got["class", 3].recall == 1.0 and got["bin", 0].n_objects == 2  # the median of bins 0 and 1 is cut to 0


def test_warmup(spark):
    s = spark.range(60).select(F.lit("a").alias("seq"), "id", F.when(F.col("id") < 5, 1000.0).otherwise(1.0).alias("value"))
    assert M.latency(M.after_warmup(s, "seq", ["id"]), "seq").first()["max"] == 1.0
    few = s.where("id < 8")
    assert M.latency(M.after_warmup(few, "seq", ["id"]), "seq").first()["n"] == 8


def test_spread_of_one_value(spark):
    r = M.spread(spark.createDataFrame([("a", 2.0)], "k string, v double"), "k", "v").first()
    assert r.sd is None and r.percent is None and r["mean"] == 2.0
