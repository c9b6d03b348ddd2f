"""Stored tables with a unique key: merges, versions, look-ups, and decisions from requests."""

import os

import pytest
from pyspark.sql import functions as F

from ringfield.sources.doctable import KeyedTable, Merged, decision_rows

RUNS = "run_id long, uid long, started_at string, finished_at string, status string"


def runs(spark, ids, status="open"):
    return spark.createDataFrame([(k, k % 5, f"t{k:03d}", None, status) for k in ids], RUNS)


def rows(t, *columns):
    return sorted(map(tuple, t.select(*columns).collect()))


def test_closing_a_run_changes_only_its_end(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path / "runs"), RUNS, ["run_id"], ["uid", "started_at", "run_id"], 8)
    assert t.read().count() == 0 and t.insert(runs(spark, range(40))) == Merged(40, 0, 40, 8)
    close = spark.createDataFrame([(7, 2, "end", "lost"), (8, 1, "end", "lost"), (99, 4, "end", "lost")], "run_id long, uid long, finished_at string, status string")
    # Run 8 belongs to another user and run 99 does not exist; the status is not among the columns that may change.
    assert t.update(close, ["finished_at"], ("uid",)) == Merged(0, 1, 1, 1)
    assert rows(t.read().where("finished_at IS NOT NULL"), "run_id", "uid", "finished_at", "status") == [(7, 2, "end", "open")]
    folders = sorted(os.listdir(tmp_path / "runs" / "data"))
    assert len(folders) == 2 and sum(d.startswith("bucket__=") for d in os.listdir(tmp_path / "runs" / "data" / folders[0])) + sum(d.startswith("bucket__=") for d in os.listdir(tmp_path / "runs" / "data" / folders[1])) == 9
    # The same again changes nothing and writes nothing; earlier versions stay.
    before = t.version()
    assert t.update(close, ["finished_at"], ("uid",)) == Merged(0, 1, 0, 0) and t.insert(runs(spark, range(3))) == Merged(0, 3, 0, 0)
    assert t.version() == before and t.read(1).where("finished_at IS NOT NULL").count() == 0 and t.read(0).count() == 0
    with pytest.raises(ValueError, match="other values"):
        t.insert(runs(spark, [3, 50], "new"))
    assert t.version() == before and t.read().count() == 40


def test_upsert_sets_some_columns_for_new_rows_only(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path), RUNS, ["run_id"], buckets=4)
    assert t.upsert(runs(spark, [1, 2]), ("started_at",)).inserted == 2
    again = runs(spark, [2, 3], "seen").withColumn("started_at", F.lit("later")).withColumn("more", F.lit(1))
    told = t.upsert(again, ("started_at",))
    assert (told.inserted, told.matched, told.changed) == (1, 1, 2) and t.upsert(again, ("started_at",)) == Merged(0, 2, 0, 0)
    assert rows(t.read(), "run_id", "started_at", "status") == [(1, "t001", "open"), (2, "t002", "seen"), (3, "later", "seen")]


def test_keys_are_unique_and_not_null(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path), RUNS, ["run_id"], buckets=4)
    for bad in (runs(spark, [1, 1]), runs(spark, [1]).withColumn("run_id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="null nor occur twice"):
            t.insert(bad)
    assert t.insert(runs(spark, [])) == Merged(0, 0, 0, 0) and t.version() == 0
    t.insert(runs(spark, range(10)))
    t.check_unique("started_at")
    with pytest.raises(ValueError, match="occurs twice"):
        t.check_unique("uid")
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, str(tmp_path), RUNS, ["run_id"])


def test_look_ups_read_the_buckets_of_their_keys(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path), RUNS, ["run_id"], buckets=16)
    t.insert(runs(spark, range(200)))
    found = t.find(spark.createDataFrame([(17,), (900,)], "run_id int"))
    assert rows(found, "run_id", "started_at") == [(17, "t017")]
    assert len({os.path.dirname(f) for f in found.inputFiles()}) <= 2 < len({os.path.dirname(f) for f in t.read().inputFiles()})
    assert "PushedFilters: [IsNotNull(uid), EqualTo(uid,3)]" in t.read().where("uid = 3")._jdf.queryExecution().toString()


def test_two_writers_of_one_version(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path), RUNS, ["run_id"], buckets=2)
    late = KeyedTable(spark, str(tmp_path))
    late.version = lambda: 0  # it has read the version before the other one wrote
    t.insert(runs(spark, [1]))
    with pytest.raises(RuntimeError, match="another merge"):
        late.insert(runs(spark, [2]))
    assert rows(t.read(), "run_id") == [(1,)]


def test_decisions_get_defaults(spark):
    good = ['{"frameId": 3, "tSec": 0.5, "selected": "primary", "risk": "LOW", "etaS": 7, "reason": "r", "trackIds": [4, "x", 2.5, null], "changed": true}', '{"frameId": 4.0, "tSec": "1", "selected": 5, "trackIds": "7", "changed": "true"}', '{"frameId": 1e3}']
    table = lambda recs, req=1: spark.createDataFrame([("r", "u", req, k) for k in recs], "run_id string, uid string, request int, record string")
    got = sorted(map(tuple, decision_rows(table(good)).collect()))
    assert got == [("r", "u", 3.0, 0.5, "primary", "LOW", 7.0, "r", [4.0, 2.5], True), ("r", "u", 4.0, 0.0, "", "", 0.0, "", [], False), ("r", "u", 1000.0, 0.0, "", "", 0.0, "", [], False)]
    for bad, why in (('{"frameId": "3"}', "must be a number"), ("[1]", "not an object"), ("{", "not an object"), (None, "not an object")):
        with pytest.raises(Exception, match=why):
            decision_rows(table([bad])).collect()
    with pytest.raises(Exception, match="more than 500"):
        decision_rows(table(['{"frameId": 1}'] * 501)).collect()
    assert decision_rows(table(['{"frameId": 1}'] * 500)).count() == 500
