"""Stored tables with a unique key: inserts, updates and upserts rewrite the buckets they touch, and readers see whole versions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import kept

#: Records of one request at most.
MOST_RECORDS = 500


@dataclass(frozen=True)
class Merged:
    """What a merge did: rows added, rows that it found, rows that it changed, buckets written anew."""

    inserted: int
    matched: int
    changed: int
    buckets: int


class KeyedTable:
    """A table below a folder of any store of the cluster, one row for each key.

    A row lies in the bucket that the hash of its whole key gives, sorted by ``order`` in it, so a look-up by key reads one
    bucket and a filter on the leading columns of ``order`` skips row groups; a value that a third of the rows share spreads over all buckets. A version is a small list of the folder of
    every bucket; a merge writes the buckets in which something changes and then the next list. A merge that dies leaves the last version, and one that changes nothing writes
    nothing, so it may run again. One writer at a time: the second one to end is an error where the store's rename does not replace.
    Choose ``buckets`` so that one fits a task (it is sorted there, and may spill).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, ddl: str, keys: list[str], order: list[str] | None = None, buckets: int = 64) -> KeyedTable:
        table = cls(spark, path)
        if table.version() >= 0:
            raise FileExistsError(f"{path} holds a table already")
        kinds = [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], ddl).schema]
        table._commit(0, {"columns": kinds, "keys": keys, "order": order or keys, "buckets": buckets, "folders": {}})
        return table

    def version(self) -> int:
        """The number of the last whole version; -1 where there is no table."""
        if not self.fs.exists(self._place("versions")):
            return -1
        names = [f.getPath().getName() for f in self.fs.listStatus(self._place("versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def _list(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if n < 0:
            raise FileNotFoundError(f"{self.path} holds no table")
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{n:09d}.json").collect()))

    def _commit(self, version: int, listed: dict) -> None:
        draft, final = self._place(f"drafts/{uuid.uuid4().hex}"), self._place(f"versions/{version:09d}.json")
        self.fs.mkdirs(self._place("versions"))
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another merge")

    def _read(self, listed: dict, buckets: list[int] | None = None) -> DataFrame:
        ddl = ", ".join(f"`{c}` {t}" for c, t in listed["columns"]) + ", at__ string, bucket__ int"
        paths = [f"{self.path}/data/at__={at}/bucket__={b}" for b, at in listed["folders"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the last version, or of an earlier one."""
        return self._read(self._list(version)).drop("at__", "bucket__")

    def _bucket(self, listed: dict) -> Column:
        return F.pmod(F.xxhash64(*listed["keys"]), F.lit(listed["buckets"])).cast("int")

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows with the given keys; only the buckets that these lie in are read."""
        listed = self._list()
        kinds = dict(listed["columns"])
        want = keys.select(*[F.col(k).cast(kinds[k]).alias(k) for k in listed["keys"]]).distinct()
        buckets = {r["b"] for r in want.select(self._bucket(listed).alias("b")).distinct().collect()}  # at most as many as there are buckets
        return self._read(listed, sorted(buckets)).join(want, listed["keys"], "left_semi").drop("at__", "bucket__")

    def check_unique(self, *columns: str) -> None:
        """An error that names a value that occurs twice (rows with a null in one of the columns do not count)."""
        twice = self.read().dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n__")).where("n__ > 1").drop("n__").first()
        if twice is not None:
            raise ValueError(f"{twice} occurs twice in {self.path}")

    def insert(self, rows: DataFrame) -> Merged:
        """Add rows; a key that is there with other values is an error, with the same values it is left as it is."""
        return self._merge(rows, "insert", [], [])

    def upsert(self, rows: DataFrame, on_insert: tuple[str, ...] = ()) -> Merged:
        """Add rows or set their columns; those of ``on_insert`` are set for new rows only."""
        return self._merge(rows, "upsert", [c for c in rows.columns if c not in on_insert], [])

    def update(self, rows: DataFrame, columns: list[str], scope: tuple[str, ...] = ()) -> Merged:
        """Set some columns of rows that are there; a row whose columns of ``scope`` differ (its owner, say) is not found."""
        return self._merge(rows, "update", columns, list(scope))

    def _merge(self, rows: DataFrame, kind: str, mutable: list[str], scope: list[str]) -> Merged:
        version = self.version()
        listed = self._list(version)
        keys, columns = listed["keys"], [c for c, _ in listed["columns"]]
        given = [c for c, _ in listed["columns"] if c in rows.columns]
        lost = [c for c in [*keys, *scope, *([] if kind != "update" else mutable)] if c not in given]
        if lost:
            raise ValueError(f"rows without {', '.join(lost)}")
        # Columns that the table does not have are left out; those that the rows lack are null in new rows.
        typed = rows.select(*[F.col(c).cast(t).alias(c) for c, t in listed["columns"] if c in given])
        new = kept(typed.withColumn("b__", self._bucket(listed)))
        wrong = new.groupBy("b__", *keys).agg(F.count(F.lit(1)).alias("n__")).where(" OR ".join(["n__ > 1", *[f"`{k}` IS NULL" for k in keys]])).select(*keys).first()
        if wrong is not None:
            raise ValueError(f"{wrong}: a key may not be null nor occur twice in one merge")
        touched = {r["b__"] for r in new.select("b__").distinct().collect()}  # at most as many as there are buckets
        old = self._read(listed, sorted(touched)).select("bucket__", F.struct(*columns).alias("o"))
        fresh = new.select("b__", F.struct(*given).alias("n"))
        same = [F.col("bucket__") == F.col("b__"), *[F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]]
        met = old.join(fresh, same, "full")
        there, came = F.col("o").isNotNull(), F.col("n").isNotNull()
        hit = there & came
        for c in scope:
            hit = hit & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        sets = [c for c in mutable if c in given and c not in keys]
        other = lambda cs: F.exists(F.array(F.lit(False), *[~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in cs]), lambda v: v)
        value = lambda c: F.when(hit, F.col(f"n.{c}")).when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in sets else F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in given else F.lit(None))
        add = ~there if kind != "update" else F.lit(False)
        done = kept(met.where(there | add).select(
            F.coalesce("bucket__", "b__").alias("bucket__"), *[value(c).cast(t).alias(c) for c, t in listed["columns"]],
            add.alias("add__"), hit.alias("hit__"), (add | (hit & other(sets))).alias("new__"), (F.lit(kind == "insert") & hit & other([c for c in given if c not in keys])).alias("clash__")))
        told = done.agg(F.count_if("add__").alias("added"), F.count_if("hit__").alias("hits"), F.count_if("new__").alias("changed"), F.collect_set(F.when(F.col("new__"), F.col("bucket__"))).alias("buckets"), F.max(F.when(F.col("clash__"), F.struct(*keys))).alias("clash")).first()
        if told["clash"] is not None:
            raise ValueError(f"{told['clash']} is there with other values")
        result = Merged(told["added"], told["hits"], told["changed"], len(told["buckets"]))
        if not told["changed"]:
            return result
        at = uuid.uuid4().hex
        out = done.where(F.col("bucket__").isin(told["buckets"])).select(*columns, "bucket__").repartition(len(told["buckets"]), "bucket__")
        out.sortWithinPartitions("bucket__", *listed["order"]).write.partitionBy("bucket__").parquet(f"{self.path}/data/at__={at}")
        self._commit(version + 1, {**listed, "folders": {**listed["folders"], **{str(b): at for b in told["buckets"]}}})
        return result


def decision_rows(records: DataFrame) -> DataFrame:
    """Typed decisions from requests: ``run_id``, ``uid``, ``request`` and ``record`` (a JSON object).

    A field of another type than its own gets its default: 0 for numbers, '' for texts, no tracks (entries that are no numbers are left
    out), changed only where it is ``true``. A record that is no object, one without a numeric ``frameId``, and a request of more than 500 records are errors.
    """
    v = F.try_parse_json("record")
    at = lambda name: F.try_variant_get("v__", f"$.{name}", "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    numeric = lambda x: kind(x).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    number = lambda name: F.when(numeric(at(name)), F.try_variant_get("v__", f"$.{name}", "double"))
    text = lambda name: F.coalesce(F.when(kind(at(name)) == "STRING", F.try_variant_get("v__", f"$.{name}", "string")), F.lit(""))
    bad = lambda why: F.raise_error(F.concat(F.lit("request "), F.col("request").cast("string"), F.lit(f": {why}"))).cast("double")
    sized = records.groupBy("request").agg(F.count(F.lit(1)).alias("size__")).where(F.col("size__") > MOST_RECORDS)
    rows = records.join(F.broadcast(sized), "request", "left") if sized.limit(1).count() else records.withColumn("size__", F.lit(None).cast("long"))
    tracks = F.filter(F.try_variant_get("v__", "$.trackIds", "array<variant>"), lambda e: numeric(e))
    return rows.withColumn("v__", v).select(
        "run_id", "uid", F.when(F.col("size__").isNotNull(), bad(f"more than {MOST_RECORDS} records")).when(~F.coalesce(kind(F.col("v__")).startswith("OBJECT"), F.lit(False)), bad("a record is not an object")).otherwise(F.coalesce(number("frameId"), bad("frameId must be a number"))).alias("frame_id"),
        F.coalesce(number("tSec"), F.lit(0.0)).alias("t_sec"), text("selected").alias("selected"), text("risk").alias("risk"), F.coalesce(number("etaS"), F.lit(0.0)).alias("eta_s"), text("reason").alias("reason"),
        F.coalesce(F.transform(tracks, lambda e: F.try_variant_get(e, "$", "double")), F.array().cast("array<double>")).alias("track_ids"), F.coalesce((kind(at("changed")) == "BOOLEAN") & F.try_variant_get("v__", "$.changed", "boolean"), F.lit(False)).alias("changed"))
