"""Deterministic point clouds over the relational test tables, for queries whose results SQL can check.

Both views give (frame_id, x, y, z, raw, pred_raw, instance, intensity) and the keys of the rows they come from. The
SQL text is one that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import ring_table
from ..functions.labels import with_class


def _raw(key: str) -> str:
    return f"CASE WHEN ({key}) % 10 < 6 THEN 40 WHEN ({key}) % 10 = 6 THEN 72 WHEN ({key}) % 10 = 7 THEN 50 WHEN ({key}) % 10 = 8 THEN (CASE WHEN l_orderkey % 2 = 0 THEN 18 ELSE 258 END) ELSE 0 END"


KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
COMMON = f"""{_raw('l_partkey + l_suppkey')} AS raw, {_raw('l_orderkey + l_partkey * 3')} AS pred_raw,
  CASE WHEN (l_partkey + l_suppkey) % 10 IN (7, 8) THEN 1 + l_suppkey % 40 ELSE 0 END AS instance, l_discount * 10 AS intensity"""
WIDE = f"""SELECT CAST(floor(l_orderkey / 2e4) * 7 + l_linenumber - 1 AS INT) AS frame_id, {KEYS},
  ((l_partkey * 7919 + l_linenumber * 104729 + l_orderkey * 31) % 16001 - 8000) / 1e2 AS x,
  ((l_suppkey * 6971 + l_orderkey * 15485863 + l_linenumber * 13) % 16001 - 8000) / 1e2 AS y,
  (l_quantity - 25e0) / 1e1 AS z, {COMMON} FROM lineitem"""
DENSE_BASE = f"""SELECT CAST(floor(l_orderkey / 2e4) * 7 + l_linenumber - 1 AS INT) AS frame_id, {KEYS}, CAST(200 + l_partkey % 24 AS INT) AS k0, CAST((l_suppkey * 13 + l_orderkey) % 50 AS INT) AS j0,
  l_tax, l_discount, {COMMON} FROM lineitem"""
DENSE_POLAR = """SELECT b.*, d.r_in + d.s * (2e-1 + 1e-1 * (l_orderkey % 7)) AS rr, (j0 + 2e-1 + 1e-1 * (l_partkey % 7)) / d.n_bins * 2e0 * pi() AS tt
  FROM base b JOIN dim_ring d ON d.ring = b.k0"""
DENSE = f"""SELECT frame_id, {KEYS}, rr * cos(tt) AS x, rr * sin(tt) AS y,
  CASE WHEN raw IN (40, 72) THEN -17e-1 + l_tax * 25e-2 + (CASE WHEN j0 BETWEEN 30 AND 34 THEN 15e-2 ELSE 0e0 END) - (CASE WHEN k0 BETWEEN 208 AND 210 AND j0 BETWEEN 10 AND 13 THEN 22e-2 ELSE 0e0 END)
       ELSE -12e-1 + l_discount * 4e1 END AS z, raw, pred_raw, instance, intensity FROM polar"""


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out by order where the table has fewer files than shuffles have partitions.

    A file with one row group is read by one task, however large. Large tables have files enough and are not shuffled. The map's sums do not depend on
    the order of the rows, so its results stay the same.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "l_orderkey") if len(rows.inputFiles()) < spread else rows


def pts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over 160 m x 160 m, a part of them beyond the envelope. Every 20,000 orders give seven frames, one for each number of a line: frames grow in number, not in size."""
    return with_class(spark.sql(WIDE.replace("FROM lineitem", "FROM {t}"), t=dealt(lineitem(spark, sf_dir))))


def pts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in 1,200 cells of the rings 200 to 223, with steps, pits and overhangs."""
    base = spark.sql(DENSE_BASE.replace("FROM lineitem", "FROM {t}"), t=dealt(lineitem(spark, sf_dir)))
    polar = spark.sql(DENSE_POLAR.replace("FROM base b JOIN dim_ring", "FROM {b} b JOIN {d}"), b=base, d=F.broadcast(ring_table(spark)))
    return with_class(spark.sql(DENSE.replace("FROM polar", "FROM {p}"), p=polar))
