"""URL filters: a sort-merge range join of page addresses with host and path rules (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, partitions, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every address by the longest rule that fits it.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains where the
    address's path starts with the rule's path; the rule with most characters in host and path together
    wins, then the one with the longer host; of equal rules the smallest verdict counts. Addresses without
    a fitting rule get a null rule and the ``default`` verdict.

    Method. The canonical key of a rule is its host with the labels reversed, ``/``, and its path; the keys
    that start with it form one interval of the sorted keys. An address gives one probe for every suffix of
    its host (no more labels than the deepest rule has), so a rule fits exactly if the probe lies in its
    interval. Rules and probes are sorted together by range partitions; each task sweeps its
    sorted rows once with the stack of rules whose intervals are open. The rules that are open where a
    partition begins are the prefixes of its first key; they are found by an equi-join of those prefixes, none longer than the longest rule.
    Memory is the depth of nesting; a host with any share of the rows is split by the sort.

    Returns the id, ``host``, ``path``, ``rule`` (host and path, else null) and ``verdict``. Null addresses
    and addresses without ``://`` have an empty host and path and no rule. Rows with a repeated or null id
    are judged one by one. An empty rule table leaves the default; an empty page table gives no rows.
    """
    spark = pages.sparkSession
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))

    rule_key = F.concat(reversed_host(F.col("host")), F.lit("/"), F.col("path"))
    rules = saved(rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.col("path"), F.col("verdict")).groupBy("host", "path").agg(F.min("verdict").alias("verdict")))
    starts = rules.select(rule_key.alias("key"), F.lit(-1).cast("long").alias("row"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("depth"), "verdict")
    deepest, longest = (x or 0 for x in rules.agg(F.max(F.size(F.split("host", r"\.", -1))), F.max(F.char_length(rule_key))).first())
    labels = F.reverse(F.split("host", r"\.", -1))
    probes = (
        rows.where("host <> ''")
        .select("row", "path", labels.alias("labels"))
        .select("row", "path", "labels", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, deepest))))).alias("n"))
        .select(F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), "."), F.lit("/"), F.col("path")).alias("key"), "row")
    )
    none = F.lit(None).cast("string")
    events = starts.unionByName(probes.select("key", "row", none.alias("rule"), F.lit(0).alias("depth"), none.alias("verdict")))
    order = [F.col("key"), F.col("row")]  # a rule, row -1, comes before the probes with its key
    swept = saved(events.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    # The open rules where each partition begins: the rules whose key is a prefix of its first key.
    first = swept.groupBy("part").agg(F.min(F.struct("key", "row")).alias("f")).select("part", "f.key")
    cuts = first.select("part", F.explode(F.sequence(F.lit(0), F.least(F.char_length("key"), F.lit(longest)))).alias("n"), "key").select("part", F.substring("key", F.lit(1), F.col("n")).alias("key"))
    open_at: dict[int, list] = {}
    for r in cuts.join(maybe_broadcast(starts), "key").select("part", "key", "rule", "depth", "verdict").collect():
        open_at.setdefault(r["part"], []).append((r["key"], r["rule"], r["depth"], r["verdict"]))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []
        begun = False
        for b in batches:
            out: list[tuple] = []
            part = b.column(5)
            for i, (key, row, rule, depth, verdict) in enumerate(zip(*[b.column(k).to_pylist() for k in range(5)], strict=True)):
                if not begun:
                    begun = True
                    stack = sorted(open_at.get(part[i].as_py(), []), key=lambda x: len(x[0]))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if row == -1:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, rule, depth, verdict))
                elif stack:
                    _, won, deep, says = max(stack, key=lambda x: (len(x[1]), x[2]))
                    out.append((row, len(won), deep, won, says))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["row", "len", "depth", "rule", "verdict"])

    hits = swept.mapInArrow(sweep, "row long, len int, depth int, rule string, verdict string")
    best = hits.groupBy("row").agg(F.max(F.struct("len", "depth", "rule", "verdict")).alias("best"))
    judged = rows.join(best, "row", "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


#: The rules of the query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return match_rules(pages, spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


OP7_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""
