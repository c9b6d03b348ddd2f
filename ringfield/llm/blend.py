"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, ranked, saved

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources: a share of all sizes by weight, none above ``most`` times its own size.

    ``sizes`` has ``source`` and ``source_size``. Sources are ordered by code point, null last, and take the
    weights of ``cycle`` in turn. What a capped source cannot take is shared anew among the others by weight
    until none is above its cap. Every round is one small aggregation over the table of sources, so the
    number of sources is not limited by the driver.
    """
    order, _, _ = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    table = saved(order.select("source", "source_size", weight.alias("weight")))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level, capped = 0.0, -1
    while True:
        over = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        n, taken, left = table.agg(
            F.coalesce(F.sum(over.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or left == 0:
            break
        capped, level = n, (total - most * taken) / left
    target = F.when(over, F.lit(most) * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def plan_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """Every document with its size, its source's size and target, and the number of copies that the mix takes.

    The repetition rate of a source is its target over its size (0 for an empty source). A document is
    taken floor(rate) times, and once more with probability equal to the fraction: the first 52 bits of the
    MD5 of seed and id are its draw, so reruns and any partitioning agree. Adds ``size``, ``source_size``,
    ``target`` and ``copies`` (columns of these names in the input are replaced).

    Null texts have size 0, null sources are a source of their own, null ids share one draw. Repeated rows
    count as often as they occur and draw alike. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    own, key = fresh(docs, "own__"), fresh(docs, "key__")
    sized = docs.select(*keep, word_count(F.col(text_col)).alias(own))
    sizes = saved(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(own).alias("source_size")))
    table = maybe_broadcast(source_targets(sizes, **targets).withColumnRenamed("source", key))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    joined = sized.join(table, sized[source_col].eqNullSafe(table[key]), "left")
    return joined.select(*[sized[c] for c in keep], F.col(own).alias("size"), "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, copy_col: str = "copy", **how) -> DataFrame:
    """The mix itself: each document once for each of its copies, numbered from 0 in ``copy_col``."""
    keep = [c for c in docs.columns if c != copy_col]
    return plan_copies(docs, **how).where("copies > 0").select(*keep, F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias(copy_col))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The source table by closed form: with sources sorted by cap over weight, the first k are capped where
#: the level that the others would get is at most the next ratio.
OP2_TEMPLATE = """
WITH sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM src),
r AS (SELECT *, 2 * source_size / weight AS ratio, sum(2 * source_size) OVER o - 2 * source_size AS capped, sum(weight) OVER (ORDER BY 2 * source_size / weight DESC, source DESC NULLS FIRST) AS left_weight,
        (SELECT sum(source_size) FROM src) * 1.5::DOUBLE AS total
      FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
l AS (SELECT arg_min((total - capped) / left_weight, ratio) FILTER ((total - capped) / left_weight <= ratio) AS lev FROM r),
t AS (SELECT source, source_size, CASE WHEN 2 * source_size <= lev * weight THEN 2.0::DOUBLE * source_size ELSE lev * weight END AS target FROM r, l),
d AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
"""
OP2_SQL = (OP2_TEMPLATE + "SELECT doc_id, size, source_size, target, size * (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS taken FROM d").replace("{docs}", "documents")
