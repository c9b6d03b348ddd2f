"""The class taxonomy: packed label words, raw and learning ids, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw ids by class, the moving ids, raw id to learning id, class of each learning id.
DRIVABLE_RAW = (40, 44, 60)
TERRAIN_RAW = (48, 49, 70, 72)
STATIC_RAW = (50, 51, 52, 71, 80, 81, 99)
DYNAMIC_RAW = (10, 11, 13, 15, 16, 18, 20, 30, 31, 32, 252, 253, 254, 255, 256, 257, 258, 259)
MOVING_RAW = (252, 253, 254, 255, 256, 257, 258, 259)
LEARNING_OF_RAW = {10: 1, 252: 1, 11: 2, 15: 3, 18: 4, 258: 4, 13: 5, 16: 5, 20: 5, 256: 5, 257: 5, 259: 5, 30: 6, 254: 6, 31: 7, 253: 7, 32: 8, 255: 8, 40: 9, 60: 9, 44: 10, 48: 11, 49: 12, 50: 13, 51: 14, 70: 15, 71: 16, 72: 17, 80: 18, 81: 19}
CLASS_OF_LEARNING = (0, 4, 4, 4, 4, 4, 4, 4, 4, 1, 1, 2, 2, 3, 3, 2, 3, 2, 3, 3)
CLASS_NAMES = ("VOID", "DRIVABLE", "NON_DRIVABLE_TERRAIN", "STATIC_OBSTACLE", "DYNAMIC_OBJECT")
RAW_IDS = 260


def class_of(raw: int) -> int:
    return 1 if raw in DRIVABLE_RAW else 2 if raw in TERRAIN_RAW else 3 if raw in STATIC_RAW else 4 if raw in DYNAMIC_RAW else 0


def label_table(spark: SparkSession) -> DataFrame:
    """All 260 raw ids with class, moving flag and learning id."""
    rows = [(k, class_of(k), k in MOVING_RAW, LEARNING_OF_RAW.get(k, 0)) for k in range(RAW_IDS)]
    return spark.createDataFrame(rows, "raw_id int, cls int, moving boolean, learning_id int").coalesce(1)


def learning_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASS_OF_LEARNING)), "learning_id int, cls int").coalesce(1)


def with_class(points: DataFrame, raw: str = "raw", cls: str = "cls", moving: str | None = "moving") -> DataFrame:
    """Add the class of a raw id; an id outside 0..259 is an error, an unknown one inside is VOID."""
    dim = F.broadcast(label_table(points.sparkSession).select(F.col("raw_id").alias("__raw"), F.col("cls").alias("__cls"), F.col("moving").alias("__moving")))
    bad = F.raise_error(F.concat(F.lit("raw label out of range: "), F.col(raw).cast("string"))).cast("int")
    checked = points.withColumn("__key", F.when(F.col(raw).between(0, RAW_IDS - 1), F.col(raw).cast("int")).when(F.col(raw).isNull(), F.lit(0)).otherwise(bad))
    out = checked.join(dim, F.col("__key") == F.col("__raw"), "left").withColumn(cls, F.coalesce("__cls", F.lit(0)))
    if moving:
        out = out.withColumn(moving, F.coalesce("__moving", F.lit(False)))
    return out.drop("__key", "__raw", "__cls", "__moving")


def semantic(word: Column) -> Column:
    """The low 16 bits of a packed label word (held as a long: Spark has no unsigned integers)."""
    return word.bitwiseAND(F.lit(0xFFFF)).cast("int")


def instance(word: Column) -> Column:
    return F.shiftrightunsigned(word, 16).bitwiseAND(F.lit(0xFFFF)).cast("int")


def packed(raw: Column, inst: Column) -> Column:
    return F.shiftleft(inst.cast("long"), 16).bitwiseOR(raw.cast("long"))
