"""The registry of scenes: scene tables as documents with ground truth and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Hazard tags with the name of their summary value and of their detail.
TAGS = (("pothole", "potholeDepth", "depthM"), ("clearance", "clearance", "clearanceM"), ("step", "curbHeight", "heightM"), ("track", "truckSpeed", "speedMps"))
SIZES = ("px", "py", "pz", "sx", "sy", "sz")


def read_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """The primitives of all ``*.csv`` scenes of a folder with name, number of frames and SHA-256 of their file."""
    text = F.col("content").cast("string")
    found = F.regexp_extract(text, r"(?m)^#\s*frames:\s*(\d+)", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(
        F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("name"), F.when(found != "", found.cast("int")).otherwise(1).alias("n_frames"), F.sha2("content", 256).alias("sha256"), F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    lines = files.where(~F.col("line").startswith("#") & (F.trim("line") != "") & ~F.lower("line").startswith("type,"))
    cut = F.split("line", ",", -1)
    text_at = lambda k: F.coalesce(F.trim(F.try_element_at(cut, F.lit(k + 1))), F.lit(""))
    num = lambda k: F.coalesce(text_at(k).try_cast("double"), F.lit(0.0))
    order = Window.partitionBy("name").orderBy("pos")
    return lines.select(
        "name", "n_frames", "sha256", (F.row_number().over(order) - 1).alias("prim"), text_at(0).alias("kind"), *[num(k + 1).alias(c) for k, c in enumerate(SIZES)],
        num(7).cast("int").alias("cls"), num(8).alias("vx"), num(9).alias("vy"), text_at(10).alias("hazard"), text_at(11).alias("note"))


def instance_ids(scene: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``instance``: 0 for planes, the others from 1 in the order of the table (a scene is a few dozen rows)."""
    order = Window.partitionBy(*by).orderBy("prim").rowsBetween(Window.unboundedPreceding, 0)
    return scene.withColumn("instance", F.when(F.col("kind") == "plane", 0).otherwise(F.sum((F.col("kind") != "plane").cast("int")).over(order)).cast("int"))


def hazard_value() -> Column:
    """The true value of a hazard's row: depth, clearance, height or speed."""
    h = F.col("hazard")
    return F.round(F.when(h == "pothole", F.col("sz")).when(h == "clearance", F.col("pz") - F.col("sz") / 2).when(h == "step", F.col("pz") + F.col("sz") / 2).when(h == "track", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))), 6)


def documents(scenes: DataFrame, dt: float = 0.1) -> DataFrame:
    """One JSON document for each scene (``name``, ``document``), the same bytes for the same scene.

    A document holds the primitives, the hazards with their positions in all frames, four summary values (null where the
    scene has no such hazard), and the file's digest. Two hazards of one kind, or an unknown kind, are an error.
    """
    s = instance_ids(scenes, ("name",)).withColumn("value", hazard_value())
    at = lambda c, v: F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1), lambda f: F.round(F.col(c) + F.col(v) * f * dt, 6))
    hazard = F.struct(F.col("instance").alias("instanceId"), F.col("hazard").alias("tag"), *[F.when(F.col("hazard") == tag, F.col("value")).alias(detail) for tag, _, detail in TAGS], F.round(F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")), 6).alias("rangeM"), at("px", "vx").alias("x"), at("py", "vy").alias("y"))
    primitive = F.struct("prim", F.col("kind").alias("type"), *[F.round(c, 6).alias(c) for c in SIZES], F.col("cls").alias("class"), "vx", "vy", "hazard", "note")
    wrong = F.count_if((F.col("hazard") != "") & ~F.col("hazard").isin(*[t for t, _, _ in TAGS]))

    def one(tag: str) -> Column:
        mine = F.col("hazard") == tag
        return F.when(F.count_if(mine) > 1, F.raise_error(F.concat(F.lit(f"two hazards of kind {tag} in scene "), F.col("name"))).cast("double")).otherwise(F.max(F.when(mine, F.col("value"))))

    g = s.groupBy("name", "n_frames", "sha256").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(primitive)).alias("primitives"), F.sort_array(F.collect_list(F.when(F.col("hazard") != "", hazard))).alias("hazards"),
        F.struct(*[one(tag).alias(key) for tag, key, _ in TAGS]).alias("truth"), F.when(wrong > 0, F.raise_error(F.concat(F.lit("unknown kind of hazard in scene "), F.col("name"))).cast("boolean")).otherwise(F.lit(True)).alias("valid"))
    doc = F.struct(F.col("name").alias("_id"), "name", F.lit(1).alias("schemaVersion"), F.col("n_frames").alias("nFrames"), F.lit(dt).alias("frameDtS"), (F.size("hazards") == 0).alias("expectNoHazards"), F.col("n").alias("nPrimitives"), "primitives", F.col("truth").alias("groundTruth"), "hazards", F.struct(F.concat("name", F.lit(".csv")).alias("csv"), "sha256").alias("source"))
    return g.where("valid").select("name", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def hazards_of(docs: DataFrame) -> DataFrame:
    """The ground truth back from the documents: a row for each hazard."""
    details = ", ".join(f"{d}: double" for _, _, d in TAGS)
    d = F.from_json("document", f"name string, nFrames int, hazards array<struct<instanceId: int, tag: string, {details}, rangeM: double, x: array<double>, y: array<double>>>")
    return docs.select(d.alias("d")).select("d.name", F.col("d.nFrames").alias("n_frames"), F.explode("d.hazards").alias("h")).select("name", "n_frames", F.col("h.instanceId").alias("instance"), F.col("h.tag").alias("tag"), F.coalesce(*[F.col(f"h.{d}") for _, _, d in TAGS]).alias("value"), F.col("h.rangeM").alias("range_m"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))
