"""Synthetic scans: rays against the primitives of a scene."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS, HEIGHT, R_MAX = 1e-6, 1.70, 100.0
SCENE_DDL = "prim int, kind string, px double, py double, pz double, sx double, sy double, sz double, cls int, vx double, vy double, hazard string"


def rays(spark: SparkSession, beams: int = 64, azimuths: int = 1800, up: float = 3.0, down: float = -25.0) -> DataFrame:
    """Unit directions of all beams at all azimuths."""
    el = F.radians(up + (down - up) * F.col("beam") / (beams - 1))
    az = 2 * math.pi * F.col("azimuth") / azimuths
    base = spark.range(beams * azimuths).select((F.col("id") / azimuths).cast("int").alias("beam"), (F.col("id") % azimuths).cast("int").alias("azimuth"))
    return base.select("beam", "azimuth", (F.cos(el) * F.cos(az)).alias("dx"), (F.cos(el) * F.sin(az)).alias("dy"), F.sin(el).alias("dz"))


def at_frame(scene: DataFrame, n_frames: int, dt: float = 0.1) -> DataFrame:
    """The scene in every frame: positions move with their velocity."""
    f = scene.withColumn("frame_id", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    return f.withColumns({"px": F.col("px") + F.col("vx") * F.col("frame_id") * dt, "py": F.col("py") + F.col("vy") * F.col("frame_id") * dt})


def _safe(d: Column) -> Column:
    return F.when(F.abs(d) < 1e-12, F.lit(1e-12)).otherwise(d)


def _slab(lo: list[Column], hi: list[Column]) -> tuple[Column, Column]:
    """Entry and exit of a ray through an axis-parallel box."""
    o, d = (F.lit(0.0), F.lit(0.0), F.lit(HEIGHT)), [_safe(F.col(c)) for c in ("dx", "dy", "dz")]
    a = [(lo[k] - o[k]) / d[k] for k in range(3)]
    b = [(hi[k] - o[k]) / d[k] for k in range(3)]
    return F.greatest(*[F.least(x, y) for x, y in zip(a, b, strict=True)]), F.least(*[F.greatest(x, y) for x, y in zip(a, b, strict=True)])


def hit_distance() -> Column:
    """Distance along the ray (dx, dy, dz) from the sensor to the primitive of the row; null without a hit."""
    half = [F.col(c) / 2 for c in ("sx", "sy", "sz")]
    centre = [F.col(c) for c in ("px", "py", "pz")]
    near, far = _slab([c - h for c, h in zip(centre, half, strict=True)], [c + h for c, h in zip(centre, half, strict=True)])
    through = (near <= far) & (far > EPS)
    dz = _safe(F.col("dz"))
    tp = (F.col("pz") - HEIGHT) / dz
    plane = F.when((tp > EPS) & (F.abs(tp * F.col("dx") - F.col("px")) <= half[0]) & (F.abs(tp * F.col("dy") - F.col("py")) <= half[1]), tp)
    box = F.when(through & (near > EPS), near).when(through, far)
    pit = F.when(through, far)
    # Cylinder: side within the height, else the caps.
    r = F.col("sx") / 2
    a = F.greatest(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(1e-12))
    b = -(F.col("dx") * F.col("px") + F.col("dy") * F.col("py"))
    q = b * b - a * (F.col("px") * F.col("px") + F.col("py") * F.col("py") - r * r)
    ts = (-b - F.sqrt(q)) / a
    side = F.when((q >= 0) & (ts > EPS) & (F.abs(HEIGHT + ts * F.col("dz") - F.col("pz")) <= half[2]), ts)
    cap = lambda z: F.when(((z - HEIGHT) / dz > EPS) & (F.pow((z - HEIGHT) / dz * F.col("dx") - F.col("px"), F.lit(2.0)) + F.pow((z - HEIGHT) / dz * F.col("dy") - F.col("py"), F.lit(2.0)) <= r * r), (z - HEIGHT) / dz)
    cylinder = F.least(side, cap(F.col("pz") + half[2]), cap(F.col("pz") - half[2]))
    return F.when(F.col("kind") == "plane", plane).when(F.col("kind") == "box", box).when(F.col("kind") == "pit", pit).when(F.col("kind") == "cyl", cylinder)


def cast(ray_table: DataFrame, scene: DataFrame) -> DataFrame:
    """The nearest hit of every ray: rays x primitives with the scene broadcast (a scene is a few dozen rows, which is checked).

    Hits of other primitives inside a pit's box are carved away. The first primitive wins ties.
    """
    if scene.count() > 10_000:
        raise ValueError("a scene has at most 10,000 primitives")
    t = ray_table.crossJoin(F.broadcast(scene)).withColumn("t", hit_distance()).where(F.col("t").isNotNull())
    pits = F.broadcast(scene.where("kind = 'pit'").select(F.col("prim").alias("pit"), *[F.col(c).alias(f"q{c}") for c in ("px", "py", "pz", "sx", "sy", "sz")]))
    point = (F.col("t") * F.col("dx"), F.col("t") * F.col("dy"), HEIGHT + F.col("t") * F.col("dz"))
    inside = F.lit(True)
    for v, c, s in zip(point, ("qpx", "qpy", "qpz"), ("qsx", "qsy", "qsz"), strict=True):
        inside = inside & (F.abs(v - F.col(c)) <= F.col(s) / 2 + EPS)
    carved = t.join(pits, (F.col("prim") != F.col("pit")) & inside, "left_anti")
    best = carved.groupBy("beam", "azimuth").agg(F.min(F.struct(F.round("t", 9).alias("t"), F.col("prim"), F.col("cls"))).alias("m"), F.first("dx").alias("dx"), F.first("dy").alias("dy"), F.first("dz").alias("dz"))
    return best.select("beam", "azimuth", "m.t", "m.prim", "m.cls", (F.col("m.t") * F.col("dx")).alias("x"), (F.col("m.t") * F.col("dy")).alias("y"), (HEIGHT + F.col("m.t") * F.col("dz")).alias("z")).where((F.col("t") > 0) & (F.col("t") <= R_MAX))


# Raw id and reflectance by class; the raw id of a moving object.
RAW_OF_CLASS, RAW_MOVING = (0, 40, 72, 50, 18), 258
REFLECTANCE = (0.10, 0.18, 0.30, 0.45, 0.55)


def gaussian(seed: int, what: str, *key: str) -> Column:
    """A standard normal number that depends on the row's key alone, so a task that runs again gives the same one."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.lit(k), *key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def measured(hits: DataFrame, scene: DataFrame, seed: int = 0, sigma: float = 0.0, dropout: float = 0.0, intensity_sigma: float = 0.0) -> DataFrame:
    """Hits as a sensor reports them: range noise, dropout, intensity and the packed label word (instance and raw id).

    ``scene`` has ``instance`` (see sources.registry); it is joined by primitive, a few dozen rows.
    """
    key = ("beam", "azimuth")
    about = F.broadcast(scene.select("prim", "instance", ((F.col("vx") != 0) | (F.col("vy") != 0)).alias("moving")))
    by_class = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cls") + 1)
    t = hits.withColumn("t", F.col("t") + sigma * gaussian(seed, "range", *key)) if sigma else hits
    t = t.where((F.col("t") > 0) & (F.col("t") <= R_MAX))
    if dropout:
        t = t.where(F.pmod(F.xxhash64(F.lit(seed), F.lit("drop"), *key), F.lit(1 << 30)) >= int(dropout * (1 << 30)))
    if sigma:
        scale = F.col("t") / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + (F.col("z") - HEIGHT) * (F.col("z") - HEIGHT))
        t = t.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale, "z": HEIGHT + (F.col("z") - HEIGHT) * scale})
    raw = F.when(F.col("moving") & (F.col("cls") == 4), RAW_MOVING).otherwise(by_class(RAW_OF_CLASS))
    light = by_class(REFLECTANCE) / (1 + F.pow(F.col("t") / 40.0, F.lit(2.0)))
    if intensity_sigma:
        light = light + intensity_sigma * gaussian(seed, "light", *key)
    word = F.col("instance").cast("long") * 65536 + raw
    return t.join(about, "prim").withColumns({"word": word, "intensity": F.greatest(F.lit(0.0), F.least(light, F.lit(1.0)))}).drop("moving")
