"""Files: binary scans and labels, scene tables, wire frames."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN_DDL = "sequence string, frame_id int, point_idx int, x float, y float, z float, intensity float"
LABEL_DDL = "sequence string, frame_id int, point_idx int, word long"
CELL_FIELDS = (("cell_id", "u4"), ("z_ground", "f4"), ("z_obstacle", "f4"), ("z_min", "f4"), ("roughness", "f4"), ("slope", "f4"), ("class_id", "u1"), ("confidence", "u1"), ("flags", "u1"))


def _records(spark: SparkSession, root: str, kind: str, suffix: str, ddl: str, width: int) -> DataFrame:
    """Rows of all ``root/<sequence>/<kind>/NNNNNN.<suffix>`` files, by Spark's binary reader (any store Spark reads)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"[0-9][0-9][0-9][0-9][0-9][0-9].{suffix}").load(f"{root}/*/{kind}")
    name = F.regexp_extract("path", rf"([^/]+)/{kind}/(\d{{6}})\.{suffix}$", 1)
    frame = F.regexp_extract("path", rf"([^/]+)/{kind}/(\d{{6}})\.{suffix}$", 2).cast("int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seq, fid, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if len(raw) % width:
                    raise ValueError(f"{seq}/{fid:06d}.{suffix}: {len(raw)} bytes are no whole number of records of {width}")
                n = len(raw) // width
                head = [pa.array([seq] * n, pa.string()), pa.array(np.full(n, fid, np.int32)), pa.array(np.arange(n, dtype=np.int32))]
                if width == 16:
                    v = np.frombuffer(raw, "<f4").reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array(v[:, k]) for k in range(4)]], ["sequence", "frame_id", "point_idx", "x", "y", "z", "intensity"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, pa.array(np.frombuffer(raw, "<u4").astype(np.int64))], ["sequence", "frame_id", "point_idx", "word"])

    return files.select(name.alias("sequence"), frame.alias("frame_id"), "content").mapInArrow(read, ddl)


def read_scans(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root, "velodyne", "bin", SCAN_DDL, 16)


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root, "labels", "label", LABEL_DDL, 4)


def pack_scans(points: DataFrame) -> DataFrame:
    """One row for each frame with the bytes of its scan file, points in order: the binary sink's payload.

    A frame's points meet in one task; a frame is one sensor revolution.
    """
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_idx")
        return pd.DataFrame([{"sequence": g["sequence"].iloc[0], "frame_id": g["frame_id"].iloc[0], "content": g[["x", "y", "z", "intensity"]].to_numpy("<f4").tobytes()}])

    return points.select("sequence", "frame_id", "point_idx", "x", "y", "z", "intensity").groupBy("sequence", "frame_id").applyInPandas(run, "sequence string, frame_id int, content binary")


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Primitives and number of frames of a scene table: ``#`` comments, a ``# frames: N`` line, blank trailing columns."""
    text = spark.read.text(path)
    frames = text.select(F.regexp_extract("value", r"^#\s*frames:\s*(\d+)", 1).alias("n")).where("n <> ''").agg(F.max(F.col("n").cast("int"))).first()[0] or 1
    rows = text.where(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.lower("value").startswith("type,")).withColumn("k", F.monotonically_increasing_id())
    cut = F.split("value", ",", -1)
    num = lambda k: F.coalesce(F.try_element_at(cut, F.lit(k + 1)).try_cast("double"), F.lit(0.0))
    names = ("px", "py", "pz", "sx", "sy", "sz")
    return rows.select("k", F.trim(cut[0]).alias("kind"), *[num(i + 1).alias(n) for i, n in enumerate(names)], num(7).cast("int").alias("cls"), num(8).alias("vx"), num(9).alias("vy"), F.coalesce(F.trim(F.try_element_at(cut, F.lit(11))), F.lit("")).alias("hazard")), frames


def encode_frame(header: dict, cells: dict[str, np.ndarray]) -> bytes:
    """A wire frame: u32 length of the JSON header, the header, then the arrays of the cells."""
    raw = json.dumps({**header, "n_cells": len(cells["cell_id"])}, sort_keys=True).encode()
    out = io.BytesIO()
    out.write(struct.pack("<I", len(raw)) + raw)
    for name, kind in CELL_FIELDS:
        out.write(np.asarray(cells[name]).astype("<" + kind).tobytes())
    return out.getvalue()


def decode_frame(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    if len(data) < 4 or len(data) < 4 + struct.unpack_from("<I", data)[0]:
        raise ValueError("truncated frame header")
    size = struct.unpack_from("<I", data)[0]
    header, at, cells = json.loads(data[4 : 4 + size]), 4 + size, {}
    for name, kind in CELL_FIELDS:
        end = at + header["n_cells"] * np.dtype(kind).itemsize
        if end > len(data):
            raise ValueError(f"truncated array {name}")
        cells[name], at = np.frombuffer(data[at:end], "<" + kind), end
    return header, cells


def wire_frames(cells: DataFrame) -> DataFrame:
    """One binary wire frame for each frame of the analysed map (null heights become NaN)."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cell_id")
        return pd.DataFrame([{"frame_id": int(g["frame_id"].iloc[0]), "message": encode_frame({"frame_id": int(g["frame_id"].iloc[0])}, {n: g[n].to_numpy() for n, _ in CELL_FIELDS})}])

    return cells.select("frame_id", *[n for n, _ in CELL_FIELDS]).groupBy("frame_id").applyInPandas(run, "frame_id int, message binary")
