"""LAS point clouds, uncompressed, point formats 0 to 3 and 6 to 8."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen3d.functions.tables import shared_table
from lumen3d.sources.tiff import write_bytes

SCHEMA = "path string, point_id long, x double, y double, z double, intensity double, classification int, num_returns int, gps_time double"
#: Where classification and time lie in a point record, for the old and the new formats; None without a time.
OLD_TIME = {0: None, 1: 20, 2: None, 3: 20}
POINTS_AT_ONCE = 100_000


def decode(content: bytes) -> Iterator[pd.DataFrame]:
    """Points in double precision, POINTS_AT_ONCE at a time."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = content[25]
    start, _, form, size = struct.unpack_from("<IIBH", content, 96)
    form &= 0x3F
    n = struct.unpack_from("<Q", content, 247)[0] if minor >= 4 and len(content) >= 255 and struct.unpack_from("<I", content, 107)[0] == 0 else struct.unpack_from("<I", content, 107)[0]
    scale, offset = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    if form not in (*OLD_TIME, 6, 7, 8):
        raise ValueError(f"point format {form} is not supported")
    for first in range(0, n, POINTS_AT_ONCE):
        count = min(POINTS_AT_ONCE, n - first)
        raw = np.frombuffer(content, np.uint8, count * size, start + first * size).reshape(count, size)
        field = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]
        new = form >= 6
        time_at = 22 if new else OLD_TIME[form]
        yield pd.DataFrame({
            "point_id": np.arange(first, first + count),
            **{c: field(4 * i, "<i4") * scale[i] + offset[i] for i, c in enumerate("xyz")},
            "intensity": field(12, "<u2").astype(float),
            "classification": (raw[:, 16] if new else raw[:, 15] & 31).astype(np.int32),
            "num_returns": (raw[:, 14] >> 4 if new else (raw[:, 14] >> 3) & 7).astype(np.int32),
            "gps_time": field(time_at, "<f8") if time_at is not None else np.zeros(count),
        })


def encode(points: pd.DataFrame, scale: float = 0.001, low: list[float] | None = None) -> bytes:
    """A version 1.2 file of point format 1; its offsets are the least coordinates, or low."""
    n = len(points)
    least = [float(points[c].min()) if n else 0.0 for c in "xyz"]
    low = least if low is None else low
    high = [float(points[c].max()) if n else 0.0 for c in "xyz"]
    record = np.zeros(n, np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("gps_time", "<f8")]))
    for i, c in enumerate("xyz"):
        record[c] = np.rint((points[c].to_numpy() - low[i]) / scale)
    record["intensity"], record["classification"] = points["intensity"], points["classification"]
    record["returns"], record["gps_time"] = (points["num_returns"].to_numpy().astype(np.uint8) & 7) << 3, points["gps_time"]
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HIIBHI5I", head, 94, 227, 227, 0, 1, record.itemsize, n, n, 0, 0, 0, 0)
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *low)
    struct.pack_into("<6d", head, 179, *[v for pair in zip(high, least, strict=True) for v in pair])
    return bytes(head) + record.tobytes()


def write_points(points: DataFrame, path: str, scale: float = 0.001, at_once: int = POINTS_AT_ONCE) -> None:
    """Points (x, y, z, intensity, classification, num_returns, gps_time) as files of at most so many points in a folder, all with the offsets of the whole cloud.

    Executors encode the files; they pass the driver, which writes them to the store of the path, a partition of about one file at a time.
    """
    spark = points.sparkSession
    low = [float(v) if v is not None else 0.0 for v in points.agg(*[F.min(F.nanvl(c, F.lit(None).cast("double"))) for c in "xyz"]).first()]

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            while len(frame):
                held.append(frame.iloc[: at_once - n])
                frame, n = frame.iloc[at_once - n :], n + len(held[-1])
                if n == at_once:
                    yield pd.DataFrame({"content": [encode(pd.concat(held), scale, low)]})
                    held, n = [], 0
        if held:
            yield pd.DataFrame({"content": [encode(pd.concat(held), scale, low)]})

    encoded = shared_table(points.select(*"xyz", "intensity", "classification", "num_returns", "gps_time").mapInPandas(files, "content binary"), "las-files")
    n = -1
    for n, row in enumerate(encoded.repartition(max(1, encoded.count())).toLocalIterator()):
        write_bytes(spark, f"{path}/{n:06}.las", bytes(row["content"]))
    if n < 0:
        none = pd.DataFrame({c: np.zeros(0) for c in (*"xyz", "intensity", "classification", "num_returns", "gps_time")})
        write_bytes(spark, f"{path}/000000.las", encode(none, scale, low))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of all files of the path; point_id counts within a file. A file is one task's to read, so tile large surveys."""

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for part in decode(bytes(content)):
                    yield part.assign(path=name)[[c.split()[0] for c in SCHEMA.split(", ")]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(points, SCHEMA)


def point_columns(points: DataFrame) -> DataFrame:
    """The matrix form: x, y, z, intensity, class, returns and time."""
    return points.select("x", "y", "z", "intensity", "classification", "num_returns", "gps_time")


def cube_cloud(spark: SparkSession, size: int, length: tuple[float, float, float] = (1.0, 1.0, 1.0), offset: tuple[float, float, float] = (0.0, 0.0, 0.0), seed: int = 0) -> DataFrame:
    """size points on each face of a box, by digits of the MD5 digest of their number, in a colour for each face."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:{i}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    face, axis = (F.floor(F.col("id") / size)).cast("int"), (F.floor(F.col("id") / size) % 3).cast("int")
    side = F.floor(face / 3).cast("double")
    place = [F.when(axis == i, side).otherwise(part(i)) * length[i] + offset[i] for i in range(3)]
    colours = [F.when(axis == i, 1.0).otherwise(F.when(face >= 3, 0.5).otherwise(0.0)) for i in range(3)]
    return spark.range(6 * size).select(F.col("id").alias("point_id"), *[p.alias(c) for p, c in zip(place, "xyz", strict=True)], *[k.alias(c) for k, c in zip(colours, "rgb", strict=True)])
