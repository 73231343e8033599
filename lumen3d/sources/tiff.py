"""GeoTIFF rasters: uncompressed or deflated strips, one sample type, any number of bands."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GEO_TEXT = 33550, 33922, 34735, 34737
#: The kind of an image, and the kind and photometric value of a transparency mask.
SUBFILE, OF_MASK, MASK = 254, 4, 4
#: Types of tag values: struct letter and size.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8)}
#: Sample kinds: unsigned, signed, floating.
KINDS = {1: "u", 2: "i", 3: "f"}
#: Types that are written as they are; all others become float32.
WRITTEN = ("uint8", "uint16", "float32", "float64")


def tags_of(content: bytes) -> tuple[str, dict]:
    """The byte order and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    return order, _directory(content, order, struct.unpack(order + "I", content[4:8])[0])[0]


def _directory(content: bytes, order: str, at: int) -> tuple[dict, int]:
    """The tags of the image at a place, and the place of the next one or 0."""
    tags, n = {}, struct.unpack_from(order + "H", content, at)[0]
    for k in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHI4s", content, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        letter, size = TYPES[kind]
        place = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * k)[0]
        tags[tag] = content[place : place + count].rstrip(b"\0").decode("utf-8", "replace") if letter == "s" else list(struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", content, place))
    return tags, struct.unpack_from(order + "I", content, at + 2 + 12 * n)[0]


def held_of(content: bytes) -> np.ndarray | None:
    """(height, width) whether a pixel is there, by the first image's mask; None if the file has none."""
    order, _ = tags_of(content)
    at, seen = struct.unpack(order + "I", content[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(content, order, at)
        if tags.get(SUBFILE) == [OF_MASK] and tags.get(PHOTOMETRIC) == [MASK] and tags.get(BITS, [1]) == [1]:
            return np.unpackbits(_strips(content, tags, np.dtype("u1")).reshape(tags[HEIGHT][0], -1), axis=1)[:, : tags[WIDTH][0]] > 0
    return None


def _strips(content: bytes, tags: dict, kind: np.dtype) -> np.ndarray:
    packed = tags.get(COMPRESSION, [1])[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"compression {packed} is not supported")
    strips = [content[o : o + n] for o, n in zip(tags[OFFSETS], tags[COUNTS], strict=True)]
    return np.frombuffer(b"".join(zlib.decompress(s) if packed != 1 else s for s in strips), kind)


def head_of(tags: dict) -> tuple[list[float], str, int, int, int]:
    """The geotransform, the projection's text, height, width and bands; no sample is decoded."""
    scale, tie = tags.get(PIXEL_SCALE, [1.0, -1.0, 0.0]), tags.get(TIE_POINT, [0.0] * 6)
    return [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]], tags.get(GEO_TEXT, ""), tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, [1])[0]


def decode(content: bytes) -> tuple[np.ndarray, list[float], str]:
    """(height, width, bands) samples, the geotransform and the projection's text."""
    order, tags = tags_of(content)
    transform, projection, height, width, bands = head_of(tags)
    kind = np.dtype(f"{order}{KINDS[tags.get(SAMPLE_FORMAT, [1])[0]]}{tags.get(BITS, [8])[0] // 8}")
    data = _strips(content, tags, kind)
    apart = tags.get(PLANAR, [1])[0] == 2
    samples = data.reshape(bands, height, width).transpose(1, 2, 0) if apart else data.reshape(height, width, bands)
    return samples, transform, projection


def encode(samples: np.ndarray, transform: list[float], projection: str = "", held: np.ndarray | None = None) -> bytes:
    """A little-endian file of uncompressed strips of one row each, with a mask if some pixels are not held."""
    samples = samples[:, :, None] if samples.ndim == 2 else samples
    samples = np.ascontiguousarray(samples.astype(samples.dtype if samples.dtype.name in WRITTEN else "float32").astype(samples.dtype.newbyteorder("<") if samples.dtype.name in WRITTEN else "<f4"))
    height, width, bands = samples.shape
    size, row = samples.dtype.itemsize, samples.strides[0]
    text = projection.encode() + b"\0"
    values = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * size] * bands), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0] * height), (SAMPLES, 3, [bands]), (ROWS_PER_STRIP, 4, [1]),
        (COUNTS, 4, [row] * height), (PLANAR, 3, [1]), (SAMPLE_FORMAT, 3, [3 if samples.dtype.kind == "f" else 1] * bands), (PIXEL_SCALE, 12, [transform[1], -transform[5], 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, transform[0], transform[3], 0.0]), (GEO_TEXT, 2, [text]),
    ]
    at, extra, entries = 8 + 2 + 12 * len(values) + 4, b"", []
    sizes = [len(text) if k == 2 else len(v) * TYPES[k][1] for _, k, v in values]
    first = at + sum(s + s % 2 for s in sizes if s > 4)
    for (tag, kind, v), n in zip(values, sizes, strict=True):
        if tag == OFFSETS:
            v = [first + row * i for i in range(height)]
        data = text if kind == 2 else struct.pack(f"<{len(v)}{TYPES[kind][0]}", *v)
        count = n if kind == 2 else len(v)
        if n > 4:
            entries.append(struct.pack("<HHII", tag, kind, count, at + len(extra)))
            extra += data + b"\0" * (n % 2)
        else:
            entries.append(struct.pack("<HHI4s", tag, kind, count, data.ljust(4, b"\0")))
    body, mask, after = samples.tobytes(), b"", 0
    if held is not None and not held.all():
        body += b"\0" * (len(body) % 2)
        after, bits = first + len(body), np.packbits(held, axis=1).tobytes()
        own = [(SUBFILE, 4, OF_MASK), (WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 1), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, MASK), (OFFSETS, 4, after + 2 + 12 * 10 + 4), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, height), (COUNTS, 4, len(bits))]
        mask = struct.pack("<H", len(own)) + b"".join(struct.pack("<HHII", tag, kind, 1, v) for tag, kind, v in own) + b"\0" * 4 + bits
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", after) + extra + body + mask


def read_rasters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pixels (path, pixel, row, col, bands), without those that a file's mask leaves out, and one row for each file (path, gt, prj, height, width, n_bands)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                samples, _, _ = decode(bytes(content))
                height, width, bands = samples.shape
                held = held_of(bytes(content))
                for row in range(height):
                    cols = np.arange(width, dtype=np.int32) if held is None else np.flatnonzero(held[row]).astype(np.int32)
                    yield pd.DataFrame({"path": name, "pixel": row * width + cols.astype(np.int64), "row": np.int32(row), "col": cols, "bands": list(samples[row, cols].astype(np.float64))})

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(name, *head_of(tags_of(bytes(content))[1]))], columns=["path", "gt", "prj", "height", "width", "n_bands"])

    return files.mapInPandas(pixels, "path string, pixel long, row int, col int, bands array<double>"), files.mapInPandas(heads, "path string, gt array<double>, prj string, height int, width int, n_bands int")


def write_raster(pixels: DataFrame, path: str, transform: list[float], projection: str = "", dtype: str = "float64") -> None:
    """One file of a raster (row, col, bands), assembled on the driver: its size is that of the one image, not of a corpus. A mask leaves out places without a row."""
    frame = pixels.select("row", "col", "bands").toPandas()
    samples = np.zeros((int(frame["row"].max()) + 1, int(frame["col"].max()) + 1, len(frame["bands"].iloc[0])), dtype)
    samples[frame["row"], frame["col"]] = np.stack([np.asarray(b) for b in frame["bands"]])
    held = np.zeros(samples.shape[:2], bool)
    held[frame["row"], frame["col"]] = True
    write_bytes(pixels.sparkSession, path, encode(samples, transform, projection, held))


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Content as a file of whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def column_major(values: DataFrame, height: int, width: int) -> DataFrame:
    """(row, col, band, value) of a flat buffer (i, value) that runs down columns, then across, then through bands."""
    return values.select((F.col("i") % height).cast("int").alias("row"), (F.floor(F.col("i") / height) % width).cast("int").alias("col"), F.floor(F.col("i") / (height * width)).cast("int").alias("band"), "value")
