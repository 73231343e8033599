"""Scalar and array maths as Column expressions; all stay inside generated code or array expressions of the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 3 x 3 Sobel kernels over 8, along columns and along rows, and each turned by 180 degrees.
SOBEL_X = ((1 / 8, 0.0, -1 / 8), (2 / 8, 0.0, -2 / 8), (1 / 8, 0.0, -1 / 8))
SOBEL_Y = ((1 / 8, 2 / 8, 1 / 8), (0.0, 0.0, 0.0), (-1 / 8, -2 / 8, -1 / 8))


def normal_filters() -> list[tuple[tuple[float, ...], ...]]:
    turned = lambda k: tuple(tuple(reversed(r)) for r in reversed(k))
    return [SOBEL_X, SOBEL_Y, turned(SOBEL_X), turned(SOBEL_Y)]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def unit(values: Column) -> Column:
    """The vector over its length; null entries for a vector of length 0."""
    length = F.sqrt(dot(values, values))
    return F.transform(values, lambda v: F.try_divide(v, length))


def spectral_angle(a: Column, b: Column) -> Column:
    """The angle of unit vectors; products that rounding takes past 1 count as 1."""
    return F.acos(F.greatest(F.least(dot(a, b), F.lit(1.0)), F.lit(-1.0)))


def scaled(values: Column, most: Column, offset: float) -> Column:
    return F.transform(values, lambda v: v / most + offset)


def squared_distance(a: Sequence[Column], b: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    total = F.lit(0.0)
    for x, y, w in zip(a, b, weights or [1.0] * len(a), strict=True):
        total = total + F.lit(w) * (x - y) * (x - y)
    return total


def yuv_to_rgb(y: Column, u: Column, v: Column) -> list[Column]:
    green = y - F.lit(0.25) * (u + v)
    return [(v + green).alias("r"), green.alias("g"), (u + green).alias("b")]


def upward(*normal: Column) -> list[Column]:
    """The normal turned so that its last part is positive; a level one is turned too."""
    sign = F.when(normal[-1] > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return [c * sign for c in normal]


def clipped(value: Column, most: float) -> Column:
    return F.least(value, F.lit(most))


def hsv_bytes(hue: Column, saturation: Column, value: Column) -> list[Column]:
    """b, g, r of a colour whose hue is 0..180 for the whole circle and whose other parts are bytes."""
    sixth = hue / 30.0
    sector = F.floor(sixth) % 6
    part, s, v = sixth - F.floor(sixth), saturation / 255.0, value / 255.0
    low, falling, rising = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    by_sector = {"b": (low, low, rising, v, v, falling), "g": (rising, v, v, falling, low, low), "r": (v, falling, low, low, rising, v)}
    return [F.rint(F.element_at(F.array(*of), (sector + 1).cast("int")) * 255).cast("int").alias(name) for name, of in by_sector.items()]


def normal_colours(nx: Column, ny: Column, nz: Column) -> list[Column]:
    """r, g, b of a normal: its parts (nz, nx, ny) as brightness and two differences, cut to 0..1, at the same hue and saturation but of brightness nz; 1 where there is no normal."""
    parts = [F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) for c in yuv_to_rgb(nz, nx, ny)]
    most = F.greatest(*parts)
    return [F.coalesce(F.when(most > 0, c * nz / most).otherwise(nz), F.lit(1.0)).alias(n) for c, n in zip(parts, "rgb", strict=True)]
