"""Raster operators on pixels (row, col, value or bands): stencils, crops, stretches and superpixel adjacency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumen3d.functions.columns import SOBEL_X, SOBEL_Y, hsv_bytes, normal_filters, scaled, spectral_angle, unit


def shifted(values: Column, by: int, along: W) -> Column:
    """The value by places further along the window, the border's where the raster ends (for one place)."""
    if by == 0:
        return values
    return F.coalesce(F.lead(values).over(along) if by > 0 else F.lag(values).over(along), values)


def convolved(pixels: DataFrame, kernel: Sequence[Sequence[float]], value: str = "value", name: str = "out") -> DataFrame:
    """3 x 3 convolution of a dense raster with its border repeated: sums over (u, v) of kernel[u][v] * value[row + 1 - u, col + 1 - v].

    Two windows, along rows and then along columns, stand for the nine neighbours; pixels move twice, not ninefold.
    """
    across, down = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    parts = pixels.withColumns({f"_k{u}": sum((F.lit(float(kernel[u][v])) * shifted(F.col(value), 1 - v, across) for v in range(3)), F.lit(0.0)) for u in range(3)})
    total = sum((shifted(F.col(f"_k{u}"), 1 - u, down) for u in range(3)), F.lit(0.0))
    return parts.withColumn(name, total).drop("_k0", "_k1", "_k2")


def surface_normals(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Normals of a height raster and the partial derivatives of their parts by the slopes n1 and n2."""
    *_, turned_x, turned_y = normal_filters()
    sloped = convolved(convolved(pixels, turned_y, value, "n1"), turned_x, value, "n2")
    found = sloped.withColumn("n3", 1 / F.sqrt(F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2") + 1))
    a, b, c = F.col("n1") * F.col("n3"), F.col("n2") * F.col("n3"), F.col("n3")
    return found.select(
        "row", "col", "n1", "n2", b.alias("nx"), a.alias("ny"), c.alias("nz"), ((1 - a * a) * c).alias("f1_1"), (-(a * b * c)).alias("f1_2"), (-a * c * c).alias("f1_3"), (-(a * b * c)).alias("f2_1"), ((1 - b * b) * c).alias("f2_2"), (-b * c * c).alias("f2_3")
    )


def _between(value: Column, low: str, high: str) -> Column:
    """The value's share of the way from low to high; 0 where these are equal."""
    return F.coalesce(F.try_divide(value - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))


def hillshade(pixels: DataFrame, value: str = "value", valid_min: float = 0.0, contrast: float = 0.75) -> DataFrame:
    """(row, col, b, g, r), bytes: height as hue over three quarters of the circle's half, the normal's z as brightness.

    Pixels up to valid_min count as height 0 before any slope is taken; both stretches go over the whole raster.
    Bytes are rounded.
    """
    flat = pixels.select("row", "col", F.when(F.col(value) > valid_min, F.col(value)).otherwise(0.0).alias("_z"))
    shaded = _steepness(flat, "_z")
    ends = shaded.agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"), F.min("_z").alias("_c"), F.max("_z").alias("_d"))
    ranged = shaded.join(F.broadcast(ends))
    hue, bright = _between(F.col("_z"), "_c", "_d") * 0.75 * 180, (_between(F.col("_n"), "_a", "_b") * contrast + (1 - contrast)) * 255
    return ranged.select("row", "col", *hsv_bytes(F.rint(hue), F.lit(191.0), F.rint(bright)))


def masked_shade(pixels: DataFrame, mask: Column, value: str = "value", contrast: float = 0.75) -> DataFrame:
    """hillshade() with a mask: heights are stretched over the masked pixels, the others have hue 0; slopes and brightness are of all pixels as they are. Bytes are cut off."""
    shaded = _steepness(pixels.select("row", "col", F.col(value).alias("_z"), F.coalesce(mask, F.lit(False)).alias("_in")), "_z")
    inside = F.when(F.col("_in"), F.col("_z"))
    ends = shaded.agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"), F.min(inside).alias("_c"), F.max(inside).alias("_d"))
    ranged = shaded.join(F.broadcast(ends))
    hue = F.when(F.col("_in"), _between(F.col("_z"), "_c", "_d")).otherwise(0.0) * 0.75 * 180
    bright = (_between(F.col("_n"), "_a", "_b") * contrast + (1 - contrast)) * 255
    return ranged.select("row", "col", *hsv_bytes(F.floor(hue).cast("double"), F.lit(191.0), F.floor(bright).cast("double")))


def _steepness(pixels: DataFrame, value: str) -> DataFrame:
    """pixels with _n, the z of their unit normals."""
    sloped = convolved(convolved(pixels, SOBEL_Y, value, "_n1"), SOBEL_X, value, "_n2")
    return sloped.withColumn("_n", 1 / F.sqrt(F.col("_n1") * F.col("_n1") + F.col("_n2") * F.col("_n2") + 1))


def valid_in_window(pixels: DataFrame, valid: Column, reach: int = 2) -> DataFrame:
    """The number of valid pixels in each (2 reach + 1) square, the border repeated, as column n_valid."""
    across, down = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")

    def summed(frame: DataFrame, source: Column, along: W, place: str, out: str) -> DataFrame:
        every = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        inner = F.sum(source).over(along.rowsBetween(-reach, reach))
        before = F.greatest(F.lit(reach) - (F.col(place) - F.min(place).over(every)), F.lit(0)) * F.first(source).over(every)
        after = F.greatest(F.lit(reach) - (F.max(place).over(every) - F.col(place)), F.lit(0)) * F.last(source).over(every)
        return frame.withColumn(out, inner + before + after)

    rows = summed(pixels.withColumn("_v", F.coalesce(valid, F.lit(False)).cast("int")), F.col("_v"), across, "col", "_r")
    return summed(rows, F.col("_r"), down, "row", "n_valid").withColumn("n_valid", F.col("n_valid").cast("long")).drop("_v", "_r")


def cropped(pixels: DataFrame, transform: Sequence[float], rows: tuple[int, int], cols: tuple[int, int]) -> tuple[DataFrame, list[float]]:
    """Pixels of a half-open window, renumbered, and the window's geotransform."""
    inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    moved = list(transform)
    moved[0], moved[3] = transform[0] + cols[0] * transform[1], transform[3] + rows[0] * transform[5]
    return pixels.where(inside).withColumns({"row": F.col("row") - rows[0], "col": F.col("col") - cols[0]}), moved


def cropped_by_place(pixels: DataFrame, transform: Sequence[float], x: tuple[float, float], y: tuple[float, float]) -> tuple[DataFrame, list[float]]:
    """cropped() by places; starts before the raster count as its start. y runs from the top down."""
    col = [int((v - transform[0]) / transform[1]) for v in x]
    row = [int((v - transform[3]) / transform[5]) for v in y]
    return cropped(pixels, transform, (max(row[0], 0), row[1]), (max(col[0], 0), col[1]))


def scaled_cube(pixels: DataFrame, offset: float = 1e-10, keep_unit_max: bool = False) -> DataFrame:
    """bands over their greatest value of all pixels and bands, plus offset; with keep_unit_max, not divided where that is 1 already."""
    most = pixels.agg(F.max(F.array_max("bands")).alias("_most"))
    by = F.when(F.col("_most") == 1, F.lit(1.0)).otherwise(F.col("_most")) if keep_unit_max else F.col("_most")
    return pixels.join(F.broadcast(most)).withColumn("bands", scaled(F.col("bands"), by, offset)).drop("_most")


def stretched(values: DataFrame, low_share: float = 0.02, high_share: float = 0.02, by: str = "band", value: str = "value", quantised: bool = False) -> DataFrame:
    """Histogram stretch of each band: column stretched, 0 to 1.

    Bands are scaled to 0..255 and counted in 256 bins; the first bins whose cumulative shares are nearest to
    low_share and 1 - high_share become 0 and 1. With quantised, the bin itself is stretched.
    """
    ends = values.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n"))
    byte = F.coalesce(F.try_divide((F.col(value) - F.col("_low")) * 255, F.col("_high") - F.col("_low")), F.lit(0.0))
    ranged = values.join(F.broadcast(ends), by).withColumn("_byte", byte).withColumn("_bin", F.rint("_byte").cast("int"))
    bins = ranged.groupBy(by, "_bin").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    every = ends.select(by, "_n", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("_bin")).join(bins.select(by, "_bin", "_c"), [by, "_bin"], "left")
    share = F.sum(F.coalesce("_c", F.lit(0))).over(W.partitionBy(by).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)) / F.col("_n")
    nearest = lambda goal: F.min(F.struct(F.abs(F.col("_share") - goal), F.col("_bin")))["_bin"]
    cuts = every.withColumn("_share", share).groupBy(by).agg(nearest(F.lit(low_share)).alias("_from"), nearest(F.lit(1 - high_share)).alias("_to"))
    source = F.col("_bin").cast("double") if quantised else F.col("_byte")
    out = F.try_divide(source - F.col("_from"), F.col("_to") - F.col("_from"))
    return ranged.join(F.broadcast(cuts), by).withColumn("stretched", F.greatest(F.least(out, F.lit(1.0)), F.lit(0.0))).drop("_low", "_high", "_n", "_byte", "_bin", "_from", "_to")


def min_max_bytes(values: DataFrame, by: str = "band", value: str = "value") -> DataFrame:
    """Each band scaled to whole numbers 0..255, as column byte."""
    ends = values.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    byte = F.coalesce(F.try_divide((F.col(value) - F.col("_low")) * 255, F.col("_high") - F.col("_low")), F.lit(0.0))
    return values.join(F.broadcast(ends), by).withColumn("byte", F.rint(byte).cast("int")).drop("_low", "_high")


def bands_long(pixels: DataFrame, bands: Sequence[int] | None = None) -> DataFrame:
    """One row (pixel, row, col, band, value) for each band, or for each of the chosen ones."""
    if bands is None:
        return pixels.select("pixel", "row", "col", F.posexplode("bands").alias("band", "value"))
    chosen = F.array(*[F.struct(F.lit(b).alias("band"), F.element_at("bands", b + 1).alias("value")) for b in bands])
    return pixels.select("pixel", "row", "col", F.explode(chosen).alias("b")).select("pixel", "row", "col", "b.*")


def cube_faces(pixels: DataFrame) -> DataFrame:
    """(face, place, band, shown): the four sides of a cube of bands, scaled to 0..1, weighted by one and the logarithm of the band's number, over their greatest.

    Faces are first_row, last_row, first_col and last_col; place runs along them.
    """
    ends = pixels.agg(F.min(F.array_min("bands")).alias("_a"), F.max(F.array_max("bands")).alias("_b"), F.max("row").alias("_h"), F.max("col").alias("_w"))
    sides = {"first_row": ("col", F.col("row") == 0), "last_row": ("col", F.col("row") == F.col("_h")), "first_col": ("row", F.col("col") == 0), "last_col": ("row", F.col("col") == F.col("_w"))}
    on = F.array_compact(F.array(*[F.when(inside, F.struct(F.lit(face).alias("face"), F.col(along).alias("place"))) for face, (along, inside) in sides.items()]))
    edges = pixels.join(F.broadcast(ends)).withColumn("side", F.explode(on)).select("side.face", "side.place", "_a", "_b", F.posexplode("bands").alias("band", "v"))
    weighed = edges.select("face", "place", "band", ((F.log(F.col("band") + 1.0) + 1) * F.coalesce(F.try_divide(F.col("v") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))).alias("w"))
    most = weighed.agg(F.max("w").alias("_most"))
    return weighed.join(F.broadcast(most)).select("face", "place", "band", F.coalesce(F.try_divide("w", "_most"), F.lit(0.0)).alias("shown"))


def grid_links(pixels: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(a, b, a_column.., b_column..): each pair of 8-neighbours once, by its east, south, south-east and north-east neighbour."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (1, 1), (-1, 1))])
    left = pixels.select(F.col("pixel").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns], "row", "col", F.explode(steps).alias("s"))
    left = left.select("a", *[f"a_{c}" for c in columns], (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    right = pixels.select(F.col("pixel").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns], "row", "col")
    return left.join(right, ["row", "col"]).drop("row", "col")


def spectral_links(pixels: DataFrame) -> DataFrame:
    """(a, b, w): 8-neighbours and the angle of their spectra in single precision."""
    turned = pixels.select("pixel", "row", "col", unit(F.col("bands")).alias("u"))
    return grid_links(turned, ["u"]).select("a", "b", spectral_angle(F.col("a_u"), F.col("b_u")).cast("float").alias("w"))


def superpixel_borders(pixels: DataFrame, more_than: int = 1) -> DataFrame:
    """Pixels of which more than so many diagonal neighbours (the border repeated) have another label."""
    size = pixels.agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 1) for c in (-1, 1)])
    asked = pixels.join(F.broadcast(size)).select("pixel", "label", F.col("row").alias("r0"), F.col("col").alias("c0"), "_h", "_w", F.explode(steps).alias("s"))
    into = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.col(most))
    asked = asked.select("pixel", "label", into(F.col("r0") + F.col("s.r"), "_h").alias("row"), into(F.col("c0") + F.col("s.c"), "_w").alias("col"))
    met = asked.join(pixels.select("row", "col", F.col("label").alias("other")), ["row", "col"])
    return met.groupBy("pixel").agg(F.sum((F.col("label") != F.col("other")).cast("int")).alias("n")).where(F.col("n") > more_than).select("pixel", F.col("n").cast("long").alias("n"))


def filled_shadows(pixels: DataFrame, brightness: Column, dark: float) -> DataFrame:
    """Pixels darker than dark take the mean spectrum of their label's brighter ones; a label without these, or a pixel at dark, stays."""
    lit = pixels.where(brightness > dark).select("label", F.posexplode("bands").alias("band", "v")).groupBy("label", "band").agg(F.avg("v").alias("v"))
    means = lit.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias("_mean"))
    return pixels.join(means, "label", "left").withColumn("bands", F.when((brightness < dark) & F.col("_mean").isNotNull(), F.col("_mean")).otherwise(F.col("bands"))).drop("_mean")
