"""Gridding of points: geotransforms, pixels of points, surface models and per-pixel sums.

Points have point_id, x, y, z and other columns; a grid is a Grid, a few numbers that every task gets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumen3d.functions.tables import numbered

NO_DATA = -1000.0


@dataclass(frozen=True)
class Grid:
    """x0, dx, y0, dy of a geotransform without rotation, and the raster's size; dy is negative where rows run south."""

    x0: float
    dx: float
    y0: float
    dy: float
    height: int
    width: int

    @classmethod
    def of_transform(cls, gt: list[float], height: int, width: int) -> Grid:
        return cls(gt[0], gt[1], gt[3], gt[5], height, width)

    @property
    def transform(self) -> list[float]:
        return [self.x0, self.dx, 0.0, self.y0, 0.0, self.dy]


def bounding_box(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least and greatest x, y and z, of all points or by columns; null for no points."""
    sides = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return points.groupBy(*by).agg(*sides) if by else points.agg(*sides)


def weighted_centroid(points: DataFrame, weight: Column, by: list[str] | None = None) -> DataFrame:
    means = [F.try_divide(F.sum(weight * F.col(c)), F.sum(weight)).alias(c) for c in "xyz"]
    return points.groupBy(*by).agg(*means) if by else points.agg(*means)


def fitted_grid(points: DataFrame, cell: float) -> DataFrame:
    """The geotransform of square cells over the points' box, as one row: x0, dx, y0, dy, width, height (whole cells)."""
    whole = lambda c: ((F.max(c) - F.min(c)) / F.lit(cell)).cast("int")
    return points.agg(F.min("x").alias("x0"), F.lit(cell).alias("dx"), F.max("y").alias("y0"), F.lit(-cell).alias("dy"), whole("x").alias("width"), whole("y").alias("height"))


def grid_of(points: DataFrame, cell: float) -> Grid:
    """fitted_grid() on the driver; an extent of less than a cell has no grid."""
    row = fitted_grid(points, cell).first()
    if row["width"] is None or row["width"] < 1 or row["height"] < 1:
        raise ValueError("the points' extent is less than one cell")
    return Grid(row["x0"], row["dx"], row["y0"], row["dy"], row["height"], row["width"])


def _clamped(value: Column, size: Column | int) -> Column:
    return F.greatest(F.least(value.cast("int"), F.lit(size) - 1 if isinstance(size, int) else size - 1), F.lit(0))


def pixel_of(grid: Grid, x: str = "x", y: str = "y") -> Column:
    """Row-major pixel of a point; points beyond the raster belong to its border."""
    col = _clamped((F.col(x) - grid.x0) / grid.dx, grid.width)
    row = _clamped((F.col(y) - grid.y0) / grid.dy, grid.height)
    return (row.cast("long") * grid.width + col).alias("pixel")


def with_pixel(points: DataFrame, grid: Grid) -> DataFrame:
    return points.withColumn("pixel", pixel_of(grid))


def surface_model(points: DataFrame, grid: Grid, no_data: float | None = NO_DATA) -> DataFrame:
    """Each occupied pixel's greatest z, at least no_data, and its number of points; with no_data, every pixel of the raster."""
    cells = with_pixel(points, grid).groupBy("pixel").agg(F.max("z").alias("z"), F.count("*").alias("n"))
    if no_data is None:
        return cells
    raster = points.sparkSession.range(grid.height * grid.width).withColumnRenamed("id", "pixel")
    return raster.join(cells, "pixel", "left").select("pixel", F.greatest(F.coalesce("z", F.lit(no_data)), F.lit(no_data)).alias("z"), F.coalesce("n", F.lit(0)).alias("n"))


def points_in_grid(points: DataFrame, grid: Grid) -> DataFrame:
    """The points of each pixel in order: the interchange form; operators group by pixel instead."""
    return with_pixel(points, grid).groupBy("pixel").agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))


def mean_images(points: DataFrame, grid: Grid, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """The mean of each column in each pixel; fill where there are no points, or only occupied pixels for None."""
    cells = with_pixel(points, grid).groupBy("pixel").agg(*[F.avg(c).alias(c) for c in columns])
    if fill is None:
        return cells
    raster = points.sparkSession.range(grid.height * grid.width).withColumnRenamed("id", "pixel")
    return raster.join(cells, "pixel", "left").select("pixel", *[F.coalesce(c, F.lit(fill)).alias(c) for c in columns])


def unshadowed_pixels(points: DataFrame, shadow: DataFrame) -> DataFrame:
    """Distinct occupied pixels that are not in shadow (pixel)."""
    return points.select("pixel").distinct().join(shadow.select("pixel").distinct(), "pixel", "left_anti")


def incidence(points: DataFrame, shadow: DataFrame) -> DataFrame:
    """The 0/1 matrix of unshadowed pixels (rows, in ascending order) and points, as (row, col, v).

    Rows number the pixels.
    """
    rows = numbered(unshadowed_pixels(points, shadow), "pixel", "row")
    return points.join(rows, "pixel").select(F.col("row").cast("long").alias("row"), F.col("point_id").alias("col"), F.lit(1.0).alias("v"))


def lit_normals(points: DataFrame, shadow: DataFrame, light: tuple[float, float, float]) -> DataFrame:
    """The matrix of unshadowed pixels and labels: sums of (light . normal) * nz, as (pixel, label, v)."""
    shade = sum((F.lit(v) * F.col(c) for v, c in zip(light, ("nx", "ny", "nz"), strict=True)), F.lit(0.0)) * F.col("nz")
    return points.join(shadow.select("pixel").distinct(), "pixel", "left_anti").groupBy("pixel", "label").agg(F.sum(shade).alias("v"))


def normal_image(points: DataFrame, grid: Grid, fill: float = -1.0) -> DataFrame:
    """Each pixel's mean normal, weighted by nz; fill where there is none."""
    means = [F.try_divide(F.sum(F.col(c) * F.col("nz")), F.sum("nz")).alias(c) for c in ("nx", "ny", "nz")]
    cells = with_pixel(points, grid).groupBy("pixel").agg(*means)
    raster = points.sparkSession.range(grid.height * grid.width).withColumnRenamed("id", "pixel")
    return raster.join(cells, "pixel", "left").select("pixel", *[F.coalesce(c, F.lit(fill)).alias(c) for c in ("nx", "ny", "nz")])


def low_points_of_steep_cells(points: DataFrame, max_spread: float, above_floor: float) -> DataFrame:
    """In pixels whose z spreads over more than max_spread, the points less than above_floor above the lowest."""
    cell = W.partitionBy("pixel")
    marked = points.withColumns({"_low": F.min("z").over(cell), "_high": F.max("z").over(cell)})
    return marked.where((F.col("_high") - F.col("_low") > max_spread) & (F.col("z") - F.col("_low") < above_floor)).drop("_low", "_high")


def select_pixels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Points of the listed pixels, once for each time that a pixel is listed; pixels without points give nothing."""
    return pixels.select("pixel").join(points, "pixel")


def pixel_to_geo(frame: DataFrame, grid: Grid) -> DataFrame:
    return frame.withColumns({"geo_x": F.col("col") * grid.dx + grid.x0, "geo_y": F.lit(grid.y0) + F.col("row") * grid.dy})


def geo_to_pixel(frame: DataFrame, grid: Grid, corrected: bool = False) -> DataFrame:
    """Truncated columns and rows of geo_x, geo_y. The plain form divides y0 - y by dy, which is negative south of
    y0; corrected divides y - y0."""
    down = F.col("geo_y") - grid.y0 if corrected else F.lit(grid.y0) - F.col("geo_y")
    return frame.withColumns({"col": ((F.col("geo_x") - grid.x0) / grid.dx).cast("int"), "row": (down / grid.dy).cast("int")})


def along_light(points: DataFrame, light: tuple[float, float, float]) -> DataFrame:
    """Points moved down the light to z = 0, with the length of the way as z; null where the light is level."""
    way = F.try_divide(F.col("z"), F.lit(light[2]))
    return points.withColumn("_way", way).withColumns({"x": F.col("x") - F.col("_way") * light[0], "y": F.col("y") - F.col("_way") * light[1], "z": F.col("_way")}).drop("_way")


def shadow_cells(points: DataFrame, light: tuple[float, float, float], cell: float, raster: Grid, max_spread: float, above_floor: float) -> DataFrame:
    """Pixels of raster that hold shadowed points: points that share a cell of the light's projection with much longer ways."""
    moved = along_light(points, light)
    low = low_points_of_steep_cells(with_pixel(moved, grid_of(moved, cell)), max_spread, above_floor)
    return points.join(low.select("point_id"), "point_id", "left_semi").select(pixel_of(raster)).distinct()


def octree_leaves(points: DataFrame, resolution: float) -> DataFrame:
    """The number of occupied leaves of a cubic octree whose leaves are at most four thirds of resolution wide, as one row (depth, leaves).

    The cube is centred on the box, 1.01 times its longest side. Three cell numbers per point stand for the tree.
    """
    box = bounding_box(points).first()
    if box["min_x"] is None:
        return points.sparkSession.createDataFrame([(0, 0)], "depth int, leaves long")
    extent = max(box[f"max_{c}"] - box[f"min_{c}"] for c in "xyz") * 1.01
    depth, size = 0, extent
    while size > resolution * 4 / 3:
        size, depth = size / 2, depth + 1
    half = extent / 1.01 / 2
    cells = points.select(*[F.floor((F.col(c) - min(box[f"min_{c}"], (box[f"min_{c}"] + box[f"max_{c}"]) / 2 - half)) / F.lit(size or 1.0)).alias(c) for c in "xyz"])
    return cells.agg(F.lit(depth).alias("depth"), F.countDistinct("x", "y", "z").alias("leaves"))
