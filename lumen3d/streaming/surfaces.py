"""Surface models that grow with a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumen3d.operators.grid import Grid, surface_model, with_pixel


def running_surface(points: DataFrame, grid: Grid) -> DataFrame:
    """(pixel, z, n) so far; state is one row for each occupied pixel, which the raster bounds. For update or complete mode."""
    return surface_model(points, grid, no_data=None)


def windowed_surface(points: DataFrame, grid: Grid, time: str, every: str, late: str) -> DataFrame:
    """(start, pixel, z, n) for windows of time; a window is given once, when no point of it may come any more."""
    placed = with_pixel(points, grid).withWatermark(time, late)
    return placed.groupBy(F.window(time, every), "pixel").agg(F.max("z").alias("z"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "pixel", "z", "n")


def write_surface(surface: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's state as a table of its own number, so that a repeated batch replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return surface.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
