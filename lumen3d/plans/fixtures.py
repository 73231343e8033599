"""Point clouds and rasters derived from the test tables, and the same relations as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen3d.operators.grid import Grid

#: The raster over the event points: 25 x 30 cells of 2 x 2.
TRANSFORM = [0.0, 2.0, 0.0, 60.0, 0.0, -2.0]
GRID = Grid.of_transform(TRANSFORM, height=30, width=25)
LIGHT = (0.3, 0.2, math.sqrt(1 - 0.13))
HSI_WIDTH = 25


def bulk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points without identifiers."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), (F.col("l_discount").cast("double") * 100).alias("z"), F.col("l_linenumber").cast("int").alias("num_returns"), F.col("l_tax").cast("double").alias("intensity"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: point_id, x, y, z, intensity, num_returns, label, seg (with gaps), r, g, b and an upward unit normal."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    y = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / 4.32e10
    z = F.get_json_object("props", "$.k").cast("double") / 10
    base = t.select(F.col("event_id").cast("long").alias("point_id"), (F.col("value") / 10).alias("x"), y.alias("y"), z.alias("z"), F.col("value").alias("intensity"), (1 + F.col("user_id") % 3).cast("int").alias("num_returns"), (F.col("user_id") % 10).cast("int").alias("label"), F.when(F.col("user_id") % 7 == 0, -1).otherwise(F.col("user_id") % 5).cast("int").alias("seg"))
    length = F.sqrt(F.lit(1.0) + F.pow((F.col("point_id") % 7) / 10.0, F.lit(2.0)) + F.pow((F.col("point_id") % 11) / 10.0, F.lit(2.0)))
    return base.withColumns({"nx": (F.col("point_id") % 7) / 10.0 / length, "ny": (F.col("point_id") % 11) / 10.0 / length, "nz": 1.0 / length, "r": F.col("intensity") / 500, "g": F.col("z") / 10, "b": (F.col("point_id") % 17) / 16.0})


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a raster of 64 bands: pixel, row, col, bands, label."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").cast("long").alias("pixel"), F.floor(F.col("vec_id") / HSI_WIDTH).cast("int").alias("row"), (F.col("vec_id") % HSI_WIDTH).cast("int").alias("col"), F.transform("embedding", lambda v: (v.cast("double") + 1) / 2).alias("bands"), F.col("label").cast("int").alias("label"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface model of the event points as a raster: row, col, value, with holes of -1000, and a label."""
    from lumen3d.operators.grid import surface_model

    cells = surface_model(event_points(spark, sf_dir), GRID)
    return cells.select(F.floor(F.col("pixel") / GRID.width).cast("int").alias("row"), (F.col("pixel") % GRID.width).cast("int").alias("col"), F.col("z").alias("value"), F.lit(0).alias("label"))


BULK_SQL = "li AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y, CAST(l_discount AS DOUBLE) * 100 AS z, CAST(l_linenumber AS INTEGER) AS num_returns, CAST(l_tax AS DOUBLE) AS intensity FROM lineitem)"
EVENTS_SQL = """ev0 AS (SELECT event_id AS point_id, value / 10 AS x, epoch(ts - TIMESTAMP '2024-01-01') / 43200.0 AS y,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS z, value AS intensity, CAST(1 + user_id % 3 AS INTEGER) AS num_returns,
  CAST(user_id % 10 AS INTEGER) AS label, CAST(CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id % 5 END AS INTEGER) AS seg,
  sqrt(1.0 + pow((event_id % 7) / 10.0, 2.0) + pow((event_id % 11) / 10.0, 2.0)) AS ln FROM events),
ev AS (SELECT *, (point_id % 7) / 10.0 / ln AS nx, (point_id % 11) / 10.0 / ln AS ny, 1.0 / ln AS nz, intensity / 500 AS r, z / 10 AS g, (point_id % 17) / 16.0 AS b FROM ev0)"""
SPECTRA_SQL = f"hsi AS (SELECT CAST(vec_id AS BIGINT) AS pixel, CAST(vec_id // {HSI_WIDTH} AS INTEGER) AS row, CAST(vec_id % {HSI_WIDTH} AS INTEGER) AS col, [(CAST(v AS DOUBLE) + 1) / 2 FOR v IN embedding] AS bands, CAST(label AS INTEGER) AS label FROM embeddings)"
_column = f"greatest(least(CAST(trunc((x - {TRANSFORM[0]}) / {TRANSFORM[1]}) AS INTEGER), {GRID.width - 1}), 0)"
_row = f"greatest(least(CAST(trunc((y - {TRANSFORM[3]}) / ({TRANSFORM[5]})) AS INTEGER), {GRID.height - 1}), 0)"
PIXEL_SQL = f"CAST({_row} * {GRID.width} + {_column} AS BIGINT)"
#: Event points with their pixel.
PLACED_SQL = f"{EVENTS_SQL}, pt AS (SELECT *, {PIXEL_SQL} AS pixel FROM ev)"
RASTER_SQL = f"px AS (SELECT CAST(range AS BIGINT) AS pixel FROM range({GRID.height * GRID.width}))"
#: The surface model as a raster.
HEIGHTS_SQL = f"{PLACED_SQL}, {RASTER_SQL}, hz AS (SELECT CAST(px.pixel // {GRID.width} AS INTEGER) AS row, CAST(px.pixel % {GRID.width} AS INTEGER) AS col, greatest(coalesce(max(z), -1000.0), -1000.0) AS value FROM px LEFT JOIN pt USING (pixel) GROUP BY px.pixel)"
