"""States and look-ups of point clouds, and octree leaves as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.operators.grid import bounding_box

#: Columns that make up an attribute.
ATTRIBUTES = {"points": ("x", "y", "z"), "normals": ("nx", "ny", "nz"), "colors": ("r", "g", "b"), "curvatures": ("curvature",)}


def has(cloud: DataFrame, attribute: str) -> bool:
    """Whether the cloud's schema holds an attribute; attributes are there for all points or for none."""
    return set(ATTRIBUTES[attribute]) <= set(cloud.columns)


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """(query_id, near): the neighbours of each point in order, as an array."""
    return neighbours.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "nbr_id"))), lambda s: s["nbr_id"]).alias("near"))


def members(points: DataFrame, label: str = "label") -> DataFrame:
    """(label, point_ids): the points of each label in order, as an array."""
    return points.groupBy(label).agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))


def label_centroids(points: DataFrame) -> DataFrame:
    """One point for each label: its mean place, normal and colour, of what there is."""
    parts = [c for names in ATTRIBUTES.values() for c in names if c in points.columns]
    return points.groupBy("label").agg(*[F.avg(c).alias(c) for c in parts])


def octree_cells(points: DataFrame, depth: int, margin: float = 0.01) -> DataFrame:
    """points with kx, ky, kz, the leaf of a cubic octree of a depth; the cube has the box's centre and longest side, grown by margin.

    Cell numbers stand for the path from the root; bounds are half-open, and points beyond them are dropped.
    """
    box = bounding_box(points)
    half = F.greatest(*[(F.col(f"max_{c}") - F.col(f"min_{c}")) / 2 for c in "xyz"])
    cube = box.select((half * 2 * (1 + margin)).alias("_size"), *[F.least(F.col(f"min_{c}"), (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 - half).alias(f"_o{c}") for c in "xyz"])
    cell = lambda c: F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"_o{c}"), F.col("_size") / (1 << depth)), F.lit(0.0))).cast("long")
    placed = points.join(F.broadcast(cube)).withColumns({f"k{c}": cell(c) for c in "xyz"})
    inside = [F.col(f"k{c}").between(0, (1 << depth) - 1) for c in "xyz"]
    return placed.where(inside[0] & inside[1] & inside[2]).drop("_size", "_ox", "_oy", "_oz")


def leaf_colours(points: DataFrame, depth: int) -> DataFrame:
    """(kx, ky, kz, n, r, g, b): occupied leaves with the colour of their last point."""
    last = F.max_by(F.struct("r", "g", "b"), "point_id")
    return octree_cells(points, depth).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), last.alias("c")).select("kx", "ky", "kz", "n", "c.*")
