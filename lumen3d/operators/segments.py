"""Statistics, votes and adjacency of labelled points (supervoxels and segments)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.functions.tables import numbered, ranked
from lumen3d.operators.grid import along_light, bounding_box
from lumen3d.operators.knn import k_nearest

MOMENTS = [("xx", "x", "x"), ("xy", "x", "y"), ("xz", "x", "z"), ("yy", "y", "y"), ("yz", "y", "z"), ("zz", "z", "z")]


def covariances() -> list:
    """Population covariances of x, y, z as aggregates c_xx .. c_zz."""
    return [F.covar_pop(a, b).alias(f"c_{n}") for n, a, b in MOMENTS]


def principal_normals(moments: DataFrame, upward: bool = True) -> DataFrame:
    """moments (c_xx .. c_zz and other columns) with nx, ny, nz, the direction of least variance, and curvature, its share of all.

    Matrices are solved in Arrow batches, all of a batch at once. With upward, nz is not negative. Points that
    coincide have no direction: their normal and curvature are null.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in moments.schema if not f.name.startswith('c_'))}, nx double, ny double, nz double, curvature double"

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            c = {n: frame[f"c_{n}"].to_numpy(np.float64) for n, *_ in MOMENTS}
            matrices = np.stack([np.stack([c["xx"], c["xy"], c["xz"]], -1), np.stack([c["xy"], c["yy"], c["yz"]], -1), np.stack([c["xz"], c["yz"], c["zz"]], -1)], 1) if len(frame) else np.zeros((0, 3, 3))
            values, vectors = np.linalg.eigh(np.nan_to_num(matrices))
            normal, total = vectors[:, :, 0], values.sum(axis=1)
            if upward:
                normal = normal * np.where(normal[:, 2] < 0, -1.0, 1.0)[:, None]
            some = total > 0
            out = frame[[n for n in frame.columns if not n.startswith("c_")]].copy()
            for i, n in enumerate(("nx", "ny", "nz")):
                out[n] = np.where(some, normal[:, i], np.nan)
            out["curvature"] = np.where(some, np.maximum(values[:, 0], 0) / np.where(some, total, 1), np.nan)
            yield out.astype(object).where(out.notna(), None)

    return moments.mapInPandas(solve, schema)


def point_normals(points: DataFrame, k: int = 30, upward: bool = True, neighbours: DataFrame | None = None) -> DataFrame:
    """(point_id, nx, ny, nz, curvature) from the k nearest points of each; neighbours may be given."""
    near = k_nearest(points, points, k) if neighbours is None else neighbours
    met = near.join(points.select(F.col("point_id").alias("nbr_id"), "x", "y", "z"), "nbr_id")
    return principal_normals(met.groupBy(F.col("query_id").alias("point_id")).agg(*covariances()), upward)


def moment_table(points: DataFrame, colours: tuple[str, ...] = ()) -> DataFrame:
    """One row per label: size, box, centroid, mean colours and covariances, from one aggregation."""
    sides = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return points.groupBy("label").agg(F.count("*").alias("size"), *sides, *[F.avg(c).alias(c) for c in "xyz"], *[F.avg(c).alias(c) for c in colours], *covariances())


def supervoxels(points: DataFrame, colours: tuple[str, ...] = ()) -> DataFrame:
    """moment_table() with normals and curvatures."""
    return principal_normals(moment_table(points, colours))


def voxel_boundaries(points: DataFrame, neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with a neighbour of another label, as (point_id), and the labels that meet, directed, as (label, nbr_label)."""
    labels = points.select("point_id", "label")
    met = neighbours.join(labels.withColumnRenamed("point_id", "query_id"), "query_id").join(labels.select(F.col("point_id").alias("nbr_id"), F.col("label").alias("nbr_label")), "nbr_id").where(F.col("label") != F.col("nbr_label"))
    return met.select(F.col("query_id").alias("point_id")).distinct(), met.select("label", "nbr_label").distinct()


def majority(points: DataFrame, by: str, vote: str) -> DataFrame:
    """(by, vote): the most frequent vote other than -1 of each group, the smallest of several; -1 where there is none."""
    counts = points.groupBy(by, vote).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.max(F.when(F.col(vote) != -1, F.struct(F.col("n"), (-F.col(vote)).alias("least")))).alias("best"))
    return best.select(by, F.coalesce(-F.col("best.least"), F.lit(-1)).cast("int").alias(vote))


def largest(points: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent label, the smallest of several, as one row (label, n)."""
    return points.where(F.col(label) != -1).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def dense_labels(values: DataFrame, column: str) -> DataFrame:
    """values with label: the rank, from 0, of each distinct value. Distinct values are numbered, not rows."""
    return values.join(numbered(values, column, "label"), column)


def sized_clusters(points: DataFrame, least: int, most: int) -> DataFrame:
    """points with labels of clusters of least to most points, numbered anew in order; -1 for all others."""
    sizes = points.where("label >= 0").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return points.join(numbered(sizes, "label", "_new"), "label", "left").withColumn("label", F.coalesce("_new", F.lit(-1))).drop("_new")


def multi_return_labels(points: DataFrame, ratio: float) -> DataFrame:
    """(label, share, is_building): segments in which the share of points with several returns is under ratio are buildings, others trees."""
    share = F.avg((F.col("num_returns") > 1).cast("int"))
    return points.groupBy("label").agg(F.count("*").alias("n"), share.alias("share")).withColumn("is_building", F.col("share") < ratio)


def split_by_returns(points: DataFrame, height: float) -> DataFrame:
    """points with class: tree for several returns, else ground up to height and other above."""
    return points.withColumn("class", F.when(F.col("num_returns") > 1, "tree").when(F.col("z") <= height, "ground").otherwise("other"))


def selected(points: DataFrame, indices: DataFrame, invert: bool = False) -> DataFrame:
    """Points whose point_id is listed, or is not; listed twice counts once."""
    return points.join(indices.select("point_id"), "point_id", "left_anti" if invert else "left_semi")


def gathered(points: DataFrame, indices: DataFrame) -> DataFrame:
    """Points in the order and as often as indices (ordinal, point_id) list them, with ordinal."""
    return indices.select("ordinal", "point_id").join(points, "point_id")


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """All points of both; columns that only one has are dropped."""
    both = [c for c in first.columns if c in second.columns]
    return first.select(*both).unionByName(second.select(*both))


def offset_labels(clouds: list[DataFrame]) -> DataFrame:
    """All labelled points; each cloud's labels follow after those of the ones before. Offsets are one number a cloud."""
    out, offsets = None, clouds[0].sparkSession.range(1).select(F.lit(0).alias("_o"))
    for cloud in clouds:
        moved = cloud.join(F.broadcast(offsets)).withColumn("label", (F.col("label") + F.col("_o")).cast("int"))
        out = moved.drop("_o") if out is None else out.unionByName(moved.drop("_o"))
        offsets = moved.agg(F.coalesce(F.max("label") + 1, F.max("_o"), F.lit(0)).alias("_o"))
    return out


def held_in_boxes(segments: DataFrame, boxes: DataFrame, margin: float = 0.5, cell: float | None = None) -> DataFrame:
    """Segments (label, box) whose centre in x and y lies inside a box (min_x .. max_y) grown by margin.

    Boxes are listed under the cells that they touch and centres under theirs, so that the range join is an
    equi-join; a cell is as wide as the widest box unless it is given.
    """
    if cell is None:
        cell = boxes.agg(F.max(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))).first()[0]
        cell = max((cell or 0.0) + 2 * margin, 1e-9)
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    tiles = boxes.select("min_x", "max_x", "min_y", "max_y", F.explode(F.sequence(at(F.col("min_x") - margin), at(F.col("max_x") + margin))).alias("cx"))
    tiles = tiles.withColumn("cy", F.explode(F.sequence(at(F.col("min_y") - margin), at(F.col("max_y") + margin))))
    centres = segments.select("label", ((F.col("min_x") + F.col("max_x")) * 0.5).alias("x"), ((F.col("min_y") + F.col("max_y")) * 0.5).alias("y")).withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
    inside = (F.col("x") > F.col("min_x") - margin) & (F.col("x") < F.col("max_x") + margin) & (F.col("y") > F.col("min_y") - margin) & (F.col("y") < F.col("max_y") + margin)
    return centres.join(tiles, ["cx", "cy"]).where(inside).select("label").distinct()


def occluded(points: DataFrame, light: tuple[float, float, float], margin: float, height: float, neighbours: int = 50) -> DataFrame:
    """(point_id) of supervoxels in shadow: projected along the light, their centroid lies in the grown box of one of their
    nearest supervoxels, and they reach no higher than its lowest way less height."""
    moved = along_light(points, light)
    boxes = bounding_box(moved, ["label"]).join(moved.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"]), "label")
    centroids = boxes.select(F.col("label").alias("point_id"), "x", "y", "z")
    near = k_nearest(centroids, centroids, neighbours)
    own = boxes.select(F.col("label").alias("query_id"), "x", "y", F.col("max_z").alias("own_z"))
    other = boxes.select(F.col("label").alias("nbr_id"), "min_x", "max_x", "min_y", "max_y", "min_z")
    dark = near.join(own, "query_id").join(other, "nbr_id").where(F.col("x").between(F.col("min_x") - margin, F.col("max_x") + margin) & F.col("y").between(F.col("min_y") - margin, F.col("max_y") + margin) & (F.col("own_z") <= F.col("min_z") - height))
    return points.join(dark.select(F.col("query_id").alias("label")).distinct(), "label", "left_semi").select("point_id")


def nearest_spread(neighbours: DataFrame, distance) -> DataFrame:
    """The upper median of each point's least distance to another one, as one row (spread); at least the machine epsilon.

    distance: a Column over neighbours.
    """
    least = neighbours.where("nbr_id <> query_id").groupBy("query_id").agg(F.min(distance).alias("d"))
    # of 2m values the m-th from above, of 2m + 1 the middle one: the discrete median from above
    upper = F.expr("percentile_disc(0.5) within group (order by d desc)")
    return least.agg(F.greatest(upper, F.lit(float(np.finfo(float).eps))).alias("spread"))
