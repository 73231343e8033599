"""Classes of points from segments and supervoxels: ground, buildings, trees and cars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.functions.tables import numbered, shared_table
from lumen3d.operators.graph import component_ids
from lumen3d.operators.grid import bounding_box
from lumen3d.operators.knn import k_nearest
from lumen3d.operators.segmentation import scattered_clusters
from lumen3d.operators.segments import held_in_boxes, largest, majority

#: Classes, and the number of points beyond which scattered ones are a tree of their own.
GROUND, BUILDING, TREE, CAR, OTHER = 0, 1, 2, 3, -1
TREE_POINTS = 2000
#: The point that a scattered cluster starts from is counted two more times.
SEED_TWICE = 2


def merged_classes(points: DataFrame, distance: float = 2.0, neighbours: int = 60, margin: float = 0.5) -> DataFrame:
    """(point_id, label, class) of points (point_id, x, y, z, label of a segment or -1, voxel).

    The largest segment is the ground. Points take the most frequent label of their supervoxel. Segments whose centre
    lies in the grown box of a ground supervoxel are scattered points, as are those without a label. Chains of steps
    under distance cluster them, in the order of their first points: more than TREE_POINTS are a tree; of the smaller
    ones those that have a point of an earlier cluster among their neighbours belong to it, as a tree, and the others
    are cars.
    """
    ground = largest(points).first()
    ground = ground["label"] if ground else -1
    votes = majority(points, "voxel", "label").withColumnRenamed("label", "vote")
    voted = shared_table(points.join(votes, "voxel").drop("label").withColumnRenamed("vote", "label"), "merging-votes")
    boxes = bounding_box(voted.where(F.col("label") == ground), ["voxel"])
    segments = bounding_box(voted.where((F.col("label") != ground) & (F.col("label") >= 0)), ["label"])
    scattered = held_in_boxes(segments, boxes, margin)
    kept = voted.where("label >= 0").select("label").distinct().join(scattered, "label", "left_anti")
    numbers = numbered(kept, "label", "number")
    placed = shared_table(voted.join(numbers, "label", "left").select("point_id", "x", "y", "z", F.coalesce("number", F.lit(-1)).alias("number"), F.when(F.col("number").isNull(), OTHER).when(F.col("label") == ground, GROUND).otherwise(BUILDING).alias("class")), "merging-segments")
    loose = placed.where("number = -1")
    near = shared_table(k_nearest(loose, loose, neighbours), "merging-neighbours")
    clusters = shared_table(scattered_clusters(loose, near, distance), "merging-clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    # clusters take their turns in order: one that is small looks for neighbours in those before it, and goes by its last point with one
    before = clusters.select(F.col("point_id").alias("nbr_id"), F.col("cluster").alias("other"))
    met = near.join(clusters.withColumnRenamed("point_id", "query_id"), "query_id").join(before, "nbr_id").where("other < cluster")
    touching = met.groupBy("cluster").agg(F.max(F.struct(F.col("place"), (-F.col("rank")).alias("nearest"), F.col("other")))["other"].alias("beside"))
    sorts = shared_table(sizes.join(touching, "cluster", "left").withColumn("beside", F.when(F.col("n") + SEED_TWICE <= TREE_POINTS, F.col("beside"))), "merging-clusters")
    roots = component_ids(sorts.where("beside is not null").select(F.col("cluster").alias("a"), F.col("beside").alias("b"))).select(F.col("node").alias("cluster"), F.col("component").alias("root"))
    owned = shared_table(sorts.join(roots, "cluster", "left").select("cluster", F.coalesce("root", "cluster").alias("owner"), F.when((F.col("n") + SEED_TWICE > TREE_POINTS) | F.col("beside").isNotNull(), TREE).otherwise(CAR).alias("class")), "merging-owners")
    base = placed.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("base"))
    found = clusters.select("point_id", "cluster").join(owned, "cluster").join(numbered(owned, "owner", "i"), "owner").join(F.broadcast(base)).select("point_id", (F.col("base") + F.col("i")).cast("int").alias("label"), "class")
    return placed.where("number >= 0").select("point_id", F.col("number").alias("label"), "class").unionByName(found)
