"""Registered queries cover all rows of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen3d.operators import grid, knn, merging, segmentation, segments
from lumen3d.plans import pipelines, registry
from lumen3d.plans.fixtures import GRID, event_points
from lumen3d.plans.registry import QUERIES


def test_fusion_takes_the_whole_cloud(spark, sf_dir):
    got = QUERIES["g6_fusion_supervoxels"](spark, sf_dir).toPandas()
    assert sorted(got["point_id"]) == sorted(r[0] for r in event_points(spark, sf_dir).select("point_id").collect())


def test_order_takes_the_whole_cloud_without_a_global_window(spark, sf_dir):
    got = QUERIES["o1_sorted"](spark, sf_dir)
    points = event_points(spark, sf_dir).select("y", "x", "point_id").collect()
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(r[2], i) for i, r in enumerate(sorted(points))]
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in x]
    assert windows and all("_part" in x for x in windows)


def test_boxes_and_unions_take_whole_clouds(spark, sf_dir):
    points = event_points(spark, sf_dir)
    boxes = points.where("num_returns = 1").groupBy("label").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()
    cells = grid.with_pixel(points, GRID).groupBy("pixel").agg((F.min("x") + F.max("x")) / 2, (F.min("y") + F.max("y")) / 2).collect()
    held = {p for p, x, y in cells if any(b[1] - 0.5 < x < b[2] + 0.5 and b[3] - 0.5 < y < b[4] + 0.5 for b in boxes)}
    assert {r["label"] for r in QUERIES["j12_held_in_boxes"](spark, sf_dir).collect()} == held
    assert QUERIES["u1_united"](spark, sf_dir).count() == 2 * points.count()


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, count", [("g12_occluded", 50), ("f8_inliers_50", 50), ("c5_graph_supervoxels", 50), ("c6_buildings_and_trees", 50), ("c12_reflectance", 50), ("g11_merged_classes", 60)])
def test_neighbour_counts_are_those_of_the_reference(spark, sf_dir, monkeypatch, name, count):
    def asked(*given, k=None, **_):
        raise Asked(k or given[2])

    for module in (knn, merging, segments):
        for f in ("k_nearest", "search"):
            if hasattr(module, f):
                monkeypatch.setattr(module, f, asked)
    with pytest.raises(Asked) as found:
        QUERIES[name](spark, sf_dir)
    assert found.value.args == (count,)


def copied(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
@pytest.mark.parametrize("k", [2, 3, 5])
def test_fusion_of_one_place_is_that_of_its_points(n, k):
    for goal in range(1, n + 2):
        reach = segmentation.Reach(np.zeros((n, 3)), [list(range(min(k, n)))] * n, 1.0)
        want = segmentation.refined(reach, segmentation.fused(reach, goal))
        assert segmentation.fused_in_place(n, k, goal).tolist() == want.tolist()


@pytest.mark.parametrize("k, goal, z_scale", [(1, 3, 1.0), (4, 5, 1.0), (7, 12, 10.0), (30, 4, 10.0)])
def test_fusion_by_places_is_that_of_all_points(spark, k, goal, z_scale):
    draw = np.random.default_rng(5)
    grid_of = np.argwhere(np.ones((4, 4, 2)))  # many places as far as each other
    far = draw.uniform(0, 50, (40, 3))
    for xyz in (np.concatenate([grid_of, far, grid_of[:9], grid_of[3:20]]), np.concatenate([far, far, far, grid_of, grid_of, grid_of, grid_of, grid_of])):
        points = copied(spark, np.concatenate([draw.permutation(xyz), [[np.nan, 0, 0], [np.nan, 0, 0]]]))
        want = segmentation.fusion_supervoxels(points, knn.k_nearest(points, points, k), goal, z_scale)
        assert {tuple(r) for r in segmentation.nearest_fusion(points, k, goal, z_scale).collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("name, goal", [("g6_fusion_supervoxels", 4), ("c11_fused_supervoxels", 6)])
def test_copies_of_points_have_no_neighbours_as_rows(spark, sf_dir, monkeypatch, name, goal):
    def asked(*_, **__):
        raise Asked

    points = copied(spark, [(i // 60, 0, i // 60 % 7) for i in range(600)])
    monkeypatch.setattr(registry, "event_points", lambda *_: points)
    monkeypatch.setattr(knn, "k_nearest", asked)
    got = QUERIES[name](spark, sf_dir).toPandas().sort_values("point_id")
    # each place has a tenth of the goal: as many of its points remain as that, and the last one to take others in has them
    sizes = got.groupby("label").size().tolist()
    assert got["label"].tolist() == sorted(got["label"]) and sizes == [60 - goal + 1, *[1] * (goal - 1)] * 10


@pytest.mark.parametrize("seed", range(8))
def test_links_in_parts_give_the_segments_of_all(seed):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(0, 50, (2, 300))
    a, b = a[a < b], b[a < b]
    w = (draw.integers(0, 30, len(a)) / 30).astype(np.float32)
    w[draw.random(len(w)) < 0.05] = np.nan
    order = np.lexsort((b, a, w))
    for step in (1, 7, 100):
        parts = (order[i : i + step] for i in range(0, len(a), step))
        got = segmentation.merged_in_order(50, ((a[p], b[p], w[p]) for p in parts), 0.3, 4, step)
        assert got.tolist() == segmentation.merged(50, a, b, w, 0.3, 4).tolist()


@pytest.mark.parametrize("k, radius", [(6, None), (9, 1.5)])
def test_supervoxels_by_places_are_those_of_all_links(spark, monkeypatch, k, radius):
    draw = np.random.default_rng(3)
    grid_of = np.argwhere(np.ones((4, 4, 2)))
    xyz = np.concatenate([grid_of, grid_of, grid_of[:20], grid_of[5:6].repeat(8, axis=0), draw.uniform(0, 9, (30, 3))])
    points = copied(spark, draw.permutation(xyz)).withColumns({c: F.pmod(F.xxhash64("point_id", F.lit(c)), F.lit(16)) / 16.0 for c in "rgb"}).withColumn("label", F.lit(0))
    colours = {r["point_id"]: np.array([r["r"], r["g"], r["b"]]) for r in points.collect()}
    near = knn.neighbour_links(knn.search(points, points, k, radius)).collect()
    links = {(r["a"], r["b"]): np.float32(((colours[r["a"]] - colours[r["b"]]) ** 2).sum()) for r in near}
    assert {(r["a"], r["b"]): np.float32(r["w"]) for r in pipelines.colour_links(points, k, radius).collect()} == links
    a, b = np.array(list(links)).T
    roots = segmentation.merged(len(xyz), a, b, np.array(list(links.values())), 0.2, 5)
    monkeypatch.setattr(segmentation, "LOCAL_LINKS", 10)
    monkeypatch.setattr(segmentation, "_rounds", None)
    got = pipelines.graph_supervoxels(points, 0.2, 5, k, radius).select("point_id", "label").collect()
    assert {tuple(r) for r in got} == set(enumerate(np.unique(roots, return_inverse=True)[1].tolist()))


@pytest.mark.parametrize("n", [2, 3, 9])
def test_complete_graphs_at_once_have_the_segments_of_each(n):
    draw = np.random.default_rng(n)
    a, b = np.triu_indices(n, 1)
    for ratio, least in ((0.3, 3), (0.05, 1), (0.6, 20)):
        w = draw.integers(0, 20, (60, len(a))) / 20
        w[draw.random(w.shape) < 0.1] = np.nan
        got = segmentation.merged_complete(w, n, ratio, least)
        assert got.tolist() == [segmentation.merged(n, a, b, x, ratio, least).tolist() for x in w]


@pytest.mark.parametrize("k, radius", [(4, None), (4, 0.9), (9, 0.5)])
def test_places_by_themselves_are_settled_without_links_as_rows(spark, monkeypatch, k, radius):
    draw = np.random.default_rng(1)
    xyz = np.concatenate([np.argwhere(np.ones((3, 3, 1))).repeat(draw.integers(1, 9, 9), axis=0) * 1.0, [[40.0, 0, 0]] * 12, [[41.0, 0, 0]] * 5, [[np.nan, 0, 0]] * 2])
    points = copied(spark, draw.permutation(xyz)).withColumns({c: F.pmod(F.xxhash64("point_id", F.lit(c)), F.lit(16)) / 16.0 for c in "rgb"}).withColumn("label", F.lit(0))
    links = pipelines.colour_links(points, k, radius)
    want = segmentation.graph_segments(points.select(F.col("point_id").alias("node")), links, 0.2, 3).collect()
    asked = []
    monkeypatch.setattr(segmentation, "graph_roots", lambda nodes, links, *rest, f=segmentation.graph_roots: asked.append(nodes.count()) or f(nodes, links, *rest))
    got = pipelines.graph_supervoxels(points, 0.2, 3, k, radius).select("point_id", "label").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and sum(asked) < len(xyz) - 18
