import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen3d.functions import columns as fn
from lumen3d.operators import graph, grid, inpainting, knn, light, raster, segmentation, segments
from tests.by_hand import filled_by_hand


def cloud(spark, xyz, **more):
    frame = pd.DataFrame(xyz, columns=["x", "y", "z"]).assign(point_id=range(len(xyz)), **more)
    return spark.createDataFrame(frame)


def random_points(n, seed=0, scale=(10, 10, 3)):
    return np.random.default_rng(seed).random((n, 3)) * scale


@pytest.mark.parametrize("n,k", [(1, 3), (40, 7), (400, 12)])
def test_nearest_equals_brute_force(spark, n, k):
    xyz = random_points(n, n)
    got = knn.k_nearest(cloud(spark, xyz), cloud(spark, xyz), k).toPandas().sort_values(["query_id", "rank"])
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    want = np.array([np.lexsort((np.arange(n), row))[:k] for row in d2])
    assert got["nbr_id"].to_numpy().reshape(n, -1).tolist() == want.tolist()
    assert (got[got["rank"] == 1]["nbr_id"].to_numpy() == np.arange(n)).all()


def test_nearest_with_queries_far_away_and_dense_clumps(spark):
    xyz = np.concatenate([random_points(50), random_points(50) * 1e-3 + 500])
    asked = cloud(spark, np.array([[-1e4, 0, 0], [500, 500, 500.0], [20, 20, 20]]))
    got = knn.k_nearest(asked, cloud(spark, xyz), 4).toPandas().sort_values(["query_id", "rank"])
    d2 = ((asked.orderBy("point_id").select("x", "y", "z").toPandas().to_numpy()[:, None] - xyz[None]) ** 2).sum(-1)
    assert got["nbr_id"].to_numpy().reshape(3, 4).tolist() == np.argsort(d2, axis=1, kind="stable")[:, :4].tolist()


def test_nearest_of_nothing(spark):
    empty = cloud(spark, random_points(1)).where("false")
    assert knn.k_nearest(empty, cloud(spark, random_points(5)), 3).count() == 0
    assert knn.k_nearest(cloud(spark, random_points(5)), empty, 3).count() == 0


def test_plane_has_its_normal(spark):
    xyz = random_points(200)
    xyz[:, 2] = 0.5 * xyz[:, 0]
    got = segments.point_normals(cloud(spark, xyz), 10).toPandas()
    want = np.array([-0.5, 0, 1]) / np.sqrt(1.25)
    assert np.allclose(got[["nx", "ny", "nz"]].to_numpy(float), want, atol=1e-6)
    assert np.allclose(got["curvature"].astype(float), 0, atol=1e-9)


def test_coincident_points_have_no_normal(spark):
    got = segments.point_normals(cloud(spark, np.ones((4, 3))), 3).toPandas()
    assert got["nx"].isna().all() and got["curvature"].isna().all()


def components_by_hand(n, edges):
    up = list(range(n))
    for _ in range(n):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 9), (7, 8), (8, 8)], [(9, 0), (9, 1), (4, 5), (5, 9)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graph.component_ids(spark.createDataFrame(edges, "a long, b long")).collect()}
    n = max(map(max, edges)) + 1
    want = components_by_hand(n, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


def merged_by_hand(n, edges, ratio, least):
    """Sets as lists; the rule read off its definition."""
    home, sets = list(range(n)), {i: [i] for i in range(n)}
    limit = dict.fromkeys(range(n), np.float32(ratio))

    def join(a, b):
        sets[a] += sets.pop(b)
        for x in sets[a]:
            home[x] = a
        return a

    for w, a, b in sorted(edges):
        a, b = home[a], home[b]
        if a != b and w <= limit[a] and w <= limit[b]:
            a = join(a, b)
            limit[a] = np.float32(w) + np.float32(ratio) / np.float32(len(sets[a]))
    for _, a, b in sorted(edges):
        a, b = home[a], home[b]
        if a != b and min(len(sets[a]), len(sets[b])) < least:
            join(a, b)
    return [min(sets[home[i]]) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_graph_segments_equal_a_plain_reading(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    edges = [(np.float32(rng.random()), int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (90, 2)) if a != b]
    links = spark.createDataFrame([(a, b, float(w)) for w, a, b in edges], "a long, b long, w double")
    got = segmentation.graph_segments(spark.range(n).withColumnRenamed("id", "node"), links, 0.3, 3).toPandas().sort_values("node")["label"].tolist()
    want = merged_by_hand(n, edges, 0.3, 3)
    assert got == [sorted(set(want)).index(x) for x in want]


@pytest.mark.parametrize("few", [True, False])
def test_few_links_are_settled_without_their_components(spark, monkeypatch, few):
    def found(links, find=segmentation.component_ids):
        assert not few
        return find(links)

    monkeypatch.setattr(segmentation, "component_ids", found)
    if not few:
        monkeypatch.setattr(segmentation, "FEW_LINKS", 0)
    test_graph_segments_equal_a_plain_reading(spark, 5)


def test_chain_of_five_merges_as_computed_by_hand(spark):
    links = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.9), (3, 4, 0.1)], "a long, b long, w double")
    got = segmentation.graph_segments(spark.range(5).withColumnRenamed("id", "node"), links, 0.5, 1).orderBy("node").toPandas()["label"].tolist()
    assert got == [0, 0, 0, 1, 1]


@pytest.mark.parametrize("seed", range(3))
def test_graph_segments_in_rounds(spark, seed):
    """Rounds that decide links out of order end where the plain order does; ties in weight included."""
    rng = np.random.default_rng(seed)
    n = 80
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (260, 2)) if a != b}
    edges = [(np.float32(round(rng.random(), 1 + seed)), a, b) for a, b in pairs]
    links = spark.createDataFrame([(a, b, float(w)) for w, a, b in edges], "a long, b long, w double")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    want = merged_by_hand(n, edges, 0.3, 4)
    want = [sorted(set(want)).index(x) for x in want]
    for most in (0, 40):
        assert segmentation.graph_segments(nodes, links, 0.3, 4, most=most).orderBy("node").toPandas()["label"].tolist() == want


def test_regions_of_a_size_from_chosen_seeds(spark):
    side = np.array([(x, y, 0) for x in range(6) for y in range(6)], float) / 6
    xyz = np.concatenate([side, side[:9] + [3, 0, 0], side + [6, 0, 0]])
    t = cloud(spark, xyz)
    near = knn.k_nearest(t, t, 5)
    normals = segments.point_normals(t, neighbours=near)
    labels = lambda **more: segmentation.region_growing(normals, near, **more).orderBy("point_id").toPandas()["label"].to_numpy()
    sized = labels(least=20)
    assert set(sized[:36]) == {0} and set(sized[36:45]) == {-1} and set(sized[45:]) == {1}
    assert set(labels(most=20)[36:45]) == {0} and set(labels(most=20)[:36]) == {-1}
    seeded = labels(seeds=spark.createDataFrame([(50,), (50,)], "point_id long"))
    assert set(seeded[:45]) == {-1} and set(seeded[45:]) == {0}


def test_k_nearest_of_clusters_and_outliers(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(size=(500, 3)) * 1e-3, rng.normal(size=(300, 3)) * 0.2 + 5, rng.random((60, 3)) * 40, [[1000.0, -900.0, 3.0]], np.zeros((9, 3)), np.zeros((9, 3)) + 7])
    t = cloud(spark, xyz)
    d2 = sum((xyz[:, None, a] - xyz[None, :, a]) ** 2 for a in range(3))
    for k, more in ((4, {}), (7, {"tile_points": 8, "most": 50})):
        got = knn.k_nearest(t, t, k, **more).toPandas().sort_values(["query_id", "rank"])
        want = np.array([np.lexsort((np.arange(len(xyz)), row))[:k] for row in d2])
        assert (got["nbr_id"].to_numpy().reshape(-1, k) == want).all()
        assert (got["rank"].to_numpy().reshape(-1, k) == np.arange(1, k + 1)).all()
        assert np.allclose(got["d2"].to_numpy().reshape(-1, k), np.take_along_axis(d2, want, 1))


def test_k_nearest_compares_as_many_pairs_in_clustered_clouds(spark):
    rng = np.random.default_rng(4)
    n, counts = 20_000, []
    clustered = np.concatenate([rng.normal(size=(n // 2, 3)) * 1e-3, rng.normal(size=(n // 4, 3)) + 20, rng.random((n // 4, 3)) * 50, rng.random((5, 3)) * 5000])
    for xyz in (rng.random((n, 3)), np.concatenate([rng.random((n, 3)), [[1000.0, 0.0, 0.0]]]), clustered):
        compared = spark.sparkContext.accumulator(0)
        t = cloud(spark, xyz)
        assert knn.k_nearest(t, t, 10, compared=compared).write.format("noop").mode("overwrite").save() is None
        counts.append(compared.value)
    assert max(counts[1:]) <= 10 * counts[0]


def test_queries_outside_the_points(spark):
    rng = np.random.default_rng(5)
    xyz = rng.random((700, 3))
    asked = np.concatenate([rng.random((40, 3)) * 6 - 3, [[np.nan, 0, 0]]])
    got = knn.k_nearest(cloud(spark, asked), cloud(spark, xyz), 3, tile_points=16).toPandas().sort_values(["query_id", "rank"])
    d2 = ((asked[:40, None] - xyz[None]) ** 2).sum(-1)
    assert (got["nbr_id"].to_numpy().reshape(-1, 3) == np.argsort(d2, axis=1)[:, :3]).all()


def test_two_cubes_are_two_regions(spark):
    side = np.array([(x, y, 0) for x in range(8) for y in range(8)], float) / 8
    xyz = np.concatenate([side, side + [3, 0, 0]])
    t = cloud(spark, xyz)
    near = knn.k_nearest(t, t, 6)
    got = segmentation.region_growing(segments.point_normals(t, neighbours=near), near).orderBy("point_id").toPandas()["label"].to_numpy()
    assert len(set(got[:64])) == 1 and len(set(got[64:])) == 1 and got[0] != got[64]


def test_fusion_covers_all_points_with_the_goal(spark):
    t = cloud(spark, random_points(120, 3))
    near = knn.k_nearest(t, t, 12)
    got = segmentation.fusion_supervoxels(t, near, 10).toPandas()
    assert len(got) == 120 and got["label"].nunique() == 10 and set(got["label"]) == set(range(10))


def test_border_mask_in_reading_order():
    labels = np.zeros((6, 6), int)
    labels[:, 3:] = 1
    mask = segmentation.raster_mask(labels, thick=False)
    assert mask[:, 2].all() and not mask[:, 4:].any() and not mask[:, :2].any()


def test_inpainting_solves_its_equations(spark):
    rng = np.random.default_rng(1)
    z = rng.random((20, 22))
    z[7:12, 9:15] = -1
    frame = pd.DataFrame([(r, c, z[r, c], 0) for r in range(20) for c in range(22)], columns=["row", "col", "value", "label"])
    got = inpainting.inpainted(spark.createDataFrame(frame, "row int, col int, value double, label int"), 1.0, 1.0, 0.0).toPandas().pivot(index="row", columns="col", values="value").to_numpy()
    assert np.allclose(got, filled_by_hand(z, z > 0), atol=1e-6)


def test_convolution_repeats_the_border(spark):
    z = np.random.default_rng(2).random((5, 7))
    kernel = np.arange(9.0).reshape(3, 3)
    frame = pd.DataFrame([(r, c, z[r, c]) for r in range(5) for c in range(7)], columns=["row", "col", "value"])
    got = raster.convolved(spark.createDataFrame(frame), kernel).toPandas().pivot(index="row", columns="col", values="out").to_numpy()
    pad = np.pad(z, 1, mode="edge")
    want = np.array([[(pad[r : r + 3, c : c + 3] * kernel[::-1, ::-1]).sum() for c in range(7)] for r in range(5)])
    assert np.allclose(got, want)


def test_light_is_recovered(spark):
    rng = np.random.default_rng(4)
    n = rng.normal(size=(60, 3))
    true = np.array([0.3, 0.2, np.sqrt(1 - 0.13)])
    frame = pd.DataFrame(n, columns=["nx", "ny", "nz"]).assign(label=np.arange(60) % 3, brightness=2.5 * n @ true)
    found = light.light_directions(spark.createDataFrame(frame))
    got = light.combined_light(found).first()
    assert np.allclose([got["lx"], got["ly"], got["lz"]], true)
    flat = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0)] * 4, "label int, nx double, ny double, nz double, brightness double")
    assert light.light_directions(flat).first()["lx"] is None


def test_reflectance_minimises_its_objective(spark):
    rng = np.random.default_rng(5)
    labels, pixels, bands = 6, 15, 2
    s, image, m = rng.random((pixels, labels)), rng.random((pixels, bands)), rng.random(pixels)
    colours = rng.random((labels, 3)) * 0.1
    meets = [(i, j) for i in range(labels) for j in range(labels) if abs(i - j) == 1]
    w = -np.eye(labels)
    for i in range(labels):
        near = [j for a, j in meets if a == i and np.sqrt(((colours[i] - colours[j]) ** 2).mean()) < 0.05]
        for j in near:
            w[i, j] = 1 / len(near)
    want = np.linalg.solve(s.T @ s + 15 * w.T @ w, s.T @ (image * m[:, None]))
    got = light.reflectance(
        spark.createDataFrame([(p, i, float(s[p, i])) for p in range(pixels) for i in range(labels)], "pixel long, label int, v double"),
        spark.createDataFrame(meets, "label int, nbr_label int"),
        spark.createDataFrame([(i, *map(float, colours[i])) for i in range(labels)], "label int, r double, g double, b double"),
        spark.createDataFrame([(p, [float(v) for v in image[p]]) for p in range(pixels)], "pixel long, bands array<double>"),
        spark.createDataFrame([(p, float(m[p])) for p in range(pixels)], "pixel long, m double"),
        15.0, 0.05, repair_below=None,
    )
    assert np.allclose(got.toPandas().pivot(index="label", columns="band", values="value").to_numpy(), want)


def test_grid_rejects_a_single_place(spark):
    with pytest.raises(ValueError):
        grid.grid_of(cloud(spark, np.ones((3, 3))), 1.0)
    assert grid.bounding_box(cloud(spark, np.ones((1, 3))).where("false")).first()["min_x"] is None


def test_level_light_projects_to_null(spark):
    assert grid.along_light(cloud(spark, np.ones((2, 3))), (1.0, 0.0, 0.0)).first()["x"] is None


def test_unit_of_nothing_is_null(spark):
    row = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(fn.unit(F.col("v")).alias("u")).first()
    assert row["u"] == [None, None]


def test_octree_counts_occupied_leaves(spark):
    xyz = random_points(300, 8)
    row = grid.octree_leaves(cloud(spark, xyz), 1.0).first()
    extent = (xyz.max(0) - xyz.min(0)).max() * 1.01
    depth = 0
    while extent > 4 / 3:
        extent, depth = extent / 2, depth + 1
    assert row["depth"] == depth and 0 < row["leaves"] <= 300


@pytest.mark.parametrize("radius,k", [(0.4, 3), (2.0, 5), (50.0, 4)])
def test_nearest_within_never_lists_the_pairs_of_a_dense_part(spark, monkeypatch, radius, k):
    def pairs(*_):
        raise AssertionError("all pairs within the radius")

    monkeypatch.setattr(knn, "_met", pairs)
    xyz = np.concatenate([random_points(300), np.repeat([[5.0, 5, 1]], 700, axis=0), random_points(40, 1) * 30 + 100, [[np.nan, 1, 1], [np.inf, 1, 1]]])
    got = knn.nearest_within(cloud(spark, xyz), cloud(spark, xyz), radius, k).toPandas().sort_values(["query_id", "rank"])
    with np.errstate(invalid="ignore"):
        d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    want = [(q, r + 1, n) for q, row in enumerate(d2) for r, n in enumerate(np.lexsort((np.arange(len(xyz)), row))[:k].tolist()) if row[n] < radius * radius]
    assert list(got[["query_id", "rank", "nbr_id"]].itertuples(index=False, name=None)) == want
