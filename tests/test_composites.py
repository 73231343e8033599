import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen3d.operators import clustering, light, merging, segmentation, segments
from lumen3d.plans import pipelines
from lumen3d.plans.fixtures import event_points
from lumen3d.plans.registry import QUERIES
from tests.by_hand import filled_by_hand


def test_seeds_lie_on_a_grid():
    places, step_x, step_y = clustering.seeds(20, 30, 5)
    assert (step_x, step_y) == (5, 5) and len(places) == 24
    assert all(0 <= x < 30 and 0 <= y < 20 for x, y in places) and len(set(places)) == 24


def test_clusters_do_not_cross_an_edge(spark):
    frame = pd.DataFrame([(r * 12 + c, r, c, [0.1, 0.2] if c < 6 else [0.9, 0.8]) for r in range(12) for c in range(12)], columns=["pixel", "row", "col", "bands"])
    pixels = spark.createDataFrame(frame, "pixel long, row int, col int, bands array<double>")
    got = clustering.superpixels(pixels, 12, 12, 6, 0.05, 3, 2).toPandas()
    left, right = set(got[got["col"] < 6]["label"]), set(got[got["col"] >= 6]["label"])
    assert not left & right and len(got) == 144
    joined = clustering.connected_superpixels(spark.createDataFrame(got, "pixel long, row int, col int, label int").join(pixels.select("pixel", "bands"), "pixel"), 4, 12, 12, 6, 0.05, 2).toPandas()
    assert sorted(joined["label"].unique()) == list(range(joined["label"].nunique()))


def features_of(values):
    """Places that do not tell and one band, as connected_labels() takes them."""
    flat = np.zeros((*values.shape, 6))
    flat[:, :, 4], flat[:, :, 5] = np.cos(values), np.sin(values)
    return flat


def test_small_components_take_the_label_met_last():
    labels = np.zeros((4, 5), int)
    labels[:, 2:] = 1
    labels[1, 3] = 5  # one pixel, left of which is label 1
    labels[3, 0] = 6  # one pixel of the first column, above which is label 0
    assert (clustering.settled_labels(labels, 2) == np.where(labels == 5, 1, np.where(labels == 6, 0, labels))).all()
    first = np.array([[3, 4], [4, 4]])
    assert (clustering.settled_labels(first, 2) == [[0, 4], [4, 4]]).all()  # nothing is met before the first


def test_small_parts_join_the_nearest_in_value():
    labels = np.zeros((6, 6), int)
    labels[:, 3:] = 1
    labels[2:4, 2] = 7
    values = np.where(labels == 1, 1.0, 0.0)
    values[2:4, 2] = 0.9
    got = clustering.connected_labels(labels, features_of(values), np.ones((6, 6)), 1, 3)
    assert got[2, 2] == got[0, 5] and got[0, 0] == 0 and got.max() == 1


@pytest.mark.parametrize("seed", range(6))
def test_connectivity_against_a_plain_reading(seed):
    """Components are sets of pixels here, merged one by one with centres taken anew from their definition."""
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 3, (7, 9))
    values, weights = rng.random((7, 9)), rng.random((7, 9)) + 0.5
    features = features_of(values)
    features[:, :, 0] = np.arange(9) / 9
    got = clustering.connected_labels(labels, features, weights, 2, 5)
    settled = clustering.settled_labels(labels, 2)
    order = [(y, x) for x in range(9) for y in range(7)]
    parts = []
    for p in order:
        if any(p in q for q in parts):
            continue
        part, todo = {p}, [p]
        while todo:
            y, x = todo.pop()
            for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if q in order and q not in part and settled[q] == settled[p]:
                    part.add(q)
                    todo.append(q)
        parts.append(part)
    states = []
    for part in parts:
        seed_at, w = min(part, key=order.index), sum(weights[q] for q in part)
        centre = len(part) * features[seed_at]
        centre = np.concatenate([sum(features[q][:4] for q in part), centre[4:]]) / w
        states.append([part, len(part), w, centre])
    alive, small = list(range(len(parts))), [k for k in range(len(parts)) if len(parts[k]) < 5]
    while small:
        k = small.pop(0)
        touching = [o for o in alive if o != k and any(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a in states[k][0] for b in states[o][0])]
        if not touching:
            continue
        o = min(touching, key=lambda t: (((states[t][3] - states[k][3]) ** 2).sum(), t))
        a, b = states[k], states[o]
        b[3] = (b[2] * b[3] + a[2] * a[3]) / (a[2] + b[2])
        b[0], b[2] = a[0] | b[0], a[2] + b[2]
        alive.remove(k)
        if o in small:
            b[1] += a[1]
            if b[1] >= 5:
                small.remove(o)
    names = {}
    want = [names.setdefault(next(k for k in alive if p in states[k][0]), len(names)) for p in order]
    assert [got[p] for p in order] == want


def test_classes_are_segmented_one_by_one(spark, sf_dir):
    points = segments.split_by_returns(event_points(spark, sf_dir), 5.0)
    got = pipelines.class_segments(points, [("other", 0.6, 5), ("tree", 0.6, 5)], neighbours=8).toPandas().sort_values("point_id")
    base = 0
    for name in ("other", "tree"):
        own = pipelines.graph_supervoxels(points.where(F.col("class") == name), 0.6, 5, 8).toPandas().sort_values("point_id")
        mine = got[got["class"] == name]
        assert (mine["point_id"].to_numpy() == own["point_id"].to_numpy()).all() and (mine["label"].to_numpy() == own["label"].to_numpy() + base).all()
        base += own["label"].max() + 1


def test_heights_of_a_class_may_be_decomposed(spark, sf_dir):
    """A decomposition that levels heights changes the classes it is given for, and those alone."""
    points = segments.split_by_returns(event_points(spark, sf_dir), 5.0)
    level = lambda image: image.withColumn("value", F.lit(1.0))
    parts = [("ground", 4.0, 0.01, 2), ("other", 4.0, 0.01, 2)]
    plain, other = (pipelines.class_supervoxels(points, parts, heights=h, neighbours=6).toPandas().set_index("point_id").sort_index() for h in (None, {"other": level}))
    assert set(other[other["class"] == "other"]["b"]) == {1.0} and len(set(plain[plain["class"] == "other"]["b"])) > 9
    assert (plain[plain["class"] == "ground"]["label"] == other[other["class"] == "ground"]["label"]).all()


def test_composite_images_are_their_definitions(spark, sf_dir):
    """c2, c3 and c4: per-cell sums by hand, holes filled by a dense system."""
    points = event_points(spark, sf_dir).toPandas()
    col = np.clip(np.trunc(points["x"] / 2).astype(int), 0, 24)
    row = np.clip(np.trunc((points["y"] - 60) / -2).astype(int), 0, 29)
    cells = points.groupby([row.rename("r"), col.rename("c")])
    image = lambda series, fill: series.reindex(pd.MultiIndex.from_product([range(30), range(25)]), fill_value=fill).to_numpy().reshape(30, 25)
    shown = lambda name, value: QUERIES[name](spark, sf_dir).toPandas().pivot(index="row", columns="col", values=value).to_numpy()
    highest = image(cells["z"].max(), -1000.0)
    assert (highest == -1000).any()  # there are holes
    assert np.allclose(shown("c2_surface", "value"), filled_by_hand(highest, highest > -1000), atol=2e-4)
    mean = image(cells["intensity"].mean(), 0.0)
    mean = filled_by_hand(mean, mean > 0)
    assert np.allclose(shown("c3_intensity_image", "value"), mean / mean.max(), atol=2e-4)
    for part in ("nx", "ny", "nz"):
        weighed = cells.apply(lambda f, part=part: (f[part] * f["nz"]).sum() / f["nz"].sum(), include_groups=False)
        whole = image(weighed, -1.0)
        assert np.allclose(shown("c4_normals_image", part), filled_by_hand(whole, whole > -1), atol=2e-4)


def test_both_solvers_give_the_least_norm():
    rng = np.random.default_rng(2)
    s = rng.random((30, 12)) @ np.diag([1.0] * 9 + [0.0] * 3) @ rng.random((12, 12))
    a, b = s.T @ s, s.T @ rng.random((30, 2))
    assert np.allclose(light.conjugate_gradients(lambda p: a @ p, b), np.linalg.lstsq(a, b, rcond=1e-10)[0], atol=1e-5)


def test_walks_have_a_direction():
    near = [np.array([1]), np.array([2]), np.array([], int), np.array([2, 4]), np.array([], int), np.array([4, 0])]
    start, place = segmentation.walked(near)
    assert start.tolist() == [0, 0, 0, 3, 3, 5] and place.tolist() == [0, 1, 2, 0, 1, 0]


def test_small_clusters_belong_to_earlier_ones(spark):
    """Three clusters in a row, each out of reach of the others but among their neighbours: all take the first one's label."""
    xyz = np.array([(10.0 * c + 0.1 * i, 0.01 * i * i, 0.0) for c in range(3) for i in range(12)])
    ground = np.column_stack([np.linspace(0, 30, 60), np.full(60, 500.0), np.zeros(60)])
    rows = [(i, *map(float, p), -1, 900 + i) for i, p in enumerate(xyz)] + [(100 + i, *map(float, p), 0, i // 10) for i, p in enumerate(ground)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, label int, voxel int")
    got = merging.merged_classes(points, distance=1.0, neighbours=30).toPandas().set_index("point_id").sort_index()
    assert got["label"][:36].nunique() == 1
    assert set(got["class"][:12]) == {merging.CAR} and set(got["class"][12:36]) == {merging.TREE}


def test_merging_tells_ground_building_and_car(spark):
    rng = np.random.default_rng(0)
    ground = np.column_stack([rng.random((300, 2)) * 40, np.zeros(300)])
    roof = np.column_stack([rng.random((80, 2)) * 5 + 60, np.full(80, 9.0)])
    car = np.column_stack([rng.random((30, 2)) * 2 + [20, 20], np.full(30, 1.0)])
    xyz = np.concatenate([ground, roof, car])
    frame = pd.DataFrame(xyz, columns=["x", "y", "z"]).assign(point_id=range(len(xyz)), label=[0] * 300 + [1] * 80 + [2] * 30)
    frame["voxel"] = frame["label"] * 100 + (frame["x"] // 10).astype(int)
    got = merging.merged_classes(spark.createDataFrame(frame), distance=3.0, neighbours=10).toPandas().sort_values("point_id")
    assert set(got["class"][:300]) == {merging.GROUND} and set(got["class"][300:380]) == {merging.BUILDING} and set(got["class"][380:]) == {merging.CAR}
    assert sorted(got["label"].unique()) == list(range(got["label"].nunique()))


def test_border_normals_point_out_of_a_disc(spark):
    frame = pd.DataFrame([(r, c, (r - 20) ** 2 + (c - 20) ** 2 <= 81) for r in range(41) for c in range(41)], columns=["row", "col", "inside"])
    got = pipelines.border_normals(spark.createDataFrame(frame)).toPandas()
    out = got[["row", "col"]].to_numpy() - 20
    out = out / np.linalg.norm(out, axis=1)[:, None]
    assert len(got) > 40 and ((got[["ny", "nx"]].to_numpy() * out).sum(axis=1) > 0.95).all()


def test_labels_of_parts_follow_each_other(spark):
    from lumen3d.operators.segments import offset_labels

    parts = [spark.createDataFrame([(i, i % n) for i in range(6)], "point_id long, label int") for n in (2, 3, 1)]
    assert sorted(r["label"] for r in offset_labels(parts).select("label").distinct().collect()) == list(range(6))
    assert offset_labels([parts[0].where("false"), parts[1]]).agg(F.min("label")).first()[0] == 0
