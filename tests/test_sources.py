import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen3d.operators import knn, segments
from lumen3d.sources import las, tiff


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32", "float64", "int32"])
@pytest.mark.parametrize("bands", [1, 3])
def test_tiff_round_trip(dtype, bands):
    data = (np.random.default_rng(0).random((5, 7, bands)) * 200).astype(dtype)
    got, transform, projection = tiff.decode(tiff.encode(data, [10.0, 2.0, 0.0, 60.0, 0.0, -2.0], "LOCAL"))
    assert got.dtype.name == (dtype if dtype in tiff.WRITTEN else "float32")
    assert np.allclose(got, data) and transform == [10.0, 2.0, 0.0, 60.0, 0.0, -2.0] and projection == "LOCAL"


def test_tiff_through_spark(spark, tmp_path):
    data = np.random.default_rng(1).random((4, 6, 2))
    frame = pd.DataFrame([(r, c, data[r, c].tolist()) for r in range(4) for c in range(6)], columns=["row", "col", "bands"])
    tiff.write_raster(spark.createDataFrame(frame), f"file://{tmp_path}/a.tif", [0.0, 1.0, 0.0, 4.0, 0.0, -1.0], "P")
    pixels, heads = tiff.read_rasters(spark, f"file://{tmp_path}/*.tif")
    got = pixels.orderBy("pixel").toPandas()
    assert np.allclose(np.stack(got["bands"]).reshape(4, 6, 2), data)
    assert heads.first()["n_bands"] == 2 and heads.first()["gt"] == [0.0, 1.0, 0.0, 4.0, 0.0, -1.0]


def test_tiff_leaves_out_the_pixels_that_are_not_there(spark, tmp_path):
    places = [(r, c) for r in range(4) for c in range(11) if (r, c) not in {(1, 5), (3, 9), (3, 10)}]
    frame = pd.DataFrame([(r, c, [float(r * c), 0.0, float("nan")]) for r, c in places], columns=["row", "col", "bands"])
    for dtype in ("float64", "uint8"):
        tiff.write_raster(spark.createDataFrame(frame.assign(bands=[[float(r * c), 0.0, 1.0] for r, c in places]) if dtype == "uint8" else frame), f"file://{tmp_path}/{dtype}.tif", [0.0, 1.0, 0.0, 4.0, 0.0, -1.0], "P", dtype)
        got = tiff.read_rasters(spark, f"file://{tmp_path}/{dtype}.tif")[0].orderBy("pixel").toPandas()
        assert list(zip(got["row"], got["col"], strict=True)) == places and [b[0] for b in got["bands"]] == [r * c for r, c in places]
    assert tiff.held_of(tiff.encode(np.zeros((2, 3, 1)), [0.0, 1.0, 0.0, 4.0, 0.0, -1.0], held=np.ones((2, 3), bool))) is None


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tiff.decode(b"nonsense" * 4)
    with pytest.raises(ValueError):
        next(las.decode(b"nonsense" * 40))


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"x": rng.random(50) * 10 + 5e5, "y": rng.random(50) * 10 + 3.4e6, "z": rng.random(50), "intensity": np.arange(50.0), "classification": np.arange(50) % 9, "num_returns": 1 + np.arange(50) % 5, "gps_time": rng.random(50)})
    (tmp_path / "a.las").write_bytes(las.encode(frame))
    got = las.read_points(spark, f"file://{tmp_path}/*.las").orderBy("point_id").toPandas()
    for c in ("x", "y", "z"):
        assert np.abs(got[c] - frame[c]).max() <= 0.0005 + 1e-9
    for c in ("intensity", "classification", "num_returns", "gps_time"):
        assert (got[c].to_numpy() == frame[c].to_numpy()).all()


@pytest.mark.parametrize("n", [0, 1, 95])
def test_las_files_are_written_without_the_cloud_on_the_driver(spark, tmp_path, monkeypatch, n):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"x": rng.random(n) * 10 + 5e5, "y": rng.random(n) * 10 + 3.4e6, "z": rng.random(n), "intensity": np.arange(float(n)), "classification": np.arange(n) % 9, "num_returns": 1 + np.arange(n) % 5, "gps_time": np.arange(float(n))})
    points = spark.createDataFrame(frame, "x double, y double, z double, intensity double, classification int, num_returns int, gps_time double").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(type(points), "toPandas", None)
        las.write_points(points, f"file://{tmp_path}/a", at_once=10)
    assert n < 95 or len(list((tmp_path / "a").glob("*.las"))) >= 10
    got = las.read_points(spark, f"file://{tmp_path}/a").orderBy("gps_time").toPandas()
    assert len(got) == n
    whole = pd.concat([frame.iloc[:0], *las.decode(las.encode(frame))])  # as one file holds them
    for c in frame.columns:
        assert (got[c].to_numpy() == whole[c].to_numpy()).all()


def test_column_major(spark):
    data = np.arange(24.0).reshape(2, 3, 4)
    flat = spark.createDataFrame(list(enumerate(data.ravel(order="F").tolist())), "i long, value double")
    got = tiff.column_major(flat, 2, 3).toPandas()
    assert (data[got["row"], got["col"], got["band"]] == got["value"]).all()


def test_cube_faces(spark):
    cube = las.cube_cloud(spark, 60, (2.0, 1.0, 1.0), (1.5, 0.0, 0.0))
    box = cube.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    assert list(box) == [1.5, 3.5, 0.0, 1.0, 0.0, 1.0] and cube.count() == 360
    normals = segments.point_normals(cube, 6, neighbours=knn.k_nearest(cube, cube, 6)).toPandas()
    flat = normals[normals["curvature"].astype(float) < 1e-9]
    assert len(flat) > 100 and np.allclose(np.abs(flat[["nx", "ny", "nz"]].to_numpy(float)).max(axis=1), 1)


def mat_file(arrays, packed):
    import struct
    import zlib

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"x".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, array in arrays.items():
        kind, cls = {"f8": (9, 6), "i4": (5, 12), "u1": (2, 9)}[array.dtype.str[1:]]
        body = element(6, struct.pack("<II", cls, 0)) + element(5, np.array(array.shape, "<i4").tobytes()) + element(1, name.encode()) + element(kind, array.tobytes(order="F"))
        whole = element(14, body)
        out += struct.pack("<II", 15, len(z := zlib.compress(whole))) + z if packed else whole
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_mat_and_numpy_files(spark, tmp_path, packed):
    from lumen3d.sources import arrays

    held = {"data": np.arange(24.0).reshape(2, 3, 4), "III": np.arange(5, dtype="i4").reshape(5, 1), "b": np.arange(3, dtype="u1").reshape(1, 3)}
    (tmp_path / "a.mat").write_bytes(mat_file(held, packed))
    got = arrays.load(spark, f"file://{tmp_path}/a.mat")
    assert set(got) == set(held) and all((got[k] == held[k]).all() and got[k].shape == held[k].shape for k in held)
    np.save(tmp_path / "b.npy", held["data"])
    assert (arrays.load(spark, f"file://{tmp_path}/b.npy")["array"] == held["data"]).all()
    np.save(tmp_path / "c.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(ValueError):
        arrays.load(spark, f"file://{tmp_path}/c.npy")


def test_arrays_become_tables(spark):
    from lumen3d.sources import arrays

    xyz = np.arange(12.0).reshape(4, 3)
    got = arrays.points_of(spark, xyz, colour=xyz, intensity=np.arange(4)).orderBy("point_id").toPandas()
    assert (got[["x", "y", "z"]].to_numpy() == xyz).all() and (got["colour_2"] == xyz[:, 2]).all()
    with pytest.raises(ValueError):
        arrays.points_of(spark, xyz[:, :2])
    cube = np.arange(24).reshape(2, 3, 4)
    assert (arrays.cube_of(arrays.pixels_of(spark, cube)) == cube).all()
    with pytest.raises(TypeError):
        arrays.pixels_of(spark, cube.astype(complex))
