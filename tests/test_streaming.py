import numpy as np
import pandas as pd

from lumen3d.operators.grid import Grid, surface_model
from lumen3d.streaming.surfaces import running_surface, windowed_surface, write_surface

GRID = Grid(0.0, 1.0, 10.0, -1.0, 10, 10)
SCHEMA = "point_id long, x double, y double, z double, at timestamp"


def files(spark, path):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.random((300, 3)) * 10, columns=["x", "y", "z"]).assign(point_id=range(300), at=pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(300), "s"))
    for i in range(3):
        spark.createDataFrame(frame[i * 100 : i * 100 + 100]).select("point_id", "x", "y", "z", "at").coalesce(1).write.mode("append").parquet(path)
    return frame


def test_running_surface_equals_the_batch_one(spark, tmp_path):
    frame = files(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write_surface(running_surface(stream, GRID), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch={last}").collect()}
    assert last == 2 and got == {tuple(r) for r in surface_model(spark.createDataFrame(frame), GRID, no_data=None).collect()}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    files(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windowed_surface(stream, GRID, "at", "60 seconds", "10 seconds").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    n = {r["start"].minute: r["n"] for r in spark.sql("select start, sum(n) as n from windows group by start").collect()}
    assert set(n) <= {0, 1, 2, 3, 4} and len(n) >= 3 and all(v == 60 for v in n.values())
