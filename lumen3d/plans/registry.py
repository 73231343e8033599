"""Queries over the test tables, and the SQL each is held against; names begin with the identifier of the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen3d.functions import columns as fn
from lumen3d.functions.tables import ranked, shared_path
from lumen3d.operators import clouds, clustering, grid, inpainting, knn, light, merging, raster, segmentation, segments
from lumen3d.plans import pipelines
from lumen3d.plans.fixtures import BULK_SQL, EVENTS_SQL, GRID, HEIGHTS_SQL, LIGHT, PLACED_SQL, RASTER_SQL, SPECTRA_SQL, TRANSFORM, bulk_points, event_points, heights, spectra
from lumen3d.sources import las, tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; results agree to so many digits."""
    return frame.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in frame.schema])


#: The k nearest by comparing all with all, as nb (query_id, nbr_id).
_BRUTE = "m AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM {0} a, {0} b), k AS (SELECT query_id, min({{'d2': d2, 'nbr_id': nbr_id}}, {1}) AS best FROM m GROUP BY query_id), nb AS (SELECT query_id, unnest(best).nbr_id AS nbr_id FROM k)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.with_pixel(event_points(spark, sf_dir), GRID)


def dark(spark: SparkSession) -> DataFrame:
    """A stand-in for shadow: every fifth pixel."""
    return spark.range(0, GRID.height * GRID.width, 5).withColumnRenamed("id", "pixel")


R = lambda *cols: ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)

# ---- projections


@query("p1_geotransform", f"WITH {BULK_SQL} SELECT min(x) AS x0, 4.0::DOUBLE AS dx, max(y) AS y0, -4.0::DOUBLE AS dy, CAST(trunc((max(x) - min(x)) / 4.0) AS INTEGER) AS width, CAST(trunc((max(y) - min(y)) / 4.0) AS INTEGER) AS height FROM li")
def _(spark, d):
    return grid.fitted_grid(bulk_points(spark, d), 4.0)


@query("p3_pixels", f"WITH {PLACED_SQL} SELECT point_id, pixel FROM pt")
def _(spark, d):
    return placed(spark, d).select("point_id", "pixel")


@query("p4_pixel_to_geo", f"WITH {SPECTRA_SQL} SELECT pixel, row, col, CAST(col * {TRANSFORM[1]} + {TRANSFORM[0]} AS DOUBLE) AS geo_x, CAST({TRANSFORM[3]} + row * ({TRANSFORM[5]}) AS DOUBLE) AS geo_y FROM hsi")
def _(spark, d):
    return grid.pixel_to_geo(spectra(spark, d).select("pixel", "row", "col"), GRID)


@query("p5_geo_to_pixel", f"WITH {EVENTS_SQL} SELECT point_id, CAST(trunc((x - {TRANSFORM[0]}) / {TRANSFORM[1]}) AS INTEGER) AS col, CAST(trunc(({TRANSFORM[3]} - y) / ({TRANSFORM[5]})) AS INTEGER) AS row FROM ev")
def _(spark, d):
    places = event_points(spark, d).select("point_id", F.col("x").alias("geo_x"), F.col("y").alias("geo_y"))
    return grid.geo_to_pixel(places, GRID).select("point_id", "col", "row")


@query("p5_geo_to_pixel_corrected", f"WITH {EVENTS_SQL} SELECT point_id, CAST(trunc((x - {TRANSFORM[0]}) / {TRANSFORM[1]}) AS INTEGER) AS col, CAST(trunc((y - {TRANSFORM[3]}) / ({TRANSFORM[5]})) AS INTEGER) AS row FROM ev")
def _(spark, d):
    places = event_points(spark, d).select("point_id", F.col("x").alias("geo_x"), F.col("y").alias("geo_y"))
    return grid.geo_to_pixel(places, GRID, corrected=True).select("point_id", "col", "row")


@query("p6_along_light", f"WITH {EVENTS_SQL} SELECT point_id, round(x - z / {LIGHT[2]!r} * {LIGHT[0]}, 6) AS x, round(y - z / {LIGHT[2]!r} * {LIGHT[1]}, 6) AS y, round(z / {LIGHT[2]!r}, 6) AS z FROM ev")
def _(spark, d):
    return rounded(grid.along_light(event_points(spark, d), LIGHT).select("point_id", "x", "y", "z"))


@query("p7_yuv_to_rgb", f"WITH {EVENTS_SQL}, t AS (SELECT *, x - 0.25 * (y + z) AS gr FROM ev) SELECT point_id, round(z + gr, 6) AS r, round(gr, 6) AS g, round(y + gr, 6) AS b FROM t")
def _(spark, d):
    return rounded(event_points(spark, d).select("point_id", *fn.yuv_to_rgb(F.col("x"), F.col("y"), F.col("z"))))


_LONG = "unnest(range(len(bands))) AS band, unnest(bands) AS value"


@query("p8_scaled_cube", f"WITH {SPECTRA_SQL}, m AS (SELECT max(list_max(bands)) AS most FROM hsi), l AS (SELECT pixel, {_LONG} FROM hsi) SELECT pixel, CAST(band AS INTEGER) AS band, round(value / most + 1e-10, 9) AS value FROM l, m")
def _(spark, d):
    return rounded(raster.bands_long(raster.scaled_cube(spectra(spark, d))).select("pixel", "band", "value"), 9)


@query("p9_scaled_for_clusters", f"WITH {SPECTRA_SQL}, m AS (SELECT max(list_max(bands)) AS most FROM hsi), l AS (SELECT pixel, {_LONG} FROM hsi) SELECT pixel, CAST(band AS INTEGER) AS band, round(value / CASE WHEN most = 1 THEN 1 ELSE most END + 1e-4, 9) AS value FROM l, m")
def _(spark, d):
    return rounded(raster.bands_long(raster.scaled_cube(spectra(spark, d), 1e-4, keep_unit_max=True)).select("pixel", "band", "value"), 9)


@query("p10_unit_spectra", f"WITH {SPECTRA_SQL}, n AS (SELECT pixel, bands, sqrt(list_sum([v * v FOR v IN bands])) AS len FROM hsi), l AS (SELECT pixel, len, {_LONG} FROM n) SELECT pixel, CAST(band AS INTEGER) AS band, round(value / len, 9) AS value FROM l")
def _(spark, d):
    return rounded(raster.bands_long(spectra(spark, d).withColumn("bands", fn.unit(F.col("bands")))).select("pixel", "band", "value"), 9)


@query("p12_upward_normals", f"WITH {EVENTS_SQL}, t AS (SELECT point_id, nx, ny, nz - 0.7 AS nz FROM ev) SELECT point_id, {R('nx', 'ny', 'nz')} FROM (SELECT point_id, nx * s AS nx, ny * s AS ny, nz * s AS nz FROM (SELECT *, CASE WHEN nz > 0 THEN 1.0 ELSE -1.0 END AS s FROM t))")
def _(spark, d):
    t = event_points(spark, d).withColumn("nz", F.col("nz") - 0.7)
    parts = fn.upward(F.col("nx"), F.col("ny"), F.col("nz"))
    return rounded(t.select("point_id", *[p.alias(n) for p, n in zip(parts, ("nx", "ny", "nz"), strict=True)]))


@query("p13_clipped_intensity", f"WITH {EVENTS_SQL}, m AS (SELECT max(least(intensity, 100)) AS most FROM ev) SELECT point_id, round(least(intensity, 100) / most, 6) AS intensity FROM ev, m")
def _(spark, d):
    t = event_points(spark, d).select("point_id", fn.clipped(F.col("intensity"), 100.0).alias("intensity"))
    most = t.agg(F.max("intensity").alias("most"))
    return rounded(t.join(F.broadcast(most)).select("point_id", (F.col("intensity") / F.col("most")).alias("intensity")))


@query("p16_link_distances", f"WITH {EVENTS_SQL} SELECT a.point_id AS a, b.point_id AS b, round((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b), 11) AS colour, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 10.0 * ((a.z - b.z) * (a.z - b.z)), 11) AS stretched, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 11) AS plain FROM ev a JOIN ev b ON b.point_id = a.point_id + 1")
def _(spark, d):
    t = event_points(spark, d)
    names = ("x", "y", "z", "r", "g", "b")
    a = t.select(F.col("point_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in names], (F.col("point_id") + 1).alias("key"))
    b = t.select(F.col("point_id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in names])
    m = a.join(b, F.col("key") == F.col("b_id"))
    of = lambda cs, w=None: fn.squared_distance([F.col(f"a{c}") for c in cs], [F.col(f"b{c}") for c in cs], w)
    return rounded(m.select("a", F.col("b_id").alias("b"), of("rgb").alias("colour"), of("xyz", [1.0, 1.0, 10.0]).alias("stretched"), F.sqrt(of("xyz")).alias("plain")), 11)


# ---- filters


@query("f1_selected", f"WITH {EVENTS_SQL} SELECT point_id FROM ev WHERE point_id IN (SELECT event_id // 3 FROM events)")
def _(spark, d):
    t = event_points(spark, d)
    return segments.selected(t, t.select(F.floor(F.col("point_id") / 3).alias("point_id"))).select("point_id")


@query("f1_selected_inverted", f"WITH {EVENTS_SQL} SELECT point_id FROM ev WHERE point_id NOT IN (SELECT event_id // 3 FROM events)")
def _(spark, d):
    t = event_points(spark, d)
    return segments.selected(t, t.select(F.floor(F.col("point_id") / 3).alias("point_id")), invert=True).select("point_id")


@query("f2_gathered", f"WITH {EVENTS_SQL} SELECT i.event_id AS ordinal, point_id, x FROM events i JOIN ev ON ev.point_id = i.event_id // 3")
def _(spark, d):
    t = event_points(spark, d)
    return segments.gathered(t, t.select(F.col("point_id").alias("ordinal"), F.floor(F.col("point_id") / 3).alias("point_id"))).select("ordinal", "point_id", "x")


@query("f3_cropped", f"WITH {SPECTRA_SQL} SELECT pixel, row - 2 AS row, col - 3 AS col FROM hsi WHERE row >= 2 AND row < 9 AND col >= 3 AND col < 20")
def _(spark, d):
    return raster.cropped(spectra(spark, d), TRANSFORM, (2, 9), (3, 20))[0].select("pixel", "row", "col")


@query("f4_cropped_by_place", f"WITH {SPECTRA_SQL} SELECT pixel, row - 0 AS row, col - 2 AS col FROM hsi WHERE row >= 0 AND row < 10 AND col >= 2 AND col < 15")
def _(spark, d):
    return raster.cropped_by_place(spectra(spark, d), TRANSFORM, (4.5, 30.2), (70.0, 39.0))[0].select("pixel", "row", "col")


@query("f5_split_by_height", f"WITH {EVENTS_SQL} SELECT CASE WHEN z <= 5 THEN 'ground' ELSE 'other' END AS class, count(*) AS n, round(sum(intensity), 4) AS intensity FROM ev GROUP BY 1")
def _(spark, d):
    t = event_points(spark, d).withColumn("class", F.when(F.col("z") <= 5, "ground").otherwise("other"))
    return rounded(t.groupBy("class").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity")), 4)


@query("f6_split_by_returns", f"WITH {EVENTS_SQL} SELECT point_id, CASE WHEN num_returns > 1 THEN 'tree' WHEN z <= 5 THEN 'ground' ELSE 'other' END AS class FROM ev")
def _(spark, d):
    return segments.split_by_returns(event_points(spark, d), 5.0).select("point_id", "class")


@query("f7_steep_cells", f"WITH {PLACED_SQL}, w AS (SELECT *, min(z) OVER (PARTITION BY pixel) AS lo, max(z) OVER (PARTITION BY pixel) AS hi FROM pt) SELECT point_id, pixel, z FROM w WHERE hi - lo > 6.0 AND z - lo < 1.5")
def _(spark, d):
    return grid.low_points_of_steep_cells(placed(spark, d), 6.0, 1.5).select("point_id", "pixel", "z")


@query("f9_valid_heights", f"WITH {HEIGHTS_SQL} SELECT row, col, value FROM hz WHERE value > -1000")
def _(spark, d):
    return heights(spark, d).where(F.col("value") > F.lit(-1000.0)).select("row", "col", "value")


@query("f10_sized_clusters", f"WITH {EVENTS_SQL}, s AS (SELECT seg FROM ev WHERE seg >= 0 GROUP BY seg HAVING count(*) BETWEEN 5 AND 1735), n AS (SELECT seg, CAST(row_number() OVER (ORDER BY seg) - 1 AS INTEGER) AS k FROM s) SELECT point_id, coalesce(k, -1) AS label FROM ev LEFT JOIN n USING (seg)")
def _(spark, d):
    t = event_points(spark, d).drop("label").withColumnRenamed("seg", "label")
    return segments.sized_clusters(t, 5, 1735).select("point_id", "label")


# ---- neighbours


@query("j3_within_radius", f"WITH {EVENTS_SQL} SELECT a.point_id AS query_id, b.point_id AS nbr_id, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 6) AS d2 FROM ev a JOIN ev b ON abs(a.x - b.x) < 1 AND abs(a.y - b.y) < 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1")
def _(spark, d):
    t = event_points(spark, d)
    return rounded(knn.within_radius(t, t, 1.0))


@query("j4_nearest_within", f"WITH {EVENTS_SQL}, m AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM ev a JOIN ev b ON abs(a.x - b.x) < 1.5 AND abs(a.y - b.y) < 1.5), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, nbr_id) AS INTEGER) AS rank FROM m WHERE d2 < 2.25) SELECT query_id, rank, nbr_id, round(d2, 6) AS d2 FROM r WHERE rank <= 5")
def _(spark, d):
    t = event_points(spark, d)
    return rounded(knn.nearest_within(t, t, 1.5, 5))


@query("j1_k_nearest", f"WITH {EVENTS_SQL}, m AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM ev a, ev b), k AS (SELECT query_id, min({{'d2': d2, 'nbr_id': nbr_id}}, 10) AS best FROM m GROUP BY query_id), u AS (SELECT query_id, unnest(range(len(best))) AS i, unnest(best) AS s FROM k) SELECT query_id, CAST(i + 1 AS INTEGER) AS rank, s.nbr_id AS nbr_id, round(s.d2, 6) AS d2 FROM u")
def _(spark, d):
    t = event_points(spark, d)
    return rounded(knn.k_nearest(t, t, 10))


@query("j2_search", f"WITH {EVENTS_SQL}, q AS (SELECT CAST(pixel AS BIGINT) AS id, (pixel % 25) * 2.0 AS x, (pixel // 25) * 2.0 AS y, 5.0 AS z FROM range(750) t(pixel)), m AS (SELECT q.id AS query_id, b.point_id AS nbr_id, (q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y) + (q.z - b.z) * (q.z - b.z) AS d2 FROM q, ev b), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, nbr_id) AS INTEGER) AS rank FROM m) SELECT query_id, rank, nbr_id, round(d2, 6) AS d2 FROM r WHERE rank <= 3")
def _(spark, d):
    asked = spark.range(750).select(F.col("id").alias("point_id"), ((F.col("id") % 25) * 2.0).alias("x"), (F.floor(F.col("id") / 25) * 2.0).alias("y"), F.lit(5.0).alias("z"))
    return rounded(knn.search(asked, event_points(spark, d), k=3))


@query("j6_fused", f"WITH {EVENTS_SQL}, " + ", ".join(f"n{i} AS (SELECT a.point_id, min({{'d2': (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 'id': b.point_id, 'v': b.intensity}}) AS s FROM ev a JOIN ev b ON b.num_returns = {i} AND abs(a.x - b.x) < 1 AND abs(a.y - b.y) < 1 AND abs(a.z - b.z) < 1 GROUP BY a.point_id)" for i in (1, 2, 3)) + " SELECT ev.num_returns AS cloud, ev.point_id, n1.s.v AS value_1, n2.s.v AS value_2, n3.s.v AS value_3 FROM ev JOIN n1 USING (point_id) JOIN n2 USING (point_id) JOIN n3 USING (point_id) WHERE n1.s.d2 < 1 AND n2.s.d2 < 1 AND n3.s.d2 < 1")
def _(spark, d):
    t = event_points(spark, d)
    return knn.fused([t.where(F.col("num_returns") == i) for i in (1, 2, 3)]).select("cloud", "point_id", "value_1", "value_2", "value_3")


@query("f8_inliers", f"WITH {EVENTS_SQL}, m AS (SELECT a.point_id AS query_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM ev a, ev b), k AS (SELECT query_id AS point_id, list_avg(min(d, 10)) AS mean FROM m GROUP BY query_id) SELECT point_id FROM k WHERE mean < (SELECT avg(mean) + 2 * stddev_samp(mean) FROM k)")
def _(spark, d):
    return knn.inliers(event_points(spark, d), 10, 2.0)


@query("f8_inliers_50", f"WITH {EVENTS_SQL}, m AS (SELECT a.point_id AS query_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM ev a, ev b), k AS (SELECT query_id AS point_id, list_avg(min(d, 50)) AS mean FROM m GROUP BY query_id) SELECT point_id FROM k WHERE mean < (SELECT avg(mean) + 2 * stddev_samp(mean) FROM k)")
def _(spark, d):
    return knn.inliers(event_points(spark, d), 50, 2.0)


_NEAR = "m AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM ev a JOIN ev b ON abs(a.x - b.x) < 1.5 AND abs(a.y - b.y) < 1.5), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, nbr_id) AS rank FROM m WHERE d2 < 2.25), nn AS (SELECT * FROM r WHERE rank <= 5)"


@query("j15_neighbour_links", f"WITH {EVENTS_SQL}, {_NEAR} SELECT query_id AS a, nbr_id AS b FROM nn WHERE nbr_id > query_id")
def _(spark, d):
    t = event_points(spark, d)
    return knn.neighbour_links(knn.nearest_within(t, t, 1.5, 5))


@query("j16_boundaries", f"WITH {EVENTS_SQL}, {_NEAR} SELECT a.label, b.label AS nbr_label, count(DISTINCT a.point_id) AS n FROM nn JOIN ev a ON a.point_id = query_id JOIN ev b ON b.point_id = nbr_id WHERE a.label <> b.label GROUP BY ALL")
def _(spark, d):
    t = event_points(spark, d)
    near = knn.nearest_within(t, t, 1.5, 5)
    _, meets = segments.voxel_boundaries(t, near)
    own, other = t.select(F.col("point_id").alias("query_id"), "label"), t.select(F.col("point_id").alias("nbr_id"), F.col("label").alias("nbr_label"))
    return near.join(own, "query_id").join(other, "nbr_id").join(meets, ["label", "nbr_label"], "left_semi").groupBy("label", "nbr_label").agg(F.countDistinct("query_id").alias("n"))


@query("j16_boundary_points", f"WITH {EVENTS_SQL}, {_NEAR} SELECT DISTINCT query_id AS point_id FROM nn JOIN ev a ON a.point_id = query_id JOIN ev b ON b.point_id = nbr_id WHERE a.label <> b.label")
def _(spark, d):
    t = event_points(spark, d)
    return segments.voxel_boundaries(t, knn.nearest_within(t, t, 1.5, 5))[0]


@query("j7_selected_pixels", f"WITH {PLACED_SQL} SELECT l.pixel, point_id FROM (SELECT CAST(i % 40 AS BIGINT) AS pixel FROM range(60) t(i)) l JOIN pt USING (pixel)")
def _(spark, d):
    return grid.select_pixels(placed(spark, d), spark.range(60).select((F.col("id") % 40).alias("pixel"))).select("pixel", "point_id")


@query("j8_unshadowed_pixels", f"WITH {PLACED_SQL} SELECT DISTINCT pixel FROM pt WHERE pixel % 5 <> 0")
def _(spark, d):
    return grid.unshadowed_pixels(placed(spark, d), dark(spark))


@query("j10_spectra_of_points", f"WITH {PLACED_SQL}, {SPECTRA_SQL} SELECT point_id, round(bands[21], 6) AS r, round(bands[28], 6) AS g, round(bands[18], 6) AS b FROM pt JOIN hsi USING (pixel)")
def _(spark, d):
    bands = raster.bands_long(spectra(spark, d), [20, 27, 17])
    wide = bands.groupBy("pixel").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(n) for b, n in ((20, "r"), (27, "g"), (17, "b"))])
    return rounded(placed(spark, d).select("point_id", "pixel").join(wide, "pixel").select("point_id", "r", "g", "b"))


@query("j11_means_of_labels", f"WITH {EVENTS_SQL}, m AS (SELECT label, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM ev GROUP BY label) SELECT point_id, {R('m.r', 'm.g', 'm.b')} FROM ev JOIN m USING (label)")
def _(spark, d):
    t = event_points(spark, d)
    means = t.groupBy("label").agg(*[F.avg(c).alias(c) for c in "rgb"])
    return rounded(t.select("point_id", "label").join(means, "label").select("point_id", "r", "g", "b"))


@query("j12_held_in_boxes", f"WITH {PLACED_SQL}, bx AS (SELECT label, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM pt WHERE num_returns = 1 GROUP BY label), sg AS (SELECT pixel AS label, (min(x) + max(x)) * 0.5 AS cx, (min(y) + max(y)) * 0.5 AS cy FROM pt GROUP BY pixel) SELECT DISTINCT sg.label FROM sg JOIN bx ON cx > x1 - 0.5 AND cx < x2 + 0.5 AND cy > y1 - 0.5 AND cy < y2 + 0.5")
def _(spark, d):
    t = placed(spark, d)
    boxes = grid.bounding_box(t.where("num_returns = 1"), ["label"])
    return segments.held_in_boxes(grid.bounding_box(t, ["pixel"]).withColumnRenamed("pixel", "label"), boxes)


@query("j14_spectral_links", f"WITH {SPECTRA_SQL}, n AS (SELECT pixel, row, col, bands, sqrt(list_sum([v * v FOR v IN bands])) AS len FROM hsi), u AS (SELECT pixel, row, col, [v / len FOR v IN bands] AS u FROM n) SELECT a.pixel AS a, b.pixel AS b, round(acos(greatest(least(list_inner_product(a.u, b.u), 1.0), -1.0)), 4) AS w FROM u a JOIN u b ON (b.row - a.row, b.col - a.col) IN ((0, 1), (1, 0), (1, 1), (-1, 1))")
def _(spark, d):
    return raster.spectral_links(spectra(spark, d)).select("a", "b", F.round(F.col("w").cast("double"), 4).alias("w"))


# ---- aggregations


@query("a1_bounding_boxes", f"WITH {EVENTS_SQL} SELECT label, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM ev GROUP BY label")
def _(spark, d):
    return grid.bounding_box(event_points(spark, d), ["label"])


@query("a2_bounding_box", f"WITH {BULK_SQL} SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM li")
def _(spark, d):
    return grid.bounding_box(bulk_points(spark, d))


@query("a3_weighted_centroids", f"WITH {EVENTS_SQL} SELECT label, round(sum(intensity * x) / sum(intensity), 6) AS x, round(sum(intensity * y) / sum(intensity), 6) AS y, round(sum(intensity * z) / sum(intensity), 6) AS z FROM ev GROUP BY label")
def _(spark, d):
    return rounded(grid.weighted_centroid(event_points(spark, d), F.col("intensity"), ["label"]))


@query("a4_dsm", f"WITH {BULK_SQL}, g AS (SELECT min(x) AS x0, max(y) AS y0, CAST(trunc((max(x) - min(x)) / 4.0) AS INTEGER) AS w, CAST(trunc((max(y) - min(y)) / 4.0) AS INTEGER) AS h FROM li), p AS (SELECT CAST(greatest(least(CAST(trunc((y - y0) / -4.0) AS INTEGER), h - 1), 0) AS BIGINT) * w + greatest(least(CAST(trunc((x - x0) / 4.0) AS INTEGER), w - 1), 0) AS pixel, z FROM li, g) SELECT pixel, max(z) AS z, count(*) AS n FROM p GROUP BY pixel")
def _(spark, d):
    t = bulk_points(spark, d)
    return grid.surface_model(t, grid.grid_of(t, 4.0), no_data=None)


@query("a4_dsm_dense", f"WITH {PLACED_SQL}, {RASTER_SQL} SELECT px.pixel, greatest(coalesce(max(z), -1000.0), -1000.0) AS z, count(point_id) AS n FROM px LEFT JOIN pt USING (pixel) GROUP BY px.pixel")
def _(spark, d):
    return grid.surface_model(event_points(spark, d), GRID)


@query("a5_points_in_grid", f"WITH {PLACED_SQL} SELECT pixel, array_to_string(list_sort(list(point_id)), ',') AS point_ids FROM pt GROUP BY pixel")
def _(spark, d):
    return grid.points_in_grid(event_points(spark, d), GRID).select("pixel", F.array_join(F.col("point_ids").cast("array<string>"), ",").alias("point_ids"))


@query("a7_mean_images", f"WITH {PLACED_SQL}, {RASTER_SQL} SELECT px.pixel, round(coalesce(avg(intensity), 0), 6) AS intensity, round(coalesce(avg(z), 0), 6) AS z FROM px LEFT JOIN pt USING (pixel) GROUP BY px.pixel")
def _(spark, d):
    return rounded(grid.mean_images(event_points(spark, d), GRID, ["intensity", "z"]))


@query("a8_incidence", f"WITH {PLACED_SQL}, n AS (SELECT pixel, row_number() OVER (ORDER BY pixel) - 1 AS row FROM (SELECT DISTINCT pixel FROM pt WHERE pixel % 5 <> 0)) SELECT row, point_id AS col, 1.0::DOUBLE AS v FROM pt JOIN n USING (pixel)")
def _(spark, d):
    return grid.incidence(placed(spark, d), dark(spark))


@query("a9_lit_normals", f"WITH {PLACED_SQL} SELECT pixel, label, round(sum(({LIGHT[0]} * nx + {LIGHT[1]} * ny + {LIGHT[2]!r} * nz) * nz), 6) AS v FROM pt WHERE pixel % 5 <> 0 GROUP BY ALL")
def _(spark, d):
    return rounded(grid.lit_normals(placed(spark, d), dark(spark), LIGHT))


@query("a10_normal_image", f"WITH {PLACED_SQL}, {RASTER_SQL} SELECT px.pixel, round(coalesce(sum(nx * nz) / sum(nz), -1), 6) AS nx, round(coalesce(sum(ny * nz) / sum(nz), -1), 6) AS ny, round(coalesce(sum(nz * nz) / sum(nz), -1), 6) AS nz FROM px LEFT JOIN pt USING (pixel) GROUP BY px.pixel")
def _(spark, d):
    return rounded(grid.normal_image(event_points(spark, d), GRID))


@query("a11_supervoxel_moments", f"WITH {EVENTS_SQL} SELECT label, count(*) AS size, min(x) AS min_x, max(z) AS max_z, {R('avg(x)').replace('avg(x)', 'x').replace('round(x', 'round(avg(x)')}, round(avg(r), 6) AS r, round(covar_pop(x, x), 5) AS c_xx, round(covar_pop(x, y), 5) AS c_xy, round(covar_pop(z, z), 5) AS c_zz FROM ev GROUP BY label")
def _(spark, d):
    t = segments.moment_table(event_points(spark, d), ("r", "g", "b"))
    return t.select("label", "size", "min_x", "max_z", F.round("x", 6).alias("x"), F.round("r", 6).alias("r"), *[F.round(c, 5).alias(c) for c in ("c_xx", "c_xy", "c_zz")])


# The least eigenvalue of a symmetric matrix (xx .. zz) by the cosine form of the cubic, its vector as the longest cross product of two rows.
_EIGEN = """e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM mo),
e2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
e3 AS (SELECT *, greatest(least(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p), 1.0), -1.0) AS co FROM e2),
e4 AS (SELECT *, q + 2 * p * cos(acos(co) / 3 + 2 * pi() / 3) AS l FROM e3),
e5 AS (SELECT *, [xy * yz - xz * (yy - l), xz * xy - (xx - l) * yz, (xx - l) * (yy - l) - xy * xy] AS u, [xy * (zz - l) - xz * yz, xz * xz - (xx - l) * (zz - l), (xx - l) * yz - xy * xz] AS v, [(yy - l) * (zz - l) - yz * yz, yz * xz - xy * (zz - l), xy * yz - (yy - l) * xz] AS w FROM e4),
e6 AS (SELECT *, CASE WHEN list_inner_product(u, u) >= list_inner_product(v, v) AND list_inner_product(u, u) >= list_inner_product(w, w) THEN u WHEN list_inner_product(v, v) >= list_inner_product(w, w) THEN v ELSE w END AS d FROM e5),
e7 AS (SELECT *, CASE WHEN d[3] < 0 THEN -1 ELSE 1 END / sqrt(list_inner_product(d, d)) AS t FROM e6)"""
_SIDES = ", ".join(f"round({f}({c}), 4) AS {f}_{c}" for f in ("min", "max") for c in "xyz")
_MOMENTS = "covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz"


@query("a12_principal_normals", f"WITH {EVENTS_SQL}, mo AS (SELECT label, count(*) AS size, {_SIDES}, {', '.join(f'round(avg({c}), 4) AS m_{c}' for c in 'xyzrgb')}, {_MOMENTS} FROM ev GROUP BY label), {_EIGEN} SELECT label, size, min_x, min_y, min_z, max_x, max_y, max_z, {', '.join(f'm_{c} AS {c}' for c in 'xyzrgb')}, round(d[1] * t, 4) AS nx, round(d[2] * t, 4) AS ny, round(d[3] * t, 4) AS nz, round(greatest(l, 0) / (xx + yy + zz), 4) AS curvature FROM e7")
def _(spark, d):
    return rounded(segments.supervoxels(event_points(spark, d), ("r", "g", "b")), 4)


@query("a13_majority", f"WITH {EVENTS_SQL}, c AS (SELECT label, seg, count(*) AS n FROM ev WHERE seg <> -1 GROUP BY ALL), w AS (SELECT label, seg, row_number() OVER (PARTITION BY label ORDER BY n DESC, seg) AS k FROM c) SELECT l.label, coalesce(seg, -1) AS seg FROM (SELECT DISTINCT label FROM ev) l LEFT JOIN w ON w.label = l.label AND k = 1")
def _(spark, d):
    return segments.majority(event_points(spark, d), "label", "seg")


_STRETCH = """l AS (SELECT pixel, unnest([20, 27, 17]) AS band, unnest([bands[21], bands[28], bands[18]]) AS value FROM hsi),
e AS (SELECT band, min(value) AS lo, max(value) AS hi, count(*) AS n FROM l GROUP BY band),
y AS (SELECT pixel, l.band, n, (value - lo) * 255 / (hi - lo) AS byte, CAST(round_even((value - lo) * 255 / (hi - lo), 0) AS INTEGER) AS bin FROM l JOIN e ON l.band = e.band),
h AS (SELECT e.band, b.bin, e.n, coalesce(c, 0) AS c FROM e CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(256)) b LEFT JOIN (SELECT band, bin, count(*) AS c FROM y GROUP BY ALL) k ON k.band = e.band AND k.bin = b.bin),
s AS (SELECT band, bin, sum(c) OVER (PARTITION BY band ORDER BY bin) / n AS share FROM h),
g AS (SELECT band, min({'a': abs(share - 0.02), 'b': bin}).b AS f, min({'a': abs(share - 0.98), 'b': bin}).b AS t FROM s GROUP BY band)"""


@query("a14_stretched", f"WITH {SPECTRA_SQL}, {_STRETCH} SELECT pixel, CAST(y.band AS INTEGER) AS band, round(greatest(least((byte - f) / (t - f), 1.0), 0.0), 6) AS stretched FROM y JOIN g ON g.band = y.band")
def _(spark, d):
    return rounded(raster.stretched(raster.bands_long(spectra(spark, d), [20, 27, 17])).select("pixel", "band", "stretched"))


@query("a15_stretched_bytes", f"WITH {SPECTRA_SQL}, {_STRETCH} SELECT pixel, CAST(y.band AS INTEGER) AS band, round(greatest(least((bin - f) / (t - f), 1.0), 0.0), 6) AS stretched FROM y JOIN g ON g.band = y.band")
def _(spark, d):
    return rounded(raster.stretched(raster.bands_long(spectra(spark, d), [20, 27, 17]), quantised=True).select("pixel", "band", "stretched"))


@query("a15_min_max_bytes", f"WITH {SPECTRA_SQL}, {_STRETCH} SELECT pixel, CAST(band AS INTEGER) AS band, bin AS byte FROM y")
def _(spark, d):
    return raster.min_max_bytes(raster.bands_long(spectra(spark, d), [20, 27, 17])).select("pixel", "band", "byte")


@query("a16_dense_labels", f"WITH {EVENTS_SQL} SELECT point_id, CAST(dense_rank() OVER (ORDER BY num_returns * 100 + label * 7) - 1 AS INTEGER) AS label FROM ev")
def _(spark, d):
    t = event_points(spark, d).select("point_id", (F.col("num_returns") * 100 + F.col("label") * 7).alias("v"))
    return segments.dense_labels(t, "v").select("point_id", "label")


@query("a17_largest", f"WITH {EVENTS_SQL} SELECT label, count(*) AS n FROM ev GROUP BY label ORDER BY n DESC, label LIMIT 1")
def _(spark, d):
    return segments.largest(event_points(spark, d))


@query("a18_multi_return", f"WITH {EVENTS_SQL} SELECT label, count(*) AS n, round(avg(CASE WHEN num_returns > 1 THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN num_returns > 1 THEN 1 ELSE 0 END) < 0.66 AS is_building FROM ev GROUP BY label")
def _(spark, d):
    return rounded(segments.multi_return_labels(event_points(spark, d), 0.66))


@query("a19_filled_shadows", f"WITH {SPECTRA_SQL}, t AS (SELECT *, list_sum(bands) / len(bands) AS br FROM hsi), l AS (SELECT pixel, label, br, {_LONG} FROM t), m AS (SELECT label, band, avg(value) AS v FROM l WHERE br > 0.5 GROUP BY ALL) SELECT pixel, CAST(l.band AS INTEGER) AS band, round(CASE WHEN br < 0.5 AND v IS NOT NULL THEN v ELSE value END, 6) AS value FROM l LEFT JOIN m ON m.label = l.label AND m.band = l.band")
def _(spark, d):
    t = spectra(spark, d).withColumn("brightness", fn.array_sum(F.col("bands")) / F.size("bands"))
    return rounded(raster.bands_long(raster.filled_shadows(t, F.col("brightness"), 0.5)).select("pixel", "band", "value"))


@query("a20_light_samples", f"WITH {PLACED_SQL}, {SPECTRA_SQL}, n AS (SELECT pixel, sum(nx * nz) / sum(nz) AS nx, sum(ny * nz) / sum(nz) AS ny, sum(nz * nz) / sum(nz) AS nz FROM pt GROUP BY pixel), g AS (SELECT label FROM pt GROUP BY label HAVING count(*) > 50), c AS (SELECT DISTINCT label, pixel FROM pt JOIN g USING (label)) SELECT c.label, count(*) AS n, round(sum(n.nx * list_sum(bands) / len(bands)), 5) AS sx, round(sum(n.nz * n.nz), 5) AS szz FROM c JOIN n USING (pixel) JOIN (SELECT pixel, bands FROM hsi) h USING (pixel) GROUP BY c.label")
def _(spark, d):
    t = placed(spark, d)
    s = light.light_samples(t, grid.normal_image(t, GRID), spectra(spark, d), least_points=50)
    return rounded(s.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("nx") * F.col("brightness")).alias("sx"), F.sum(F.col("nz") * F.col("nz")).alias("szz")), 5)


_LIGHT_SQL = f"""{PLACED_SQL}, {SPECTRA_SQL}, n AS (SELECT pixel, sum(nx * nz) / sum(nz) AS nx, sum(ny * nz) / sum(nz) AS ny, sum(nz * nz) / sum(nz) AS nz FROM pt GROUP BY pixel),
g AS (SELECT label FROM pt GROUP BY label HAVING count(*) > 50), c AS (SELECT DISTINCT label, pixel FROM pt JOIN g USING (label)),
sa AS (SELECT c.label, n.nx AS x, n.ny AS y, n.nz AS z, list_sum(bands) / len(bands) AS b FROM c JOIN n USING (pixel) JOIN (SELECT pixel, bands FROM hsi) h USING (pixel)),
no AS (SELECT label, sum(x * x) AS a11, sum(x * y) AS a12, sum(x * z) AS a13, sum(y * y) AS a22, sum(y * z) AS a23, sum(z * z) AS a33, sum(x * b) AS b1, sum(y * b) AS b2, sum(z * b) AS b3 FROM sa GROUP BY label),
iv AS (SELECT label, (a22 * a33 - a23 * a23) * b1 + (a13 * a23 - a12 * a33) * b2 + (a12 * a23 - a13 * a22) * b3 AS u, (a13 * a23 - a12 * a33) * b1 + (a11 * a33 - a13 * a13) * b2 + (a12 * a13 - a11 * a23) * b3 AS v,
  (a12 * a23 - a13 * a22) * b1 + (a12 * a13 - a11 * a23) * b2 + (a11 * a22 - a12 * a12) * b3 AS w, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM no),
un AS (SELECT sign(det) * u / sqrt(u * u + v * v + w * w) AS lx, sign(det) * v / sqrt(u * u + v * v + w * w) AS ly, sign(det) * w / sqrt(u * u + v * v + w * w) AS lz FROM iv)
SELECT """ + ", ".join(f"round(CASE WHEN sum(l{c}) < 0 THEN -1 ELSE 1 END * sqrt(avg(l{c} * l{c})), 4) AS l{c}" for c in "xyz") + " FROM un"


@query("a20_light", f"WITH {_LIGHT_SQL}")
def _(spark, d):
    t = placed(spark, d)
    return rounded(light.combined_light(light.light_directions(light.light_samples(t, grid.normal_image(t, GRID), spectra(spark, d), least_points=50))), 4)


@query("a22_nearest_spread", f"WITH {EVENTS_SQL}, {_NEAR}, l AS (SELECT query_id, min(d2) AS d FROM nn WHERE query_id <> nbr_id GROUP BY query_id), o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM l) SELECT round(d, 6) AS spread FROM o WHERE k = n // 2")
def _(spark, d):
    t = event_points(spark, d)
    return rounded(segments.nearest_spread(knn.nearest_within(t, t, 1.5, 5), F.col("d2")))


@query("a23_octree_leaves", f"WITH {EVENTS_SQL}, bx AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM ev), dp AS (SELECT *, CAST(greatest(ceil(log2(e * 1.01 / (4.0 * 4 / 3))), 0) AS INTEGER) AS depth FROM bx), sz AS (SELECT *, e * 1.01 / pow(2, depth) AS s FROM dp) SELECT min(depth) AS depth, count(DISTINCT (CAST(floor((x - least(x1, (x1 + x2) / 2 - e / 2)) / s) AS BIGINT), CAST(floor((y - least(y1, (y1 + y2) / 2 - e / 2)) / s) AS BIGINT), CAST(floor((z - least(z1, (z1 + z2) / 2 - e / 2)) / s) AS BIGINT))) AS leaves FROM ev, sz")
def _(spark, d):
    return grid.octree_leaves(event_points(spark, d), 4.0)


@query("a24_label_count", f"WITH {EVENTS_SQL} SELECT count(DISTINCT label) AS n FROM ev")
def _(spark, d):
    return event_points(spark, d).agg(F.countDistinct("label").alias("n"))


# ---- rasters


# The Sobel kernels over 8 along columns and along rows, as the definitions state them, and turned by half a circle.
_KX = ((0.125, 0.0, -0.125), (0.25, 0.0, -0.25), (0.125, 0.0, -0.125))
_KY = ((0.125, 0.25, 0.125), (0.0, 0.0, 0.0), (-0.125, -0.25, -0.125))
_KX_TURNED = ((-0.125, 0.0, 0.125), (-0.25, 0.0, 0.25), (-0.125, 0.0, 0.125))
_KY_TURNED = ((-0.125, -0.25, -0.125), (0.0, 0.0, 0.0), (0.125, 0.25, 0.125))


def _stencil(kernel, out: str) -> str:
    taps = " + ".join(f"{kernel[u][v]!r} * max(CASE WHEN dr = {1 - u} AND dc = {1 - v} THEN n.value END)" for u in range(3) for v in range(3))
    return f"{taps} AS {out}"


_AROUND = f"""st AS (SELECT a.range - 1 AS dr, b.range - 1 AS dc FROM range(3) a, range(3) b),
ne AS (SELECT h.row, h.col, dr, dc, least(greatest(h.row + dr, 0), {GRID.height - 1}) AS r2, least(greatest(h.col + dc, 0), {GRID.width - 1}) AS c2 FROM hz h, st)"""


@query("w1_convolved", f"WITH {HEIGHTS_SQL}, {_AROUND} SELECT ne.row, ne.col, round({_stencil(_KX, 'out').replace(' AS out', '')}, 6) AS out FROM ne JOIN hz n ON n.row = r2 AND n.col = c2 GROUP BY ne.row, ne.col")
def _(spark, d):
    return rounded(raster.convolved(heights(spark, d), fn.SOBEL_X).select("row", "col", "out"))


@query("w2_surface_normals", f"WITH {HEIGHTS_SQL}, {_AROUND}, s AS (SELECT ne.row, ne.col, {_stencil(_KY_TURNED, 'n1')}, {_stencil(_KX_TURNED, 'n2')} FROM ne JOIN hz n ON n.row = r2 AND n.col = c2 GROUP BY ne.row, ne.col), t AS (SELECT *, 1 / sqrt(n1 * n1 + n2 * n2 + 1) AS n3 FROM s) SELECT row, col, round(n1, 4) AS n1, round(n2, 4) AS n2, round(n2 * n3, 4) AS nx, round(n1 * n3, 4) AS ny, round(n3, 4) AS nz FROM t")
def _(spark, d):
    return rounded(raster.surface_normals(heights(spark, d)).select("row", "col", "n1", "n2", "nx", "ny", "nz"), 4)


@query("w3_valid_in_window", f"WITH {HEIGHTS_SQL}, st AS (SELECT a.range - 2 AS dr, b.range - 2 AS dc FROM range(5) a, range(5) b), ne AS (SELECT h.row, h.col, least(greatest(h.row + dr, 0), {GRID.height - 1}) AS r2, least(greatest(h.col + dc, 0), {GRID.width - 1}) AS c2 FROM hz h, st) SELECT ne.row, ne.col, count(*) FILTER (n.value > 4) AS n_valid FROM ne JOIN hz n ON n.row = r2 AND n.col = c2 GROUP BY ne.row, ne.col")
def _(spark, d):
    return raster.valid_in_window(heights(spark, d), F.col("value") > 4).select("row", "col", "n_valid")


# hue 0..180, saturation 191 and brightness, bytes, to blue, green and red
_COLOUR = """k AS (SELECT row, col, hue / 30.0 - floor(hue / 30.0) AS f, CAST(floor(hue / 30.0) AS INTEGER) AS sector, v / 255.0 AS v, 191.0 / 255.0 AS s FROM hv),
t AS (SELECT row, col, sector, v, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS u FROM k)
SELECT row, col, CAST(round_even(255 * CASE sector WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN u WHEN 3 THEN v WHEN 4 THEN v ELSE q END, 0) AS INTEGER) AS b,
  CAST(round_even(255 * CASE sector WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END, 0) AS INTEGER) AS g,
  CAST(round_even(255 * CASE sector WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN u ELSE v END, 0) AS INTEGER) AS r FROM t"""
_SLOPES = f"ne2 AS (SELECT h.row, h.col, dr, dc, least(greatest(h.row + dr, 0), {GRID.height - 1}) AS r2, least(greatest(h.col + dc, 0), {GRID.width - 1}) AS c2 FROM zz h, (SELECT a.range - 1 AS dr, b.range - 1 AS dc FROM range(3) a, range(3) b)), sl AS (SELECT ne2.row, ne2.col, {_stencil(_KX, 'n1')}, {_stencil(_KY, 'n2')} FROM ne2 JOIN zz n ON n.row = r2 AND n.col = c2 GROUP BY ne2.row, ne2.col), nn AS (SELECT zz.*, 1 / sqrt(n1 * n1 + n2 * n2 + 1) AS n3 FROM sl JOIN zz USING (row, col))"


@query("w4_hillshade", f"WITH {HEIGHTS_SQL}, zz AS (SELECT row, col, CASE WHEN value > -999 THEN value ELSE 0.0 END AS value FROM hz), {_SLOPES}, hv AS (SELECT row, col, round_even((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 0.75 * 180, 0) AS hue, round_even(((n3 - min(n3) OVER ()) / (max(n3) OVER () - min(n3) OVER ()) * 0.75 + 0.25) * 255, 0) AS v FROM nn), {_COLOUR}")
def _(spark, d):
    return raster.hillshade(heights(spark, d), valid_min=-999.0)


@query("w5_masked_shade", f"WITH {HEIGHTS_SQL}, zz AS (SELECT row, col, value, value > -999 AS inside FROM hz), {_SLOPES}, en AS (SELECT min(value) FILTER (inside) AS lo, max(value) FILTER (inside) AS hi, min(n3) AS na, max(n3) AS nb FROM nn), hv AS (SELECT row, col, CASE WHEN inside THEN floor((value - lo) / (hi - lo) * 0.75 * 180) ELSE 0.0 END AS hue, floor(((n3 - na) / (nb - na) * 0.75 + 0.25) * 255) AS v FROM nn, en), {_COLOUR}")
def _(spark, d):
    return raster.masked_shade(heights(spark, d), F.col("value") > -999.0)


@query("w8_contour_mask")
def _(spark, d):
    return segmentation.contour_mask(spectra(spark, d))


@query("w9_superpixel_borders", f"WITH {SPECTRA_SQL}, z AS (SELECT max(row) AS h, max(col) AS w FROM hsi), ne AS (SELECT pixel, label, least(greatest(row + dr, 0), h) AS r2, least(greatest(col + dc, 0), w) AS c2 FROM hsi, z, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) s(dr, dc)) SELECT ne.pixel, count(*) FILTER (n.label <> ne.label) AS n FROM ne JOIN hsi n ON n.row = r2 AND n.col = c2 GROUP BY ne.pixel HAVING count(*) FILTER (n.label <> ne.label) > 1")
def _(spark, d):
    return raster.superpixel_borders(spectra(spark, d))


# ---- order, sets, shadows, segmentation


@query("o1_sorted", f"WITH {EVENTS_SQL} SELECT point_id, row_number() OVER (ORDER BY y, x, point_id) - 1 AS place FROM ev")
def _(spark, d):
    return ranked(event_points(spark, d).select("point_id", "y", "x"), ["y", "x", "point_id"]).select("point_id", "place")


@query("u1_united", f"WITH {EVENTS_SQL} SELECT point_id, x, y, z FROM ev UNION ALL SELECT point_id, x, y, z FROM ev")
def _(spark, d):
    t = event_points(spark, d)
    return segments.united(t.select("point_id", "x", "y", "z", "r"), t.select("point_id", "x", "y", "z", "nz"))


@query("u2_offset_labels", f"WITH {EVENTS_SQL} SELECT point_id, label FROM ev WHERE num_returns = 1 UNION ALL SELECT point_id, CAST(label + (SELECT max(label) + 1 FROM ev WHERE num_returns = 1) AS INTEGER) FROM ev WHERE num_returns = 2 UNION ALL SELECT point_id, CAST(label + (SELECT max(label) + 1 FROM ev WHERE num_returns = 1) + (SELECT max(label) + 1 FROM ev WHERE num_returns = 2) AS INTEGER) FROM ev WHERE num_returns = 3")
def _(spark, d):
    t = event_points(spark, d).select("point_id", "label", "num_returns")
    return segments.offset_labels([t.where(F.col("num_returns") == i) for i in (1, 2, 3)]).select("point_id", "label")


@query("g1_graph_segments")
def _(spark, d):
    t = event_points(spark, d)
    links = knn.neighbour_links(knn.k_nearest(t, t, 10))
    own = t.select(F.col("point_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "rgb"])
    other = t.select(F.col("point_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "rgb"])
    weight = fn.squared_distance([F.col(f"a{c}") for c in "rgb"], [F.col(f"b{c}") for c in "rgb"])
    weighed = links.join(own, "a").join(other, "b").select("a", "b", weight.cast("float").alias("w"))
    return segmentation.graph_segments(t.select(F.col("point_id").alias("node")), weighed, 0.6, 50)


@query("g4_superpixels")
def _(spark, d):
    t = spectra(spark, d)
    return segmentation.graph_segments(t.select(F.col("pixel").alias("node")), raster.spectral_links(t), 0.06, 5)


@query("g9_region_growing")
def _(spark, d):
    t = event_points(spark, d)
    near = knn.k_nearest(t, t, 10)
    return segmentation.region_growing(segments.point_normals(t, neighbours=near), near)


_MOVED = f"SELECT point_id, pixel, label, x AS x_at, y AS y_at, x - z / {LIGHT[2]!r} * {LIGHT[0]} AS x, y - z / {LIGHT[2]!r} * {LIGHT[1]} AS y, z / {LIGHT[2]!r} AS z FROM pt"


@query("g12_occluded", f"WITH {PLACED_SQL}, mv AS ({_MOVED}), bx AS (SELECT pixel AS point_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM mv GROUP BY pixel), {_BRUTE.format('bx', 50)} SELECT point_id FROM pt WHERE pixel IN (SELECT a.point_id FROM nb JOIN bx a ON a.point_id = query_id JOIN bx b ON b.point_id = nbr_id WHERE a.x >= b.x1 - 0.5 AND a.x <= b.x2 + 0.5 AND a.y >= b.y1 - 0.5 AND a.y <= b.y2 + 0.5 AND a.z2 <= b.z1 - 0.5)")
def _(spark, d):
    return segments.occluded(placed(spark, d).withColumn("label", F.col("pixel")), LIGHT, 0.5, 0.5)


@query("l1_inpainted")
def _(spark, d):
    return rounded(inpainting.inpainted(heights(spark, d), 1.0, 1.0, -1000.0), 4)


@query("l9_point_normals", f"WITH {EVENTS_SQL}, {_BRUTE.format('ev', 10)}, mo AS (SELECT query_id AS point_id, {_MOMENTS} FROM nb JOIN ev ON ev.point_id = nbr_id GROUP BY query_id), {_EIGEN} SELECT point_id, round(d[1] * t, 4) AS nx, round(d[2] * t, 4) AS ny, round(d[3] * t, 4) AS nz, round(greatest(l, 0) / (xx + yy + zz), 4) AS curvature FROM e7")
def _(spark, d):
    return rounded(segments.point_normals(event_points(spark, d), 10), 4)


@query("c13_shadow_cells", f"WITH {PLACED_SQL}, mv AS ({_MOVED}), fg AS (SELECT min(x) AS x0, max(y) AS y0, CAST(trunc((max(x) - min(x)) / 2.0) AS INTEGER) AS w, CAST(trunc((max(y) - min(y)) / 2.0) AS INTEGER) AS h FROM mv), ce AS (SELECT point_id, pixel, z, CAST(greatest(least(CAST(trunc((y - y0) / -2.0) AS INTEGER), h - 1), 0) AS BIGINT) * w + greatest(least(CAST(trunc((x - x0) / 2.0) AS INTEGER), w - 1), 0) AS cell FROM mv, fg), sp AS (SELECT *, min(z) OVER (PARTITION BY cell) AS lo, max(z) OVER (PARTITION BY cell) AS hi FROM ce) SELECT DISTINCT pixel FROM sp WHERE hi - lo > 6.0 AND z - lo < 1.5")
def _(spark, d):
    return grid.shadow_cells(event_points(spark, d), LIGHT, 2.0, GRID, 6.0, 1.5)


# ---- composites


def with_class(spark, d):
    t = event_points(spark, d)
    return segments.split_by_returns(t, 5.0)


@query("g6_fusion_supervoxels")
def _(spark, d):
    t = event_points(spark, d)
    return segmentation.nearest_fusion(t, 10, 40)


@query("g11_merged_classes")
def _(spark, d):
    t = placed(spark, d)
    return merging.merged_classes(t.drop("label").withColumnRenamed("seg", "label").withColumn("voxel", F.col("pixel")), 1.0)


@query("g14_clustered_superpixels")
def _(spark, d):
    t = raster.scaled_cube(spectra(spark, d), 1e-4, keep_unit_max=True)
    size = t.agg(F.max("row") + 1, F.max("col") + 1).first()
    found = clustering.superpixels(t, size[0], size[1], 5, 0.1, 3, 64)
    return clustering.connected_superpixels(found.join(t.select("pixel", "bands"), "pixel"), 5, size[0], size[1], 5, 0.1, 64)


_HUE = lambda i, red: f"round(CASE WHEN seg = -1 THEN {red} ELSE CAST('0x' || substr(md5(seg || ':{i}'), 1, 2) AS INTEGER) / 255.0 END, 6)"


@query("g20_hashed_colours", f"WITH {EVENTS_SQL} SELECT point_id, seg AS label, {_HUE(0, 1.0)} AS r, {_HUE(1, 0.0)} AS g, {_HUE(2, 0.0)} AS b FROM ev")
def _(spark, d):
    return rounded(segmentation.hashed_colours(event_points(spark, d).select("point_id", F.col("seg").alias("label"))))


@query("w6_normal_colours", f"WITH {EVENTS_SQL}, gr AS (SELECT point_id, nz, nx, ny, nz - 0.25 * (nx + ny) AS g FROM ev), cl AS (SELECT point_id, nz, least(greatest(ny + g, 0), 1) AS r, least(greatest(g, 0), 1) AS g, least(greatest(nx + g, 0), 1) AS b FROM gr) SELECT point_id, round(CASE WHEN greatest(r, g, b) > 0 THEN r / greatest(r, g, b) ELSE 1 END * nz, 6) AS r, round(CASE WHEN greatest(r, g, b) > 0 THEN g / greatest(r, g, b) ELSE 1 END * nz, 6) AS g, round(CASE WHEN greatest(r, g, b) > 0 THEN b / greatest(r, g, b) ELSE 1 END * nz, 6) AS b FROM cl")
def _(spark, d):
    return rounded(event_points(spark, d).select("point_id", *fn.normal_colours(F.col("nx"), F.col("ny"), F.col("nz"))))


@query("w7_border_normals", f"""WITH {HEIGHTS_SQL}, mk AS (SELECT row, col, value > 2 AS inside FROM hz),
bo AS (SELECT DISTINCT a.row, a.col FROM mk a JOIN mk b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 WHERE a.inside AND NOT b.inside AND a.row BETWEEN 5 AND {GRID.height - 1 - 5} AND a.col BETWEEN 5 AND {GRID.width - 1 - 5}),
me AS (SELECT bo.row, bo.col, -avg((m.row - bo.row) * exp(-5.0 * ((m.row - bo.row) * (m.row - bo.row) + (m.col - bo.col) * (m.col - bo.col)) / 25)) AS y, -avg((m.col - bo.col) * exp(-5.0 * ((m.row - bo.row) * (m.row - bo.row) + (m.col - bo.col) * (m.col - bo.col)) / 25)) AS x FROM bo JOIN mk m ON m.inside AND abs(m.row - bo.row) <= 5 AND abs(m.col - bo.col) <= 5 GROUP BY ALL)
SELECT CAST(row * {GRID.width} + col AS BIGINT) AS pixel, row, col, round(y / sqrt(x * x + y * y), 6) AS ny, round(x / sqrt(x * x + y * y), 6) AS nx, round(-x / sqrt(x * x + y * y), 6) AS ty, round(y / sqrt(x * x + y * y), 6) AS tx FROM me""")
def _(spark, d):
    mask = heights(spark, d).select("row", "col", (F.col("value") > 2).alias("inside"))
    return rounded(pipelines.border_normals(mask))


@query("c2_surface")
def _(spark, d):
    return rounded(pipelines.surface(event_points(spark, d), GRID), 4)


@query("c3_intensity_image")
def _(spark, d):
    return rounded(pipelines.intensity_image(event_points(spark, d), GRID), 4)


@query("c4_normals_image")
def _(spark, d):
    return rounded(pipelines.normals_image(event_points(spark, d), GRID), 4)


@query("c5_graph_supervoxels")
def _(spark, d):
    return pipelines.graph_supervoxels(event_points(spark, d), 0.6, 20, radius=3.0).select("point_id", "label")


@query("c6_buildings_and_trees")
def _(spark, d):
    return pipelines.buildings_and_trees(event_points(spark, d), 5.0, 0.6, 20, 0.66)


@query("c7_surface_superpixels")
def _(spark, d):
    return pipelines.surface_superpixels(event_points(spark, d), GRID, 0.3, 5)


@query("c9_light_direction", f"WITH {_LIGHT_SQL}")
def _(spark, d):
    return rounded(pipelines.light_direction(event_points(spark, d), spectra(spark, d), GRID, 50), 4)


@query("c10_class_supervoxels")
def _(spark, d):
    return pipelines.class_supervoxels(with_class(spark, d), [("ground", 4.0, 0.6, 5), ("tree", 4.0, 0.6, 5), ("other", 4.0, 0.6, 5)]).select("point_id", "class", "label")


@query("c10_class_supervoxels_within")
def _(spark, d):
    parts = [("ground", 4.0, 0.6, 5, 4.0), ("other", 4.0, 0.6, 5, 4.0), ("tree", 4.0, 0.6, 5, 4.0)]
    return pipelines.class_supervoxels(with_class(spark, d), parts, heights={"other": pipelines.identity, "tree": pipelines.identity}).select("point_id", "class", "label")


@query("c11_class_segments")
def _(spark, d):
    return pipelines.class_segments(with_class(spark, d), [("other", 0.6, 20), ("tree", 0.6, 20), ("ground", 0.6, 20)]).select("point_id", "class", "label")


@query("c11_fused_supervoxels")
def _(spark, d):
    return pipelines.fused_supervoxels(event_points(spark, d), 60)


@query("c12_reflectance")
def _(spark, d):
    return rounded(pipelines.reflectance(event_points(spark, d), spectra(spark, d), GRID, LIGHT, 15.0, 0.2), 4)


@query("c15_gamma_shown", f"WITH {SPECTRA_SQL}, {_STRETCH} SELECT pixel, CAST(l.band AS INTEGER) AS band, round(pow((value - lo) / (hi - lo), 0.5), 6) AS shown FROM l JOIN e ON e.band = l.band")
def _(spark, d):
    return rounded(pipelines.gamma_shown(raster.bands_long(spectra(spark, d), [20, 27, 17]), 0.5).select("pixel", "band", "shown"))


@query("c15_cube_faces", f"WITH {SPECTRA_SQL}, en AS (SELECT min(list_min(bands)) AS lo, max(list_max(bands)) AS hi, max(row) AS h, max(col) AS w FROM hsi), fa AS (SELECT 'first_row' AS face, col AS place, bands FROM hsi WHERE row = 0 UNION ALL SELECT 'last_row', col, bands FROM hsi, en WHERE row = h UNION ALL SELECT 'first_col', row, bands FROM hsi WHERE col = 0 UNION ALL SELECT 'last_col', row, bands FROM hsi, en WHERE col = w), l AS (SELECT face, place, {_LONG} FROM fa), v AS (SELECT face, place, band, (ln(band + 1.0) + 1) * (value - lo) / (hi - lo) AS w FROM l, en) SELECT face, place, CAST(band AS INTEGER) AS band, round(w / max(w) OVER (), 6) AS shown FROM v")
def _(spark, d):
    return rounded(raster.cube_faces(spectra(spark, d)))


@query("s1_tiff_round_trip", f"WITH {SPECTRA_SQL} SELECT pixel, row, col, CAST(band AS INTEGER) AS band, value FROM (SELECT pixel, row, col, {_LONG} FROM hsi)")
def _(spark, d):
    path = f"{shared_path(spark, 'raster')}/cube.tif"
    tiff.write_raster(spectra(spark, d), path, TRANSFORM)
    return raster.bands_long(tiff.read_rasters(spark, path)[0])


@query("s1_tiff_heads", f"WITH {SPECTRA_SQL} SELECT '0.0,2.0,0.0,60.0,0.0,-2.0' AS gt, 'a projection' AS prj, max(row) + 1 AS height, max(col) + 1 AS width, max(len(bands))::INTEGER AS n_bands FROM hsi")
def _(spark, d):
    path = f"{shared_path(spark, 'raster')}/cube.tif"
    tiff.write_raster(spectra(spark, d), path, TRANSFORM, "a projection")
    return tiff.read_rasters(spark, path)[1].select(F.array_join(F.col("gt").cast("array<string>"), ",").alias("gt"), "prj", "height", "width", "n_bands")


@query("s3_las_round_trip", f"WITH {EVENTS_SQL}, lo AS (SELECT min(x) AS x1, min(y) AS y1, min(z) AS z1 FROM ev) SELECT {', '.join(f'round(round_even(({c} - {c}1) / 0.001, 0) * 0.001 + {c}1, 6) AS {c}' for c in 'xyz')}, CAST(trunc(intensity) AS DOUBLE) AS intensity, label AS classification, num_returns, round(CAST(point_id AS DOUBLE), 6) AS gps_time FROM ev, lo")
def _(spark, d):
    path = shared_path(spark, "cloud")
    points = event_points(spark, d).select(*"xyz", "intensity", F.col("label").alias("classification"), "num_returns", F.col("point_id").cast("double").alias("gps_time"))
    las.write_points(points, path)
    return rounded(las.point_columns(las.read_points(spark, path)))


@query("f12_attributes", "SELECT * FROM (VALUES ('points', true), ('normals', true), ('colors', true), ('curvatures', false)) t(attribute, held)")
def _(spark, d):
    cloud = event_points(spark, d)
    return spark.createDataFrame([(a, clouds.has(cloud, a)) for a in clouds.ATTRIBUTES], "attribute string, held boolean")


@query("s9_column_major", "SELECT CAST(i % 30 AS INTEGER) AS row, CAST((i // 30) % 25 AS INTEGER) AS col, CAST(i // 750 AS INTEGER) AS band, CAST(i * 0.5 AS DOUBLE) AS value FROM range(2250) t(i)")
def _(spark, d):
    return tiff.column_major(spark.range(2250).select(F.col("id").alias("i"), (F.col("id") * 0.5).alias("value")), 30, 25)


_PART = lambda i: f"CAST('0x' || substr(md5(i || ':0:{i}'), 1, 8) AS BIGINT) / 4294967296.0"


@query("s10_cube_cloud", f"WITH t AS (SELECT i, i // 50 AS face, (i // 50) % 3 AS axis FROM range(300) r(i)) SELECT i AS point_id, " + ", ".join(f"round(CASE WHEN axis = {k} THEN face // 3 ELSE {_PART(k)} END, 6) AS {c}" for k, c in enumerate("xyz")) + ", " + ", ".join(f"CASE WHEN axis = {k} THEN 1.0::DOUBLE WHEN face >= 3 THEN 0.5 ELSE 0.0 END AS {c}" for k, c in enumerate("rgb")) + " FROM t")
def _(spark, d):
    return rounded(las.cube_cloud(spark, 50))


_OCTREE = "bb AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2 FROM ev), cu AS (SELECT *, greatest((x2 - x1) / 2, (y2 - y1) / 2, (z2 - z1) / 2) AS h FROM bb), cv AS (SELECT h * 2 * 1.01 / 16 AS s, least(x1, (x1 + x2) / 2 - h) AS ox, least(y1, (y1 + y2) / 2 - h) AS oy, least(z1, (z1 + z2) / 2 - h) AS oz FROM cu)"


@query("g22_octree_leaves", f"WITH {EVENTS_SQL}, {_OCTREE}, k AS (SELECT ev.*, CAST(floor((x - ox) / s) AS BIGINT) AS kx, CAST(floor((y - oy) / s) AS BIGINT) AS ky, CAST(floor((z - oz) / s) AS BIGINT) AS kz FROM ev, cv) SELECT kx, ky, kz, count(*) AS n, round(arg_max(r, point_id), 6) AS r, round(arg_max(g, point_id), 6) AS g, round(arg_max(b, point_id), 6) AS b FROM k WHERE kx BETWEEN 0 AND 15 AND ky BETWEEN 0 AND 15 AND kz BETWEEN 0 AND 15 GROUP BY kx, ky, kz")
def _(spark, d):
    return rounded(clouds.leaf_colours(event_points(spark, d), 4))


@query("g13_label_centroids", f"WITH {EVENTS_SQL} SELECT label, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('x', 'y', 'z', 'nx', 'ny', 'nz', 'r', 'g', 'b'))} FROM ev GROUP BY label")
def _(spark, d):
    return rounded(clouds.label_centroids(event_points(spark, d)))


@query("j17_neighbour_lists", f"WITH {EVENTS_SQL}, {_NEAR} SELECT query_id, array_to_string(list(nbr_id ORDER BY rank), ',') AS near FROM nn GROUP BY query_id")
def _(spark, d):
    t = event_points(spark, d)
    return clouds.neighbour_lists(knn.nearest_within(t, t, 1.5, 5)).select("query_id", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"))


@query("j17_members", f"WITH {EVENTS_SQL} SELECT label, array_to_string(list_sort(list(point_id)), ',') AS point_ids FROM ev GROUP BY label")
def _(spark, d):
    return clouds.members(event_points(spark, d)).select("label", F.array_join(F.col("point_ids").cast("array<string>"), ",").alias("point_ids"))
