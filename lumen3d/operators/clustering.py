"""Superpixels by weighted k-means in a space of cosines and sines, and their connectivity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen3d.functions.tables import shared_table

#: Weight of colours; that of places is a ratio of it. Fixed values of the method.
COLOUR = 20.0


def seeds(height: int, width: int, region: int) -> tuple[list[tuple[int, int]], int, int]:
    """Seeds (x, y) on a regular grid of about height * width / region ** 2 cells, and the cells' width and height."""
    n = height * width // (region * region)
    columns = max(1, int(math.sqrt(n * width / height)))
    rows = max(1, n // columns)
    step_x, step_y = width // columns, height // rows
    spare_x, spare_y = width - step_x * columns, height - step_y * rows
    at = lambda i, step, spare, size: min(int(i * step + 0.5 * step + min(1 + i, max(1, spare))), size - 1)
    return [(at(i, step_x, spare_x, width), at(j, step_y, spare_y, height)) for i in range(columns) for j in range(rows)], step_x, step_y


def feature_space(pixels: DataFrame, step_x: int, step_y: int, ratio: float, bands: int) -> DataFrame:
    """pixels (pixel, row, col, bands) with f, cosines and sines of place and bands, and w, one over the weight of each.

    The weights are sums over features of a value times its mean over all pixels; the means are 4 + 2 * bands numbers.
    """
    place, quarter = COLOUR * ratio, math.pi / 2
    x, y = F.col("col") / step_x * quarter, F.col("row") / step_y * quarter
    around = lambda f: F.transform("bands", lambda v: f(v * quarter) * (COLOUR / bands))
    featured = pixels.withColumn("f", F.concat(F.array(F.cos(x) * place, F.sin(x) * place, F.cos(y) * place, F.sin(y) * place), around(F.cos), around(F.sin)))
    means = featured.select(F.posexplode("f").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    sigma = F.array(*[F.lit(float(r["m"])) for r in means])
    return featured.withColumn("w", 1 / F.aggregate(F.zip_with("f", sigma, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))


def squared_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def centres(sums: DataFrame) -> DataFrame:
    """(k, i, v) as (k, centre)."""
    return sums.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))


def superpixels(pixels: DataFrame, height: int, width: int, region: int, ratio: float, iterations: int, bands: int, cumulative: bool = True) -> DataFrame:
    """(pixel, row, col, label) of pixels (pixel, row, col, bands scaled to 0..1).

    Each iteration joins pixels to the seeds whose windows of one step hold them, by grid cell, takes the nearest in
    the weighted space (the lower number of several), and sums up new centres and seeds; with cumulative the sums
    go on over iterations. A pixel that no window holds keeps its label, at first the nearest seed's number.
    """
    spark = pixels.sparkSession
    places, step_x, step_y = seeds(height, width, region)
    pixels = pixels.select("pixel", "row", "col", "bands")
    space = shared_table(feature_space(pixels, step_x, step_y, ratio, bands).withColumn("g", F.transform("f", lambda v: v / F.col("w"))), "clusters-space")
    at = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "k int, x double, y double")
    cells = [F.floor(F.col("col") / step_x).alias("cx"), F.floor(F.col("row") / step_y).alias("cy")]

    def windows(seeds_at: DataFrame, reach_x: int, reach_y: int, more: list[str]) -> DataFrame:
        near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        spread = seeds_at.select("k", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *more, F.explode(near).alias("s")).withColumns({"cx": F.floor(F.col("x") / step_x) + F.col("s.i"), "cy": F.floor(F.col("y") / step_y) + F.col("s.j")}).drop("s")
        return space.select("pixel", "row", "col", "f", "g", "w", *cells).join(spread, ["cx", "cy"]).where((F.abs(F.col("col") - F.col("x")) <= reach_x) & (F.abs(F.col("row") - F.col("y")) <= reach_y))

    first = windows(at, step_x // 4, step_y // 4, []).select("k", F.posexplode("g").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("v"))
    state = shared_table(at.join(centres(first), "k"), "clusters-centres")
    labels = None
    totals = spark.createDataFrame([], "k int, i int, v double")
    for turn in range(iterations):
        nearest = windows(state, step_x, step_y, ["centre"]).groupBy("pixel").agg(F.min(F.struct(squared_gap(F.col("g"), F.col("centre")).cast("float").alias("d"), F.col("k"))).alias("best")).select("pixel", F.col("best.k").alias("label"))
        fallback = space.select("pixel", F.lit(0).alias("old")) if labels is None else labels.withColumnRenamed("label", "old")
        labels = shared_table(fallback.join(nearest, "pixel", "left").select("pixel", F.coalesce("label", "old").alias("label")), "clusters-labels")
        # the last entries sum the weights, the members and their places
        parts = F.concat("f", F.array(F.col("w"), F.lit(1.0), F.col("col").cast("double"), F.col("row").cast("double")))
        new = space.join(labels, "pixel").select(F.col("label").alias("k"), F.posexplode(parts).alias("i", "v"))
        totals = shared_table((totals.unionByName(new) if cumulative else new).groupBy("k", "i").agg(F.sum("v").alias("v")), "clusters-sums")
        sums = centres(totals)
        size = 4 + 2 * bands
        over = lambda i: F.element_at("centre", size + i)
        moved = sums.select("k", F.try_divide(over(3), over(2)).alias("x"), F.try_divide(over(4), over(2)).alias("y"), F.transform(F.slice("centre", 1, size), lambda v: F.try_divide(v, over(1))).alias("centre"))
        state = shared_table(state.select("k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("centre").alias("c0")).join(moved, "k", "left").select("k", F.coalesce("x", "x0").alias("x"), F.coalesce("y", "y0").alias("y"), F.coalesce("centre", "c0").alias("centre")), "clusters-centres")
        del turn
    return space.select("pixel", "row", "col").join(labels, "pixel")


def flooded(labels: np.ndarray) -> np.ndarray:
    """8-connected components of equal labels, numbered in column order."""
    height, width = labels.shape
    out, count = np.full(labels.shape, -1, np.int64), 0
    for x in range(width):
        for y in range(height):
            if out[y, x] >= 0:
                continue
            out[y, x], stack = count, [(y, x)]
            while stack:
                a, b = stack.pop()
                for c in range(max(a - 1, 0), min(a + 2, height)):
                    for d in range(max(b - 1, 0), min(b + 2, width)):
                        if out[c, d] < 0 and labels[c, d] == labels[a, b]:
                            out[c, d] = count
                            stack.append((c, d))
            count += 1
    return out


def settled_labels(labels: np.ndarray, least: int) -> np.ndarray:
    """Components of fewer than least pixels, in column order, take a label met before.

    That is the label, as it is by then, of the pixel left of a component's first one (above it in the first column), if it
    is another one than the component's own; else the one that was met last, at first 0.
    """
    parts = flooded(labels)
    sizes = np.bincount(parts.ravel())
    columns = parts.T.ravel()
    firsts = np.unique(columns, return_index=True)[1]
    height, beside, now = len(labels), 0, labels.T.ravel()[firsts].copy()
    for part, first in enumerate(firsts.tolist()):
        x, y = divmod(first, height)
        if x or y:
            met = now[parts[y, x - 1] if x else parts[y - 1, x]]
            if met != now[part]:
                beside = met
        if sizes[part] < least:
            now[part] = beside
    return now[parts]


def connected_labels(labels: np.ndarray, features: np.ndarray, weights: np.ndarray, least: int, least_merged: float) -> np.ndarray:
    """settled_labels(), of which components of fewer than least_merged pixels join a neighbour, in column order; numbers in column order.

    Of a component, features (height, width, f) give a centre: the sum of its pixels' first four, and as often as it has
    pixels the others of its first pixel, over the sum of its weights. It joins the neighbour whose centre is nearest (the
    first of several), and the centre moves by weight. A joined component keeps its turn, unless it is large enough by then.
    """
    parts = flooded(settled_labels(labels, least))
    height, width = parts.shape
    sizes = np.bincount(parts.ravel())
    total = np.bincount(parts.ravel(), weights.ravel())
    firsts = np.unique(parts.T.ravel(), return_index=True)[1]
    centres = sizes[:, None] * features[firsts % height, firsts // height]
    for f in range(4):
        centres[:, f] = np.bincount(parts.ravel(), features[:, :, f].ravel())
    centres = centres / total[:, None]
    near: list[set[int]] = [set() for _ in sizes]
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = parts[: height - dy, max(0, -dx) : width - max(0, dx)]
        b = parts[dy:, max(0, dx) : width + min(0, dx)]
        for p, q in np.unique(np.column_stack([a[a != b], b[a != b]]), axis=0).tolist():
            near[p].add(q)
            near[q].add(p)
    home, waiting = np.arange(len(sizes)), sizes < least_merged
    for small in np.flatnonzero(waiting).tolist():
        if not waiting[small] or not near[small]:
            continue
        others = np.array(sorted(near[small]))
        into = int(others[((centres[others] - centres[small]) ** 2).sum(axis=1).argmin()])
        centres[into] = (total[into] * centres[into] + total[small] * centres[small]) / (total[into] + total[small])
        total[into] += total[small]
        home[small], waiting[small] = into, False
        if waiting[into]:
            sizes[into] += sizes[small]
            waiting[into] = sizes[into] < least_merged
        for other in near[small]:
            near[other].discard(small)
            if other != into:
                near[other].add(into)
                near[into].add(other)
    while not np.array_equal(home, home[home]):
        home = home[home]
    merged = home[parts]
    _, first, inverse = np.unique(merged.T.ravel(), return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse].reshape(width, height).T


def connected_superpixels(pixels: DataFrame, least: int, height: int, width: int, region: int, ratio: float, bands: int) -> DataFrame:
    """(pixel, label) of pixels (pixel, row, col, label, bands) of superpixels(): connected_labels() over the whole raster, whose order needs one task.

    Components join others below a quarter of the pixels of a seed.
    """
    places, step_x, step_y = seeds(height, width, region)
    least_merged = height * width // (4 * len(places))
    space = feature_space(pixels.select("pixel", "row", "col", "label", "bands"), step_x, step_y, ratio, bands)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["row"].to_numpy(), frame["col"].to_numpy()
        labels, weights = np.full((height, width), -1, np.int64), np.zeros((height, width))
        features = np.zeros((height, width, 4 + 2 * bands))
        labels[at], weights[at] = frame["label"], frame["w"]
        features[at] = np.stack([np.asarray(f) for f in frame["f"]])
        return pd.DataFrame({"pixel": frame["pixel"], "label": connected_labels(labels, features, weights, least, least_merged)[at]})

    return space.select(F.lit(0).alias("one"), "pixel", "row", "col", "label", "f", "w").groupBy("one").applyInPandas(run, "pixel long, label int")
