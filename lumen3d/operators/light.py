"""Estimation of the light's direction, and per-label reflectance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen3d.operators.raster import bands_long


def light_directions(samples: DataFrame) -> DataFrame:
    """Per label, the unit vector l that best fits brightness = n . l over its samples (label, nx, ny, nz, brightness).

    Normal equations are nine sums, solved by Cramer's rule in columns; a label whose normals do not span space
    has null parts.
    """
    n = ("nx", "ny", "nz")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(n) for b in n[i:]] + [F.sum(F.col(a) * F.col("brightness")).alias(f"b{a}") for a in n]
    s = samples.groupBy("label").agg(F.count("*").alias("n"), *sums)
    m = [[F.col(f"{min(a, b)}{max(a, b)}") for b in n] for a in n]
    right = [F.col(f"b{a}") for a in n]

    def det(c: list[list[Column]]) -> Column:
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    whole = det(m)
    parts = [F.try_divide(det([[right[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]), whole) for k in range(3)]
    solved = s.select("label", "n", *[p.alias(f"_l{k}") for k, p in enumerate(parts)])
    length = F.sqrt(sum((F.col(f"_l{k}") * F.col(f"_l{k}") for k in range(3)), F.lit(0.0)))
    return solved.select("label", "n", *[F.try_divide(F.col(f"_l{k}"), length).alias(f"l{a}") for k, a in enumerate("xyz")])


def combined_light(directions: DataFrame) -> DataFrame:
    """One light (lx, ly, lz): root mean squares of the parts, with the sign of their sums (plus for 0)."""
    part = lambda c: F.when(F.sum(c) < 0, -1.0).otherwise(1.0) * F.sqrt(F.avg(F.col(c) * F.col(c)))
    return directions.agg(*[part(f"l{a}").alias(f"l{a}") for a in "xyz"])


def light_samples(points: DataFrame, normals: DataFrame, pixels: DataFrame, least_points: int = 1000) -> DataFrame:
    """For segments of more than least_points points (label, pixel): each occupied pixel's normal and mean spectrum."""
    big = points.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > least_points).select("label")
    cells = points.join(big, "label", "left_semi").select("label", "pixel").distinct()
    bright = pixels.select("pixel", (F.aggregate("bands", F.lit(0.0), lambda a, v: a + v) / F.size("bands")).alias("brightness"))
    return cells.join(normals, "pixel").join(bright, "pixel").select("label", "nx", "ny", "nz", "brightness")


def reflectance(shading: DataFrame, neighbours: DataFrame, colours: DataFrame, spectra: DataFrame, weights: DataFrame, smoothness: float, threshold: float | None, repair_below: float | None = 0.1, max_direct: int = 3000) -> DataFrame:
    """(label, band, value): per-label reflectance R that minimises |S R - I m|^2 + smoothness |W R|^2 for each band.

    shading: (pixel, label, v). neighbours: (label, nbr_label). colours: (label, r, g, b). spectra: (pixel, bands).
    weights: (pixel, m), the sums of nz. W's rows hold 1 / m for the m neighbours whose colours differ by less than
    threshold in root mean square, and -1 for the label itself; a label without any holds -1 alone. The normal
    matrix is joined and summed in Spark; labels number a few thousand. The solution of least norm is wanted: up to
    max_direct labels it is found directly in one task, with more, where the matrix would not fit, by conjugate
    gradients on the sparse one, which end there too and fail if they do not. Labels whose mean falls under
    repair_below take the value of the neighbour that is nearest in colour, in order of label.
    """
    c = colours.select("label", "r", "g", "b")
    n = c.select(F.col("label").alias("nbr_label"), *[F.col(k).alias(f"n{k}") for k in "rgb"])
    gap = F.sqrt(sum(((F.col(k) - F.col(f"n{k}")) * (F.col(k) - F.col(f"n{k}")) for k in "rgb"), F.lit(0.0)) / 3)
    met = neighbours.join(c, "label").join(n, "nbr_label").select("label", "nbr_label", gap.alias("gap"))
    near = met if threshold is None else met.where(F.col("gap") < threshold)
    degree = near.groupBy("label").agg(F.count("*").alias("m"))
    w = near.join(degree, "label").select(F.col("label").alias("row"), F.col("nbr_label").alias("col"), (1 / F.col("m")).alias("v")).union(c.select("label", F.col("label").alias("l2"), F.lit(-1.0).alias("v")))
    squared = lambda t, key, a, factor: t.select(key, F.col(a).alias("i"), F.col("v").alias("vi")).join(t.select(key, F.col(a).alias("j"), F.col("v").alias("vj")), key).groupBy("i", "j").agg((F.sum(F.col("vi") * F.col("vj")) * factor).alias("v"))
    g = squared(shading, "pixel", "label", 1.0).union(squared(w, "row", "col", smoothness)).groupBy("i", "j").agg(F.sum("v").alias("v"))
    seen = bands_long(spectra.withColumns({"row": F.lit(0), "col": F.lit(0)})).select("pixel", "band", "value")
    right = shading.join(weights, "pixel").join(seen, "pixel").groupBy("label", "band").agg(F.sum(F.col("v") * F.col("m") * F.col("value")).alias("v"))
    rows = g.select(F.lit(0).alias("one"), F.lit(0).alias("kind"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v").union(right.select(F.lit(0), F.lit(1), F.col("label").cast("long"), F.col("band").cast("long"), "v")).union(met.select(F.lit(0), F.lit(2), F.col("label").cast("long"), F.col("nbr_label").cast("long"), F.col("gap")))
    return rows.groupBy("one").applyInPandas(_solver(repair_below, max_direct), "label long, band int, value double")


def _solver(repair_below: float | None, max_direct: int) -> Callable:
    import pandas as pd

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: f for k, f in frame.groupby("kind")}
        g, right = kinds[0], kinds.get(1, frame[:0])
        labels = np.unique(g[["i", "j"]].to_numpy())
        n, bands = len(labels), int(right["j"].max()) + 1 if len(right) else 0
        at = lambda v: np.searchsorted(labels, v.to_numpy())
        b = np.zeros((n, bands))
        b[at(right["i"]), right["j"].to_numpy(int)] = right["v"]
        i, j, v = at(g["i"]), at(g["j"]), g["v"].to_numpy(float)
        if n <= max_direct:
            a = np.zeros((n, n))
            np.add.at(a, (i, j), v)
            x = np.linalg.lstsq(a, b, rcond=None)[0]
        else:
            x = conjugate_gradients(lambda p: _product(i, j, v, p), b)
        if repair_below is not None and 2 in kinds:
            near = kinds[2].sort_values(["i", "v", "j"]).drop_duplicates("i")
            for label, other in zip(at(near["i"]), at(near["j"]), strict=True):
                if bands and x[label].mean() < repair_below:
                    x[label] = x[other]
        return pd.DataFrame({"label": np.repeat(labels, bands), "band": np.tile(np.arange(bands, dtype="int32"), n), "value": x.ravel()})

    return solve


def _product(i: np.ndarray, j: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros_like(p)
    np.add.at(out, i, v[:, None] * p[j])
    return out


def conjugate_gradients(times: Callable, b: np.ndarray, tolerance: float = 1e-20, most: int = 50_000) -> np.ndarray:
    """Solves a symmetric positive system for all columns of b, which must be in its range: the solution of least norm."""
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), (r * r).sum(axis=0)
    goal = tolerance * np.maximum(rr, 1e-300)
    for _ in range(most):
        if (rr <= goal).all():
            break
        ap = times(p)
        bottom = (p * ap).sum(axis=0)
        step = np.divide(rr, bottom, out=np.zeros_like(rr), where=bottom > 0)
        x += step * p
        r -= step * ap
        new = (r * r).sum(axis=0)
        p = r + np.divide(new, rr, out=np.zeros_like(rr), where=rr > 0) * p
        rr = new
    else:
        raise RuntimeError("conjugate gradients did not converge")
    return x
