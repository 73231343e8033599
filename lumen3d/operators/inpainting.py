"""Filling of holes in height rasters by least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.functions.tables import shared_table
from lumen3d.operators.graph import component_ids
from lumen3d.operators.raster import valid_in_window

#: Weight of a known height; a fixed value of the method.
KNOWN = 9.0


def unknowns(pixels: DataFrame, valid_min: float) -> DataFrame:
    """Pixels (row, col, value, label) whose 5 x 5 neighbourhood, the border repeated, is not all valid, with valid."""
    marked = valid_in_window(pixels, F.col("value") > F.lit(valid_min).cast("float"))
    return marked.where("n_valid < 25").select("row", "col", "value", "label", (F.col("value") > F.lit(valid_min).cast("float")).alias("valid"))


def equations(row: np.ndarray, col: np.ndarray, valid: np.ndarray, label: np.ndarray, gradient: float, curve: float) -> list[list[tuple[int, float]]]:
    """Rows of the smoothness equations over the unknowns, each a list of (unknown, weight) that shall be 0.

    An invalid pixel equals its right and lower neighbours, and its left and upper ones where those are valid,
    weighted by gradient. Three unknowns in line of one label have no second difference, weighted by curve, where
    an outer one is invalid or the middle one is valid.
    """
    at = {(r, c): k for k, (r, c) in enumerate(zip(row.tolist(), col.tolist(), strict=True))}
    out: list[list[tuple[int, float]]] = []
    for k, (r, c) in enumerate(zip(row.tolist(), col.tolist(), strict=True)):
        if not valid[k]:
            for step, only_valid in (((0, -1), True), ((-1, 0), True), ((0, 1), False), ((1, 0), False)):
                other = at.get((r + step[0], c + step[1]))
                if other is not None and label[other] == label[k] and (valid[other] or not only_valid):
                    out.append([(k, gradient), (other, -gradient)])
        for step in ((0, 1), (1, 0)):
            one, two = at.get((r - step[0], c - step[1])), at.get((r + step[0], c + step[1]))
            if one is None or two is None or not (not valid[one] or not valid[two] or valid[k]):
                continue
            if label[k] == label[one] == label[two]:
                out.append([(one, -curve), (two, -curve), (k, 2 * curve)])
    return out


def least_squares(rows: list[list[tuple[int, float]]], n: int, valid: np.ndarray, value: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Conjugate gradients on the normal equations, from 0."""
    known = np.flatnonzero(valid)
    i = np.array([k for k, r in enumerate(rows) for _ in r] + [len(rows) + k for k in range(len(known))], np.int64)
    j = np.array([c for r in rows for c, _ in r] + known.tolist(), np.int64)
    v = np.array([w for r in rows for _, w in r] + [KNOWN] * len(known), float)
    m = len(rows) + len(known)
    b = np.zeros(m)
    b[len(rows) :] = KNOWN * value[known]
    times = lambda x: np.bincount(i, v * x[j], m)
    back = lambda y: np.bincount(j, v * y[i], n)
    x, residual = np.zeros(n), b.copy()
    s = back(residual)
    p, gamma = s.copy(), float(s @ s)
    goal = tolerance**2 * max(gamma, 1e-300)
    for _ in range(4 * n + 100):
        if gamma <= goal:
            break
        q = times(p)
        step = gamma / max(float(q @ q), 1e-300)
        x += step * p
        residual -= step * q
        s = back(residual)
        gamma, before = float(s @ s), gamma
        p = s + gamma / before * p
    return x


def inpainted(pixels: DataFrame, gradient: float, curve: float, valid_min: float = 0.0) -> DataFrame:
    """(row, col, value): the raster (row, col, value, label) with every unknown replaced by its least squares value.

    Unknowns are found by windows; each group of them that touches, also across a pixel, is solved in a task of
    its own, so that holes far apart do not meet.
    """
    holes = shared_table(unknowns(pixels, valid_min).withColumn("node", F.col("row").cast("long") * (1 << 32) + F.col("col")), "holes")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, 2), (2, 0))])
    asked = holes.select("node", "row", "col", F.explode(steps).alias("s")).select(F.col("node").alias("a"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    touching = asked.join(holes.select("row", "col", F.col("node").alias("b")), ["row", "col"]).select("a", "b")
    named = holes.join(component_ids(touching), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"], ignore_index=True)
        row, col, valid, label = (frame[c].to_numpy() for c in ("row", "col", "valid", "label"))
        solved = least_squares(equations(row, col, valid, label, gradient, curve), len(frame), valid, frame["value"].to_numpy(float))
        return pd.DataFrame({"row": row, "col": col, "solved": solved})

    solved = named.select("component", "row", "col", "value", "label", "valid").groupBy("component").applyInPandas(run, "row int, col int, solved double")
    return pixels.join(solved, ["row", "col"], "left").select("row", "col", F.coalesce("solved", "value").alias("value"))
