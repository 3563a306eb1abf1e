"""Saddles of the ground, and where a ridge is a crossing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spurline.operators.lattice import soft
from spurline.operators.lines import junctions, thinned
from spurline.operators.squares import Grids, blurred, haloed, inner
from spurline.operators.store import keep


def _gradient(df: DataFrame, value: str, cell: float, down: str, along: str, by: Sequence[str]) -> DataFrame:
    """Adds the change of value per metre down and along: central differences, one-sided at edges."""
    for axis, other, name in (("row", "col", down), ("col", "row", along)):
        w = Window.partitionBy(*by, other).orderBy(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        span = (before.isNotNull().cast("int") + after.isNotNull().cast("int")) * cell
        df = df.withColumn(name, F.coalesce(F.try_divide(F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value)), span), F.lit(0.0)))
    return df


def saddles(df: DataFrame, z: str, cell: float, sigma: float = 25.0, reach: float = 250.0, least: float = 8.0, by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """by, row, col, rise, drop and axis of the saddles of the smoothed ground: the lower of the ridge's climbs on both sides, that of the falls across it, and the ridge's angle from east, 0 to 180.

    A saddle is the most saddle-like cell (Hessian determinant most below 0) of 60 m about it on gentle ground, from which the ground rises by `least` metres both ways along the one axis of curvature and falls by three quarters of it both ways along the other, within reach.
    Derivatives are columns; the axes are eigenvectors of two by two numbers, and the profiles are read within squares of cells, only at candidates, so no step of a ray is a row.
    """
    ground = df.select(*by, "row", "col", F.col(z).cast("double").alias("z_"))
    flat = keep(blurred(ground, "z_", sigma / cell, "edge", by, tile) if sigma / cell > 0.3 else ground)
    first = keep(_gradient(flat, "z_", cell, "gy", "gx", by))
    second = _gradient(_gradient(first, "gy", cell, "gyy", "gyx", by), "gx", cell, "gxy", "gxx", by).withColumn("hxy", 0.5 * (F.col("gxy") + F.col("gyx")))
    det = F.col("gxx") * F.col("gyy") - F.col("hxy") * F.col("hxy")
    gentle = F.hypot("gx", "gy") < math.tan(math.radians(8))
    best, half = second.withColumn("s_", F.when((det < 0) & gentle, F.sqrt(-det)).otherwise(0.0)).withColumn("top_", F.col("s_")), max(3, round(60 / cell) | 1) // 2
    for axis, other in (("col", "row"), ("row", "col")):
        best = best.withColumn("top_", F.max("top_").over(Window.partitionBy(*by, other).orderBy(axis).rowsBetween(-half, half)))
    marked = keep(best.withColumn("peak_", ((F.col("s_") == F.col("top_")) & (F.col("s_") > 0)).cast("int")).select(*by, "row", "col", "z_", "gxx", "gyy", "hxy", "peak_"))
    margin, steps = math.ceil(reach / cell) + 1, np.linspace(cell, reach, max(4, int(reach / (2 * cell)))) / cell

    def run(grids: Grids) -> Grids:
        wide = grids["z_"]
        own = {k: inner(grids[k], margin) for k in ("gxx", "gyy", "hxy", "peak_")}
        out = {k: np.full(own["peak_"].shape, np.nan) for k in ("rise", "drop", "axis")}
        r, c = np.nonzero(own["peak_"] == 1)
        if len(r):
            a, b, d = own["gxx"][r, c], own["hxy"][r, c], own["gyy"][r, c]
            values, vectors = np.linalg.eigh(np.stack([np.stack([a, b], -1), np.stack([b, d], -1)], -2))
            here = wide[r + margin, c + margin]

            def profile(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return wide[(r[:, None] + margin + np.round(y[:, None] * steps)).astype(int), (c[:, None] + margin + np.round(x[:, None] * steps)).astype(int)]

            (nx, ny), (ex, ey) = vectors[:, :, 0].T, vectors[:, :, 1].T
            rise = np.minimum(profile(ex, ey).max(axis=1), profile(-ex, -ey).max(axis=1)) - here
            drop = here - np.maximum(profile(nx, ny).min(axis=1), profile(-nx, -ny).min(axis=1))
            good = (values[:, 0] < 0) & (values[:, 1] > 0) & (rise >= least) & (drop >= 0.75 * least)
            for k, v in (("rise", rise), ("drop", drop), ("axis", np.degrees(np.arctan2(-ey, ex)) % 180)):
                out[k][r[good], c[good]] = v[good]
        return out

    found = haloed(marked, ["z_", "gxx", "gyy", "hxy", "peak_"], run, {"rise": "double", "drop": "double", "axis": "double"}, margin, "edge", by, tile)
    return found.where("rise is not null")


def spine_gate(df: DataFrame, pos: str, saddle: DataFrame, cell: float, saddle_reach: float = 150.0, junction_reach: float = 100.0, high: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Adds gate, 0 to 1: where a spine is a crossing. 1 at a saddle or at a junction of the skeleton of the cells with pos over `high`, fading out with the distance."""
    meet = junctions(thinned(df.where(F.col(pos) > high), by), by).select(*by, "row", "col", F.lit(True).alias("junction_"))
    marked = keep(df.join(meet, [*by, "row", "col"], "left").join(saddle.select(*by, "row", "col").distinct().withColumn("saddle_", F.lit(True)), [*by, "row", "col"], "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("junction_", "saddle_")}))
    near = soft(soft(marked, "saddle_", saddle_reach / cell, "a_", by), "junction_", junction_reach / cell, "b_", by)
    return near.withColumn("gate", F.greatest(F.coalesce("a_", F.lit(0.0)), F.coalesce("b_", F.lit(0.0)))).drop("a_", "b_", "saddle_", "junction_")
