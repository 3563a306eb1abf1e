"""Grids cut into squares of cells with a margin of their neighbours' cells, for filters that look further than a window of columns should."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Grids = dict[str, np.ndarray]


def tile_of(c: Column, tile: int) -> Column:
    return F.floor(c / tile).cast("int")


def with_margins(df: DataFrame, tile: int, margin: int) -> DataFrame:
    """Each cell once for each square (tr, tc) that it lies in, or within margin cells of; margin is at most tile."""
    near = lambda c: F.explode(F.array_distinct(F.array(tile_of(F.col(c) - margin, tile), tile_of(F.col(c), tile), tile_of(F.col(c) + margin, tile))))
    return df.withColumn("tr", near("row")).withColumn("tc", near("col"))


def haloed(df: DataFrame, columns: Sequence[str], run: Callable[[Grids], Mapping[str, np.ndarray]], out: Mapping[str, str], margin: int, edge: str | None = None, by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """by, row, col of df and the columns of `out` (name: type), which run makes of each square of cells.

    run gets every column as a 2-D array of numbers (NaN for null) of the square and margin cells around it, and gives arrays of the square alone, one deep for each name; NaN becomes null. Beyond the area there is NaN, or,
    by edge, what numpy.pad makes of the area: `edge` (the last cell), `symmetric` (mirrored), `odd` (mirrored through the last cell, so planes stay planes). A cell is copied only to the squares it is within margin of: (1 + 2 margin / tile)^2 rows a
    cell, and a square is the work of one task, whatever the size of the area. With an edge df holds every cell of its rectangle; without one it may hold just those that matter.
    """
    tile = max(tile, margin)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*by, "row", "col").schema}
    keys = [*by, "row", "col"]
    schema = ", ".join(f"{c} {k}" for c, k in [*kinds.items(), *out.items()])
    modes = {"edge": {"mode": "edge"}, "symmetric": {"mode": "symmetric"}, "odd": {"mode": "reflect", "reflect_type": "odd"}, None: {"mode": "constant", "constant_values": np.nan}}

    def settle(cells: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(cells["tr"].iloc[0]), int(cells["tc"].iloc[0])
        row, col = cells["row"].to_numpy(), cells["col"].to_numpy()
        own = (row // tile == tr) & (col // tile == tc)
        if not own.any():
            return cells.head(0).reindex(columns=[*keys, *out])
        low, high = (row[own].min(), col[own].min()), (row[own].max(), col[own].max())
        near = (row >= low[0] - margin) & (row <= high[0] + margin) & (col >= low[1] - margin) & (col <= high[1] + margin)
        cells, row, col, own = cells[near], row[near], col[near], own[near]
        r0, c0 = row.min(), col.min()
        shape = (row.max() - r0 + 1, col.max() - c0 + 1)
        around = [(max(0, int(a) - (int(o) - margin)), max(0, int(b) + margin - (int(a) + n - 1))) for a, o, b, n in zip((r0, c0), low, high, shape)]
        grids = {}
        for c in columns:
            grid = np.full(shape, np.nan)
            grid[row - r0, col - c0] = cells[c].astype(float)
            grids[c] = np.pad(grid, around, **modes[edge]) if any(map(any, around)) else grid
        made = run(grids)
        part = cells.loc[own, keys].copy()
        for name, kind in out.items():
            value = made[name][row[own] - low[0], col[own] - low[1]]
            if kind == "boolean":
                value = value.astype(bool)
            elif kind in ("int", "long"):
                value = pd.array(np.where(np.isnan(value), 0, value).astype(np.int64), dtype="Int64") if not np.isnan(value).any() else pd.array([None if np.isnan(v) else int(v) for v in value], dtype="Int64")
            else:
                value = pd.Series(value, index=part.index).astype(object).where(~np.isnan(value), None) if np.isnan(value).any() else value
            part[name] = value
        return part

    copies = with_margins(df.select(*keys, *columns), tile, margin)
    return copies.groupBy(*by, "tr", "tc").applyInPandas(settle, schema)


def inner(a: np.ndarray, margin: int, r: int = 0, c: int = 0) -> np.ndarray:
    """The square of an array with margins, seen from so many cells further down and to the right."""
    h, w = a.shape[0] - 2 * margin, a.shape[1] - 2 * margin
    return a[margin + r : margin + r + h, margin + c : margin + c + w]


def smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius int(4 sigma + 0.5) of an array, edges mirrored."""
    k = int(4 * sigma + 0.5)
    if not k:
        return a
    weights = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        wide = np.pad(a, [(k, k) if x == axis else (0, 0) for x in (0, 1)], mode="symmetric")
        n = a.shape[axis]
        a = sum(w * np.take(wide, range(i, i + n), axis) for i, w in enumerate(weights))
    return a


def bilinear(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of an array between its cells, held at its edges."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    r, c = np.minimum(np.floor(y).astype(int), a.shape[0] - 1), np.minimum(np.floor(x).astype(int), a.shape[1] - 1)
    r2, c2, fy, fx = np.minimum(r + 1, a.shape[0] - 1), np.minimum(c + 1, a.shape[1] - 1), y - r, x - c
    return (a[r, c] * (1 - fx) + a[r, c2] * fx) * (1 - fy) + (a[r2, c] * (1 - fx) + a[r2, c2] * fx) * fy


def window_median(df: DataFrame, value: str, k: int, edge: str, by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """by, row, col and value: its median over the square of half-width k; edge: `symmetric` or `edge`. Nulls are left out of it."""

    def run(grids: Grids) -> Grids:
        wide = grids[value]
        found = np.empty((wide.shape[0] - 2 * k, wide.shape[1] - 2 * k))
        for r in range(len(found)):  # a row of cells at a time, so that windows take little memory
            windows = np.lib.stride_tricks.sliding_window_view(wide[r : r + 2 * k + 1], (2 * k + 1, 2 * k + 1))[0].reshape(found.shape[1], -1)
            found[r] = np.nanmedian(windows, axis=1) if np.isnan(windows).any() else np.median(windows, axis=1)
        return {value: found}

    return haloed(df, [value], run, {value: "double"}, k, edge, by, tile)


def horizon(df: DataFrame, z: str, cell: float, from_degrees: float, distances: Sequence[float], name: str, by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """by, row, col and name: the greatest angle (degrees) up to the ground at some distances in a direction, between cells bilinear, beyond the area its last cell."""
    a = math.radians(from_degrees)
    margin = math.ceil(max(distances) / cell) + 1

    def run(grids: Grids) -> Grids:
        wide = grids[z]
        own = inner(wide, margin)
        y, x = (g.astype(float) + margin for g in np.mgrid[: own.shape[0], : own.shape[1]])
        best = np.full(own.shape, -90.0)
        for d in distances:
            at = bilinear(wide, y - d * math.cos(a) / cell, x + d * math.sin(a) / cell)
            best = np.fmax(best, np.degrees(np.arctan((at - own) / d)))
        return {name: best}

    return haloed(df, [z], run, {name: "double"}, margin, "edge", by, tile)


def blurred(df: DataFrame, value: str, sigma: float, edge: str, by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """by, row, col and value: its Gaussian of radius int(4 sigma + 0.5) cells; edge: `edge` or `symmetric`."""
    margin = int(4 * sigma + 0.5)
    return haloed(df, [value], lambda grids: {value: inner(smoothed(grids[value], sigma), margin)}, {value: "double"}, margin, edge, by, tile)
