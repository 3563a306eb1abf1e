"""Circuit current against a dense solve of the whole grid, and the filters on haloed squares against direct loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spurline.operators import current, lattice, squares


def frame(spark, areas, name="r"):
    rows = [(a, i, j, float(v)) for a, grid in areas.items() for (i, j), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, f"area long, row int, col int, {name} double")


def arrays(df, name, shape):
    out = {}
    for r in df.collect():
        out.setdefault(r["area"], np.full(shape, np.nan))[r["row"], r["col"]] = r[name]
    return out


def solved(r, axis):
    """Potentials by one dense system."""
    h, w = r.shape
    a, b = np.zeros((h * w, h * w)), np.zeros(h * w)
    for i in range(h):
        for j in range(w):
            k = i * w + j
            at, last = (i, h - 1) if axis == 0 else (j, w - 1)
            if at in (0, last):
                a[k, k], b[k] = 1, float(at == 0)
                continue
            for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= i + di < h and 0 <= j + dj < w:
                    g = 2 / (r[i, j] + r[i + di, j + dj])
                    a[k, k] += g
                    a[k, (i + di) * w + j + dj] -= g
    return np.linalg.solve(a, b).reshape(h, w)


def density(r):
    out = 0
    for axis in (0, 1):
        v, cur = solved(r, axis), np.zeros(r.shape)
        for i in range(r.shape[0]):
            for j in range(r.shape[1]):
                for di, dj in ((0, 1), (1, 0)):
                    if i + di < r.shape[0] and j + dj < r.shape[1]:
                        x = 0.5 * abs(2 / (r[i, j] + r[i + di, j + dj]) * (v[i, j] - v[i + di, j + dj]))
                        cur[i, j] += x
                        cur[i + di, j + dj] += x
        out = out + 0.5 * cur / cur.mean()
    return out


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_potentials_and_current(spark, tile):
    rng = np.random.default_rng(1)
    areas = {1: np.exp(rng.normal(0, 3, (24, 24))).clip(1, 1e4), 2: np.ones((24, 24))}
    areas[2][10:14, 3:20] = 9000  # a wall with a gap on each side
    df = frame(spark, areas)
    both = current.potentials(df, "r", ["area"], tile)
    for name, axis in (("ns", 0), ("we", 1)):
        for area, got in arrays(both, name, (24, 24)).items():
            np.testing.assert_allclose(got, solved(areas[area], axis), atol=1e-9)
    for area, got in arrays(current.current(df, "r", ["area"], tile), "current", (24, 24)).items():
        np.testing.assert_allclose(got, density(areas[area]), atol=1e-6)


def test_funnels(spark):
    """The gap in a wall is a funnel, level ground is none; larger areas are solved on blocks."""
    wall = np.ones((20, 20))
    wall[10, :] = 1e4
    wall[10, 9:11] = 1
    got = arrays(current.funnels(frame(spark, {1: wall}), "r", 30.0, by=["area"], tile=7), "funnel", (20, 20))[1]
    d = density(wall)
    padded = np.pad(d, 10, mode="edge")
    want = np.clip(np.log2(np.maximum(d / np.maximum([[np.median(padded[i : i + 21, j : j + 21]) for j in range(20)] for i in range(20)], 1e-9), 1e-9)) / 2.5, 0, 1)
    np.testing.assert_allclose(got, want, atol=1e-6)
    assert got[10, 9] > 0.8 and got[10, 2] == 0
    coarse = current.coarse_funnels(frame(spark, {1: np.repeat(np.repeat(wall, 2, 0), 2, 1)}), "r", 15.0, 40, 40, by=["area"], most_cells=400, tile=7)
    assert arrays(coarse, "funnel", (40, 40))[1][20, 19] > 0.8
    assert current.potentials(frame(spark, {1: np.ones((1, 3))}), "r", ["area"]).count() == 3  # a single row is all fixed
    assert current.current(frame(spark, {1: wall}).limit(0), "r", ["area"]).count() == 0


@pytest.mark.parametrize("tile", [4, 16])
def test_median_and_horizon(spark, tile):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 5, (13, 17))
    df = frame(spark, {1: z, 2: -z}, "z")
    wide = np.pad(z, 3, mode="symmetric")
    got = arrays(squares.window_median(df, "z", 3, "symmetric", ["area"], tile), "z", z.shape)
    np.testing.assert_allclose(got[1], [[np.median(wide[i : i + 7, j : j + 7]) for j in range(17)] for i in range(13)])
    np.testing.assert_allclose(got[2], -got[1])
    far = arrays(squares.horizon(df, "z", 10.0, 30.0, (10.0, 25.0, 40.0), "up", ["area"], tile), "up", z.shape)[1]
    a = math.radians(30)

    def at(y, x):
        y, x = min(max(y, 0), 12), min(max(x, 0), 16)
        r, c = int(y), int(x)
        r2, c2 = min(r + 1, 12), min(c + 1, 16)
        return (z[r, c] * (1 - x + c) + z[r, c2] * (x - c)) * (1 - y + r) + (z[r2, c] * (1 - x + c) + z[r2, c2] * (x - c)) * (y - r)

    want = [[max(math.degrees(math.atan((at(i - d * math.cos(a) / 10, j + d * math.sin(a) / 10) - z[i, j]) / d)) for d in (10, 25, 40)) for j in range(17)] for i in range(13)]
    np.testing.assert_allclose(far, want)


def test_haloed_nulls_and_types(spark):
    df = frame(spark, {1: np.arange(30.0).reshape(5, 6)}, "z").withColumn("z", F.when(F.col("z") != 7, F.col("z")))
    run = lambda g: {"n": np.where(np.isnan(g["z"][1:-1, 1:-1]), np.nan, 3), "b": g["z"][1:-1, 1:-1] > 10, "x": g["z"][1:-1, :-2]}
    got = {(r["row"], r["col"]): r for r in squares.haloed(df, ["z"], run, {"n": "int", "b": "boolean", "x": "double"}, 1, by=["area"], tile=2).collect()}
    assert len(got) == 30 and got[1, 1]["n"] is None and got[0, 0]["n"] == 3 and got[2, 0]["b"] and got[0, 0]["x"] is None and got[0, 1]["x"] == 0
    assert squares.haloed(df.limit(0), ["z"], run, {"n": "int"}, 1, by=["area"]).count() == 0
    assert lattice.DIRECTIONS[0] == (-1, 0)
