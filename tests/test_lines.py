"""Line detector, thinning and tracing against direct computations."""

import math

import numpy as np
import pytest

from spurline.operators import lines


def frame(spark, grid, name="z", area=1):
    return spark.createDataFrame([(area, i, j, float(v)) for (i, j), v in np.ndenumerate(grid)], f"area long, row int, col int, {name} double")


def mask_frame(spark, mask, area=1):
    return spark.createDataFrame([(area, int(i), int(j)) for i, j in np.argwhere(mask)], "area long, row int, col int")


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def ground():
    """A slope with noise, a trough along it and a bench across it."""
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:90, :100].astype(float)
    z = 0.3 * y + rng.normal(0, 0.02, y.shape)
    at = y - 45
    z += np.where(np.abs(at) <= 1.5, -0.3 * at, np.where((at > 1.5) & (at <= 3), -0.45 + 0.3 * (at - 1.5), 0)) * (x > 10)
    z[:, :30] -= 0.15 * np.exp(-0.5 * ((y[:, :30] - 20 - 0.2 * x[:, :30]) / 1.2) ** 2)
    return z


@pytest.mark.parametrize("tile", [40, 512])
def test_responses_equal_direct_filters(spark, tile):
    z, s = ground(), lines.Worn(off_fall=0.0)
    found = lines.responses(frame(spark, z), "z", ["area"], s, tile)
    wide = np.pad(z, 32, mode="reflect", reflect_type="odd")
    for k, across in enumerate(s.across):
        each = []
        for i in range(s.directions):
            f = lines.trough(across, s.along, i * math.pi / s.directions)
            half = len(f) // 2
            windows = np.lib.stride_tricks.sliding_window_view(wide[32 - half : -32 + half, 32 - half : -32 + half], f.shape)
            each.append((windows * f).sum(axis=(2, 3)))
        np.testing.assert_allclose(array(found, f"best{k}", z.shape), np.max(each, axis=0), atol=1e-9)


def test_filters_answer_to_troughs():
    for angle in (0, 0.7, 2.0):
        f = lines.trough(1.0, 6.0, angle)
        assert abs(f.sum()) < 1e-9 and abs(np.abs(f).sum() - 10) < 1e-9
        y, x = np.mgrid[-18:19, -18:19].astype(float)
        along = np.abs(-x * math.sin(angle) + y * math.cos(angle)) < 1
        assert (f * -1.0 * along).sum() > 0 > (f * along).sum()  # a trough, and a wall


def test_fall_line_and_bench(spark):
    """Troughs down the fall line don't count on slopes; the bench does; and no square sees the whole grid."""
    y, x = np.mgrid[:80, :80].astype(float)
    rng = np.random.default_rng(2)
    plain = 0.4 * y + rng.normal(0, 0.01, y.shape)
    bench = plain + np.where(np.abs(y - 40) <= 1.5, -0.4 * (y - 40), np.where((y > 41.5) & (y < 46), -0.6 * (46 - y) / 4.5, np.where((y < 38.5) & (y > 34), 0.6 * (y - 34) / 4.5, 0)))
    gully = plain - 0.4 * (np.abs(x - 40) <= 1)
    both = frame(spark, bench, area=1).unionByName(frame(spark, gully, area=2)).selectExpr("*", "col > 3 as inside")
    found = lines.strengths(both, "z", "inside", ["area"], tile=40)
    top = {k: array(found.where(f"area = {k}"), "strength", y.shape) for k in (1, 2)}
    assert np.median(top[1][38:46, 10:70].max(axis=0)) > 7 and (top[1][:, :4] == 0).all()
    assert np.median(top[2][10:70, 40]) < 4


def test_worn_lines(spark):
    """The bench is a line of cells, with a channel along it the channel's bank."""
    y = np.mgrid[:56, :64][0].astype(float)
    z = 0.4 * y + np.random.default_rng(2).normal(0, 0.01, y.shape) + np.where(np.abs(y - 28) <= 1.5, -0.4 * (y - 28), np.where((y > 29.5) & (y < 34), -0.6 * (34 - y) / 4.5, np.where((y < 26.5) & (y > 22), 0.6 * (y - 22) / 4.5, 0)))
    found = lines.worn_lines(frame(spark, z).selectExpr("*", "true as inside"), "z", "inside", ["area"], tile=64).collect()
    assert len(found) >= 40 and all(24 <= r["row"] <= 32 for r in found)
    rows = spark.createDataFrame([(r["direction"], d, vx, vy) for r in found[:1] for d, vx, vy in ((1.0, 1.0, 0.0), (5.0, 5.0, 0.0), (5.0, 0.0, 5.0), (11.0, 0.0, 11.0))], "direction int, distance double, vx double, vy double")
    assert found[0]["direction"] in (11, 0, 1)
    assert [r[0] for r in rows.select(lines.bank(lines.Worn())).collect()] == [True, False, True, False]


def test_nothing_inside(spark):
    df = frame(spark, np.random.default_rng(1).normal(0, 1, (12, 12))).selectExpr("row", "col", "z", "false as inside")
    assert {r["strength"] for r in lines.strengths(df, "z", "inside").collect()} == {0.0}


def blob(rng, h, w):
    a = np.zeros((h, w), dtype=bool)
    for _ in range(7):
        i, j, r = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 9)
        y, x = np.mgrid[:h, :w]
        a |= (np.abs(y - i) + np.abs(x - j) * rng.uniform(0.2, 2)) < r
    a[h // 2, 3:-3] = a[3:-3, w // 3] = True
    return a


def skeleton_of(mask):
    while True:
        after = lines.thinner(mask)
        if (after == mask).all():
            return mask
        mask = after


@pytest.mark.parametrize("tile,margin", [(8, 2), (16, 8), (256, 32)])
def test_thinning_is_the_same_whatever_the_squares(spark, tile, margin):
    for seed in (1, 2):
        mask = blob(np.random.default_rng(seed), 45, 52)
        got = np.zeros(mask.shape, dtype=bool)
        for r in lines.thinned(mask_frame(spark, mask), ["area"], tile, margin).collect():
            got[r["row"], r["col"]] = True
        assert (got == skeleton_of(mask)).all() and 0 < got.sum() < mask.sum()


def test_thinning_by_hand():
    """A bar becomes its middle line; a line, a cross and a ring stay."""
    bar = np.zeros((9, 20), dtype=bool)
    bar[3:6, 2:18] = True
    assert skeleton_of(bar)[4, 4:16].all() and skeleton_of(bar).sum() <= 16
    ring = np.zeros((9, 9), dtype=bool)
    ring[2, 3:6] = ring[6, 3:6] = ring[3:6, 2] = ring[3:6, 6] = True
    assert (skeleton_of(ring) == ring).all()


def test_strong_patches(spark):
    z = np.zeros((6, 12))
    z[1, 1:5] = 5
    z[1, 2] = 8  # strong, grown through weak cells
    z[3, 1:6] = 5  # never strong
    z[5, 8] = 9  # too small
    z[2, 5] = 5  # touches by a corner only
    got = {(r["row"], r["col"]) for r in lines.strong_patches(frame(spark, z), "z", 4.0, 7.0, 3, ["area"]).collect()}
    assert got == {(1, c) for c in range(1, 5)}


def steps_of(mask):
    cells = {(int(i), int(j)) for i, j in np.argwhere(mask)}
    out = set()
    for i, j in cells:
        for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
            b = (i + di, j + dj)
            if b in cells and not (di and dj and ((i, j + dj) in cells or (i + di, j) in cells)):
                out.add(frozenset([(i, j), b]))
    return out


def test_traced_lines_cover_each_step_once(spark):
    mask = np.zeros((40, 40), dtype=bool)
    for i, j in np.argwhere(skeleton_of(blob(np.random.default_rng(5), 40, 40))):
        mask[i, j] = True
    mask[30:40, 20:40] = False
    ring = [(32, 30), (31, 31), (31, 32), (32, 33), (33, 33), (34, 32), (34, 31), (33, 30)]
    for i, j in ring:
        mask[i, j] = True
    mask[39, 0] = True  # a cell alone has no step
    rows = lines.traced(mask_frame(spark, mask), ["area"]).collect()
    by_line = {}
    for r in sorted(rows, key=lambda r: (r["line"], r["k"])):
        by_line.setdefault(r["line"], []).append((r["row"], r["col"]))
    want = steps_of(mask)
    seen = [frozenset(p) for cells in by_line.values() for p in zip(cells, cells[1:])]
    assert len(seen) == len(set(seen)) and set(seen) == want
    degree = {}
    for step in want:
        for c in step:
            degree[c] = degree.get(c, 0) + 1
    for cells in by_line.values():
        assert all(degree[c] == 2 for c in cells[1:-1])
        assert cells[0] == cells[-1] == min(cells) or degree[cells[0]] != 2 and degree[cells[-1]] != 2 and cells[0:2] <= cells[:-3:-1]
    assert any(set(c) == set(ring) for c in by_line.values())


def test_junctions_and_simplified_lines(spark):
    mask = np.zeros((30, 60), dtype=bool)
    mask[10, 2:50] = True
    mask[10:25, 25] = True
    mask[28, 1:4] = True  # too short
    got = {(r["row"], r["col"]) for r in lines.junctions(mask_frame(spark, mask), ["area"]).collect()}
    assert (10, 25) in got and all(abs(i - 10) <= 1 and abs(j - 25) <= 1 for i, j in got)
    found = lines.polylines(mask_frame(spark, mask), 2.0, 10.0, 1.0, ["area"]).collect()
    assert {r["line"] for r in found} and len({r["line"] for r in found}) == 3 and len(found) == 6
    x = np.linspace(0, 10, 41)
    kept = lines._needed(x, np.where(x < 5, 0, x - 5), 0.01)
    assert kept.sum() == 3 and kept[20]
    assert lines.polylines(mask_frame(spark, np.zeros((3, 3), dtype=bool)), 2.0).count() == 0
