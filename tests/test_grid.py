import math

import numpy as np
from pyspark.sql import functions as F

from spurline.functions import scalar as S
from spurline.operators import graph, lattice, picks, vectors


def grid(spark, a, name="v"):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], f"row int, col int, {name} double")


def back(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def test_ramp_and_sector(spark):
    df = spark.createDataFrame([(20.0,), (800.0,), (410.0,), (None,)], "x double")
    got = [r[0] for r in df.select(S.ramp("x", 800, 20)).collect()]
    assert got[:2] == [1.0, 0.0] and abs(got[2] - 0.5) < 1e-9 and got[3] is None
    names = [r[0] for r in spark.createDataFrame([(0.0,), (11.25,), (-22.5,), (359.0,), (180.0,)], "d double").select(S.sector("d")).collect()]
    assert names == ["N", "NNE", "NNW", "N", "S"]


def test_open_spans(spark):
    df = spark.createDataFrame([("05/01-11/30",), ("11/15-02/28",), ("no span",), ("05/01-06/30,09/01-09/30",)], "s string")
    got = df.select(*(S.open_in_month("s", m).alias(f"m{m}") for m in (1, 6, 9)), S.seasonal("s").alias("seasonal")).collect()
    assert [tuple(r) for r in got] == [(False, True, True, True), (True, False, False, True), (True, True, True, False), (False, True, True, True)]


def test_utm_known_point(spark):
    r = spark.range(1).select(S.utm(F.lit(-117.6), F.lit(47.9)).alias("u")).first()["u"]
    assert r["zone"] == 11 and abs(r["easting"] - 455_154) < 50 and abs(r["northing"] - 5_305_300) < 300


def test_half_precision(spark):
    xs = [0.1, 1.0, 1 / 3, 1000.7, -2.3456, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.half_precision("x")).collect()]
    assert got == [float(np.float16(x)) for x in xs]


def test_padding_modes(spark):
    a = np.arange(12.0).reshape(3, 4)
    got = back(lattice.box_mean(grid(spark, a), "v", 1, 3, 4), a.shape)
    p = np.pad(a, 1, mode="edge")
    want = sum(p[i : i + 3, j : j + 4] for i in range(3) for j in range(3)) / 9
    assert np.allclose(got, want)
    med = back(lattice.median_filter(grid(spark, a), "v", 1), a.shape)
    q = np.pad(a, 1, mode="symmetric")
    assert np.allclose(med, np.median([q[i : i + 3, j : j + 4] for i in range(3) for j in range(3)], axis=0))


def test_gaussian_keeps_constants(spark):
    assert np.allclose(back(lattice.gaussian(grid(spark, np.full((5, 6), 3.0)), "v", 1.0, 5, 6), (5, 6)), 3.0)


def test_opening_counts_outside_as_false(spark):
    m = np.zeros((6, 6))
    m[0:3, 0:3] = 1
    m[4, 4] = 1
    df = grid(spark, m).withColumn("m", F.col("v") > 0)
    got = {(r["row"], r["col"]) for r in lattice.opened(df, "m", 1).where("m").collect()}
    assert got == {(i, j) for i in range(3) for j in range(3)}


def test_distances_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.random((9, 11)) < 0.1
    df = grid(spark, m.astype(float)).withColumn("m", F.col("v") > 0)
    at = np.argwhere(m)
    want = np.array([[min((i - r) ** 2 + (j - c) ** 2 for r, c in at) for j in range(11)] for i in range(9)])
    assert np.array_equal(back(lattice.nearest_any(df, "m"), m.shape, "d2"), want)
    near = back(lattice.nearest(df, df.where("m").select("row", "col"), 3), m.shape, "d2")
    assert np.array_equal(np.isnan(near), want > 9) and np.array_equal(near[want <= 9], want[want <= 9])
    none = lattice.nearest_any(df.withColumn("m", F.lit(False)), "m")
    assert none.where("d2 is not null").isEmpty()


def test_regions_against_flood_fill(spark):
    rng = np.random.default_rng(2)
    for diagonal in (False, True):
        m = rng.random((12, 13)) < 0.45
        label, n = np.zeros(m.shape, int), 0
        for i, j in np.argwhere(m):
            if label[i, j]:
                continue
            n += 1
            stack = [(i, j)]
            while stack:
                r, c = stack.pop()
                if 0 <= r < 12 and 0 <= c < 13 and m[r, c] and not label[r, c]:
                    label[r, c] = n
                    stack += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
        df = grid(spark, m.astype(float)).where("v > 0")
        got = {(r["row"], r["col"]): r["label"] for r in graph.regions(df, diagonal=diagonal).collect()}
        assert got == {(i, j): label[i, j] for i, j in np.argwhere(m)}


def test_flow_total_and_route(spark):
    # 0 -> 1 -> 2 -> 5, 3 -> 2, 4 -> 5
    t = spark.createDataFrame([(0, 1), (1, 2), (2, 5), (3, 2), (4, 5), (5, None)], "id long, receiver long").withColumn("w", F.lit(1.0))
    assert {r["id"]: r["total"] for r in graph.accumulated(t, "w").collect()} == {0: 1, 1: 2, 2: 4, 3: 1, 4: 1, 5: 6}
    p = t.select("id", F.col("receiver").alias("parent"))
    assert {r["id"]: (r["root"], r["depth"]) for r in graph.roots(p).collect()} == {0: (5, 3), 1: (5, 2), 2: (5, 1), 3: (5, 2), 4: (5, 1), 5: (5, 0)}
    assert [r["id"] for r in graph.route(p, 0).orderBy("step").collect()] == [0, 1, 2, 5]


def test_least_cost_goes_round_a_wall(spark):
    cost = np.ones((4, 5))
    cost[0:3, 2] = np.nan
    df = grid(spark, cost, "c").withColumn("c", F.nanvl("c", F.lit(None).cast("double"))).withColumn("s", (F.col("row") == 0) & (F.col("col") == 0))
    got = {(r["row"], r["col"]): r["reach"] for r in graph.least_cost(df, "c", "s", 1.0).collect()}
    assert got[0, 2] is None and abs(got[0, 4] - (2 + 4 * math.sqrt(2))) < 1e-9


def test_flooding_leaves_no_pit(spark):
    z = np.full((5, 5), 5.0)
    z[2, 2] = 1.0
    df = grid(spark, z, "z").withColumn("a", F.lit(0))
    got = back(graph.flooded(df, "z", ["a"]), z.shape, "filled")
    assert abs(got[2, 2] - (5 + 2e-4)) < 1e-9 and np.all(got[0] == 5)


def test_spaced_picks(spark):
    rows = [(0, 0, 0, 9.0), (0, 0, 1, 8.0), (0, 0, 2, 7.0), (0, 50, 50, 6.0)]
    df = spark.createDataFrame(rows, "a int, row int, col int, s double")
    got = [(r["name"], r["col"], r["zone"]) for r in picks.spaced(df, "s", 10.0, 2, 5, ["a"]).orderBy("rank").collect()]
    assert got == [("#1", 0, 1), ("#2", 1, 1), ("#3", 50, 2)]


def test_burned_ring(spark):
    ring = [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]
    edges = [(1, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame(edges, "k int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["row"], r["col"]) for r in vectors.burned_rings(df, "k", 0.0, 5.0, 1.0).collect()}
    assert got == {(2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)}
