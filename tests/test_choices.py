"""Greedy choices against plain loops, and regions that wind for many rounds."""

import numpy as np
from pyspark.sql import functions as F

from spurline.operators import evidence, graph, picks


def test_greedy_cover_against_a_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(int(c), int(u), int(n)) for c in range(25) for u in rng.choice(12, rng.integers(1, 6), replace=False) for n in [rng.integers(1, 5)]]
    got = [r["cell"] for r in evidence.greedy_cover(spark.createDataFrame(rows, "cell long, unit long, n long"), "cell", "unit", 6, 8).orderBy("place").collect()]
    have, want = dict.fromkeys(range(12), 0), []
    for _ in range(8):
        gain = {}
        for c, u, n in rows:
            if c not in want:
                gain[c] = gain.get(c, 0) + min(n, max(6 - have[u], 0))
        best = min(gain, key=lambda c: (-gain[c], c))
        if gain[best] <= 0:
            break
        want.append(best)
        for c, u, n in rows:
            if c == best:
                have[u] += n
    assert got == want
    nothing = spark.createDataFrame([], "cell long, unit long, n long")
    assert evidence.greedy_cover(nothing, "cell", "unit", 6, 8).count() == 0


def test_blocks_apart_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(a, i, j, float(rng.integers(0, 6))) for a in (1, 2) for i in range(9) for j in range(9)]
    got = picks.blocks_apart(spark.createDataFrame(rows, "area long, block_row int, block_col int, score double"), "score", 1.0, ["area"], 7)
    for area in (1, 2):
        want = []
        for _, i, j, s in sorted((r for r in rows if r[0] == area and r[3] > 1.0), key=lambda r: (-r[3], r[1], r[2])):
            if len(want) < 7 and all(max(abs(i - a), abs(j - b)) > 1 for a, b in want):
                want.append((i, j))
        assert [(r["block_row"], r["block_col"]) for r in got.where(F.col("area") == area).orderBy("rank").collect()] == want


def test_regions_of_a_winding_path(spark):
    """A path up and down the grid is one region after many rounds, whose estimates of size must not grow with them."""
    cells = [(i, j) for j in range(0, 16, 2) for i in range(16)] + [(15 if j % 4 == 1 else 0, j) for j in range(1, 14, 2)]
    found = graph.regions(spark.createDataFrame(cells, "row int, col int")).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in found] == [(1, len(cells))]
