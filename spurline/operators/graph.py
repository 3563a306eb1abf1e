"""Iterative operators on grids and links: components, accumulation, routes, least cost, depression filling.

Loops are driven by one fixpoint helper: each round is a join and a grouped aggregation, written to the checkpoint
folder, and only a count comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.operators.lattice import DIRECTIONS, neighbours, nearest_any, slopes, opened
from spurline.operators.ranks import numbered
from spurline.operators.store import drop_written, keep, written


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str, most: int = 10_000) -> DataFrame:
    """Repeats step until no row of its result has `changed`; step's result keeps start's columns and adds that one."""
    state, before = written(start), None
    for _ in range(most):
        after = written(step(state))
        drop_written(before if before is not None else state)
        state, before = after.drop(changed), after
        if after.where(changed).isEmpty():
            return state
    raise RuntimeError(f"no end after {most} rounds")


def regions(mask: DataFrame, by: Sequence[str] = (), diagonal: bool = False) -> DataFrame:
    """mask: the true cells (by, row, col). Adds label: regions of touching cells, numbered from 1 in order of their first cell.

    Runs of cells in a row are one node from the start; nodes take the least label of those they touch, and then of the node that label names,
    so the rounds grow with the logarithm of a region's winding.
    """
    run = Window.partitionBy(*by, "row").orderBy("col")
    cells = mask.select(*by, "row", "col").withColumn("start", F.when(F.coalesce(F.lag("col").over(run), F.lit(-2)) != F.col("col") - 1, F.col("col")))
    cells = keep(cells.withColumn("start", F.last("start", True).over(run)))
    nodes = cells.groupBy(*by, "row", "start").agg(F.max("col").alias("end"))
    reach = int(diagonal)
    below = nodes.select(*by, (F.col("row") - 1).alias("row"), F.col("start").alias("start_"), F.col("end").alias("end_"), F.col("row").alias("row_"))
    touch = nodes.join(below, [*by, "row"]).where((F.col("start") <= F.col("end_") + reach) & (F.col("start_") <= F.col("end") + reach))
    key = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    links = touch.select(*by, key("row", "start").alias("a"), key("row_", "start_").alias("b"))
    links = keep(links.unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))))

    def step(state: DataFrame) -> DataFrame:
        near = links.join(state.select(*by, F.col("node").alias("b"), F.col("label").alias("m")), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("m").alias("m"))
        low = state.join(near, [*by, "node"], "left").withColumn("new", F.least("label", F.coalesce("m", "label")))
        jump = low.select(*by, F.col("node").alias("new"), F.col("new").alias("next"))
        return low.join(jump, [*by, "new"]).select(*by, "node", F.least("new", "next").alias("label"), (F.least("new", "next") < F.col("label")).alias("changed"))

    found = fixpoint(nodes.select(*by, key("row", "start").alias("node")).withColumn("label", F.col("node")), step, "changed")
    names = numbered(found.select(*by, "label").distinct(), [F.col("label")], "number", by)
    found = found.join(names, [*by, "label"]).select(*by, F.col("node.r").alias("row"), F.col("node.c").alias("start"), F.col("number").cast("int").alias("label"))
    return cells.join(found, [*by, "row", "start"]).drop("start")


def accumulated(df: DataFrame, weight: str) -> DataFrame:
    """df: id, receiver (null at outlets), weight. Adds total: the weight of all ids whose way leads through each, its own included.

    Doubles the length of the ways each round: an id hands what it has gathered to the id that many steps on.
    """
    flows = written(df.select("id", F.col("receiver").alias("jump"), F.col(weight).cast("double").alias("total")))
    while not flows.where("jump is not null").isEmpty():
        arriving = flows.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("total").alias("more"))
        onward = flows.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        flows = written(
            flows.join(arriving, "id", "left").join(onward, "jump", "left").select("id", F.col("next").alias("jump"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))
        )
    return df.join(flows.select("id", "total"), "id")


def roots(df: DataFrame) -> DataFrame:
    """df: id, parent (null at roots). Adds root and depth by pointer doubling."""
    state = written(df.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while True:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        after = written(state.join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            return df.join(state.select("id", F.col("up").alias("root"), "depth"), "id")


def route(df: DataFrame, start: int, thin: int = 1) -> DataFrame:
    """df: id, parent. The way from start to its root as rows step, id; every thin-th of them and the last."""
    way, here = written(df.where(F.col("id") == start).select(F.lit(0).cast("long").alias("step"), "id", "parent")), True
    jump = written(df.select("id", F.col("parent").alias("to")))
    size = 1
    # ids within `size` steps are known; each of them also leads to the one `size` steps on
    while here:
        more = way.join(jump, "id").where("to is not null").select((F.col("step") + size).alias("step"), F.col("to").alias("id"))
        way = written(way.select("step", "id").unionByName(more.join(way.select("id"), "id", "left_anti")))
        here = not more.isEmpty()
        onward = jump.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jump, size = written(jump.join(onward, "to", "left").select("id", F.col("next").alias("to"))), size * 2
    last = way.agg(F.max("step")).first()[0]
    return way.where((F.col("step") % thin == 0) | (F.col("step") == last))


def _tile(c: Column | str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("int") if isinstance(c, str) else F.floor(c / tile).cast("int")


def tiled_fixpoint(df: DataFrame, value: str, relax: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], carried: Sequence[str], by: Sequence[str], tile: int, most: int = 100_000) -> DataFrame:
    """Repeats relax until value no longer changes anywhere. df: by, row, col, value (double) and the carried columns.

    The grid is cut into squares of `tile` cells. A round settles each square that something changed beside, with a ring of its neighbours' cells as they are, so the rounds count squares
    and not cells. relax gets the columns as 2-D arrays (NaN where there is no cell), the ring included, with which cells are the square's own, and gives their new values.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*by, "row", "col", *carried).schema}
    columns = [*by, "row", "col", *carried, value]
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", {value} double, changed boolean"

    def settle(cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = cells["row"].min(), cells["col"].min()
        at = (cells["row"] - r0).to_numpy(), (cells["col"] - c0).to_numpy()
        shape = (at[0].max() + 1, at[1].max() + 1)
        grid = {}
        for c in (*carried, value):
            first = cells[c].iloc[0]
            deep = np.asarray(first).shape if isinstance(first, (list, np.ndarray)) else ()
            grid[c] = np.full((*shape, *deep), np.nan)
            grid[c][at] = np.stack(cells[c].to_numpy()) if deep else cells[c].astype(float)
        own = np.zeros(shape, dtype=bool)
        own[at] = cells["own"].to_numpy()
        there = np.zeros(shape, dtype=bool)
        there[at] = True
        new = relax({**grid, "row": np.arange(shape[0]) + r0, "col": np.arange(shape[1]) + c0, "there": there}, own)
        out = cells[[*by, "row", "col", *carried]].copy()
        out[value] = new[at]
        before = grid[value][at]
        out["changed"] = ~((out[value].to_numpy() == before) | (np.isnan(out[value].to_numpy()) & np.isnan(before)))
        return out[cells["own"].to_numpy()]

    state, first = written(df.select(*columns).withColumn("changed", F.lit(True))), True
    for _ in range(most):
        near = lambda c: F.array_distinct(F.array(_tile(F.col(c) - 1, tile), _tile(c, tile), _tile(F.col(c) + 1, tile)))
        copies = state.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col"))).withColumn("own", (F.col("tr") == _tile("row", tile)) & (F.col("tc") == _tile("col", tile)))
        squares = keep(copies.where(F.lit(True) if first else F.col("changed") & ~F.col("own")).select(*by, "tr", "tc").distinct())
        if not first and squares.isEmpty():
            return state.drop("changed")
        first = False
        work = copies.join(squares, [*by, "tr", "tc"], "left_semi").groupBy(*by, "tr", "tc").applyInPandas(settle, schema)
        rest = state.withColumns({"tr": _tile("row", tile), "tc": _tile("col", tile)}).join(squares, [*by, "tr", "tc"], "left_anti").select(*columns, F.lit(False).alias("changed"))
        # a square of ring cells alone gives nothing back
        state = written(rest.unionByName(work))
    raise RuntimeError(f"no end after {most} rounds")


def _shifted(a: np.ndarray, r: int, c: int, fill: float) -> np.ndarray:
    """a seen from each cell's neighbour r down and c to the right."""
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    out[max(0, -r) : h - max(0, r), max(0, -c) : w - max(0, c)] = a[max(0, r) : h - max(0, -r), max(0, c) : w - max(0, -c)]
    return out


def cheapest(df: DataFrame, cost: str, source: str, cell: float, by: Sequence[str] = (), cutoff: float = math.inf, tile: int = 256) -> DataFrame:
    """Adds reach to df (by, row, col, cost, source): the least cost of a way from a source cell, null beyond cutoff and where none leads.

    A step costs the mean of both cells' cost times its length; a null or infinite cost can't be entered.
    """

    def relax(grid: dict[str, np.ndarray], own: np.ndarray) -> np.ndarray:
        pay, reach = grid[cost], np.where(np.isnan(grid["reach"]), np.inf, grid["reach"])
        pay = np.where(np.isfinite(pay), pay, np.inf)
        steps = [(r, c, 0.5 * (pay + _shifted(pay, r, c, np.inf)) * (math.hypot(r, c) * cell)) for r, c in DIRECTIONS]
        while True:
            best = reach
            for r, c, far in steps:
                offer = _shifted(reach, r, c, np.inf) + far
                best = np.where(own & (offer < best) & (offer <= cutoff), offer, best)
            if np.array_equal(best, reach):
                return np.where(np.isfinite(reach), reach, np.nan)
            reach = best

    sound = F.col(cost).isNotNull() & (F.col(cost) < float("inf"))
    start = df.select(*by, "row", "col", F.when(sound, F.col(cost).cast("double")).alias(cost), F.when(F.col(source) & sound, 0.0).alias("reach"))
    found = tiled_fixpoint(start, "reach", relax, [cost], by, tile).select(*by, "row", "col", F.nanvl("reach", F.lit(None).cast("double")).alias("reach"))
    return df.join(found, [*by, "row", "col"])


def least_cost(df: DataFrame, cost: str, source: str, cell: float, by: Sequence[str] = (), longest: float | None = None, cutoff: float = math.inf, tile: int = 256) -> DataFrame:
    """Cheapest ways from the source cells over the lattice: by, row, col, reach (cost), length and the cell before (from_row, from_col), root_row and root_col (the source).

    A step costs the mean of both cells' cost, above 0, times its length; a null cost can't be entered. Of the neighbours that give a cell its cost, the one
    that is itself cheapest, then first in row-major order, comes before it, so ties have one answer. Ways end at the cutoff of cost; those longer than `longest` are left out.
    """
    reached = keep(cheapest(df.select(*by, "row", "col", cost, source), cost, source, cell, by, cutoff, tile).where("reach is not null"))
    offer = F.col("to_reach") + F.lit(0.5) * (F.col(cost) + F.col(f"to_{cost}")) * (F.col("step") * cell)
    near = neighbours(reached.select(*by, "row", "col", cost, "reach"), [cost, "reach"], by).where((offer <= F.col("reach") * (1 + 1e-12)) & (F.col("to_reach") < F.col("reach")))
    before = near.groupBy(*by, "row", "col").agg(F.min(F.struct(F.col("to_reach").alias("a"), F.col("to_row").alias("r"), F.col("to_col").alias("c"), (F.col("step") * cell).alias("far"))).alias("b"))
    tree = reached.join(before, [*by, "row", "col"], "left").select(*by, "row", "col", "reach", F.when(~F.col(source), F.col("b")).alias("b"))
    up = F.struct(F.coalesce("b.r", "row").alias("r"), F.coalesce("b.c", "col").alias("c"))
    state = written(tree.select(*by, "row", "col", up.alias("up"), F.coalesce("b.far", F.lit(0.0)).alias("length"), F.col("b").isNotNull().alias("open")))
    while not state.where("open").isEmpty():
        above = state.select(*by, F.struct(F.col("row").alias("r"), F.col("col").alias("c")).alias("up"), F.col("up").alias("next"), F.col("length").alias("more"), F.col("open").alias("on"))
        state = written(state.join(above, [*by, "up"]).select(*by, "row", "col", F.col("next").alias("up"), (F.col("length") + F.col("more")).alias("length"), F.col("on").alias("open")))
    ways = tree.join(state.select(*by, "row", "col", "length", F.col("up.r").alias("root_row"), F.col("up.c").alias("root_col")), [*by, "row", "col"])
    ways = ways.select(*by, "row", "col", "reach", "length", F.col("b.r").alias("from_row"), F.col("b.c").alias("from_col"), "root_row", "root_col")
    ways = ways if longest is None else ways.where(F.col("length") <= longest)
    return df.select(*by, "row", "col").join(ways, [*by, "row", "col"], "left")


def covered_share(tree: DataFrame, covered: str, cell: float, last: float, by: Sequence[str] = ()) -> DataFrame:
    """tree: the result of least_cost() with a mask. Adds share: of the last metres of each cell's way into its source, as far as it has them, that are covered.

    A cell's way holds the cells within `last` of its source; each of these hands its uncovered step on by pointer doubling.
    """
    inner = F.col("length") <= last
    step = F.hypot(F.col("from_row") - F.col("row"), F.col("from_col") - F.col("col")) * cell
    bare = F.when(F.col("from_row").isNotNull() & ~F.col(covered) & inner, step).otherwise(0.0)
    cells = keep(tree.where("reach is not null"))
    up = F.struct(F.coalesce("from_row", "row").alias("r"), F.coalesce("from_col", "col").alias("c"))
    state = written(cells.select(*by, "row", "col", up.alias("up"), bare.alias("bare"), F.col("from_row").isNotNull().alias("open")))
    while not state.where("open").isEmpty():
        above = state.select(*by, F.struct(F.col("row").alias("r"), F.col("col").alias("c")).alias("up"), F.col("up").alias("next"), F.col("bare").alias("more"), F.col("open").alias("on"))
        state = written(state.join(above, [*by, "up"]).select(*by, "row", "col", F.col("next").alias("up"), (F.col("bare") + F.col("more")).alias("bare"), F.col("on").alias("open")))
    share = F.when(F.col("length") > 0, 1 - F.col("bare") / F.least("length", F.lit(float(last)))).otherwise(1.0)
    return tree.join(state.select(*by, "row", "col", "bare"), [*by, "row", "col"], "left").withColumn("share", F.when(F.col("reach").isNotNull(), share)).drop("bare")


def flooded(df: DataFrame, z: str, by: Sequence[str], eps: float = 1e-4, tile: int = 256) -> DataFrame:
    """Adds filled: the lowest surface on or above z that falls by at least eps on some way from every cell to the edge of its area. Cells at a gap of the area are edge too."""

    def relax(grid: dict[str, np.ndarray], own: np.ndarray) -> np.ndarray:
        height, level = grid[z], np.where(np.isnan(grid["filled"]), np.inf, grid["filled"])
        while True:
            around = np.min([_shifted(level, r, c, np.inf) for r, c in DIRECTIONS], axis=0)
            best = np.where(own, np.minimum(level, np.fmax(height, around + eps)), level)
            if np.array_equal(best, level):
                return np.where(np.isfinite(level), level, np.nan)
            level = best

    rows = df.select(*by, "row", "col", F.col(z).cast("double").alias(z))
    inner = neighbours(rows.select(*by, "row", "col"), [], by).groupBy(*by, "row", "col").agg((F.count(F.lit(1)) == 8).alias("inner"))
    start = rows.join(inner, [*by, "row", "col"], "left").withColumn("filled", F.when(~F.coalesce("inner", F.lit(False)), F.col(z))).drop("inner")
    found = tiled_fixpoint(start, "filled", relax, [z], by, tile)
    return rows.join(found.select(*by, "row", "col", "filled"), [*by, "row", "col"])


def shared_flow(df: DataFrame, z: str, cell: float, by: Sequence[str], power: float = 1.1, tile: int = 256) -> DataFrame:
    """Adds area: what drains through each cell when its flow is shared among all lower neighbours by slope**power times contour length (0.5, and 0.354 aslant).

    The shares of a cell are one row; what it gathers is then a sum over its higher neighbours, settled in each square from high to low.
    """

    def relax(grid: dict[str, np.ndarray], own: np.ndarray) -> np.ndarray:
        height, shares, area = grid[z], np.nan_to_num(grid["shares"]), np.nan_to_num(grid["area"])
        order = np.argsort(-np.where(np.isnan(height), -np.inf, height), axis=None, kind="stable")
        new = np.where(own, cell * cell, area)
        for i, j in zip(*np.unravel_index(order, height.shape)):
            if np.isnan(height[i, j]):
                break
            for d in np.flatnonzero(shares[i, j]):
                r, c = i + DIRECTIONS[d][0], j + DIRECTIONS[d][1]
                if 0 <= r < own.shape[0] and 0 <= c < own.shape[1] and own[r, c]:
                    new[r, c] += new[i, j] * shares[i, j, d]
        return new

    rows = df.select(*by, "row", "col", F.col(z).cast("double").alias(z))
    down = neighbours(rows, [z], by).withColumn("slope", (F.col(z) - F.col(f"to_{z}")) / (F.col("step") * cell)).where("slope > 0")
    down = down.withColumn("w", F.pow("slope", F.lit(power)) * F.when(F.col("step") == 1, 0.5).otherwise(0.354))
    weights = down.groupBy(*by, "row", "col").agg(F.sum("w").alias("whole"), *(F.sum(F.when(F.col("dir") == d, F.col("w")).otherwise(0.0)).alias(f"w{d}") for d in range(8)))
    shares = F.array(*(F.coalesce(F.col(f"w{d}") / F.col("whole"), F.lit(0.0)) for d in range(8)))
    start = rows.join(weights, [*by, "row", "col"], "left").select(*by, "row", "col", z, shares.alias("shares"), F.lit(float(cell * cell)).alias("area"))
    found = tiled_fixpoint(start, "area", relax, [z, "shares"], by, tile)
    return rows.join(found.select(*by, "row", "col", "area"), [*by, "row", "col"])


def sized_regions(mask: DataFrame, least: int, by: Sequence[str] = (), diagonal: bool = False) -> DataFrame:
    """regions() of at least so many cells, numbered anew, with their cells."""
    found = regions(mask, by, diagonal)
    sizes = found.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= least)
    names = numbered(sizes, [F.col("label")], "number", by)
    return found.join(names, [*by, "label"]).select(*by, "row", "col", F.col("number").cast("int").alias("label"), "cells")


def openings(df: DataFrame, height_of: str, lake: str, k: int, least: int, low: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Open ground as regions of touching cells (label, cells): lower than `low`, no lake, without strips narrower than a square of half-width k, and of at least so many cells."""
    ground = df.select(*by, "row", "col", ((F.col(height_of) < low) & ~F.col(lake)).alias("open_"))
    return sized_regions(opened(ground, "open_", k, by).where("open_"), least, by)


def steep_bands(df: DataFrame, z: str, cell: float, by: Sequence[str] = (), cliff: float = 50.0, steep: float = 35.0, least_area: float = 60.0, least_relief: float = 12.0, base_reach: float = 60.0, top_reach: float = 30.0) -> DataFrame:
    """Adds rock, base and top. df: all cells, z smoothed as wanted.

    A band is a region of touching steep cells, corners too, with at least least_relief between its highest and lowest. rock marks its cells of at least `cliff` degrees in touching
    patches of at least least_area. base and top are 1 beside a band, fading with distance, on gentle ground below and above its middle; both grow with its relief, and are 0.7 of that without so much rock.
    """
    sloped = keep(slopes(df.select(*by, "row", "col", z), z, cell, by).select(*by, "row", "col", z, "slope"))
    bands = regions(sloped.where(F.col("slope") >= steep), by, diagonal=True).join(sloped, [*by, "row", "col"])
    stats = bands.groupBy(*by, "label").agg(F.max(z).alias("high"), F.min(z).alias("low"), (F.count_if(F.col("slope") >= cliff) * (cell * cell)).alias("rock_area")).where(F.col("high") - F.col("low") >= least_relief)
    kept = keep(bands.join(stats, [*by, "label"]).select(*by, "row", "col", "slope", "high", "low", "rock_area"))
    rock = sized_regions(kept.where(F.col("slope") >= cliff), math.ceil(least_area / (cell * cell)), by).select(*by, "row", "col", F.lit(True).alias("rock"))
    marked = sloped.join(kept.select(*by, "row", "col", F.lit(True).alias("band_")), [*by, "row", "col"], "left").withColumn("band_", F.coalesce("band_", F.lit(False)))
    near = nearest_any(marked, "band_", by).join(kept.drop("slope").withColumnsRenamed({"row": "near_row", "col": "near_col"}), [*by, "near_row", "near_col"], "left")
    middle, d = (F.col("high") + F.col("low")) / 2, F.sqrt("d2") * cell
    tall = F.least(F.greatest((F.col("high") - F.col("low")) / 30.0, F.lit(0.35)), F.lit(1.0)) * F.when(F.col("rock_area") >= least_area, 1.0).otherwise(0.7)
    beside = lambda reach, where: F.when((F.col("slope") < 25) & where & (F.col("d2") > 0), F.greatest(1 - d / reach, F.lit(0.0)) * tall).otherwise(0.0)
    out = near.join(rock, [*by, "row", "col"], "left").select(
        *by, "row", "col", F.coalesce("rock", F.lit(False)).alias("rock"), F.coalesce(beside(base_reach, F.col(z) < middle), F.lit(0.0)).alias("base"), F.coalesce(beside(top_reach, F.col(z) >= middle), F.lit(0.0)).alias("top")
    )
    return df.join(out, [*by, "row", "col"])
