"""Grids in cell form: one row for each (area, row, col). Windows, padding and offset joins stand for 2-D frames.

`by` names the columns that tell areas apart. Separable filters take two windows, by row and by column, so
their work is spread over areas, rows and columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spurline.functions.scalar import clip, fading, ramp
from spurline.operators.ranks import quantiles
from spurline.operators.squares import Grids, haloed, horizon, inner, window_median

# Fixed value: the order of directions, north first, clockwise; earlier ones win ties.
DIRECTIONS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def cells(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All row, col of one area."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def filled(values: DataFrame, height: int, width: int, *layers: str) -> DataFrame:
    """values on the full lattice; cells without a value take the layer's mean over all cells that have one."""
    full = cells(values.sparkSession, height, width).join(values, ["row", "col"], "left")
    means = values.agg(*(F.avg(v).alias(f"{v}_mean") for v in layers))
    return full.crossJoin(F.broadcast(means)).select("row", "col", *(F.coalesce(v, f"{v}_mean").alias(v) for v in layers))  # means: one row


#: Columns on each side that a row of windows looks at.
WIDE = 16


def _axis(by: Sequence[str], axis: str) -> tuple[str, Window]:
    other = "row" if axis == "col" else "col"
    return other, Window.partitionBy(*by, other).orderBy(axis)


def padded(df: DataFrame, axis: str, k: int, size: int, edge: str) -> DataFrame:
    """df with cells beyond both ends of an axis: copies of the last cell (nearest) or of the mirror image (reflect)."""
    at = F.col(axis)
    if edge == "nearest":
        before = F.when(at == 0, F.sequence(F.lit(-k), F.lit(-1)))
        after = F.when(at == size - 1, F.sequence(F.lit(size), F.lit(size + k - 1)))
    else:
        before = F.when(at < k, F.array((-1 - at).cast("int")))
        after = F.when(at >= size - k, F.array((2 * size - 1 - at).cast("int")))
    empty = F.array().cast("array<int>")
    places = F.concat(F.array(at.cast("int")), F.coalesce(before, empty), F.coalesce(after, empty))
    return df.withColumn(axis, F.explode(places)) if k else df


def _filtered(df: DataFrame, value: str, k: int, height: int, width: int, edge: str, over, by: Sequence[str] = ()) -> DataFrame:
    """value replaced by over(value, window ordered along the axis), along columns, then along rows."""
    for axis, size in (("col", width), ("row", height)):
        _, window = _axis(by, axis)
        df = padded(df, axis, k, size, edge).withColumn(value, over(value, window)).where(F.col(axis).between(0, size - 1))
    return df


def box_mean(df: DataFrame, value: str, r: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the square of half-width r, edges repeated."""
    return _filtered(df, value, r, height, width, "nearest", lambda v, w: F.avg(v).over(w.rowsBetween(-r, r)), by)


def gaussian(df: DataFrame, value: str, sigma: float, height: int, width: int, edge: str = "reflect", by: Sequence[str] = ()) -> DataFrame:
    """Separable Gaussian of radius int(4 sigma + 0.5); sigma in cells."""
    k = min(int(4 * sigma + 0.5), height, width)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    total = sum(weights)

    def blur(v: str, w: Window) -> Column:
        return sum((F.lag(v, -i).over(w) * (weights[i + k] / total) if i else F.col(v) * (weights[k] / total) for i in range(-k, k + 1)), F.lit(0.0))

    return _filtered(df, value, k, height, width, edge, blur, by)


def opened(df: DataFrame, mask: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Erosion, outside counting as false, then dilation, by a square of half-width k."""
    for best, inside in ((F.min, True), (F.max, False)):
        for axis in ("col", "row"):
            _, w = _axis(by, axis)
            w = w.rowsBetween(-k, k)
            value = best(F.col(mask).cast("int")).over(w) == 1
            df = df.withColumn(mask, value & (F.count(F.lit(1)).over(w) == 2 * k + 1) if inside else value)
    return df


def median_filter(df: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Median over the square of half-width k, edges mirrored."""
    return window_median(df, value, k, "symmetric", by)


def slopes(df: DataFrame, value: str, cell: float, by: Sequence[str] = ()) -> DataFrame:
    """Central differences, one-sided at edges: adds slope (degrees), rise (per metre), and the downhill unit vector (east, north), 0 where level."""
    for axis, name in (("col", "gx"), ("row", "gy")):
        _, w = _axis(by, axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        span = (before.isNotNull().cast("int") + after.isNotNull().cast("int")) * cell
        df = df.withColumn(name, F.try_divide(F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value)), span))
    rise = F.hypot(F.coalesce("gx", F.lit(0.0)), F.coalesce("gy", F.lit(0.0)))
    down = lambda g, sign: F.when(F.col("rise") > 1e-6, sign * F.col(g) / F.col("rise")).otherwise(0.0)
    return df.withColumn("rise", rise).withColumns({"slope": F.degrees(F.atan("rise")), "east": down("gx", -1), "north": down("gy", 1)}).drop("gx", "gy")


def chords(radius: float) -> dict[int, int]:
    """Of a disc about a cell, the half-width in cells of each row that it covers."""
    k = int(radius)
    return {r: int(math.sqrt(radius * radius - r * r)) for r in range(-k, k + 1)}


def disc_total(df: DataFrame, value: str, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds total: the sum of value (null: 0) over the disc about each cell, as far as it is on the grid.

    Each row of a disc is a difference of two running sums along its row of cells, and the rows are added down the columns: two windows, and work that grows
    with the radius, not its square. df holds every cell of its rectangle.
    """
    _, along = _axis(by, "col")
    _, down = _axis(by, "row")
    widths, whole = chords(radius), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = df.withColumns({"s_": F.sum(F.coalesce(value, F.lit(0))).over(along), "all_": F.sum(F.coalesce(value, F.lit(0))).over(whole)})
    of = lambda c: F.coalesce(F.lead("s_", c).over(along), F.col("all_")) - F.coalesce(F.lag("s_", c + 1).over(along), F.lit(0))
    wide = summed.withColumns({f"w{c}_": of(c) for c in set(widths.values())})
    total = sum((F.coalesce(F.lag(f"w{c}_", -r).over(down), F.lit(0)) if r else F.col(f"w{c}_") for r, c in widths.items()), F.lit(0))
    return wide.withColumn("total", total).drop("s_", "all_", *(f"w{c}_" for c in set(widths.values())))


def disc_share(df: DataFrame, mask: str, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds share: of the whole disc about each cell, also beyond the grid, that is true."""
    size = sum(2 * c + 1 for c in chords(radius).values())
    return disc_total(df.withColumn("n_", F.col(mask).cast("long")), "n_", radius, by).withColumn("share", clip(F.col("total") / size)).drop("n_", "total")


def disc_sum(df: DataFrame, points: DataFrame, value: str, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds total: the sum of value of the points (row, col, value) on the grid within the radius of each cell."""
    sums = points.groupBy(*by, "row", "col").agg(F.sum(value).alias("n_"))
    return disc_total(df.join(sums, [*by, "row", "col"], "left"), "n_", radius, by).drop("n_")


def _column_gap(df: DataFrame, there: Column, by: Sequence[str]) -> Column:
    """The row of the nearest cell up or down the column where `there` holds; the upper one at equal distance."""
    _, w = _axis(by, "row")
    up = F.last(F.when(there, F.col("row")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(F.when(there, F.col("row")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.when(up.isNull() | (down - F.col("row") < F.col("row") - up), down).otherwise(up)


def nearest_true(df: DataFrame, mask: str, reach: float, by: Sequence[str] = (), square: bool = False) -> DataFrame:
    """Adds d2 (squared cells), near_row and near_col of the nearest true cell within reach, null without one; at equal distances the left column, then the upper row wins. square: reach is the half-width of a square.

    The nearest of each column comes from two windows, the nearest of all from the columns within reach: work that grows with reach, not its square. Beyond WIDE cells
    it comes from the distances of nearest_any(). df holds every cell of its rectangle.
    """
    if reach > WIDE and not square:
        far = nearest_any(df, mask, by)
        return far.withColumns({c: F.when(F.col("d2") <= reach * reach, F.col(c)) for c in ("near_row", "near_col", "d2")})
    _, along = _axis(by, "col")
    k, found = int(reach), df.withColumn("at_", _column_gap(df, F.coalesce(F.col(mask), F.lit(False)), by))

    def offer(i: int) -> Column:
        at = F.lag("at_", -i).over(along) if i else F.col("at_")
        d2 = i * i + (at - F.col("row")) * (at - F.col("row"))
        return F.when(F.abs(at - F.col("row")) <= k if square else d2 <= reach * reach, F.struct(d2.alias("d2"), (F.col("col") + i).alias("c"), at.alias("r")))

    # a window for each column, then the least of them: nulls are left out
    offers = found.withColumns({f"o{i + k}_": offer(i) for i in range(-k, k + 1)})
    names = [f"o{i}_" for i in range(2 * k + 1)]
    best = offers.withColumn("best_", F.least(*names) if k else F.col(names[0]))
    return best.withColumns({"d2": F.col("best_.d2"), "near_row": F.col("best_.r"), "near_col": F.col("best_.c")}).drop("at_", "best_", *names)


def nearest(df: DataFrame, points: DataFrame, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """The same for points (row, col) on the grid."""
    marks = points.select(*by, "row", "col").distinct().withColumn("there_", F.lit(True))
    return nearest_true(df.join(marks, [*by, "row", "col"], "left"), "there_", reach, by).drop("there_")


def _row_distances(lines: pd.DataFrame) -> pd.DataFrame:
    """Of one row of cells with the gap to the nearest true cell in each column, the least d2 and its column, by the lower envelope of the columns' parabolas."""
    lines = lines.sort_values("col")
    cols, gaps = lines["col"].to_numpy(), lines["gap"].to_numpy(dtype=float)
    hits = np.flatnonzero(~np.isnan(gaps))
    d2, near = np.full(len(cols), np.nan), np.full(len(cols), np.nan)
    if len(hits):
        x, f = cols[hits].astype(float), gaps[hits] ** 2
        kept, starts = [0], [-np.inf]
        for q in range(1, len(x)):
            while True:
                p = kept[-1]
                cross = ((f[q] + x[q] ** 2) - (f[p] + x[p] ** 2)) / (2 * (x[q] - x[p]))
                if cross > starts[-1]:
                    break
                kept.pop()
                starts.pop()
            kept.append(q)
            starts.append(cross)
        # at a crossing itself the left parabola stands
        of = np.array(kept)[np.maximum(np.searchsorted(starts, cols, side="left") - 1, 0)]
        d2, near = (cols - x[of]) ** 2 + f[of], x[of]
    return lines.assign(d2=d2, near=near)


def nearest_any(df: DataFrame, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds d2, near_row and near_col of the nearest true cell however far, null in areas without one, by the two passes of the exact transform.

    Along each column the nearest true row comes from windows; then each row of cells is a task of its own, linear in its width. At equal distances the left column, then the upper row wins.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*by, "row", "col").schema}
    found = df.withColumn("at", _column_gap(df, F.coalesce(F.col(mask), F.lit(False)), by))
    gaps = found.select(*by, "row", "col", F.abs(F.col("at") - F.col("row")).cast("double").alias("gap"))
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", gap double, d2 double, near double"
    near = gaps.groupBy(*by, "row").applyInPandas(_row_distances, schema)
    near = near.select(*by, "row", "col", F.nanvl("d2", F.lit(None)).cast("long").alias("d2"), F.nanvl("near", F.lit(None)).cast("int").alias("near_col"))
    rows = found.select(*by, "row", F.col("col").alias("near_col"), F.col("at").alias("near_row"))
    return df.join(near.join(rows, [*by, "row", "near_col"], "left"), [*by, "row", "col"])


def best_source(df: DataFrame, sources: DataFrame, near: float, scale: float, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """sources: row, col, weight, place (order). Adds value and place of the strongest: weight, fading beyond near; the first in place wins ties.

    Each kind of source (place, weight), of which there are a few, has a distance field of its own.
    """
    kinds = sources.select("place", "weight").distinct()
    marks = sources.select(*by, "row", "col", "place", "weight").distinct().withColumn("there_", F.lit(True))
    every = df.select(*by, "row", "col").crossJoin(F.broadcast(kinds)).join(marks, [*by, "row", "col", "place", "weight"], "left")
    d = F.sqrt("d2")
    value = F.col("weight") * F.when(d <= near, 1.0).otherwise(F.exp(-(d - near) / scale))
    found = nearest_true(every, "there_", reach, [*by, "place", "weight"]).where("d2 is not null")
    best = found.groupBy(*by, "row", "col").agg(F.max(F.struct(value.alias("value"), (-F.col("place")).alias("place"))).alias("best"))
    return df.join(best, [*by, "row", "col"], "left").withColumns({"value": F.coalesce("best.value", F.lit(0.0)), "place": -F.col("best.place")}).drop("best")


def soft(df: DataFrame, mask: str, reach: float, name: str, by: Sequence[str] = (), exclude: str | None = None) -> DataFrame:
    """Adds name: 1 on the mask, fading to 0 at reach cells, 0 where `exclude` holds and where nothing is near."""
    near = nearest_true(df, mask, reach, by)
    value = fading(F.sqrt("d2"), reach)
    return near.withColumn(name, F.when(F.coalesce(F.col(exclude), F.lit(False)), 0.0).otherwise(value) if exclude else value).drop("d2", "near_row", "near_col")


def holes_filled(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """value, with null cells taking that of the nearest cell that has one; an area without any value is an error."""
    near = nearest_any(df.withColumn("has_", F.col(value).isNotNull()), "has_", by)
    given = df.select(*by, F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col(value).alias("given_"))
    out = near.join(given, [*by, "near_row", "near_col"], "left").withColumn(value, F.coalesce(value, "given_"))
    return out.withColumn(value, F.when(F.col("d2").isNull(), F.raise_error(F.lit("an area without any value"))).otherwise(F.col(value))).drop("has_", "given_", "d2", "near_row", "near_col")


def blurred(df: DataFrame, value: str, sigma: float, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian; from 8 cells on of the means of blocks of a quarter of sigma, edges repeated, and bilinear between them."""
    f = int(sigma // 4)
    if f < 2:
        return gaussian(df, value, sigma, height, width, by=by)
    beyond = lambda c, size: F.explode(F.when(F.col(c) == size - 1, F.sequence(F.lit(size - 1), F.lit(size - 1 + -size % f))).otherwise(F.array(F.col(c))))
    whole = df.select(*by, "row", "col", value).withColumn("row", beyond("row", height)).withColumn("col", beyond("col", width))
    high, wide = -(-height // f), -(-width // f)
    small = blocks(whole, f, F.avg(value).alias(value), by=by).withColumnsRenamed({"block_row": "row", "block_col": "col"})
    small = gaussian(small, value, sigma / f, high, wide, by=by).withColumnsRenamed({"row": "block_row", "col": "block_col"})
    return df.drop(value).join(upsampled(small, value, f, height, width, by), [*by, "row", "col"])


def upwind(df: DataFrame, z: str, cell: float, from_degrees: float, distances: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Adds shelter: the greatest horizon angle (degrees) over some distances in the direction that the wind comes from."""
    return df.join(horizon(df, z, cell, from_degrees, distances, "shelter", by), [*by, "row", "col"])


# Landforms by the number of lower directions (rows) and higher directions (columns); 0 is a slope too.
FLAT, PEAK, RIDGE, SHOULDER, SPUR, SLOPE, HOLLOW, FOOTSLOPE, VALLEY, PIT = range(1, 11)
LANDFORMS = (
    (1, 1, 1, 8, 8, 9, 9, 9, 10),
    (1, 1, 8, 8, 8, 9, 9, 9, 0),
    (1, 4, 6, 6, 7, 7, 9, 0, 0),
    (4, 4, 6, 6, 6, 7, 0, 0, 0),
    (4, 4, 5, 6, 6, 0, 0, 0, 0),
    (3, 3, 5, 5, 0, 0, 0, 0, 0),
    (3, 3, 3, 0, 0, 0, 0, 0, 0),
    (3, 3, 0, 0, 0, 0, 0, 0, 0),
    (2, 0, 0, 0, 0, 0, 0, 0, 0),
)


def landforms(df: DataFrame, z: str, cell: float, steps: int, flat_degrees: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds landform: by how many of the eight lines of sight of so many steps rise, and how many fall, by more than flat_degrees (the steeper of both counts)."""
    flat = math.radians(flat_degrees)

    def run(grids: Grids) -> Grids:
        wide = grids[z]
        here = inner(wide, steps)
        counts = np.zeros((2, *here.shape))
        for r, c in DIRECTIONS:
            up, down = np.full((2, *here.shape), -np.inf)
            for k in range(1, steps + 1):
                angle = np.arctan((inner(wide, steps, r * k, c * k) - here) / (math.hypot(r, c) * k * cell))
                up, down = np.fmax(up, angle), np.fmax(down, -angle)
            counts += (up > flat) & (up > down), (down > flat) & (down > up)
        return {"higher": counts[0], "lower": counts[1]}

    counts = haloed(df, [z], run, {"higher": "int", "lower": "int"}, steps, None, by)
    table = F.array(*(F.array(*map(F.lit, row)) for row in LANDFORMS))
    form = F.coalesce(F.get(F.get(table, F.col("lower")), F.col("higher")), F.lit(FLAT))
    return df.join(counts, [*by, "row", "col"], "left").withColumn("landform", F.when(form > 0, form).otherwise(SLOPE)).drop("higher", "lower")


def thermal(df: DataFrame, z: str, cell: float, height: int, width: int, sigma: float, aspect: tuple[float, float] = (100.0, 215.0), steep: float = 10.0, radius: float = 300.0, share: tuple[float, float] = (0.2, 0.45), by: Sequence[str] = ()) -> DataFrame:
    """Adds thermal: the share of the disc about each cell that is a slope of at least `steep` degrees facing into the sun, ramped; sigma: cells that z is smoothed by, from 0.3 on."""
    smooth = gaussian(df.select(*by, "row", "col", z), z, sigma, height, width, "nearest", by) if sigma > 0.3 else df.select(*by, "row", "col", z)
    faced = slopes(smooth, z, cell, by).withColumn("aspect", F.pmod(F.degrees(F.atan2("east", "north")) + 360, F.lit(360.0)))
    sunny = faced.withColumn("sunny_", (F.col("aspect") >= aspect[0]) & (F.col("aspect") <= aspect[1]) & (F.col("slope") >= steep))
    found = disc_share(sunny, "sunny_", radius / cell, by).select(*by, "row", "col", ramp("share", *share).alias("thermal"))
    return df.join(found, [*by, "row", "col"])


def low_ground(df: DataFrame, z: str, step: int, k: int, least: float, height: int, width: int, sigma: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds low: 1 at the bottom and 0 at the top of the heights of every step-th cell within k of these, smoothed; ranges below `least` count as that. Edges are mirrored."""
    coarse = df.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).select(*by, (F.col("row") / step).cast("int").alias("row"), (F.col("col") / step).cast("int").alias("col"), F.col(z).alias("lo_"), F.col(z).alias("hi_"))
    high, wide = -(-height // step), -(-width // step)
    for value, best in (("lo_", F.min), ("hi_", F.max)):
        # a mirrored edge holds nothing that the window has not yet, so it is left out
        coarse = _extremes(coarse, value, best, k, by)
    fine = df.select(*by, "row", "col").withColumns({"r_": (F.col("row") / step).cast("int"), "c_": (F.col("col") / step).cast("int")})
    up = fine.join(coarse.withColumnsRenamed({"row": "r_", "col": "c_"}), [*by, "r_", "c_"]).drop("r_", "c_")
    for value in ("lo_", "hi_"):
        up = gaussian(up, value, sigma, height, width, by=by)
    out = df.join(up, [*by, "row", "col"])
    return out.withColumn("low", clip(1 - (F.col(z) - F.col("lo_")) / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(least)))).drop("lo_", "hi_")


def _extremes(df: DataFrame, value: str, best, k: int, by: Sequence[str] = ()) -> DataFrame:
    for axis in ("col", "row"):
        _, w = _axis(by, axis)
        df = df.withColumn(value, best(value).over(w.rowsBetween(-k, k)))
    return df


def relief(df: DataFrame, z: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds relief: highest less lowest of the square of half-width k."""
    both = df.withColumns({"lo_": F.col(z), "hi_": F.col(z)})
    return _extremes(_extremes(both, "lo_", F.min, k, by), "hi_", F.max, k, by).withColumn("relief", F.col("hi_") - F.col("lo_")).drop("lo_", "hi_")


def travel_parts(df: DataFrame, z: str, radius: int, height: int, width: int, power: float = 2.0, floor: float = 3.0) -> DataFrame:
    """Adds pos, bottom and spine: the height against the mean of the square of half-width radius, as a signed rank among all cells (-1 lowest, 1 highest), and its power where it is
    below and above, faded out where that height is under `floor`."""
    at = box_mean(df.withColumn("mean_", F.col(z)), "mean_", radius, height, width).withColumn("t_", F.col(z) - F.col("mean_"))
    ranked = ranked_by_quantiles(at, "t_").withColumn("pos", 2 * F.col("position") - 1)
    line = F.pow(F.abs("pos"), F.lit(power)) * clip(F.abs("t_") / floor)
    return ranked.withColumns({"bottom": F.when(F.col("pos") < 0, line).otherwise(0.0), "spine": F.when(F.col("pos") > 0, line).otherwise(0.0)}).drop("mean_", "t_", "position")


def ranked_by_quantiles(df: DataFrame, value: str, shares: int = 201) -> DataFrame:
    """Adds position: the rank of value from 0 to 1, linear between so many exact quantiles; 0.5 where all are equal, null for null."""
    asked = [i / (shares - 1) for i in range(shares)]
    q = quantiles(df, value, asked).agg(F.array_sort(F.collect_list(F.struct("q", value))).alias("t"))  # `shares` values
    # strictly increasing, as ties would leave no slope to interpolate on
    top = F.greatest(F.lit(1.0), F.array_max(F.transform("t", lambda x: F.abs(x[value]))))
    q = q.withColumn("top", top).select(F.transform("t", lambda x, i: x[value] + i * 1e-9 * F.col("top")).alias("e"), (F.element_at("t", -1)[value] - F.element_at("t", 1)[value] > 1e-12).alias("wide"))
    k = F.size(F.filter("e", lambda e: e <= F.col(value)))
    part = (F.col(value) - F.element_at("e", k)) / (F.element_at("e", k + 1) - F.element_at("e", k))
    position = F.when(~F.col("wide"), 0.5).when(k == 0, 0.0).when(k >= shares, 1.0).otherwise((k - 1 + part) / (shares - 1))
    return df.crossJoin(F.broadcast(q)).withColumn("position", F.when(F.col(value).isNotNull(), position)).drop("e", "wide")


def blocks(df: DataFrame, size: int, *aggregates: Column, by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over square blocks of cells."""
    block = [F.floor(F.col(c) / size).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    return df.groupBy(*by, *block).agg(*aggregates)


def upsampled(coarse: DataFrame, value: str, factor: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Bilinear values at fine cells of block means (block_row, block_col, value), edges held."""
    fine = coarse.select(*by).distinct().crossJoin(cells(coarse.sparkSession, height, width)) if by else cells(coarse.sparkSession, height, width)
    parts, corner = [], []
    for axis, size in (("row", height), ("col", width)):
        x = (F.col(axis) + 0.5) / factor - 0.5
        last = -(-size // factor) - 1
        low = F.floor(x)
        hold = lambda v, last=last: F.least(F.greatest(v, F.lit(0)), F.lit(last)).cast("int")
        parts.append(F.array(F.struct(hold(low).alias("at"), (1 - (x - low)).alias("w")), F.struct(hold(low + 1).alias("at"), (x - low).alias("w"))))
        corner.append(f"{axis}_c")
    spread_ = fine.withColumn("row_c", F.explode(parts[0])).withColumn("col_c", F.explode(parts[1]))
    keyed = spread_.withColumns({"block_row": F.col("row_c.at"), "block_col": F.col("col_c.at"), "w": F.col("row_c.w") * F.col("col_c.w")})
    return keyed.join(coarse, [*by, "block_row", "block_col"]).groupBy(*by, "row", "col").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def shifted(df: DataFrame, dr: int, dc: int, height: int, width: int) -> DataFrame:
    """Layers rolled about the torus."""
    return df.withColumns({"row": F.pmod(F.col("row") + dr, F.lit(height)), "col": F.pmod(F.col("col") + dc, F.lit(width))})


def neighbours(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), directions: Sequence[tuple[int, int]] = DIRECTIONS) -> DataFrame:
    """Each cell with each of its neighbours: dir, step (cells), and the neighbour's columns as to_<name>."""
    moves = F.array(*(F.struct(F.lit(i).alias("dir"), F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(math.hypot(r, c)).alias("step")) for i, (r, c) in enumerate(directions)))
    left = df.withColumn("move", F.explode(moves)).withColumns({"to_row": F.col("row") + F.col("move.dr"), "to_col": F.col("col") + F.col("move.dc"), "dir": F.col("move.dir"), "step": F.col("move.step")}).drop("move")
    return left.join(df.select(*by, F.col("row").alias("to_row"), F.col("col").alias("to_col"), *(F.col(c).alias(f"to_{c}") for c in columns)), [*by, "to_row", "to_col"])


def receivers(df: DataFrame, z: str, cell: float, by: Sequence[str] = ()) -> DataFrame:
    """The steepest strictly lower neighbour of each cell: receiver_row, receiver_col, null in pits; the first direction wins ties."""
    drop = (F.col(z) - F.col(f"to_{z}")) / (F.col("step") * cell)
    best = neighbours(df.select(*by, "row", "col", z), [z], by).withColumn("drop", drop).where("drop > 0")
    best = best.groupBy(*by, "row", "col").agg(F.max(F.struct("drop", (-F.col("dir")).alias("d"), "to_row", "to_col")).alias("best"))
    return df.join(best, [*by, "row", "col"], "left").withColumns({"receiver_row": F.col("best.to_row"), "receiver_col": F.col("best.to_col")}).drop("best")


def peaks(df: DataFrame, value: str, spacing: int, least: float | None, by: Sequence[str] = ()) -> DataFrame:
    """Cells above least (null: with a value) that are the largest of the square of half-width spacing; equal ones in it: the first in row-major order."""
    wide = df
    order = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))
    wide = wide.withColumn("top", order)
    for axis in ("col", "row"):
        _, w = _axis(by, axis)
        wide = wide.withColumn("top", F.max("top").over(w.rowsBetween(-spacing, spacing)))
    high = F.col(value).isNotNull() if least is None else F.col(value) > least
    return wide.where((F.col("top") == order) & high).drop("top")
