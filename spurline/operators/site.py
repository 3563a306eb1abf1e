"""Layers of a camera site as compositions of the grid operators: edges, pinches, water, season, travel, access, approaches, what lies beside a spot.

Tables hold every cell of a rectangle; lengths are metres, `cell` is the width of a cell. Layers that later steps read several times are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.functions import scalar as S
from spurline.functions.scalar import clip, ramp, sector, walking_kmh
from spurline.operators import graph, lattice, squares
from spurline.operators.store import keep


def hunting_edge(df: DataFrame, canopy: str, meadow: str, cell: float, by: Sequence[str] = (), hide: float = 8.0, view: float = 60.0, full: float = 15.0, reach: float = 25.0, cover_radius: float = 30.0, cover_share: float = 0.25, weight: float = 1.0) -> DataFrame:
    """Adds edge: in cover close to a meadow in sight, up to 75 m back, or in the meadow beside real cover; the better of both."""
    at = df.withColumn("cover_", F.col(canopy) >= 4.0)
    for mask, radius, name in (("cover_", hide, "hide_"), (meadow, view, "view_"), ("cover_", cover_radius, "real_")):
        at = lattice.disc_share(at, mask, radius / cell, by).withColumnRenamed("share", name)
    for mask, far, name in ((meadow, 75.0, "open_"), ("cover_", reach, "near_")):
        at = lattice.nearest_true(at, mask, far / cell, by).withColumn(name, F.sqrt("d2") * cell).drop("d2", "near_row", "near_col")
    close = F.when(F.col("open_") > 0, clip(1 - (F.col("open_") - 35) / 40)).otherwise(0.0)
    in_cover = clip((F.col("hide_") - 0.35) / 0.45) * clip(F.col("view_") / 0.30) * close
    near = F.when(F.col("near_").isNull(), 0.0).otherwise(clip(1 - (F.col("near_") - full) / (reach - full)))
    in_open = F.when(F.col(meadow), near * clip(F.col("real_") / cover_share) * weight).otherwise(0.0)
    return at.withColumn("edge", F.greatest(in_cover, in_open)).drop("cover_", "hide_", "view_", "real_", "open_", "near_")


def with_lines(edge: Column, lines: Sequence[Column]) -> Column:
    """An edge that travel lines make better: the strongest of all, and 0.15 for each of up to two lines over 0.15 where the edge itself is over 0.3."""
    n = sum(((x > 0.15).cast("int") for x in lines), F.lit(0))
    return clip(F.greatest(edge, *lines) + F.when(edge > 0.3, 0.15 * F.least(n, F.lit(2))).otherwise(0.0))


def pinched(parts: Sequence[Column]) -> Column:
    """The strongest pinch, and 0.1 for each further one over 0.3."""
    n = sum(((x > 0.3).cast("int") for x in parts), F.lit(0))
    return clip(F.greatest(*parts) + 0.1 * F.greatest(n - 1, F.lit(0)))


def scarcity(df: DataFrame, permanent: str, limited: str, radius: float, by: Sequence[str] = (), dense: float = 0.04) -> DataFrame:
    """Adds scarcity, 0.75 to 1: more where little of the disc of so many cells is permanent water, and few different limited sources (regions of touching cells, corners too, by their middle) are in it."""
    spots = graph.regions(df.where(limited).select(*by, "row", "col"), by, diagonal=True).groupBy(*by, "label").agg(F.floor(F.avg("row")).cast("int").alias("row"), F.floor(F.avg("col")).cast("int").alias("col"))
    seeds = spots.select(*by, "row", "col").distinct().withColumn("one_", F.lit(1).cast("long"))
    at = lattice.disc_sum(lattice.disc_share(df, permanent, radius, by).withColumnRenamed("share", "wet_"), seeds, "one_", radius, by)
    unique = 1 / (1 + 0.15 * F.greatest(F.col("total") - 1, F.lit(0)))
    return at.withColumn("scarcity", 0.75 + 0.25 * clip(1 - F.col("wet_") / dense) * unique).drop("wet_", "total")


def water_score(value: Column, scarce: Column, lake: Column) -> Column:
    return F.when(lake, 0.0).otherwise(clip(value * scarce))


def season(month: int, snow: Column, low: Column, sunny: Column, ranged: Column, floor: float = 0.6) -> Column:
    """From November to April a share of the habitat that grows with shallow snow, low and sunny ground, times the winter range's factor from December to March; else 1."""
    if month not in (11, 12, 1, 2, 3, 4):
        return F.lit(1.0)
    value = floor + (1 - floor) * snow * (0.5 + 0.5 * low) * (0.5 + 0.5 * sunny)
    return value * ranged if month in (12, 1, 2, 3) else value


def travel(bottom: Column, spine: Column, grade: Column, gate: Column, thermal: Column) -> Column:
    """Bottoms on gentle ground, and spines by half, or fully at a gate or above sun-warmed slopes."""
    return bottom * grade + spine * (0.5 + 0.5 * F.greatest(gate, thermal))


def walks(df: DataFrame, slope: str, road: str, closed: str, cell: float, by: Sequence[str] = (), longest: float = 2414.0, tile: int = 256) -> DataFrame:
    """Adds walk_s and walk_m: the quickest walk from an open road over the ground that isn't closed, by Tobler's pace; null where none leads within 1.5 times longest."""
    pace = F.when(~F.col(closed), 3.6 / walking_kmh(slope))
    ways = graph.least_cost(df.select(*by, "row", "col", pace.alias("pace_"), F.col(road).alias("road_")), "pace_", "road_", cell, by, longest=1.5 * longest, tile=tile)
    return df.join(ways.select(*by, "row", "col", F.col("reach").alias("walk_s"), F.col("length").alias("walk_m")), [*by, "row", "col"], "left")


def capped_distance(df: DataFrame, mask: str, name: str, cell: float, cap: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds name: the distance to the nearest true cell, at most cap."""
    near = lattice.nearest_any(df.select(*by, "row", "col", mask), mask, by).select(*by, "row", "col", F.least(F.coalesce(F.sqrt("d2") * cell, F.lit(cap)), F.lit(cap)).alias(name))
    return df.join(near, [*by, "row", "col"])


def approaches(df: DataFrame, cost: str, dest: str, origin: str, covered: str, by_cover: Column, flow: tuple[str, str], cell: float, front: float, cutoff: float, last: float, taper: tuple[float, float], tile: int = 256) -> DataFrame:
    """Adds approach, 0 to 1, and root (row * width of the way's end): where the cheapest ways from origin cells to the destinations come together under cover, near their end and downwind of it.

    flow: columns east and north of the air's way at each cell; the destination's own counts. Widths of a way are measured against a front of so many metres.
    """
    cells = keep(df)
    ways = keep(graph.least_cost(cells.select("row", "col", cost, dest), cost, dest, cell, cutoff=cutoff, tile=tile).join(cells.select("row", "col", covered), ["row", "col"]))
    tree = keep(graph.covered_share(ways, covered, cell, last))
    at = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    weights = tree.where("reach is not null").join(cells.select("row", "col", F.when(F.col(origin), cell * cell).otherwise(0.0).alias("w")), ["row", "col"])
    receiver = F.when(F.col("from_row").isNotNull(), at("from_row", "from_col"))
    flows = graph.accumulated(weights.select(at("row", "col").alias("id"), receiver.alias("receiver"), "w"), "w").select(F.col("id.r").alias("row"), F.col("id.c").alias("col"), "total")
    conv = clip(F.log10(F.greatest("total", F.lit(1e-9)) / (front * cell)))
    wide = cells.select("row", "col").join(flows.select("row", "col", conv.alias("conv")), ["row", "col"], "left").withColumn("conv", F.coalesce("conv", F.lit(0.0)))
    for axis in ("col", "row"):
        other = "row" if axis == "col" else "col"
        wide = wide.withColumn("conv", F.max("conv").over(Window.partitionBy(other).orderBy(axis).rowsBetween(-1, 1)))
    ends = cells.select(F.col("row").alias("root_row"), F.col("col").alias("root_col"), F.col(flow[0]).alias("air_east_"), F.col(flow[1]).alias("air_north_"))
    d = lattice.nearest_any(cells.select("row", "col", dest), dest).select("row", "col", (F.sqrt("d2") * cell).alias("d_dest"))
    full = cells.join(wide, ["row", "col"]).join(tree.select("row", "col", "share", "root_row", "root_col"), ["row", "col"]).join(ends, ["root_row", "root_col"], "left").join(d, ["row", "col"])
    east, north = F.col("col") - F.col("root_col"), F.col("root_row") - F.col("row")
    far = F.hypot(east, north)
    q = F.when(far > 0, clip(0.5 + 0.5 * (east * F.col("air_east_") + north * F.col("air_north_")) / F.greatest(far, F.lit(1e-6)))).otherwise(0.5)
    near = clip(1 - (F.col("d_dest") - taper[0]) / (taper[1] - taper[0]))
    value = F.col("conv") * F.sqrt(clip(F.col("share")) * by_cover) * (0.5 + 0.5 * q) * near
    return full.withColumn("approach", F.when(F.col("root_row").isNull() | F.col(dest), 0.0).otherwise(value)).select("row", "col", "approach", "root_row", "root_col")


def alternates(spots: DataFrame, cells: DataFrame, cell: float, search: float = 150.0, least: float = 30.0, share: float = 0.5, apart: float = 100.0, open_road: float = 20.0) -> DataFrame:
    """spots: id, row, col, score. cells: row, col, score, kind (0: no quiet line), road, rec (distances). Per spot that is on no line itself the best cell on one within search: it scores enough, is apart from
    recreation sites, and off open roads if any such is there; ties in row-major order. Adds distance (metres), direction and is_open.

    Spots and cells meet by squares as wide as the search reaches."""
    k = math.ceil(search / cell)
    square = lambda c: F.floor(F.col(c) / k).cast("int")
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    own = cells.select("row", "col", F.col("kind").alias("own_kind"))
    asked = spots.join(own, ["row", "col"]).where("own_kind = 0").withColumn("dr", around).withColumn("dc", around)
    asked = asked.select("id", F.col("row").alias("r"), F.col("col").alias("c"), F.col("score").alias("of"), (square("row") + F.col("dr")).alias("sr"), (square("col") + F.col("dc")).alias("sc"))
    lines = cells.where((F.col("kind") > 0) & (F.col("score") > 0) & (F.col("rec") >= apart)).withColumns({"sr": square("row"), "sc": square("col")})
    d = F.hypot(F.col("row") - F.col("r"), F.col("col") - F.col("c")) * cell
    met = asked.join(lines, ["sr", "sc"]).withColumn("distance", d).where((F.col("distance") <= search) & (F.col("score") >= F.greatest(F.lit(least), share * F.col("of")))).withColumn("is_open", F.col("road") <= open_road)
    best = met.groupBy("id").agg(F.min(F.struct("is_open", (-F.col("score")).alias("s"), "row", "col", "distance", "kind", "r", "c")).alias("b"))
    way = F.degrees(F.atan2(F.col("b.col") - F.col("b.c"), F.col("b.r") - F.col("b.row")))
    return best.select("id", "b.row", "b.col", (-F.col("b.s")).alias("score"), "b.distance", sector(way).alias("direction"), "b.is_open", "b.kind")


def line_hint(distance: Column, direction: Column, cell: float, facing: float = 15.0) -> Column:
    """What a worn line so far away means for a camera; null without one."""
    what, far = F.lit("a worn line on no map"), F.round(distance).cast("int").cast("string")
    through = F.concat(what, F.lit(" runs through this spot: hang the camera beside it, facing along it"))
    close = F.concat(what, F.lit(" "), far, F.lit(" m "), direction, F.lit(": hang the camera facing it"))
    farther = F.concat(what, F.lit(" "), far, F.lit(" m "), direction, F.lit(": hang the camera a few metres toward it, facing it"))
    return F.when(distance <= cell, through).when(distance <= facing, close).when(distance.isNotNull(), farther)


def hints(spots: DataFrame, cells: DataFrame, mask: str, cell: float, reach: float = 30.0) -> DataFrame:
    """spots: id, row, col. Per spot with a true cell within reach: its distance (metres), direction and a hint."""
    near = lattice.nearest_true(cells.select("row", "col", mask), mask, reach / cell).where("d2 is not null").select("row", "col", (F.sqrt("d2") * cell).alias("distance"), "near_row", "near_col")
    way = F.degrees(F.atan2(F.col("near_col") - F.col("col"), F.col("row") - F.col("near_row")))
    found = spots.join(near, ["row", "col"]).withColumn("direction", sector(way))
    return found.select("id", F.round("distance", 4).alias("distance"), "direction", line_hint(F.col("distance"), F.col("direction"), cell).alias("hint"))


def gentle_slope(df: DataFrame, z: str, cell: float, height: int, width: int, sigma: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds grade: 1 to 8 degrees of the smoothed height, down to 0.5 at 25."""
    smooth = lattice.gaussian(df.select(*by, "row", "col", z), z, sigma, height, width, "nearest", by) if sigma > 0.3 else df.select(*by, "row", "col", z)
    found = lattice.slopes(smooth, z, cell, by).select(*by, "row", "col", (1 - 0.5 * ramp("slope", 8, 25)).alias("grade"))
    return df.join(found, [*by, "row", "col"])


def _downhill(df: DataFrame, z: str, sigma: float, cell: float, prefix: str, by: Sequence[str]) -> DataFrame:
    """by, row, col and prefix_east, prefix_north, prefix_rise: the way down the ground smoothed by sigma cells, and its slope."""
    ground = df.select(*by, "row", "col", F.col(z).cast("double").alias(z))
    smooth = squares.blurred(ground, z, sigma, "edge", by) if sigma > 0.3 else ground
    return lattice.slopes(smooth, z, cell, by).select(*by, "row", "col", *(F.col(c).alias(f"{prefix}_{c}") for c in ("east", "north", "rise")))


def wind(df: DataFrame, z: str, cell: float, from_degrees: float, consistency: float, by: Sequence[str] = ()) -> DataFrame:
    """df: all cells with z, landform, tpi (height against its surroundings) and sca (what drains through per metre). by, row, col and the wind factor and its parts:

    drain: cold air running down, spread over the valley floor; flow_east, flow_north: where air moves at dawn and dusk, from drainage in low and sheltered places and from the wind, led along valleys, in exposed ones; agree: the cosine of drainage and wind;
    conv: both the same way in a valley; windward: slopes facing the wind within 100 m of a crest; wind: the stronger of steady drainage and windward, less where the wind is not consistent.
    """
    wx, wn = -math.sin(math.radians(from_degrees)), -math.cos(math.radians(from_degrees))
    keys = [*by, "row", "col"]
    half = max(3, int(40 / cell) | 1) // 2
    strength = df.select(*keys, S.drainage_strength("sca").alias("own_")).withColumn("most_", F.col("own_"))
    spread = lattice._extremes(strength, "most_", F.max, half, by).select(*keys, F.greatest("own_", 0.85 * F.col("most_")).alias("spread_"))
    parts = keep(squares.blurred(keep(spread), "spread_", 20 / cell, "symmetric", by))
    near, wide = keep(_downhill(df, z, 60 / cell, cell, "d", by)), keep(_downhill(df, z, 200 / cell, cell, "v", by))
    reach = [cell + i * (300.0 - cell) / 11 for i in range(12)]
    lee = keep(squares.horizon(df.select(*keys, z), z, cell, from_degrees, reach, "lee_", by))
    crest = lattice.nearest_any(df.select(*keys, F.col("landform").isin(lattice.RIDGE, lattice.PEAK, lattice.SHOULDER).alias("crest_")), "crest_", by)
    at = df.select(*keys, "tpi")
    for other in (parts, near, wide, lee, crest.select(*keys, clip(1 - F.sqrt("d2") * cell / 100).alias("close_"))):
        at = at.join(other, keys)
    exposed, shelter, rise = 1 / (1 + F.exp(-F.col("tpi") / 12.0)), clip(F.col("lee_") / 10.0), F.col("d_rise")
    at = keep(at.withColumns({"e_": exposed, "shelter_": shelter, "drain": F.col("spread_") * clip(rise / 0.05, 0.3, 1.0), "along_": F.col("v_east") * wx + F.col("v_north") * wn}))
    led = lambda w, axis: F.col("e_") * w + (1 - F.col("e_")) * F.col("along_") * F.col(f"v_{axis}") + 1e-6 * F.col(f"d_{axis}")
    at = at.withColumn("led_", S.normalised(led(wx, "east"), led(wn, "north"))).withColumn("beta_", clip(0.3 + 0.5 * (1 - F.col("e_")) + 0.2 * F.col("shelter_"), 0.0, 0.95))
    moved = lambda axis: F.col("beta_") * F.col(f"d_{axis}") + (1 - F.col("beta_")) * F.col(f"led_.{axis}")
    down = F.col("d_east") * wx + F.col("d_north") * wn
    agree = clip(F.col("e_") * down + (1 - F.col("e_")) * (F.col("d_east") * F.col("v_east") + F.col("d_north") * F.col("v_north")) * F.col("along_"), -1.0, 1.0)
    at = at.withColumns({"flow_": S.normalised(moved("east"), moved("north")), "agree": agree, "windward": clip(-down) * F.coalesce("close_", F.lit(0.0)) * clip(rise / 0.15) * (1 - F.col("shelter_"))})
    steady = F.col("drain") * (0.5 + 0.5 * (1 + F.col("agree")) / 2)
    return at.select(
        *keys, "drain", F.col("flow_.east").alias("flow_east"), F.col("flow_.north").alias("flow_north"), "agree", (F.pow((1 + F.col("agree")) / 2, F.lit(2.0)) * F.col("drain") * clip(1.2 - F.col("e_"))).alias("conv"), "windward",
        clip(F.greatest(steady, 0.6 * F.col("windward")) * (0.7 + 0.3 * min(max(consistency, 0.0), 1.0))).alias("wind"),
    )


def saddle_discs(df: DataFrame, found: DataFrame, cell: float, least: float = 8.0, by: Sequence[str] = ()) -> DataFrame:
    """Adds saddle: the best of the saddles within six rows and columns, each a soft disc of 25 m worth 0.25 to 1 by the climb that it saves."""
    near = F.explode(F.sequence(F.lit(-6), F.lit(6)))
    worth = clip((F.col("rise") - least) / 40, 0.25, 1.0)
    drawn = found.select(*by, "row", "col", worth.alias("w_")).withColumn("dr", near).withColumn("dc", near)
    drawn = drawn.select(*by, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (F.col("w_") * F.exp(-(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * (cell * cell / 1250.0))).alias("v_"))
    best = drawn.groupBy(*by, "row", "col").agg(F.max("v_").alias("saddle"))
    return df.join(best, [*by, "row", "col"], "left").withColumn("saddle", F.coalesce("saddle", F.lit(0.0)))


def resistance(slope: Column, cliff: Column, lake: Column, bare: Column, road: Column) -> Column:
    """What ground resists movement: 1 on easy ground, more on slopes (degrees) and roads, in the open, far more on cliffs and lakes; all but slope as shares of the cell."""
    return 1 + 25 * F.pow(clip(slope / 45, 0.0, 1.5), F.lit(2.0)) + 150 * cliff + 400 * lake + 1.5 * bare + 4 * road
