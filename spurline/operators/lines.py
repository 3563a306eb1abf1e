"""Narrow lines in fine ground: oriented filters, noise, thinning to one cell, and lines of points."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.operators.evidence import robust_spread
from spurline.operators.graph import regions, sized_regions
from spurline.operators.ranks import numbered
from spurline.operators.squares import Grids, bilinear, haloed, inner, smoothed
from spurline.operators.store import keep, written

#: Cells that a square looks at beyond its own: the filters' half-length, the smoothing of the slope and the steps of the bench test.
MARGIN = 32


@dataclass(frozen=True)
class Worn:
    """Settings of the line detector, in cells (of 1 m) and degrees. Fixed values."""

    across: tuple[float, ...] = (1.0, 2.0)
    along: float = 6.0
    directions: int = 12
    flat: float = 8.0
    off_fall: float = 40.0
    bench: float = 0.7
    fall_smooth: float = 5.0
    low: float = 4.0
    high: float = 7.0
    least_patch: int = 16
    least_line: int = 40
    creek: float = 10.0
    creek_degrees: float = 30.0


def trough(across: float, along: float, angle: float) -> np.ndarray:
    """A filter that answers to a trough along an angle (from columns to rows): minus the second derivative across an elongated Gaussian, of mean 0 and absolute sum 10 across^2."""
    half = int(3 * along)
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    over, on = y * math.cos(angle) - x * math.sin(angle), x * math.cos(angle) + y * math.sin(angle)
    bell = np.exp(-0.5 * ((over / across) ** 2 + (on / along) ** 2))
    wave = bell * ((over / across) ** 2 - 1) / across**2
    wave = wave - wave.mean()
    return wave * (10 * across**2 / np.abs(wave).sum())


@lru_cache(maxsize=4)
def _spectra(s: Worn, shape: tuple[int, int]) -> list[list[np.ndarray]]:
    """Of every scale and direction the filter's spectrum for squares of a shape, centred on the first cell."""

    def spectrum(k: np.ndarray) -> np.ndarray:
        wide = np.zeros(shape)
        wide[: len(k), : len(k)] = k
        return np.conj(np.fft.rfft2(np.roll(wide, (-(len(k) // 2),) * 2, axis=(0, 1))))

    return [[spectrum(trough(a, s.along, i * math.pi / s.directions)) for i in range(s.directions)] for a in s.across]


def fall_line(z: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope in degrees and the uphill angle (from columns to rows) of ground smoothed by sigma cells."""
    gy, gx = np.gradient(smoothed(z, sigma))
    return np.degrees(np.arctan(np.hypot(gx, gy))), np.arctan2(gy, gx)


def responses(df: DataFrame, z: str, by: Sequence[str] = (), s: Worn = Worn(), tile: int = 512) -> DataFrame:
    """by, row, col and for each scale k: best{k}, the strongest answer of the filters, and dir{k}, its direction; null where no direction is allowed.

    On ground of at least s.flat degrees only directions at least s.off_fall degrees off the fall line count. Each square is filtered by the Fourier transform of itself and its margin (overlap-save: what wraps around stays in the margin);
    beyond the area the ground goes on mirrored through its last cell.
    """

    def run(grids: Grids) -> Grids:
        wide = grids[z]
        shape = tuple(-(-n // 64) * 64 for n in wide.shape)  # few shapes, so that spectra are made once
        slope, fall = (inner(a, MARGIN) for a in fall_line(wide, s.fall_smooth))
        seen = np.fft.rfft2(wide, s=shape)
        angles = [i * math.pi / s.directions for i in range(s.directions)]
        limit = math.cos(math.radians(s.off_fall)) + 1e-12
        allowed = [(slope < s.flat) | (np.abs(np.cos(fall - a)) <= limit) for a in angles]
        out = {}
        for k, spectra in enumerate(_spectra(s, shape)):
            each = np.stack([np.where(ok, inner(np.fft.irfft2(seen * f, s=shape)[: wide.shape[0], : wide.shape[1]], MARGIN), -np.inf) for ok, f in zip(allowed, spectra)])
            best = each.max(axis=0)
            there = np.isfinite(best)
            out[f"best{k}"], out[f"dir{k}"] = np.where(there, best, np.nan), np.where(there, each.argmax(axis=0), np.nan)
        return out

    kinds = {f"{name}{k}": kind for k in range(len(s.across)) for name, kind in (("best", "double"), ("dir", "int"))}
    return haloed(df, [z], run, kinds, MARGIN, "odd", by, tile)


def strengths(df: DataFrame, z: str, inside: str, by: Sequence[str] = (), s: Worn = Worn(), tile: int = 512) -> DataFrame:
    """by, row, col, strength (in units of the noise, 0 where a test fails or outside) and direction of the trough at each cell.

    Two phases: all squares' answers give each scale's noise over the inside of its area; then the stronger scale is taken, and on slopes it has to be a bench: within 2 cells below it the ground is flatter than
    s.bench times the steepest fill 3 to 7 cells below and cut 2 to 7 above.
    """
    found = keep(responses(df, z, by, s, tile).join(df.select(*by, "row", "col", z, F.coalesce(F.col(inside), F.lit(False)).alias("in_")), [*by, "row", "col"]))
    for k in range(len(s.across)):
        units = robust_spread(found.where("in_"), f"best{k}", by).withColumnRenamed("spread", f"noise{k}")
        found = found.join(units, list(by), "left") if by else found.join(F.broadcast(units), F.lit(True), "left")  # without by one row, or none
    # the first of equal scales wins
    scaled = [F.struct((F.col(f"best{k}") / F.coalesce(f"noise{k}", F.lit(1.0))).alias("v"), F.lit(-k).alias("k"), F.col(f"dir{k}").alias("d")) for k in range(len(s.across))]
    best = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
    merged = found.withColumn("best_", best).select(*by, "row", "col", z, F.when(F.col("in_"), F.coalesce("best_.v", F.lit(0.0))).otherwise(0.0).alias("strength"), F.coalesce("best_.d", F.lit(0)).alias("direction"))

    def run(grids: Grids) -> Grids:
        wide = grids[z]
        slope, fall = (inner(a, MARGIN) for a in fall_line(wide, s.fall_smooth))
        strength = inner(grids["strength"], MARGIN).copy()
        r, c = np.nonzero((strength >= s.low) & (slope >= s.flat))
        if len(r):
            fine, up = fall_line(wide, 1.0)[0], fall[r, c]
            at = lambda d: bilinear(fine, r + MARGIN - d * np.sin(up), c + MARGIN - d * np.cos(up))  # noqa: E731  slope so far downhill
            tread, fill, cut = np.min([at(d) for d in (0, 1, 2)], axis=0), np.max([at(d) for d in (3, 5, 7)], axis=0), np.max([at(-d) for d in (2, 4, 7)], axis=0)
            bad = ~((tread < s.bench * fill) & (tread < s.bench * cut))
            strength[r[bad], c[bad]] = 0.0
        return {"strength": strength, "direction": inner(grids["direction"], MARGIN)}

    return haloed(keep(merged), [z, "strength", "direction"], run, {"strength": "double", "direction": "int"}, MARGIN, "odd", by, tile)


def strong_patches(df: DataFrame, value: str, low: float, high: float, least: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells of at least `low` in touching patches (no corners) of at least so many cells with one of at least `high`: strong cells grow through weak ones."""
    weak = keep(df.where(F.col(value) >= low).select(*by, "row", "col", value))
    labelled = regions(weak, by).join(weak, [*by, "row", "col"])
    good = labelled.groupBy(*by, "label").agg(F.max(value).alias("top_"), F.count(F.lit(1)).alias("n_")).where((F.col("top_") >= high) & (F.col("n_") >= least))
    return labelled.join(good, [*by, "label"], "left_semi").select(*by, "row", "col")


def _around(a: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each cell, north first, clockwise; nothing beyond the edges."""
    wide = np.pad(a, 1)
    h, w = a.shape
    return [wide[1 + r : 1 + r + h, 1 + c : 1 + c + w] for r, c in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thinner(a: np.ndarray) -> np.ndarray:
    """One round of parallel thinning (Zhang and Suen 1984): border cells go if that breaks no line and shortens none, from the south-east and then from the north-west."""
    for first in (True, False):
        p = _around(a)
        count, turns = sum(x.astype(int) for x in p), sum((~x & y).astype(int) for x, y in zip(p, p[1:] + p[:1]))
        n, e, so, w = p[0], p[2], p[4], p[6]
        three = ~(n & e & so) & ~(e & so & w) if first else ~(n & e & w) & ~(n & so & w)
        a = a & ~((count >= 2) & (count <= 6) & (turns == 1) & three)
    return a


def thinned(mask: DataFrame, by: Sequence[str] = (), tile: int = 256, margin: int = 32) -> DataFrame:
    """mask: true cells (by, row, col). The skeleton: what is left of them when thinning changes nothing any more.

    A round of squares thins as often as its margin allows without a neighbour's change being missed, half of it, so rounds count the width of patches over the margin, and the skeleton is the same whatever the squares.
    """

    def run(grids: Grids) -> Grids:
        a = grids["on_"] == 1
        for _ in range(margin // 2):
            after = thinner(a)
            if (after == a).all():
                break
            a = after
        return {"kept_": inner(a, margin)}

    state = keep(mask.select(*by, "row", "col").withColumn("on_", F.lit(1)))
    before = state.count()
    while True:
        state = keep(haloed(state, ["on_"], run, {"kept_": "boolean"}, margin, None, by, tile).where("kept_").select(*by, "row", "col", F.lit(1).alias("on_")))
        left = state.count()
        if left == before:
            return state.drop("on_")
        before = left


def _steps(skeleton: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, row, col, n (touching cells) and to: the moves to the next cells of a skeleton to the east and south; aslant only where neither square way is there."""

    def run(grids: Grids) -> Grids:
        a = grids["on_"] == 1
        n, ne, e, se, so, sw, w, nw = (inner(x, 1) for x in _around(a))
        return {"n": sum(x.astype(float) for x in (n, ne, e, se, so, sw, w, nw)), "e": e, "s": so, "se": se & ~e & ~so, "sw": sw & ~w & ~so}

    return haloed(skeleton.select(*by, "row", "col").withColumn("on_", F.lit(1)), ["on_"], run, {"n": "int", "e": "boolean", "s": "boolean", "se": "boolean", "sw": "boolean"}, 1, None, by)


def junctions(skeleton: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cells of a skeleton with three or more others about them."""
    return _steps(skeleton, by).where("n >= 3").select(*by, "row", "col")


def _followed(edges: DataFrame) -> DataFrame:
    """edges: id, next (null at an end). Adds last (the id at the end of its way, null on a ring), depth (steps to it) and low (the least id on the way, or of the ring), by pointer doubling.

    Ways still open are counted each round: if none of them has ended, all are rings, as the ones nearest to an end always do.
    """
    state = written(edges.select("id", F.col("next").alias("jump"), F.when(F.col("next").isNull(), F.col("id")).alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("id").alias("low")))
    open_, lows = state.where("jump is not null").count(), -1
    while open_:
        onward = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump_"), F.col("last").alias("last_"), F.col("depth").alias("depth_"), F.col("low").alias("low_"))
        moved = state.join(onward, "jump", "left")
        state = written(moved.select("id", F.when(F.col("jump").isNotNull(), F.col("jump_")).alias("jump"), F.coalesce("last", "last_").alias("last"), (F.col("depth") + F.coalesce("depth_", F.lit(0))).alias("depth"), F.least("low", F.coalesce("low_", "low")).alias("low"), (F.col("low_") < F.col("low")).alias("lower")))
        left = state.where("jump is not null").count()
        lower = state.where("jump is not null and lower").count()
        state = state.drop("lower")
        if left == open_ and lower == 0 and lows == 0:
            break  # rings, whose least ids have gone round
        open_, lows = left, lower
    return edges.join(state.select("id", "last", "depth", "low"), "id")


_SHIFT = 1 << 32


def traced(skeleton: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, line, k, row, col: a skeleton as lines of cells in order, from end or junction to the next; rings begin and end at their first cell.

    Every step between two cells is in one line, once. Steps are followed both ways by pointer doubling, in as many rounds as the logarithm of the longest line; of both ways of a line the one whose beginning comes first
    in row-major order is kept. Lines are numbered in that order.
    """
    steps = keep(_steps(skeleton, by))
    cell = lambda r, c: r.cast("long") * _SHIFT + c.cast("long")
    moves = [F.when(F.col(k), F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c"))) for k, r, c in (("e", 0, 1), ("s", 1, 0), ("se", 1, 1), ("sw", 1, -1))]
    there = steps.withColumn("m", F.explode(F.filter(F.array(*moves), lambda m: m.isNotNull()))).select(*by, cell(F.col("row"), F.col("col")).alias("a"), cell(F.col("m.r"), F.col("m.c")).alias("b"))
    place = F.struct(*by, F.col("a"), F.col("b"))
    both = keep(there.unionByName(there.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))))
    # where just two steps meet the one goes on as the other
    ends = both.groupBy(*by, "a").agg(F.collect_list("b").alias("to")).where(F.size("to") == 2)  # at most eight

    def turn(i: int, j: int) -> Column:
        before, after = F.struct(*by, F.element_at("to", i).alias("a"), F.col("a").alias("b")), F.struct(*by, F.col("a"), F.element_at("to", j).alias("b"))
        return F.struct(before.alias("id"), after.alias("next"))

    follow = ends.select(F.explode(F.array(turn(1, 2), turn(2, 1))).alias("turn")).select("turn.*")
    edges = keep(both.select(place.alias("id")).join(follow, "id", "left"))
    found = keep(_followed(edges))

    rings = found.where("last is null")
    if not rings.isEmpty():
        # of both ways round the one with the lesser step, begun there
        back = F.struct(*(F.col(f"id.{c}").alias(c) for c in by), F.col("id.b").alias("a"), F.col("id.a").alias("b"))
        other = rings.select(back.alias("id"), F.col("low").alias("other"))
        one = keep(rings.join(other, "id").where(F.col("low") < F.col("other")).select("id", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next")))
        found = keep(found.where("last is not null").unionByName(_followed(one)))
    way = Window.partitionBy("last")
    begun = found.withColumn("begin", F.max(F.struct("depth", "id")).over(way))
    mirrored = F.struct(*(F.col(f"last.{c}").alias(c) for c in by), F.col("last.b").alias("a"), F.col("last.a").alias("b"))
    first = F.col("begin.id")
    ring = first["a"] == F.col("last.b")
    once = keep(begun.where((first < mirrored) | (ring & (first["b"] == F.col("last.a")))).select(first.alias("begin"), (F.col("begin.depth") - F.col("depth")).alias("k"), "id", (F.col("depth") == 0).alias("end")))
    names = numbered(once.select("begin").distinct(), [F.col("begin")], "line")
    at = F.explode(F.when(F.col("end"), F.array(F.struct(F.col("k").alias("k"), F.col("id.a").alias("at")), F.struct((F.col("k") + 1).alias("k"), F.col("id.b").alias("at")))).otherwise(F.array(F.struct(F.col("k").alias("k"), F.col("id.a").alias("at")))))
    out = once.join(names, "begin").withColumn("p", at)
    return out.select(*(F.col(f"begin.{c}").alias(c) for c in by), "line", F.col("p.k").alias("k"), F.floor(F.col("p.at") / _SHIFT).cast("int").alias("row"), (F.col("p.at") % _SHIFT).cast("int").alias("col"))


def _needed(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """The points that Douglas and Peucker keep: ends, and of each stretch the furthest from its chord if over tolerance."""
    kept = np.zeros(len(x), dtype=bool)
    kept[[0, -1]] = True
    open_ = [(0, len(x) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        along = np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else np.zeros(len(px))
        off = np.hypot(px - along * dx, py - along * dy)
        far = int(off.argmax())
        if off[far] > tolerance:
            kept[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return kept


def simplified(points: DataFrame, key: str, order: str, x: str, y: str, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """Of each line the points that its shape needs within tolerance (Douglas and Peucker), each line a piece of work of its own."""

    def run(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values(order)
        return line[_needed(line[x].to_numpy(dtype=float), line[y].to_numpy(dtype=float), tolerance)]

    return points.groupBy(*by, key).applyInPandas(run, points.schema)


def polylines(skeleton: DataFrame, cell: float, least: float = 5.0, tolerance: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """by, line, k, x, y (cells' centres, in metres from the first cell's corner, y down) of the lines of a skeleton that are at least `least` metres long, simplified."""
    points = traced(skeleton, by).select(*by, "line", "k", ((F.col("col") + 0.5) * cell).alias("x"), ((F.col("row") + 0.5) * cell).alias("y"))
    w = Window.partitionBy(*by, "line").orderBy("k")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    whole = points.withColumn("step_", step).withColumn("whole_", F.sum("step_").over(Window.partitionBy(*by, "line"))).where(F.col("whole_") >= least)
    return simplified(whole.drop("step_", "whole_"), "line", "k", "x", "y", tolerance, by)


def worn_lines(df: DataFrame, z: str, inside: str, by: Sequence[str] = (), s: Worn = Worn(), channel: DataFrame | None = None, tile: int = 512) -> DataFrame:
    """by, row, col, direction: the cells of the lines worn into the ground, one cell wide, touching in pieces of at least s.least_line cells.

    channel (optional): per cell distance and the vector (vx by columns, vy by rows) to the nearest channel, in cells; line cells within 1.5 cells of one, or within s.creek and parallel to within s.creek_degrees, are its banks and go.
    """
    found = keep(strengths(df, z, inside, by, s, tile))
    skeleton = thinned(strong_patches(found, "strength", s.low, s.high, s.least_patch, by), by)
    lines = keep(sized_regions(skeleton, s.least_line, by, diagonal=True).select(*by, "row", "col").join(found.select(*by, "row", "col", "direction"), [*by, "row", "col"]))
    if channel is None:
        return lines
    near = lines.join(channel, [*by, "row", "col"], "left")
    kept = keep(near.where(~F.coalesce(bank(s), F.lit(False))).select(*lines.columns))
    return sized_regions(kept, s.least_line, by, diagonal=True).select(*by, "row", "col").join(kept, [*by, "row", "col"])


def bank(s: Worn) -> Column:
    """Whether a line cell (direction) lies on or along the channel at distance (vx, vy)."""
    angle = F.col("direction") * (math.pi / s.directions)
    across = F.abs(F.cos(angle) * F.col("vx") + F.sin(angle) * F.col("vy")) / F.greatest(F.hypot("vx", "vy"), F.lit(1e-9))
    return (F.col("distance") <= 1.5) | ((F.col("distance") <= s.creek) & (across <= math.sin(math.radians(s.creek_degrees))))
