"""Ranked, spaced picks and what is said about them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.functions.scalar import threshold
from spurline.operators.lattice import gaussian, peaks
from spurline.operators.ranks import summed_before
from spurline.operators.store import keep


def spaced(candidates: DataFrame, score: str, radius: float, per_zone: int, most: int, by: Sequence[str], prefix: str = "#", times: int = 8) -> DataFrame:
    """Greedy picks by score (then row, col): one is skipped when per_zone kept ones lie within the radius; at most `most` for each area.

    zone is that of the first earlier pick within the radius, numbered by appearance. Of an area's candidates the best times * most are looked at, so each area is one small group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, "row", "col"], ascending=[False, True, True]).reset_index(drop=True)
        kept: list[int] = []
        zones: list[int] = []
        for i, r in rows.iterrows():
            near = [k for k, j in enumerate(kept) if (rows.at[j, "row"] - r["row"]) ** 2 + (rows.at[j, "col"] - r["col"]) ** 2 < radius * radius]
            if len(near) >= per_zone:
                continue
            zones.append(zones[near[0]] if near else max(zones, default=0) + 1)
            kept.append(i)
            if len(kept) == most:
                break
        return rows.loc[kept].assign(rank=range(1, len(kept) + 1), zone=zones)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    picked = best(candidates, score, times * most, by).drop("rank").groupBy(*by).applyInPandas(run, f"{kinds}, rank int, zone int")
    return picked.withColumn("name", F.concat(F.lit(prefix), "rank"))


def pick(df: DataFrame, score: str, spacing: int, least: float, radius: float, per_zone: int, most: int, by: Sequence[str], prefix: str = "#") -> DataFrame:
    """Peaks of score at least spacing apart and above least, then spaced()."""
    return spaced(peaks(df, score, spacing, least, by), score, radius, per_zone, most, by, prefix)


def snapped(df: DataFrame, score: str, usable: str, sigma: float, spacing: int, snap: int, height: int, width: int, most: int, by: Sequence[str] = (), times: int = 8) -> DataFrame:
    """The best usable peaks of the smoothed score, at least spacing apart, each moved to the cell of the highest score within snap cells: by, row, col, score, peak.

    A peak has to be above a threshold that follows from the best usable one of its area; of them the best times * most count.
    """
    smooth = gaussian(df.select(*by, "row", "col", usable, score, F.col(score).alias("smooth_")), "smooth_", sigma, height, width, by=by)
    best_of = smooth.where(usable).groupBy(*by).agg(F.max("smooth_").alias("top_"))
    limited = (smooth.join(best_of, list(by)) if by else smooth.crossJoin(F.broadcast(best_of))).withColumn("at_", F.when(F.col(usable), F.col("smooth_")))
    tops = peaks(limited, "at_", spacing, None, by).where(F.col("at_") > threshold("top_"))
    tops = best(tops, "at_", times * most, by).select(*by, F.col("row").alias("r_"), F.col("col").alias("c_"), F.col("at_").alias("peak"))
    moves = F.explode(F.sequence(F.lit(-snap), F.lit(snap)))
    around = tops.withColumn("dr", moves).withColumn("dc", moves).select(*by, "r_", "c_", "peak", (F.col("r_") + F.col("dr")).alias("row"), (F.col("c_") + F.col("dc")).alias("col"))
    chosen = around.join(df.select(*by, "row", "col", score), [*by, "row", "col"]).groupBy(*by, "r_", "c_", "peak").agg(F.max(F.struct(F.col(score).alias("s"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b"))
    return chosen.select(*by, (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.s").alias(score), "peak")


def two_lists(df: DataFrame, score: str, public: str, private: str, sigma: float, spacing: int, snap: int, radius: float, per_zone: int, height: int, width: int, most: int, by: Sequence[str] = ()) -> DataFrame:
    """The spots on public ground, named #1, #2, ..., and those on private ground, named P1, P2, ...: scores count where their own mask holds."""
    lists = []
    for mask, prefix in ((public, "#"), (private, "P")):
        own = df.select(*by, "row", "col", mask, F.when(F.col(mask), F.col(score)).otherwise(0.0).alias(score))
        found = snapped(own, score, mask, sigma, spacing, snap, height, width, most, by)
        found = found if by else found.withColumn("all_", F.lit(0))
        lists.append(spaced(found, score, radius, per_zone, most, by or ["all_"], prefix).drop("all_"))
    return lists[0].unionByName(lists[1])


def best(df: DataFrame, score: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The n highest cells of each area with rank; ties in row-major order."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "row", "col")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def blocks_apart(blocks: DataFrame, score: str, least: float, by: Sequence[str], most: int = 100) -> DataFrame:
    """At most `most` blocks in order of score, none touching a chosen one even at a corner. A choice strikes out eight others at most, so the best 9 * most blocks of an area decide, and each area is one small group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, "block_row", "block_col"], ascending=[False, True, True])
        kept: list[int] = []
        for i in rows.index:
            if len(kept) < most and all(max(abs(rows.at[i, "block_row"] - rows.at[j, "block_row"]), abs(rows.at[i, "block_col"] - rows.at[j, "block_col"])) > 1 for j in kept):
                kept.append(i)
        return rows.loc[kept].assign(rank=range(1, len(kept) + 1))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    order = Window.partitionBy(*by).orderBy(F.desc(score), "block_row", "block_col")
    high = blocks.where(F.col(score) > least).withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= 9 * most).drop("place_")
    return high.groupBy(*by).applyInPandas(run, f"{kinds}, rank int")


def reasons(rules: Sequence[tuple[Column, Column]]) -> Column:
    """The sentences of the rules that hold, in order: (condition, sentence)."""
    return F.array_compact(F.array(*(F.when(when, what) for when, what in rules)))


def share_above(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds position: the mid-rank of each value among all of its area, from 0 to 1; ties share the middle of their ranks, null has none.

    Equal values are counted and the counts summed up in ranges, so no task holds an area.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_"))
    placed = keep(summed_before(counts, [F.col(value)], {"low_": F.col("n_")}, by))
    total = placed.groupBy(*by).agg(F.sum("n_").alias("all_"))
    shares = (placed.join(total, list(by)) if by else placed.crossJoin(F.broadcast(total))).select(*by, value, ((F.col("low_") + 0.5 * F.col("n_")) / F.col("all_")).alias("position"))
    return df.join(shares, [*by, value], "left")


def ranked_among(points: DataFrame, spots: DataFrame, key: str, score: str, least_own: float = 0.0) -> DataFrame:
    """points: key and score of each; spots: scores of an area's spots. Adds fraction: (spots of a higher score + 1) / spots, at most 1; null without spots."""
    all_spots = spots.select(F.col(score).alias("s_"))
    n = all_spots.agg(F.count(F.lit(1)).alias("n_"))  # one row
    counts = all_spots.groupBy("s_").agg(F.count(F.lit(1)).alias("k_"))
    both = points.select(F.col(score).alias("s_"), F.lit(0).cast("long").alias("k_")).unionByName(counts).groupBy("s_").agg(F.sum("k_").alias("k_"))
    above = summed_before(both, [-F.col("s_")], {"higher_": F.col("k_")}).select(F.col("s_").alias(score), "higher_")
    out = points.join(above, score, "left").crossJoin(F.broadcast(n))
    return out.withColumn("fraction", F.when(F.col("n_") > 0, F.least(F.lit(1.0), (F.col("higher_") + 1) / F.col("n_")))).drop("higher_", "n_")


def standing(points: DataFrame, df: DataFrame, key: str, score: str, cell: float, height: int, width: int, pin: float = 15.0, spacing: float = 150.0, local: float = 1000.0) -> DataFrame:
    """Where points (key, row, col) stand among the spots of an area: adds fraction, of spots that score as well, and better, how many better ones are between 2 pin and local metres off.

    df: all cells with their score. Spots are peaks of the smoothed score at least `spacing` apart; a point counts as the best smoothed cell within pin metres of it. Points meet the spots of their own and the eight neighbouring squares of width local:
    spots keep their distance, so a point meets at most some 9 (local / spacing)^2 of them however many points there are. Without spots there is a null fraction.
    """
    smooth = keep(gaussian(df.select("row", "col", F.col(score).cast("double").alias("v_")), "v_", max(0.5, 6 / cell), height, width).withColumn("v_", F.round("v_", 9)))
    spots = keep(peaks(smooth, "v_", max(1, int(spacing / cell)), 1e-6))
    at, k = smooth, max(1, int(pin / cell))
    for axis, other in (("col", "row"), ("row", "col")):
        at = at.withColumn("v_", F.max("v_").over(Window.partitionBy(other).orderBy(axis).rowsBetween(-k, k)))
    placed = keep(points.select(key, "row", "col").join(at, ["row", "col"]))
    ranked = ranked_among(placed.select(F.col(key), F.col("v_").alias("s")), spots.select(F.col("v_").alias("s")), key, "s").select(key, "fraction")
    step = max(1, math.ceil(local / cell))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    square = lambda c: F.floor(F.col(c) / step).cast("long")
    spread = spots.select(F.col("row").alias("r_"), F.col("col").alias("c_"), F.col("v_").alias("s_"), square("row").alias("sr"), square("col").alias("sc")).withColumn("dr", near).withColumn("dc", near)
    spread = spread.select("r_", "c_", "s_", (F.col("sr") + F.col("dr")).alias("sr"), (F.col("sc") + F.col("dc")).alias("sc"))
    d = F.hypot(F.col("r_") - F.col("row"), F.col("c_") - F.col("col")) * cell
    met = placed.withColumns({"sr": square("row"), "sc": square("col")}).join(spread, ["sr", "sc"]).where((d <= local) & (d > 2 * pin) & (F.col("s_") > F.col("v_")))
    better = met.groupBy(key).agg(F.count(F.lit(1)).alias("better"))
    return points.join(ranked, key, "left").join(better, [key], "left").withColumn("better", F.coalesce("better", F.lit(0).cast("long")))
