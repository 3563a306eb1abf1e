"""Circular statistics of directions and the hours that count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.functions.scalar import sector_index


def circular(df: DataFrame, by: Sequence[str], degrees: str, weight: Column | str | None = None) -> DataFrame:
    """Per group: mean direction (degrees, null where it cancels out), strength (0 to 1) and rows."""
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    a = F.radians(F.col(degrees))
    sums = df.groupBy(*by).agg(F.sum(w * F.sin(a)).alias("s"), F.sum(w * F.cos(a)).alias("c"), F.sum(w).alias("w"), F.count(degrees).alias("n"))
    strength = F.coalesce(F.try_divide(F.hypot("s", "c"), "w"), F.lit(0.0))
    return sums.select(*by, F.when(strength > 0, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("direction"), strength.alias("strength"), "n")


def rose(df: DataFrame, by: Sequence[str], degrees: str) -> DataFrame:
    """Per group and sector: rows and share."""
    counted = df.withColumn("sector", sector_index(degrees)).groupBy(*by, "sector").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def settled_hours(hourly: DataFrame, by: Sequence[str], ts: str, pressure: str, rain: str) -> DataFrame:
    """Adds settled: pressure at or above its month's median, no fall of more than 0.5 over six hours, under 0.2 of rain in 24 hours."""
    order = Window.partitionBy(*by).orderBy(ts)
    middle = F.median(pressure).over(Window.partitionBy(*by, F.month(ts)))
    trend = F.coalesce(F.col(pressure) - F.lag(pressure, 6).over(order), F.lit(0.0))
    wet = F.sum(rain).over(order.rowsBetween(-23, 0))
    return hourly.withColumn("settled", (F.col(pressure) >= middle) & (trend >= -0.5) & (wet < 0.2))


def period(minute: Column, rise: Column, set_: Column) -> Column:
    """night, day, dawn or dusk by minutes of the day; within 90 minutes of both, dusk."""
    rise, set_ = F.coalesce(rise, F.lit(360)), F.coalesce(set_, F.lit(1080))
    return F.when(F.abs(minute - set_) <= 90, "dusk").when(F.abs(minute - rise) <= 90, "dawn").when((minute > rise + 90) & (minute < set_ - 90), "day").otherwise("night")


def combined(a_dir: Column, a_r: Column, a_hours: Column, b_dir: Column, b_r: Column, b_hours: Column) -> Column:
    """Two groups' mean directions as one, weighted by hours and steadiness: struct(direction, strength)."""
    wa, wb = a_hours * a_r + 1e-6, b_hours * b_r + 1e-6
    s = (wa * F.sin(F.radians(a_dir)) + wb * F.sin(F.radians(b_dir))) / (wa + wb)
    c = (wa * F.cos(F.radians(a_dir)) + wb * F.cos(F.radians(b_dir))) / (wa + wb)
    mean = ((a_hours + 1) * a_r + (b_hours + 1) * b_r) / (a_hours + b_hours + 2)
    return F.struct(F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)).alias("direction"), (mean * F.hypot(s, c)).alias("strength"))
