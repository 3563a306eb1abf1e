"""Places in an order, running sums and exact quantiles, without a window that takes all rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.operators.store import keep


def summed_before(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds to each row, under each name of sums, the sum of its column over the rows of its `by` before it in a total order.

    Rows are dealt into ranges of (by, order). The ranges' sums, a row for each range and `by` in it, give each range its start, so no task holds more than a range.
    """
    named = {f"at{i}_": c for i, c in enumerate(order)} | {f"of_{k}": c for k, c in sums.items()}
    keys = [f"at{i}_" for i in range(len(order))]
    ranged = keep(rows.withColumns(named).repartitionByRange(*by, *keys).withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "range_").agg(*(F.sum(f"of_{k}").alias(f"sum_{k}") for k in sums))
    starts = parts.select(*by, "range_", *(F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"start_{k}") for k in sums))
    inside = Window.partitionBy(*by, "range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(starts, [*by, "range_"]).withColumns({k: F.col(f"start_{k}") + F.coalesce(F.sum(f"of_{k}").over(inside), F.lit(0)) for k in sums})
    return out.drop("range_", *named, *(f"start_{k}" for k in sums))


def numbered(rows: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the place of each row, from 1, in a total order."""
    return summed_before(rows, order, {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) + 1)


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per `by` and share in at: q and the exact quantile, interpolated between neighbours as is usual. Null values are left out.

    Equal values are counted first; the counts are summed up in order, and the two values that a quantile lies between are looked up by their ranks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_"))
    placed = keep(summed_before(counts, [F.col(value)], {"low_": F.col("n_")}, by))
    totals = placed.groupBy(*by).agg(F.sum("n_").alias("total_"))
    wanted = F.explode(F.array(*map(F.lit, map(float, at))))
    asked = totals.withColumn("q", wanted).withColumn("place_", F.col("q") * (F.col("total_") - 1)).withColumn("k_", F.explode(F.array_distinct(F.array(F.floor("place_"), F.ceil("place_")))))
    joined = placed.join(asked, list(by)) if by else placed.crossJoin(F.broadcast(asked))  # without by at most two rows for each share
    found = joined.where((F.col("low_") <= F.col("k_")) & (F.col("k_") < F.col("low_") + F.col("n_")))
    share = F.max("place_") - F.floor(F.max("place_"))
    low, high = F.min_by(value, "k_"), F.max_by(value, "k_")
    return found.groupBy(*by, "q").agg((low + (high - low) * share).alias(value))
