"""Lines and shapes as rows of points, and their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lengths(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Per line: its length and number of points."""
    w = Window.partitionBy(key).orderBy(order)
    part = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return points.withColumn("part", part).groupBy(key).agg(F.sum("part").alias("length"), F.count(F.lit(1)).alias("points"))


def _pieces(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Each point with the next of its line (x2, y2), the length d to it, the length before it, and the line's total; last: it is the line's end."""
    w = Window.partitionBy(key).orderBy(order)
    pieces = points.withColumns({"x2": F.lead(x).over(w), "y2": F.lead(y).over(w), "last": F.lead(F.lit(1)).over(w).isNull()}).withColumn("d", F.coalesce(F.hypot(F.col("x2") - F.col(x), F.col("y2") - F.col(y)), F.lit(0.0)))
    return pieces.withColumns({"before": F.sum("d").over(w) - F.col("d"), "total": F.sum("d").over(Window.partitionBy(key))})


def densified(points: DataFrame, key: str, order: str, x: str, y: str, step: float) -> DataFrame:
    """Points k at every step along each line, its first and last point included: each piece of it makes those that fall on it. A line of one point, or without length, gives its last point."""
    pieces = _pieces(points, key, order, x, y)
    first, last = F.ceil(F.col("before") / step), F.ceil((F.col("before") + F.col("d")) / step) - 1
    at = pieces.where((F.col("d") > 0) & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step - F.col("before")) / F.col("d")
    inner = at.select(key, "k", (F.col(x) + (F.col("x2") - F.col(x)) * share).alias("x"), (F.col(y) + (F.col("y2") - F.col(y)) * share).alias("y"))
    return inner.unionByName(pieces.where("last").select(key, F.ceil(F.col("total") / step).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")))


def cell_of(x: Column, y: Column, west: float, north: float, size: float) -> tuple[Column, Column]:
    """row and col of a point; row 0 is the northernmost."""
    return F.floor((F.lit(north) - y) / size).cast("int"), F.floor((x - west) / size).cast("int")


def burned_lines(points: DataFrame, key: str, order: str, x: str, y: str, west: float, north: float, size: float) -> DataFrame:
    """All cells that each line passes: between the crossings of cell borders on a piece, in order, it is in one cell each."""
    u, v = (F.col(x) - west) / size, (F.lit(north) - F.col(y)) / size
    pieces = _pieces(points, key, order, x, y).withColumns({"u": u, "v": v, "u2": F.coalesce((F.col("x2") - west) / size, u), "v2": F.coalesce((F.lit(north) - F.col("y2")) / size, v)})

    def crossings(a: str, b: str) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        borders = F.when(F.floor(low) + 1 <= F.ceil(high) - 1, F.sequence(F.floor(low) + 1, F.ceil(high) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(borders, lambda k: (k - F.col(a)) / (F.col(b) - F.col(a)))

    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("u", "u2"), crossings("v", "v2"))))
    between = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: (F.element_at("at", i) + F.element_at("at", i + 1)) / 2)
    cut = pieces.withColumn("at", at).withColumn("t", F.explode(F.concat(between, F.array(F.lit(0.0), F.lit(1.0)))))
    along = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("t")).cast("int")
    return cut.select(key, along("v", "v2").alias("row"), along("u", "u2").alias("col")).distinct()


def centroids(rings: DataFrame, ring: str) -> DataFrame:
    """Adds lon and lat: the mean of the vertices of a ring array<struct<lon, lat>>; null without any."""
    mean = lambda c: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]), F.size(ring))
    return rings.withColumns({"lon": mean("lon"), "lat": mean("lat")})


def nearest_within(points: DataFrame, others: DataFrame, key: str, x: str, y: str, reach: float, order: str) -> DataFrame:
    """Adds to each point the nearest of others (order, x, y) closer than reach: near (its order) and distance, null without one; the first in order wins ties.

    Points meet those of their own and the neighbouring squares of a lattice of width reach. Of others at one place the first in order stands for all, and pairs are cut to the nearest place of a point before they are shuffled.
    """
    square = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    places = others.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x_"), F.col(y).alias("y_")).agg(F.min(order).alias("near"))
    spread = places.withColumns({"sx": square("x_"), "sy": square("y_")}).withColumn("dx", around).withColumn("dy", around)
    spread = spread.select("near", "x_", "y_", (F.col("sx") + F.col("dx")).alias("sx"), (F.col("sy") + F.col("dy")).alias("sy"))
    d = F.hypot(F.col("x_") - F.col(x), F.col("y_") - F.col(y))
    met = points.select(key, x, y, square(x).alias("sx"), square(y).alias("sy")).join(spread, ["sx", "sy"]).withColumn("distance", d).where(F.col("distance") < reach)
    best = met.groupBy(key).agg(F.min(F.struct("distance", "near")).alias("best"))
    return points.join(best, key, "left").withColumns({"near": F.col("best.near"), "distance": F.col("best.distance")}).drop("best")


def top_distance(points: DataFrame, spots: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Adds to each point (row, col) the distance in cells to the nearest of the k best spots (row, col, value; ties in row-major order); infinite without any."""
    best = spots.orderBy(F.desc(value), "row", "col").limit(k).select(F.col("row").alias("r"), F.col("col").alias("c"))
    near = points.crossJoin(F.broadcast(best)).groupBy(key).agg(F.min(F.hypot(F.col("row") - F.col("r"), F.col("col") - F.col("c"))).alias("distance"))  # at most k rows
    return points.join(near, key, "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def burned_rings(edges: DataFrame, key: str, west: float, north: float, size: float) -> DataFrame:
    """edges: key, x1, y1, x2, y2 of closed rings. Cells whose centre is inside, by the even-odd rule along each row of cells."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil((F.lit(north) - high) / size - 0.5), F.ceil((F.lit(north) - low) / size - 0.5) - 1
    crossed = edges.where("y1 <> y2").withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))))
    y = F.lit(north) - (F.col("row") + 0.5) * size
    at = crossed.select(key, "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    w = Window.partitionBy(key, "row").orderBy("x")
    spans = at.withColumns({"n": F.row_number().over(w), "end": F.lead("x").over(w)}).where("n % 2 = 1 and end is not null")
    a, b = F.ceil((F.col("x") - west) / size - 0.5), F.ceil((F.col("end") - west) / size - 0.5) - 1
    return spans.withColumns({"a": a, "b": b}).where("a <= b").select(key, "row", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("col"))


def drawn(cells: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """One value for each cell: that of the last shape in order."""
    return cells.groupBy(*by, "row", "col").agg(F.max_by(value, order).alias(value))
