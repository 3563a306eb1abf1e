"""Writers: layers, GeoJSON lines, KML folders, saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spurline.functions.scalar import half_precision


def write_layers(cells: DataFrame, path: str, half: tuple[str, ...] = (), block: int = 256) -> None:
    """Cells as Parquet by area and block of cells, so that a read of one window prunes the rest; layers named in half are rounded to half precision."""
    rows = cells.withColumns({c: half_precision(c) for c in half}).withColumns({"block_row": F.floor(F.col("row") / block).cast("int"), "block_col": F.floor(F.col("col") / block).cast("int")})
    by = [c for c in ("area_id", "block_row", "block_col") if c in rows.columns]
    rows.repartition(*by).sortWithinPartitions(*by, "row", "col").write.mode("overwrite").partitionBy(*by).parquet(path)


def read_window(spark: SparkSession, path: str, row: int, col: int, height: int, width: int, block: int = 256) -> DataFrame:
    """The cells of a window: its blocks by partition pruning, its cells by pushed filters."""
    df = spark.read.parquet(path)
    inside = F.col("block_row").between(row // block, (row + height - 1) // block) & F.col("block_col").between(col // block, (col + width - 1) // block)
    return df.where(inside & F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)).drop("block_row", "block_col")


def geojson(kind: str, coordinates: Column, *props: str) -> Column:
    """One GeoJSON feature as text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties")))


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def kml_folders(points: DataFrame, folder: str, name: str, description: str) -> DataFrame:
    """points: lon, lat. One row for each folder: its KML text, placemarks in order of name."""
    c = lambda x: escaped(F.coalesce(F.col(x).cast("string"), F.lit("")))
    mark = F.concat(
        F.lit("<Placemark><name>"), c(name), F.lit("</name><description>"), c(description), F.lit("</description><Point><coordinates>"),
        F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0</coordinates></Point></Placemark>"),
    )
    marks = points.groupBy(folder).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("n"), mark.alias("m")))), lambda x: x["m"]), "").alias("marks"))
    return marks.select(folder, F.concat(F.lit("<Folder><name>"), c(folder), F.lit("</name>"), F.col("marks"), F.lit("</Folder>")).alias("kml"))


def colour(value: Column, stops: list[tuple[float, int, int, int]], floor: float) -> Column:
    """struct(r, g, b, a) on a piecewise-linear ramp of (value, r, g, b); transparent below floor, then ((v - floor) / (1 - floor)) ** 0.7."""

    def channel(k: int) -> Column:
        out = F.lit(stops[-1][k])
        for low, high in reversed(list(zip(stops, stops[1:]))):
            out = F.when(value < high[0], low[k] + (value - low[0]) / (high[0] - low[0]) * (high[k] - low[k])).otherwise(out)
        return F.round(F.when(value <= stops[0][0], stops[0][k]).otherwise(out)).cast("int")

    alpha = F.when(value > floor, F.pow((value - floor) / (1 - floor), F.lit(0.7))).otherwise(0.0)
    return F.struct(*(channel(k).alias(c) for k, c in enumerate("rgb", 1)), F.round(255 * F.least(alpha, F.lit(1.0))).cast("int").alias("a"))
