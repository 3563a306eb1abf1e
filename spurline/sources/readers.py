"""Readers of map features, tracks, field logs, collar data and hourly weather. Schemas are explicit; NaN becomes null."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "array<array<struct<lon:double,lat:double>>>"
# Field names of the log and of the weather files.
LOG = (
    "type string, v int, id string, name string, lat double, lon double, lion_seen boolean, arm string, zone string, start string, end string, detections int, times array<string>, "
    "downtime_nights double, trail_type string, deployment string, date string, removed boolean, datetime string, species string, count int, lines array<array<array<double>>>, notes string, logged string, shared_by string"
)
WEATHER = "hourly struct<time array<string>, wind_direction array<double>, wind_speed array<double>, pressure array<double>, precipitation array<double>>, daily struct<time array<string>, sunrise array<string>, sunset array<string>>"


def field_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines, all record types in one table; lines that don't parse are kept in broken."""
    return spark.read.schema(f"{LOG}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """Weather files of parallel arrays as rows: ts, wind_direction, wind_speed, pressure, precipitation."""
    h = spark.read.schema(WEATHER.replace(" array<", ": array<").replace("struct<time", "struct<time")).option("multiLine", True).json(path).select("hourly.*")
    zipped = F.arrays_zip("time", "wind_direction", "wind_speed", "pressure", "precipitation")
    return h.select(F.inline(zipped)).withColumn("ts", F.to_timestamp_ntz("time")).drop("time")


def daylight(spark: SparkSession, path: str) -> DataFrame:
    """day, sunrise and sunset in minutes of the day."""
    d = spark.read.schema(WEATHER.replace(" array<", ": array<")).option("multiLine", True).json(path).select("daily.*")
    minutes = lambda c: (F.hour(F.to_timestamp_ntz(c)) * 60 + F.minute(F.to_timestamp_ntz(c))).alias(c)
    return d.select(F.inline(F.arrays_zip("time", "sunrise", "sunset"))).select(F.to_date("time").alias("day"), minutes("sunrise"), minutes("sunset"))


def collar_csv(spark: SparkSession, path: str, species: str) -> DataFrame:
    """Positions (animal, ts, lon, lat) of a species that are visible, no outliers, and not empty."""
    raw = spark.read.option("header", True).csv(path)
    c = lambda name: F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")
    false = lambda name: F.coalesce(F.lower(c(name)) == "false", F.lit(False))
    true = lambda name: F.coalesce(F.lower(c(name)) == "true", F.lit(False))
    kept = raw.where((c("individual-taxon-canonical-name") == species) & ~false("visible") & ~true("manually-marked-outlier"))
    rows = kept.select(c("individual-local-identifier").alias("animal"), F.to_timestamp_ntz(c("timestamp")).alias("ts"), F.expr("try_cast(`location-long` as double)").alias("lon"), F.expr("try_cast(`location-lat` as double)").alias("lat"))
    return rows.where("lon is not null and lat is not null and ts is not null")


def collar_json(spark: SparkSession, path: str, species: str) -> DataFrame:
    """The same from nested JSON with times in milliseconds."""
    schema = "individuals array<struct<individual_local_identifier: string, individual_taxon_canonical_name: string, locations: array<struct<timestamp: bigint, location_long: double, location_lat: double>>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("individuals")).where(F.col("individual_taxon_canonical_name") == species)
    at = each.select(F.col("individual_local_identifier").alias("animal"), F.inline("locations"))
    return at.select("animal", F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("ts"), F.col("location_long").alias("lon"), F.col("location_lat").alias("lat")).where("lon is not null and lat is not null")


def feature_pages(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """GeoJSON-like pages of features: layer, fid, kind, lines, props (names lower-cased). Malformed geometries and repeated ids (the first stays) are dropped."""
    schema = "features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("page"), F.posexplode("features").alias("place", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    deep = lambda n: F.from_json(text, "array<" * n + "double" + ">" * n)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    line = lambda ps: F.transform(ps, point)
    lines = (
        F.when(kind == "Point", F.array(F.array(point(deep(1))))).when(kind == "LineString", F.array(line(deep(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(deep(3), line)).when(kind == "MultiPolygon", F.transform(F.flatten(deep(4)), line))
    )
    props = F.map_from_entries(F.transform(F.map_entries("f.properties"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = f.select(F.lit(layer).alias("layer"), F.coalesce("f.id", F.md5(text)).alias("fid"), kind.alias("kind"), lines.alias("lines"), props.alias("props"), F.struct("page", "place").alias("order"))
    rows = rows.where("lines is not null and forall(lines, l -> size(l) > 0 and forall(l, p -> p.lon is not null and p.lat is not null))")
    return rows.groupBy("layer", "fid").agg(F.min_by(F.struct("kind", "lines", "props"), "order").alias("f")).select("layer", "fid", "f.*")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _track_rows(path: str, content: bytes) -> Iterator[tuple]:
    """(path, kind, item, part, seq, lat, lon, name, time) of each point of a GPX, KML or KMZ file."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    root = ET.fromstring(content)
    text = lambda e, tag: next((x.text.strip() for x in e.iter() if _name(x.tag) == tag and x.text), None)
    item = 0
    for e in root.iter():
        tag = _name(e.tag)
        if tag == "wpt":
            yield path, "point", item, 0, 0, float(e.get("lat")), float(e.get("lon")), text(e, "name"), text(e, "time")
            item += 1
        elif tag in ("trk", "rte"):
            parts = [s for s in e if _name(s.tag) == "trkseg"] if tag == "trk" else [e]
            for part, s in enumerate(parts):
                for seq, p in enumerate(p for p in s if _name(p.tag) in ("trkpt", "rtept")):
                    yield path, "line", item, part, seq, float(p.get("lat")), float(p.get("lon")), text(e, "name"), text(p, "time")
            item += 1
        elif tag == "Placemark":
            name, part = text(e, "name"), 0
            for g in e.iter():
                kind = _name(g.tag)
                if kind in ("Point", "LineString", "LinearRing"):
                    for seq, triple in enumerate((text(g, "coordinates") or "").split()):
                        lon, lat = map(float, triple.split(",")[:2])
                        yield path, {"Point": "point", "LineString": "line", "LinearRing": "ring"}[kind], item, part, seq, lat, lon, name, text(e, "when")
                    part += 1
                elif kind == "Track":
                    times = [w.text for w in g if _name(w.tag) == "when"]
                    for seq, (c, t) in enumerate(zip((c for c in g if _name(c.tag) == "coord"), times)):
                        lon, lat = map(float, c.text.split()[:2])
                        yield path, "line", item, part, seq, lat, lon, name, t
                    part += 1
            item += 1


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """GPX, KML and KMZ files as points: path, kind (point, line, ring), item, part, seq, lat, lon, name, time. Files that don't parse give none.

    Each file is read whole by one task, as XML needs; files are spread over the cluster.
    """
    schema = "path string, kind string, item int, part int, seq int, lat double, lon double, name string, time string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"]):
                try:
                    rows += list(_track_rows(p, content))
                except (ET.ParseError, zipfile.BadZipFile, StopIteration, ValueError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def grid_file(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """Gzipped or plain grids of big-endian 16-bit numbers: path, row, line (array of a row; negative is null)."""
    import gzip

    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"]):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                grid = np.frombuffer(data, dtype=">i2", count=height * width).reshape(height, width).astype(float)
                grid[grid < 0] = np.nan
                yield pd.DataFrame({"path": p, "row": np.arange(height, dtype="int32"), "line": [[None if np.isnan(v) else v for v in line] for line in grid]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, line array<double>")


def coordinates(text: str | F.Column = "text") -> F.Column:
    """struct(lat, lon) of a text such as "47.9 N, 117.6 W" or "47.9, -117.6"; null for other texts."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*°?\s*([NSns])?\s*[, ]\s*(-?\d+(?:\.\d+)?)\s*°?\s*([EWew])?\s*$"
    g = lambda k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    lat, lon = g(1).cast("double"), g(3).cast("double")
    lat = F.when(F.upper(g(2)) == "S", -F.abs(lat)).otherwise(lat)
    lon = F.when(F.upper(g(4)) == "W", -F.abs(lon)).otherwise(lon)
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))
