import datetime as dt
import json

from pyspark.sql import functions as F

from spurline.operators import climate, evidence, records
from spurline.sources import readers, sinks
from spurline.streaming import hits


def test_independent_at_exactly_thirty_minutes(spark):
    at = lambda h, m, s=0: dt.datetime(2026, 1, 1, h, m, s)
    rows = [(1, at(0, 0)), (1, at(0, 30)), (1, at(0, 59, 59)), (1, None), (2, at(5, 0)), (2, at(5, 20))]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    assert {r["k"]: r["hits"] for r in evidence.independent(df, ["k"], "ts").collect()} == {1: 3, 2: 1}


def test_fold_keeps_the_last_that_is_not_null(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, None, 2.0), ("a", 3, None, None)], "id string, seq int, n string, h double")
    r = evidence.folded(df, "id", "seq", ["n", "h"]).first()
    assert (r["n"], r["h"]) == ("x", 2.0)


def test_effort_example(spark):
    df = spark.createDataFrame([("a", dt.date(2026, 11, 20), dt.date(2026, 12, 10), 3)], "id string, start date, stop date, down int")
    got = {r["month"]: r["nights"] for r in evidence.effort_by_month(df, "id", "start", "stop", "down").collect()}
    assert abs(got[11] - 17 * 11 / 20) < 1e-9 and abs(got[12] - 17 * 9 / 20) < 1e-9


def test_tails(spark):
    r = spark.range(1).select(evidence.binomial_tail(F.lit(8), F.lit(10)), evidence.poisson_tail(F.lit(3), F.lit(1.0)), evidence.normal_tail(F.lit(1.96)), evidence.poisson_tail(F.lit(0), F.lit(1.0))).first()
    assert abs(r[0] - 56 / 1024) < 1e-9 and abs(r[1] - 0.0803014) < 1e-6 and abs(r[2] - 0.0249979) < 1e-6 and r[3] == 1.0


def test_circular_mean_over_north(spark):
    df = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("b", 0.0), ("b", 180.0)], "k string, d double")
    got = {r["k"]: r for r in climate.circular(df, ["k"], "d").collect()}
    assert min(got["a"]["direction"], 360 - got["a"]["direction"]) < 1e-6 and got["b"]["strength"] < 1e-9


def test_expand_and_name(spark):
    v1 = spark.createDataFrame([("s", "2026-01-01", None, ["2026-01-02"]), ("t", "2026-01-01", "2026-02-01", [])], "id string, start string, end string, times array<string>")
    kinds = sorted((r["id"], r["kind"]) for r in records.expanded(v1).collect())
    assert kinds == [("s", "deployment"), ("s", "event"), ("t", "check"), ("t", "deployment")]
    taken = spark.createDataFrame([("cam",)], "id string")
    rows = spark.createDataFrame([("cam", 1), ("cam", 2), ("pin", 3)], "base string, o int")
    assert sorted(r["id"] for r in records.named(rows, "base", "o", taken).collect()) == ["cam#2", "cam#3", "pin"]


def test_evolution_names_what_is_missing(spark):
    df = records.evolved(spark.createDataFrame([(1,)], "a int"), {"a": F.lit(0), "b": F.lit(0.5)})
    r = df.first()
    assert (r["a"], r["b"], r["unmodeled"]) == (1, 0.5, ["b"])


def test_track_files(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx xmlns="u"><wpt lat="1" lon="2"><name>W</name></wpt><trk><trkseg><trkpt lat="3" lon="4"/><trkpt lat="5" lon="6"><time>2026-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    (tmp_path / "b.kml").write_text("<kml><Placemark><name>L</name><LineString><coordinates>1,2,0 3,4,0</coordinates></LineString></Placemark></kml>")
    (tmp_path / "c.gpx").write_text("not xml")
    rows = readers.tracks(spark, str(tmp_path)).collect()
    got = sorted((r["path"][-5:], r["kind"], r["seq"], r["lat"], r["lon"]) for r in rows)
    assert got == [("a.gpx", "line", 0, 3.0, 4.0), ("a.gpx", "line", 1, 5.0, 6.0), ("a.gpx", "point", 0, 1.0, 2.0), ("b.kml", "line", 0, 2.0, 1.0), ("b.kml", "line", 1, 4.0, 3.0)]


def test_features_and_collars(spark, tmp_path):
    page = {"features": [
        {"id": "1", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"NAME": "x"}}, {"id": "1", "geometry": {"type": "Point", "coordinates": [9.0, 9.0]}, "properties": {"NAME": "y"}},
        {"id": "2", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1]]]}, "properties": {}}, {"id": "3", "geometry": {"type": "Point", "coordinates": []}, "properties": {}},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = {r["fid"]: r for r in readers.feature_pages(spark, str(tmp_path / "p.json"), "land").collect()}
    assert sorted(rows) == ["1", "2"] and rows["1"]["props"] == {"name": "x"} and len(rows["2"]["lines"][0]) == 3
    (tmp_path / "c.csv").write_text(
        "timestamp,location-long,location-lat,visible,manually-marked-outlier,individual-taxon-canonical-name,individual-local-identifier\n"
        "2026-01-01 00:00:00.000,1.5,2.5,true,,Puma concolor,a\n2026-01-01 02:00:00.000,1.5,2.5,false,,Puma concolor,a\n2026-01-01 03:00:00.000,,2.5,true,,Puma concolor,a\n2026-01-01 04:00:00.000,1,2,true,,Cervus,b\n"
    )
    got = readers.collar_csv(spark, str(tmp_path / "c.csv"), "Puma concolor").collect()
    assert [(r["animal"], r["lon"]) for r in got] == [("a", 1.5)]


def test_coordinates(spark):
    df = spark.createDataFrame([("47.9, -117.6",), ("47.9 N, 117.6 W",), ("95, 10",), ("somewhere",)], "text string")
    got = [r[0] for r in df.select(readers.coordinates()).collect()]
    assert tuple(got[0]) == (47.9, -117.6) == tuple(got[1]) and got[2] is None and got[3] is None


def test_layers_round_trip_prunes(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id div 10 as int) row", "cast(id % 10 as int) col", "id / 3 as v")
    sinks.write_layers(df, str(tmp_path / "l"), half=("v",), block=5)
    w = sinks.read_window(spark, str(tmp_path / "l"), 2, 3, 4, 4, block=5)
    assert w.count() == 16 and "PartitionFilters: [" in w._jdf.queryExecution().toString()


def test_streamed_hits(spark, tmp_path):
    rows = [(1, "2026-01-01T00:00:00"), (1, "2026-01-01T00:10:00"), (1, "2026-01-01T01:00:00"), (2, "2026-01-01T00:00:00")]
    spark.createDataFrame(rows, "k long, t string").selectExpr("k", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("hits_out", hits.independent_stream(stream, "k", "ts")), ("window_out", hits.windowed_counts(stream, "ts", "k"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r["k"], r["counts"]) for r in spark.table("hits_out").collect()) == [(1, False), (1, True), (1, True), (2, True)]
