import gzip
import heapq
import json
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spurline.functions import scalar
from spurline.operators import evidence, graph, lattice, picks, ranks, records, vectors
from spurline.sources import readers, sinks

AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def frame(spark, **layers):
    """Arrays of one shape as cells; NaN is null."""
    names = list(layers)
    shape = layers[names[0]].shape
    kind = {"b": "boolean", "i": "long", "f": "double"}
    of = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    rows = [(r, c, *(of(layers[n][r, c].item()) for n in names)) for r in range(shape[0]) for c in range(shape[1])]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{n} {kind[layers[n].dtype.kind]}" for n in names))


def labelled(mask, diagonal=False):
    """Touching cells by search; numbered from 1 by first cell."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        ways = [start]
        out[start] = n
        while ways:
            r, c = ways.pop()
            for dr, dc in AROUND:
                q = (r + dr, c + dc)
                if (diagonal or not dr or not dc) and 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = n
                    ways.append(q)
    return out


def test_cost_tree_against_dijkstra(spark):
    rng = np.random.default_rng(3)
    cost = rng.uniform(0.5, 4, (19, 23))
    cost[rng.random(cost.shape) < 0.15] = np.nan
    source = np.zeros(cost.shape, bool)
    source[[2, 15], [3, 20]] = True
    cost[[2, 15], [3, 20]] = 1.0
    covered, cell, cutoff, last = rng.random(cost.shape) < 0.5, 3.0, 60.0, 12.0
    done, heap = {}, [(0.0, r, c, None) for r, c in zip(*np.nonzero(source))]
    while heap:
        d, r, c, came = heapq.heappop(heap)
        if (r, c) in done:
            continue
        done[r, c] = d
        for dr, dc in AROUND:
            q = (r + dr, c + dc)
            if 0 <= q[0] < cost.shape[0] and 0 <= q[1] < cost.shape[1] and not math.isnan(cost[q]) and q not in done:
                nd = d + 0.5 * (cost[r, c] + cost[q]) * (math.hypot(dr, dc) * cell)
                if nd <= cutoff:
                    heapq.heappush(heap, (nd, *q, None))
    before = {}
    for (r, c), d in done.items():
        if not source[r, c]:
            offers = [(done[q], *q) for q in ((r + dr, c + dc) for dr, dc in AROUND) if q in done and abs(done[q] + 0.5 * (cost[r, c] + cost[q]) * (math.hypot(q[0] - r, q[1] - c) * cell) - d) < 1e-9]
            before[r, c] = min(offers)[1:]
    tree = graph.least_cost(frame(spark, c=cost, s=source), "c", "s", cell, cutoff=cutoff, tile=8)
    tree = tree.join(frame(spark, covered=covered), ["row", "col"])
    got = {(r["row"], r["col"]): r for r in graph.covered_share(tree, "covered", cell, last).collect()}
    assert len(got) == cost.size and sum(r["reach"] is not None for r in got.values()) == len(done) > 200
    for q, d in done.items():
        r, way = got[q], [q]
        while way[-1] in before:
            way.append(before[way[-1]])
        steps = [math.hypot(a[0] - b[0], a[1] - b[1]) * cell for a, b in zip(way, way[1:])]
        left = np.cumsum(steps[::-1])[::-1]  # from each cell of the way to its end
        bare = sum(s for s, a, to in zip(steps, way, left) if not covered[a] and to <= last)
        assert abs(r["reach"] - d) < 1e-9 and (r["root_row"], r["root_col"]) == way[-1] and abs(r["length"] - sum(steps)) < 1e-9
        assert (r["from_row"], r["from_col"]) == before.get(q, (None, None))
        assert abs(r["share"] - (1 - bare / min(sum(steps), last) if steps else 1)) < 1e-9


def test_flooding_and_sharing_over_squares(spark):
    rng = np.random.default_rng(5)
    z = rng.uniform(0, 10, (17, 20))
    filled, heap = {}, [(z[r, c], r, c) for r in range(17) for c in range(20) if r in (0, 16) or c in (0, 19)]
    filled.update({(r, c): h for h, r, c in heap})
    heapq.heapify(heap)
    while heap:
        h, r, c = heapq.heappop(heap)
        for dr, dc in AROUND:
            q = (r + dr, c + dc)
            if 0 <= q[0] < 17 and 0 <= q[1] < 20 and q not in filled:
                filled[q] = max(z[q], h + 1e-4)
                heapq.heappush(heap, (filled[q], *q))
    cells = frame(spark, z=z).withColumn("area", F.lit(1))
    got = {(r["row"], r["col"]): r["filled"] for r in graph.flooded(cells, "z", ["area"], tile=6).collect()}
    assert all(abs(got[q] - h) < 1e-9 for q, h in filled.items()) and len(got) == z.size
    f = np.array([[filled[r, c] for c in range(20)] for r in range(17)])
    area = np.full(f.shape, 4.0)
    for r, c in sorted(np.ndindex(f.shape), key=lambda q: -f[q]):
        low = {(r + dr, c + dc): ((f[r, c] - f[r + dr, c + dc]) / (math.hypot(dr, dc) * 2)) ** 1.1 * (0.5 if 0 in (dr, dc) else 0.354) for dr, dc in AROUND if 0 <= r + dr < 17 and 0 <= c + dc < 20 and f[r + dr, c + dc] < f[r, c]}
        for q, w in low.items():
            area[q] += area[r, c] * w / sum(low.values())
    shared = graph.shared_flow(frame(spark, z=f).withColumn("by", F.lit(1)), "z", 2.0, ["by"], tile=6)
    assert all(abs(r["area"] - area[r["row"], r["col"]]) < 1e-6 for r in shared.collect())


def test_openings_and_bands_against_search(spark):
    rng = np.random.default_rng(6)
    low, lake = rng.random((24, 26)) < 0.93, rng.random((24, 26)) < 0.03
    open_ = low & ~lake
    inner = np.array([[all(0 <= r + a < 24 and 0 <= c + b < 26 and open_[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) for c in range(26)] for r in range(24)])
    opened = np.array([[any(0 <= r + a < 24 and 0 <= c + b < 26 and inner[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) for c in range(26)] for r in range(24)])
    first = labelled(opened)
    want = labelled(np.isin(first, [k for k in range(1, first.max() + 1) if (first == k).sum() >= 30]))
    got = graph.openings(frame(spark, h=np.where(low, 1.0, 9.0), lake=lake), "h", "lake", 1, 30).collect()
    assert {(r["row"], r["col"]): r["label"] for r in got} == {q: int(want[q]) for q in zip(*np.nonzero(want))} and got

    z = np.cumsum(rng.uniform(0, 1, (16, 16)), axis=1)
    z[:, 9:] += 25
    z[5:9, 3:5] += 9
    gy, gx = np.gradient(z)
    slope = np.degrees(np.arctan(np.hypot(gx, gy)))
    bands = labelled(slope >= 50, True)
    stats = {k: (z[bands == k].max(), z[bands == k].min(), (slope[bands == k] >= 70).sum()) for k in range(1, bands.max() + 1)}
    stats = {k: v for k, v in stats.items() if v[0] - v[1] >= 6}
    rock = labelled(np.isin(bands, list(stats)) & (slope >= 70))
    cells = [(r, c) for r, c in np.ndindex(z.shape) if bands[r, c] in stats]
    assert stats and rock.any()
    for r in graph.steep_bands(frame(spark, z=z), "z", 1.0, cliff=70, steep=50, least_area=3, least_relief=6, base_reach=5, top_reach=4).collect():
        q = (r["row"], r["col"])
        d2, c_, r_ = min(((q[0] - a) ** 2 + (q[1] - b) ** 2, b, a) for a, b in cells)
        high, lowest, area = stats[bands[r_, c_]]
        tall = min(max((high - lowest) / 30, 0.35), 1) * (1 if area >= 3 else 0.7)
        gentle, above = slope[q] < 25 and d2 > 0, z[q] >= (high + lowest) / 2
        assert r["rock"] == bool(rock[q] and (rock == rock[q]).sum() >= 3)
        assert abs(r["base"] - (max(1 - math.sqrt(d2) / 5, 0) * tall if gentle and not above else 0)) < 1e-9
        assert abs(r["top"] - (max(1 - math.sqrt(d2) / 4, 0) * tall if gentle and above else 0)) < 1e-9


def test_discs_and_distances(spark):
    rng = np.random.default_rng(7)
    v, mask = rng.integers(0, 5, (11, 14)), rng.random((11, 14)) < 0.1
    df = frame(spark, v=v, m=mask)
    true = list(zip(*np.nonzero(mask)))
    for r in lattice.disc_total(df, "v", 3.7).collect():
        assert r["total"] == sum(v[a, b] for a, b in np.ndindex(v.shape) if (a - r["row"]) ** 2 + (b - r["col"]) ** 2 <= 3.7**2)
    for r in lattice.nearest_any(df, "m").collect():
        d2, c, a = min(((a - r["row"]) ** 2 + (b - r["col"]) ** 2, b, a) for a, b in true)
        assert (r["d2"], r["near_col"], r["near_row"]) == (d2, c, a)
    for reach in (4.5, lattice.WIDE + 0.5):
        for r in lattice.nearest_true(df, "m", reach).collect():
            best = min(((a - r["row"]) ** 2 + (b - r["col"]) ** 2, b, a) for a, b in true)
            assert (r["d2"], r["near_col"], r["near_row"]) == (best if best[0] <= reach**2 else (None,) * 3)
    none = lattice.nearest_any(df.withColumn("m", F.lit(False)), "m")
    assert none.where("d2 is not null").isEmpty() and none.count() == v.size
    with pytest.raises(Exception, match="without any value"):
        lattice.holes_filled(df.withColumn("x", F.lit(None).cast("double")), "x").collect()


def test_ranks_without_one_task(spark):
    rng = random.Random(2)
    values = [(rng.choice("ab"), rng.choice([None, *map(float, range(6)), rng.random()])) for _ in range(300)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, k string, v double")
    for r in ranks.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], ["k"]).collect():
        assert abs(r["v"] - np.quantile([v for k, v in values if k == r["k"] and v is not None], r["q"])) < 1e-12
    order = sorted(range(300), key=lambda i: (values[i][0], i))
    got = {r["id"]: r["n"] for r in ranks.numbered(df, [F.col("k"), F.col("id")], "n").collect()}
    assert [got[i] for i in order] == list(range(1, 301))
    assert ranks.quantiles(df.limit(0), "v", [0.5]).count() == 0
    share = {r["id"]: r["position"] for r in picks.share_above(df, "v", ["k"]).collect()}
    for i, (k, v) in enumerate(values):
        own = [x for q, x in values if q == k and x is not None]
        assert share[i] is None if v is None else abs(share[i] - (sum(x < v for x in own) + 0.5 * own.count(v)) / len(own)) < 1e-12


def test_two_lists_of_spots(spark):
    rng = np.random.default_rng(8)
    score, private = rng.uniform(0, 60, (30, 30)), rng.random((30, 30)) < 0.3
    rows = picks.two_lists(frame(spark, s=score, pr=private, pu=~private), "s", "pu", "pr", 1.0, 2, 1, 6.0, 2, 30, 30, 6).collect()
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    w /= w.sum()
    for mask, prefix in ((~private, "#"), (private, "P")):
        own = np.where(mask, score, 0.0)
        pad = np.pad(own, 4, mode="symmetric")
        smooth = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), 0, np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), 1, pad))
        high = min(5, max(0.5, 0.2 * smooth[mask].max()))
        seen = np.where(mask, smooth, -1)
        peaks = [(smooth[q], q) for q in np.ndindex(30, 30) if mask[q] and smooth[q] > high and seen[q] == seen[max(q[0] - 2, 0) : q[0] + 3, max(q[1] - 2, 0) : q[1] + 3].max()]
        peaks = sorted(peaks, reverse=True)[:48]
        moved = []
        for _, (r, c) in peaks:
            q = max(((own[a, b], -a, -b) for a in range(max(r - 1, 0), min(r + 2, 30)) for b in range(max(c - 1, 0), min(c + 2, 30))))
            moved.append((-q[0], -q[1], -q[2]))
        kept = []
        for s, r, c in sorted(moved):
            if sum(math.hypot(r - a, c - b) < 6 for _, a, b in kept) < 2 and len(kept) < 6:
                kept.append((s, r, c))
        got = sorted((r["rank"], r["row"], r["col"]) for r in rows if r["name"].startswith(prefix))
        assert got == [(i, r, c) for i, (_, r, c) in enumerate(kept, 1)] and len(got) > 3


def test_free_ids_skip_those_taken(spark):
    taken = spark.createDataFrame([("cam#2",), ("pin",), ("pin#2",), ("pin#4",), ("x#2",)], "id string")
    rows = spark.createDataFrame([("cam", 1), ("cam", 2), ("pin", 3), ("pin", 4), ("x#2", 5), ("new", 6)], "base string, o int")
    got = {r["o"]: r["id"] for r in records.named(rows, "base", "o", taken).collect()}
    assert got == {1: "cam", 2: "cam#3", 3: "pin#3", 4: "pin#5", 5: "x#2#2", 6: "new"}


def test_boyce_of_planted_use(spark):
    rng = random.Random(4)
    of = lambda used, available: spark.createDataFrame([(v, True) for v in used] + [(v, False) for v in available], "v double, u boolean")
    available = [rng.random() for _ in range(500)]
    got = evidence.boyce(of([rng.random() ** 0.4 for _ in range(300)], available), "v", "u").first()
    assert got["bins"] == 10 and got["boyce"] > 0.9
    for used, rest in (([0.5] * 4, available), ([0.5] * 9, [0.1] * 9), ([0.5] * 9, [0.1, 0.2] * 20), ([], available)):
        r = evidence.boyce(of(used, rest), "v", "u").first()
        assert r["boyce"] is None


def test_rates_compare_cameras_on_features_only(spark):
    rows = [("a", "on-feature", 40.0, 3, 0.2), ("a", "off-feature", 100.0, 50, 9.0), ("b", "on-feature", 20.0, 9, 0.1), ("c", "unrecorded", 80.0, 1, 0.4)]
    got = {(r["arm"], r["placement"]): r for r in evidence.rates(spark.createDataFrame(rows, "arm string, placement string, nights double, hits long, expected double"), "arm", "placement").collect()}
    a, b, c = got["a", None], got["b", None], got["c", None]
    assert a["per_100"] == round(100 * 53 / 140, 3) and a["ratio"] == 15.0 and abs(a["p"] - 0.0011) < 1e-9 and not a["few"]
    assert b["ratio"] is None and b["few"] and b["per_100"] == 45.0 and c["compared_nights"] == 0 and c["base_per_100"] is None
    assert got["a", "off-feature"]["cameras"] == 1 and got["a", "off-feature"]["ratio"] is None
    tail = spark.range(1).select(evidence.poisson_tail(F.lit(3100), F.lit(3000.0)), evidence.poisson_tail(F.lit(2900), F.lit(3000.0))).first()
    assert abs(tail[0] - 0.0348) < 5e-4 and abs(tail[1] - 0.9671) < 5e-4


def test_lines_end_and_cells_are_all_touched(spark):
    points = [("a", 0, 0.3, 9.7), ("a", 1, 6.4, 2.2), ("a", 2, 6.4, 8.9), ("b", 0, 1.0, 1.0), ("c", 0, 2.0, 2.0), ("c", 1, 2.0, 2.0)]
    df = spark.createDataFrame(points, "line string, o int, x double, y double")
    dense = sorted((r["line"], r["k"], round(r["x"], 6), round(r["y"], 6)) for r in vectors.densified(df, "line", "o", "x", "y", 5.0).collect())
    assert ("a", 0, 0.3, 9.7) in dense and ("a", 4, 6.4, 8.9) in dense and ("b", 0, 1.0, 1.0) in dense and ("c", 0, 2.0, 2.0) in dense and len(dense) == 7
    got = {(r["line"], r["row"], r["col"]) for r in vectors.burned_lines(df, "line", "o", "x", "y", 0.0, 10.0, 1.0).collect()}
    want = set()
    for (k, _, x, y), (k2, _, x2, y2) in zip(points, points[1:]):
        if k == k2:
            want |= {(k, math.floor(10 - (y + (y2 - y) * t)), math.floor(x + (x2 - x) * t)) for t in np.linspace(0, 1, 20_001)}
    assert got == want | {("b", 9, 1)}


def test_files_of_weather_grids_and_collars(spark, tmp_path):
    weather = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_direction": [10.0, None], "wind_speed": [1.0, 2.0], "pressure": [1000.0, 1001.0], "precipitation": [0.0, 0.5]}, "daily": {"time": ["2024-01-01"], "sunrise": ["2024-01-01T07:30"], "sunset": ["2024-01-01T16:15"]}}
    (tmp_path / "w.json").write_text(json.dumps(weather))
    rows = sorted(readers.hourly(spark, str(tmp_path / "w.json")).collect(), key=lambda r: str(r["ts"]))
    assert len(rows) == 2 and rows[0]["wind_direction"] == 10.0 and rows[1]["wind_direction"] is None and rows[1]["precipitation"] == 0.5
    day = readers.daylight(spark, str(tmp_path / "w.json")).first()
    assert (day["sunrise"], day["sunset"]) == (450, 975)
    collar = {"individuals": [{"individual_local_identifier": "m1", "individual_taxon_canonical_name": "Puma concolor", "locations": [{"timestamp": 1704067200000, "location_long": -117.5, "location_lat": 47.5}, {"timestamp": 1704070800000, "location_long": None, "location_lat": 47.5}]}, {"individual_local_identifier": "d", "individual_taxon_canonical_name": "Odocoileus", "locations": []}]}
    (tmp_path / "c.json").write_text(json.dumps(collar))
    got = readers.collar_json(spark, str(tmp_path / "c.json"), "Puma concolor").collect()
    assert [(r["animal"], r["lon"], str(r["ts"])) for r in got] == [("m1", -117.5, "2024-01-01 00:00:00")]
    grid = np.array([[1, -9999, 300], [4, 5, 6]], dtype=">i2")
    for name, content in (("g.dat", grid.tobytes()), ("h.dat.gz", gzip.compress(grid.tobytes()))):
        (tmp_path / name).write_bytes(content)
        lines = {r["row"]: list(r["line"]) for r in readers.grid_file(spark, str(tmp_path / name), 2, 3).collect()}
        assert lines == {0: [1, None, 300], 1: [4, 5, 6]}


def test_sinks_as_text(spark):
    df = spark.createDataFrame([("f", "b <1>", "x & y", -117.0, 47.0, 0.5), ("f", "a", "", -118.0, 48.0, 0.02)], "folder string, name string, description string, lon double, lat double, v double")
    kml = sinks.kml_folders(df, "folder", "name", "description").first()["kml"]
    assert kml.index("<name>a</name>") < kml.index("<name>b &lt;1&gt;</name>") and "x &amp; y" in kml and "-117.0,47.0,0" in kml
    one = json.loads(df.select(sinks.geojson("Point", F.array("lon", "lat"), "name", "v")).first()[0])
    assert one == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-117.0, 47.0]}, "properties": {"name": "b <1>", "v": 0.5}}
    shades = [r[0] for r in df.orderBy("name").select(sinks.colour(F.col("v"), [(0.0, 0, 0, 0), (1.0, 200, 100, 50)], 0.08)).collect()]
    assert (shades[0]["a"], shades[1]["r"], shades[1]["g"], shades[1]["b"]) == (0, 100, 50, 25) and shades[1]["a"] == round(255 * ((0.5 - 0.08) / 0.92) ** 0.7)


def test_codes_and_times(spark):
    one = spark.createDataFrame([("  Hiking_Trail ", "2024-07-01T05:00:00Z", "2024-07-01")], "code string, at string, day string")
    code = scalar.normalised_code("code", {"hiking-trail": "trail"})
    r = one.select(code.alias("c"), scalar.must_be(code, ["trail"]).alias("m"), scalar.local_time("at", "America/Los_Angeles").alias("t"), scalar.local_time("day", "America/Los_Angeles").alias("d")).first()
    assert (r["c"], r["m"], str(r["t"]), str(r["d"])) == ("trail", "trail", "2024-06-30 22:00:00", "2024-07-01 00:00:00")
    with pytest.raises(Exception, match="not allowed: trail"):
        one.select(scalar.must_be(code, ["road"])).collect()
    with pytest.raises(Exception, match="unknown version 3"):
        records.versioned(spark.createDataFrame([(3,)], "v int"), "v", 2).collect()
    log = spark.createDataFrame([("a", None), ("b", "x")], "id string, sender string")
    assert [r["id"] for r in records.own(log).collect()] == ["a"]


def test_approaches_lead_under_cover_to_water(spark):
    """A spring in the middle of a strip of cover: the way along the strip counts, the far end and the bare ground beside do not; downwind is better."""
    shape = (9, 41)
    dest, covered, bed = (np.zeros(shape, bool) for _ in range(3))
    dest[4, 20], covered[3:6, :] = True, True
    bed[4, 5:9] = bed[4, 32:36] = True
    df = frame(spark, cost=np.where(covered, 1.0, 4.0), dest=dest, covered=covered, bed=bed, fx=np.full(shape, 1.0), fn=np.zeros(shape))
    from spurline.operators import site

    got = {(r["row"], r["col"]): r["approach"] for r in site.approaches(df, "cost", "dest", "bed", "covered", F.lit(1.0), ("fx", "fn"), 10.0, 5.0, 400.0, 60.0, (40.0, 160.0), tile=16).collect()}
    assert len(got) == 9 * 41 and got[4, 20] == 0 and got[4, 24] > got[4, 16] > 0 and got[4, 38] == 0 and got[0, 24] == 0


def test_walks_keep_off_closed_ground(spark):
    from spurline.operators import site

    shape = (5, 7)
    road, closed = np.zeros(shape, bool), np.zeros(shape, bool)
    road[2, 0], closed[:4, 3] = True, True
    got = {(r["row"], r["col"]): r for r in site.walks(frame(spark, slope=np.zeros(shape), road=road, closed=closed), "slope", "road", "closed", 10.0, tile=4).collect()}
    assert got[0, 3]["walk_m"] is None and got[2, 0]["walk_s"] == 0 and abs(got[2, 2]["walk_m"] - 20) < 1e-9
    assert abs(got[2, 6]["walk_m"] - (20 + 40 * math.sqrt(2))) < 1e-6 and abs(got[2, 2]["walk_s"] - 20 * 3.6 / (6 * math.exp(-3.5 * 0.05))) < 1e-6


def test_means_round_as_sql_rounds_them(spark):
    """Halves that a sum missed by its last bit go up as in SQL, zero keeps its sign, and means don't hang on how rows are dealt out."""
    df = spark.createDataFrame([(0.41249999999999998,), (0.0624999999999999999,), (1.0004999999999997,), (-0.0002,), (-0.0005,), (float("nan"),), (None,)], "x double")
    got = [r["x"] for r in df.select(evidence.half_away("x", 3).alias("x")).collect()]
    assert repr(got) == "[0.413, 0.063, 1.0, -0.0, -0.001, nan, None]"
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, float(v), 10, 200.0 * (i % 2)) for i, v in enumerate(rng.uniform(0, 1, 900))]
    want = {}
    for _, k, v, _, _ in rows:
        want[k] = want.get(k, 0.0) + v
    for parts in (1, 7):
        dealt = spark.createDataFrame(rows, "at long, kind int, rank double, k int, step double").orderBy(F.desc("at")).repartition(parts)
        for r in evidence.summaries(dealt, ["kind"], order="at").collect():
            assert r["rank"] == math.floor(want[r["kind"]] / 300 * 1000 + 0.5) / 1000 and r["moving"] == 150
    sides = [spark.createDataFrame([(i, 20, v) for i, v in enumerate(vs)], "key int, n int, value double") for vs in ([0.5, 0.4, 0.3], [0.5, 0.4, 0.301])]
    assert str(evidence.compared(*sides, "key", "value").first()["mean_diff"]) == "-0.0"


def test_nearest_of_many_at_one_place(spark):
    """Others at one place are one before they meet the points, so the pairs don't grow with copies of a place; the first in order stands for it."""
    rng = np.random.default_rng(9)
    places = [(float(x), float(y)) for x, y in rng.integers(0, 6, (12, 2)) * 10]
    others = [(i, *places[(i * 7) % 12]) for i in range(400, 0, -1)] + [(401, None, 1.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-5, 60, (80, 2)))] + [(900, None, 2.0)]
    found = vectors.nearest_within(spark.createDataFrame(points, "key long, x double, y double"), spark.createDataFrame(others, "id long, x double, y double"), "key", "x", "y", 12.0, "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    got = {r["key"]: (r["distance"], r["near"]) for r in found.collect()}
    for k, x, y in points:
        near = min(((math.hypot(u - x, v - y), i) for i, u, v in others if u is not None and x is not None and math.hypot(u - x, v - y) < 12), default=(None, None))
        assert got[k] == near


def test_means_hold_where_the_order_has_ties_or_nulls(spark):
    """Ranks that tie in the order add up alike however they are dealt out, and ranks without a place in it count."""
    vs = (0.10442, 0.19412000000000001, 0.66596)
    for at in (7, None):
        for dealt in (vs, (vs[2], vs[0], vs[1])):
            df = spark.createDataFrame([(at, 0, v, 10, 200.0) for v in dealt], "at long, kind int, rank double, k int, step double").coalesce(1)
            got = evidence.summaries(df, ["kind"], order="at").first()
            assert (got["n"], got["rank"], got["moving_rank"]) == (3, 0.322, 0.322)
    assert str(spark.createDataFrame([(-0.0,)], "x double").select(evidence.half_away("x", 3)).first()[0]) == "-0.0"


def test_scores_compare_events_without_a_kind_last(spark, tmp_path):
    """Kinds in SQL's order: click before view, none after both; events without an id count."""
    from spurline.plans import land

    rows = [(None if u == 2 else i, u, kind, v) for u in (1, 2) for kind, v in (("click", 50.0), ("view", 100.0), (None, 75.0)) for i in range(5)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_type"]: (r["pairs"], r["better"], r["worse"], r["mean_diff"]) for r in land.QUERIES["score_comparison"](spark, str(tmp_path)).collect()}
    assert got == {"view": (2, 2, 0, 0.1), None: (2, 0, 2, -0.05)}


def test_scores_add_up_in_the_order_of_the_table(spark, tmp_path):
    """Means that are halves go up or down by the order of addition: it is that of the rows, file by file, whatever their ids. A pair without an own value is a pair."""
    from spurline.plans import land

    rng = np.random.default_rng(12)
    kinds, groups = ("click", "view"), []
    for user in range(300):
        total = 300 * int(rng.integers(200, 400)) + 150
        for kind in kinds:
            cents = rng.multinomial(total, rng.dirichlet(np.ones(6)))
            groups += [(user, kind, int(c) / 100) for c in cents]
    rows = [groups[i] for i in rng.permutation(len(groups))] + [(300, k, v) for k, v in (("click", 10.0), ("view", None)) for _ in range(5)]

    def by_hand(order):
        sums = {}
        for user, kind, v in order:
            if v is not None:
                sums[user, kind] = sums.get((user, kind), 0.0) + v / 500
        mean = {k: math.floor(x / 6 * 1000 + 0.5) / 1000 for k, x in sums.items() if k[0] < 300}
        return tuple(sum(sign * (mean[u, "view"] - mean[u, "click"]) > 0 for u in range(300)) for sign in (1, -1))

    (tmp_path / "events.parquet").mkdir()
    ids = np.arange(len(rows))[::-1]
    for name, part in (("a", slice(0, 900)), ("b", slice(900, None))):
        columns = list(zip(*rows[part]))
        pq.write_table(pa.table({"event_id": pa.array(ids[part]), "user_id": pa.array(columns[0], pa.int64()), "event_type": pa.array(columns[1]), "value": pa.array(columns[2], pa.float64())}), tmp_path / f"events.parquet/{name}.parquet")
    got = land.QUERIES["score_comparison"](spark, str(tmp_path)).collect()
    assert [(r["event_type"], r["pairs"], r["better"], r["worse"]) for r in got] == [("view", 301, *by_hand(rows))]
    assert by_hand(rows) != by_hand(rows[::-1])
