"""Queries of terrain, cover, roads, spots and their tests over the lattice of line items and the star tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spurline.functions import scalar as S
from spurline.operators import climate, current, evidence, graph, lattice, picks, records, saddles, shores, site, vectors
from spurline.operators.store import keep
from spurline.plans.fields import fixes
from spurline.plans.grids import FACTORS, LATTICE, SIZE, layers, masked, points, r6, scored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{LATTICE}", LATTICE)
        return f

    return add


def gauss_sql(out: str, src: str, sigma: float, h: int, w: int, mode: str = "reflect") -> str:
    """CTEs that blur z of src (row, col, z) into out."""
    k = min(int(4 * sigma + 0.5), h, w)

    def edge(x: str, n: int) -> str:
        return f"greatest(least({x}, {n - 1}), 0)" if mode == "nearest" else f"case when {x} < 0 then -1 - ({x}) when {x} >= {n} then {2 * n - 1} - ({x}) else {x} end"

    return f"""{out}_w as (select cast(i as int) as i, exp(-0.5 * (i / {sigma}) * (i / {sigma})) as w from range(-{k}, {k} + 1) t(i)),
{out}_h as (select l.row, l.col, sum(k.w * b.z) / (select sum(w) from {out}_w) as z from {src} l cross join {out}_w k join {src} b on b.row = l.row and b.col = ({edge('l.col + k.i', w)}) group by l.row, l.col),
{out} as (select l.row, l.col, sum(k.w * b.z) / (select sum(w) from {out}_w) as z from {src} l cross join {out}_w k join {out}_h b on b.col = l.col and b.row = ({edge('l.row + k.i', h)}) group by l.row, l.col)"""


def slope_sql(out: str, src: str, cell: float) -> str:
    """CTEs of the slope and the downhill unit vector of z of src."""
    return f"""{out}_g as (select row, col, z, (coalesce(lead(z) over (partition by row order by col), z) - coalesce(lag(z) over (partition by row order by col), z)) / (case when col in (0, 63) then {cell} else 2 * {cell} end) as gx,
 (coalesce(lead(z) over (partition by col order by row), z) - coalesce(lag(z) over (partition by col order by row), z)) / (case when row in (0, 63) then {cell} else 2 * {cell} end) as gy from {src}),
{out} as (select row, col, z, sqrt(gx * gx + gy * gy) as rise, degrees(atan(sqrt(gx * gx + gy * gy))) as slope, case when sqrt(gx * gx + gy * gy) > 1e-6 then -gx / sqrt(gx * gx + gy * gy) else 0 end as east,
 case when sqrt(gx * gx + gy * gy) > 1e-6 then gy / sqrt(gx * gx + gy * gy) else 0 end as north from {out}_g)"""


def offsets_sql(k: int) -> str:
    return f"offs as (select cast(a.i as int) as dr, cast(b.i as int) as dc from range(-{k}, {k} + 1) a(i) cross join range(-{k}, {k} + 1) b(i))"


ZLAT = "zl as (select row, col, z from lat)"


@query("with {LATTICE}, " + ZLAT + """, pad as (select cast(r.i as int) as row, cast(c.i as int) as col, z from range(66) r(i) cross join range(66) c(i) join lat on lat.row = least(r.i, 63) and lat.col = least(c.i, 63)),
small as (select cast(row // 3 as int) as row, cast(col // 3 as int) as col, avg(z) as z from pad group by 1, 2), """ + gauss_sql("sb", "small", 4.0, 22, 22) + """,
x as (select row, col, (row + 0.5) / 3 - 0.5 as y, (col + 0.5) / 3 - 0.5 as x from lat), f as (select row, col, floor(y) as r0, floor(x) as c0, y - floor(y) as fy, x - floor(x) as fx from x)
select f.row, f.col, round(sum(z * (case when i = 0 then 1 - fy else fy end) * (case when j = 0 then 1 - fx else fx end)), 6) as z from f cross join range(2) a(i) cross join range(2) c(j)
join sb b on b.row = greatest(least(r0 + i, 21), 0) and b.col = greatest(least(c0 + j, 21), 0) group by f.row, f.col""")
def wide_blur(spark, sf):
    """Twelve cells wide, so by way of the means of blocks of three, whose last one is only begun."""
    return lattice.blurred(layers(spark, sf).select("row", "col", "z"), "z", 12.0, SIZE, SIZE).select("row", "col", r6("z").alias("z"))


@query("with {LATTICE}, " + ZLAT + ", " + gauss_sql("sm", "zl", 1.0, 64, 64, "nearest") + ", " + slope_sql("sl", "sm", 1.0) + ", " + offsets_sql(4) + """,
sun as (select row, col, (degrees(atan2(east, north)) + 360) - 360 * floor((degrees(atan2(east, north)) + 360) / 360) between 100 and 215 and slope >= 10 as sunny from sl)
select a.row, a.col, round(greatest(least((count(b.row) / (select count(*) from offs where dr * dr + dc * dc <= 16)::double - 0.2) / (0.45 - 0.2), 1), 0), 5) as thermal
from lat a cross join offs left join sun b on b.sunny and b.row = a.row + dr and b.col = a.col + dc where dr * dr + dc * dc <= 16 group by a.row, a.col""")
def thermal_slopes(spark, sf):
    return lattice.thermal(layers(spark, sf).select("row", "col", "z"), "z", 1.0, SIZE, SIZE, 1.0, radius=4.0).select("row", "col", F.round("thermal", 5).alias("thermal"))


@query("with {LATTICE}, c as (select cast(row // 4 as int) as r, cast(col // 4 as int) as c, z from lat where row % 4 = 0 and col % 4 = 0), " + offsets_sql(3) + """,
e as (select a.r, a.c, min(b.z) as lo, max(b.z) as hi from c a cross join offs join c b on b.r = a.r + dr and b.c = a.c + dc group by a.r, a.c),
ul as (select row, col, lo as z from lat join e on e.r = row // 4 and e.c = col // 4), uh as (select row, col, hi as z from lat join e on e.r = row // 4 and e.c = col // 4), """ + gauss_sql("gl", "ul", 2.0, 64, 64) + ", " + gauss_sql("gh", "uh", 2.0, 64, 64) + """
select lat.row, lat.col, round(greatest(least(1 - (lat.z - gl.z) / greatest(gh.z - gl.z, 2.0), 1), 0), 6) as low from lat join gl using (row, col) join gh using (row, col)""")
def low_ground(spark, sf):
    return lattice.low_ground(layers(spark, sf).select("row", "col", "z"), "z", 4, 3, 2.0, SIZE, SIZE, 2.0).select("row", "col", r6("low").alias("low"))


@query("with {LATTICE}, " + """ds as (select unnest(range(12)) as i), dist as (select 10.0 + i * (120.0 - 10.0) / 11 as d from ds),
a as (select lat.row, lat.col, z, dist.d, least(greatest(lat.row - dist.d * cos(radians(250)) / 10, 0), 63) as y, least(greatest(lat.col + dist.d * sin(radians(250)) / 10, 0), 63) as x from (select row, col, z from lat) lat cross join dist),
v as (select a.row, a.col, a.z, a.d, sum(b.z * (case when i = 0 then 1 - (y - floor(y)) else y - floor(y) end) * (case when j = 0 then 1 - (x - floor(x)) else x - floor(x) end)) as seen
 from a cross join range(2) p(i) cross join range(2) q(j) join lat b on b.row = least(floor(y) + i, 63) and b.col = least(floor(x) + j, 63) group by 1, 2, 3, 4)
select row, col, round(greatest(max(degrees(atan((seen - z) / d))), -90), 5) as shelter from v group by 1, 2""")
def upwind_shelter(spark, sf):
    far = [10.0 + i * (120.0 - 10.0) / 11 for i in range(12)]
    return lattice.upwind(layers(spark, sf).select("row", "col", "z"), "z", 10.0, 250.0, far).select("row", "col", F.round("shelter", 5).alias("shelter"))


FORMS = "[" + ", ".join("[" + ", ".join(map(str, row)) + "]" for row in lattice.LANDFORMS) + "]"
DIRS = "dirs as (select * from (values (0,-1,0),(1,-1,1),(2,0,1),(3,1,1),(4,1,0),(5,1,-1),(6,0,-1),(7,-1,-1)) t(dir, dr, dc))"


@query("with {LATTICE}, " + DIRS + f""", v as (select a.row, a.col, dir, max(atan((b.z - a.z) / (sqrt(dr * dr + dc * dc) * k.i * 10.0))) as up, max(-atan((b.z - a.z) / (sqrt(dr * dr + dc * dc) * k.i * 10.0))) as down
 from lat a cross join dirs cross join range(1, 6) k(i) join lat b on b.row = a.row + dr * k.i and b.col = a.col + dc * k.i group by 1, 2, 3),
n as (select row, col, count(*) filter (up > radians(4) and up > down) as higher, count(*) filter (down > radians(4) and down > up) as lower from v group by 1, 2)
select row, col, cast(case when {FORMS}[lower + 1][higher + 1] = 0 then 6 else {FORMS}[lower + 1][higher + 1] end as int) as landform from n""")
def landform_table(spark, sf):
    return lattice.landforms(layers(spark, sf).select("row", "col", "z"), "z", 10.0, 5, 4.0).select("row", "col", "landform")


NEAR = """n as (select a.row, a.col, min((a.row - b.row) ** 2 + (a.col - b.col) ** 2) as d2 from lat a left join masked b on b.hit and b.t > 0.04 and (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 36 group by 1, 2)"""


@query("with {LATTICE}, " + NEAR + """ select row, col, round(case when lat.p > 40000 then 0 when d2 is null then 0 else greatest(1 - sqrt(d2) / 6, 0) end, 6) as near, round(0.6 + 0.4 * coalesce(greatest(1 - sqrt(d2) / 6, 0), 0), 6) as factor from lat join n using (row, col)""")
def soft_edges(spark, sf):
    """Nearness to marked cells, none on excluded ones, and the same as a feathered factor of what lies inside."""
    m = masked(spark, sf).withColumns({"mark": F.col("hit") & (F.col("t") > 0.04), "out": F.col("p") > 40000})
    near = lattice.soft(lattice.soft(m, "mark", 6.0, "near", exclude="out"), "mark", 6.0, "inside")
    return near.select("row", "col", r6("near").alias("near"), r6(0.6 + 0.4 * F.col("inside")).alias("factor"))


@query("""with {LATTICE} select row, col, cast(d2 as int) as d2, near_row, near_col from (select a.row, a.col, b.row as near_row, b.col as near_col, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 as d2,
 row_number() over (partition by a.row, a.col order by (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.col, b.row) as k from lat a left join sup b on abs(a.row - b.row) <= 3 and abs(a.col - b.col) <= 3) where k = 1""")
def window_nearest(spark, sf):
    marks = points(spark, sf).withColumn("there", F.lit(True))
    return lattice.nearest_true(layers(spark, sf).join(marks, ["row", "col"], "left"), "there", 3, square=True).select("row", "col", "d2", "near_row", "near_col")


@query()
def openings(spark, sf):
    return graph.openings(masked(spark, sf), "z", "hit", 1, 10, 45.0).select("row", "col", "label", "cells")


@query()
def steep_bands(spark, sf):
    found = graph.steep_bands(keep(layers(spark, sf).select("row", "col", "z")), "z", 4.0, cliff=63.0, steep=60.0, least_area=20.0, least_relief=3.0, base_reach=12.0, top_reach=8.0)
    return found.select("row", "col", "rock", r6("base").alias("base"), r6("top").alias("top"))


@query("with {LATTICE}, " + ZLAT + ", q as (select quantile_cont(z, [i / 200.0 for i in range(201)]) as t, greatest(1, max(abs(z))) as top from lat), " + """e as (select [t[i + 1] + i * 1e-9 * top for i in range(201)] as e, t[201] - t[1] > 1e-12 as wide from q),
k as (select row, col, z, e, wide, len(list_filter(e, lambda x: x <= z)) as k from lat cross join e)
select row, col, round(case when not wide then 0.5 when k = 0 then 0 when k >= 201 then 1 else (k - 1 + (z - e[k]) / (e[k + 1] - e[k])) / 200 end, 5) as position from k""")
def quantile_rank(spark, sf):
    return lattice.ranked_by_quantiles(layers(spark, sf).select("row", "col", "z"), "z").select("row", "col", F.round("position", 5).alias("position"))


@query("with {LATTICE}, " + offsets_sql(5) + """, tp as (select a.row, a.col, a.z - avg(b.z) as t from lat a cross join offs join lat b on b.row = greatest(least(a.row + dr, 63), 0) and b.col = greatest(least(a.col + dc, 63), 0) group by a.row, a.col, a.z),
q as (select quantile_cont(t, [i / 200.0 for i in range(201)]) as t, greatest(1, max(abs(t))) as top from tp), e as (select [t[i + 1] + i * 1e-9 * top for i in range(201)] as e from q),
k as (select row, col, t, e, len(list_filter(e, lambda x: x <= t)) as k from tp cross join e),
p as (select row, col, t, 2 * case when k = 0 then 0 when k >= 201 then 1 else (k - 1 + (t - e[k]) / (e[k + 1] - e[k])) / 200 end - 1 as pos from k), l as (select *, abs(pos) ** 2 * least(abs(t) / 3.0, 1) as line from p)
select row, col, round(pos, 4) + 0.0 as pos, round(case when pos < 0 then line else 0 end, 4) as bottom, round(case when pos > 0 then line else 0 end, 4) as spine from l""")
def travel_parts(spark, sf):
    found = lattice.travel_parts(keep(layers(spark, sf).select("row", "col", "z")), "z", 5, SIZE, SIZE)
    return found.select("row", "col", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("pos", "bottom", "spine")))


@query("""with m as (select event_type, median(value) as m from events group by 1), d as (select event_type, median(abs(value - m)) as d from events join m using (event_type) group by 1) select event_type, round(case when d > 0 then 1.4826 * d else 1 end, 6) as spread from d""")
def robust_spread(spark, sf):
    return evidence.robust_spread(table(spark, sf, "events"), "value", ["event_type"]).withColumn("spread", r6("spread"))


@query("with {LATTICE}, " + offsets_sql(3) + " select a.row, a.col, round(max(b.z) - min(b.z), 6) as relief from lat a cross join offs join lat b on b.row = a.row + dr and b.col = a.col + dc group by a.row, a.col")
def relief(spark, sf):
    return lattice.relief(layers(spark, sf).select("row", "col", "z"), "z", 3).select("row", "col", r6("relief").alias("relief"))


@query("with {LATTICE}, g as (select row, col, case when not hit then z end as z from masked) " + """select row, col, z from (select a.row, a.col, b.z, row_number() over (partition by a.row, a.col order by (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.col, b.row) as k
 from g a join g b on b.z is not null and abs(a.row - b.row) <= 12 and abs(a.col - b.col) <= 12) where k = 1""")
def holes_filled(spark, sf):
    gaps = masked(spark, sf).select("row", "col", F.when(~F.col("hit"), F.col("z")).alias("z"))
    return lattice.holes_filled(keep(gaps), "z").select("row", "col", "z")


def _cost_tree(spark, sf) -> DataFrame:
    cells = keep(masked(spark, sf).select("row", "col", (1 + F.col("d") * 20).alias("cost"), "hit", ((F.col("row") * 7 + F.col("col") * 3) % 211 == 0).alias("source")))
    return graph.least_cost(cells, "cost", "source", 10.0, cutoff=1500.0, tile=32).join(cells.select("row", "col", "hit"), ["row", "col"])


@query()
def cost_tree(spark, sf):
    """Ways to the nearest of a few destinations, how much of their last 60 m is covered, and what comes through each cell of them."""
    tree = keep(graph.covered_share(keep(_cost_tree(spark, sf)), "hit", 10.0, 60.0))
    at = lambda r, c: (F.col(r) * SIZE + F.col(c)).cast("long")
    flow = graph.accumulated(tree.where("reach is not null").select(at("row", "col").alias("id"), at("from_row", "from_col").alias("receiver"), F.lit(1.0).alias("one")), "one").select("id", F.col("total").alias("flow"))
    return tree.withColumn("id", at("row", "col")).join(flow, "id", "left").select("row", "col", r6("reach").alias("reach"), r6("length").alias("length"), "from_row", "from_col", "root_row", "root_col", r6("share").alias("share"), "flow")


@query()
def spot_lists(spark, sf):
    """Spots on public and on private ground: smoothed peaks, moved to the best cell beside them, spread over zones."""
    df = keep(scored(spark, sf).select("row", "col", "score", F.col("hit").alias("private"), (~F.col("hit")).alias("public")))
    return picks.two_lists(df, "score", "public", "private", 1.2, 3, 2, 12.0, 3, SIZE, SIZE, 10).select("name", "rank", "zone", "row", "col", r6("score").alias("score"))


@query("with {LATTICE}, " + FACTORS + ", sc as (select row, col, score as z from scored), " + gauss_sql("bl", "sc", 0.5, 64, 64) + """, sm as (select row, col, round(z, 9) as z from bl),
o as (select a.row, a.col, a.z, max(b.z) as high, bool_or(b.z = a.z and (b.row < a.row or (b.row = a.row and b.col < a.col))) as later from sm a join sm b on abs(a.row - b.row) <= 3 and abs(a.col - b.col) <= 3 group by 1, 2, 3),
pk as (select row, col, z from o where z = high and not later and z > 1e-6), pm as (select a.row, a.col, max(b.z) as v from sm a join sm b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2),
p as (select s.row * 64 + s.col as id, s.row, s.col, v from scored s join pm using (row, col) where hit)
select cast(id as int) as id, round(least(1, ((select count(*) from pk where pk.z > p.v) + 1) / (select count(*) from pk)::double), 6) as fraction,
 (select count(*) from pk where pk.z > p.v and sqrt((pk.row - p.row) ** 2 + (pk.col - p.col) ** 2) * 50 > 30 and sqrt((pk.row - p.row) ** 2 + (pk.col - p.col) ** 2) * 50 <= 1000) as better from p""")
def spot_ranks(spark, sf):
    """Where cells of one kind stand among an area's spots, and how many better spots are near."""
    df = keep(scored(spark, sf).select("row", "col", "hit", "score"))
    pins = df.where("hit").select((F.col("row") * SIZE + F.col("col")).cast("int").alias("id"), "row", "col")
    return picks.standing(pins, df, "id", "score", 50.0, SIZE, SIZE).select("id", r6("fraction").alias("fraction"), "better")


@query("""with f as (select user_id, ts, event_id, value * 10 as x, cast(json_extract_string(props, '$.k') as double) * 25 as y from events), s as (select s_suppkey as id, (s_suppkey * 37 % 500) * 10.0 as x, (s_suppkey * 13 % 100) * 25.0 as y from supplier),
m as (select f.event_id, s.id as near, sqrt((s.x - f.x) ** 2 + (s.y - f.y) ** 2) as d from f join s on sqrt((s.x - f.x) ** 2 + (s.y - f.y) ** 2) < 120), k as (select *, row_number() over (partition by event_id order by d, near) as k from m)
select f.event_id, near, round(d, 4) as distance from f left join k on k.event_id = f.event_id and k.k = 1""")
def nearest_point(spark, sf):
    """The supplier's place closer than 120 to each event's."""
    e = table(spark, sf, "events").select("event_id", (F.col("value") * 10).alias("x"), (F.get_json_object("props", "$.k").cast("double") * 25).alias("y"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 500 * 10.0).alias("x"), (F.col("s_suppkey") * 13 % 100 * 25.0).alias("y"))
    return vectors.nearest_within(e, s, "event_id", "x", "y", 120.0, "id").select("event_id", "near", F.round("distance", 4).alias("distance"))


@query("with {LATTICE}, " + FACTORS + """, k as (select row as r, col as c from scored order by score desc, row, col limit 12)
select sup.row, sup.col, round(min(sqrt((row - r) ** 2 + (col - c) ** 2)), 6) as distance from sup cross join k group by 1, 2""")
def top_distance(spark, sf):
    pts = points(spark, sf).withColumn("id", F.col("row") * SIZE + F.col("col"))
    return vectors.top_distance(pts, keep(scored(spark, sf).select("row", "col", "score")), "id", "score", 12).select("row", "col", r6("distance").alias("distance"))


@query("""with t as (select s_suppkey as id, s_suppkey * 22.5 % 360 as deg, s_acctbal as v, s_nationkey % 12 + 1 as m, s_suppkey % 46 as slope, s_suppkey * 3 % 80 as snow from supplier)
select id, round(-sin(radians(deg)), 6) + 0.0 as east, round(-cos(radians(deg)), 6) + 0.0 as north, round(greatest(least((log10(greatest(v, 1)) - 1.7) / 3.8, 1), 0), 6) as drainage, round(1 - 0.8 * greatest(least((snow - 25) / 35.0, 1), 0), 6) as snow,
 round(greatest((6 * exp(-3.5 * abs(tan(radians(slope)) + 0.05)) + 6 * exp(-3.5 * abs(-tan(radians(slope)) + 0.05))) / 2, 0.05), 6) as pace, round(1 - 0.5 * greatest(least((slope - 8) / 17.0, 1), 0), 6) as gentle,
 round(0.5 + 0.5 * greatest(least(-cos(radians(deg)), 1), 0) * greatest(least(slope / 100.0 / 0.25, 1), 0), 6) as sunny, case when m in (7, 8, 9) then 0.87 when m in (12, 1, 2) then 0.37 else 0.62 end as base, round(least(5, greatest(0.5, 0.2 * v / 100)), 6) as threshold,
 case m when 10 then '5,6,7,8,9,10,11' when 1 then '12,1,2,3,4' end as season, round((case when m < 4 then deg when m < 8 then v / 30 else deg + 300 end + 3600) - 360 * floor((case when m < 4 then deg when m < 8 then v / 30 else deg + 300 end + 3600) / 360), 4) as wind,
 case when m >= 10 then round(100.0 * slope / m, 2) end as rate from t""")
def factor_terms(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 22.5 % 360).alias("deg"), F.col("s_acctbal").alias("v"), (F.col("s_nationkey") % 12 + 1).alias("m"), (F.col("s_suppkey") % 46).alias("slope"), (F.col("s_suppkey") * 3 % 80).cast("double").alias("snow"))
    way = S.unit_from("deg")
    wind = S.wind_choice(F.when(F.col("m") < 4, F.col("deg")), F.when(F.col("m") < 8, F.col("v") / 30), F.col("deg") + 300)
    return t.select(
        "id", r6(way["east"]).alias("east"), r6(way["north"]).alias("north"), r6(S.drainage_strength("v")).alias("drainage"), r6(S.snow_use("snow")).alias("snow"), r6(S.walking_kmh("slope")).alias("pace"), r6(S.gentle("slope")).alias("gentle"),
        r6(S.sunny(F.cos(F.radians("deg")), F.col("slope") / 100.0)).alias("sunny"), S.base_rate("m").alias("base"), r6(S.threshold(F.col("v") / 100)).alias("threshold"), F.array_join(S.season_months("m").cast("array<string>"), ",").alias("season"), F.round(wind, 4).alias("wind"),
        S.rate_per_100("slope", "m", 10).alias("rate"),
    )


HIGHWAYS = ("motorway", "track", "residential", "service", "path", "secondary", "unclassified", "footway")
ROADS = f"""ways as (select s_suppkey as id, {list(HIGHWAYS)}[s_suppkey % 8 + 1] as highway, case s_nationkey % 5 when 0 then 'private' when 1 then 'yes' end as access, case s_suppkey % 7 when 0 then 'driveway' end as service, case s_suppkey % 3 when 0 then 'asphalt' when 1 then 'gravel' end as surface,
 case s_suppkey % 11 when 0 then 'fence' end as barrier, case s_suppkey % 13 when 0 then 'rail' end as railway, s_suppkey % 4 = 0 as forest, s_suppkey % 6 = 0 as open from supplier),
cls as (select *, case when access = 'private' or coalesce(service, '') = 'driveway' then null when highway in ('motorway', 'residential', 'secondary', 'unclassified') then 'yes' when highway in ('track', 'service') then 'maybe' end as drivable,
 highway in ('motorway', 'secondary') or coalesce(surface, '') = 'asphalt' as paved from ways)"""


def ways(spark, sf) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    tag = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    tags = F.array(
        tag("highway", F.element_at(F.array(*map(F.lit, HIGHWAYS)), (k % 8).cast("int") + 1)), tag("access", F.when(n % 5 == 0, "private").when(n % 5 == 1, "yes")), tag("service", F.when(k % 7 == 0, "driveway")),
        tag("surface", F.when(k % 3 == 0, "asphalt").when(k % 3 == 1, "gravel")), tag("barrier", F.when(k % 11 == 0, "fence")), tag("railway", F.when(k % 13 == 0, "rail")),
    )
    tags = F.map_from_entries(F.filter(tags, lambda e: e["value"].isNotNull()))
    return table(spark, sf, "supplier").select(k.alias("id"), tags.alias("tags"), (k % 4 == 0).alias("forest"), (k % 6 == 0).alias("open"))


@query(f"with {ROADS} select id, drivable, paved, coalesce(access, '') <> 'private' and not paved as quiet, coalesce(barrier, '') = 'fence' or coalesce(railway, '') <> '' as barrier from cls")
def road_classes(spark, sf):
    t = F.col("tags")
    return ways(spark, sf).select("id", S.drivable(t).alias("drivable"), S.paved(t).alias("paved"), S.quiet(t).alias("quiet"), S.is_barrier(t).alias("barrier"))


@query(f"with {ROADS} select id, 'mapped' as source from cls where drivable = 'yes' or (drivable = 'maybe' and not forest) union all select id, 'forest' from cls where open")
def open_roads(spark, sf):
    w = ways(spark, sf).withColumn("drivable", S.drivable(F.col("tags")))
    return records.combined_roads(w, w, "forest")


@query(f"""with {ROADS} select id, cast(case when forest and not open then 1 when forest then 2 when highway = 'track' and coalesce(access, '') <> 'private' and not paved then 3 when highway in ('path', 'footway') and coalesce(access, '') <> 'private' and not paved then 4 else 0 end as int) as kind from cls""")
def trail_kinds(spark, sf):
    """The quietest kind of line that a way is: closed forest road, seasonal forest road, two-track, trail."""
    t, w = F.col("tags"), ways(spark, sf)
    way = F.try_element_at(t, F.lit("highway"))
    kinds = [F.col("forest") & ~F.col("open"), F.col("forest"), (way == "track") & S.quiet(t), way.isin("path", "footway") & S.quiet(t)]
    return w.select("id", records.first_kind(w, [F.coalesce(k, F.lit(False)) for k in kinds]).cast("int").alias("kind"))


@query("""with d as (select c_custkey as id, case c_custkey % 5 when 0 then 'open-dirt' when 1 then 'game-trail' when 2 then 'none' when 3 then '' end as trail, case c_custkey % 3 when 0 then 'on-feature' when 1 then 'model' end as arm, ['certain', 'probable', 'possible', 'unheard'][c_custkey % 4 + 1] as level,
  -117.0 + c_custkey % 10 as lon, 47.0 + c_custkey % 7 as lat, c_custkey % 60 as name from customer)
select id, case when trail in ('open-dirt', 'game-trail') then 'on-feature' when trail <> '' then 'off-feature' when arm = 'on-feature' then 'on-feature' else 'unrecorded' end as placement,
 case when level = 'unheard' then null else level in ('certain', 'probable') end as sure, lon >= -115 and lon < -110 and lat >= 48 and lat < 52 as inside,
 name % 9 <= 1.5 or (name % 9 <= 6 and least(id * 7 % 180, 180 - id * 7 % 180) <= 30) as along from d""")
def record_classes(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "open-dirt").when(k % 5 == 1, "game-trail").when(k % 5 == 2, "none").when(k % 5 == 3, "").alias("trail"), F.when(k % 3 == 0, "on-feature").when(k % 3 == 1, "model").alias("arm"),
        F.element_at(F.array(*map(F.lit, ("certain", "probable", "possible", "unheard"))), (k % 4).cast("int") + 1).alias("level"), (k % 10 - 117.0).alias("lon"), (k % 7 + 47.0).alias("lat"), (k % 60 % 9).alias("far"),
    )
    return d.select("id", S.placement(F.col("trail"), F.col("arm")).alias("placement"), S.confident(F.col("level")).alias("sure"), S.inside_box(F.col("lon"), F.col("lat"), -115, 48, -110, 52).alias("inside"), S.along_line(F.col("far"), F.col("id") * 7, reach=6.0).alias("along"))


@query("""select p_partkey as id, p_size % 3 = 0 as lake, (contains(upper(p_type), 'STEEL') or p_size > 40) and (contains(lower(p_name), 'part-1') or contains(lower(p_name), 'part-3')) as winter from part""")
def feature_predicates(spark, sf):
    size = F.col("p_size")
    ftype = F.when(size % 3 == 0, F.when(size % 2 == 0, 390)).otherwise(460)
    fcode = F.when((size % 3 == 0) & (size % 2 == 1), 43601).otherwise(46006)
    name = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "part-1", "deer"), "part-3", "elk")
    notes, kind = F.regexp_replace(F.upper("p_type"), "STEEL", "winter"), F.when(size > 40, "Regular Concentration")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.is_lake(ftype, fcode).alias("lake"), S.is_winter_range(name, notes, kind).alias("winter"))


@query("""with b as (select s_suppkey as id, -118.0 + s_suppkey % 240 + 0.25 as w, 40.0 + s_suppkey % 5 as s from supplier), e as (select id, w, s, w + 1.5 as ee, s + 0.5 + id % 2 as n from b),
r as (select id, unnest(range(cast(floor(s) as bigint), cast(floor(n) as bigint) + 1)) as la, w, ee from e), c as (select id, la, unnest(range(cast(floor(w) as bigint), cast(floor(ee) as bigint) + 1)) as lo from r)
select id, string_agg('n' || lpad(cast(la + 1 as varchar), 2, '0') || case when lo < 0 then 'w' || lpad(cast(-lo as varchar), 3, '0') else 'e' || lpad(cast(lo as varchar), 3, '0') end, ',' order by la, lo) as tiles from c group by id""")
def degree_tiles(spark, sf):
    w, s = F.col("s_suppkey") % 240 - 117.75, F.col("s_suppkey") % 5 + 40.0
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(S.degree_tiles(w, s, w + 1.5, s + 0.5 + F.col("s_suppkey") % 2), ",").alias("tiles"))


@query("""with o as (select o_orderkey as id, o_orderdate::date as today from orders), y as (select id, today, case when make_date(year(today), 2, 1) < today then year(today) else year(today) - 1 end as y from o)
select id, array_to_string([cast(make_date(y - k, 2, 1) as varchar) for k in [0, 1, 2]], ',') as days from y""")
def past_days(spark, sf):
    days = S.past_days(F.to_date("o_orderdate"), F.lit(2), F.lit(1), 3)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(days.cast("array<string>"), ",").alias("days"))


@query("""select cast(l_orderkey % 64 as int) as row, cast(l_partkey % 64 as int) as col, round(quantile_cont(nullif(l_quantity, 1), 0.5), 6) as value, count(nullif(l_quantity, 1)) as years from lineitem group by 1, 2""")
def years_median(spark, sf):
    """The median over the days that have a value of a cell; none without any."""
    t = table(spark, sf, "lineitem").select((F.col("l_orderkey") % SIZE).cast("int").alias("row"), (F.col("l_partkey") % SIZE).cast("int").alias("col"), F.nullif("l_quantity", F.lit(1.0)).alias("v"))
    return t.groupBy("row", "col").agg(r6(F.median("v")).alias("value"), F.count("v").alias("years"))


@query("""with d as (select c_custkey as id, case when c_custkey % 3 = 0 then '2026-03-01' end as ended from customer), c as (select o_custkey as id, min(cast(o_orderdate::date as varchar)) as first from orders where o_orderstatus = 'F' group by 1)
select d.id, coalesce(ended, first) as ended from d left join c using (id)""")
def deployment_end(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "2026-03-01").alias("end"))
    checks = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("day"), (F.col("o_orderstatus") == "F").alias("removed"))
    return evidence.ended(d, checks, "id").select("id", "ended")


RANKS = "rk as (select user_id, event_type, value / 500 as rank, 10 + event_id % 6 as k, value as step from events)"
TAIL = "(select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from (select unnest(range(cast(w as bigint), cast(n as bigint) + 1)) as i))"


def ranks(spark, sf) -> DataFrame:
    """A stratum an event, and its place in the table: the order in which SQL adds up."""
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    return table(spark, sf, "events").select(place, "user_id", "event_type", (F.col("value") / 500).alias("rank"), (F.col("event_id") % 6 + 10).alias("k"), F.col("value").alias("step"))


@query(f"""with {RANKS}, s as (select event_type, count(*) as n, avg(rank) as m, sum((k + 2) / (12.0 * k)) as v, count(*) filter (step >= 100) as moving, avg(rank) filter (step >= 100) as mr from rk group by 1),
z as (select *, (m - 0.5) / (sqrt(v) / n) as z from s), q as (select *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as t from z),
u as (select *, (0.254829592 * t - 0.284496736 * t ** 2 + 1.421413741 * t ** 3 - 1.453152027 * t ** 4 + 1.061405429 * t ** 5) * exp(-z * z / 2) / 2 as upper from q)
select event_type, n, round(m, 3) as rank, round(case when z >= 0 then upper else 1 - upper end, 4) as p, moving, round(mr, 3) as moving_rank from u""")
def rank_summary(spark, sf):
    return evidence.summaries(ranks(spark, sf), ["event_type"])


@query(f"""with {RANKS}, a as (select user_id, event_type, count(*) as n, round(avg(rank), 3) as rank from rk group by 1, 2), ok as (select * from a where n >= 8),
g as (select event_type, count(*) as animals, round(median(rank), 3) as median, count(*) filter (rank > 0.5) as w, count(*) filter (rank < 0.5) as b from ok group by 1), x as (select *, w + b as n from g)
select event_type, animals, median, cast(w as int) as above, cast(b as int) as below, case when n > 0 then round({TAIL}, 5) end as p from x""")
def across_animals(spark, sf):
    animals = evidence.summaries(ranks(spark, sf), ["user_id", "event_type"], order="place")
    return evidence.across(animals, ["event_type"], "rank", 8).select("event_type", "animals", "median", "above", "below", F.round("p", 5).alias("p"))


@query(f"""with {RANKS}, a as (select user_id, event_type, count(*) as n, round(avg(rank), 3) as rank, round(avg(1 - rank), 3) as other from rk group by 1, 2), c as (select user_id, event_type, n, rank, lag(rank) over (partition by user_id order by event_type) as b from a),
d as (select * from c where n >= 5 and b is not null), g as (select event_type, count(*) as pairs, count(*) filter (rank > b) as better, count(*) filter (rank < b) as worse, round(avg(rank - b), 3) as mean_diff from d group by 1), x as (select *, better + worse as n, greatest(better, worse) as w from g)
select event_type, pairs, better, worse, mean_diff, case when n > 0 then round(least(1, 2 * {TAIL}), 4) end as p from x""")
def score_comparison(spark, sf):
    """A user's rank in one kind of event against that in the kind before it."""
    from pyspark.sql import Window

    a = evidence.summaries(ranks(spark, sf), ["user_id", "event_type"], order="place").withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    before = a.withColumn("rank", F.lag("rank").over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("event_type")))).select("key", "rank")
    return evidence.compared(a, before, "key", "rank", ["event_type"], 5, unranked=True)


@query(f"""with ch as (select unnest([0.6, 0.7, 0.8, 0.9]) as chance), n as (select unnest(range(1, 201)) as n), k as (select n, unnest(range(0, n + 1)) as w from n), s as (select n, min(w) as least from (select n, w, {TAIL} as p from k) where p <= 0.05 group by n),
i as (select chance, n, unnest(range(least, n + 1)) as i from s cross join ch), p as (select chance, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(chance) + (n - i) * ln(1 - chance))) as power from i group by 1, 2)
select ch.chance, min(n) filter (power >= 0.8) as tracks from ch left join p using (chance) group by 1""")
def tracks_needed(spark, sf):
    return evidence.tracks_needed(spark, [0.6, 0.7, 0.8, 0.9])


@query("""with r as (select user_id, value from events where event_type <> 'purchase'), c as (select user_id, value from events where event_type = 'purchase'),
p as (select c.user_id, c.value, (select avg((r.value < c.value)::int) + 0.5 * avg((r.value = c.value)::int) from r where r.user_id = c.user_id) as pos from c),
t as (select quantile_cont(value, 1 / 3.0) as lo, quantile_cont(value, 2 / 3.0) as hi from r)
select (select count(*) from p where pos is not null) as crossings, (select round(avg(pos), 3) from p) as auc, round((select count(*) from r) * 5 / 1000.0, 2) as route_km,
 round(10.0 * (select count(*) from c where value >= hi) / ((select count(*) from r where value >= hi) * 5 / 1000.0), 2) as top_per_10km, round(10.0 * (select count(*) from c where value <= lo) / ((select count(*) from r where value <= lo) * 5 / 1000.0), 2) as bottom_per_10km from t""")
def transect_scores(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", "event_type")
    return evidence.transects(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), "user_id", "value")


@query("""with c as (select user_id, radians(value % 360) as a, event_type = 'view' as day from events), s as (select user_id, sum(sin(a)) filter (day) as s1, sum(cos(a)) filter (day) as c1, count(*) filter (day) as n1, sum(sin(a)) filter (not day) as s2, sum(cos(a)) filter (not day) as c2, count(*) filter (not day) as n2 from c group by 1 having count(*) filter (day) > 0 and count(*) filter (not day) > 0),
m as (select *, atan2(s1, c1) as d1, sqrt(s1 * s1 + c1 * c1) / n1 as r1, atan2(s2, c2) as d2, sqrt(s2 * s2 + c2 * c2) / n2 as r2 from s), w as (select *, n1 * r1 + 1e-6 as w1, n2 * r2 + 1e-6 as w2 from m),
x as (select *, (w1 * sin(d1) + w2 * sin(d2)) / (w1 + w2) as s, (w1 * cos(d1) + w2 * cos(d2)) / (w1 + w2) as c from w)
select user_id, round((degrees(atan2(s, c)) + 360) - 360 * floor((degrees(atan2(s, c)) + 360) / 360), 4) as direction, round(((n1 + 1) * r1 + (n2 + 1) * r2) / (n1 + n2 + 2) * sqrt(s * s + c * c), 6) as strength from x""")
def combined_wind(spark, sf):
    """The mean direction of views and of all other events of a user as one."""
    e = table(spark, sf, "events").select("user_id", (F.col("value") % 360).alias("deg"), (F.col("event_type") == "view").alias("day"))
    of = lambda day, x: climate.circular(e.where(F.col("day") == day), ["user_id"], "deg").select("user_id", *(F.col(c).alias(f"{c}_{x}") for c in ("direction", "strength", "n")))
    both = of(True, "a").join(of(False, "b"), "user_id")
    c = climate.combined(*(F.col(f"{k}_{x}") for x in "ab" for k in ("direction", "strength", "n")))
    return both.select("user_id", F.round(c["direction"], 4).alias("direction"), r6(c["strength"]).alias("strength"))


@query("with {LATTICE}, pos as (select t from lat where t > 0.03), q as (select quantile_cont(t, [i / 100.0 for i in range(101)]) as q from pos) " + """select row, col, round(case when t <= 0.03 then 0 when t < q[71] then 0 else greatest(least((len(list_filter(q, lambda x: x <= t)) - 1) / 100.0, 1), 0) end, 4) as shown from lat cross join q""")
def shown_layer(spark, sf):
    """Positive cells by their step among the hundredths of all of them, none below the seventieth."""
    from spurline.operators.ranks import quantiles

    lat = keep(layers(spark, sf).select("row", "col", "t"))
    q = quantiles(lat.where("t > 0.03"), "t", [i / 100 for i in range(101)]).agg(F.array_sort(F.collect_list("t")).alias("q"))  # 101 values
    step = (F.size(F.filter("q", lambda x: x <= F.col("t"))) - 1) / 100.0
    return lat.crossJoin(F.broadcast(q)).select("row", "col", F.round(F.when((F.col("t") <= 0.03) | (F.col("t") < F.element_at("q", 71)), 0.0).otherwise(S.clip(step)), 4).alias("shown"))


@query("with {LATTICE}, " + ZLAT + ", " + slope_sql("sl", "zl", 10.0) + " select row, col, round(col * 10 + 5 + east * 120, 4) as head_x, round(-(row * 10 + 5) + north * 120, 4) as head_y from sl where row % 8 = 4 and col % 8 = 4 and rise > 1e-6")
def flow_arrows(spark, sf):
    """An arrow of 120 m downhill from every eighth cell."""
    sl = lattice.slopes(layers(spark, sf).select("row", "col", "z"), "z", 10.0).where("row % 8 = 4 and col % 8 = 4 and rise > 1e-6")
    return sl.select("row", "col", F.round(F.col("col") * 10 + 5 + F.col("east") * 120, 4).alias("head_x"), F.round(-(F.col("row") * 10 + 5) + F.col("north") * 120, 4).alias("head_y"))


@query("""with f as (select user_id, ts, value * 10 as x, cast(json_extract_string(props, '$.k') as double) * 25 as y from events), d as (select distinct user_id, ts, x, y from f), k as (select *, row_number() over (partition by user_id, ts order by x, y) as k from d)
select user_id, count(*) as fixes, round(sum(x), 3) as x, round(sum(y), 3) as y from k where k = 1 group by 1""")
def fix_cleaning(spark, sf):
    one = evidence.one_fix_per_time(fixes(spark, sf), "user_id", "ts", "x", "y")
    return one.groupBy("user_id").agg(F.count(F.lit(1)).alias("fixes"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"))


@query("""with s as (select s_suppkey as id, cast(s_suppkey % 64 as int) as row, cast((s_suppkey * 7 + s_nationkey) % 64 as int) as col, s_nationkey % 3 as access from supplier)
select row, col, max_by(access, access * 100000 + id) as access, max(id) as last from s group by 1, 2""")
def land_drawn(spark, sf):
    """Open ground is drawn last, so it wins where shapes overlap."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % SIZE).cast("int").alias("row"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % SIZE).cast("int").alias("col"), (F.col("s_nationkey") % 3).alias("access"))
    drawn = vectors.drawn(s.withColumn("order", F.col("access") * 100000 + F.col("id")), "access", "order")
    return drawn.join(s.groupBy("row", "col").agg(F.max("id").alias("last")), ["row", "col"])


@query("""with r as (select s_suppkey as id, s_suppkey % 4 as n, 1.0 * s_suppkey as lon, 0.5 * s_nationkey as lat from supplier) select id, round(lon + n / 2.0, 6) as lon, round(lat + n * (n + 1) / 12.0 * 2, 6) as lat from r""")
def ring_centroids(spark, sf):
    """The mean vertex of rings (lon + k, lat + k(k + 1)/... ) of one to four points."""
    n = (F.col("s_suppkey") % 4).cast("int")
    ring = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((F.col("s_suppkey") + k).cast("double").alias("lon"), (F.lit(0.5) * F.col("s_nationkey") + k * n / 3.0 + k / 3.0 - F.when(n == 0, 0.0).otherwise(k * 0.0)).alias("lat")))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ring.alias("ring"))
    return vectors.centroids(rows, "ring").select("id", r6("lon").alias("lon"), r6("lat").alias("lat"))


def disc_sql(out: str, mask: str, radius: int) -> str:
    """A CTE of the share of a disc about each cell of `cv` where mask holds."""
    size = sum(2 * c + 1 for c in lattice.chords(radius).values())
    return f"{out} as (select a.row, a.col, count(b.row) / {size}.0 as v from cv a cross join offs left join cv b on b.{mask} and b.row = a.row + dr and b.col = a.col + dc where dr * dr + dc * dc <= {radius * radius} group by 1, 2)"


def dist_sql(out: str, mask: str, reach: float, cell: float) -> str:
    return f"{out} as (select a.row, a.col, min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) * {cell} as v from cv a left join cv b on b.{mask} and (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= {(reach / cell) ** 2} group by 1, 2)"


@query("with {LATTICE}, cv as (select row, col, z >= 24 as cover, hit as meadow from masked), " + offsets_sql(6) + ", " + disc_sql("hd", "cover", 1) + ", " + disc_sql("vw", "meadow", 6) + ", " + disc_sql("rl", "cover", 3) + ", " + dist_sql("op", "meadow", 75, 10) + ", " + dist_sql("nc", "cover", 25, 10) + """
select cv.row, cv.col, round(greatest(greatest(least((hd.v - 0.35) / 0.45, 1), 0) * least(vw.v / 0.3, 1) * case when op.v > 0 then greatest(least(1 - (op.v - 35) / 40, 1), 0) else 0 end,
 case when meadow then case when nc.v is null then 0 else greatest(least(1 - (nc.v - 15) / 10, 1), 0) end * least(rl.v / 0.25, 1) else 0 end), 6) as edge
from cv join hd using (row, col) join vw using (row, col) join rl using (row, col) join op using (row, col) join nc using (row, col)""")
def hunting_edge(spark, sf):
    """Cover is high ground here, a meadow is a marked cell; cells of 10 m."""
    cells = keep(masked(spark, sf).select("row", "col", F.when(F.col("z") >= 24, 9.0).otherwise(0.0).alias("canopy"), "hit"))
    return site.hunting_edge(cells, "canopy", "hit", 10.0, hide=10.0).select("row", "col", r6("edge").alias("edge"))


@query("""with {LATTICE}, v as (select row, col, d * 8.1375913::double as a, t * 10.3141597::double as b, z / 61.7::double as c, p / 91234.5::double as e from lat) select row, col, round(least(greatest(a, b, c, e) + 0.1::double * greatest((a > 0.3)::int + (b > 0.3)::int + (c > 0.3)::int + (e > 0.3)::int - 1, 0), 1), 7) as pinch,
 round(least(greatest(a, b / 3, c / 2) + case when a > 0.3 then 0.15::double * least((b / 3 > 0.15)::int + (c / 2 > 0.15)::int, 2) else 0 end, 1), 7) as edge, round(case when c > 0.6 then 0 else least(a * (0.75 + b / 4), 1) end, 7) as water,
 round((0.6 + 0.4 * a * (0.5 + 0.5 * b) * (0.5 + 0.5 * c)) * e, 7) as january, round(0.6 + 0.4 * a * (0.5 + 0.5 * b) * (0.5 + 0.5 * c), 7) as november, 1.0::double as july, round(a * b + c * (0.5 + 0.5 * greatest(a, e)), 7) as travel from v""")
def site_terms(spark, sf):
    """How layers are put together: pinches, edges with travel lines, water, seasons, travel."""
    v = layers(spark, sf).select("row", "col", (F.col("d") * 8.1375913).alias("a"), (F.col("t") * 10.3141597).alias("b"), (F.col("z") / 61.7).alias("c"), (F.col("p") / 91234.5).alias("e"))
    a, b, c, e = (F.col(x) for x in "abce")
    return v.select(
        "row", "col", F.round(site.pinched([a, b, c, e]), 7).alias("pinch"), F.round(site.with_lines(a, [b / 3, c / 2]), 7).alias("edge"), F.round(site.water_score(a, 0.75 + b / 4, c > 0.6), 7).alias("water"), F.round(site.season(1, a, b, c, e), 7).alias("january"),
        F.round(site.season(11, a, b, c, e), 7).alias("november"), site.season(7, a, b, c, e).alias("july"), F.round(site.travel(a, c, b, a, e), 7).alias("travel"),
    )


SITE = "ce as (select row, col, score, case when t > 0.041 then 1 + (row + col) % 4 else 0 end as kind, p / 500 as road, d * 4000 as rec, t > 0.05 as worn from scored), sp as (select row * 64 + col as id, row, col, score from ce where row % 9 = 4 and col % 7 = 3)"


def _site(spark, sf) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("t") > 0.041, 1 + (F.col("row") + F.col("col")) % 4).otherwise(0).cast("int")
    cells = keep(scored(spark, sf).select("row", "col", "score", kind.alias("kind"), (F.col("p") / 500).alias("road"), (F.col("d") * 4000).alias("rec"), (F.col("t") > 0.05).alias("worn")))
    return cells, cells.where("row % 9 = 4 and col % 7 = 3").select((F.col("row") * SIZE + F.col("col")).cast("int").alias("id"), "row", "col", "score")


COMPASS = str(list(S.SECTORS))


@query("with {LATTICE}, " + FACTORS + ", " + SITE + f""", m as (select sp.id, sp.row as r, sp.col as c, ce.*, sqrt((ce.row - sp.row) ** 2 + (ce.col - sp.col) ** 2) * 10 as distance, ce.road <= 75 as is_open
 from sp join ce o on o.row = sp.row and o.col = sp.col and o.kind = 0 join ce on ce.kind > 0 and ce.score > 0 and ce.rec >= 150 and sqrt((ce.row - sp.row) ** 2 + (ce.col - sp.col) ** 2) * 10 <= 60 and ce.score >= greatest(1, 0.5 * sp.score)),
k as (select *, row_number() over (partition by id order by is_open, score desc, row, col) as k from m)
select id, row, col, score, round(distance, 4) as distance, {COMPASS}[cast(floor(((degrees(atan2(col - c, r - row)) + 360) % 360 + 11.25) / 22.5) as int) % 16 + 1] as direction, is_open, cast(kind as int) as kind from k where k = 1""")
def line_alternates(spark, sf):
    cells, spots = _site(spark, sf)
    found = site.alternates(spots, cells, 10.0, search=60.0, least=1.0, apart=150.0, open_road=75.0)
    return found.withColumn("distance", F.round("distance", 4))


@query("with {LATTICE}, " + FACTORS + ", " + SITE + f""", m as (select sp.id, sp.row as r, sp.col as c, ce.row, ce.col, sqrt((ce.row - sp.row) ** 2 + (ce.col - sp.col) ** 2) * 10 as d from sp join ce on ce.worn and (ce.row - sp.row) ** 2 + (ce.col - sp.col) ** 2 <= 9),
k as (select *, row_number() over (partition by id order by d, col, row) as k from m), w as (select *, {COMPASS}[cast(floor(((degrees(atan2(col - c, r - row)) + 360) % 360 + 11.25) / 22.5) as int) % 16 + 1] as direction from k where k = 1)
select id, round(d, 4) as distance, direction, 'a worn line on no map' || case when d <= 10 then ' runs through this spot: hang the camera beside it, facing along it' when d <= 15 then ' ' || cast(cast(round(d) as int) as varchar) || ' m ' || direction || ': hang the camera facing it'
 else ' ' || cast(cast(round(d) as int) as varchar) || ' m ' || direction || ': hang the camera a few metres toward it, facing it' end as hint from w""")
def worn_hints(spark, sf):
    cells, spots = _site(spark, sf)
    return site.hints(spots, cells, "worn", 10.0)


@query("with {LATTICE}, cv as (select row, col, hit and t > 0.045 as there from masked) select a.row, a.col, round(least(coalesce(min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) * 10, 60), 60), 6) as paved from cv a left join cv b on b.there and abs(a.row - b.row) <= 6 and abs(a.col - b.col) <= 6 group by 1, 2")
def capped_distance(spark, sf):
    cells = keep(masked(spark, sf).select("row", "col", (F.col("hit") & (F.col("t") > 0.045)).alias("there")))
    return site.capped_distance(cells, "there", "paved", 10.0, 60.0).select("row", "col", r6("paved").alias("paved"))


def _terrain(cells: DataFrame) -> DataFrame:
    """Landforms, height against the surroundings, and what drains through each cell, of height."""
    ground = cells.select("row", "col", "height")
    forms = lattice.landforms(ground, "height", 10.0, 5, 4.0).select("row", "col", "landform")
    raised = lattice.box_mean(ground.withColumn("mean", F.col("height")), "mean", 10, SIZE, SIZE).select("row", "col", (F.col("height") - F.col("mean")).alias("tpi"))
    to = lattice.receivers(ground, "height", 10.0)
    number = lambda r, c: (F.col(r) * SIZE + F.col(c)).cast("long")
    flow = graph.accumulated(keep(to.select(number("row", "col").alias("id"), number("receiver_row", "receiver_col").alias("receiver"), F.lit(100.0).alias("area"))), "area")
    drained = flow.select(F.floor(F.col("id") / SIZE).cast("int").alias("row"), (F.col("id") % SIZE).cast("int").alias("col"), (F.col("total") / 10.0).alias("sca"))
    return ground.join(forms, ["row", "col"]).join(raised, ["row", "col"]).join(drained, ["row", "col"])


@query()
def wind_factor(spark, sf):
    ground = keep(layers(spark, sf).select("row", "col", (F.col("z") * 3).alias("height")))
    found = site.wind(keep(_terrain(ground)), "height", 10.0, 240.0, 0.6)
    return found.select("row", "col", *(r6(c).alias(c) for c in ("drain", "flow_east", "flow_north", "agree", "conv", "windward", "wind")))


def _pinches(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pinch of each cell, of saddles, feet and rims of steep bands, banks, funnels of the current, water squeezed against them; and the saddles."""
    ground = cells.select("row", "col", "height")
    found = keep(saddles.saddles(ground, "height", 10.0, 30.0, 300.0, 2.0))
    bands = keep(graph.steep_bands(ground, "height", 10.0, cliff=42.0, steep=30.0))
    slope = lattice.slopes(ground, "height", 10.0).select("row", "col", "slope")
    base = keep(cells.select("row", "col", "lake", "canopy", "road").join(slope, ["row", "col"]).join(bands.select("row", "col", "rock", "base", "top"), ["row", "col"]))
    share = lambda c: F.col(c).cast("double")
    ohms = base.select("row", "col", site.resistance(F.col("slope"), share("rock"), share("lake"), (F.col("canopy") < 2.5).cast("double"), share("road")).alias("r"))
    funnel = current.coarse_funnels(keep(ohms), "r", 30.0, SIZE, SIZE)
    wall = F.when(F.col("rock"), shores.CLIFF).when(F.col("slope") >= 35, shores.STEEP).otherwise(0)
    water = shores.squeezed(keep(base.select("row", "col", "lake", wall.alias("wall"))), "lake", "wall", 10.0)
    bank = lattice.soft(base.select("row", "col", "lake"), "lake", 3, "bank", exclude="lake").select("row", "col", (0.7 * F.coalesce("bank", F.lit(0.0))).alias("bank"))
    every = site.saddle_discs(base.select("row", "col", "base", (0.4 * F.col("top")).alias("rim")), found, 10.0, 2.0)
    for part in (keep(funnel), keep(water.select("row", "col", F.col("squeeze").alias("water_pinch"))), keep(bank)):
        every = every.join(part, ["row", "col"])
    names = ["saddle", "base", "rim", "bank", "funnel", "water_pinch"]
    return keep(every.select("row", "col", site.pinched([F.col(c) for c in names]).alias("pinch"))), found


@query()
def site_plan(spark, sf):
    """One area from its layers to its spots: terrain and wind, openings and edges, pinches, water and its scarcity, travel with its gates and sunny slopes, walks, score, masks, the lists of spots."""
    base = masked(spark, sf).withColumns({
        "canopy": F.col("z") - 15, "lake": F.col("p") > 45000, "road": (F.col("row") % 21 == 3), "spring": (F.col("t") > 0.055), "public": (F.col("col") < 48), "wet": F.col("p") > 44500, "height": F.col("z") * 3,
    })
    base = keep(base.select("row", "col", "canopy", "lake", "road", "spring", "public", "wet", "height", "hit"))
    meadow = graph.openings(base, "canopy", "lake", 1, 4, 12.0).select("row", "col", F.lit(True).alias("meadow"))
    cells = keep(base.join(meadow, ["row", "col"], "left").withColumn("meadow", F.coalesce("meadow", F.lit(False))))
    edge = keep(site.hunting_edge(cells, "canopy", "meadow", 10.0).select("row", "col", "edge"))
    sources = cells.where("spring").select("row", "col", F.lit(1.0).alias("weight"), F.lit(1).alias("place")).unionByName(cells.where("wet").select("row", "col", F.lit(0.3).alias("weight"), F.lit(2).alias("place")))
    scarce = keep(site.scarcity(cells.select("row", "col", "wet", "spring", "lake"), "wet", "spring", 8))
    water = lattice.best_source(scarce, sources, 4, 4.0, 12)
    water = keep(water.select("row", "col", site.water_score(F.col("value"), F.col("scarcity"), F.col("lake")).alias("water")))
    parts = lattice.travel_parts(cells.select("row", "col", "height"), "height", 5, SIZE, SIZE).select("row", "col", "bottom", "spine")
    parts = keep(site.gentle_slope(cells.select("row", "col", "height"), "height", 10.0, SIZE, SIZE, 2.0).join(parts, ["row", "col"]).select("row", "col", "bottom", "spine", "grade"))
    slope = keep(lattice.slopes(cells.select("row", "col", "height"), "height", 10.0).select("row", "col", "slope"))
    walk = keep(site.walks(cells.join(slope, ["row", "col"]).select("row", "col", "slope", "road", "lake"), "slope", "road", "lake", 10.0, tile=64).select("row", "col", "walk_m"))
    pinch, found = _pinches(cells)
    pos = lattice.travel_parts(cells.select("row", "col", "height"), "height", 5, SIZE, SIZE).select("row", "col", "pos")
    gate = keep(saddles.spine_gate(keep(pos), "pos", found, 10.0).select("row", "col", "gate"))
    warm = keep(lattice.thermal(cells.select("row", "col", "height"), "height", 10.0, SIZE, SIZE, 3.0, radius=100.0).select("row", "col", "thermal"))
    air = keep(site.wind(keep(_terrain(cells)), "height", 10.0, 240.0, 0.6).select("row", "col", "wind"))
    site_ = keep(cells.join(edge, ["row", "col"]).join(pinch, ["row", "col"]).join(gate, ["row", "col"]).join(warm, ["row", "col"]).join(air, ["row", "col"]).join(water, ["row", "col"]).join(parts, ["row", "col"]).join(slope, ["row", "col"]).join(walk, ["row", "col"]))
    full = site_.withColumn("travel", site.travel(F.col("bottom"), F.col("spine"), F.col("grade"), F.col("gate"), F.col("thermal")))
    names = {"wind": "wind", "edges": "edge", "pinch": "pinch", "water": "water"}
    full = full.withColumn("spot", S.spot_score(names, "travel") * S.habitat("edge", "water"))
    scored_ = lattice.gaussian(keep(full.select("row", "col", "spot", "lake", "public", "walk_m", *names.values(), "travel")), "spot", 2.0, SIZE, SIZE)
    usable = ~F.col("lake") & (F.coalesce("walk_m", F.lit(1e9)) <= S.METRES_PER_MILE)
    ready = keep(scored_.withColumns({"score": r6(S.score_100("spot")), "pub": usable & F.col("public"), "priv": usable & ~F.col("public")}))
    chosen = picks.two_lists(ready, "score", "pub", "priv", 1.0, 3, 1, 12.0, 3, SIZE, SIZE, 10)
    return chosen.join(ready.select("row", "col", *(r6(c).alias(c) for c in (*names.values(), "travel"))), ["row", "col"]).select("name", "rank", "zone", "row", "col", "score", *names.values(), "travel")
