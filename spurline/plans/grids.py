"""Queries of the grid operators over a 64 x 64 lattice of line items, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spurline.functions import scalar as S
from spurline.operators import graph, lattice, picks
from spurline.operators.store import keep

SIZE = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LATTICE = """
raw as (select cast(l_orderkey % 64 as int) as row, cast(l_partkey % 64 as int) as col, round(avg(l_quantity), 6) as z, round(avg(l_discount), 6) as d,
  round(avg(l_tax), 6) as t, round(avg(l_extendedprice), 4) as p from lineitem group by 1, 2),
means as (select avg(z) as mz, avg(d) as md, avg(t) as mt, avg(p) as mp from raw),
lat as (select cast(r.i as int) as row, cast(c.i as int) as col, round(coalesce(z, mz), 6) as z, round(coalesce(d, md), 6) as d, round(coalesce(t, mt), 6) as t, round(coalesce(p, mp), 4) as p
  from range(64) r(i) cross join range(64) c(i) left join raw on raw.row = r.i and raw.col = c.i cross join means),
cut as (select quantile_cont(d, 0.7) as q from lat),
masked as (select lat.*, d >= q as hit from lat cross join cut),
sup as (select distinct cast(s_suppkey % 64 as int) as row, cast((s_suppkey * 7 + s_nationkey) % 64 as int) as col from supplier)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{LATTICE}", LATTICE)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col and the layers z, d, t, p of all cells."""
    key = lambda c, a: (F.col(c) % SIZE).cast("int").alias(a)
    raw = (
        table(spark, sf_dir, "lineitem").groupBy(key("l_orderkey", "row"), key("l_partkey", "col"))
        .agg(*(F.round(F.avg(c), k).alias(a) for c, a, k in (("l_quantity", "z", 6), ("l_discount", "d", 6), ("l_tax", "t", 6), ("l_extendedprice", "p", 4))))
    )
    full = lattice.filled(raw, SIZE, SIZE, "z", "d", "t", "p")
    return full.select("row", "col", *(F.round(a, 4 if a == "p" else 6).alias(a) for a in ("z", "d", "t", "p")))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layers with hit: d at or above its own 70th percentile."""
    lat = layers(spark, sf_dir)
    cut = lat.agg(F.percentile("d", F.lit(0.7)).alias("q"))
    return lat.crossJoin(F.broadcast(cut)).withColumn("hit", F.col("d") >= F.col("q")).drop("q")  # cut: one row


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cells, one for each supplier key."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % SIZE).cast("int").alias("row"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % SIZE).cast("int").alias("col")).distinct()


def r6(x: Column | str) -> Column:
    """Six places, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


@query("with {LATTICE} select row, col, z, d, t, p from lat")
def lattice_fill(spark, sf):
    return layers(spark, sf)


@query("""with {LATTICE}, g as (select row, col,
  (coalesce(lead(z) over (partition by row order by col), z) - coalesce(lag(z) over (partition by row order by col), z)) / (case when col in (0, 63) then 10.0 else 20.0 end) as gx,
  (coalesce(lead(z) over (partition by col order by row), z) - coalesce(lag(z) over (partition by col order by row), z)) / (case when row in (0, 63) then 10.0 else 20.0 end) as gy from lat),
m as (select *, sqrt(gx * gx + gy * gy) as rise from g)
select row, col, round(rise, 6) as rise, round(degrees(atan(rise)), 6) as slope, round(case when rise > 1e-6 then -gx / rise else 0 end, 6) + 0.0 as east, round(case when rise > 1e-6 then gy / rise else 0 end, 6) + 0.0 as north from m""")
def slope_field(spark, sf):
    return lattice.slopes(layers(spark, sf).select("row", "col", "z"), "z", 10.0).select("row", "col", *(r6(c).alias(c) for c in ("rise", "slope", "east", "north")))


@query("""with {LATTICE}, n as (select row, col, z * 20 as paved, t * 1000 as houses, d * 5000 as recreation from lat)
select row, col, round(greatest(least((paved - 800) / (20 - 800), 1), 0), 6) as near_paved,
 round((1 - 0.7 * greatest(least((paved - 800) / -780, 1), 0)) * (1 - 0.7 * greatest(least((houses - 15) / 45, 1), 0)) * power(1 + greatest(houses, 0), -0.34) * (1 - 0.3 * greatest(least((recreation - 400) / -350, 1), 0)), 6) as penalty
from n""")
def site_cost(spark, sf):
    n = layers(spark, sf).select("row", "col", (F.col("z") * 20).alias("paved"), (F.col("t") * 1000).alias("houses"), (F.col("d") * 5000).alias("recreation"))
    return n.select("row", "col", r6(S.ramp("paved", 800, 20)).alias("near_paved"), r6(S.penalty("paved", "houses", "recreation")).alias("penalty"))


def factors(df: DataFrame) -> DataFrame:
    return df.withColumns({"wind": S.clip(F.col("d") * 10), "edges": S.clip(F.col("t") * 12), "pinch": S.clip(F.col("z") / 50), "water": S.clip(F.col("p") / 100000), "travel": S.clip(F.col("d") * 8)})


FACTORS = """fac as (select row, col, hit, z, d, t, p, greatest(least(d * 10, 1), 0) as wind, greatest(least(t * 12, 1), 0) as edges, greatest(least(z / 50, 1), 0) as pinch,
  greatest(least(p / 100000, 1), 0) as water, greatest(least(d * 8, 1), 0) as travel from masked),
spot as (select *, (0.35 * wind + 0.30 * edges + 0.20 * pinch + 0.15 * water + 0.30 * travel) * (1 + 0.25 * greatest(least((wind - 0.35) / 0.3, 1), 0)) * (1 + 0.25 * greatest(least((edges - 0.35) / 0.3, 1), 0))
  * (1 + 0.25 * greatest(least((pinch - 0.35) / 0.3, 1), 0)) * (1 + 0.25 * greatest(least((water - 0.35) / 0.3, 1), 0)) as spot,
  (0.2 + greatest(least(edges / 0.3, 1), 0)) * (0.5 + greatest(least(water / 0.3, 1), 0)) as habitat,
  cast((wind >= 0.5) as int) + cast((edges >= 0.5) as int) + cast((pinch >= 0.5) as int) + cast((water >= 0.5) as int) as n_on from fac),
scored as (select *, round(greatest(least(300.0 * spot * habitat / (1.30 * power(1.25, 4) * 1.2 * 1.5), 100), 0), 6) as score from spot)"""


def scored(spark, sf) -> DataFrame:
    df = factors(masked(spark, sf))
    names = {k: k for k in S.FACTOR_WEIGHTS}
    return df.withColumn("spot", S.spot_score(names, "travel")).withColumn("habitat", S.habitat("edges", "water")).withColumns({"score": r6(S.score_100(F.col("spot") * F.col("habitat"))), "n_on": S.strong_factors(list(names))})


@query("with {LATTICE}, " + FACTORS + " select row, col, score, n_on, round(case when z * 2 > 8 and not hit and t * 30000 <= 1609.344 then score else 0 end, 6) as final from scored")
def suitability(spark, sf):
    ok = S.usable(F.lit(True), F.col("hit"), F.col("z") * 2, F.lit(False), F.lit(True), F.col("t") * 30000)
    return scored(spark, sf).select("row", "col", "score", "n_on", F.when(ok, F.col("score")).otherwise(0.0).alias("final"))


@query("with {LATTICE}, " + FACTORS + " select row, col, score, cast(rank as int) as rank from (select row, col, score, row_number() over (order by score desc, row, col) as rank from scored where not hit) where rank <= 10")
def best_usable_cells(spark, sf):
    return picks.best(scored(spark, sf).where("not hit").select("row", "col", "score"), "score", 10)


@query("""with {LATTICE}, b as (select cast(row // 8 as int) as block_row, cast(col // 8 as int) as block_col, z, d, cast((row * 7 + col * 3) % 25 as int) as nation from lat),
m as (select block_row, block_col, nation, row_number() over (partition by block_row, block_col order by count(*) desc, nation) as k from b group by 1, 2, 3)
select s.*, n_name as nation from (select block_row, block_col, round(avg(z), 6) as mean_z, round(sum(d), 6) as sum_d, round(quantile_cont(z, 0.97), 6) as high_z from b group by 1, 2) s
join m using (block_row, block_col) join nation on n_nationkey = m.nation where k = 1""")
def block_screen(spark, sf):
    lat = layers(spark, sf).withColumn("nation", ((F.col("row") * 7 + F.col("col") * 3) % 25).cast("int"))
    stats = lattice.blocks(lat, 8, r6(F.avg("z")).alias("mean_z"), r6(F.sum("d")).alias("sum_d"), r6(F.percentile("z", F.lit(0.97))).alias("high_z"))
    counted = lattice.blocks(lat, 8, F.count(F.lit(1)).alias("n"), by=["nation"])
    modal = counted.groupBy("block_row", "block_col").agg(F.max(F.struct("n", (-F.col("nation")).alias("m")))["m"].alias("m"))
    names = table(spark, sf, "nation").select((-F.col("n_nationkey")).alias("m"), F.col("n_name").alias("nation"))
    return stats.join(modal, ["block_row", "block_col"]).join(names, "m").drop("m")


OFFSETS = "offs as (select cast(a.i as int) as dr, cast(b.i as int) as dc from range(-{k}, {k} + 1) a(i) cross join range(-{k}, {k} + 1) b(i))"


@query("with {LATTICE}, " + OFFSETS.replace("{k}", "3") + """ select a.row, a.col, round(a.z - avg(b.z), 6) as position from lat a cross join offs
join lat b on b.row = greatest(least(a.row + dr, 63), 0) and b.col = greatest(least(a.col + dc, 63), 0) group by a.row, a.col, a.z""")
def local_position(spark, sf):
    lat = layers(spark, sf).withColumn("mean", F.col("z"))
    return lattice.box_mean(lat, "mean", 3, SIZE, SIZE).select("row", "col", r6(F.col("z") - F.col("mean")).alias("position"))


@query("with {LATTICE}, w as (select cast(i as int) as i, exp(-0.5 * (i / 2.0) * (i / 2.0)) as w from range(-8, 9) t(i)), n as (select sum(w) as s from w)," + """
a as (select l.row, l.col, w.i, w.w / s as w, case when l.col + i < 0 then -1 - l.col - i when l.col + i > 63 then 127 - l.col - i else l.col + i end as at from lat l cross join w cross join n),
h as (select a.row, a.col, sum(a.w * b.z) as z from a join lat b on b.row = a.row and b.col = a.at group by a.row, a.col),
v as (select l.row, l.col, w.w / s as w, case when l.row + i < 0 then -1 - l.row - i when l.row + i > 63 then 127 - l.row - i else l.row + i end as at from lat l cross join w cross join n)
select v.row, v.col, round(sum(v.w * h.z), 6) as z from v join h on h.row = v.at and h.col = v.col group by v.row, v.col""")
def gaussian_blur(spark, sf):
    return lattice.gaussian(layers(spark, sf).select("row", "col", "z"), "z", 2.0, SIZE, SIZE).select("row", "col", r6("z").alias("z"))


@query("with {LATTICE}, " + OFFSETS.replace("{k}", "1") + """, e as (select a.row, a.col, count(b.row) = 9 as hit from lat a cross join offs left join masked b on b.hit and b.row = a.row + dr and b.col = a.col + dc group by a.row, a.col)
select a.row, a.col, count(b.row) > 0 as hit from lat a cross join offs left join e b on b.hit and b.row = a.row + dr and b.col = a.col + dc group by a.row, a.col""")
def square_open(spark, sf):
    return lattice.opened(masked(spark, sf).select("row", "col", "hit"), "hit", 1)


@query("with {LATTICE}, " + OFFSETS.replace("{k}", "1") + """ select a.row, a.col, round(quantile_cont(b.z, 0.5), 6) as z from lat a cross join offs
join lat b on b.row = (case when a.row + dr < 0 then 0 when a.row + dr > 63 then 63 else a.row + dr end) and b.col = (case when a.col + dc < 0 then 0 when a.col + dc > 63 then 63 else a.col + dc end) group by a.row, a.col""")
def median_window(spark, sf):
    return lattice.median_filter(layers(spark, sf), "z", 1).select("row", "col", r6("z").alias("z"))


@query("with {LATTICE}, " + OFFSETS.replace("{k}", "4") + """ select a.row, a.col, round(count(b.row) / (select count(*) from offs where dr * dr + dc * dc <= 16)::double, 6) as share
from lat a cross join offs left join masked b on b.hit and b.row = a.row + dr and b.col = a.col + dc where dr * dr + dc * dc <= 16 group by a.row, a.col""")
def disc_share(spark, sf):
    return lattice.disc_share(masked(spark, sf), "hit", 4).select("row", "col", r6("share").alias("share"))


@query("with {LATTICE}, " + OFFSETS.replace("{k}", "5") + """, h as (select cast(s_suppkey % 64 as int) as row, cast((s_suppkey * 7 + s_nationkey) % 64 as int) as col, count(*) as n from supplier group by 1, 2)
select a.row, a.col, cast(coalesce(sum(n), 0) as bigint) as total from lat a cross join offs left join h b on b.row = a.row + dr and b.col = a.col + dc where dr * dr + dc * dc <= 25 group by a.row, a.col""")
def disc_count(spark, sf):
    p = table(spark, sf, "supplier").select((F.col("s_suppkey") % SIZE).cast("int").alias("row"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % SIZE).cast("int").alias("col"), F.lit(1).cast("long").alias("n"))
    return lattice.disc_sum(layers(spark, sf), p, "n", 5).select("row", "col", "total")


NEAREST = """with {LATTICE} select row, col, {d2} near_row, near_col from (select a.row, a.col, b.row as near_row, b.col as near_col, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 as d2,
 row_number() over (partition by a.row, a.col order by (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.col, b.row) as k from lat a left join sup b on (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= {far}) where k = 1"""


@query(NEAREST.replace("{d2}", "cast(d2 as int) as d2,").replace("{far}", "144"))
def nearest_cell(spark, sf):
    return lattice.nearest(layers(spark, sf), points(spark, sf), 12).select("row", "col", "d2", "near_row", "near_col")


@query("with {LATTICE} select a.row, a.col, cast(min((a.row - b.row) ** 2 + (a.col - b.col) ** 2) as bigint) as d2 from lat a left join sup b on true group by a.row, a.col")
def distance_field(spark, sf):
    lat = layers(spark, sf).join(points(spark, sf).withColumn("there", F.lit(True)), ["row", "col"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return lattice.nearest_any(lat.select("row", "col", "there"), "there").select("row", "col", "d2")


@query("""with {LATTICE}, s as (select row, col, 0.8 as weight, 1 as place from sup where row % 2 = 0 union all select row, col, 1.0, 2 from sup where row % 2 = 1),
v as (select a.row, a.col, s.place, s.weight * case when sqrt((a.row - s.row) ** 2 + (a.col - s.col) ** 2) <= 3 then 1.0 else exp(-(sqrt((a.row - s.row) ** 2 + (a.col - s.col) ** 2) - 3) / 4.0) end as value
  from lat a join s on (a.row - s.row) ** 2 + (a.col - s.col) ** 2 <= 100),
k as (select *, row_number() over (partition by row, col order by value desc, place) as k from v)
select lat.row, lat.col, round(coalesce(value, 0), 6) as value, place from lat left join k on k.row = lat.row and k.col = lat.col and k.k = 1""")
def priority_source(spark, sf):
    even = F.col("row") % 2 == 0
    s = points(spark, sf).withColumns({"weight": F.when(even, 0.8).otherwise(1.0), "place": F.when(even, 1).otherwise(2)})
    return lattice.best_source(layers(spark, sf), s, 3, 4.0, 10).select("row", "col", r6("value").alias("value"), "place")


@query("""with {LATTICE}, l as (select cast((row // 8) * 8 + col // 8 as int) as label, row, col, z, d from lat),
m as (select label, avg(d) as flow from l group by 1), x as (select l.label, row, col, z * flow as v from l join m using (label))
select label, row, col, round((v - min(v) over (partition by label)) / (max(v) over (partition by label) - min(v) over (partition by label)), 5) as position from x""")
def mean_flow_position(spark, sf):
    from pyspark.sql import Window

    lab = layers(spark, sf).withColumn("label", (F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8)).cast("int"))
    w = Window.partitionBy("label")
    v = lab.join(lab.groupBy("label").agg(F.avg("d").alias("flow")), "label").withColumn("v", F.col("z") * F.col("flow"))
    low, high = F.min("v").over(w), F.max("v").over(w)
    return v.select("label", "row", "col", F.round(F.try_divide(F.col("v") - low, high - low), 5).alias("position"))


@query("""with {LATTICE}, n as (select i + 1 as label from range(70) t(i)), l as (select (row // 8) * 8 + col // 8 + 1 as label, z from lat)
select cast(n.label as int) as label, count(z) as n, round(coalesce(sum(z), 0), 5) as total, coalesce(min(z), 0) as low, coalesce(max(z), 0) as high from n left join l on l.label = n.label group by 1""")
def label_stats(spark, sf):
    lab = layers(spark, sf).select((F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8) + 1).cast("int").alias("label"), "z")
    every = spark.range(1, 71).select(F.col("id").cast("int").alias("label"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return every.join(lab, "label", "left").groupBy("label").agg(F.count("z").alias("n"), F.round(zero(F.sum("z")), 5).alias("total"), zero(F.min("z")).alias("low"), zero(F.max("z")).alias("high"))


@query("""with recursive {LATTICE}, m as (select row, col, row * 64 + col as id from masked where hit),
reach(a, b) as (select id, id from m union select reach.a, n.id from reach join m x on x.id = reach.b join m n on abs(n.row - x.row) + abs(n.col - x.col) = 1),
low as (select a, min(b) as b from reach group by a)
select cast(a // 64 as int) as row, cast(a % 64 as int) as col, cast(dense_rank() over (order by b) as int) as label from low""")
def components(spark, sf):
    return graph.regions(masked(spark, sf).where("hit")).select("row", "col", "label")


DIRS = "dirs as (select * from (values (0,-1,0),(1,-1,1),(2,0,1),(3,1,1),(4,1,0),(5,1,-1),(6,0,-1),(7,-1,-1)) t(dir, dr, dc))"
RECEIVERS = DIRS + """, drops as (select a.row, a.col, dir, b.row as tr, b.col as tc, (a.z - b.z) / (sqrt(dr * dr + dc * dc) * 10.0) as dropped from lat a cross join dirs join lat b on b.row = a.row + dr and b.col = a.col + dc),
rec as (select row, col, tr, tc from (select *, row_number() over (partition by row, col order by dropped desc, dir) as k from drops where dropped > 0) where k = 1),
recv as (select lat.row, lat.col, tr as receiver_row, tc as receiver_col from lat left join rec using (row, col))"""


@query("with {LATTICE}, " + RECEIVERS + " select row, col, receiver_row, receiver_col from recv")
def receiver_cells(spark, sf):
    return lattice.receivers(layers(spark, sf), "z", 10.0).select("row", "col", "receiver_row", "receiver_col")


def _tree(spark, sf) -> DataFrame:
    at = lambda r, c: (F.col(r) * SIZE + F.col(c)).cast("long")
    return receiver_cells(spark, sf).select(at("row", "col").alias("id"), at("receiver_row", "receiver_col").alias("receiver"), F.lit(100.0).alias("area"))


TREE = "tree as (select row * 64 + col as id, receiver_row * 64 + receiver_col as receiver from recv), way(a, b, n) as (select id, id, 0 from tree union all select way.a, tree.receiver, n + 1 from way join tree on tree.id = way.b where tree.receiver is not null)"


@query("with recursive {LATTICE}, " + RECEIVERS + ", " + TREE + " select cast(b as bigint) as id, count(*) * 100.0::double as total from way group by b")
def flow_total(spark, sf):
    return graph.accumulated(_tree(spark, sf), "area").select("id", "total")


@query("with recursive {LATTICE}, " + RECEIVERS + ", " + TREE + " select cast(a as bigint) as id, cast(max_by(b, n) as bigint) as root, cast(max(n) as bigint) as depth from way group by a")
def flow_outlets(spark, sf):
    return graph.roots(_tree(spark, sf).select("id", F.col("receiver").alias("parent"))).select("id", "root", "depth")


@query("with recursive {LATTICE}, " + RECEIVERS + ", " + TREE + " select cast(n as bigint) as step, cast(b as bigint) as id from way where a = 2080")
def route_trace(spark, sf):
    return graph.route(_tree(spark, sf).select("id", F.col("receiver").alias("parent")), 2080).select("step", "id")


@query("""with recursive {LATTICE}, small as (select row, col, d from lat), """ + DIRS + """,
edge as (select a.row * 64 + a.col as f, b.row * 64 + b.col as t, (a.d + b.d) / 2 * sqrt(dr * dr + dc * dc) * 10.0 as pay from small a cross join dirs join small b on b.row = a.row + dr and b.col = a.col + dc),
walk(id, reach) using key (id) as (select 0::bigint, 0.0::double union select edge.t::bigint, min(walk.reach + pay) from walk join edge on edge.f = walk.id left join recurring.walk old on old.id = edge.t where old.reach is null or walk.reach + pay < old.reach - 1e-12 group by edge.t)
select cast(id // 64 as int) as row, cast(id % 64 as int) as col, round(reach, 6) as reach from walk""")
def least_cost(spark, sf):
    every = keep(layers(spark, sf).select("row", "col", "d")).withColumn("source", (F.col("row") == 0) & (F.col("col") == 0))
    return graph.cheapest(every, "d", "source", 10.0, tile=32).select("row", "col", r6("reach").alias("reach"))


@query()
def filled_depressions(spark, sf):
    quarter = layers(spark, sf).withColumn("area_id", (F.floor(F.col("row") / 32) * 2 + F.floor(F.col("col") / 32)).cast("int"))
    return graph.flooded(keep(quarter), "z", ["area_id"], tile=16).withColumn("filled", r6("filled"))


@query()
def shared_drainage(spark, sf):
    quarter = layers(spark, sf).withColumn("area_id", (F.floor(F.col("row") / 32) * 2 + F.floor(F.col("col") / 32)).cast("int"))
    return graph.shared_flow(keep(quarter), "z", 10.0, ["area_id"], tile=16).select("area_id", "row", "col", r6("area").alias("area"))


@query("with {LATTICE} select row, col, round((rank() over (order by z) - 1 + 0.5 * count(*) over (partition by z)) / count(*) over (), 6) as position from lat")
def percent_position(spark, sf):
    return picks.share_above(layers(spark, sf), "z").select("row", "col", r6("position").alias("position"))


@query("""select cast(r as int) as row, cast(c as int) as col, q as value from (select l_orderkey % 64 as r, l_partkey % 64 as c, l_quantity as q,
 row_number() over (partition by l_orderkey % 64, l_partkey % 64 order by l_shipdate desc, l_orderkey, l_linenumber) as k from lineitem where l_quantity > 5) where k = 1""")
def tiles_merge(spark, sf):
    """The newest tile that has a value wins each cell."""
    t = table(spark, sf, "lineitem").where("l_quantity > 5")
    newest = F.max_by("l_quantity", F.struct("l_shipdate", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))).alias("value")
    return t.groupBy((F.col("l_orderkey") % SIZE).cast("int").alias("row"), (F.col("l_partkey") % SIZE).cast("int").alias("col")).agg(newest)


@query("with {LATTICE} select cast((row + 12) % 64 as int) as row, cast((col + 60) % 64 as int) as col, z from lat")
def toroidal_shift(spark, sf):
    return lattice.shifted(layers(spark, sf).select("row", "col", "z"), 12, -4, SIZE, SIZE)


@query("""with {LATTICE}, b as (select row // 4 as br, col // 4 as bc, avg(z) as z from lat group by 1, 2),
x as (select row, col, (row + 0.5) / 4 - 0.5 as y, (col + 0.5) / 4 - 0.5 as x from lat),
f as (select row, col, floor(y) as r0, floor(x) as c0, y - floor(y) as fy, x - floor(x) as fx from x)
select f.row, f.col, round(sum(z * (case when i = 0 then 1 - fy else fy end) * (case when j = 0 then 1 - fx else fx end)), 6) as z from f cross join range(2) a(i) cross join range(2) c(j)
join b on b.br = greatest(least(r0 + i, 15), 0) and b.bc = greatest(least(c0 + j, 15), 0) group by f.row, f.col""")
def block_upsample(spark, sf):
    coarse = lattice.blocks(layers(spark, sf), 4, F.avg("z").alias("z"))
    return lattice.upsampled(coarse, "z", 4, SIZE, SIZE).select("row", "col", r6("z").alias("z"))


@query("""with {LATTICE}, s as (select row, col, z, d, hit from masked)
select row, col, array_to_string(list_filter([case when z >= 30 then 'high ground at ' || cast(round(z)::int as varchar) end, case when hit then 'dense cover' end, case when d < 0.03 then 'open' end], x -> x is not null), '; ') as reasons from s""".replace("x -> x is not null", "lambda x: x is not null"))
def reason_list(spark, sf):
    rules = [
        (F.col("z") >= 30, F.concat(F.lit("high ground at "), F.round("z").cast("int").cast("string"))),
        (F.col("hit"), F.lit("dense cover")),
        (F.col("d") < 0.03, F.lit("open")),
    ]
    return masked(spark, sf).select("row", "col", F.array_join(picks.reasons(rules), "; ").alias("reasons"))


@query()
def spaced_picks(spark, sf):
    quarter = scored(spark, sf).withColumn("area_id", (F.floor(F.col("row") / 32) * 2 + F.floor(F.col("col") / 32)).cast("int")).select("area_id", "row", "col", "score")
    return picks.pick(quarter, "score", 3, 0.5, 12.0, 3, 15, ["area_id"])


@query("with {LATTICE}, " + FACTORS + """, o as (select a.row, a.col, a.score, max(b.score) as high, bool_or(b.score = a.score and (b.row < a.row or (b.row = a.row and b.col < a.col))) as later
 from scored a join scored b on abs(a.row - b.row) <= 3 and abs(a.col - b.col) <= 3 group by 1, 2, 3) select row, col, score from o where score = high and not later and score > 0.5""")
def peak_cells(spark, sf):
    return lattice.peaks(scored(spark, sf).select("row", "col", "score"), "score", 3, 0.5)


@query()
def spaced_blocks(spark, sf):
    b = lattice.blocks(scored(spark, sf).withColumn("area_id", F.lit(0)), 8, F.avg("score").alias("score"), by=["area_id"])
    return picks.blocks_apart(b, "score", 1.0, ["area_id"])


@query()
def score_pipeline(spark, sf):
    """Layers, slopes, smoothed factors, score, penalties, usable ground, peaks, spaced picks with reasons."""
    lat = keep(scored(spark, sf).withColumn("spot", F.col("spot") * F.col("habitat")).select("row", "col", "z", "d", "t", "p", "hit", "spot", "n_on"))
    blurred = lattice.gaussian(lat, "spot", 2.0, SIZE, SIZE)
    near = lattice.disc_sum(lattice.nearest(blurred, points(spark, sf), 12), points(spark, sf).withColumn("n", F.lit(1)), "n", 8)
    cost = S.penalty(F.coalesce(F.sqrt("d2") * 50, F.lit(2000.0)), "total", F.lit(500.0))
    ready = near.withColumn("area_id", F.lit(0)).withColumn("score", r6(F.when(~F.col("hit"), S.score_100("spot") * cost).otherwise(0.0)))
    chosen = picks.pick(ready.select("area_id", "row", "col", "z", "d2", "n_on", "score"), "score", 3, 0.5, 12.0, 3, 15, ["area_id"])
    rules = [(F.col("z") >= 30, F.lit("high ground")), (F.col("n_on") >= 2, F.concat(F.col("n_on").cast("string"), F.lit(" strong factors"))), (F.col("d2").isNull(), F.lit("far from houses"))]
    return chosen.withColumn("reasons", F.array_join(picks.reasons(rules), "; "))
