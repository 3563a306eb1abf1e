"""Queries of field records, evidence tests, climate, names and codes over the star tables and events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spurline.functions import scalar as S
from spurline.operators import climate, evidence, records, vectors
from spurline.plans.grids import r6, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


GAPS = "g as (select *, lag(ts) over (partition by {keys} order by ts) as b from events)"


@query(f"with {GAPS.replace('{keys}', 'user_id')} select user_id, cast(sum(case when b is null or epoch_us(ts) - epoch_us(b) >= 1800000000 then 1 else 0 end) as bigint) as hits from g group by 1")
def independent_hits(spark, sf):
    return evidence.independent(events(spark, sf), ["user_id"], "ts")


@query(f"with {GAPS.replace('{keys}', 'user_id, event_type')} select user_id, event_type, cast(sum(case when b is null or epoch_us(ts) - epoch_us(b) >= 1800000000 then 1 else 0 end) as bigint) as hits from g group by 1, 2")
def independent_hits_by_type(spark, sf):
    return evidence.independent(events(spark, sf), ["user_id", "event_type"], "ts")


@query("""with u as (select o_custkey as id, o_orderkey as seq, case when o_orderkey % 3 > 0 then o_orderpriority end as kind, case when o_orderstatus <> 'P' then o_totalprice end as height, case when o_orderstatus = 'F' then '' when o_orderkey % 2 = 0 then cast(o_orderdate::date as varchar) end as stop from orders)
select id, arg_max(kind, seq) filter (kind is not null) as kind, arg_max(height, seq) filter (height is not null) as height, nullif(arg_max(stop, seq) filter (stop is not null), '') as stop from u group by id""")
def deployment_fold(spark, sf):
    o = table(spark, sf, "orders")
    stop = F.when(F.col("o_orderstatus") == "F", F.lit("")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    u = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("kind"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("height"), stop.alias("stop"))
    return evidence.folded(u, "id", "seq", ["kind", "height", "stop"]).withColumn("stop", F.nullif("stop", F.lit("")))


def deployments(spark, sf) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(day).alias("start"), F.max(day).alias("stop"), (F.count(F.lit(1)) % 4).alias("down"))


DEPLOY = "dep as (select o_custkey as id, min(o_orderdate::date) as start, max(o_orderdate::date) as stop, count(*) % 4 as down from orders group by 1)"


@query(f"""with {DEPLOY}, n as (select id, greatest(date_diff('day', start, stop) - down, 0) / date_diff('day', start, stop)::double as share, unnest(generate_series(start, stop - interval 1 day, interval 1 day)) as night from dep where stop > start)
select id, cast(year(night) as int) as year, cast(month(night) as int) as month, round(sum(share), 6) as nights from n group by 1, 2, 3""")
def effort_by_month(spark, sf):
    return evidence.effort_by_month(deployments(spark, sf), "id", "start", "stop", "down").withColumn("nights", r6("nights"))


def stats(spark, sf) -> DataFrame:
    """Per customer: arm (segment), placement, zone (nation), nights and hits."""
    n = deployments(spark, sf).select(F.col("id").alias("c_custkey"), F.greatest(F.datediff("stop", "start") - F.col("down"), F.lit(0)).cast("double").alias("nights"))
    hits = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("arm"), (F.col("c_custkey") % 3).cast("string").alias("placement"), F.col("c_nationkey").alias("zone"))
    both = c.join(n, "c_custkey", "left").join(hits, "c_custkey", "left")
    return both.withColumns({"nights": F.coalesce("nights", F.lit(0.0)), "hits": F.coalesce("hits", F.lit(0))}).withColumn("expected", F.col("nights") * 0.0062)


STATS = f"""{DEPLOY}, st as (select c_custkey, c_mktsegment as arm, cast(c_custkey % 3 as varchar) as placement, c_nationkey as zone, coalesce(greatest(date_diff('day', start, stop) - down, 0), 0)::double as nights, coalesce(h.hits, 0) as hits
 from customer left join dep on dep.id = c_custkey left join (select o_custkey, count(*) filter (o_orderstatus = 'F') as hits from orders group by 1) h on h.o_custkey = c_custkey)"""


PLACES = "['on-feature', 'off-feature', 'unrecorded']"


@query(f"""with {STATS.replace("cast(c_custkey % 3 as varchar)", PLACES + "[c_custkey % 3 + 1]")},
a as (select arm, count(*) as cameras, sum(hits) as hits, sum(nights) as nights, coalesce(sum(nights) filter (placement = 'on-feature'), 0) as cn, coalesce(sum(nights * 0.0062) filter (placement = 'on-feature'), 0) as base, coalesce(sum(hits) filter (placement = 'on-feature'), 0) as ch from st group by 1),
k as (select arm, sum(exp(k * ln(base) - base - lgamma(k + 1))) as below from (select arm, base, unnest(range(0, ch::bigint)) as k from a where base > 0) group by 1)
select arm, null::varchar as placement, cameras, cast(hits as bigint) as hits, round(nights, 1) as nights, case when nights > 0 then round(100.0 * hits / nights, 3) end as per_100, round(cn, 1) as compared_nights, case when cn > 0 then round(100.0 * base / cn, 3) end as base_per_100,
 case when base > 0 and cn >= 30 then round(ch / base, 2) end as ratio, case when base > 0 and cn >= 30 then round(greatest(0, 1 - coalesce(below, 0)), 4) end as p, cn < 30 as few from a left join k using (arm)
union all select arm, placement, count(*), cast(sum(hits) as bigint), round(sum(nights), 1), case when sum(nights) > 0 then round(100.0 * sum(hits) / sum(nights), 3) end, null, null, null, null, null from st group by 1, 2""")
def arm_rates(spark, sf):
    place = F.element_at(F.array(*map(F.lit, ("on-feature", "off-feature", "unrecorded"))), (F.col("c_custkey") % 3).cast("int") + 1)
    return evidence.rates(stats(spark, sf).withColumn("placement", place), "arm", "placement")


PAIRED = f"""{STATS}, pr as (select zone, sum(hits) filter (arm = 'BUILDING') as ha, sum(hits) filter (arm = 'MACHINERY') as hb, sum(nights) filter (arm = 'BUILDING') as na, sum(nights) filter (arm = 'MACHINERY') as nb from st group by zone),
df as (select zone, 100.0 * ha / na as rate_a, 100.0 * hb / nb as rate_b, round(100.0 * ha / na - 100.0 * hb / nb, 6) as difference from pr where na > 0 and nb > 0)"""


@query(f"with {PAIRED} select zone, round(rate_a, 6) as rate_a, round(rate_b, 6) as rate_b, difference from df")
def paired_zones(spark, sf):
    return evidence.paired(stats(spark, sf), "zone", "arm", "BUILDING", "MACHINERY").select("zone", r6("rate_a").alias("rate_a"), r6("rate_b").alias("rate_b"), r6("difference").alias("difference"))


REGIONAL = PAIRED.replace("c_nationkey as zone", "c_nationkey // 5 as zone")


@query(f"""with {REGIONAL}, t as (select row_number() over (order by zone) - 1 as i, difference as d from df),
m as (select w.i as way, sum(case when (w.i >> t.i) % 2 = 1 then d else -d end) as s from range(1024) w(i) cross join t where w.i < power(2, (select count(*) from t)) group by w.i)
select cast((select count(*) from t) as int) as n, round((select sum(d) from t), 6) as total, round(count(*) filter (s >= (select sum(d) from t) - 1e-9) / count(*)::double, 6) as p from m""")
def sign_flip_exact(spark, sf):
    """Zones of five nations each: all signs are tried."""
    wide = stats(spark, sf).withColumn("zone", F.expr("zone div 5"))
    d = evidence.paired(wide, "zone", "arm", "BUILDING", "MACHINERY").select(r6("difference").alias("difference"))
    return evidence.sign_flips(d, "difference").select("n", r6("total").alias("total"), r6("p").alias("p"))


@query()
def sign_flip_drawn(spark, sf):
    return evidence.sign_flips(paired_zones(spark, sf), "difference").select("n", r6("total").alias("total"), r6("p").alias("p"))


@query("""with e as (select event_type, count(*) filter (value > 250) as above, count(*) filter (value < 250) as below from events group by 1),
k as (select *, unnest(range(above, above + below + 1)) as k from e)
select event_type, cast(above as int) as above, cast(below as int) as below, round(sum(exp(lgamma(above + below + 1) - lgamma(k + 1) - lgamma(above + below - k + 1) - (above + below) * ln(2))), 5) as p from k group by 1, 2, 3""")
def sign_counts(spark, sf):
    return evidence.sign_test(events(spark, sf), "value", 250.0, ["event_type"]).withColumn("p", F.round("p", 5))


@query("""with u as (select event_type, value from events where user_id % 2 = 1), a as (select event_type, value as ref from events where user_id % 2 = 0)
select event_type, value, round(avg((ref < value)::int) + 0.5 * avg((ref = value)::int), 6) as position, count(*) as refs from u join a using (event_type) group by 1, 2""")
def mid_rank(spark, sf):
    """Events of odd users among those of even ones: each event is of one or the other."""
    e = events(spark, sf)
    return evidence.mid_ranks(e.where("user_id % 2 = 1"), e.where("user_id % 2 = 0"), ["event_type"], "value").withColumn("position", r6("position"))


BINS = """av as (select value from events where event_type <> 'purchase'), q as (select distinct unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from av),
inn as (select e from q where e > (select min(value) from av) and e < (select max(value) from av)),
pl as (select event_type = 'purchase' as used, (select count(*) from inn where e <= value) as bin from events),
bb as (select bin, count(*) filter (used) as used, count(*) filter (not used) as available from pl group by bin),
br as (select *, case when available > 0 then (used / sum(used) over ()) / (available / sum(available) over ()) end as ratio from bb)"""


@query(f"with {BINS} select cast(bin as int) as bin, used, available, round(ratio, 6) as ratio from br")
def boyce_bins(spark, sf):
    e = events(spark, sf).withColumn("used", F.col("event_type") == "purchase")
    return evidence.used_available(e, "value", "used").withColumn("ratio", r6("ratio"))


@query(f"""with {BINS}, rk as (select ratio, rank() over (order by ratio) + (count(*) over (partition by ratio) - 1) / 2.0 as r, rank() over (order by bin) as q from br where ratio is not null)
select count(*) as bins, case when (select sum(used) >= 5 and sum(available) >= 10 and count(*) >= 3 from bb) and count(*) >= 3 and max(ratio) > min(ratio) then round(corr(r, q), 3) end as boyce from rk""")
def boyce_index(spark, sf):
    e = events(spark, sf).withColumn("used", F.col("event_type") == "purchase")
    return evidence.boyce(e, "value", "used")


@query("select event_type, cast(user_id % 4 as bigint) as bucket, round(avg(value), 5) as mean, round(quantile_cont(value, 0.5), 6) as median, count(*) as n from events group by rollup (event_type, user_id % 4)".replace("cast(user_id % 4 as bigint) as bucket", "user_id % 4 as bucket"))
def rank_rollup(spark, sf):
    e = events(spark, sf).withColumn("bucket", F.col("user_id") % 4)
    return evidence.rolled_up(e, "event_type", "bucket", "value").withColumns({"mean": F.round("mean", 5), "median": r6("median")})


def fixes(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events(spark, sf).select("user_id", "ts", (F.col("value") * 10).alias("x"), (k * 25).alias("y"))


@query("""with f as (select user_id, ts, value * 10 as x, cast(json_extract_string(props, '$.k') as double) * 25 as y from events), w as (select *, x - lag(x) over o as dx, y - lag(y) over o as dy, (epoch_us(ts) - epoch_us(lag(ts) over o)) / 1e6 as seconds from f window o as (partition by user_id order by ts)),
h as (select *, sqrt(dx * dx + dy * dy) as length, (degrees(atan2(dx, dy)) + 360) - 360 * floor((degrees(atan2(dx, dy)) + 360) / 360) as heading from w)
select user_id, ts, seconds, round(length, 4) as length, round(heading, 4) as heading, round((heading - lag(heading) over o + 540) - 360 * floor((heading - lag(heading) over o + 540) / 360) - 180, 4) as turn from h window o as (partition by user_id order by ts) qualify seconds is not null""")
def step_table(spark, sf):
    return evidence.steps(fixes(spark, sf), "user_id", "ts", "x", "y").select("user_id", "ts", "seconds", *(F.round(c, 4).alias(c) for c in ("length", "heading", "turn")))


SUN = """degrees(asin(sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(gm * 15 + lon) - ra)))"""
ALMANAC = """g1 as (select *, radians(357.528 + 0.9856003 * n) as g, radians(23.439 - 0.0000004 * n) as tilt from g0), g2 as (select *, radians(280.460 + 0.9856474 * n + 1.915 * sin(g) + 0.020 * sin(2 * g)) as ec from g1),
g3 as (select *, atan2(cos(tilt) * sin(ec), cos(ec)) as ra, asin(sin(tilt) * sin(ec)) as de, (18.697374558 + 24.06570982441908 * n) - 24 * floor((18.697374558 + 24.06570982441908 * n) / 24) as gm from g2)"""


@query(f"""with f as (select user_id, ts, value * 10 as x, cast(json_extract_string(props, '$.k') as double) * 25 as y, epoch_us(ts) as us from events),
w as (select *, x - lag(x) over o as dx, y - lag(y) over o as dy, (us - lag(us) over o) / 1e6 as seconds from f window o as (partition by user_id order by ts)),
g0 as (select *, sqrt(dx * dx + dy * dy) as length, (degrees(atan2(dx, dy)) + 360) - 360 * floor((degrees(atan2(dx, dy)) + 360) / 360) as heading, us / 1e6 / 86400.0 + 2440587.5 - 2451545.0 as n, -117.6 + x / 70000 as lon, 47.9 + y / 111320 as lat from w where seconds is not null),
{ALMANAC}, s as (select *, {SUN} as sun from g3),
u as (select *, median(seconds) over (partition by user_id) as usual, count(*) over (partition by user_id) as fixes from s),
r as (select *, abs(seconds - usual) <= 0.25 * usual as regular, length > 1 as moved from u where fixes >= 2 and usual <= 8 * 3600),
b as (select *, case when lag(regular) over o and lag(moved) over o then lag(heading) over o end as before from r window o as (partition by user_id order by ts)),
t as (select *, regular and sun < 6 as use, regular and before is not null and moved as turns from b),
p as (select *, use or (regular and count(*) filter (use) over (partition by user_id) < 30) as pooled from t),
q as (select *, turns and (pooled or count(*) filter (turns and pooled) over (partition by user_id) < 30) as turned from p),
ln as (select user_id, row_number() over (partition by user_id order by ts) - 1 as i, length as l from q where pooled),
tn as (select user_id, row_number() over (partition by user_id order by ts) - 1 as i, (heading - before + 540) - 360 * floor((heading - before + 540) / 360) - 180 as a from q where turned),
c as (select user_id, count(*) filter (pooled) as nl, count(*) filter (turned) as nt from q group by 1),
k as (select *, unnest(range(1, 16)) as k from q join c using (user_id) where use),
h as (select *, cast('0x' || substr(md5('0/1/' || user_id || '/' || us || '/' || k), 1, 8) as bigint) % nl as li, case when nt > 0 then cast('0x' || substr(md5('0/2/' || user_id || '/' || us || '/' || k), 1, 8) as bigint) % nt end as ti,
 cast('0x' || substr(md5('0/3/' || user_id || '/' || us || '/' || k), 1, 8) as bigint) * (360.0::double / 4294967296) as free from k),
j as (select h.*, l, radians(coalesce(before + a, free)) as way from h join ln on ln.user_id = h.user_id and ln.i = li left join tn on tn.user_id = h.user_id and tn.i = ti)
select user_id, ts, cast(k as int) as k, round(length, 4) as length, round(x - length * sin(radians(heading)) + l * sin(way), 3) as ax, round(y - length * cos(radians(heading)) + l * cos(way), 3) as ay from j""")
def available_points(spark, sf):
    """Used steps in the dark, the lattice of events taken for metres about a point in the north-west."""
    s = evidence.steps(fixes(spark, sf), "user_id", "ts", "x", "y")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = s.withColumn("sun", S.sun_angle(at, F.lit(-117.6) + F.col("x") / 70000, F.lit(47.9) + F.col("y") / 111320))
    return evidence.strata(s, "user_id", "ts", "x", "y", "sun").select("user_id", "ts", "k", F.round("length", 4).alias("length"), F.round("ax", 3).alias("ax"), F.round("ay", 3).alias("ay"))


@query("""with h as (select event_type, epoch_us(ts) / 1e6 / 86400.0 + 2440587.5 - 2451545.0 as n, event_id, -117.6 + (user_id % 20) * 0.1 as lon, 40.0 + user_id % 15 as lat from events),
g as (select *, radians(357.528 + 0.9856003 * n) as g, radians(23.439 - 0.0000004 * n) as tilt from h), l as (select *, radians(280.460 + 0.9856474 * n + 1.915 * sin(g) + 0.020 * sin(2 * g)) as ec from g),
a as (select *, atan2(cos(tilt) * sin(ec), cos(ec)) as ra, asin(sin(tilt) * sin(ec)) as de, (18.697374558 + 24.06570982441908 * n) - 24 * floor((18.697374558 + 24.06570982441908 * n) / 24) as gm from l)
select event_id, round(degrees(asin(sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(gm * 15 + lon) - ra))), 4) as sun from a""")
def sun_angle(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events(spark, sf).select("event_id", F.round(S.sun_angle(at, F.lit(-117.6) + (F.col("user_id") % 20) * F.lit(0.1), (F.lit(40.0) + F.col("user_id") % 15)), 4).alias("sun"))


@query("""with c as (select cast(user_id % 16 as int) as grp, value % 360 as deg from events)
select grp, cast(cast(floor((deg + 11.25) / 22.5) as int) % 16 as int) as sector, count(*) as n, round(count(*) / sum(count(*)) over (partition by grp)::double, 6) as share from c group by 1, 2""")
def compass_rose(spark, sf):
    e = events(spark, sf).select((F.col("user_id") % 16).cast("int").alias("grp"), (F.col("value") % 360).alias("deg"))
    return climate.rose(e, ["grp"], "deg").withColumn("share", r6("share"))


@query("""with c as (select event_type, cast(hour(ts) // 6 as int) as quarter, radians(value % 360) as a from events), s as (select event_type, quarter, sum(sin(a)) as s, sum(cos(a)) as c, count(*) as n from c group by 1, 2)
select event_type, quarter, round((degrees(atan2(s, c)) + 360) - 360 * floor((degrees(atan2(s, c)) + 360) / 360), 4) as direction, round(sqrt(s * s + c * c) / n, 6) as strength, n from s""")
def circular_mean(spark, sf):
    e = events(spark, sf).select("event_type", F.floor(F.hour("ts") / 6).cast("int").alias("quarter"), (F.col("value") % 360).alias("deg"))
    return climate.circular(e, ["event_type", "quarter"], "deg").withColumns({"direction": F.round("direction", 4), "strength": r6("strength")})


HOURLY = "hr as (select date_trunc('hour', ts) as h, round(avg(value), 6) as p, round(count(*) filter (event_type = 'error') / 100.0, 6) as rain from events group by 1)"


@query(f"with {HOURLY} select h, p, p >= quantile_cont(p, 0.5) over (partition by month(h)) and coalesce(p - lag(p, 6) over (order by h), 0) >= -0.5 and sum(rain) over (order by h rows between 23 preceding and current row) < 0.2 as settled from hr")
def calm_hours(spark, sf):
    hr = events(spark, sf).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(r6(F.avg("value")).alias("p"), F.round(F.count_if(F.col("event_type") == "error") / 100.0, 6).alias("rain"))
    return climate.settled_hours(hr.withColumn("site", F.lit(0)), ["site"], "h", "p", "rain").select("h", "p", "settled")


@query("""with p as (select o_orderkey, lpad(cast(month(o_orderdate) as varchar), 2, '0') || '/01-' || lpad(cast((month(o_orderdate) + o_orderkey % 7 - 1) % 12 + 1 as varchar), 2, '0') || '/28' as span, cast(o_orderkey % 12 + 1 as int) as m, month(o_orderdate) as a, (month(o_orderdate) + o_orderkey % 7 - 1) % 12 + 1 as b from orders)
select o_orderkey, span, m, case when a <= b then m between a and b else m >= a or m <= b end as open, not (b = case when a = 1 then 12 else a - 1 end or (a = 1 and b = 12)) as seasonal from p""")
def open_in_month(spark, sf):
    m = F.month("o_orderdate")
    end = (m + F.col("o_orderkey") % 7 - 1) % 12 + 1
    span = F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit("/01-"), F.lpad(end.cast("string"), 2, "0"), F.lit("/28"))
    o = table(spark, sf, "orders").select("o_orderkey", span.alias("span"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("m"))
    return o.withColumns({"open": S.open_in_month("span", F.col("m")), "seasonal": S.seasonal("span")})


@query("""with k as (select distinct s_suppkey as id, -179.5 + (s_suppkey * 37) % 359 as lon, -80.0 + (s_suppkey * 13) % 160 as lat from supplier),
t as (select id, cast(least(greatest(floor((lon + 180) / 360 * 512), 0), 511) as int) as x, cast(least(greatest(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 512), 0), 511) as int) as y from k)
select id, x, y, array_to_string([cast((x >> (l - 1)) % 2 + 2 * ((y >> (l - 1)) % 2) as varchar) for l in [9, 8, 7, 6, 5, 4, 3, 2, 1]], '') as quadkey from t""")
def quad_key(spark, sf):
    k = _lonlat(spark, sf)
    t = k.select("id", S.tile_xy("lon", "lat", 9).alias("t")).select("id", "t.x", "t.y")
    return t.withColumn("quadkey", S.quadkey("x", "y", 9))


def _lonlat(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.lit(-179.5) + (F.col("s_suppkey") * 37) % 359).alias("lon"), (F.lit(-80.0) + (F.col("s_suppkey") * 13) % 160).alias("lat"))


@query("""with k as (select s_suppkey as id, -179.5 + (s_suppkey * 37) % 359 as lon, -80.0 + (s_suppkey * 13) % 160 as lat from supplier),
c as (select *, 1 / 298.257223563 / (2 - 1 / 298.257223563) as n, floor((lon + 180) / 6) + 1 as zone from k), p as (select *, radians(lon - (zone * 6 - 183)) as dl, radians(lat) as phi, 2 * sqrt(n) / (1 + n) as e from c),
t as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as t from p), x as (select *, atan2(t, cos(dl)) as xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) as eta from t),
a as (select *, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as r, n / 2 - 2 / 3.0 * n ** 2 + 5 / 16.0 * n ** 3 + 41 / 180.0 * n ** 4 as a1, 13 / 48.0 * n ** 2 - 3 / 5.0 * n ** 3 + 557 / 1440.0 * n ** 4 as a2, 61 / 240.0 * n ** 3 - 103 / 140.0 * n ** 4 as a3, 49561 / 161280.0 * n ** 4 as a4 from x)
select id, cast(zone as int) as zone, round(500000 + 0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) as easting,
 round(case when lat < 0 then 1e7 else 0 end + 0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) as northing from a""")
def utm_points(spark, sf):
    u = _lonlat(spark, sf).select("id", S.utm("lon", "lat").alias("u"))
    return u.select("id", "u.zone", F.round("u.easting", 3).alias("easting"), F.round("u.northing", 3).alias("northing"))


@query("""with r as (select s_suppkey as id, 40.0 + s_nationkey as lat, 0.001 * (1 + s_suppkey % 5) as w, 0.002 * (1 + s_suppkey % 3) as h from supplier)
select id, round(w * h * 111320 * cos(radians(lat)) * 110540, 1) as area from r""")
def ring_area(spark, sf):
    w, h, lat = 0.001 * (1 + F.col("s_suppkey") % 5), 0.002 * (1 + F.col("s_suppkey") % 3), F.lit(40.0) + F.col("s_nationkey")
    p = lambda x, y: F.struct((F.lit(-117.0) + x).alias("lon"), y.alias("lat"))
    zero = F.lit(0.0)
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), lat.alias("lat"), F.array(p(zero, lat), p(w, lat), p(w, lat + h), p(zero, lat + h)).alias("ring"))
    return s.select("id", F.round(S.ring_area("ring", "lat"), 1).alias("area"))


@query("""with f as (select user_id, ts, value * 10 as x, cast(json_extract_string(props, '$.k') as double) * 25 as y from events)
select user_id, round(sum(sqrt(dx * dx + dy * dy)), 3) as length, count(*) as points from (select user_id, x - lag(x) over o as dx, y - lag(y) over o as dy from f window o as (partition by user_id order by ts)) group by 1""")
def line_length(spark, sf):
    return vectors.lengths(fixes(spark, sf), "user_id", "ts", "x", "y").withColumn("length", F.round("length", 3))


@query("""with f as (select user_id, ts, value * 10 as x, cast(json_extract_string(props, '$.k') as double) * 25 as y from events),
s as (select *, lead(x) over o as x2, lead(y) over o as y2 from f window o as (partition by user_id order by ts)), d as (select *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) as d from s),
c as (select *, sum(coalesce(d, 0)) over (partition by user_id order by ts) - coalesce(d, 0) as before, sum(coalesce(d, 0)) over (partition by user_id) as total from d),
k as (select user_id, unnest(range(0, cast(ceil(max(total) / 500) as bigint))) as k from c group by user_id)
select c.user_id, k.k, round(x + (x2 - x) * (k.k * 500 - before) / d, 3) as x, round(y + (y2 - y) * (k.k * 500 - before) / d, 3) as y from c join k on k.user_id = c.user_id and k.k * 500 >= before and k.k * 500 < before + d where d > 0
union all select user_id, cast(ceil(total / 500) as bigint), round(x, 3), round(y, 3) from c where d is null""")
def densify(spark, sf):
    return vectors.densified(fixes(spark, sf), "user_id", "ts", "x", "y", 500.0).select("user_id", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""select id, kind, case kind when 'deployment' then start when 'check' then stop else cast(start::date + cast(n * 7 as int) as varchar) end as day from (
 select o_orderkey as id, unnest(case o_orderstatus when 'F' then ['deployment', 'check', 'event', 'event'] when 'O' then ['deployment', 'event'] else ['deployment', 'check'] end) as kind,
  unnest(case o_orderstatus when 'F' then [0, 0, 0, 1] when 'O' then [0, 0] else [0, 0] end) as n, cast(o_orderdate::date as varchar) as start, cast(o_orderdate::date + 30 as varchar) as stop from orders)""")
def v1_expand(spark, sf):
    day = F.to_date("o_orderdate")
    times = F.when(F.col("o_orderstatus") == "F", F.array(day.cast("string"), F.date_add(day, 7).cast("string"))).when(F.col("o_orderstatus") == "O", F.array(day.cast("string"))).otherwise(F.array().cast("array<string>"))
    v1 = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.cast("string").alias("start"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 30).cast("string")).alias("end"), times.alias("times"))
    return records.expanded(v1).select("id", "kind", "day")


@query("""with c as (select c_custkey, 'site' || (c_custkey % 50) as base from customer), used as (select distinct 'site' || (s_suppkey % 20) || case when s_suppkey % 7 = 0 then '' else '#' || (s_suppkey % 7 + 1) end as id from supplier),
tried as (select base, unnest(range(1, cast(count(*) as bigint) + 1 + (select count(*) from used))) as number from c group by base),
free as (select base, number, case when number = 1 then base else base || '#' || number end as id from tried), left_ as (select base, id, row_number() over (partition by base order by number) as place from free where id not in (select id from used)),
p as (select *, row_number() over (partition by base order by c_custkey) as place from c) select c_custkey, id from p join left_ using (base, place)""")
def free_ids(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("site"), (F.col("c_custkey") % 50).cast("string")).alias("base"))
    k = F.col("s_suppkey")
    used = table(spark, sf, "supplier").select(F.concat(F.lit("site"), (k % 20).cast("string"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("#"), (k % 7 + 1).cast("string")))).alias("id"))
    return records.named(c, "base", "c_custkey", used).select("c_custkey", "id")


@query("""select c_custkey, 'team/' || c_name as name, 'team' as sender from customer where c_nationkey = 3 union all select c_custkey, c_name, case when c_custkey % 5 = 0 then 'old' end from customer where c_nationkey <> 3 and c_custkey % 5 <> 1""")
def keyed_replace(spark, sf):
    c = table(spark, sf, "customer")
    sender = F.when(F.col("c_custkey") % 5 == 0, "old").when(F.col("c_custkey") % 5 == 1, "team")
    mine = c.where("c_nationkey <> 3").select("c_custkey", F.col("c_name").alias("name"), sender.alias("sender"))
    theirs = records.imported(c.where("c_nationkey = 3").select("c_custkey", F.col("c_name").alias("name")), "team", ["name"])
    return records.replaced(mine, theirs, "sender", "team")


@query()
def greedy_tiles(spark, sf):
    counts = events(spark, sf).groupBy((F.col("value") / 25).cast("long").alias("cell"), (F.col("user_id") % 20).alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return evidence.greedy_cover(counts, "cell", "unit", 300, 6)


@query("""with n as (select r_regionkey, r_name, lower(r_name) as low from region) select r_name, regexp_replace(regexp_replace(low, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, r_name || ' (' || n_name || ')' as label, contains(low, 'asia') or contains(low, 'east') as mention
from n join nation on n_regionkey = r_regionkey""")
def names(spark, sf):
    j = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("r_name", S.slug("r_name").alias("slug"), S.display_name("r_name", "n_name").alias("label"), S.mentions("r_name", ["asia", "east"]).alias("mention"))


@query("""with b as (select event_type = 'purchase' as pin, user_id % 8 as area, value from events), p as (select area, value as p from b where pin), q as (select area, value as q from b where not pin)
select area, round(avg(case when p < q then 1.0 when p = q then 0.5 else 0 end), 6) as chance from p join q using (area) group by 1""")
def outranks_random(spark, sf):
    """Purchases among all other events of their area."""
    b = events(spark, sf).select((F.col("user_id") % 8).alias("area"), "value", (F.col("event_type") == "purchase").alias("pin"))
    return evidence.outranks_random(b.where("pin"), b.where("not pin"), ["area"], "value").withColumn("chance", r6("chance"))


@query("""with m as (select user_id % 8 as area, value / 500 as rank from events) select area, count(*) as pins, round(quantile_cont(rank, 0.5), 6) as median, round(avg((rank <= 0.10)::int), 6) as top10, round(avg((rank <= 0.25)::int), 6) as top25 from m group by grouping sets ((area), ())""")
def area_metrics(spark, sf):
    m = events(spark, sf).select((F.col("user_id") % 8).alias("area"), (F.col("value") / 500).alias("rank"))
    share = lambda x: r6(F.avg((F.col("rank") <= x).cast("double")))
    return m.groupingSets([["area"], []], "area").agg(F.count(F.lit(1)).alias("pins"), r6(F.median("rank")).alias("median"), share(0.10).alias("top10"), share(0.25).alias("top25"))