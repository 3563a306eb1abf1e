"""Field records against a score: effort, independent detections, rates, paired and rank tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spurline.operators.ranks import quantiles
from spurline.operators.store import keep


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number, as a sum of logarithms."""
    return F.aggregate(F.when(n >= 2, F.sequence(F.lit(2), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))


def ln_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series with an exact start."""
    m = F.greatest(n.cast("double"), F.lit(1.0))
    return F.when(n <= 1, 0.0).otherwise((m + 0.5) * F.ln(m) - m + 0.5 * math.log(2 * math.pi) + _stirling_rest(m))


def poisson_tail(hits: Column, expected: Column) -> Column:
    """Chance of so many hits or more; the chances of fewer are added up in logarithms, so large expectations don't underflow."""
    below = F.when(hits >= 1, F.sequence(F.lit(0), (hits - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.greatest(F.lit(0.0), 1 - F.aggregate(below, F.lit(0.0), lambda a, k: a + F.exp(k * F.ln(expected) - expected - ln_factorial(k))))


def _stirling_rest(n: Column) -> Column:
    """ln n! less Stirling's formula, for n from 1; the series' error is below 1e-13 from 16 on."""
    n = n.cast("double")
    exact = log_factorial(F.least(n, F.lit(16.0))) - (n + 0.5) * F.ln(n) + n - 0.5 * math.log(2 * math.pi)
    return F.when(n < 16, exact).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n)


def _fair_chance(k: Column, n: Column) -> Column:
    """Chance of k wins in n fair draws, by Stirling's formula with its rest, so that large parts cancel before they are added."""
    d = (2.0 * k - n) / n
    inner = F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - k * F.log1p(d) - (n - k) * F.log1p(-d)) * F.sqrt(n / (2 * math.pi * k * (n - k)))
    return F.when((k == 0) | (k == n), F.exp(-n * math.log(2))).otherwise(inner)


def binomial_tail(wins: Column, n: Column) -> Column:
    """Chance of so many wins or more in n fair draws.

    Draws further than 20 * sqrt(n) from the middle are left out: their chance, below exp(-800), is 0 in doubles.
    """
    wide = 20 * F.sqrt(n)
    first, last = F.greatest(wins.cast("long"), F.floor(n / 2 - wide)), F.least(n.cast("long"), F.ceil(n / 2 + wide))
    at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(at, F.lit(0.0), lambda a, k: a + _fair_chance(k, n)))


def normal_tail(z: Column) -> Column:
    """Chance of a standard normal above z, by a rational approximation of the error function (error below 2e-7)."""
    # Coefficients of the published approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = sum((c * F.pow(t, F.lit(float(i + 1))) for i, c in enumerate(a)), F.lit(0.0))
    upper = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def independent(events: DataFrame, keys: Sequence[str], ts: str, minutes: int = 30) -> DataFrame:
    """Per key: hits. A time counts when the one before it is at least so many minutes back; rows without a time count each."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last()))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("counts", F.col(ts).isNull() | before.isNull() | (gap >= minutes * 60_000_000)).groupBy(*keys).agg(F.sum(F.col("counts").cast("long")).alias("hits"))


def folded(updates: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key: of every column the last value that isn't null, in order."""
    return updates.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def effort_by_month(deployments: DataFrame, key: str, start: str, stop: str, downtime: str) -> DataFrame:
    """Nights of each key and month: from start to the day before stop, less downtime (not below 0), which is spread evenly over them."""
    span = F.datediff(stop, start)
    share = F.when(span > 0, F.greatest(span - F.col(downtime), F.lit(0)) / span).otherwise(0.0)
    nights = deployments.where(span > 0).select(key, share.alias("share"), F.explode(F.sequence(F.col(start), F.date_sub(stop, 1))).alias("night"))
    return nights.groupBy(key, F.year("night").alias("year"), F.month("night").alias("month")).agg(F.sum("share").alias("nights"))


def rates(stats: DataFrame, arm: str, placement: str, on: str = "on-feature", least_nights: float = 30.0) -> DataFrame:
    """stats: nights, hits, expected. Per arm (placement null), and per arm and placement: cameras, nights, hits and per_100 nights.

    Rows of an arm compare its cameras of the placement `on` alone with what was expected of them: compared_nights, base_per_100, ratio, and p, the
    Poisson chance of doing that well; ratio and p are null, and few true, below least_nights of such nights.
    """
    is_on = F.col(placement) == on
    of = lambda c: F.coalesce(F.sum(F.when(is_on, F.col(c))), F.lit(0.0))
    sums = [F.count(F.lit(1)).alias("cameras"), F.sum("hits").alias("hits"), F.sum("nights").alias("nights")]
    each = stats.groupBy(arm, placement).agg(*sums)
    whole = stats.groupBy(arm).agg(*sums, of("nights").alias("compared_nights"), of("expected").alias("base"), of("hits").alias("on_hits"))
    few = F.col("compared_nights") < least_nights
    shown = (F.col("base") > 0) & ~few
    per_100 = F.when(F.col("nights") > 0, F.round(100.0 * F.col("hits") / F.col("nights"), 3)).alias("per_100")
    compared = whole.select(
        arm, F.lit(None).cast("string").alias(placement), "cameras", "hits", F.round("nights", 1).alias("nights"), per_100, F.round("compared_nights", 1).alias("compared_nights"),
        F.when(F.col("compared_nights") > 0, F.round(100.0 * F.col("base") / F.col("compared_nights"), 3)).alias("base_per_100"), F.when(shown, F.round(F.col("on_hits") / F.col("base"), 2)).alias("ratio"),
        F.when(shown, F.round(poisson_tail(F.col("on_hits"), F.col("base")), 4)).alias("p"), few.alias("few"),
    )
    return compared.unionByName(each.select(arm, placement, "cameras", "hits", F.round("nights", 1).alias("nights"), per_100), allowMissingColumns=True)


def paired(stats: DataFrame, zone: str, arm: str, one: str, other: str) -> DataFrame:
    """stats: hits, nights. Zones with nights of both arms: the rates of each per 100 nights and their difference."""
    of = lambda c, which: F.sum(F.when(F.col(arm) == which, F.col(c))).alias(f"{c}_{'a' if which == one else 'b'}")
    both = stats.where(F.col(arm).isin(one, other)).groupBy(zone).agg(*(of(c, w) for c in ("hits", "nights") for w in (one, other))).where("nights_a > 0 and nights_b > 0")
    rate = lambda x: 100.0 * F.col(f"hits_{x}") / F.col(f"nights_{x}")
    return both.withColumns({"rate_a": rate("a"), "rate_b": rate("b"), "difference": rate("a") - rate("b")})


def sign_flips(differences: DataFrame, value: str, most: int = 16, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: n, total, p: the share of the 2**n ways to set the signs whose sum is at least as large; 1 for none.

    Beyond n = `most`, p is (1 + those of `draws`) / (1 + draws) with signs drawn by hashes of (seed, draw, place).
    """
    spark = differences.sparkSession
    listed = differences.agg(F.sort_array(F.collect_list(F.col(value))).alias("d")).withColumn("total", F.aggregate("d", F.lit(0.0), lambda a, x: a + x))
    few = listed.where(F.size("d") <= most).withColumn("way", F.explode(F.expr("sequence(0, shiftleft(1, size(d)) - 1)"))).withColumn("signed", F.expr("transform(d, (x, i) -> if(shiftright(way, i) % 2 = 1, x, -x))"))
    many = spark.range(draws).withColumnRenamed("id", "way").crossJoin(F.broadcast(listed.where(F.size("d") > most)))  # listed: one row
    many = many.withColumn("signed", F.expr(f"transform(d, (x, i) -> if(xxhash64({seed}, way, i) % 2 = 0, x, -x))"))
    ways = few.select("d", "total", "signed").withColumn("own", F.lit(0)).unionByName(many.select("d", "total", "signed").withColumn("own", F.lit(1)))
    hit = F.aggregate("signed", F.lit(0.0), lambda a, x: a + x) >= F.col("total") - 1e-9
    out = ways.select(F.size("d").alias("n"), "total", "own", hit.alias("hit")).groupBy("n", "total", "own").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("ways"))
    return out.select("n", "total", ((F.col("hits") + F.col("own")) / (F.col("ways") + F.col("own"))).alias("p"))


def sign_test(df: DataFrame, value: str, middle: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Above and below the middle, ties dropped, with the one-sided binomial p."""
    counts = df.groupBy(*by).agg(F.count_if(F.col(value) > middle).cast("int").alias("above"), F.count_if(F.col(value) < middle).cast("int").alias("below"))
    return counts.withColumn("p", binomial_tail(F.col("above"), F.col("above") + F.col("below")))


def _counted_below(used: DataFrame, available: DataFrame, keys: Sequence[str], value: str, ranges: int = 64) -> DataFrame:
    """Per keys and value of used: used (rows), below and equal (available rows), valued and total (those of the keys with a value, and all).

    Counts of equal values are summed up in ranges of values, then over the ranges, so no pair of rows is made and a key's values are many tasks.
    """
    of = lambda df, u: df.select(*keys, F.col(value).alias(value), F.lit(u).alias("u"))
    counts = of(used, 1).unionByName(of(available, 0)).dropna(subset=list(keys)).groupBy(*keys, value).agg(F.sum("u").alias("used"), F.sum(1 - F.col("u")).alias("equal"))
    counts = keep(counts)
    edges = counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)]).alias("edges"))
    # equal values are in one range; null is one of its own before all others
    placed = counts.crossJoin(F.broadcast(edges)).withColumn("range", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col(value))))).drop("edges")
    sums = placed.groupBy(*keys, "range").agg(F.sum("equal").alias("n"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most ranges + 1 rows for each key
    valued = F.when(F.col("range") >= 0, F.col("n")).otherwise(0)
    sums = sums.select(*keys, "range", F.coalesce(F.sum(valued).over(before), F.lit(0)).alias("lower"), F.sum(valued).over(whole).alias("valued"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("equal").over(inside), F.lit(0))).where("used > 0").join(sums, [*keys, "range"]).where("total > 0")
    return summed.select(*keys, value, "used", (F.col("lower") + F.col("inside")).alias("below"), "equal", "valued", "total")


def mid_ranks(used: DataFrame, available: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds position to used: the share of the available values of its keys below it and half of those equal."""
    c = _counted_below(used, available, keys, value)
    position = F.when(F.col(value).isNotNull(), F.try_divide(F.col("below") + 0.5 * F.col("equal"), F.col("valued")))
    return c.select(*keys, value, position.alias("position"), (F.col("used") * F.col("total")).alias("refs"))


def rank_p(mean_rank: Column, n: Column, k: int) -> Column:
    """One-sided p of a mean rank of n strata with k available points each, by the normal approximation."""
    return normal_tail((mean_rank - 0.5) / F.sqrt((k + 2) / (12.0 * k) / n))


def used_available(df: DataFrame, value: str, used: str, bins: int = 10) -> DataFrame:
    """Per bin of equally many available rows (fewer bins where values tie): used and available rows, and the ratio of their shares, null where none is available. Null values are left out."""
    edges = quantiles(df.where(~F.col(used)), value, [i / bins for i in range(1, bins)]).agg(F.array_sort(F.collect_set(value)).alias("edges"))  # at most bins - 1 values
    range_ = df.where(~F.col(used)).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    inner = edges.crossJoin(range_).select(F.filter("edges", lambda e: (e > F.col("low")) & (e < F.col("high"))).alias("edges"))  # one row
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(inner)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value))))
    counted = placed.groupBy("bin").agg(F.count_if(used).alias("used"), F.count_if(~F.col(used)).alias("available"))
    whole = Window.partitionBy()  # at most `bins` rows
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(whole))
    return counted.withColumn("ratio", F.when(F.col("available") > 0, share("used") / share("available")))


def boyce(df: DataFrame, value: str, used: str, bins: int = 10, least_used: int = 5) -> DataFrame:
    """One row: bins with available rows, and boyce, the rank correlation of bin and ratio of used_available().

    It is null with fewer than least_used used or `bins` available rows, under three bins, or one ratio in all of them.
    """
    b = used_available(df, value, used, bins)
    whole = Window.partitionBy()  # at most `bins` rows
    ok = b.withColumns({"all_used": F.sum("used").over(whole), "all_available": F.sum("available").over(whole), "all_bins": F.count(F.lit(1)).over(whole)}).where("ratio is not null")
    ranked = ok.withColumn("r", F.rank().over(whole.orderBy("ratio")) + (F.count(F.lit(1)).over(Window.partitionBy("ratio")) - 1) / 2).withColumn("q", F.rank().over(whole.orderBy("bin")))
    n = F.count(F.lit(1))
    enough = (F.max("all_used") >= least_used) & (F.max("all_available") >= bins) & (F.max("all_bins") >= 3) & (n >= 3) & (F.max("ratio") > F.min("ratio"))
    return ranked.agg(n.alias("bins"), F.when(enough, F.round(F.corr("r", "q"), 3)).alias("boyce"))


def rolled_up(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean, median and rows of value for each (outer, inner), each outer, and all."""
    return df.rollup(outer, inner).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))


def steps(fixes: DataFrame, key: str, ts: str, x: str, y: str) -> DataFrame:
    """Per fix but the first: seconds, length, heading (degrees, north 0), turn (degrees, -180 to 180) from the one before."""
    w = Window.partitionBy(key).orderBy(ts)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    out = fixes.withColumns({"seconds": (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6, "length": F.hypot(dx, dy), "heading": F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))})
    turn = F.pmod(F.col("heading") - F.lag("heading").over(w) + 180, F.lit(360.0)) - 180
    return out.withColumn("turn", turn).where("seconds is not null")


def one_fix_per_time(fixes: DataFrame, key: str, ts: str, x: str, y: str) -> DataFrame:
    """The first position, by x and y, of each time."""
    w = Window.partitionBy(key, ts).orderBy(x, y)
    return fixes.distinct().withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def drawn(seed: str, salt: int, *key: str) -> Column:
    """A number from 0 to 2**32 - 1 that follows from the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit(str(salt)), *(F.col(k).cast("string") for k in key))), 1, 8), 16, 10).cast("long")


def strata(steps_: DataFrame, key: str, ts: str, x: str, y: str, sun: str, draws: int = 15, tolerance: float = 0.25, longest_h: float = 8.0, dark: float = 6.0, enough: int = 30, seed: str = "0") -> DataFrame:
    """steps_: the result of steps() with sun, its height in degrees. For each used step draws available end points: key, ts, x, y, length, k, ax, ay.

    Used are steps within tolerance of the key's median interval that end with the sun below `dark`, of keys with three fixes and an interval of up to longest_h hours. Available points start where the step does.
    Their lengths are drawn from the key's used steps, and their turns, from the heading of the step before, from those of these that have one: it is
    regular too and both moved over a metre. Where fewer than `enough` are used, or turn, those of any hour are drawn from. Without a heading before, or any turn, the heading is drawn.
    Draws are hashes of (seed, key, ts, k), so a stratum has the same points however the work is cut.
    """
    w = Window.partitionBy(key).orderBy(ts)
    usual = steps_.groupBy(key).agg(F.median("seconds").alias("usual"), F.count(F.lit(1)).alias("steps"))
    near = steps_.join(usual.where((F.col("steps") >= 2) & (F.col("usual") <= longest_h * 3600)), key).withColumns({"regular": F.abs(F.col("seconds") - F.col("usual")) <= tolerance * F.col("usual"), "moved": F.col("length") > 1.0})
    near = near.withColumn("before", F.when(F.lag("regular").over(w) & F.lag("moved").over(w), F.lag("heading").over(w)))
    near = near.withColumns({"use": F.col("regular") & (F.col(sun) < dark), "turns": F.col("regular") & F.col("before").isNotNull() & F.col("moved")})
    whole = Window.partitionBy(key)
    near = near.withColumn("wide", F.count_if("use").over(whole) < enough)
    near = near.withColumn("pooled", F.col("use") | (F.col("wide") & F.col("regular")))
    near = keep(near.withColumn("turned", F.col("turns") & (F.col("pooled") | (F.count_if(F.col("turns") & F.col("pooled")).over(whole) < enough))))

    def pool(which: str, value: Column, name: str) -> DataFrame:
        return near.where(which).select(key, (F.row_number().over(w) - 1).cast("long").alias(f"{name}_i"), value.alias(name))

    lengths, turns = pool("pooled", F.col("length"), "drawn_length"), pool("turned", F.pmod(F.col("heading") - F.col("before") + 180, F.lit(360.0)) - 180, "drawn_turn")
    sizes = near.groupBy(key).agg(F.count_if("pooled").alias("lengths"), F.count_if("turned").alias("turns_n"))
    asked = near.where("use").join(sizes, key).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp")))
    of = lambda salt: drawn(seed, salt, key, "micros", "k")
    asked = asked.withColumns({"drawn_length_i": of(1) % F.col("lengths"), "drawn_turn_i": F.when(F.col("turns_n") > 0, of(2) % F.greatest("turns_n", F.lit(1))), "free": of(3) * (360.0 / 2**32)})
    a = F.radians(F.coalesce(F.col("before") + F.col("drawn_turn"), F.col("free")))
    start = lambda c, f: F.col(c) - F.col("length") * f(F.radians("heading"))
    return asked.join(lengths, [key, "drawn_length_i"]).join(turns, [key, "drawn_turn_i"], "left").select(
        key, ts, x, y, "length", "k", (start(x, F.sin) + F.col("drawn_length") * F.sin(a)).alias("ax"), (start(y, F.cos) + F.col("drawn_length") * F.cos(a)).alias("ay")
    )


def outranks_random(pins: DataFrame, randoms: DataFrame, by: Sequence[str], rank: str) -> DataFrame:
    """Per area: the chance that a pin ranks before a random point, ties half, null ranks never."""
    c = _counted_below(randoms, pins, by, rank)
    before = F.when(F.col(rank).isNotNull(), F.col("used") * (F.col("below") + 0.5 * F.col("equal"))).otherwise(0.0)
    return c.groupBy(*by).agg((F.sum(before) / F.sum(F.col("used") * F.col("total"))).alias("chance"))


def greedy_cover(counts: DataFrame, cell: str, unit: str, need: int, most: int) -> DataFrame:
    """counts: cell, unit, n. Cells picked one after another, each adding the most of sum(min(n, what the unit still needs)); ties to the lowest cell.

    Each pick is one job over the counts; only the picked cell comes to the driver.
    """
    spark, picked = counts.sparkSession, []
    for _ in range(most):
        done = counts.where(F.col(cell).isin(picked)).groupBy(unit).agg(F.sum("n").alias("have"))
        left = counts.where(~F.col(cell).isin(picked)).join(done, unit, "left")
        gain = F.sum(F.least(F.col("n"), F.greatest(need - F.coalesce("have", F.lit(0)), F.lit(0)))).alias("gain")
        best = left.groupBy(cell).agg(gain).where("gain > 0").orderBy(F.desc("gain"), cell).limit(1).collect()
        if not best:
            break
        picked.append(best[0][cell])
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(picked)], f"place int, {cell} long")


def robust_spread(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per `by`: 1.4826 times the median distance from the median of the finite values, or 1 where that is 0 or there are none."""
    sound = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (F.abs(F.col(value)) < F.lit(float("inf"))))
    middle = quantiles(sound, value, [0.5], by).select(*by, F.col(value).alias("middle"))
    away = (sound.join(middle, list(by)) if by else sound.crossJoin(F.broadcast(middle))).withColumn("away", F.abs(F.col(value) - F.col("middle")))
    found = quantiles(away, "away", [0.5], by).select(*by, (1.4826 * F.col("away")).alias("spread"))
    every = df.select(*by).distinct().join(found, list(by), "left") if by else df.sparkSession.range(1).select().crossJoin(F.broadcast(found.agg(F.first("spread").alias("spread"))))
    return every.select(*by, F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0).alias("spread"))


def ended(deployments: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Adds ended to deployments (key, end): its end, else the day of the first check (key, day, removed) that removed it."""
    first = checks.where("removed").groupBy(key).agg(F.min("day").alias("first"))
    return deployments.join(first, key, "left").withColumn("ended", F.coalesce("end", "first")).drop("first")


def half_away(x: Column | str, places: int) -> Column:
    """x rounded as SQL rounds doubles: x * 10^places to the nearest whole, halves away from zero, and zero keeps the sign of x. F.round goes by the decimal digits of x instead, so they part at halves that a sum missed by its last bit."""
    x, p = (F.col(x) if isinstance(x, str) else x), 10.0**places
    size = F.floor(F.abs(x) * p + 0.5).cast("double") / p
    return F.when(F.abs(x) * p < 2.0**52, F.when(x < 0, -size).when(x == 0, x).otherwise(size)).otherwise(x)


def summaries(ranks: DataFrame, by: Sequence[str], least: float = 100.0, order: str | None = None) -> DataFrame:
    """ranks: rank, k (available points), step. Per `by`: n, mean rank, p by the normal approximation with each stratum's own k, and the same mean of the steps of at least `least`.

    With order, ranks are added up in it (null first, ties by rank), so that means which are halves at the third place round alike however the rows are dealt out; that sorts each group, so it is for groups of few rows.
    """
    moving = F.col("step") >= least
    mean, moving_mean = F.avg("rank"), F.avg(F.when(moving, F.col("rank")))
    if order is not None:
        w = Window.partitionBy(*by).orderBy(order, "rank")
        w_sum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranks = ranks.withColumns({"at_": F.row_number().over(w), "sum_": F.sum("rank").over(w_sum), "moving_sum_": F.sum(F.when(moving, F.col("rank"))).over(w_sum)})
        mean, moving_mean = (F.try_divide(F.max_by(c, "at_"), F.count(r)) for c, r in (("sum_", F.col("rank")), ("moving_sum_", F.when(moving, F.col("rank")))))
    out = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), F.sum((F.col("k") + 2) / (12.0 * F.col("k"))).alias("v"), F.count_if(moving).alias("moving"), moving_mean.alias("moving_rank"))
    return out.select(*by, "n", half_away("mean", 3).alias("rank"), F.round(normal_tail((F.col("mean") - 0.5) / (F.sqrt("v") / F.col("n"))), 4).alias("p"), "moving", half_away("moving_rank", 3).alias("moving_rank"))


def across(animals: DataFrame, by: Sequence[str], value: str, least: int = 20) -> DataFrame:
    """animals: n and value of each. Per `by`, of those with at least so many strata: animals, the median of value, and the sign test against one half."""
    ok = animals.where(F.col("n") >= least)
    tested = sign_test(ok, value, 0.5, by)
    middle = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("animals"), F.round(F.median(value), 3).alias("median"))
    return (middle.join(tested, list(by)) if by else middle.crossJoin(tested)).withColumn("p", F.when(F.col("above") + F.col("below") > 0, F.col("p")))


def compared(one: DataFrame, other: DataFrame, key: str, value: str, by: Sequence[str] = (), least: int = 20, unranked: bool = False) -> DataFrame:
    """one, other: key, n, value. Per `by`, of the keys in both with at least `least` strata in one: where one is better and worse, the mean difference, and the two-sided sign test.

    Keys without a value are no pairs; with unranked, those that lack it in one alone count as pairs, neither better nor worse.
    """
    both = one.where(F.col("n") >= least).join(other.select(key, F.col(value).alias("value_b")), key).where((F.lit(unranked) | F.col(value).isNotNull()) & F.col("value_b").isNotNull())
    d = F.col(value) - F.col("value_b")
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), half_away(F.avg(d), 3).alias("mean_diff"))
    n = F.col("better") + F.col("worse")
    two = F.least(F.lit(1.0), 2 * binomial_tail(F.greatest("better", "worse"), n))
    return out.withColumn("p", F.when(n > 0, F.round(two, 4)))


def tracks_needed(spark: SparkSession, chances: Sequence[float], alpha: float = 0.05, power: float = 0.8, most: int = 200) -> DataFrame:
    """Per chance that a track beats its copies: the fewest tracks (up to most) with which the sign test at alpha finds it with the power wanted; null where none do."""
    n = spark.range(1, most + 1).select(F.col("id").alias("n"))
    k = n.withColumn("k", F.explode(F.sequence(F.lit(0), "n")))
    least = k.where(binomial_tail(F.col("k"), F.col("n")) <= alpha).groupBy("n").agg(F.min("k").alias("least"))
    asked = spark.createDataFrame([(float(c),) for c in chances], "chance double")
    each = least.crossJoin(F.broadcast(asked)).withColumn("i", F.explode(F.sequence("least", "n")))
    term = F.exp(ln_factorial(F.col("n")) - ln_factorial(F.col("i")) - ln_factorial(F.col("n") - F.col("i")) + F.col("i") * F.ln("chance") + F.when(F.col("i") == F.col("n"), 0.0).otherwise((F.col("n") - F.col("i")) * F.log1p(-F.col("chance"))))
    found = each.groupBy("chance", "n").agg(F.sum(term).alias("power")).where(F.col("power") >= power - 1e-12).groupBy("chance").agg(F.min("n").alias("tracks"))
    return asked.join(found, "chance", "left")


def transects(routes: DataFrame, crossings: DataFrame, survey: str, value: str, metres: float = 5.0) -> DataFrame:
    """routes, crossings: the score at each route point and crossing inside the area. One row: crossings, auc (the mean share of its own route's points that a crossing
    outscores, ties half), route km, and crossings per 10 km in the top and bottom third of all route points."""
    placed = mid_ranks(crossings, routes, [survey], value).join(crossings.groupBy(survey, value).agg(F.count(F.lit(1)).alias("times")), [survey, value])
    auc = placed.agg(F.sum("times").alias("crossings"), F.round(F.sum(F.col("position") * F.col("times")) / F.sum("times"), 3).alias("auc"))
    thirds = quantiles(routes, value, [1 / 3, 2 / 3]).agg(F.min(value).alias("low"), F.max(value).alias("high"))  # one row
    count = lambda df, name: df.crossJoin(F.broadcast(thirds)).agg(F.count_if(F.col(value) >= F.col("high")).alias(f"{name}_top"), F.count_if(F.col(value) <= F.col("low")).alias(f"{name}_bottom"), F.count(F.lit(1)).alias(name))
    per = lambda end: F.round(F.try_divide(10.0 * F.col(f"c_{end}"), F.col(f"r_{end}") * metres / 1000), 2).alias(f"{end}_per_10km")
    return auc.crossJoin(count(routes, "r")).crossJoin(count(crossings, "c")).select("crossings", "auc", F.round(F.col("r") * metres / 1000, 2).alias("route_km"), per("top"), per("bottom"))
