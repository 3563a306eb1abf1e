import bisect
import math
import random

from pyspark.sql import functions as F

from spurline.operators import evidence
from spurline.plans import fields, grids


def test_ranks_by_counts_against_pairs(spark):
    rng = random.Random(4)
    of = lambda n: [(rng.choice("ab"), rng.choice([None, *map(float, range(9)), rng.random() * 9])) for _ in range(n)]
    used, available = of(400) + [("c", 1.0), (None, 1.0)], of(300) + [(None, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["v"]): (r["position"], r["refs"]) for r in evidence.mid_ranks(frame(used), frame(available), ["k"], "v").collect()}
    assert set(got) == {u for u in used if u[0] in ("a", "b")}
    for (k, v), (position, refs) in got.items():
        valued = [x for key, x in available if key == k and x is not None]
        assert refs == used.count((k, v)) * sum(key == k for key, _ in available)
        assert position is None if v is None else abs(position - sum((x < v) + 0.5 * (x == v) for x in valued) / len(valued)) < 1e-9
    chance = {r["k"]: r["chance"] for r in evidence.outranks_random(frame(used), frame(available), ["k"], "v").collect()}
    for k in "ab":
        pairs = [0 if p is None or q is None else (p < q) + 0.5 * (p == q) for a, p in used if a == k for b, q in available if b == k]
        assert abs(chance[k] - sum(pairs) / len(pairs)) < 1e-9
    assert set(chance) == {"a", "b"}


def test_ranks_make_no_pairs(spark):
    n = 100_000  # 10**10 pairs
    e = spark.range(2 * n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"), (F.col("id") % 2 == 1).alias("odd"))
    r = evidence.mid_ranks(e.where("odd"), e.where("not odd"), ["k"], "v").agg(F.count(F.lit(1)), F.min("position"), F.max("position"), F.avg("position")).first()
    assert r[0] == n and abs(r[1] - 1 / n) < 1e-12 and r[2] == 1.0 and abs(r[3] - (n + 1) / (2 * n)) < 1e-9


def test_tail_of_many_draws(spark):
    cases = [(0, 0), (0, 1), (1, 1), (3, 40), (40, 40), (21, 40), (10_100, 20_001), (400, 20_000), (19_000, 20_000), (50_004_000, 100_000_000)]
    df = spark.createDataFrame(cases, "w long, n long")
    got = {(r["w"], r["n"]): r["p"] for r in df.select("w", "n", evidence.binomial_tail(F.col("w"), F.col("n")).alias("p")).collect()}
    for (w, n), p in got.items():
        if n <= 30_000:
            assert abs(p - float(sum(math.comb(n, k) for k in range(w, n + 1)) / 2**n if n < 100 else exact(w, n))) < 1e-9
    assert abs(got[50_004_000, 100_000_000] - 0.5 * math.erfc((4000 - 0.5) / 5000 / math.sqrt(2))) < 1e-6


def exact(w, n):
    """The tail in whole numbers, by the ratio of neighbouring binomial coefficients."""
    c = above = math.comb(n, w)
    for k in range(w, n):
        c = c * (n - k) // (k + 1)
        above += c
    return (above * 10**15 // 2**n) / 10**15


def test_queries_take_whole_tables(spark, tmp_path):
    """Users, areas and ranks of all kinds."""
    rows = [(u * 20 + i, f"2026-01-01T{i:02d}:{u % 60:02d}:00", u, "purchase" if i % 3 else "view", float((u * 7 + i * 31) % 500), f'{{"k": {(i * i + u) % 50}}}') for u in (3, 7, 12, 45, 61, 62) for i in range(20)]
    e = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.to_timestamp("t").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    users = {3, 7, 12, 45, 61, 62}
    for name in ("line_length", "densify"):
        assert {r["user_id"] for r in fields.QUERIES[name](spark, str(tmp_path)).select("user_id").distinct().collect()} == users
    assert {r["area"] for r in fields.QUERIES["area_metrics"](spark, str(tmp_path)).collect()} == {u % 8 for u in users} | {None}
    assert sum(r["above"] + r["below"] for r in fields.QUERIES["sign_counts"](spark, str(tmp_path)).collect()) == sum(r[4] != 250 for r in rows)
    got = {r["area"]: r["chance"] for r in fields.QUERIES["outranks_random"](spark, str(tmp_path)).collect()}
    for a in {u % 8 for u in users}:
        p, q = (sorted(r[4] for r in rows if r[2] % 8 == a and (r[3] == "purchase") == pin) for pin in (True, False))
        assert abs(got[a] - sum(bisect.bisect_left(p, x) + 0.5 * p.count(x) for x in q) / (len(p) * len(q))) < 1e-6
    odd = [r for r in rows if r[2] % 2]
    assert sum(r["refs"] for r in fields.QUERIES["mid_rank"](spark, str(tmp_path)).collect()) == sum(a[3] == b[3] for a in odd for b in rows if b[2] % 2 == 0)
    assert {"least_cost", "reason_list", "mean_flow_position"} <= set(grids.QUERIES)
    assert not [q for q in (*fields.SQL.values(), *grids.SQL.values()) if "user_id <" in q]


def test_sign_flips_beyond_sixteen(spark):
    of = lambda d: evidence.sign_flips(spark.createDataFrame([(x,) for x in d], "v double"), "v").first()
    assert of([])["p"] == 1.0 and of([1.0, 2.0])["p"] == 0.25
    d = [1.0] * 13 + [-1.0] * 7
    r = of(d)
    assert r["n"] == 20 and r["total"] == 6.0 and abs(r["p"] - sum(math.comb(20, k) for k in range(13, 21)) / 2**20) < 0.02
    assert of([1.0] * 40)["p"] == 1 / 10_001 and of(d)["p"] == r["p"]
