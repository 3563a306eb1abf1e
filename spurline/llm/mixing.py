"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.llm.common import keep

#: Rows that one leaf of the reduction tree takes about, and leaves under one node.
LEAF_ROWS, FAN_IN = 2_000, 64
#: No source takes over this many times its own size.
MOST_TIMES = 3


def words(text: Column) -> Column:
    """The number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: int = 3, most: float = MOST_TIMES) -> DataFrame:
    """sources: one row each (source, source_size); adds weight, and target: the words the mix takes of it.

    Sources in order of code points, null last, weigh 1 to cycle, repeating. They share the
    sum of all sizes by weight; a target stops at most times its source's size and the excess is
    shared again by weight. Equivalently target = min(weight * level, most * size) with the one
    level at which the targets add up to the sum, found by running sums over sources sorted by
    the level at which each stops, in ranges, so sources may be as many as hosts are. Sources without words get 0.
    """
    total = sources.agg(F.sum("source_size").cast("double").alias("total"))  # one row
    ranked = (
        summed_before(sources, [F.col("source").isNull(), F.col("source").cast("binary")], {"rank": F.lit(1)})
        .withColumn("rank", F.col("rank").cast("long") + 1)
        .withColumn("weight", ((F.col("rank") - 1) % cycle + 1).cast("double"))
        .withColumn("most", most * F.col("source_size").cast("double"))
        .withColumn("stop", F.col("most") / F.col("weight"))
    )
    weights = ranked.agg(F.sum("weight").alias("weights"))  # one row
    summed = summed_before(ranked, [F.col("stop"), F.col("rank")], {"taken": F.col("most"), "used": F.col("weight")})
    levels = summed.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(weights)).withColumn("level", F.try_divide(F.col("total") - F.col("taken"), F.col("weights") - F.col("used")))
    # the first source, in order of stop, that does not reach its stop fixes the level
    fixed = levels.agg(F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).alias("fixed"))
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("fixed.level"), F.col("most")))
    return ranked.crossJoin(F.broadcast(fixed)).select("source", "source_size", "rank", "weight", target.alias("target"))


def summed_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row, under each name of sums, the sum of its column over the rows before it in a total order.

    Rows are dealt into ranges of the order; the ranges' sums, one row each, give every range its start, so no task holds more than a range.
    """
    named = {f"at{i}": c for i, c in enumerate(order)} | {f"of_{k}": c for k, c in sums.items()}
    keys = [f"at{i}" for i in range(len(order))]
    ranged = keep(rows.withColumns(named).repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("range").agg(*(F.sum(f"of_{k}").alias(f"sum_{k}") for k in sums)).select("range", *(F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"start_{k}") for k in sums))
    inside = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return keep(ranged.join(F.broadcast(starts), "range").withColumns({k: F.col(f"start_{k}") + F.coalesce(F.sum(f"of_{k}").over(inside), F.lit(0)) for k in sums}).drop("range", *named, *(f"start_{k}" for k in sums)))


def _pivotal(seed: int, last: bool):
    """Rounds the open chances of one node until at most one is left, keeping the sum of size * chance; at the last node none is."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what is left open in the end is then mostly a small one
        rows = rows.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        chance, size = rows["chance"].tolist(), rows["size"].tolist()
        # the stream follows from the rows, so a repeated task draws the same
        draws = np.random.default_rng([seed, int(rows["node"].iloc[0]), *(int(x) & (2**63 - 1) for x in rows["key"].iloc[[0, -1]])]).random(len(rows) + 1).tolist()
        held = -1
        for i in range(len(rows)):
            if held < 0:
                held = i
                continue
            # words move from one to the other until either chance is 0 or 1
            up = min((1 - chance[held]) * size[held], chance[i] * size[i])
            down = min(chance[held] * size[held], (1 - chance[i]) * size[i])
            move = up if draws[i] * (up + down) < down else -down
            chance[held] += move / size[held]
            chance[i] -= move / size[i]
            for j in (held, i):
                chance[j] = 0.0 if chance[j] < 1e-9 else 1.0 if chance[j] > 1 - 1e-9 else chance[j]
            held = next((j for j in (held, i) if 0 < chance[j] < 1), -1)
        if last and held >= 0:
            chance[held] = float(draws[-1] < chance[held])
        return rows.assign(chance=chance)

    return run


def mix(docs: DataFrame, seed: int = 0, cycle: int = 3, most: float = MOST_TIMES, leaf_rows: int = LEAF_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, copies, and the columns in carry.

    Each row is to be taken target / source_size times on average: the whole part always, and one
    more time with the rest as its chance. Pairs of open chances within a source move words from
    one to the other, at random and fair in the mean, until one of them is 0 or 1, so the words
    taken from a source differ from its target by less than its largest document. Leaves of the
    reduction tree hold about leaf_rows rows of a source, dealt by hash of doc_id, text and carry; each leaves at most one
    open chance, which meet 64 to a node, level by level. The last open chance of a source is drawn.
    Rows equal in all of these are counted first and are one row with a multiplicity in the tree.

    Rows without words, or with null text, are never taken. A null source is a source of its own.
    Repeated rows and ids count as rows. Empty tables give empty results. The same rows and seed
    give the same result. Other columns of docs are ignored.
    """
    text = F.col("text")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), F.xxhash64("doc_id", text, F.lit(seed), *carry).alias("key"), *carry
    )
    sized = keep(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("many")))
    sources = keep(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.sum(F.when(F.col("size") > 0, 1)).alias("rows")))
    wanted = targets(sources.select("source", "source_size"), cycle, most).withColumnsRenamed({"source": "named"}).join(sources.select("source", "rows"), F.col("named").eqNullSafe(F.col("source"))).drop("source")
    wanted = keep(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= 10_000 else wanted
    rate = F.when(F.col("size") > 0, F.col("target") / F.greatest("source_size", F.lit(1))).otherwise(0.0)
    rows = (
        sized.join(wanted, F.col("source").eqNullSafe(F.col("named"))).drop("source", "named", "weight")
        .withColumn("rate", rate).withColumn("whole", F.floor("rate"))
        # of equal rows as many as the sum of their chances allows are taken once more, and one is left open
        .withColumn("open", F.round(F.col("many") * (F.col("rate") - F.col("whole")), 9))
        .withColumns({"surely": F.floor("open"), "chance": F.col("open") - F.floor("open"), "leaves": F.ceil(F.col("rows") / leaf_rows)})
        .withColumn("node", F.pmod("key", F.greatest("leaves", F.lit(1))))
        .drop("rate", "rows", "open")
    )
    most_leaves = max(1, -(-(sources.agg(F.max("rows")).first()[0] or 0) // leaf_rows))
    closed, left = [rows.where("chance <= 0 or chance >= 1")], rows.where("chance > 0 and chance < 1")
    while True:
        step = keep(left.groupBy("rank", "node").applyInPandas(_pivotal(seed, most_leaves == 1), left.schema))
        closed.append(step.where("chance <= 0 or chance >= 1"))
        if most_leaves == 1:
            break
        left = step.where("chance > 0 and chance < 1").withColumn("node", F.floor(F.col("node") / FAN_IN))
        most_leaves = -(-most_leaves // FAN_IN)
    once_more = F.col("surely") + F.col("chance").cast("long")
    each = reduce(DataFrame.unionByName, closed).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
    copies = (F.col("whole") + (F.col("one") <= once_more).cast("long")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *carry)
