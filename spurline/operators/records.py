"""Field logs: one version of record into the next, ids, imports from others, schemas that grow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanded(v1: DataFrame) -> DataFrame:
    """v1: id, start, end, times. Each row as a deployment, a check if it has an end, and an event for each time: adds kind, day and record."""
    of = lambda kind, day: F.struct(F.lit(kind).alias("kind"), day.alias("day"))
    check = F.when(F.col("end").isNotNull(), F.array(of("check", F.col("end")))).otherwise(F.array().cast("array<struct<kind:string,day:string>>"))
    made = F.concat(F.array(of("deployment", F.col("start"))), check, F.transform(F.coalesce("times", F.array().cast("array<string>")), lambda t: of("event", t)))
    return v1.select("id", F.posexplode(made).alias("record", "r")).select("id", "record", "r.kind", "r.day")


def versioned(rows: DataFrame, version: str, newest: int) -> DataFrame:
    """rows, or an error where a record is of a version that isn't known."""
    return rows.withColumn(version, F.when(F.col(version) <= newest, F.col(version)).otherwise(F.raise_error(F.concat(F.lit("unknown version "), F.col(version).cast("string")))))


def named(rows: DataFrame, base: str, order: str, taken: DataFrame) -> DataFrame:
    """Adds id: the first of base, base#2, base#3, ... that is neither taken (id, those in use) nor given to a row before it in order.

    As many numbers as there are new rows and ids of the base in use are tried, so enough of them are free; those in use are struck out by a join.
    """
    id_of = F.when(F.col("number") == 1, F.col(base)).otherwise(F.concat(base, F.lit("#"), F.col("number").cast("string")))
    stems = taken.select(F.explode(F.array_distinct(F.array("id", F.regexp_replace("id", r"#\d+$", "")))).alias(base)).groupBy(base).agg(F.count(F.lit(1)).alias("used"))
    asked = rows.groupBy(base).agg(F.count(F.lit(1)).alias("new")).join(stems, base, "left").select(base, F.explode(F.sequence(F.lit(1), (F.col("new") + F.coalesce("used", F.lit(0))).cast("int"))).alias("number"))
    free = asked.withColumn("id", id_of).join(taken.select("id").distinct(), "id", "left_anti")
    free = free.withColumn("place", F.row_number().over(Window.partitionBy(base).orderBy("number"))).select(base, "place", "id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(base).orderBy(order))).join(free, [base, "place"]).drop("place")


def imported(rows: DataFrame, sender: str, ids: Sequence[str]) -> DataFrame:
    """Another's records: their ids below the sender's name, and the sender."""
    return rows.withColumns({c: F.concat_ws("/", F.lit(sender), F.col(c)) for c in ids}).withColumn("sender", F.lit(sender))


def replaced(log: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """log with all rows whose key has the value replaced by rows."""
    return log.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(rows, allowMissingColumns=True)


def own(log: DataFrame, sender: str = "sender") -> DataFrame:
    """The rows that come from nobody else."""
    return log.where(F.col(sender).isNull())


def evolved(state: DataFrame, neutral: dict[str, Column]) -> DataFrame:
    """Fills layers that a state of an older version lacks with neutral values, and names them in unmodeled."""
    missing = [c for c in neutral if c not in state.columns]
    filled = reduce(lambda df, c: df.withColumn(c, neutral[c]), missing, state)
    return filled.withColumn("unmodeled", F.array(*map(F.lit, missing)).cast("array<string>"))


def combined_roads(mapped: DataFrame, forest: DataFrame, inside: str) -> DataFrame:
    """The roads open to vehicles: mapped ones (id, drivable: yes, maybe or null, inside: in a national forest) that are, maybe ones outside the forest, where
    its own map (id, open) doesn't decide, and the open ones of that; source names where each comes from."""
    sure = mapped.where((F.col("drivable") == "yes") | ((F.col("drivable") == "maybe") & ~F.col(inside)))
    return sure.select("id", F.lit("mapped").alias("source")).unionByName(forest.where("open").select("id", F.lit("forest").alias("source")))


def first_kind(df: DataFrame, kinds: Sequence[Column]) -> Column:
    """The number, from 1, of the first condition that holds; 0 without one."""
    out = F.lit(0)
    for i, k in reversed(list(enumerate(kinds, 1))):
        out = F.when(k, i).otherwise(out)
    return out
