"""Connected components of links, by rounds of joins and grouped aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spurline.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). One row for each id in them: id, component (the smallest id reachable).

    Each round an id takes the least label among its own and its neighbours', and then the label of the id which that names, until no label
    changes: the rounds grow with the logarithm of the longest chain. Each round is a table in the checkpoint folder, dropped after the next; only whether
    anything changed comes to the driver. An id linked with many is a grouped minimum with partial results and joins on plain rows, which adaptive execution splits.
    """
    both = written(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*").distinct())
    state = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("changed")))
    while state.agg(F.max("changed")).first()[0]:
        near = both.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        low = state.select("id", F.col("label").alias("before")).join(near, "id").select("id", "before", F.least("before", "m").alias("at"))
        named = state.select(F.col("id").alias("at"), F.col("label").alias("jump"))
        last, state = state, written(low.join(named, "at").select("id", F.least("at", "jump").alias("label"), (F.least("at", "jump") < F.col("before")).alias("changed")))
        drop_written(last)
    drop_written(both)
    return state.select("id", F.col("label").alias("component"))


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known: the result of components(); links: further ones, in which new ids may occur. The components of both."""
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = written(known.unionByName(ids.join(known, "id", "left_anti").withColumn("component", F.col("id"))))
    at = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_"))
    across = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    return written(known.join(across.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
