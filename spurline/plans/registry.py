"""Every query of the grid and evidence engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spurline.plans import fields, grids, land, shapes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**grids.QUERIES, **fields.QUERIES, **land.QUERIES, **shapes.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**grids.SQL, **fields.SQL, **land.SQL, **shapes.SQL}
