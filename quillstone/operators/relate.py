"""Access sets, enrichment and nesting: joins that never send keys through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(rows: DataFrame, access: DataFrame, key: str, requested=None) -> DataFrame:
    """Rows whose key is accessible; a requested key narrows them and never widens them."""
    held = rows.join(access.select(key), key, "left_semi")
    return held if requested is None else held.where(F.col(key) == requested)


def named(rows: DataFrame, dimension: DataFrame, key: str, id_column: str, name: str, alias: str) -> DataFrame:
    """rows with the dimension's name for one of its keys; a key without a match has none."""
    side = dimension.select(F.col(id_column).alias(f"_{alias}"), F.col(name).alias(alias))
    return rows.join(side, F.col(key) == F.col(f"_{alias}"), "left").drop(f"_{alias}")


def nested(children: DataFrame, parent_key: str, fields: Sequence[str], name: str) -> DataFrame:
    """One sorted array of structs for each parent."""
    return children.groupBy(parent_key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def superseded(rows: DataFrame, owner: str, *order: str) -> DataFrame:
    """Rows for which a later row of the same owner exists: one window instead of an inequality self-join."""
    last = Window.partitionBy(owner).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_place", F.row_number().over(last)).where("_place > 1").drop("_place")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
