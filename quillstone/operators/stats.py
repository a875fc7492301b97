"""Tallies: counts by key, conditional counts, means and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import rounded2


def tally(df: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """For each value of key the number of rows, and of those that meet each named condition; null meets none."""
    return df.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def tallies(df: DataFrame, *keys: str) -> DataFrame:
    """Independent tallies of several keys, and the grand total, in one pass: each key's rows have the others null."""
    sets = [[F.col(k)] for k in keys] + [[]]
    return df.groupingSets(sets, *map(F.col, keys)).agg(F.count("*").alias("total"), F.grouping_id().cast("long").alias("which"))


def mean_cents(amount: Column) -> Column:
    """The mean of an amount from its exact whole cents, rounded to two decimals; 0 over no rows."""
    cents = F.round(amount * 100).cast("long")
    return F.coalesce(rounded2(F.sum(cents) / F.count(cents) / 100), F.lit(0.0))


def one_row(sources: Sequence[tuple[DataFrame, Mapping[str, Column | None]]]) -> DataFrame:
    """Named counts of several frames in one row, each frame read once: of all its rows (None), or of those that meet a condition."""

    def counted(df: DataFrame, named: Mapping[str, Column | None]) -> DataFrame:
        each = df.agg(*((F.count("*") if c is None else F.count_if(F.coalesce(c, F.lit(False)))).alias(n) for n, c in named.items()))
        return each.select(F.inline(F.array(*(F.struct(F.lit(n).alias("tag"), F.col(n).alias("n")) for n in named))))

    every = reduce(DataFrame.unionByName, [counted(*s) for s in sources])
    return every.agg(*(F.coalesce(F.sum(F.when(F.col("tag") == n, F.col("n"))), F.lit(0)).alias(n) for _, named in sources for n in named))


def fold_status(groups: DataFrame, facts: DataFrame, key: str, failed: Column, passed: Column, absent: str = "not_performed") -> DataFrame:
    """any failed -> failed, all passed -> passed, else pending, for each group; a group without facts is ``absent``."""
    held = facts.groupBy(key).agg(F.bool_or(failed).alias("_failed"), F.bool_and(passed).alias("_passed"))
    status = F.when(F.col("_failed").isNull(), absent).when(F.col("_failed"), "failed").when(F.col("_passed"), "passed").otherwise("pending")
    return groups.select(key).join(held, key, "left").select(key, status.alias("status"))


def readiness(items: DataFrame, upload: str, staged: Column, patched: Column, source: Column) -> DataFrame:
    """For each upload how many rows wait (staged ones, and those that wait for their patch only), how many staged ones still
    wait for source work, and whether it can be published: none does. An upload whose rows all matched has patches alone."""
    held = tally(items.where(staged | patched), upload, outstanding=staged & source).withColumnRenamed("total", "staged")
    return held.select(upload, "staged", "outstanding", (F.col("outstanding") == 0).alias("ready"))
