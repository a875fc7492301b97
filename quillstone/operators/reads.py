"""Filtered, searched, sorted and paged reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import search_pattern

_OPS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def compose(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """The conjunction of stored filters: dicts of column, op and value."""
    predicates = [_OPS[f["op"]](F.col(f["column"]), f.get("value")) for f in filters]
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each given column; None asks nothing, so no predicate reaches the plan."""
    return compose(df, [{"column": c, "op": "eq", "value": v} for c, v in wanted.items() if v is not None])


def search_any(df: DataFrame, term: str, columns: Sequence[str], underscore_is_wildcard: bool = False) -> DataFrame:
    """Rows in which any of the columns contains the term, whatever its case."""
    pattern = search_pattern(term, underscore_is_wildcard)
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns]))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 25, most: int = 100, least: int = 10) -> DataFrame:
    """One page of a totally ordered read with total and total_pages beside every row.

    The size is clamped, pages begin at 1, and the total is a one-row aggregate beside the page, not a window over all
    rows.
    """
    size, number = max(least, min(most, size)), max(1, number)
    total = df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def keyset(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows by key after a seen one."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def visible(df: DataFrame, layout: Sequence[tuple[str, bool]]) -> DataFrame:
    """The visible columns of a stored layout in its order; all columns where it shows none that exist."""
    shown = [c for c, on in layout if on and c in df.columns]
    return df.select(*(shown or df.columns))


def clamp_limit(n: int | None, default: int = 100, most: int = 200) -> int:
    """A requested limit within 1 and ``most``."""
    return min(max(default if n is None else n, 1), most)


def vocabulary_rank(column: Column, vocabulary: Sequence[str]) -> Column:
    """The place of a value in an ordered vocabulary, from 1; 0 for values it doesn't name."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, vocabulary)), column), F.lit(0)).cast("long")


class ShortRead(RuntimeError):
    """A read came back with other than the rows it was to have."""


def whole(df: DataFrame, expected: int, action):
    """action(df), of which every row is counted on its way: ShortRead if they aren't ``expected``. There is no second pass."""
    seen = Observation()
    result = action(df.observe(seen, F.count(F.lit(1)).alias("n")))
    if seen.get["n"] != expected:
        raise ShortRead(f"{seen.get['n']} rows instead of {expected}")
    return result


def paged_rows(pages: DataFrame, source: str, page: str, rows: str, stated: str) -> DataFrame:
    """source, page and row of all pages (an array of rows each), whose sources state how many rows they have in all.

    The job that reads them fails where a source's pages are short of what it states, or don't agree on it, so no part of
    a source passes for the whole.
    """
    over = Window.partitionBy(source)
    found = F.sum(F.size(rows)).over(over)
    held = pages.withColumns({"_found": found, "_least": F.min(stated).over(over), "_most": F.max(stated).over(over)})
    short = F.concat(F.lit("short read of "), F.col(source).cast("string"), F.lit(": "), F.col("_found").cast("string"), F.lit(" rows instead of "), F.coalesce(F.col("_most").cast("string"), F.lit("?")))
    whole_ = F.assert_true(F.coalesce((F.col("_found") == F.col("_least")) & (F.col("_found") == F.col("_most")), F.lit(False)), short)
    return held.select(source, page, F.explode(F.when(whole_.isNull(), F.col(rows))).alias("row"))
