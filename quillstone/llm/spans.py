"""Regular-expression matches with code-point offsets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.exprs import let

_BLOCK = 64
EMPTY = "array<struct<start:int,end:int,value:string>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Exclusive prefix sums of an integer array that isn't empty, in blocks so that long arrays stay cheap."""
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(x, b * _BLOCK + 1, _BLOCK)))
    before = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: F.when(b == 0, F.lit(0)).otherwise(_sum(F.slice(s, 1, b))))

    def places(x: Column, base: Column) -> Column:
        def at(i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            within = i - b * _BLOCK
            return base[b] + F.when(within == 0, F.lit(0)).otherwise(_sum(F.slice(x, b * _BLOCK + 1, within)))

        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), at)

    return let(lengths, lambda x: let(let(blocks(x), before), lambda base: places(x, base)))


def find(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches; offsets are code points, end exclusive.

    The pieces between the matches give their places. Rows that fail the guard, and null texts, have no matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.coalesce(found if guard is None else F.when(guard, found), F.array().cast("array<string>"))

    def placed(m: Column) -> Column:
        size = lambda xs: running(F.transform(xs, lambda x: F.length(x)))
        return let(
            size(F.split(text, pattern, -1)),
            lambda before: let(
                size(m),
                lambda own: F.transform(
                    m,
                    lambda x, i: F.struct(
                        (before[i + 1] + own[i]).alias("start"),
                        (before[i + 1] + own[i] + F.length(x)).alias("end"),
                        x.alias("value"),
                    ),
                ),
            ),
        )

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(EMPTY)))
