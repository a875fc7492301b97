"""Operators as table functions of SQL: access sets to join laterally, delimited files by their headings, and ordered folds."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quillstone.functions.headers import aliases, key_of
from quillstone.session import ship


def register_access(spark: SparkSession, name: str, allowed: DataFrame, subject: str, target: str, level: str = "level") -> None:
    """name(who, wanted): the targets that ``allowed`` (subject, target, level) grants somebody at a level.

    Columns of these names don't hide the parameters. The function has the operator's own plan as its body, so a lateral call of it becomes a join with that plan.
    """
    kinds = dict(allowed.dtypes)
    allowed.select(subject, target, level).createOrReplaceTempView(f"{name}_granted")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(who {kinds[subject]}, wanted STRING) RETURNS TABLE ({target} {kinds[target]}) "
        f"RETURN SELECT g.{target} FROM {name}_granted AS g WHERE g.{subject} = {name}.who AND g.{level} = {name}.wanted"
    )


class DelimitedRows:
    """delimited_rows(TABLE (file, body, mark), fields): a row below each file's header, with a column for each field named.

    The columns are those of the call: ``fields`` is a comma-joined list of known fields, and each is taken from the first
    heading that names it. A file without a header has no rows. Each row of the table is a whole file, so files are read
    where they are, many by one instance.
    """

    @staticmethod
    def analyze(files: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or fields.value is None:
            raise ValueError("delimited_rows takes a table and a constant list of fields")
        shape = StructType().add("file", files.dataType["file"].dataType).add("row", LongType())
        for name in fields.value.split(","):
            shape = shape.add(name.strip(), StringType())
        return AnalyzeResult(schema=shape)

    def __init__(self):
        self.known = aliases()

    def eval(self, row, fields):
        grid = [r for r in csv.reader(io.StringIO((row["body"] or "").removeprefix("﻿"), newline=""), delimiter=row["mark"] or ",") if any(c.strip() for c in r)]
        named = [[self.known.get(key_of(c)) for c in r] for r in grid[:15]]
        score = [len({f for f in r if f}) for r in named]
        if not score or max(score) < 2:
            return
        at = score.index(max(score))
        places = [named[at].index(f.strip()) if f.strip() in named[at] else None for f in fields.split(",")]
        for n, r in enumerate(grid[at + 1 :], at + 1):
            yield (row["file"], n, *(r[p] if p is not None and p < len(r) else None for p in places))


class RateLimited:
    """rate_limited(TABLE (key, at, tie), most, seconds): the window anchored at a key's first event, in order of at and tie."""

    @staticmethod
    def analyze(events: AnalyzeArgument, most: AnalyzeArgument, seconds: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in events.dataType}
        shape = StructType().add("key", kinds["key"]).add("tie", kinds["tie"]).add("allowed", BooleanType()).add("count", LongType())
        return AnalyzeResult(schema=shape, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("at"), OrderingColumn("tie")])

    def __init__(self):
        self.began, self.count = None, 0

    def eval(self, row, most, seconds):
        if self.began is None or row["at"] - self.began >= float(seconds):
            self.began, self.count = row["at"], 0
        self.count += 1
        yield row["key"], row["tie"], self.count <= most, self.count


def register_functions(spark: SparkSession) -> None:
    """Make delimited_rows and rate_limited callable from the session's SQL."""
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("delimited_rows", udtf(DelimitedRows))
    spark.udtf.register("rate_limited", udtf(RateLimited))
