"""Rows as quoted delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """A cell, quoted with its quotes doubled where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(df: DataFrame) -> Column:
    """One line of all columns of df."""
    return F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns])


def csv_matrix(cells: Column) -> Column:
    """The text of an array of rows of cells, as readers.cells reads it back."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(F.transform(row, csv_cell), ",")), "\r\n")


def write_csv(df: DataFrame, path: str) -> None:
    """df as one folder of delimited files, a header in each, written by all tasks at once."""
    df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
