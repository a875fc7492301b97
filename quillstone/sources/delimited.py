"""Quoted delimited files of any size, read by all cores.

Spark deals a file's lines out by byte ranges. A line break within quotes is no end of a record, and a range can't see
whether it begins within quotes. So each range counts its quotes first; whether an odd number of them lies before a range
says how it begins. Then each range parses the records that end in it, and hands on the line pieces at its ends, of which
those that belong to one record are put together.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import scratch, ship

#: Byte ranges whose states are sent to all tasks; of more, lines meet theirs by a shuffle.
BROADCAST_RANGES = 100_000

_ROW = "file string, begin long, place long, nth long, cells array<string>"
_PIECE = [("file", pa.string()), ("begin", pa.int64()), ("place", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("inside", pa.bool_())]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, begin (of the byte range) and line, in order within a range."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("begin"), F.col("value").alias("line"))


def _parse(text: str, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(1 << 30)
    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in row)]


def _pieces(runs: Iterator[tuple]) -> Iterator[tuple]:
    """What a range has of records that begin before or end after it: head (null: all of the range lies within a record),
    tail, and whether its last record goes on; ``place`` counts the lines that are ends of whole records."""
    key, head, held, place, inside = None, None, [], 0, False
    for own, inside_, lines, after in runs:
        if own != key:
            if key is not None:
                yield *key, place, head, "\n".join(held), inside
            key, head, held, place = own, None if inside_ else "", [], 0
        ends = np.flatnonzero(~after)
        inside = bool(after[-1])
        if not len(ends):
            held += lines
            continue
        if head is None:
            head, held = "\n".join([*held, *lines[: int(ends[0]) + 1]]), []
        place += len(ends)
        held = lines[int(ends[-1]) + 1 :]
    if key is not None:
        yield *key, place, head, "\n".join(held), inside


def _whole(runs: Iterator[tuple], delimiter: str) -> Iterator[tuple]:
    """Records that begin and end in a range, by the line end, counted in the range, at which each stretch of them begins."""
    key, headless, held, place = None, False, [], 0
    for own, inside, lines, after in runs:
        if own != key:
            key, headless, held, place = own, inside, [], 0
        ends = np.flatnonzero(~after)
        if not len(ends):
            held += lines
            continue
        first, last = 0, int(ends[-1]) + 1
        if headless:
            first, headless, held = int(ends[0]) + 1, False, []
        rows = _parse("\n".join([*held, *lines[first:last]]) + "\n", delimiter)
        held = lines[last:]
        yield *own, place, rows
        place += len(ends)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, begin), whether the range begins within quotes, lines, and whether each line ends within quotes."""
    key, inside = None, False
    for batch in batches:
        files, begins = batch.column("file").to_pylist(), batch.column("begin").to_pylist()
        edges = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or begins[i] != begins[i - 1]), len(files)]
        quotes = pc.count_substring(batch.column("line"), '"').to_numpy() % 2
        lines, starts = batch.column("line").to_pylist(), batch.column("inside").to_pylist()
        for a, z in zip(edges, edges[1:]):
            if a < z:
                own = files[a], begins[a]
                if own != key:
                    key, inside = own, starts[a]
                after = (np.cumsum(quotes[a:z]) + inside) % 2 == 1
                yield own, starts[a], lines[a:z], after
                inside = bool(after[-1])


def _rows_of(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, begin, place, rows in _whole(_runs(batches), delimiter):
            n = len(rows)
            columns = [file] * n, pa.array([begin] * n, pa.int64()), pa.array([place] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "begin", "place", "nth", "cells"), columns)))

    return run


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _pieces(_runs(batches)):
        yield pa.RecordBatch.from_pydict({n: pa.array([v], t) for (n, t), v in zip(_PIECE, found)})


def _joined(delimiter: str):
    """The records of a file that several ranges have pieces of, by the range they begin in; pieces come in order."""

    def run(table: pa.Table) -> pa.Table:
        out, pieces, start = [], [], None
        put = lambda: out.extend((rows[0]["file"], *start, n, cells) for n, cells in enumerate(_parse("\n".join(pieces) + "\n", delimiter)))
        rows = sorted(table.to_pylist(), key=lambda r: r["begin"])
        for r in rows:
            if pieces and r["head"] is None:
                pieces.append(r["tail"])
                continue
            if pieces:
                pieces.append(r["head"])
                put()
                pieces = []
            if r["inside"]:
                pieces, start = [r["tail"]], (r["begin"], r["place"])
        if pieces:
            put()
        columns = zip(*out) if out else [[]] * 5
        kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())
        return pa.table({n: pa.array(x, t) for n, t, x in zip(("file", "begin", "place", "nth", "cells"), kinds, columns)})

    return run


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """file, begin, place, nth and cells of the records of quoted delimited files; blank ones go.

    begin, place and nth order a file's records. Quotes are doubled within quotes, and a record may span lines, and byte
    ranges, of any number. Text is UTF-8; a mark at the beginning of a file is no part of its first cell. The files are
    read three times, and parsed once: for the quotes, for the pieces of records at the ends of ranges, and for the rest.
    """
    ship(spark)
    lines = _lines(spark, path)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    # One row a range meets in a file's window.
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "begin").agg((F.sum(quotes) % 2).alias("odd"))
    at = scratch(spark, "ranges")
    ranges.select("file", "begin", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")).write.parquet(at)
    held = spark.read.parquet(at).withColumnsRenamed({"file": "_file", "begin": "_begin"})
    same = (F.col("file") == F.col("_file")) & (F.col("begin") == F.col("_begin"))
    marked = lines.withColumn("line", F.when(F.col("begin") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    if held.count() <= BROADCAST_RANGES:
        marked = marked.join(F.broadcast(held), same)
    else:
        marked = marked.withColumn("_at", F.monotonically_increasing_id()).join(held, same).repartition("file", "begin").sortWithinPartitions("file", "begin", "_at")
    marked = marked.select("file", "begin", "line", "inside")
    whole = marked.mapInArrow(_rows_of(delimiter), _ROW)
    pieces = marked.mapInArrow(_pieces_of, ", ".join(f"{n} {'string' if t == pa.string() else 'long' if t == pa.int64() else 'boolean'}" for n, t in _PIECE))
    return whole.unionByName(pieces.groupBy("file").applyInArrow(_joined(delimiter), _ROW))
