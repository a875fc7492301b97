"""What the operators of this subpackage share: durable cuts of lineage and checks of input columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a temporary one of a local session's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='quillstone-work-')}")
    return _own[0]


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage: Spark then drops the shuffle files of finished jobs that nothing names any more."""
    gc.collect()
    spark._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes with the session's JVM at the latest."""
    path = f"{work_folder(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path


def cut(df: DataFrame, name: str, tidy: bool = False, apart: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later jobs restart from there if executors are lost.

    An operator whose steps shuffle much should hold the shuffle files of one step at a time (``tidy``). A job that has
    just ended is still named by events on their way, so what the step before has left is dropped before this one begins.

    ``apart``: for rows of many megabytes. Parquet's writer looks at the size of a row group after a hundred rows only, and
    its reader decodes a row group's rows together; so each row gets a row group, and a task holds one at a time.
    """
    spark, schema = df.sparkSession, df.schema
    if tidy:
        release(spark)
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", 1) if apart else out).parquet(path)
    del df
    back = spark.read.schema(schema).parquet(path)
    back.cut_path = path
    if tidy:
        release(spark)
    return back


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that nothing will read again; what was cut from them since stands by itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Frames:
    """What an operator cuts on its way to a result; it goes as soon as the result is written."""

    def __init__(self):
        self._held: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
        self._held.append(cut(df, name, tidy))
        return self._held[-1]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        drop(*self._held)
        self._held.clear()
        return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null read as empty), whatever other columns there are."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(doc_id: str = "doc_id"):
    """True for the third of documents that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
