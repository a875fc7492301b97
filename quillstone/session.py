"""Session settings, and the shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, adaptive execution, bounded Arrow batches."""
    builder = SparkSession.builder.master(master).appName("quillstone")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_quillstone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quillstone-")
    name = os.path.join(folder, f"quillstone-{context.applicationId}.zip")
    with zipfile.ZipFile(name, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(name)
    context._quillstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_quillstone_folder", None):
        context._quillstone_folder = f"file://{tempfile.mkdtemp(prefix='quillstone-work-')}"
    return context._quillstone_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes with the session's JVM."""
    path = f"{shared_folder(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path
