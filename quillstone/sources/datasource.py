"""Files of delimited rows as a source of Spark's own, batch and stream, and an outbox folder as a sink.

Both read and write with Python's files, so their folder must be one that the executors see, such as a mounted share; for
other stores there are ``delimited.read_delimited`` and Spark's writers.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quillstone.session import ship

_SHAPE = "file string, row long, cells array<string>"


def _folder(options) -> str:
    return options["path"].removeprefix("file://")


def _rows(folder: str, name: str, delimiter: str) -> Iterator[tuple]:
    with open(f"{folder}/{name}", newline="", encoding="utf-8-sig") as held:
        csv.field_size_limit(1 << 30)
        kept = (row for row in csv.reader(held, delimiter=delimiter) if any(c.strip() for c in row))
        yield from ((name, n, row) for n, row in enumerate(kept))


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class DelimitedReader(DataSourceReader):
    """A partition for each file; filters on ``file`` leave out the files they exclude."""

    def __init__(self, options):
        self.folder, self.delimiter = _folder(options), options.get("delimiter", ",")
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if not n.startswith((".", "_")))
        # A source without partitions isn't one, so a read of no files has one that gives no rows.
        return [_File(n) for n in names if self.only is None or n in self.only] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(self.folder, partition.name, self.delimiter) if partition.name else iter(())


class DelimitedStream(DataSourceStreamReader):
    """New files in order of their time and name; an offset is the last file that was read. Files must come whole."""

    def __init__(self, options):
        self.folder, self.delimiter = _folder(options), options.get("delimiter", ",")

    def _files(self) -> list[list]:
        names = [n for n in os.listdir(self.folder) if not n.startswith((".", "_"))]
        return sorted([os.stat(f"{self.folder}/{n}").st_mtime_ns, n] for n in names)

    def initialOffset(self) -> dict:
        return {"last": [0, ""]}

    def latestOffset(self) -> dict:
        return {"last": max(self._files(), default=[0, ""])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f[1]) for f in self._files() if start["last"] < f <= end["last"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(self.folder, partition.name, self.delimiter)

    def commit(self, end: dict) -> None:
        pass


class Delimited(DataSource):
    """spark.read.format("quillstone_delimited").option("delimiter", ";").load(folder): file, row and cells."""

    @classmethod
    def name(cls) -> str:
        return "quillstone_delimited"

    def schema(self) -> str:
        return _SHAPE

    def reader(self, schema) -> DataSourceReader:
        return DelimitedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DelimitedStream(self.options)


class _Delivered(WriterCommitMessage):
    def __init__(self, keys: list[str], drafts: list[str]):
        self.keys, self.drafts = keys, drafts


class OutboxWriter(DataSourceStreamWriter):
    """An envelope for each row, named by its idempotence key, in a folder.

    Tasks write drafts of their own; the driver gives them their names once all tasks of the batch are done, and lists
    what was delivered from the commit messages. A task that fails and runs again leaves drafts that are removed, and a
    batch that runs again finds its envelopes there, so none comes twice.
    """

    def __init__(self, options):
        self.folder, self.key = _folder(options), options["key"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(f"{self.folder}/drafts", exist_ok=True)
        keys, drafts = [], []
        for n, row in enumerate(rows):
            body = row.asDict(recursive=True)
            key = hashlib.sha256(str(body[self.key]).encode()).hexdigest()
            draft = f"{task.stageId()}-{task.taskAttemptId()}-{n}"
            with open(f"{self.folder}/drafts/{draft}", "w", encoding="utf-8") as out:
                json.dump(body, out, default=str)
            keys.append(key)
            drafts.append(draft)
        return _Delivered(keys, drafts)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        os.makedirs(f"{self.folder}/sent", exist_ok=True)
        keys = []
        for message in messages:
            for key, draft in zip(message.keys, message.drafts) if message else ():
                if not os.path.exists(f"{self.folder}/sent/{key}"):
                    os.replace(f"{self.folder}/drafts/{draft}", f"{self.folder}/sent/{key}")
                keys.append(key)
        self._clear()
        with open(f"{self.folder}/.delivered-{batchId}", "w", encoding="utf-8") as out:
            out.write("\n".join(keys))
        os.replace(f"{self.folder}/.delivered-{batchId}", f"{self.folder}/delivered-{batchId}")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(f"{self.folder}/drafts") if os.path.isdir(f"{self.folder}/drafts") else ():
            os.remove(f"{self.folder}/drafts/{name}")


class Outbox(DataSource):
    """events.writeStream.format("quillstone_outbox").option("key", "event_id").start(folder)"""

    @classmethod
    def name(cls) -> str:
        return "quillstone_outbox"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return OutboxWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and filters reach the source."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Delimited)
    spark.dataSource.register(Outbox)
