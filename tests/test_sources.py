"""Sources and sinks of Spark's own, table functions of SQL, and contracts of whole reads."""

import csv
import json
import time

import pytest
from conftest import DATA
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillstone.operators import reads
from quillstone.operators.tablefunctions import register_access, register_functions
from quillstone.sources import datasource, readers

ROWS = [["Lot", "Said"], ["1", 'say "a,b"\nthere'], ["2", ""], ["", " "], ["3", "x"]]


def put(folder, name, rows):
    with open(folder / name, "w", newline="") as f:
        csv.writer(f).writerows(rows)


def test_delimited_source(spark, tmp_path):
    datasource.register(spark)
    for k in range(4):
        put(tmp_path, f"f{k}.csv", [*ROWS, [str(k), "own"]])
    load = lambda: spark.read.format("quillstone_delimited").load(str(tmp_path))
    found = {}
    for r in load().orderBy("row").collect():
        found.setdefault(r.file, []).append(r.cells)
    kept = [r for r in ROWS if any(c.strip() for c in r)]
    assert found == {f"f{k}.csv": [*kept, [str(k), "own"]] for k in range(4)}
    bodies = spark.read.text(str(tmp_path), wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), readers.cells(F.col("value"), F.lit(",")).alias("rows"))
    assert {r.file: r.rows for r in bodies.collect()} == found
    one = load().where("file = 'f2.csv' AND row > 0")
    assert one.rdd.getNumPartitions() == 1 and {r.file for r in one.collect()} == {"f2.csv"}
    assert load().where(F.col("file").isin("f1.csv", "f3.csv")).rdd.getNumPartitions() == 2 and load().where("file = 'none'").count() == 0


def test_delimited_stream(spark, tmp_path):
    """Files that come later are read once, from the offset on."""
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    run = lambda: spark.readStream.format("quillstone_delimited").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(once=True).start().awaitTermination()
    for k in range(3):
        put(tmp_path / "in", f"f{k}.csv", [[str(k), "x"]] * (k + 1))
        time.sleep(0.02)
        if k != 1:
            run()
    assert sorted(r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["f0.csv", "f1.csv", "f1.csv", "f2.csv", "f2.csv", "f2.csv"]


def test_outbox(spark, tmp_path):
    """One envelope a key though batches come twice; what was delivered is listed, and no draft is left."""
    datasource.register(spark)
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type").where("event_id < 60")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    events.where("event_id < 20").write.mode("append").parquet(str(tmp_path / "in"))
    send = lambda mark: spark.readStream.schema("event_id long, event_type string").parquet(str(tmp_path / "in")).writeStream.format("quillstone_outbox").option("key", "event_id").option("checkpointLocation", str(tmp_path / mark)).trigger(availableNow=True).start(str(tmp_path / "box")).awaitTermination()
    send("one")
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "box" / "sent").iterdir()}
    send("two")
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "box" / "sent").iterdir()} == first
    assert sorted(json.loads((tmp_path / "box" / "sent" / n).read_text())["event_id"] for n in first) == sorted(r.event_id for r in events.collect())
    delivered = (tmp_path / "box" / "delivered-0").read_text().split("\n")
    assert set(delivered) == set(first) and len(delivered) == events.count() + events.where("event_id < 20").count()
    assert not list((tmp_path / "box" / "drafts").iterdir())


def test_outbox_after_a_failed_task(tmp_path):
    """A task that fails after drafts of its own leaves no envelope; what its next attempt drafts is sent once."""
    from types import SimpleNamespace

    writer = datasource.OutboxWriter({"path": str(tmp_path), "key": "k"})
    row = lambda k: SimpleNamespace(asDict=lambda recursive: {"k": k})
    attempts = iter(range(100))

    def task(rows):
        datasource_task = SimpleNamespace(stageId=lambda: 1, taskAttemptId=lambda n=next(attempts): n)
        import pyspark

        held, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(lambda: datasource_task)
        try:
            return writer.write(iter(rows))
        finally:
            pyspark.TaskContext.get = held

    def failing():
        yield row(1)
        raise OSError("lost")

    with pytest.raises(OSError):
        task(failing())
    writer.commit([task([row(1), row(2)]), None], 0)
    assert len(list((tmp_path / "sent").iterdir())) == 2 and not list((tmp_path / "drafts").iterdir())
    task([row(3)])
    writer.abort([None], 1)
    assert len(list((tmp_path / "sent").iterdir())) == 2 and not list((tmp_path / "drafts").iterdir())


def test_access_by_sql(spark, capsys):
    allowed = spark.createDataFrame([(1, 10, "view"), (1, 11, "edit"), (2, 10, "view")], "who long, project long, level string")
    register_access(spark, "projects_of", allowed, "who", "project")
    people = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    found = spark.sql("SELECT p, project FROM {people} LEFT JOIN LATERAL projects_of(p, 'view') ON true", people=people)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 10), (2, 10), (3, None)]
    found.explain()
    plan = capsys.readouterr().out
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_functions_of_sql(spark):
    register_functions(spark)
    files = spark.createDataFrame([(1, "title,,\nLot,Price,Estate\n1,$5,A\n2,POA\n", ","), (2, "no header", ","), (3, None, None), (4, "Status;Lot\nSold;9\n", ";")], "file int, body string, mark string")
    found = spark.sql("SELECT * FROM delimited_rows(TABLE({files}), 'lot_number,price')", files=files).collect()
    assert sorted(map(tuple, found)) == [(1, 2, "1", "$5"), (1, 3, "2", "POA"), (4, 1, "9", None)]
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM delimited_rows(TABLE({files}), mark)", files=files).collect()


def test_files_are_read_where_they_are(spark, capsys):
    register_functions(spark)
    files = spark.range(50).selectExpr("id AS file", "'Lot,Price' AS body", "',' AS mark")
    spark.sql("SELECT * FROM delimited_rows(TABLE({files}), 'lot_number')", files=files).explain()
    plan = capsys.readouterr().out
    assert "UDTF" in plan and "Exchange" not in plan and "Sort" not in plan


def test_whole_reads(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    n = events.count()
    assert reads.whole(events, n, lambda df: df.groupBy("event_type").count().collect())
    with pytest.raises(reads.ShortRead):
        reads.whole(events.where("event_id > 3"), n, lambda df: df.write.parquet(str(tmp_path / "short")))
    pages = spark.createDataFrame([("a", 0, [1, 2], 3), ("a", 1, [3], 3), ("b", 0, [4], 1)], "source string, page int, rows array<int>, stated int")
    rows = lambda df: sorted(r.row for r in reads.paged_rows(df, "source", "page", "rows", "stated").collect())
    assert rows(pages) == [1, 2, 3, 4] and rows(pages.where("source = 'b'")) == [4]
    for broken in (pages.where("page = 0"), pages.withColumn("stated", F.when(F.col("page") == 0, 3).otherwise(4)), pages.withColumn("stated", F.lit(None).cast("int"))):
        with pytest.raises(PySparkException, match="short read"):
            rows(broken)
