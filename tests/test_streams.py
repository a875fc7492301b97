"""Streams, versioned tables, delay queues and leases."""

import datetime
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillstone.operators import leases
from quillstone.sources.versioned import VersionedTable
from quillstone.streaming import events, folds, stateful

START = datetime.datetime(2024, 5, 1)
EVENT = "event_id long, received_at timestamp, connection long, event_type string, item long, status string, attempts int, fails int"


def test_stream_equals_batch(spark, tmp_path):
    """Deduplication and versioned state over a stream of files give what a batch gives."""
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id")
    folder = str(tmp_path / "in")
    batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(folder)

    query = events.deduplicated(events.source(spark, folder, 10), "user_id", "100 days").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT count(*) FROM seen").first()[0] == batch.select("user_id").distinct().count()

    rows = events.source(spark, folder, 1).select("user_id", "event_id", "event_type", "value")
    latest = {r.user_id: r.m for r in batch.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    for mark in ("first", "again"):  # a new checkpoint reads all events once more, and leaves the state as it is
        events.apply_into(rows, str(tmp_path / "state"), str(tmp_path / mark), ["user_id"], "event_id").awaitTermination()
        held = VersionedTable(spark, str(tmp_path / "state"), rows.schema.toDDL(), ["user_id"], "event_id")
        assert {r.user_id: r.event_id for r in held.snapshot().collect()} == latest
    assert len(held.manifest()["streams"]) == 2


def inbound(spark, folder, n=200):
    """Events of which some are refused and some fail once or more, and the queue that takes them."""
    rows = [(k, START + datetime.timedelta(seconds=k), k % 4, ("view", "odd")[k % 11 == 0], None if k % 7 == 0 else k % 5, ("selected", "bad")[k % 13 == 0], 0, k % 8 if k % 2 else 0) for k in range(1, n)]
    links = spark.createDataFrame([(0, "active", 1), (1, "active", 1), (2, "revoked", 1)], "connection long, state string, org int")
    owned = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 1)], "item long, org int")
    return rows, events.InboundQueue(spark, folder, links, owned, ["view"], ["selected"])


def test_large_rounds_are_compacted(spark, tmp_path, monkeypatch):
    """After a large round only what still waits is kept, and no batch is left to merge; small rounds leave their batches."""
    shape = "event_id long, received_at timestamp, connection long, event_type string, item long, status string, attempts int, fails int"
    for large, left in ((10, 0), (1000, 2)):
        monkeypatch.setattr(events, "LARGE", large, raising=False)
        rows, queue = inbound(spark, str(tmp_path / str(large)), 40)
        queue.receive(spark.createDataFrame(rows, shape), "all", 0)
        counts = queue.work(START + datetime.timedelta(days=1), None)
        assert sum(counts.values()) == 39 and queue.waiting.snapshot().count() == counts["deferred"]
        assert len(queue.waiting.manifest()["deltas"]) == left


def expected(rows):
    """What becomes of every event: the last applied one of each item, and the dead ones with a reason."""
    state, dead = {}, {}
    for k, _, connection, kind, item, status, _, fails in rows:
        reason = "connection_revoked" if connection > 1 else "unhandled_event_type" if kind != "view" else "invalid_payload" if item is None else "invalid_status" if status != "selected" else "stock_item_not_ours" if item in (2, 4) else None
        if reason or fails >= 5:
            dead[k] = (reason or "", not reason)
        else:
            state[item] = max(state.get(item, 0), k)
    return state, dead


def outcome(queue):
    return {r.item: r.event_id for r in queue.state.snapshot().collect()}, {r.event_id: (r.reason, r.exhausted) for r in queue.dead.snapshot().collect()}


def test_deferred_events_come_back(spark, tmp_path):
    """By a stream and then round by round: oldest first, fifty at a time, until all are applied or dead; a failure waits."""
    rows, queue = inbound(spark, str(tmp_path / "queue"))
    spark.createDataFrame(rows, EVENT).repartitionByRange(2, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    noon = START + datetime.timedelta(hours=1)
    queue.stream(stream, str(tmp_path / "mark"), lambda: noon).awaitTermination()
    left = {r.event_id: (r.attempts, r.next_attempt_at) for r in queue.waiting.snapshot().collect()}
    assert sum(n == 0 for n, _ in left.values()) == 99 and {n for n, _ in left.values()} == {0, 1}
    assert {at - noon for n, at in left.values() if n} == {datetime.timedelta(seconds=2)}
    rounds, now = 0, noon
    while (at := queue.next_due()) is not None:
        now = max(now, at)
        assert 0 < sum(queue.work(now, 5000).values()) <= 500
        rounds += 1
    assert outcome(queue) == expected(rows) and 5 <= rounds <= 8


def test_killed_rounds_are_repeated(spark, tmp_path):
    """A round that is killed before its last step, and repeated later with more events due, loses none."""
    rows, queue = inbound(spark, str(tmp_path / "queue"), 60)
    queue.receive(spark.createDataFrame(rows, EVENT), "all", 0)
    whole = queue.waiting.apply

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    queue.waiting.apply = killed
    with pytest.raises(KeyboardInterrupt):
        queue.work(START + datetime.timedelta(seconds=30), None)
    queue.waiting.apply = whole
    now = START + datetime.timedelta(hours=1)
    while (at := queue.next_due()) is not None:
        now = max(now, at)
        queue.work(now, None)
    assert outcome(queue) == expected(rows)


def test_drain_ends_by_itself(spark, tmp_path):
    rows, queue = inbound(spark, str(tmp_path / "queue"), 40)
    queue.receive(spark.createDataFrame(rows, EVENT), "all", 0)
    ticks = iter(range(10_000))
    rounds = events.drain(queue, spark, str(tmp_path / "mark"), lambda: START + datetime.timedelta(hours=1 + next(ticks)), every="0 seconds")
    assert rounds >= 5 and outcome(queue) == expected(rows) and not spark.streams.active


def test_versioned_table(spark, tmp_path):
    """Batches in any number leave what a dictionary holds; killed and repeated ones change nothing; compaction keeps untouched buckets."""
    shape = "k long, v long, said string"
    made = lambda: VersionedTable(spark, str(tmp_path), shape, ["k"], "v", buckets=4, deltas=3)
    rows_of = lambda t, n=None: {r.k: (r.v, r.said) for r in t.snapshot(n).collect()}
    table, held = made(), {}
    for number in range(8):
        rows = [(k, (k * 7 + number * 3) % 11, f"{number}:{k}") for k in range(number, number + 20, 2)]
        assert table.apply(spark.createDataFrame(rows, shape), "s", number)
        for k, v, said in rows:
            if k not in held or v >= held[k][0]:
                held[k] = (v, said)
        if number == 3:
            early = table.manifest()["number"], dict(held)
        assert not made().apply(spark.createDataFrame([(0, 99, "no")], shape), "s", number)
    assert rows_of(made()) == held and rows_of(table, early[0]) == early[1]

    def killed(old, **new):
        raise KeyboardInterrupt

    table._switch = killed
    with pytest.raises(KeyboardInterrupt):
        table.apply(spark.createDataFrame([(1, 50, "lost")], shape), "s", 8)
    assert rows_of(made()) == held
    table = made()
    table.compact()
    base, number = table.manifest()["base"], table.manifest()["number"]
    table.apply(spark.createDataFrame([(1, 60, "x"), (2, 60, None)], shape), "s", 9, gone=F.col("said").isNull())
    held = {k: x for k, x in held.items() if k != 2} | {1: (60, "x")}
    assert rows_of(table) == held
    table.compact()
    assert 1 <= sum(base[b] != n for b, n in table.manifest()["base"].items()) <= 2 and table.manifest()["number"] == number + 2
    table.vacuum(1)
    assert rows_of(table) == held


def test_workers_never_share_a_job(spark, tmp_path):
    """Ten workers claim at once; one dies, and its buckets move once its leases are over."""
    now, names = [1000.0], [f"w{k}" for k in range(10)]
    jobs = spark.range(400).selectExpr("id", "'active' AS lifecycle", "'read' AS stage", "0 AS attempts", "timestamp_seconds(id) AS next_attempt_at", "CAST(NULL AS TIMESTAMP) AS claim_until")
    as_of = F.lit(datetime.datetime(2030, 1, 1))
    worker = {n: leases.Worker(spark, str(tmp_path), n, 16, 120, lambda: now[0]) for n in names}

    def claimed(present):
        with ThreadPoolExecutor(10) as pool:
            return dict(zip(present, pool.map(lambda n: {r.id for r in worker[n].claim(jobs, as_of, 400, present).collect()}, present)))

    first = claimed(names)
    assert sorted(x for ids in first.values() for x in ids) == list(range(400))
    busy = max(names, key=lambda n: len(first[n]))
    rest = [n for n in names if n != busy]
    soon = claimed(rest)  # the dead one's leases still run
    assert all(soon[n] == first[n] for n in rest)
    now[0] += 121
    with ThreadPoolExecutor(10) as pool:  # of many that see a lease run out, one gets the next
        assert sum(pool.map(lambda n: worker[n].take(3), names)) == 1
    now[0] += 121
    later = claimed(rest)
    assert sorted(x for ids in later.values() for x in ids) == list(range(400)) and all(first[n] <= later[n] for n in rest)


@pytest.mark.parametrize("kind", ["counter", "breaker"])
def test_stateful_streams_equal_folds(spark, tmp_path, kind):
    """Files in any order within the delay give what the batch fold gives, and no state is left after the last window."""
    batch = spark.read.parquet(f"{DATA}/events.parquet").where("user_id < 8").withColumn("ok", F.col("event_type") != "error")
    end = batch.agg(F.max("ts")).first()[0] + datetime.timedelta(days=400)
    shape = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, ok BOOLEAN"
    rows = batch.select("event_id", "ts", "user_id", "ok").orderBy(F.hash("event_id")).collect()
    closing = [(10**9 + u, end, u, True) for u in range(8)]
    for part in [rows[::3], rows[1::3], rows[2::3], closing, [(10**9 + 99, end + datetime.timedelta(days=900), 99, True)]]:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    found = stateful.rate_limited(stream, 5, 86400.0, "300 days") if kind == "counter" else stateful.circuit_broken(stream, 3, 7200.0, "ok", "300 days")
    query = found.writeStream.format("memory").queryName(kind).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    timed = batch.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rule = folds.rate_limit(5, 86400.0) if kind == "counter" else folds.circuit_breaker(3, 7200.0)
    fold = {tuple(r) for r in folds.fold(timed, "user_id", "at", "event_id", *rule).collect()}
    assert {tuple(r) for r in spark.sql(f"SELECT * FROM {kind} WHERE event_id < {10**9}").collect()} == fold
    # What is left is the waiting event, and the timer, of the user that came last.
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4


def test_streams_begin_with_given_states(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    for row in [(1, at, 7), (2, at + datetime.timedelta(days=90), 7), (3, at + datetime.timedelta(days=900), 8)]:
        spark.createDataFrame([row], "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    begun = spark.createDataFrame([(7, at.timestamp() - 60, 5.0)], "user_id long, a double, b double")
    query = stateful.rate_limited(stream, 5, 3600.0, "1 day", begun).writeStream.format("memory").queryName("begun").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id: (r.allowed, r["count"]) for r in spark.sql("SELECT * FROM begun").collect()} == {1: (False, 6), 2: (True, 1)}
