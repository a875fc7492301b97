"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quillstone.functions.exprs import backoff_delivery
from quillstone.operators import queueing
from quillstone.sources.files import Files
from quillstone.sources.versioned import VersionedTable

SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
#: Events that one round applies by default, and at most.
ROUND, MOST = 50, 500
#: A round of more events is followed by a compaction of those that wait.
LARGE = 10_000
#: Tries that an event has.
TRIES = 5


def source(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; watermarks need a timestamp with a zone."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """One event for each key within the watermark's delay: redeliveries are dropped, and state is bounded by the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of each type in tumbling event-time windows, final once the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to: a new checkpoint is a new stream, whose batches are numbered anew."""
    return json.loads(Files(spark, checkpoint).read("metadata"))["id"]


def apply_into(events: DataFrame, folder: str, checkpoint: str, keys: list[str], version: str) -> StreamingQuery:
    """Apply micro-batches to a versioned table, each once: a batch that runs again, or that a killed run left, changes nothing."""
    spark = events.sparkSession
    held = VersionedTable(spark, folder, events.schema.toDDL(), keys, version)
    apply = lambda batch, number: held.apply(batch, stream_name(spark, checkpoint), number)
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class InboundQueue:
    """Inbound events as a delay queue: what fails comes back by backoff, oldest first, until it is applied or out of tries.

    Events are event_id, received_at, connection, event_type, item, status, attempts and fails (tries of it that fail).
    All tables are versioned: ``waiting`` (events that are due at next_attempt_at), ``state`` (the last applied event of
    each item) and ``dead`` (refused or out of tries, with the reason). A round that is killed before its last step is
    repeated, with the same effect, as its events still wait.
    """

    def __init__(self, spark: SparkSession, folder: str, connections: DataFrame, items: DataFrame, handled: Sequence[str], vocabulary: Sequence[str]):
        self.connections, self.items, self.handled, self.vocabulary = connections, items, handled, vocabulary
        event = "event_id LONG, received_at TIMESTAMP, connection LONG, event_type STRING, item LONG, status STRING, attempts INT, fails INT, next_attempt_at TIMESTAMP"
        self.waiting = VersionedTable(spark, f"{folder}/waiting", event, ["event_id"], "attempts")
        self.state = VersionedTable(spark, f"{folder}/state", "item LONG, event_id LONG, status STRING, attempts INT", ["item"], "event_id")
        self.dead = VersionedTable(spark, f"{folder}/dead", "event_id LONG, outcome STRING, reason STRING, exhausted BOOLEAN, attempts INT", ["event_id"], "attempts")

    def receive(self, batch: DataFrame, stream: str, number: int) -> None:
        """Let a batch of events wait; each is due at once."""
        self.waiting.apply(batch.withColumn("next_attempt_at", F.col("received_at")), stream, number)

    def next_due(self):
        """When the first of those that wait is due; None if none waits."""
        return self.waiting.snapshot().agg(F.min("next_attempt_at")).first()[0]

    def work(self, now, most: int | None = ROUND) -> dict[str, int]:
        """One round: the oldest ``most`` (1 to MOST; None: all) due events go through the ladder. Counts by outcome."""
        due = self.waiting.snapshot().where(F.col("next_attempt_at") <= F.lit(now)).withColumn("failed", F.col("attempts") < F.col("fails"))
        if most is not None:
            due = due.orderBy("received_at", "event_id").limit(max(1, min(most, MOST)))
        judged = queueing.outcomes(due, self.connections, self.items, self.handled, self.vocabulary).persist()
        try:
            counts = {r.outcome: r["count"] for r in judged.groupBy(F.split_part("outcome", F.lit(":"), F.lit(1)).alias("outcome")).count().collect()}
            if counts:
                # Each table counts its rounds by its own versions: a repeated round may hold more than the one that was killed.
                put = lambda table, rows, gone=None: table.apply(rows, "rounds", table.manifest()["number"], gone)
                last = F.max_by(F.struct("event_id", "status", "attempts"), "event_id").alias("b")
                put(self.state, judged.where("outcome = 'applied'").groupBy("item").agg(last).select("item", "b.*"))
                put(self.dead, queueing.dead_letters(judged))
                tried = judged.withColumn("attempts", F.col("attempts") + 1)
                later = tried.withColumn("next_attempt_at", F.lit(now) + queueing.seconds(backoff_delivery(F.col("attempts"))))
                put(self.waiting, later, F.col("outcome") != "deferred")
                # What a large round has done with is forgotten at once, so that later ones don't merge it anew.
                if sum(counts.values()) > LARGE:
                    self.waiting.compact()
        finally:
            judged.unpersist()
        return counts

    def stream(self, events: DataFrame, checkpoint: str, clock: Callable, most: int | None = ROUND) -> StreamingQuery:
        """Receive the events that are there and work a round after each micro-batch."""
        spark = events.sparkSession

        def apply(batch: DataFrame, number: int) -> None:
            self.receive(batch, stream_name(spark, checkpoint), number)
            self.work(clock(), most)

        return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Drained(StreamingQueryListener):
    """Sees from the progress of a query, which says of every tick, that nothing is pending any more."""

    def __init__(self, name: str, pending: Callable[[], bool]):
        self.name, self.pending, self.idle = name, pending, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.idle = not self.pending()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def drain(queue: InboundQueue, spark: SparkSession, checkpoint: str, clock: Callable, most: int | None = ROUND, every: str = "1 second", patience: float = 600) -> int:
    """Tick until nothing waits any more, and then stop by itself; how many rounds did something.

    The ticks are the micro-batches of a rate source, so a driver that restarts goes on where it was; a listener sees
    that the queue is empty and the query ends.
    """
    worked = []

    def round_(batch: DataFrame, number: int) -> None:
        worked.append(bool(queue.work(clock(), most)))

    watch = Drained(f"drain-{id(queue)}", lambda: queue.next_due() is not None)
    spark.streams.addListener(watch)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = ticks.writeStream.queryName(watch.name).foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        until = time.monotonic() + patience
        while query.isActive and not watch.idle and time.monotonic() < until:
            query.awaitTermination(0.2)
    finally:
        query.stop()
        spark.streams.removeListener(watch)
    if not watch.idle:
        raise TimeoutError("the queue isn't empty yet")
    return sum(worked)
