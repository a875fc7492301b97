"""Queues that many workers share: each owns hash buckets by rendezvous, and holds a lease on what it works on.

No two workers claim one row, as a row lies in one bucket and a bucket has one lease at a time, taken by creating the file
of its next epoch, which one of several succeeds in. A worker that dies loses its buckets when their leases have run out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.queueing import claim, due
from quillstone.sources.files import Files

BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key, from the first bits of its hash."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def owner_of(bucket: Column, workers: Sequence[str]) -> Column:
    """Of the workers that whose hash with the bucket is highest: if one leaves, its own buckets move and no others."""
    scores = [F.struct(F.md5(F.concat(F.lit(f"{w}:"), bucket.cast("string"))).alias("score"), F.lit(w).alias("worker")) for w in workers]
    return F.array_max(F.array(*scores))["worker"]


def claims_of_all(jobs: DataFrame, as_of: Column, limit: int, workers: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """id and worker of what each worker would claim at once: the ``limit`` longest waiting due jobs of its own buckets.

    A worker's best of each bucket are chosen first, so no worker's whole queue meets in one task.
    """
    held = jobs.where(due(as_of)).select("id", "next_attempt_at", bucket_of(F.col("id"), buckets).alias("_bucket"))
    first = held.withColumn("_turn", F.row_number().over(Window.partitionBy("_bucket").orderBy("next_attempt_at", "id"))).where(F.col("_turn") <= limit)
    mine = first.withColumn("worker", owner_of(F.col("_bucket"), workers))
    return mine.withColumn("turn", F.row_number().over(Window.partitionBy("worker").orderBy("next_attempt_at", "id"))).where(F.col("turn") <= limit).select("id", "worker", F.col("turn").cast("long"))


class Worker:
    """One of several workers over a queue. ``folder``: where the leases lie; ``clock``: seconds, the same for all workers."""

    def __init__(self, spark: SparkSession, folder: str, name: str, buckets: int = BUCKETS, lease: float = 120, clock=time.time):
        self.files, self.name, self.buckets, self.lease, self.clock = Files(spark, folder), name, buckets, lease, clock

    def _last(self, bucket: int) -> tuple[int, str | None, float]:
        """Epoch, holder and end of a bucket's last lease. A lease that was created and never filled runs from its file's time."""
        epochs = self.files.names(f"bucket={bucket}")
        if not epochs:
            return 0, None, 0.0
        text = self.files.read(f"bucket={bucket}/{epochs[-1]}")
        said = json.loads(text) if text else {"worker": None, "until": self.files.written(f"bucket={bucket}/{epochs[-1]}") + self.lease}
        return int(epochs[-1]), said["worker"], said["until"]

    def take(self, bucket: int) -> bool:
        """Take or renew a bucket's lease; False while another worker holds it, or if another was faster."""
        epoch, holder, until = self._last(bucket)
        if until > self.clock() and holder != self.name:
            return False
        return self.files.create(f"bucket={bucket}/{epoch + 1:012d}", json.dumps({"worker": self.name, "until": self.clock() + self.lease}))

    def release(self, bucket: int) -> None:
        """Give a bucket back before its lease ends."""
        epoch, holder, until = self._last(bucket)
        if holder == self.name and until > self.clock():
            self.files.create(f"bucket={bucket}/{epoch + 1:012d}", json.dumps({"worker": self.name, "until": 0}))

    def owned(self, workers: Sequence[str]) -> list[int]:
        """The buckets that this worker may work on now, of those that rendezvous gives it among the workers that are there."""
        spark = SparkSession.active()
        mine = spark.range(self.buckets).where(owner_of(F.col("id"), workers) == self.name)
        return [b for b in sorted(r.id for r in mine.collect()) if self.take(b)]

    def claim(self, jobs: DataFrame, as_of: Column, limit: int, workers: Sequence[str]) -> DataFrame:
        """``queueing.claim`` of the jobs in the buckets this worker owns and holds the leases of."""
        held = self.owned(workers)
        inside = bucket_of(F.col("id"), self.buckets).isin(*held) if held else F.lit(False)
        return claim(jobs.where(inside), as_of, limit, int(self.lease))
