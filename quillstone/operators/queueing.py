"""Work queues and inbound events as frames: claims, counts, deduplication, guarded application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import backoff_claim


def seconds(n: Column) -> Column:
    """An interval of n seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def due(as_of: Column) -> Column:
    """Unsettled, not before its next attempt, and not under a lease that still runs."""
    free = F.col("claim_until").isNull() | (F.col("claim_until") < as_of)
    return F.col("lifecycle").isin("active", "staged") & (F.col("stage") != "settled") & (F.col("next_attempt_at") <= as_of) & free


def claim(jobs: DataFrame, as_of: Column, limit: int, lease: int = 120) -> DataFrame:
    """The next ``limit`` due jobs, longest waiting first, as they are once claimed: leased, counted and put off.

    Spark has no row locks: one writer claims at a time.
    """
    taken = jobs.where(due(as_of)).orderBy("next_attempt_at", "id").limit(max(limit, 0))
    return taken.withColumns(
        {"claim_until": as_of + seconds(F.lit(max(lease, 1))), "next_attempt_at": as_of + seconds(backoff_claim(F.col("attempts"))), "attempts": F.col("attempts") + 1}
    )


def pending(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row: how many jobs can be claimed now, and how many are left at all."""
    left = F.col("lifecycle").isin("active", "staged") & (F.col("stage") != "settled")
    return jobs.agg(F.count_if(F.coalesce(due(as_of), F.lit(False))).alias("claimable"), F.count_if(F.coalesce(left, F.lit(False))).alias("outstanding"))


def first_of_each(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first delivery of each dedupe key; the others are duplicates."""
    rest = [c for c in events.columns if c not in key]
    best = events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*key, "b.*").select(*events.columns)


def guarded(updates: DataFrame, key: Sequence[str], version: str, order: Sequence[str]) -> DataFrame:
    """The state of each key after all updates: the highest version wins, of equal ones the last to arrive.

    An acknowledgement survives a replay: where the winner says selected though an update of the same or a lower version
    had been acknowledged, the key stays acknowledged.
    """
    rest = [c for c in updates.columns if c not in key]
    best = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, *order)).alias("b"), F.bool_or(F.col("status") == "builder_acknowledged").alias("_acknowledged"))
    flat = best.select(*key, "b.*", "_acknowledged")
    sticky = F.when(F.col("_acknowledged") & (F.col("status") == "selected"), "builder_acknowledged").otherwise(F.col("status"))
    return flat.withColumn("status", sticky).select(*updates.columns)


def outcomes(events: DataFrame, connections: DataFrame, items: DataFrame, handled: Sequence[str], vocabulary: Sequence[str]) -> DataFrame:
    """events (connection, event_type, item, status, attempts, failed) with outcome: applied, refused with a reason, or deferred.

    The ladder: a missing or revoked connection; an event type nobody handles; no item; a status outside the vocabulary;
    an item of another organisation; a failure, which defers until the fifth attempt and then is dead.
    """
    held = events.join(connections.select("connection", "state", "org"), "connection", "left").join(items.select("item", F.col("org").alias("_owner")), "item", "left")
    outcome = (
        F.when(F.col("state").isNull() | (F.col("state") == "revoked"), "refused:connection_revoked")
        .when(~F.col("event_type").isin(*handled), F.concat(F.lit("refused:unhandled_event_type:"), F.substring("event_type", 1, 60)))
        .when(F.col("item").isNull(), "refused:invalid_payload")
        .when(~F.col("status").isin(*vocabulary), F.concat(F.lit("refused:invalid_status:"), F.substring("status", 1, 40)))
        .when(F.col("_owner").isNull() | (F.col("_owner") != F.col("org")), "refused:stock_item_not_ours")
        .when(F.col("failed") & (F.col("attempts") + 1 >= 5), "dead")
        .when(F.col("failed"), "deferred")
        .otherwise("applied")
    )
    return held.select(*events.columns, outcome.alias("outcome"))


def dead_letters(judged: DataFrame) -> DataFrame:
    """The events of ``outcomes`` that will not be tried again, with reason (of a refusal) and exhausted (out of attempts)."""
    gone = judged.where((F.col("outcome") == "dead") | F.col("outcome").startswith("refused:"))
    return gone.withColumns({"reason": F.split_part("outcome", F.lit(":"), F.lit(2)), "exhausted": F.col("outcome") == "dead"})


def stamps_differ(previous: Column, current: Column) -> Column:
    """Whether a reading differs from the one before; no reading before is no change."""
    return previous.isNotNull() & ~previous.eqNullSafe(current)


def settle(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """jobs after workers reported: id, next_stage (null stays), reset, retry_after (seconds), result and error.

    Attempts begin anew where the stage changes or the worker says so, so a job that makes progress is never put off for
    it. The lease ends; a job without a report stays as it is.
    """
    said = results.select("id", F.lit(True).alias("_said"), *[F.col(c).alias(f"_{c}") for c in ("next_stage", "reset", "retry_after", "result", "error")])
    moved = F.coalesce("_reset", F.lit(False)) | (F.col("_next_stage").isNotNull() & ~F.col("_next_stage").eqNullSafe(F.col("stage")))
    new = {
        "stage": F.coalesce("_next_stage", "stage"),
        "attempts": F.when(moved, 0).otherwise(F.col("attempts")),
        "claim_until": F.lit(None),
        "next_attempt_at": as_of + seconds(F.greatest(F.coalesce("_retry_after", F.lit(0)), F.lit(0))),
        "last_result": F.substring("_result", 1, 200),
        "last_error": F.substring("_error", 1, 500),
    }
    types = dict(jobs.dtypes)
    joined = jobs.join(said, "id", "left")
    return joined.select(*[F.when(F.col("_said"), new[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in new else F.col(c) for c in jobs.columns])


def reopened(jobs: DataFrame, current: int, as_of: Column) -> DataFrame:
    """jobs with settled ones begun anew that a worker of an older version than ``current`` failed on, and no image came of.

    branches is JSON: for each document its result and, where a worker of ours caused it, the runtime_version. A read
    that never came back counts with or without a version, a retirement only with one; a dead link carries none, and
    what a document answered stays true.
    """
    branches = F.map_values(F.from_json(F.coalesce("branches", F.lit("{}")), "map<string,map<string,string>>"))
    older = lambda b: F.coalesce(F.try_element_at(b, F.lit("runtime_version")).cast("int"), F.lit(0)) < current
    result = lambda b: F.try_element_at(b, F.lit("result"))
    ours = F.exists(branches, lambda b: F.coalesce(older(b) & ((result(b) == "package_recovery_attempt") | ((result(b) == "no_deterministic_image") & F.map_contains_key(b, "runtime_version"))), F.lit(False)))
    again = F.coalesce(F.col("lifecycle").isin("active", "staged") & (F.col("stage") == "settled") & F.col("primary_image").isNull() & ours, F.lit(False))
    new = {"stage": F.lit("source"), "next_attempt_at": as_of, "claim_until": F.lit(None), "attempts": F.lit(0), "enrichment": F.lit("pending")}
    types = dict(jobs.dtypes)
    return jobs.select(*[F.when(again, new[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in new else F.col(c) for c in jobs.columns])
