"""Queues, inbound events, stamps, alerts and metering over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import backoff_claim, backoff_delivery
from quillstone.operators import leases
from quillstone.operators import queueing as Q
from quillstone.operators.tablefunctions import register_functions
from quillstone.plans.aggregates import EVENTS_AS_OF, at
from quillstone.registry import ORACLES, Tables, query
from quillstone.session import scratch
from quillstone.sources.versioned import VersionedTable
from quillstone.streaming import folds
from quillstone.streaming.events import InboundQueue

_JOBS = (
    "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'archived' WHEN event_type = 'error' THEN 'staged' ELSE 'active' END AS lifecycle, CASE WHEN user_id % 5 = 0 THEN 'settled' ELSE 'election' END AS stage, "
    "CAST(event_id % 10 AS INTEGER) AS attempts, ts AS next_attempt_at, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL {day} END AS claim_until FROM events"
)
_DUE = f"lifecycle IN ('active', 'staged') AND stage <> 'settled' AND next_attempt_at <= TIMESTAMP '{EVENTS_AS_OF}' AND (claim_until IS NULL OR claim_until < TIMESTAMP '{EVENTS_AS_OF}')"
_DUCK_JOBS = _JOBS.format(day="3 DAY")


def _jobs(t: Tables) -> DataFrame:
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(_JOBS.format(day="3 DAYS"))


@query(
    f"SELECT id, attempts + 1 AS attempts, TIMESTAMP '{EVENTS_AS_OF}' + INTERVAL 120 SECOND AS claim_until, TIMESTAMP '{EVENTS_AS_OF}' + to_seconds(CAST(least(30 * power(2, least(attempts, 7)), 3600) AS BIGINT)) AS next_attempt_at "
    f"FROM ({_DUCK_JOBS}) j WHERE {_DUE} ORDER BY j.next_attempt_at, id LIMIT 50"
)
def queue_claim_batch(t: Tables) -> DataFrame:
    return Q.claim(_jobs(t), at(EVENTS_AS_OF), 50).select("id", "attempts", "claim_until", "next_attempt_at")


_WORKERS = [f"worker-{k}" for k in range(10)]


@query(
    f"WITH held AS (SELECT id, next_attempt_at, ('0x' || md5(id::VARCHAR)[1:8])::BIGINT % {leases.BUCKETS} AS bucket FROM ({_DUCK_JOBS}) j WHERE {_DUE}), "
    f"owners AS (SELECT b AS bucket, arg_max(w, md5(w || ':' || b)) AS worker FROM range({leases.BUCKETS}) r(b), unnest({_WORKERS}) u(w) GROUP BY b) "
    "SELECT id, worker, turn FROM (SELECT id, worker, row_number() OVER (PARTITION BY worker ORDER BY next_attempt_at, id) AS turn FROM held JOIN owners USING (bucket)) x WHERE turn <= 50"
)
def queue_claims_of_workers(t: Tables) -> DataFrame:
    return leases.claims_of_all(_jobs(t), at(EVENTS_AS_OF), 50, _WORKERS)


@query(f"SELECT count(*) FILTER (WHERE {_DUE}) AS claimable, count(*) FILTER (WHERE lifecycle IN ('active', 'staged') AND stage <> 'settled') AS outstanding FROM ({_DUCK_JOBS}) j")
def queue_pending(t: Tables) -> DataFrame:
    return Q.pending(_jobs(t), at(EVENTS_AS_OF))


@query(
    "SELECT event_id, CAST(least(30 * power(2, least(event_id % 15, 7)), 3600) AS BIGINT) AS claim_seconds, CAST(least(3600, power(2, least(event_id % 15, 12))) AS BIGINT) AS delivery_seconds, event_id % 15 >= 12 AS dead FROM events"
)
def backoff_schedule(t: Tables) -> DataFrame:
    n = F.col("event_id") % 15
    return t.events.select("event_id", backoff_claim(n).alias("claim_seconds"), backoff_delivery(n).alias("delivery_seconds"), (n >= 12).alias("dead"))


@query(
    "SELECT user_id, event_type, day, event_id FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS rn FROM events) x WHERE rn = 1"
)
def inbound_dedupe(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "ts")
    return Q.first_of_each(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).drop("ts")


_STATUS = "CASE event_type WHEN 'view' THEN 'selected' WHEN 'click' THEN 'progressed' WHEN 'purchase' THEN 'builder_acknowledged' WHEN 'signup' THEN 'completed' ELSE 'withdrawn' END"


@query(
    "SELECT user_id, event_id, version, CASE WHEN acknowledged AND status = 'selected' THEN 'builder_acknowledged' ELSE status END AS status FROM (SELECT user_id, event_id, version, status, "
    "bool_or(status = 'builder_acknowledged') OVER (PARTITION BY user_id) AS acknowledged, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, ts DESC, event_id DESC) AS rn "
    f"FROM (SELECT user_id, event_id, ts, (event_id * 7) % 1000 AS version, {_STATUS} AS status FROM events) u) x WHERE rn = 1"
)
def version_guard_latest(t: Tables) -> DataFrame:
    u = t.events.select("user_id", "event_id", "ts", ((F.col("event_id") * 7) % 1000).alias("version"), F.expr(_STATUS).alias("status"))
    return Q.guarded(u, ["user_id"], "version", ["ts", "event_id"]).select("user_id", "event_id", "version", "status")


_INBOUND = (
    "SELECT event_id, user_id % 40 AS connection, event_type, CASE WHEN event_id % 17 <> 0 THEN event_id % 2000 END AS item, CASE WHEN event_id % 5 = 0 THEN 'odd' ELSE 'selected' END AS status, "
    "CAST(event_id % 6 AS INTEGER) AS attempts, event_id % 9 = 0 AS failed FROM events"
)
_CONNECTIONS = "SELECT n_nationkey AS connection, CASE WHEN n_nationkey % 8 = 0 THEN 'revoked' ELSE 'active' END AS state, n_regionkey AS org FROM nation"
_OWNED = "SELECT p_partkey AS item, CAST(p_partkey % 5 AS INTEGER) AS org FROM part"


@query(
    "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.state IS NULL OR c.state = 'revoked' THEN 'refused:connection_revoked' WHEN e.event_type NOT IN ('view', 'click', 'purchase') THEN 'refused:unhandled_event_type:' || substr(e.event_type, 1, 60) "
    "WHEN e.item IS NULL THEN 'refused:invalid_payload' WHEN e.status <> 'selected' THEN 'refused:invalid_status:' || substr(e.status, 1, 40) WHEN i.org IS NULL OR i.org <> c.org THEN 'refused:stock_item_not_ours' "
    "WHEN e.failed AND e.attempts + 1 >= 5 THEN 'dead' WHEN e.failed THEN 'deferred' ELSE 'applied' END AS outcome "
    f"FROM ({_INBOUND}) e LEFT JOIN ({_CONNECTIONS}) c ON e.connection = c.connection LEFT JOIN ({_OWNED}) i ON e.item = i.item) x GROUP BY outcome"
)
def inbound_apply_outcomes(t: Tables) -> DataFrame:
    for name in ("events", "nation", "part"):
        getattr(t, name).createOrReplaceTempView(name)
    sql = t.spark.sql
    judged = Q.outcomes(sql(_INBOUND), sql(_CONNECTIONS), sql(_OWNED), ["view", "click", "purchase"], ["selected", "progressed", "completed", "withdrawn"])
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    f"SELECT event_id, outcome, split_part(outcome, ':', 2) AS reason, outcome = 'dead' AS exhausted FROM (SELECT e.event_id, CASE WHEN c.state IS NULL OR c.state = 'revoked' THEN 'refused:connection_revoked' WHEN e.event_type NOT IN ('view', 'click', 'purchase') THEN 'refused:unhandled_event_type:' || substr(e.event_type, 1, 60) "
    "WHEN e.item IS NULL THEN 'refused:invalid_payload' WHEN e.status <> 'selected' THEN 'refused:invalid_status:' || substr(e.status, 1, 40) WHEN i.org IS NULL OR i.org <> c.org THEN 'refused:stock_item_not_ours' "
    "WHEN e.failed AND e.attempts + 1 >= 5 THEN 'dead' WHEN e.failed THEN 'deferred' ELSE 'applied' END AS outcome "
    f"FROM ({_INBOUND}) e LEFT JOIN ({_CONNECTIONS}) c ON e.connection = c.connection LEFT JOIN ({_OWNED}) i ON e.item = i.item) x WHERE outcome NOT IN ('applied', 'deferred')"
)
def inbound_dead_letters(t: Tables) -> DataFrame:
    for name in ("events", "nation", "part"):
        getattr(t, name).createOrReplaceTempView(name)
    sql = t.spark.sql
    judged = Q.outcomes(sql(_INBOUND), sql(_CONNECTIONS), sql(_OWNED), ["view", "click", "purchase"], ["selected", "progressed", "completed", "withdrawn"])
    return Q.dead_letters(judged).select("event_id", "outcome", "reason", "exhausted")


_DELAYED = (
    "SELECT event_id, {stamp} AS received_at, user_id % 40 AS connection, event_type, CASE WHEN event_id % 17 <> 0 THEN event_id % 2000 END AS item, CASE WHEN event_id % 5 = 0 THEN 'odd' ELSE 'selected' END AS status, "
    "CAST(0 AS INTEGER) AS attempts, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 8 ELSE 0 END AS INTEGER) AS fails FROM events"
)


@query(
    "WITH x AS (SELECT e.event_id, e.item, fails, CASE WHEN c.state IS NULL OR c.state = 'revoked' THEN 'connection_revoked' WHEN e.event_type NOT IN ('view', 'click', 'purchase') THEN 'unhandled_event_type' WHEN e.item IS NULL THEN 'invalid_payload' "
    "WHEN e.status <> 'selected' THEN 'invalid_status' WHEN i.org IS NULL OR i.org <> c.org THEN 'stock_item_not_ours' WHEN fails >= 5 THEN '' END AS reason "
    f"FROM ({_DELAYED.format(stamp='ts')}) e LEFT JOIN ({_CONNECTIONS}) c ON e.connection = c.connection LEFT JOIN ({_OWNED}) i ON e.item = i.item) "
    "SELECT 'dead' AS kind, event_id AS id, event_id, CASE WHEN reason = '' THEN 4 ELSE 0 END AS attempts, reason FROM x WHERE reason IS NOT NULL UNION ALL "
    "SELECT 'applied', item, max(event_id), arg_max(fails, event_id), NULL FROM x WHERE reason IS NULL GROUP BY item"
)
def inbound_drain(t: Tables) -> DataFrame:
    """All events wait at once; rounds at the time at which the next is due, until none waits: what failed came back by backoff."""
    for name in ("events", "nation", "part"):
        getattr(t, name).createOrReplaceTempView(name)
    sql = t.spark.sql
    queue = InboundQueue(t.spark, scratch(t.spark, "inbound"), sql(_CONNECTIONS), sql(_OWNED), ["view", "click", "purchase"], ["selected", "progressed", "completed", "withdrawn"])
    queue.receive(sql(_DELAYED.format(stamp="CAST(ts AS TIMESTAMP)")), "all", 0)
    last = t.events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    while (due := queue.next_due()) is not None:
        queue.work(max(due, last), None)
    dead = queue.dead.snapshot().select(F.lit("dead").alias("kind"), F.col("event_id").alias("id"), "event_id", "attempts", "reason")
    return dead.unionByName(queue.state.snapshot().select(F.lit("applied").alias("kind"), F.col("item").alias("id"), "event_id", "attempts", F.lit(None).cast("string").alias("reason")))


@query(
    "SELECT user_id, version, event_id, event_type FROM (SELECT user_id, event_id, event_type, event_id * 7919 % 1000003 AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1000003 DESC) AS rn FROM events) x WHERE rn = 1"
)
def versioned_batches(t: Tables) -> DataFrame:
    """The events as six batches into a versioned table, each batch twice, compacted on the way."""
    held = VersionedTable(t.spark, scratch(t.spark, "versioned"), "user_id LONG, version LONG, event_id LONG, event_type STRING", ["user_id"], "version", deltas=4)
    rows = t.events.withColumn("version", F.col("event_id") * 7919 % 1000003)
    for number in (0, 1, 1, 2, 3, 2, 4, 5):
        held.apply(rows.where(F.col("event_id") % 6 == number), "events", number)
    return held.snapshot()


def _timed(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros")).withColumn("at", F.col("micros") / 1e6)


# Each user's events in order; a recursive query goes through them one by one.
_ORDERED = "e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, epoch_us(ts) / 1e6 AS at_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL)"


@query(
    f"WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, event_id, rn, at_s, at_s AS began, 1 AS n FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, e.at_s, CASE WHEN e.at_s - began >= 86400 THEN e.at_s ELSE began END, "
    "CASE WHEN e.at_s - began >= 86400 THEN 1 ELSE n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) "
    "SELECT user_id, event_id, n <= 5 AS allowed, n::BIGINT AS count, greatest(5 - n, 0)::BIGINT AS remaining, greatest(0, ceil(began + 86400 - at_s))::BIGINT AS retry_after FROM r"
)
def rate_limit_fold(t: Tables) -> DataFrame:
    return folds.fold(_timed(t).select("user_id", "event_id", "at"), "user_id", "at", "event_id", *folds.rate_limit(5, 86400.0))


@query("SELECT user_id, event_id, allowed, count FROM (" + ORACLES["rate_limit_fold"] + ") f")
def rate_limited_sql(t: Tables) -> DataFrame:
    """The same fold as a table function of SQL, over partitions in order."""
    register_functions(t.spark)
    rows = _timed(t).where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("key"), "at", F.col("event_id").alias("tie"))
    return t.spark.sql("SELECT key AS user_id, tie AS event_id, allowed, count FROM rate_limited(TABLE(SELECT * FROM {rows}), 5, 86400)", rows=rows)


@query(
    f"WITH RECURSIVE {_ORDERED}, r AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS rn, 0 AS held, NULL::DOUBLE AS until_s, false AS is_open, 0 AS failures, false AS tripped FROM e UNION ALL "
    "SELECT e.user_id, e.event_id, e.rn, CASE WHEN ok OR held + 1 >= 3 THEN 0 ELSE held + 1 END, CASE WHEN ok THEN NULL WHEN held + 1 >= 3 THEN e.at_s + 7200 ELSE until_s END, coalesce(until_s > e.at_s, false), "
    "CASE WHEN ok OR held + 1 >= 3 THEN 0 ELSE held + 1 END, NOT ok AND held + 1 >= 3 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) "
    "SELECT user_id, event_id, is_open, failures::BIGINT AS failures, tripped FROM r WHERE rn > 0"
)
def circuit_breaker_fold(t: Tables) -> DataFrame:
    rows = _timed(t).select("user_id", "event_id", "at", (F.col("event_type") != "error").alias("ok"))
    return folds.fold(rows, "user_id", "at", "event_id", *folds.circuit_breaker(3, 7200.0))


@query(
    "SELECT day, n, latest, attention, prior_n IS NOT NULL AND (n <> prior_n OR latest IS DISTINCT FROM prior_latest OR attention <> prior_attention) AS changed FROM (SELECT *, lag(n) OVER (ORDER BY day) AS prior_n, "
    "lag(latest) OVER (ORDER BY day) AS prior_latest, lag(attention) OVER (ORDER BY day) AS prior_attention FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(ts) AS latest, count(*) FILTER (WHERE event_type = 'error') AS attention FROM events GROUP BY 1) d) x"
)
def change_stamp(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.max("ts").alias("latest"), F.count_if(F.col("event_type") == "error").alias("attention")
    )
    # One row a day goes to this window.
    stamp = F.struct("n", "latest", "attention")
    return days.withColumn("prior", F.lag(stamp).over(Window.orderBy("day"))).select("day", "n", "latest", "attention", Q.stamps_differ(F.col("prior"), stamp).alias("changed"))


@query(
    "SELECT event_id, event_type AS alert_type, CASE WHEN value > 150 THEN 'critical' ELSE 'high' END AS severity, replace(event_type || '_seen', '_', ' ') AS summary FROM events WHERE event_type IN ('error', 'purchase') AND value > 100"
)
def alert_rules(t: Tables) -> DataFrame:
    found = t.events.where(F.col("event_type").isin("error", "purchase") & (F.col("value") > 100))
    summary = F.replace(F.concat("event_type", F.lit("_seen")), F.lit("_"), F.lit(" "))
    return found.select("event_id", F.col("event_type").alias("alert_type"), F.when(F.col("value") > 150, "critical").otherwise("high").alias("severity"), summary.alias("summary"))


@query(
    "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN tokens ELSE 1 END) AS BIGINT) AS units, count(*) AS requests FROM (SELECT user_id, event_type, coalesce(nullif(CAST(regexp_extract(props, '[0-9]+') AS BIGINT), 0), CAST(floor(value) AS BIGINT)) AS tokens FROM events) u "
    "WHERE tokens > 0 GROUP BY user_id"
)
def usage_events(t: Tables) -> DataFrame:
    first = F.nullif(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    used = t.events.select("user_id", "event_type", F.coalesce(first, F.floor("value").cast("long")).alias("tokens")).where("tokens > 0")
    return used.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", F.col("tokens")).otherwise(1)).alias("units"), F.count("*").alias("requests"))
