"""Guarded upserts, price changes, staged imports and settled jobs over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import merge as M
from quillstone.operators import queueing as Q
from quillstone.registry import Tables, query

_KEY = "CASE WHEN k % 11 = 0 THEN k + 100000000 WHEN k % 7 = 0 THEN NULL ELSE k END"


@query(
    "WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), "
    f"j AS (SELECT k, {_KEY} AS id, CASE WHEN k % 35 = 0 THEN NULL ELSE k % 100 END AS parent, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 4 END AS expected FROM c) "
    "SELECT k AS command, CASE WHEN j.id IS NULL AND parent IS NULL THEN 'PARENT_REQUIRED' WHEN j.id IS NULL THEN 'INSERTED' WHEN o_orderkey IS NULL THEN 'NOT_FOUND' "
    "WHEN expected = o_orderkey % 3 + o_orderkey % 2 THEN 'PATCHED' ELSE 'STALE_WRITE' END AS outcome, "
    "CASE WHEN j.id IS NULL AND parent IS NOT NULL THEN 'new' WHEN expected = o_orderkey % 3 + o_orderkey % 2 AND k % 2 = 0 THEN NULL WHEN expected = o_orderkey % 3 + o_orderkey % 2 THEN 'new' ELSE o_orderpriority END AS note, "
    "CASE WHEN j.id IS NULL AND parent IS NOT NULL THEN 1 WHEN o_orderkey IS NOT NULL THEN o_orderkey % 3 + o_orderkey % 2 + CASE WHEN expected = o_orderkey % 3 + o_orderkey % 2 THEN 1 ELSE 0 END END AS row_version "
    "FROM j LEFT JOIN orders ON o_orderkey = j.id"
)
def guarded_upsert(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    base = o.select(k.alias("id"), (k % 100).alias("parent"), F.col("o_orderpriority").alias("note"), (k % 3 + k % 2).alias("row_version"))
    ids = F.when(k % 11 == 0, k + 100000000).when(k % 7 != 0, k)
    commands = o.where(k % 3 == 0).select(
        k.alias("command"), ids.alias("id"), (-k - 1).alias("new_id"), F.when(k % 35 != 0, k % 100).alias("parent"), F.when(k % 5 != 0, k % 4).alias("expected_version"),
        F.create_map(F.lit("note"), F.when(ids.isNull() | (k % 2 == 1), F.lit("new"))).alias("payload"),
    )
    new, outcomes = M.guarded_upsert(base, commands, ["note"], "parent")
    at = commands.select("command", F.coalesce("id", "new_id").alias("id"))
    return outcomes.join(at, "command").join(new, "id", "left").select("command", "outcome", "note", F.col("row_version").cast("long").alias("row_version"))


@query(
    "WITH u AS (SELECT o_custkey AS unit, o_orderkey AS command, CASE WHEN o_orderkey % 13 = 0 THEN -1.0::DOUBLE ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 17 = 0 THEN 'guess' ELSE 'fixed' END AS basis, o_orderdate AS since FROM orders), "
    "c AS (SELECT *, CASE WHEN unit % 10 = 0 THEN 'UNIT_NOT_FOUND' WHEN price < 0 THEN 'INVALID_PRICE' WHEN basis = 'guess' THEN 'INVALID_PRICE_BASIS' ELSE 'SET' END AS outcome FROM u), "
    "s AS (SELECT unit, price, since AS effective_from, lead(since) OVER (PARTITION BY unit ORDER BY command) AS effective_to FROM c WHERE outcome = 'SET'), "
    "p AS (SELECT c_custkey AS unit, c_acctbal AS price, TIMESTAMP '1990-01-01' AS effective_from, (SELECT arg_min(since, command) FROM c WHERE c.unit = c_custkey AND outcome = 'SET') AS effective_to FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT 'price' AS part, unit AS key, price, effective_from, effective_to, CASE WHEN effective_to IS NULL THEN 'current' ELSE 'closed' END AS outcome FROM s "
    "UNION ALL SELECT 'price', unit, price, effective_from, effective_to, CASE WHEN effective_to IS NULL THEN 'current' ELSE 'closed' END FROM p UNION ALL SELECT 'command', command, NULL, NULL, NULL, outcome FROM c"
)
def price_change(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    commands = t.orders.select(
        k.alias("command"), F.col("o_custkey").alias("unit"), F.when(k % 13 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 17 == 0, "guess").otherwise("fixed").alias("basis"), F.col("o_orderdate").alias("at"),
    )
    units = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("unit"))
    none = F.lit(None).cast(dict(commands.dtypes)["at"])
    prices = t.customer.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("price"), F.lit("fixed").alias("basis"), F.lit("1990-01-01 00:00:00").cast(dict(commands.dtypes)["at"]).alias("effective_from"), none.alias("effective_to"), F.lit(True).alias("is_current")
    )
    new, outcomes = M.change_prices(prices, units, commands, ["fixed", "from", "indicative", "on_application"])
    held = new.select(F.lit("price").alias("part"), F.col("unit").alias("key"), "price", "effective_from", "effective_to", F.when(F.col("is_current"), "current").otherwise("closed").alias("outcome"))
    return held.unionByName(outcomes.select(F.lit("command").alias("part"), F.col("command").alias("key"), F.lit(None).cast("double").alias("price"), none.alias("effective_from"), none.alias("effective_to"), "outcome"))


_LIFE = "CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'archived' ELSE 'staged' END WHEN o_orderkey % 4 = 0 THEN 'archived' WHEN o_orderkey % 4 = 1 THEN 'staged' ELSE 'active' END"


@query(
    f"WITH i AS (SELECT o_custkey AS org, o_orderkey AS id, o_totalprice AS price, 1 AS upload, {_LIFE} AS lifecycle FROM orders), l AS (SELECT DISTINCT org FROM i WHERE lifecycle = 'active'), "
    "r AS (SELECT *, id % 5 = 0 AS seen, CASE WHEN id % 15 <> 0 THEN price + 1 END AS said FROM i) "
    "SELECT org, id, CASE WHEN seen AND lifecycle <> 'active' THEN coalesce(said, price) ELSE price END AS price, CASE WHEN seen AND lifecycle <> 'active' THEN 2 ELSE 1 END AS upload, "
    "CASE WHEN seen AND lifecycle = 'archived' THEN CASE WHEN org IN (SELECT org FROM l) THEN 'staged' ELSE 'active' END ELSE lifecycle END AS lifecycle, CASE WHEN seen AND lifecycle = 'active' THEN 2 END AS pending_upload, CASE WHEN seen AND lifecycle = 'active' THEN said END AS patch_price FROM r "
    "UNION ALL SELECT org, -id - 1, price, 2, CASE WHEN org IN (SELECT org FROM l) THEN 'staged' ELSE 'active' END, NULL, NULL FROM i WHERE id % 5 = 1"
)
def staged_import(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    items = t.orders.select(
        F.col("o_custkey").alias("org"), k.alias("id"), F.col("o_totalprice").alias("price"), F.lit(1).alias("upload"), F.expr(_LIFE).alias("lifecycle"), F.lit(None).cast("int").alias("pending_upload"), F.lit(None).cast("double").alias("patch_price")
    )
    matched = t.orders.where(k % 5 == 0).select(F.col("o_custkey").alias("org"), k.alias("id"), F.lit(None).cast("long").alias("new_id"), F.when(k % 15 != 0, F.col("o_totalprice") + 1).alias("price"))
    fresh = t.orders.where(k % 5 == 1).select(F.col("o_custkey").alias("org"), F.lit(None).cast("long").alias("id"), (-k - 1).alias("new_id"), F.col("o_totalprice").alias("price"))
    return M.staged_import(items, matched.unionByName(fresh), 2, ["price"])


@query(
    "SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN event_type WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN event_type ELSE 'settled' END AS stage, "
    "CASE WHEN event_id % 3 = 0 AND (event_id % 7 = 0 OR event_id % 4 > 1) THEN 0 ELSE event_id % 9 END AS attempts, event_id % 3 <> 0 AS leased, "
    "CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01' + to_seconds(greatest(event_id % 50 - 10, 0)) ELSE ts END AS next_attempt_at FROM events"
)
def stage_progress(t: Tables) -> DataFrame:
    k, none = F.col("event_id"), F.lit(None).cast("string")
    jobs = t.events.select(k.alias("id"), F.col("event_type").alias("stage"), (k % 9).alias("attempts"), F.col("ts").alias("claim_until"), F.col("ts").alias("next_attempt_at"), none.alias("last_result"), none.alias("last_error"))
    results = t.events.where(k % 3 == 0).select(
        k.alias("id"), F.when(k % 4 == 1, F.col("event_type")).when(k % 4 > 1, "settled").alias("next_stage"), (k % 7 == 0).alias("reset"), (k % 50 - 10).alias("retry_after"), F.lit("done").alias("result"), none.alias("error")
    )
    as_of = F.lit("2024-02-01 00:00:00").cast(dict(jobs.dtypes)["next_attempt_at"])
    return Q.settle(jobs, results, as_of).select("id", "stage", "attempts", F.col("claim_until").isNotNull().alias("leased"), "next_attempt_at")


@query(
    "SELECT event_id AS id, again, CASE WHEN again THEN 'source' ELSE stage END AS stage, CASE WHEN again THEN 0 ELSE event_id % 9 END AS attempts FROM (SELECT *, event_id % 5 > 0 AND stage = 'settled' AND event_id % 6 > 0 "
    "AND ((event_id % 4 = 0) OR (event_id % 4 = 1 AND event_id % 3 < 2) OR (event_id % 4 = 2 AND event_id % 3 = 1)) AS again FROM (SELECT *, CASE WHEN event_id % 7 > 0 THEN 'settled' ELSE 'draw' END AS stage FROM events) s) e"
)
def reopened_jobs(t: Tables) -> DataFrame:
    k = F.col("event_id")
    version = F.concat(F.lit(',"runtime_version":'), (k % 3).cast("string"))
    old = F.when(k % 3 > 0, version).otherwise("")
    branch = (
        F.when(k % 4 == 0, '"a":{"result":"answered"},"b":{"result":"package_recovery_attempt"}')
        .when(k % 4 == 1, F.concat(F.lit('"b":{"result":"package_recovery_attempt"'), version, F.lit("}")))
        .when(k % 4 == 2, F.concat(F.lit('"b":{"result":"no_deterministic_image"'), old, F.lit("}")))
        .otherwise('"b":{"result":"dead_link"}')
    )
    none = F.lit(None)
    jobs = t.events.select(
        k.alias("id"), F.when(k % 5 > 0, "active").otherwise("archived").alias("lifecycle"), F.when(k % 7 > 0, "settled").otherwise("draw").alias("stage"), F.when(k % 6 == 0, k).alias("primary_image"),
        F.concat(F.lit("{"), branch, F.lit("}")).alias("branches"), (k % 9).alias("attempts"), F.col("ts").alias("claim_until"), F.col("ts").alias("next_attempt_at"), none.cast("string").alias("enrichment"),
    )
    new = Q.reopened(jobs, 2, F.lit("2024-02-01 00:00:00").cast(dict(jobs.dtypes)["next_attempt_at"]))
    return new.select("id", F.col("enrichment").isNotNull().alias("again"), "stage", "attempts")
