"""Transitions, commands, patches and publication over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import lifecycle as L
from quillstone.operators import merge as M
from quillstone.registry import Tables, query

_PAIRS = ", ".join(f"('{m}', '{a}', '{b}')" for m, steps in L.TRANSITIONS.items() for a, after in steps.items() for b in after.split())
_STATUSES = ", ".join(f"('{m}', '{s}')" for m in L.TRANSITIONS for s in L.statuses(m))
_UNIT = ", ".join(f"('{a}', '{b}')" for a, after in L.TRANSITIONS["unit"].items() for b in after.split())
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'P' THEN 'reserved' ELSE 'contracted' END"


@query(
    f"SELECT a.machine, a.status AS from_status, b.status AS to_status, p.machine IS NOT NULL AS allowed FROM (VALUES {_STATUSES}) a(machine, status) JOIN (VALUES {_STATUSES}) b(machine, status) ON a.machine = b.machine "
    f"LEFT JOIN (VALUES {_PAIRS}) p(machine, f, s) ON p.machine = a.machine AND p.f = a.status AND p.s = b.status"
)
def transition_allowed(t: Tables) -> DataFrame:
    all_statuses = t.spark.sql(f"SELECT * FROM VALUES {_STATUSES} AS v(machine, from_status)")
    pairs = t.spark.sql(f"SELECT *, true AS held FROM VALUES {_PAIRS} AS v(machine, from_status, to_status)")
    both = all_statuses.join(all_statuses.withColumnRenamed("from_status", "to_status"), "machine")
    return both.join(pairs, ["machine", "from_status", "to_status"], "left").select("machine", "from_status", "to_status", F.coalesce("held", F.lit(False)).alias("allowed"))


@query(
    f"SELECT o_custkey, o_orderkey, from_status, to_status FROM (SELECT o_custkey, o_orderkey, {_STATUS} AS to_status, lag({_STATUS}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_status FROM orders) x "
    f"WHERE from_status IS NOT NULL AND from_status <> to_status AND NOT EXISTS (SELECT 1 FROM (VALUES {_UNIT}) p(f, s) WHERE p.f = from_status AND p.s = to_status)"
)
def transition_audit(t: Tables) -> DataFrame:
    history = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.expr(_STATUS).alias("status"))
    return L.audit(history, "o_custkey", ["o_orderdate", "o_orderkey"], "unit").select("o_custkey", "o_orderkey", "from_status", "to_status")


_COMMANDS = (
    "SELECT o_orderkey + CASE WHEN o_orderkey % 41 = 0 THEN 100000000 ELSE 0 END AS id, o_orderkey AS sequence, o_orderkey % 4 AS expected_version, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'available' ELSE 'reserved' END AS from_status, CASE WHEN o_orderkey % 5 < 3 THEN 'on_hold' WHEN o_orderkey % 5 = 3 THEN 'contracted' ELSE 'withdrawn' END AS to_status, "
    "CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'because' END AS reason FROM orders WHERE o_orderkey % 3 = 0"
)
_OUTCOME = (
    "CASE WHEN trim(c.reason) = '' THEN 'REASON_REQUIRED' WHEN p.f IS NULL THEN 'NOT_ALLOWED' WHEN s.id IS NULL THEN 'NOT_FOUND' WHEN s.row_version <> c.expected_version THEN 'STALE_VERSION' "
    "WHEN s.status <> c.from_status THEN 'STALE_STATUS' ELSE 'APPLIED' END"
)


@query(
    f"SELECT c.id, {_OUTCOME} AS outcome, CASE WHEN {_OUTCOME} = 'APPLIED' THEN c.to_status ELSE s.status END AS new_status, CASE WHEN {_OUTCOME} = 'APPLIED' THEN s.row_version + 1 ELSE s.row_version END AS new_version FROM ({_COMMANDS}) c "
    f"LEFT JOIN (SELECT o_orderkey AS id, {_STATUS} AS status, o_orderkey % 5 AS row_version FROM orders) s ON s.id = c.id LEFT JOIN (VALUES {_UNIT}) p(f, s) ON p.f = c.from_status AND p.s = c.to_status"
)
def transition_apply(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    state = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_STATUS).alias("status"), (F.col("o_orderkey") % 5).alias("row_version"))
    new, _, outcomes = L.apply_commands(state, t.spark.sql(_COMMANDS), "unit")
    return outcomes.select("id", "outcome").join(new, "id", "left").select("id", "outcome", F.col("status").alias("new_status"), F.col("row_version").alias("new_version"))


_HOLDS = (
    "SELECT o_orderkey AS id, o_custkey AS sequence, o_orderkey % 3 AS expected_version, 'active' AS from_status, CASE o_orderkey % 4 WHEN 0 THEN 'contracted' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'expired' ELSE 'active' END AS to_status, "
    "o_orderpriority AS reason, o_orderdate AS at FROM orders"
)


@query(
    "SELECT o_orderkey AS id, 'active' AS from_status, CASE o_orderkey % 4 WHEN 0 THEN 'contracted' WHEN 1 THEN 'cancelled' ELSE 'expired' END AS to_status, o_orderpriority AS reason, o_orderdate AS closed_at, o_orderkey % 2 + 1 AS row_version FROM orders "
    "WHERE o_orderkey % 4 < 3 AND o_orderkey % 2 = o_orderkey % 3 AND o_orderstatus <> 'F'"
)
def transition_history(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    k = F.col("o_orderkey")
    state = t.orders.select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "lapsed").otherwise("active").alias("status"), (k % 2).alias("row_version"), F.lit(None).cast(dict(t.orders.dtypes)["o_orderdate"]).alias("closed_at"))
    new, history, _ = L.apply_commands(state, t.spark.sql(_HOLDS), "reservation")
    return history.drop("at").join(new.select("id", "closed_at", "row_version"), "id")


@query(
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN 'new ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 4 < 2 THEN 2 + p_partkey % 4 ELSE 2 END::BIGINT AS version FROM part WHERE p_partkey % 5 > 0 "
    "UNION ALL SELECT p_partkey, 'new ' || p_name, (1 + p_partkey % 4)::BIGINT FROM part WHERE p_partkey % 5 = 0"
)
def upsert_seeds(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    held = t.part.where(k % 5 > 0).select(k.alias("id"), F.col("p_name").alias("name"), F.lit(2).cast("long").alias("version"))
    version = F.when((k % 5 > 0) & (k % 4 < 2), 2 + k % 4).when(k % 5 > 0, 1).otherwise(1 + k % 4)
    return M.upsert_latest(held, t.part.select(k.alias("id"), F.concat(F.lit("new "), "p_name").alias("name"), version.cast("long").alias("version")), ["id"], "version")


@query(
    "SELECT o_orderkey AS id, CASE WHEN best IS NULL THEN NULL ELSE best END AS primary_part, o_orderkey % 3 <> 0 OR best IS NOT NULL AS changed FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey AS best FROM "
    "(SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_returnflag <> 'R') x WHERE rn = 1) b ON l_orderkey = o_orderkey"
)
def primary_write_back(t: Tables) -> DataFrame:
    parents = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(-1)).cast("long").alias("primary_part"))
    order = F.struct((-F.col("l_extendedprice")).alias("price"), "l_linenumber", "l_partkey")
    best = t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_partkey", order).alias("best"))
    return M.write_back(parents, best, "id", "primary_part", "best")


_ITEMS = (
    "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS upload, o_totalprice AS price, CASE WHEN year(o_orderdate) = 2000 THEN 'staged' WHEN year(o_orderdate) > 2000 THEN 'archived' ELSE 'active' END AS lifecycle, "
    "CASE WHEN year(o_orderdate) = 1998 AND o_orderkey % 4 = 0 THEN 2000 END AS pending_upload, CASE WHEN o_orderkey % 8 <> 0 THEN 1.0 * o_orderkey END AS patch_price FROM orders"
)


def _items(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(_ITEMS).withColumn("patch_price", F.col("patch_price").cast("double"))


@query(
    "SELECT id, price, upload, CASE WHEN upload = 2000 AND lifecycle = 'staged' THEN 'active' WHEN upload = 1998 AND lifecycle = 'active' THEN 'archived' ELSE lifecycle END AS lifecycle FROM "
    f"(SELECT id, CAST(CASE WHEN pending_upload = 2000 THEN coalesce(patch_price, price) ELSE price END AS DOUBLE) AS price, CASE WHEN pending_upload = 2000 THEN 2000 ELSE upload END AS upload, lifecycle FROM ({_ITEMS}) i) x"
)
def staged_publish(t: Tables) -> DataFrame:
    return M.publish(_items(t), 2000, [1998, 2000], ["price"]).select("id", "price", "upload", "lifecycle")


@query(
    f"SELECT id, CAST(coalesce(patch_price, price) AS DOUBLE) AS price, CASE WHEN id % 6 = 0 THEN 'sold' ELSE lifecycle END AS lifecycle FROM ({_ITEMS}) i"
)
def non_erasing_patch(t: Tables) -> DataFrame:
    base = _items(t).select("id", "price", "lifecycle")
    patch = _items(t).select("id", F.col("patch_price").alias("price"), F.when(F.col("id") % 6 == 0, "sold").when(F.col("id") % 6 == 1, "unknown").alias("lifecycle"))
    return M.non_erasing_patch(base, patch, "id", ["price", "lifecycle"], {"lifecycle": "unknown"})


@query(f"SELECT upload, count(*) FILTER (WHERE upload = 1997 AND lifecycle <> 'archived') AS archived_now, count(*) FILTER (WHERE upload <> 1997 AND lifecycle <> 'archived') AS retained FROM ({_ITEMS}) i GROUP BY upload")
def archive_on_delete(t: Tables) -> DataFrame:
    before = _items(t).select("id", "upload", F.col("lifecycle").alias("was"))
    after = M.archive_source(_items(t).select("id", "upload", "lifecycle"), 1997).select("id", "lifecycle")
    both = before.join(after, "id")
    return both.groupBy("upload").agg(
        F.count_if((F.col("was") != "archived") & (F.col("lifecycle") == "archived")).alias("archived_now"), F.count_if(F.col("lifecycle") != "archived").alias("retained")
    )


@query(
    "SELECT o_custkey AS c_custkey, 'orders' AS dependent, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'lines', count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 "
    "UNION ALL SELECT user_id, 'events', count(*) FROM events JOIN customer ON user_id = c_custkey GROUP BY 1"
)
def delete_blockers(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return M.blockers(t.customer, "c_custkey", {"orders": orders, "lines": lines, "events": t.events.select(F.col("user_id").alias("c_custkey"))})
