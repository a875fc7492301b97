"""Permission ladders and access sets over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import access as A
from quillstone.operators.tablefunctions import register_access
from quillstone.plans.aggregates import AS_OF, at
from quillstone.plans.joins import _ACCESS, accessible_customers
from quillstone.registry import ORACLES, Tables, query

_KEYS = "(VALUES ('units', false, 'standard'), ('finance', true, 'standard'), ('network', false, 'inbound_projection'), ('projects', false, 'standard')) AS k(permission, is_forbidden, key_kind)"
_ASKED = "(VALUES ('units'), ('finance'), ('network'), ('projects'), ('typo')) AS a(permission)"
_LEVELS = "(VALUES ('view'), ('edit'), ('delete')) AS l(level)"
_DEFAULTS = (
    "(VALUES ('owner', 'units', true, true, true), ('owner', 'projects', true, true, false), ('owner', 'network', true, true, true), ('owner', 'finance', true, true, true), "
    "('sales', 'units', true, true, false), ('sales', 'projects', true, false, false), ('read_only', 'units', true, true, true), ('read_only', 'network', true, false, false)) "
    "AS d(role, permission, can_view, can_edit, can_delete)"
)
_ROLE = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'owner' WHEN 'BUILDING' THEN 'sales' WHEN 'MACHINERY' THEN 'read_only' ELSE 'guest' END"
_MEMBERS = f"(SELECT c_custkey AS \"user\", c_nationkey AS org, c_custkey * 10 AS membership_id, {_ROLE} AS role FROM customer WHERE c_acctbal >= 0)"
_OVERRIDES = (
    "(SELECT c_custkey * 10 AS membership_id, 'units' AS permission, CASE WHEN c_custkey % 7 = 0 THEN 'deny' ELSE 'inherit' END AS view_decision, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'allow' ELSE 'inherit' END AS edit_decision, CASE WHEN c_custkey % 3 = 0 THEN 'allow' ELSE 'deny' END AS delete_decision FROM customer WHERE c_custkey % 2 = 1)"
)
_DECISION = "CASE level WHEN 'view' THEN view_decision WHEN 'edit' THEN edit_decision ELSE delete_decision END"
_LADDER = (
    "CASE WHEN is_forbidden IS NULL OR is_forbidden THEN false WHEN key_kind = 'inbound_projection' AND level <> 'view' THEN false WHEN m.membership_id IS NULL THEN false "
    f"WHEN {_DECISION} = 'deny' THEN false WHEN m.role = 'read_only' AND level <> 'view' THEN false WHEN {_DECISION} = 'allow' THEN true "
    "ELSE coalesce(CASE level WHEN 'view' THEN can_view WHEN 'edit' THEN can_edit ELSE can_delete END, false) END"
)


def _sql(t: Tables, text: str) -> DataFrame:
    t.customer.createOrReplaceTempView("customer")
    return t.spark.sql(f"SELECT * FROM {text}".replace('"user"', "`user`"))


def _frames(t: Tables) -> list[DataFrame]:
    return [_sql(t, text) for text in (_KEYS, _MEMBERS + " AS m", _DEFAULTS, _OVERRIDES + " AS o")]


@query(
    f"SELECT c_custkey AS \"user\", a.permission, level, {_LADDER} AS allowed FROM customer CROSS JOIN {_ASKED} CROSS JOIN {_LEVELS} LEFT JOIN {_KEYS} ON k.permission = a.permission "
    f"LEFT JOIN {_MEMBERS} m ON m.\"user\" = c_custkey AND m.org = c_nationkey LEFT JOIN {_DEFAULTS} ON d.role = m.role AND d.permission = a.permission "
    f"LEFT JOIN {_OVERRIDES} o ON o.membership_id = m.membership_id AND o.permission = a.permission"
)
def permission_ladder(t: Tables) -> DataFrame:
    asked = t.customer.select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("org"))
    # Two literal frames of a fixed few rows.
    asked = asked.crossJoin(F.broadcast(_sql(t, _ASKED))).crossJoin(F.broadcast(_sql(t, _LEVELS)))
    return A.organisation_permission(asked, *_frames(t)).select("user", "permission", "level", "allowed")


_GRANTED = (
    f"o_orderdate <= TIMESTAMP '{AS_OF}' AND o_orderdate + INTERVAL 1000 DAY > TIMESTAMP '{AS_OF}' AND o_orderpriority <> '5-LOW'"
)


# A membership's own decision for a project, for each level.
_BY_PROJECT = {x: f"CASE WHEN o_orderkey % 17 = {n} THEN 'deny' WHEN o_orderkey % 19 = {n} THEN 'allow' ELSE 'inherit' END" for n, x in enumerate(("view", "edit", "delete"))}
_PROJECT = "CASE level " + " ".join(f"WHEN '{x}' THEN {d}" for x, d in _BY_PROJECT.items()) + " END"


@query(
    f"SELECT o_orderkey AS project, level FROM orders JOIN customer ON o_custkey = c_custkey JOIN {_MEMBERS} m ON m.\"user\" = c_custkey AND m.org = c_nationkey CROSS JOIN {_LEVELS} JOIN {_KEYS} ON k.permission = 'units' "
    f"LEFT JOIN {_DEFAULTS} ON d.role = m.role AND d.permission = 'units' LEFT JOIN {_OVERRIDES} o ON o.membership_id = m.membership_id "
    f"WHERE {_GRANTED} AND CASE WHEN {_PROJECT} = 'deny' OR (level = 'view' AND o_orderkey % 11 = 0) THEN false WHEN o_orderkey % 23 = 0 AND level <> 'view' THEN false "
    f"WHEN {_PROJECT} = 'allow' OR (level = 'view' AND o_orderkey % 13 = 0) THEN true ELSE {_LADDER} END"
)
def accessible_entities(t: Tables) -> DataFrame:
    return _granted(t).select("project", "level")


def _granted(t: Tables) -> DataFrame:
    """user, project and level of what users may see, edit and delete."""
    orders = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    until = F.col("o_orderdate") + F.expr("INTERVAL 1000 DAYS")
    json = F.when(F.col("o_orderkey") % 11 == 0, '{"units":{"view":"deny"}}').when(F.col("o_orderkey") % 13 == 0, '{"units":{"view":"allow"}}').otherwise("{}")
    grants = orders.select(
        F.col("c_custkey").alias("user"), F.col("o_orderkey").alias("project"), F.col("c_nationkey").alias("org"), F.col("o_orderdate").alias("valid_from"), until.alias("valid_until"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("revoked_at"), F.when(F.col("o_orderkey") % 23 == 0, "read_only").otherwise("editor").alias("access_role"), json.alias("permissions"),
    )
    asked = orders.select(F.col("c_custkey").alias("user"), F.col("o_orderkey").alias("project"), F.lit("units").alias("permission")).crossJoin(F.broadcast(_sql(t, _LEVELS)))
    by_project = orders.select((F.col("c_custkey") * 10).alias("membership_id"), F.col("o_orderkey").alias("project"), F.lit("units").alias("permission"), *[F.expr(d).alias(f"{x}_decision") for x, d in _BY_PROJECT.items()])
    keys, members, defaults, overrides = _frames(t)
    return A.project_permission(asked, grants, keys, members, defaults, overrides, by_project, at(AS_OF)).where("allowed").select("user", "project", "level")


@query("SELECT c_custkey, count(project) AS editable FROM customer LEFT JOIN (SELECT o_custkey, project FROM (" + ORACLES["accessible_entities"] + ") a JOIN orders ON o_orderkey = project WHERE level = 'edit') x ON o_custkey = c_custkey GROUP BY c_custkey")
def access_function(t: Tables) -> DataFrame:
    """The access set of every customer by a table function of SQL, joined laterally."""
    register_access(t.spark, "accessible_projects", _granted(t), "user", "project")
    return t.spark.sql("SELECT c_custkey, count(p.project) AS editable FROM {customers} LEFT JOIN LATERAL accessible_projects(c_custkey, 'edit') AS p ON true GROUP BY c_custkey", customers=t.customer)


@query(
    "SELECT d.doc_id, coalesce(g.mine, true) AS visible FROM documents d LEFT JOIN (SELECT doc_id, bool_or(doc_id % 3 = 0) AS mine FROM labels WHERE toxic = 1 GROUP BY doc_id) g ON d.doc_id = g.doc_id"
)
def restricted_documents(t: Tables) -> DataFrame:
    grants = t.labels.where("toxic = 1").select("doc_id", (F.col("doc_id") % 3).alias("grantee"))
    return A.open_or_granted(t.documents.select("doc_id"), "doc_id", grants, F.lit(0))


@query(
    f"SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('signup', 'purchase', 'error') AND user_id IN {_ACCESS} ORDER BY ts DESC NULLS LAST, event_id LIMIT 100"
)
def visible_activity(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), "ts")
    types = t.spark.sql("SELECT * FROM VALUES ('signup'), ('purchase'), ('error') AS v(entity_type)")
    seen = A.visible_activity(rows, types, accessible_customers(t).withColumnRenamed("c_custkey", "entity_id"))
    return seen.orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(100).select("event_id", F.col("entity_type").alias("event_type"), F.col("entity_id").alias("user_id"))


_TYPES = [*A.GOVERNED, "organisation", "membership"]
_KINDS = ", ".join(f"({k}, '{t}', '{A.GOVERNED[t][0]}', '{A.GOVERNED[t][1]}')" if t in A.GOVERNED else f"({k}, '{t}', NULL, NULL)" for k, t in enumerate(_TYPES))
_REACHED = sorted(set(A.GOVERNED.values()))


@query(
    f"WITH k(n, entity_type, scope_type, permission) AS (VALUES {_KINDS}), reach AS (SELECT scope_type, permission, c_custkey AS scope_id FROM customer, (VALUES "
    + ", ".join(f"({i}, '{s}', '{p}')" for i, (s, p) in enumerate(_REACHED))
    + ") r(i, scope_type, permission) WHERE (c_custkey + i) % 3 = 0) "
    f"SELECT event_id, entity_type FROM (SELECT event_id, k.*, CASE WHEN entity_type = scope_type THEN user_id WHEN user_id % 11 > 0 AND c_custkey IS NOT NULL THEN user_id * 7 % 1000 END AS scope_id FROM events JOIN k ON k.n = event_id % {len(_TYPES)} LEFT JOIN customer ON c_custkey = user_id) e "
    "WHERE EXISTS (SELECT 1 FROM reach r WHERE r.scope_type = e.scope_type AND r.permission = e.permission AND r.scope_id = e.scope_id)"
)
def governed_activity(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    activity = t.events.select("event_id", kind.alias("entity_type"), F.col("user_id").alias("entity_id"))
    below = F.array(*[F.lit(x) for x, (scope, _) in A.GOVERNED.items() if x != scope])
    parents = t.customer.where("c_custkey % 11 > 0").select(F.explode(below).alias("entity_type"), F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") * 7 % 1000).alias("parent_id"))
    reached = F.array(*(F.struct(F.lit(s).alias("scope_type"), F.lit(p).alias("permission"), F.lit(i).alias("i")) for i, (s, p) in enumerate(_REACHED)))
    reach = t.customer.select(F.col("c_custkey").alias("scope_id"), F.inline(reached)).where((F.col("scope_id") + F.col("i")) % 3 == 0).drop("i")
    return A.governed_activity(activity, parents, reach).select("event_id", "entity_type")


_SCOPED = "(SELECT c_custkey * 10 AS membership_id, CASE c_custkey % 3 WHEN 0 THEN 'stage' WHEN 1 THEN 'unit' ELSE 'elsewhere' END AS scope_type, c_custkey % 5 AS scope_id, CASE WHEN c_custkey % 2 = 0 THEN 'deny' ELSE 'allow' END AS decision FROM customer)"


@query(
    f"SELECT o_orderkey, m.membership_id IS NOT NULL AND coalesce(can_view, false) AND coalesce(view_decision, '') <> 'deny' AND coalesce(s.decision, '') <> 'deny' AS allowed FROM orders JOIN customer ON o_custkey = c_custkey "
    f"LEFT JOIN {_MEMBERS} m ON m.\"user\" = c_custkey AND m.org = c_nationkey LEFT JOIN {_DEFAULTS} ON d.role = m.role AND d.permission = 'units' LEFT JOIN {_OVERRIDES} o ON o.membership_id = m.membership_id "
    f"LEFT JOIN {_SCOPED} s ON s.membership_id = m.membership_id AND ((s.scope_type = 'stage' AND o_orderkey % 2 = 0 AND s.scope_id = o_orderkey % 5) OR (s.scope_type = 'unit' AND s.scope_id = o_orderkey % 7))"
)
def unit_permissions(t: Tables) -> DataFrame:
    orders = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    asked = orders.select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("org"), F.lit("units").alias("permission"), F.lit("view").alias("level"), "o_orderkey", F.when(k % 2 == 0, k % 5).alias("stage"), (k % 7).alias("unit"))
    parent = A.organisation_permission(asked, *_frames(t))
    decisions = _sql(t, _SCOPED + " AS s").select("membership_id", F.lit("units").alias("permission"), "scope_type", "scope_id", *[F.col("decision").alias(f"{x}_decision") for x in ("view", "edit", "delete")])
    return A.narrowed(parent, decisions, {"stage": "stage", "unit": "unit"}).select("o_orderkey", "allowed")


@query(
    "SELECT event_id, kind FROM (SELECT event_id, user_id, event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN 'project' WHEN 1 THEN 'unit' WHEN 2 THEN 'transaction' WHEN 3 THEN 'construction_case' ELSE 'elsewhere' END AS kind FROM events) e "
    f"WHERE (k = 0 AND user_id IN {_ACCESS}) OR (k = 1 AND user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) OR (k = 2 AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) OR (k = 3 AND user_id IN (SELECT p_partkey FROM part WHERE p_size > 25))"
)
def scope_dispatch(t: Tables) -> DataFrame:
    kinds = ["project", "unit", "transaction", "construction_case", "elsewhere"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = t.events.select("event_id", kind.alias("scope_type"), F.col("user_id").alias("scope_id"))
    of = lambda df, key: df.select(F.col(key).alias("scope_id"))
    reach = [of(accessible_customers(t), "c_custkey"), of(t.supplier.where("s_acctbal > 0"), "s_suppkey"), of(t.orders.where("o_orderstatus = 'P'"), "o_custkey"), of(t.part.where("p_size > 25"), "p_partkey")]
    return A.dispatched(rows, dict(zip(kinds, reach))).select("event_id", F.col("scope_type").alias("kind"))


@query(
    "WITH c AS (SELECT o_orderkey AS command, o_custkey AS connection, CASE o_orderkey % 4 WHEN 0 THEN 'stock:read' WHEN 1 THEN 'documents:share' WHEN 2 THEN 'aml:reliance' ELSE 'typo' END AS scope, o_orderkey % 3 > 0 AS given FROM orders), "
    "j AS (SELECT c.*, c_mktsegment, max(command) OVER (PARTITION BY connection, scope) AS last, scope <> 'typo' AND (connection + length(scope)) % 2 = 0 AS held FROM c LEFT JOIN customer ON c_custkey = connection AND c_custkey % 9 > 0) "
    "SELECT command, CASE WHEN c_mktsegment IS NULL THEN 'CONNECTION_NOT_FOUND' WHEN c_mktsegment = 'BUILDING' THEN 'CONNECTION_NOT_ACTIVE' WHEN scope = 'typo' THEN 'UNKNOWN_SCOPE' WHEN command < last THEN 'SUPERSEDED' WHEN given AND held THEN 'ALREADY_GRANTED' WHEN given THEN 'GRANTED' WHEN held THEN 'REVOKED' ELSE 'NOT_GRANTED' END AS outcome FROM j"
)
def scope_grants(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    scope = F.when(k % 4 == 0, "stock:read").when(k % 4 == 1, "documents:share").when(k % 4 == 2, "aml:reliance").otherwise("typo")
    commands = t.orders.select(k.alias("command"), F.col("o_custkey").alias("connection"), F.when(k % 3 > 0, "grant").otherwise("revoke").alias("operation"), scope.alias("scope"))
    connections = t.customer.where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("connection"), F.when(F.col("c_mktsegment") == "BUILDING", "revoked").otherwise("active").alias("state"))
    keys = t.spark.sql("SELECT * FROM VALUES ('stock:read'), ('documents:share'), ('aml:reliance') AS v(scope)")
    grants = commands.select("connection", "scope").distinct().where((F.col("scope") != "typo") & ((F.col("connection") + F.length("scope")) % 2 == 0))
    return A.scope_commands(connections, grants, commands, keys)[1]
