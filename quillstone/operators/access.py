"""Permission ladders and accessible sets, resolved for whole frames of requests at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import live


def _by_level(level: str, view: str, edit: str, delete: str) -> Column:
    return F.when(F.col(level) == "view", F.col(view)).when(F.col(level) == "edit", F.col(edit)).otherwise(F.col(delete))


def organisation_permission(requests: DataFrame, keys: DataFrame, memberships: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """requests (user, org, permission, level and whatever else) with allowed, role and membership_id.

    In order: an unknown or forbidden key is denied; an inbound projection is never written; without a live membership
    there is no access; the role's default is the base, missing means no; the membership's own decision denies or raises
    it; read_only never writes.
    """
    # A membership decides each of the few keys once, so its decisions travel with it: a join by its id would bring all requests without one together.
    decided = overrides.where("membership_id IS NOT NULL").groupBy("membership_id").agg(F.collect_list(F.struct("permission", "view_decision", "edit_decision", "delete_decision")).alias("_decided"))
    held = memberships.select("user", "org", "membership_id", "role").join(decided, "membership_id", "left")
    ladder = (
        requests.join(keys.select("permission", "is_forbidden", "key_kind"), "permission", "left")
        .join(held, ["user", "org"], "left")
        .join(defaults.select("role", "permission", "can_view", "can_edit", "can_delete"), ["role", "permission"], "left")
        .withColumn("_decision", F.explode_outer(F.filter("_decided", lambda d: d["permission"] == F.col("permission"))))
        .select("*", "_decision.view_decision", "_decision.edit_decision", "_decision.delete_decision")
    )
    decision = _by_level("level", "view_decision", "edit_decision", "delete_decision")
    allowed = (
        F.when(F.col("is_forbidden").isNull() | F.col("is_forbidden"), False)
        .when((F.col("key_kind") == "inbound_projection") & (F.col("level") != "view"), False)
        .when(F.col("membership_id").isNull(), False)
        .when(decision == "deny", False)
        .when((F.col("role") == "read_only") & (F.col("level") != "view"), False)
        .when(decision == "allow", True)
        .otherwise(F.coalesce(_by_level("level", "can_view", "can_edit", "can_delete"), F.lit(False)))
    )
    return ladder.select(*requests.columns, "membership_id", "role", "is_forbidden", allowed.alias("allowed"))


def project_permission(requests: DataFrame, grants: DataFrame, keys: DataFrame, memberships: DataFrame, defaults: DataFrame, overrides: DataFrame, project_overrides: DataFrame, as_of: Column) -> DataFrame:
    """requests (user, project, permission, level) with allowed.

    A live grant comes first, then a live membership of the granting organisation, which nothing can replace; then the
    organisation's answer, the membership's decision for the project, and the grant's own; a forbidden or unknown key is
    denied whatever these say, and a read_only grant never writes.
    """
    held = grants.where(live(F.col("valid_from"), F.col("valid_until"), as_of, F.col("revoked_at"))).select("user", "project", "org", "access_role", "permissions")
    asked = requests.join(held, ["user", "project"], "left")
    base = organisation_permission(asked, keys, memberships, defaults, overrides)
    scoped = project_overrides.select("membership_id", "project", "permission", F.col("view_decision").alias("v"), F.col("edit_decision").alias("e"), F.col("delete_decision").alias("d"))
    ladder = base.join(scoped, ["membership_id", "project", "permission"], "left")
    by_project = _by_level("level", "v", "e", "d")
    by_grant = F.from_json("permissions", "map<string,map<string,string>>")[F.col("permission")][F.col("level")]
    allowed = (
        F.when(F.col("access_role").isNull() | F.col("membership_id").isNull(), False)
        .when((by_project == "deny") | (by_grant == "deny"), False)
        .when(F.col("is_forbidden").isNull() | F.col("is_forbidden"), False)
        .when((F.col("access_role") == "read_only") & (F.col("level") != "view"), False)
        .when((by_project == "allow") | (by_grant == "allow"), True)
        .otherwise(F.col("allowed"))
    )
    return ladder.select(*requests.columns, allowed.alias("allowed"))


def open_or_granted(items: DataFrame, key: str, grants: DataFrame, caller) -> DataFrame:
    """Items with visible: an item with any live grant is open to those who hold one only, one without to everybody."""
    held = grants.groupBy(key).agg(F.bool_or(F.col("grantee") == caller).alias("_mine"))
    return items.join(held, key, "left").withColumn("visible", F.coalesce("_mine", F.lit(True))).drop("_mine")


def visible_activity(activity: DataFrame, allowed_types: DataFrame, parents: DataFrame) -> DataFrame:
    """Activity of an allow-listed entity type whose parent is accessible."""
    return activity.join(allowed_types.select("entity_type"), "entity_type", "left_semi").join(parents.select("entity_id"), "entity_id", "left_semi")


# The entity types whose activity can be seen, each with what governs it and the permission asked there.
GOVERNED = {
    "project": ("project", "projects"),
    "project_party": ("project", "projects"),
    "stage": ("project", "inventory"),
    "building": ("project", "inventory"),
    "lot": ("project", "inventory"),
    "unit": ("unit", "inventory"),
    "unit_price": ("unit", "pricing"),
    "unit_hold": ("unit", "inventory"),
    "reservation": ("unit", "reservations"),
    "allocation": ("unit", "inventory"),
    "transaction": ("transaction", "transactions"),
    "transaction_party": ("transaction", "transactions"),
    "construction_case": ("construction_case", "construction"),
    "construction_stage": ("construction_case", "construction"),
    "milestone": ("construction_case", "construction"),
    "progress_update": ("construction_case", "construction"),
    "photograph": ("construction_case", "construction"),
    "variation": ("construction_case", "construction"),
    "variation_approval": ("construction_case", "construction"),
    "progress_claim": ("construction_case", "construction"),
    "inspection": ("construction_case", "construction"),
    "defect": ("construction_case", "construction"),
    "practical_completion": ("construction_case", "construction"),
    "handover": ("construction_case", "construction"),
    "warranty_claim": ("construction_case", "construction"),
    "document": ("document", "documents"),
    "document_version": ("document", "documents"),
    "conversation": ("conversation", "messages"),
    "message": ("conversation", "messages"),
    "task": ("task", "tasks"),
    "task_assignment": ("task", "tasks"),
}


def governed_activity(activity: DataFrame, parents: DataFrame, reach: DataFrame) -> DataFrame:
    """Activity (entity_type, entity_id) of the entities whose governing record the caller reaches under its permission.

    parents: entity_type, entity_id and parent_id of entities that something else governs; without a parent they are
    seen by nobody, as are types that GOVERNED leaves out. reach: scope_type, permission and scope_id. Both may have many
    rows for each record of a small table, of whose size a plan knows nothing, so neither is sent whole to the driver.
    """
    kinds = activity.sparkSession.createDataFrame([(k, *v) for k, v in GOVERNED.items()], "entity_type string, scope_type string, permission string")
    known = activity.join(F.broadcast(kinds), "entity_type")
    own = known.where("entity_type = scope_type").withColumn("scope_id", F.col("entity_id"))
    below = known.where("entity_type <> scope_type").join(parents.select("entity_type", "entity_id", F.col("parent_id").alias("scope_id")).hint("merge"), ["entity_type", "entity_id"])
    return own.unionByName(below).join(reach.hint("merge"), ["scope_type", "permission", "scope_id"], "left_semi").select(activity.columns)


def narrowed(resolved: DataFrame, decisions: DataFrame, scopes: Mapping[str, str]) -> DataFrame:
    """resolved (membership_id, permission, level, allowed and the scopes' ids) with what narrower scopes deny taken away.

    decisions: membership_id, permission, scope_type, scope_id and a decision for each level. ``scopes`` names the id
    column of each scope type that lies below what was resolved, the widest first. None of them can open what the
    parent withholds, so only a denial counts; a row without an id in a scope is not judged by it.
    """
    held = decisions.select("membership_id", "permission", "scope_type", "scope_id", F.col("view_decision").alias("_v"), F.col("edit_decision").alias("_e"), F.col("delete_decision").alias("_d"))
    out = resolved
    for scope, column in scopes.items():
        own = held.where(F.col("scope_type") == scope).drop("scope_type").withColumnRenamed("scope_id", column)
        denied = F.coalesce(_by_level("level", "_v", "_e", "_d") == "deny", F.lit(False))
        # What has no membership or no id is dealt by its other columns, as nothing is joined to it.
        lacking = lambda: F.col("membership_id").isNull() | F.col(column).isNull()
        apart = out.withColumn("_apart", F.when(lacking(), F.xxhash64(*out.columns)).otherwise(0))
        own = own.withColumn("_apart", F.when(lacking(), -1).otherwise(0).cast("long"))
        out = apart.join(own, ["membership_id", "permission", column, "_apart"], "left").select(*[(F.col("allowed") & ~denied).alias("allowed") if c == "allowed" else F.col(c) for c in out.columns])
    return out


def dispatched(rows: DataFrame, accessible: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (scope_type, scope_id) that are as reachable as what they are attached to; an unknown scope type reaches nothing.

    accessible: for each scope type a frame with the scope_id of what the caller reaches. One semi-join serves all types.
    """
    reach = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("scope_type"), "scope_id") for kind, df in accessible.items()])
    return rows.join(reach, ["scope_type", "scope_id"], "left_semi")


def scope_commands(connections: DataFrame, grants: DataFrame, commands: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new grants, outcomes) of commands (command, connection, operation grant or revoke, scope).

    Scopes move only on active connections; granting what is granted and revoking what isn't changes nothing. Of several
    commands for a connection's scope the last one counts, the others are SUPERSEDED.
    """
    held = grants.select("connection", "scope", F.lit(True).alias("_held"))
    known = keys.select("scope", F.lit(True).alias("_known"))
    last = F.max("command").over(Window.partitionBy("connection", "scope"))
    joined = commands.withColumn("_last", last).join(connections.select("connection", "state"), "connection", "left").join(known, "scope", "left").join(held, ["connection", "scope"], "left")
    grant = F.col("operation") == "grant"
    outcome = (
        F.when(F.col("state").isNull(), "CONNECTION_NOT_FOUND")
        .when(F.col("state") != "active", "CONNECTION_NOT_ACTIVE")
        .when(F.col("_known").isNull(), "UNKNOWN_SCOPE")
        .when(F.col("command") < F.col("_last"), "SUPERSEDED")
        .when(grant, F.when(F.col("_held"), "ALREADY_GRANTED").otherwise("GRANTED"))
        .otherwise(F.when(F.col("_held"), "REVOKED").otherwise("NOT_GRANTED"))
    )
    judged = joined.withColumn("outcome", outcome)
    moved = lambda what: judged.where(F.col("outcome") == what).select("connection", "scope")
    new = grants.select("connection", "scope").join(moved("REVOKED"), ["connection", "scope"], "left_anti").unionByName(moved("GRANTED"))
    return new, judged.select("command", "outcome")
