"""State machines: allow-lists of transitions, and commands applied to versioned state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# For each machine the statuses that may follow a status. Statuses without an entry are terminal.
TRANSITIONS: dict[str, dict[str, str]] = {
    "project": {
        "planning": "pre_sales approved on_hold cancelled",
        "pre_sales": "approved planning on_hold cancelled",
        "approved": "under_construction pre_sales on_hold cancelled",
        "under_construction": "practical_completion on_hold cancelled",
        "practical_completion": "handover under_construction on_hold cancelled",
        "handover": "completed practical_completion on_hold cancelled",
        "on_hold": "planning pre_sales approved under_construction cancelled",
    },
    "unit": {
        "available": "on_hold reserved withdrawn",
        "on_hold": "available reserved withdrawn",
        "reserved": "available contracted withdrawn",
        "contracted": "settled available",
        "withdrawn": "available",
    },
    "reservation": {"active": "contracted cancelled expired lapsed"},
    "transaction": {
        "lead": "reserved contract_issued cancelled lapsed",
        "reserved": "contract_issued lead cancelled lapsed",
        "contract_issued": "contract_signed reserved cancelled lapsed",
        "contract_signed": "unconditional contract_issued cancelled lapsed",
        "unconditional": "construction practical_completion settled cancelled lapsed",
        "construction": "practical_completion unconditional cancelled lapsed",
        "practical_completion": "settled construction cancelled lapsed",
    },
    "construction": {
        "not_started": "site_preparation cancelled",
        "site_preparation": "under_construction on_hold cancelled",
        "under_construction": "practical_completion on_hold cancelled",
        "practical_completion": "handover under_construction cancelled",
        "handover": "completed practical_completion cancelled",
        "on_hold": "site_preparation under_construction cancelled",
    },
    "milestone": {
        "pending": "in_progress achieved missed waived",
        "in_progress": "pending achieved missed waived",
        "missed": "pending in_progress",
        "waived": "pending in_progress",
    },
    "variation": {"draft": "submitted withdrawn", "submitted": "approved rejected withdrawn superseded"},
    "progress_claim": {
        "draft": "submitted withdrawn",
        "submitted": "certified disputed withdrawn",
        "disputed": "certified submitted withdrawn",
        "certified": "closed",
    },
    "inspection": {
        "scheduled": "in_progress rescheduled cancelled",
        "rescheduled": "in_progress cancelled",
        "in_progress": "passed failed passed_with_defects cancelled",
        "failed": "rescheduled passed cancelled",
        "passed_with_defects": "rescheduled passed cancelled",
    },
    "defect": {
        "open": "acknowledged rejected in_rectification",
        "acknowledged": "in_rectification rejected",
        "in_rectification": "rectified open",
        "rectified": "verified in_rectification",
        "verified": "closed",
        "rejected": "open closed",
    },
    "practical_completion": {"not_reached": "notified", "notified": "inspected disputed", "inspected": "achieved disputed", "disputed": "inspected notified"},
    "handover": {"not_scheduled": "scheduled", "scheduled": "walkthrough_complete not_scheduled", "walkthrough_complete": "keys_released", "keys_released": "completed"},
    "warranty_claim": {"lodged": "under_review rejected", "under_review": "accepted rejected", "accepted": "rectified", "rectified": "closed", "rejected": "under_review closed"},
}


def statuses(machine: str) -> list[str]:
    """Every status of a machine, sorted."""
    steps = TRANSITIONS[machine]
    return sorted({*steps, *(s for after in steps.values() for s in after.split())})


def allowed_pairs(spark: SparkSession, machine: str) -> DataFrame:
    """from_status and to_status of the allowed transitions: a literal frame."""
    pairs = [(a, b) for a, after in TRANSITIONS[machine].items() for b in after.split()]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + " AS v(from_status, to_status)")


def apply_commands(state: DataFrame, commands: DataFrame, machine: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, history, outcomes) of commands (id, sequence, expected_version, from_status, to_status, reason).

    state has id, status and row_version. Of several commands for one id the first by sequence is applied, the others are
    SUPERSEDED. The rest of the ladder: REASON_REQUIRED, NOT_ALLOWED, NOT_FOUND, STALE_VERSION, STALE_STATUS, APPLIED.
    Where state has closed_at and commands say when (at), a terminal status is stamped with it, and others clear it.
    """
    spark = state.sparkSession
    first = F.row_number().over(Window.partitionBy("id").orderBy("sequence"))
    held = state.select("id", F.col("status").alias("_status"), F.col("row_version").alias("_version"))
    pairs = F.broadcast(allowed_pairs(spark, machine).withColumn("_allowed", F.lit(True)))
    judged = commands.withColumn("_place", first).join(held, "id", "left").join(pairs, ["from_status", "to_status"], "left")
    outcome = (
        F.when(F.col("_place") > 1, "SUPERSEDED")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "REASON_REQUIRED")
        .when(F.col("_allowed").isNull(), "NOT_ALLOWED")
        .when(F.col("_status").isNull(), "NOT_FOUND")
        .when(~F.col("_version").eqNullSafe(F.col("expected_version")), "STALE_VERSION")
        .when(F.col("_status") != F.col("from_status"), "STALE_STATUS")
        .otherwise("APPLIED")
    )
    when = ["at"] if "at" in commands.columns else []
    outcomes = judged.select("id", "sequence", "from_status", "to_status", "reason", *when, outcome.alias("outcome"))
    history = outcomes.where("outcome = 'APPLIED'").select("id", "from_status", "to_status", "reason", *when)
    moved = history.select("id", F.col("to_status").alias("_to"), *[F.col(c).alias(f"_{c}") for c in when])
    new = state.join(moved, "id", "left")
    changed = {"status": F.coalesce("_to", "status"), "row_version": F.col("row_version") + F.col("_to").isNotNull().cast("long")}
    if when:
        changed["closed_at"] = F.when(F.col("_to").isNull(), F.col("closed_at") if "closed_at" in state.columns else None).when(~F.col("_to").isin(*TRANSITIONS[machine]), F.col("_at"))
    return new.select(*[changed.get(c, F.col(c)).alias(c) for c in state.columns]), history, outcomes


def audit(history: DataFrame, entity: str, order: list[str], machine: str) -> DataFrame:
    """Consecutive statuses of an entity that the allow-list doesn't have; a status that stays is no transition."""
    w = Window.partitionBy(entity).orderBy(*order)
    steps = history.withColumn("from_status", F.lag("status").over(w)).withColumnRenamed("status", "to_status").where("from_status IS NOT NULL AND from_status <> to_status")
    return steps.join(F.broadcast(allowed_pairs(history.sparkSession, machine)), ["from_status", "to_status"], "left_anti")
