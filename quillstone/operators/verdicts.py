"""Verdicts as ordered ladders over facts: the first rung that holds decides. Every frame keeps its own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROVED = ("approved", "approved_with_controls")
# The record classes that can be asked for.
RECORD_CLASSES = (
    "identity_verification_record identity_document_details document_sighting_record ownership_control_evidence authority_evidence "
    "source_of_funds_declaration consent_evidence screening_procedure_record"
).split()
ELIGIBLE = ("eligible_reporting_entity", "eligible_foreign_equivalent")


def _ladder(rungs: list[tuple[Column, str]], last: str) -> Column:
    """The label of the first condition that is true; an unknown one isn't."""
    out = F.lit(last)
    for condition, label in reversed(rungs):
        out = F.when(condition, label).otherwise(out)
    return out


def issue_state(cases: DataFrame, versions: DataFrame, key: str = "case_id") -> DataFrame:
    """cases (key, gate, case_status, inputs_current, open_obligations) with state, reasons, current_version and latest_version.

    versions: key, version, superseded. The latest is the highest version, the current one the highest that isn't
    superseded. A terminated or locked gate wins over all; then a case that never issued, a closed one, one without a
    current version; then whatever asks for a refresh, with every reason in order.
    """
    held = versions.groupBy(key).agg(F.max("version").alias("latest_version"), F.max(F.when(~F.coalesce("superseded", F.lit(False)), F.col("version"))).alias("current_version"))
    gate, approved = F.col("gate"), F.col("gate").isin(*APPROVED)
    refresh = F.array_compact(
        F.array(
            F.when(~F.col("inputs_current"), "material_inputs_changed"),
            F.when(F.col("open_obligations") > 0, "open_refresh_obligation"),
            F.when((gate != "") & ~approved, "service_gate_regressed"),
        )
    )
    # A gate stops the case before its versions are looked at.
    rungs = [
        (gate == "terminated", "revoked", F.array(F.lit("service_gate_terminated"))),
        (gate == "locked", "suspended", F.array(F.lit("service_gate_locked"))),
        (F.col("latest_version").isNull() & approved, "ready_for_issuance", F.array(F.lit("gate_approved_no_attestation"))),
        (F.col("latest_version").isNull(), "not_issued", F.array(F.lit("no_attestation"))),
        (F.col("case_status") == "closed", "completed_retained", F.array(F.lit("case_closed"))),
        (F.col("current_version").isNull(), "superseded", F.array(F.lit("all_versions_superseded"))),
        (F.size(refresh) > 0, "refresh_required", refresh),
        (F.lit(True), "issued_current", F.array(F.lit("current_attestation_gate_approved"))),
    ]
    state = F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("state"), r.alias("reasons"))) for c, s, r in rungs])
    judged = cases.join(held, key, "left").withColumn("_v", state)
    return judged.select(*cases.columns, "_v.state", "_v.reasons", "current_version", F.coalesce("latest_version", F.lit(0)).alias("latest_version"))


def attestation_state(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows (attested, granted, revoked_at, expires_at, superseded_at, refresh_required_at, pinned_hash, content_hash) with state."""
    differs = (F.col("pinned_hash") != "") & (F.col("content_hash") != "") & (F.col("pinned_hash") != F.col("content_hash"))
    rungs = [
        (~F.coalesce(F.col("attested") & F.col("granted"), F.lit(False)), "unavailable"),
        (F.col("revoked_at").isNotNull(), "revoked"),
        (F.col("expires_at") < as_of, "expired"),
        (F.col("superseded_at").isNotNull(), "superseded"),
        (F.col("refresh_required_at").isNotNull() | differs, "refresh_required"),
    ]
    return rows.withColumn("state", _ladder(rungs, "current"))


def record_scope(requests: DataFrame, arrangements: DataFrame, key: str = "arrangement", code: str = "code") -> DataFrame:
    """requests with scope: prohibited for a code nobody knows, within_scope where the arrangement names it, else for review."""
    named = arrangements.select(key, F.explode("record_classes").alias(code)).distinct().withColumn("_in", F.lit(True))
    rungs = [(~F.coalesce(F.col(code).isin(*RECORD_CLASSES), F.lit(False)), "prohibited"), (F.col("_in"), "within_scope")]
    return requests.join(named, [key, code], "left").select(*requests.columns, _ladder(rungs, "requires_origin_review").alias("scope"))


def link_verdict(cases: DataFrame, links: DataFrame, key: str = "case_id") -> DataFrame:
    """cases (key, tenant, partner, partner_status, agreement) with verdict: ok, or why no link carries reliance.

    links: agreement, partner, link_case, link_tenant, route, link_state, as they were handed over for an agreement. One
    of another case or tenant refuses all of them.
    """
    other = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reliance = F.col("route") == "reliance"
    joined = cases.join(links, ["agreement", "partner"], "left")
    tallied = joined.groupBy(key).agg(
        F.count("link_case").alias("_any"),
        *(F.count_if(F.col("link_case").isNotNull() & c).alias(n) for n, c in (("_case", other("link_case", key)), ("_tenant", other("link_tenant", "tenant")), ("_route", reliance), ("_active", reliance & (F.col("link_state") == "active")))),
    )
    rungs = [
        (F.col("partner").isNull(), "partner_org_unresolved"),
        (~F.coalesce(F.col("partner_status") == "active", F.lit(False)), "partner_org_not_active"),
        (F.col("_any") == 0, "partner_link_missing"),
        (F.col("_case") > 0, "partner_link_wrong_case"),
        (F.col("_tenant") > 0, "partner_link_wrong_tenant"),
        (F.col("_route") == 0, "partner_link_wrong_route"),
        (F.col("_active") == 0, "partner_link_not_active"),
    ]
    return cases.join(tallied, key).select(*cases.columns, _ladder(rungs, "ok").alias("verdict"))


def arrangement_verdict(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with verdict: ok, or the first reason why a written arrangement can't carry new reliance.

    Columns: arrangement, status, effective_from, expires_on, next_review_due, eligibility, procedures, customer_types,
    procedure, customer_type, assessment_status, assessment_decision, assessment_due.
    """
    types = F.col("customer_types")
    rungs = [
        (F.col("arrangement").isNull(), "agreement_missing"),
        (~F.coalesce(F.col("status") == "active", F.lit(False)), "agreement_inactive"),
        (F.col("effective_from") > as_of, "agreement_not_yet_effective"),
        (F.col("expires_on") < as_of, "agreement_expired"),
        (F.col("next_review_due") < as_of, "review_overdue"),
        (F.col("eligibility") == "not_eligible", "eligibility_not_eligible"),
        (~F.coalesce(F.col("eligibility").isin(*ELIGIBLE), F.lit(False)), "eligibility_not_recorded"),
        (F.coalesce(F.size("procedures"), F.lit(0)) <= 0, "scope_not_recorded"),
        (~F.array_contains("procedures", F.col("procedure")), "scope_procedure_not_covered"),
        ((F.col("customer_type") != "") & (F.size(types) > 0) & ~F.array_contains(types, F.col("customer_type")), "scope_customer_type_not_covered"),
        (~F.coalesce(F.col("assessment_status") == "operative", F.lit(False)), "assessment_missing"),
        (F.col("assessment_decision") == "unsuitable", "assessment_unsuitable"),
        (F.col("assessment_due") < as_of, "assessment_overdue"),
    ]
    return rows.withColumn("verdict", _ladder(rungs, "ok"))


def stored_verdict(state: Column, flag: Column, measured: Column, stored: Column) -> Column:
    """The verdict kept with an image; pending where it was measured on other bytes, or where none was made."""
    other = (measured != "") & (stored != "") & (measured != stored)
    return F.when(other, "pending").when(state.isin("eligible", "ineligible", "pending"), state).when(flag, "eligible").otherwise("pending")


def needs_assessment(version: Column, current: int) -> Column:
    """A verdict of an older version, or none, is due again; one of this version is final whatever it says."""
    return F.coalesce(version, F.lit(0)) < current


def image_progress(has_image: Column, stage: Column, documents: Column, unprocessed: Column, unreachable: Column) -> Column:
    """What a row's imagery amounts to, in one of six words."""
    at = F.trim(F.coalesce(stage, F.lit("")))
    rungs = [
        (has_image, "drawn"),
        ((at != "") & (at != "settled"), "working"),
        (documents <= 0, "no_document"),
        (unprocessed > 0, "unreadable"),
        (unreachable > 0, "source_unavailable"),
    ]
    return _ladder(rungs, "none_found")


def evidence_state(rows: DataFrame, branches: str = "branches") -> DataFrame:
    """rows (accepted, discovery, version, anchor and JSON ``branches``) with total, inspected, operational, waiting and state.

    branches: by name, whether a source can be opened, and the result, exhaustion, version, anchor and attempts of its last
    reading. A source that can't be opened counts as inspected; a reading of another version or for another anchor is none.
    A negative counts as inspected where the document was read, else as our own failure; a recovery that was begun is
    under way until its second attempt. An accepted image settles all; then what was never opened, is under way, or failed
    on our side; links that couldn't be listed withhold the end.
    """
    held = F.map_values(F.from_json(F.coalesce(branches, F.lit("{}")), "map<string,struct<opens:boolean,result:string,exhaustion:string,version:int,anchor:string,attempts:int>>"))

    def verdict(b: Column) -> Column:
        rungs = [
            (~b["opens"], "inspected"),
            (b["result"].isNull() | ~b["version"].eqNullSafe(F.col("version")) | ~b["anchor"].eqNullSafe(F.col("anchor")), "open"),
            ((b["result"] == "no_deterministic_image") & (b["exhaustion"] == "inspected"), "inspected"),
            (b["result"] == "no_deterministic_image", "operational"),
            ((b["result"] == "package_recovery_attempt") & (b["attempts"] < 2), "in_flight"),
            (b["result"] == "package_recovery_attempt", "operational"),
        ]
        return _ladder(rungs, "open")

    judged = rows.withColumn("_verdicts", F.transform(held, verdict))
    many = lambda *kinds: F.size(F.filter("_verdicts", lambda v: v.isin(*kinds)))
    counted = judged.withColumns({"total": F.size("_verdicts"), "inspected": many("inspected"), "operational": many("operational"), "waiting": many("open")})
    unlisted = F.coalesce(F.col("discovery") == "unavailable", F.lit(False))
    rungs = [
        (F.col("accepted"), "found"),
        ((F.col("total") == 0) & ~unlisted, "no_evidence"),
        (F.col("waiting") > 0, "pending"),
        (many("in_flight") > 0, "processing"),
        ((F.col("operational") > 0) | unlisted, "retryable_failure"),
    ]
    return counted.withColumn("state", _ladder(rungs, "exhausted")).drop("_verdicts")


# The routes on which a partner may be told, and those of them on which it relies on the origin's work.
ROUTES = ("reliance", "outsourced_cdd", "independent_cdd", "information_share_only")
RELIANCE_ROUTES = ("reliance", "outsourced_cdd")
#: What is still to be made along the way stops nothing.
SOFT_BLOCKERS = ("DISCLOSURE_CONFIGURATION_REQUIRED", "EVIDENCE_AVAILABILITY_INCOMPLETE")


def distribution_readiness(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows, a candidate each with the facts of its own, with blockers (in order), ready and state.

    Facts: enabled, attestation, issued_at, superseded_at, obligations, passport_state, gate, route, consent, partner,
    membership, member_partner, portal_user, link (verdict of ``link_verdict``), link_active, classification,
    arrangement_partner, arrangement (verdict of ``arrangement_verdict``), evidence, manifest, granted, revoked_at,
    refresh_at, expires_at and granted_attestation. What only reliance needs is asked of its routes alone. A candidate
    without hard blockers is told where a grant it may have stands.
    """
    c, no = F.col, lambda x: ~F.coalesce(x, F.lit(False))
    known, relies = F.coalesce(c("route").isin(*ROUTES), F.lit(False)), F.coalesce(c("route").isin(*RELIANCE_ROUTES), F.lit(False))
    issued = c("attestation").isNotNull() & c("issued_at").isNotNull()
    member = (c("membership") == "active") & c("portal_user").isNotNull() & (c("partner").isNull() | (c("member_partner") == c("partner")))
    verdict = c("arrangement")
    facts = [
        (no(c("enabled")), "DISTRIBUTION_NOT_ENABLED"),
        (~issued, "PASSPORT_NOT_ISSUED"),
        (issued & c("superseded_at").isNotNull(), "PASSPORT_SUPERSEDED"),
        (c("obligations") > 0, "PASSPORT_REFRESH_REQUIRED"),
        (c("passport_state").isin("suspended", "revoked") | c("gate").isin("terminated", "locked"), "PASSPORT_SUSPENDED"),
        (~known, "LEGAL_ROUTE_NOT_RECORDED"),
        (c("consent").isNull(), "CLIENT_SHARING_CONSENT_REQUIRED"),
        (no(member), "PORTAL_MEMBERSHIP_REQUIRED"),
        (F.when(relies, no(c("link") == "ok")).otherwise(known & no(c("link_active"))), "PARTNER_LINK_REQUIRED"),
        (relies & no(c("classification") == "completed"), "PARTNER_CLASSIFICATION_REQUIRED"),
        (relies & (c("arrangement_partner") != c("partner")), "CDD_ARRANGEMENT_REQUIRED"),
        (relies & verdict.isin("review_overdue", "assessment_overdue"), "ARRANGEMENT_REVIEW_OVERDUE"),
        (relies & verdict.isin("assessment_missing", "assessment_unsuitable"), "ARRANGEMENT_ASSESSMENT_REQUIRED"),
        (relies & ~verdict.isin("ok", "review_overdue", "assessment_overdue", "assessment_missing", "assessment_unsuitable"), "CDD_ARRANGEMENT_REQUIRED"),
        (no(c("evidence") > 0), "EVIDENCE_AVAILABILITY_INCOMPLETE"),
        (no(c("manifest")), "DISCLOSURE_CONFIGURATION_REQUIRED"),
    ]
    blockers = F.array_distinct(F.array_compact(F.array(*(F.when(x, name) for x, name in facts))))
    judged = rows.withColumn("blockers", blockers).withColumn("ready", F.size(F.array_except("blockers", F.array(*map(F.lit, SOFT_BLOCKERS)))) == 0)
    rungs = [
        (~c("ready"), "ACTION_REQUIRED"),
        (no(c("granted")), "READY"),
        (c("revoked_at").isNotNull(), "GRANT_REVOKED"),
        (c("refresh_at").isNotNull(), "REFRESH_REQUIRED"),
        (c("expires_at") < as_of, "GRANT_EXPIRED"),
        (c("attestation").isNotNull() & ~c("granted_attestation").eqNullSafe(c("attestation")), "NEW_VERSION_AVAILABLE"),
    ]
    return judged.withColumn("state", _ladder(rungs, "ALREADY_CURRENT"))
