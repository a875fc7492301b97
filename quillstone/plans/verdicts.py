"""Verdict ladders and labels over orders, line items, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import labels as T
from quillstone.operators import verdicts as V
from quillstone.registry import Tables, query
from quillstone.sources import sinks

_GATE = "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'terminated' WHEN 2 THEN 'locked' WHEN 3 THEN 'under_review' WHEN 4 THEN 'approved_with_controls' ELSE 'approved' END"
_DAY = "TIMESTAMP '1998-01-01 12:00:00'"


@query(
    f"WITH v AS (SELECT l_orderkey AS k, max(l_linenumber) AS latest, max(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS current FROM lineitem GROUP BY 1), "
    f"c AS (SELECT o_orderkey AS case_id, {_GATE} AS gate, o_orderstatus = 'F' AS closed, o_orderkey % 7 <> 0 AS fresh, o_orderkey % 5 = 0 AS owed FROM orders), "
    "j AS (SELECT c.*, latest, current, gate IN ('approved', 'approved_with_controls') AS approved, concat_ws(',', CASE WHEN NOT fresh THEN 'material_inputs_changed' END, CASE WHEN owed THEN 'open_refresh_obligation' END, CASE WHEN gate NOT IN ('approved', 'approved_with_controls') THEN 'service_gate_regressed' END) AS why FROM c LEFT JOIN v ON k = case_id) "
    "SELECT case_id, CASE WHEN gate = 'terminated' THEN 'revoked' WHEN gate = 'locked' THEN 'suspended' WHEN latest IS NULL AND approved THEN 'ready_for_issuance' WHEN latest IS NULL THEN 'not_issued' WHEN closed THEN 'completed_retained' WHEN current IS NULL THEN 'superseded' WHEN why <> '' THEN 'refresh_required' ELSE 'issued_current' END AS state, "
    "CASE WHEN gate = 'terminated' THEN 'service_gate_terminated' WHEN gate = 'locked' THEN 'service_gate_locked' WHEN latest IS NULL AND approved THEN 'gate_approved_no_attestation' WHEN latest IS NULL THEN 'no_attestation' WHEN closed THEN 'case_closed' WHEN current IS NULL THEN 'all_versions_superseded' WHEN why <> '' THEN why ELSE 'current_attestation_gate_approved' END AS reasons, "
    "current AS current_version, coalesce(latest, 0) AS latest_version FROM j"
)
def issue_states(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    cases = t.orders.select(k.alias("case_id"), F.expr(_GATE).alias("gate"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("case_status"), (k % 7 != 0).alias("inputs_current"), F.when(k % 5 == 0, 1).otherwise(0).alias("open_obligations"))
    versions = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("version"), (F.col("l_returnflag") == "R").alias("superseded"))
    return V.issue_state(cases, versions).select("case_id", "state", F.array_join("reasons", ",").alias("reasons"), "current_version", "latest_version")


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unavailable' WHEN o_orderkey % 13 = 0 THEN 'revoked' WHEN o_orderdate + INTERVAL 400 DAY < {_DAY} THEN 'expired' WHEN o_orderstatus = 'P' THEN 'superseded' "
    "WHEN o_orderkey % 3 = 0 OR (o_orderkey % 4 > 0 AND o_orderkey % 4 <> 1) THEN 'refresh_required' ELSE 'current' END AS state FROM orders"
)
def attestation_states(t: Tables) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    rows = t.orders.select(
        "o_orderkey", (k % 22 != 0).alias("attested"), (k % 11 != 0).alias("granted"), F.when(k % 13 == 0, at).alias("revoked_at"), (at + F.expr("INTERVAL 400 DAYS")).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "P", at).alias("superseded_at"), F.when(k % 3 == 0, at).alias("refresh_required_at"), F.when(k % 4 > 0, (k % 4).cast("string")).otherwise("").alias("pinned_hash"), F.lit("1").alias("content_hash"),
    )
    as_of = F.lit("1998-01-01 12:00:00").cast(dict(t.orders.dtypes)["o_orderdate"])
    return V.attestation_state(rows, as_of).select("o_orderkey", "state")


_CODES = ["consent_evidence", "authority_evidence", "source_of_funds_declaration", "household_pets"]


@query(
    f"SELECT event_id, code, CASE WHEN code = 'household_pets' THEN 'prohibited' WHEN user_id % 2 = 0 AND code IN ('consent_evidence', 'authority_evidence') THEN 'within_scope' ELSE 'requires_origin_review' END AS scope FROM (SELECT event_id, user_id, {_CODES!r}[event_id % 4 + 1] AS code FROM events) e"
)
def record_scopes(t: Tables) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 4 + 1).cast("int"))
    requests = t.events.select("event_id", F.col("user_id").alias("arrangement"), code.alias("code"))
    arrangements = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("arrangement")).distinct().withColumn("record_classes", F.array(*map(F.lit, _CODES[:2])))
    return V.record_scope(requests, arrangements).select("event_id", "code", "scope")


@query(
    "WITH l AS (SELECT l_orderkey AS agreement, l_suppkey % 3 AS partner, CASE WHEN l_partkey % 19 = 0 THEN -1 ELSE l_orderkey END AS link_case, l_partkey % 23 = 0 AS foreign_tenant, l_returnflag <> 'A' AS reliance, l_linestatus = 'O' AS active FROM lineitem), "
    "c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 3 END AS partner, o_orderkey % 8 > 0 AS good FROM orders), "
    "g AS (SELECT case_id, count(link_case) AS n, count(*) FILTER (link_case <> case_id) AS wrong_case, count(*) FILTER (foreign_tenant) AS wrong_tenant, count(*) FILTER (reliance) AS route, count(*) FILTER (reliance AND active) AS live FROM c LEFT JOIN l ON agreement = case_id AND l.partner = c.partner GROUP BY 1) "
    "SELECT case_id, CASE WHEN partner IS NULL THEN 'partner_org_unresolved' WHEN NOT good THEN 'partner_org_not_active' WHEN n = 0 THEN 'partner_link_missing' WHEN wrong_case > 0 THEN 'partner_link_wrong_case' WHEN wrong_tenant > 0 THEN 'partner_link_wrong_tenant' WHEN route = 0 THEN 'partner_link_wrong_route' WHEN live = 0 THEN 'partner_link_not_active' ELSE 'ok' END AS verdict FROM c JOIN g USING (case_id)"
)
def link_verdicts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    cases = t.orders.select(k.alias("case_id"), k.alias("agreement"), F.lit("t1").alias("tenant"), F.when(k % 10 > 0, k % 3).alias("partner"), F.when(k % 8 > 0, "active").otherwise("suspended").alias("partner_status"))
    links = t.lineitem.select(
        F.col("l_orderkey").alias("agreement"), (F.col("l_suppkey") % 3).alias("partner"), F.when(F.col("l_partkey") % 19 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("link_case"), F.when(F.col("l_partkey") % 23 == 0, "t2").otherwise("t1").alias("link_tenant"),
        F.when(F.col("l_returnflag") != "A", "reliance").otherwise("outsourced").alias("route"), F.when(F.col("l_linestatus") == "O", "active").otherwise("ended").alias("link_state"),
    )
    return V.link_verdict(cases, links).select("case_id", "verdict")


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'agreement_missing' WHEN o_orderstatus = 'P' THEN 'agreement_inactive' WHEN o_orderdate > {_DAY} THEN 'agreement_not_yet_effective' WHEN o_orderkey % 5 = 0 AND o_orderdate + INTERVAL 700 DAY < {_DAY} THEN 'agreement_expired' "
    f"WHEN o_orderdate + INTERVAL 1100 DAY < {_DAY} THEN 'review_overdue' WHEN o_orderkey % 7 = 0 THEN 'eligibility_not_eligible' WHEN o_orderkey % 7 = 1 THEN 'eligibility_not_recorded' WHEN o_orderkey % 6 = 0 THEN 'scope_not_recorded' WHEN o_orderkey % 6 = 1 THEN 'scope_procedure_not_covered' "
    f"WHEN o_orderkey % 6 = 2 THEN 'scope_customer_type_not_covered' WHEN o_orderkey % 11 = 0 THEN 'assessment_missing' WHEN o_orderkey % 11 = 1 THEN 'assessment_unsuitable' WHEN o_orderdate + INTERVAL 500 DAY < {_DAY} THEN 'assessment_overdue' ELSE 'ok' END AS verdict FROM orders"
)
def arrangement_verdicts(t: Tables) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    kind = dict(t.orders.dtypes)["o_orderdate"]
    plus = lambda n: at + F.expr(f"INTERVAL {n} DAYS")
    rows = t.orders.select(
        "o_orderkey", F.when(k % 29 > 0, k).alias("arrangement"), F.when(F.col("o_orderstatus") != "P", "active").alias("status"), at.alias("effective_from"), F.when(k % 5 == 0, plus(700)).alias("expires_on"), plus(1100).alias("next_review_due"),
        F.when(k % 7 == 0, "not_eligible").when(k % 7 > 1, "eligible_reporting_entity").alias("eligibility"), F.when(k % 6 == 1, F.array(F.lit("other"))).when(k % 6 > 1, F.array(F.lit("identity"))).alias("procedures"),
        F.when(k % 6 == 2, F.array(F.lit("company"))).when(k % 6 == 3, F.array(F.lit("person"))).alias("customer_types"), F.lit("identity").alias("procedure"), F.lit("person").alias("customer_type"),
        F.when(k % 11 > 0, "operative").alias("assessment_status"), F.when(k % 11 == 1, "unsuitable").otherwise("suitable").alias("assessment_decision"), plus(500).alias("assessment_due"),
    )
    return V.arrangement_verdict(rows, F.lit("1998-01-01 12:00:00").cast(kind)).select("o_orderkey", "verdict")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 6 AND o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 4 = 0 THEN 'eligible' WHEN o_orderkey % 4 = 1 THEN 'ineligible' WHEN o_orderkey % 4 > 1 AND o_orderkey % 5 = 0 THEN 'eligible' ELSE 'pending' END AS verdict, "
    "coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 END, 0) < 4 AS due, CASE WHEN o_orderkey % 5 = 0 THEN 'drawn' WHEN o_orderstatus = 'O' THEN 'working' WHEN o_orderkey % 3 = 0 THEN 'no_document' WHEN o_orderkey % 7 = 0 THEN 'unreadable' WHEN o_orderkey % 4 = 0 THEN 'source_unavailable' ELSE 'none_found' END AS progress FROM orders"
)
def image_states(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "eligible").when(k % 4 == 1, "ineligible").when(k % 4 == 2, "odd")
    verdict = V.stored_verdict(state, k % 5 == 0, F.when(k % 10 > 6, "aa"), F.when(k % 3 == 0, "bb").otherwise(""))
    stage = F.when(F.col("o_orderstatus") == "O", " eligibility ").when(F.col("o_orderstatus") == "F", "settled")
    progress = V.image_progress(k % 5 == 0, stage, k % 3, F.when(k % 7 == 0, 1), F.when(k % 4 == 0, 2))
    return t.orders.select("o_orderkey", verdict.alias("verdict"), V.needs_assessment(F.when(k % 2 == 0, k % 6), 4).alias("due"), progress.alias("progress"))


@query(
    f"SELECT o_orderkey, CASE WHEN d = 0 THEN 'Today' WHEN d > 0 THEN 'In ' || d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END ELSE -d || CASE WHEN d = -1 THEN ' day' ELSE ' days' END || ' ago' END AS countdown, "
    f"CASE WHEN b = 0 THEN 'Today' WHEN b > 0 THEN b || CASE WHEN b = 1 THEN ' day' ELSE ' days' END END AS dwell FROM (SELECT o_orderkey, ceil((epoch_us(o_orderdate) - epoch_us({_DAY})) / 86400000000.0)::BIGINT AS d, floor((epoch_us({_DAY}) - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS b FROM orders) x"
)
def time_labels(t: Tables) -> DataFrame:
    at, as_of = F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01 12:00:00").cast("timestamp")
    return t.orders.select("o_orderkey", T.countdown(at, as_of).alias("countdown"), T.dwell(at, as_of).alias("dwell"))


@query(
    "SELECT doc_id, CASE WHEN n <= 0 THEN '—' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' ELSE floor(n * 10 / 1048576 + 0.5)::BIGINT // 10 || '.' || floor(n * 10 / 1048576 + 0.5)::BIGINT % 10 || ' MB' END AS size, "
    "CASE WHEN floor((doc_id % 50 - 10) / 7 + 0.5) > 0 THEN floor((doc_id % 50 - 10) / 7 + 0.5)::BIGINT END AS metres FROM (SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 97 ELSE 4099 END AS n FROM documents) d"
)
def size_labels(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    n = F.col("n_chars") * F.when(k % 4 == 0, 0).when(k % 4 == 1, 1).when(k % 4 == 2, 97).otherwise(4099)
    return t.documents.select("doc_id", T.file_size(n).alias("size"), T.whole_square_metres((k % 50 - 10) / 7).alias("metres"))


@query(
    "SELECT r_name, CASE WHEN len(l) > 1 THEN array_to_string(l[:-2], ', ') || ' and ' || l[-1] ELSE coalesce(l[1], '') END AS nations FROM (SELECT r_name, coalesce(list(n_name ORDER BY n_name) FILTER (n_nationkey % 3 > 0), []) AS l FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) x"
)
def sentence_lists(t: Tables) -> DataFrame:
    kept = F.sort_array(F.collect_list(F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name"))))
    named = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(kept.alias("l"))
    return named.select("r_name", T.english_list(F.col("l")).alias("nations"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Unit ' || o_custkey || ', ' || o_orderkey || ' High St, Lara' WHEN o_orderkey % 4 = 1 THEN 'Lot ' || o_orderkey || ', ' || CASE WHEN o_orderkey % 3 = 0 THEN 'High St' ELSE 'lot 0' || o_orderkey || ' High St' END || ', Lara' WHEN o_orderkey % 4 = 2 THEN 'Lara' ELSE 'Estate ' || o_custkey END AS label FROM orders"
)
def record_labels(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    unit, lot = F.when(k % 4 == 0, c), F.when(k % 4 < 2, k)
    address = F.when(k % 4 == 0, F.concat(F.lit("UNIT "), c.cast("string"), F.lit(" - "), k.cast("string"), F.lit(" High St"))).when(
        k % 4 == 1, F.concat(F.when(k % 3 == 0, "lot. ").otherwise("lot 0"), k.cast("string"), F.lit(" High St"))
    )
    return t.orders.select("o_orderkey", T.record_label(unit, lot, address, F.when(k % 4 < 3, "Lara"), [F.concat(F.lit("Estate "), c.cast("string"))]).alias("label"))


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(t, '[\",\r\n]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END || ',' || doc_id AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d"
)
def csv_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sinks.csv_line(t.documents.select("text", "doc_id")).alias("line"))


# Each line of an order is a source of its evidence.
_BRANCH = (
    "CASE WHEN l_partkey % 7 = 0 THEN 'inspected' WHEN l_returnflag = 'N' OR l_suppkey % 5 = 0 THEN 'open' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'inspected' WHEN l_returnflag = 'R' THEN 'operational' "
    "WHEN l_linenumber % 3 < 2 THEN 'in_flight' ELSE 'operational' END"
)


@query(
    f"WITH b AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (v = 'inspected') AS inspected, count(*) FILTER (v = 'operational') AS operational, count(*) FILTER (v = 'open') AS waiting, count(*) FILTER (v = 'in_flight') AS flying "
    f"FROM (SELECT l_orderkey, {_BRANCH} AS v FROM lineitem WHERE l_orderkey % 9 > 0) x GROUP BY l_orderkey) "
    "SELECT o_orderkey, coalesce(total, 0)::INT AS total, coalesce(inspected, 0)::INT AS inspected, coalesce(operational, 0)::INT AS operational, coalesce(waiting, 0)::INT AS waiting, "
    "CASE WHEN o_orderkey % 10 = 0 THEN 'found' WHEN total IS NULL AND o_orderkey % 4 > 0 THEN 'no_evidence' WHEN waiting > 0 THEN 'pending' WHEN flying > 0 THEN 'processing' WHEN operational > 0 OR o_orderkey % 4 = 0 THEN 'retryable_failure' ELSE 'exhausted' END AS state "
    "FROM orders LEFT JOIN b ON l_orderkey = o_orderkey"
)
def evidence_states(t: Tables) -> DataFrame:
    flag, k = F.col("l_returnflag"), F.col("o_orderkey")
    result = F.when(flag == "R", "no_deterministic_image").when(flag == "A", "package_recovery_attempt")
    reading = F.struct(
        (F.col("l_partkey") % 7 > 0).alias("opens"), result.alias("result"), F.when(F.col("l_linestatus") == "F", "inspected").otherwise("operational").alias("exhaustion"),
        F.when(F.col("l_suppkey") % 5 > 0, 3).otherwise(2).alias("version"), F.when(F.col("l_suppkey") % 10 == 0, "b").otherwise("a").alias("anchor"), (F.col("l_linenumber") % 3).alias("attempts"),
    )
    listed = t.lineitem.where("l_orderkey % 9 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(reading).alias("l"))
    branches = F.to_json(F.map_from_entries(F.transform("l", lambda b, i: F.struct(F.concat(F.lit("b"), i.cast("string")), b))))
    rows = t.orders.select("o_orderkey").join(listed.select("o_orderkey", branches.alias("branches")), "o_orderkey", "left")
    rows = rows.withColumns({"accepted": k % 10 == 0, "discovery": F.when(k % 4 == 0, "unavailable"), "version": F.lit(3), "anchor": F.lit("a")})
    return V.evidence_state(rows).select("o_orderkey", "total", "inspected", "operational", "waiting", "state")


_HARD = (
    "concat_ws(',', CASE WHEN k % 31 = 0 THEN 'DISTRIBUTION_NOT_ENABLED' END, CASE WHEN k % 17 = 0 THEN 'PASSPORT_NOT_ISSUED' WHEN k % 19 = 0 THEN 'PASSPORT_SUPERSEDED' END, CASE WHEN k % 23 = 0 THEN 'PASSPORT_REFRESH_REQUIRED' END, "
    "CASE WHEN k % 29 = 0 OR k % 37 = 0 THEN 'PASSPORT_SUSPENDED' END, CASE WHEN k % 6 = 5 THEN 'LEGAL_ROUTE_NOT_RECORDED' END, CASE WHEN k % 41 = 0 THEN 'CLIENT_SHARING_CONSENT_REQUIRED' END, CASE WHEN k % 13 < 2 THEN 'PORTAL_MEMBERSHIP_REQUIRED' END, "
    "CASE WHEN k % 6 < 3 AND k % 7 = 0 OR k % 6 IN (3, 4) AND k % 8 = 0 THEN 'PARTNER_LINK_REQUIRED' END, CASE WHEN k % 6 < 3 AND k % 5 = 0 THEN 'PARTNER_CLASSIFICATION_REQUIRED' END, CASE WHEN k % 6 < 3 AND k % 11 = 0 THEN 'CDD_ARRANGEMENT_REQUIRED' END, "
    "CASE WHEN k % 6 < 3 THEN CASE k % 9 WHEN 0 THEN 'ARRANGEMENT_REVIEW_OVERDUE' WHEN 1 THEN 'ARRANGEMENT_ASSESSMENT_REQUIRED' WHEN 2 THEN CASE WHEN k % 11 > 0 THEN 'CDD_ARRANGEMENT_REQUIRED' END END END)"
)


@query(
    f"SELECT k AS o_orderkey, concat_ws(',', nullif(hard, ''), CASE WHEN k % 3 = 0 THEN 'EVIDENCE_AVAILABILITY_INCOMPLETE' END, CASE WHEN k % 4 = 0 THEN 'DISCLOSURE_CONFIGURATION_REQUIRED' END) AS blockers, "
    f"CASE WHEN hard <> '' THEN 'ACTION_REQUIRED' WHEN k % 10 < 3 THEN 'READY' WHEN k % 10 = 3 THEN 'GRANT_REVOKED' WHEN k % 10 = 4 THEN 'REFRESH_REQUIRED' WHEN o_orderdate < {_DAY} THEN 'GRANT_EXPIRED' WHEN k % 10 < 8 THEN 'NEW_VERSION_AVAILABLE' ELSE 'ALREADY_CURRENT' END AS state "
    f"FROM (SELECT o_orderkey AS k, o_orderdate, {_HARD.replace('k %', 'o_orderkey %')} AS hard FROM orders) x"
)
def distribution_readiness(t: Tables) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    rows = t.orders.select(
        "o_orderkey", (k % 31 != 0).alias("enabled"), F.lit("a2").alias("attestation"), F.when(k % 17 != 0, at).alias("issued_at"), F.when(k % 19 == 0, at).alias("superseded_at"), F.when(k % 23 == 0, 1).otherwise(0).alias("obligations"),
        F.when(k % 29 == 0, "revoked").otherwise("current").alias("passport_state"), F.when(k % 37 == 0, "locked").otherwise("approved").alias("gate"), pick(6, "reliance", "outsourced_cdd", "reliance", "independent_cdd", "information_share_only", "other").alias("route"),
        F.when(k % 41 != 0, k).alias("consent"), F.lit(7).alias("partner"), F.when(k % 13 == 0, "ended").otherwise("active").alias("membership"), F.when(k % 13 == 1, 8).otherwise(7).alias("member_partner"), F.lit(1).alias("portal_user"),
        F.when(k % 7 == 0, "partner_link_missing").otherwise("ok").alias("link"), (k % 8 != 0).alias("link_active"), F.when(k % 5 != 0, "completed").alias("classification"), F.when(k % 11 == 0, 8).when(k % 2 == 0, 7).alias("arrangement_partner"),
        F.when(k % 9 == 0, "review_overdue").when(k % 9 == 1, "assessment_missing").when(k % 9 == 2, "agreement_expired").otherwise("ok").alias("arrangement"), (k % 3).alias("evidence"), (k % 4 != 0).alias("manifest"), (k % 10 > 2).alias("granted"),
        F.when(k % 10 == 3, at).alias("revoked_at"), F.when(k % 10 == 4, at).alias("refresh_at"), at.alias("expires_at"), F.when(k % 10 < 8, "a1").otherwise("a2").alias("granted_attestation"),
    )
    as_of = F.lit("1998-01-01 12:00:00").cast(dict(t.orders.dtypes)["o_orderdate"])
    return V.distribution_readiness(rows, as_of).select("o_orderkey", F.array_join("blockers", ",").alias("blockers"), "state")
