"""Truth tables and invariants."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillstone.operators import access, lifecycle, matching, merge, queueing
from quillstone.streaming import folds


def test_permission_truth_table(spark):
    """All combinations of key, membership, default and decision against the ladder written out as Python."""
    kinds = [("plain", False, "standard"), ("secret", True, "standard"), ("inbound", False, "inbound_projection")]
    roles, decisions, levels = ["owner", "read_only", None], ["allow", "deny", "inherit", None], ["view", "edit"]
    cases = list(itertools.product([*(k[0] for k in kinds), "typo"], roles, [True, False, None], decisions, levels))
    asked = spark.createDataFrame([(n, 1, c[0], c[4]) for n, c in enumerate(cases)], "user int, org int, permission string, level string")
    keys = spark.createDataFrame(kinds, "permission string, is_forbidden boolean, key_kind string")
    members = spark.createDataFrame([(n, 1, n, f"{c[1]}-{c[2]}") for n, c in enumerate(cases) if c[1]], "user int, org int, membership_id int, role string")
    members = members.withColumn("role", F.when(F.col("role").startswith("read_only"), "read_only").otherwise(F.col("role")))
    defaults = [(r, k, v, v, v) for r, v in (("owner-True", True), ("owner-False", False), ("read_only", True)) for k in ("plain", "secret", "inbound", "typo")]
    defaults = spark.createDataFrame(defaults, "role string, permission string, can_view boolean, can_edit boolean, can_delete boolean")
    overrides = spark.createDataFrame([(n, c[0], c[3], c[3], c[3]) for n, c in enumerate(cases) if c[3]], "membership_id int, permission string, view_decision string, edit_decision string, delete_decision string")
    found = {r.user: r.allowed for r in access.organisation_permission(asked, keys, members, defaults, overrides).collect()}

    def expected(permission, role, default, decision, level):
        if permission in ("typo", "secret") or (permission == "inbound" and level != "view") or role is None or decision == "deny" or (role == "read_only" and level != "view"):
            return False
        return True if decision == "allow" else bool(default) if role == "owner" else True

    assert found == {n: expected(*c) for n, c in enumerate(cases)}


def test_requests_without_membership_are_dealt(spark):
    """No task gets all requests that nobody's membership answers, and of two decisions for a key each answers."""
    asked = spark.range(4000).select(F.col("id").cast("int").alias("user"), F.lit(1).alias("org"), F.lit("plain").alias("permission"), F.lit("view").alias("level"), F.col("id").cast("int").alias("unit"))
    keys = spark.createDataFrame([("plain", False, "standard")], "permission string, is_forbidden boolean, key_kind string")
    members = spark.createDataFrame([(7, 1, 70, "owner"), (8, 1, 80, "owner"), (9, 1, 90, "owner")], "user int, org int, membership_id int, role string")
    defaults = spark.createDataFrame([("owner", "plain", True, True, True)], "role string, permission string, can_view boolean, can_edit boolean, can_delete boolean")
    decisions = "view_decision string, edit_decision string, delete_decision string"
    overrides = spark.createDataFrame([(70, "plain", *["deny"] * 3), (80, "plain", *["deny"] * 3), (80, "plain", *["allow"] * 3), (90, "other", *["deny"] * 3), (None, "plain", *["allow"] * 3)], f"membership_id int, permission string, {decisions}")
    scoped = spark.createDataFrame([(90, "plain", "unit", 9, *["deny"] * 3), (None, "plain", "unit", 1, *["deny"] * 3)], f"membership_id int, permission string, scope_type string, scope_id int, {decisions}")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        # The keys and the defaults are sent to all; nothing else is.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = access.organisation_permission(asked, F.broadcast(keys), members, F.broadcast(defaults), overrides)
        narrow = access.narrowed(found, scoped, {"unit": "unit"})
        for rows in (found, narrow):
            sizes = [r["count"] for r in rows.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
            assert sum(sizes) == 4001 and max(sizes) < 2500
        answers = lambda rows: sorted((r.user, r.allowed) for r in rows.where("membership_id IS NOT NULL").collect())
        assert answers(found) == [(7, False), (8, False), (8, True), (9, True)] and answers(narrow) == [(7, False), (8, False), (8, True), (9, False)]
        assert not found.where("membership_id IS NULL AND allowed").count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_containments_deal_known_words_only(spark, monkeypatch):
    """Scores as by brute force, also where the candidates' words are too many to be sent; words of no candidate are left where they are."""
    texts = {n: sorted({f"w{(n * k) % 23}" for k in range(n % 9)} | {f"own{n}-{k}" for k in range(50)}) for n in range(60)} | {60: [], 61: None}
    wanted = {c: sorted({f"w{(c * k + 1) % 23}" for k in range(1, 2 + c % 5)}) for c in range(1, 30)}
    items = spark.createDataFrame(list(texts.items()), "item int, words array<string>")
    sets = spark.createDataFrame(list(wanted.items()), "candidate int, words array<string>")
    expected = {(i, c): len(set(w) & set(v)) / len(w) for i, v in texts.items() if v for c, w in wanted.items() if len(set(w) & set(v)) >= 0.5 * len(w)}
    for most in (100_000, 0):
        monkeypatch.setattr(matching, "BROADCAST_WORDS", most, raising=False)
        scores = matching.containments(items, sets, "item", "candidate", "words", 0.5)
        assert {(r.item, r.candidate): r.score for r in scores.collect()} == expected and expected
        assert "LeftSemi" in scores._jdf.queryExecution().optimizedPlan().toString()


def test_transitions_are_never_loops():
    for machine, steps in lifecycle.TRANSITIONS.items():
        assert all(a not in after.split() for a, after in steps.items()), machine
    unit = lifecycle.TRANSITIONS["unit"]
    assert "reserved" in unit["available"].split() and "settled" not in unit and "withdrawn" not in unit["contracted"].split()


def test_publish_is_idempotent(spark):
    rows = [(1, 1, 5.0, "active", 2, 7.0), (2, 1, 5.0, "active", 2, None), (3, 1, 5.0, "active", None, None), (4, 2, 5.0, "staged", None, None), (5, 9, 5.0, "active", None, None)]
    items = spark.createDataFrame(rows, "id int, upload int, price double, lifecycle string, pending_upload int, patch_price double")
    once = merge.publish(items, 2, [1], ["price"])
    twice = merge.publish(once, 2, [1], ["price"])
    found = {r.id: (r.upload, r.price, r.lifecycle) for r in once.collect()}
    assert found == {1: (2, 7.0, "active"), 2: (2, 5.0, "active"), 3: (1, 5.0, "archived"), 4: (2, 5.0, "active"), 5: (9, 5.0, "active")}
    assert {r.id: (r.upload, r.price, r.lifecycle) for r in twice.collect()} == found


def test_commands(spark):
    state = spark.createDataFrame([(1, "available", 3), (2, "settled", 1), (3, "available", 1)], "id int, status string, row_version long")
    rows = [(1, 1, 3, "available", "reserved", "ok"), (1, 2, 4, "reserved", "contracted", "ok"), (2, 1, 1, "settled", "available", "ok"), (3, 1, 9, "available", "reserved", "ok"), (4, 1, 1, "available", "reserved", "ok"), (5, 1, 1, "available", "reserved", " ")]
    commands = spark.createDataFrame(rows, "id int, sequence int, expected_version long, from_status string, to_status string, reason string")
    new, history, outcomes = lifecycle.apply_commands(state, commands, "unit")
    assert {(r.id, r.sequence): r.outcome for r in outcomes.collect()} == {(1, 1): "APPLIED", (1, 2): "SUPERSEDED", (2, 1): "NOT_ALLOWED", (3, 1): "STALE_VERSION", (4, 1): "NOT_FOUND", (5, 1): "REASON_REQUIRED"}
    assert {r.id: (r.status, r.row_version) for r in new.collect()} == {1: ("reserved", 4), 2: ("settled", 1), 3: ("available", 1)}
    assert history.count() == 1


def test_identity_guard(spark):
    rows = [("43", "44", True), ("", "elara 18", False), (None, "1", False), ("7", "7", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    joined = df.select(F.struct(F.col("a").alias("lot")).alias("l"), F.struct(F.col("b").alias("lot")).alias("r"), "want")
    assert all(r.got == r.want for r in joined.select(matching.differs("l", "r", ["lot"]).alias("got"), "want").collect())


def test_best_unique_refuses_ties(spark):
    schema = "id int, a string, b string, c string"
    left = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "q"), (3, "n", None, "m")], schema).withColumnRenamed("id", "l")
    right = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "q"), (3, "x", "y", "q"), (4, "n", "any", "m")], schema).withColumnRenamed("id", "r")
    assert {x.l: x.r for x in matching.best_unique(left, right, "l", "r", ["a", "b", "c"]).collect()} == {1: 1, 3: 4}


@pytest.mark.parametrize("previous,current,changed", [(None, 1, False), (1, 1, False), (1, 2, True)])
def test_stamps(spark, previous, current, changed):
    df = spark.createDataFrame([(previous, current)], "p int, c int")
    assert df.select(queueing.stamps_differ(F.col("p"), F.col("c")).alias("d")).first().d is changed


def test_fixed_window_begins_at_first_event(spark):
    rows = [("a", i, t) for i, t in enumerate([0.0, 5.0, 9.0, 10.0, 12.0, 30.0])] + [("b", 9, 3.0)]
    df = spark.createDataFrame(rows, "who string, n int, at double")
    found = {(r.who, r.n): (r.allowed, r["count"]) for r in folds.fold(df, "who", "at", "n", *folds.rate_limit(2, 10.0)).collect()}
    assert found == {("a", 0): (True, 1), ("a", 1): (True, 2), ("a", 2): (False, 3), ("a", 3): (True, 1), ("a", 4): (True, 2), ("a", 5): (True, 1), ("b", 9): (True, 1)}
    late = folds.fold(df, "who", "at", "n", *folds.rate_limit(2, 10.0, restart_at_end=False)).where("n = 3").first()
    assert late["count"] == 4


def test_breaker(spark):
    df = spark.createDataFrame([("s", n, float(n), ok) for n, ok in enumerate([False, False, True, False, False, False, True])], "who string, n int, at double, ok boolean")
    found = {r.n: (r.is_open, r.failures, r.tripped) for r in folds.fold(df, "who", "at", "n", *folds.circuit_breaker(3, 100.0)).collect()}
    assert found == {0: (False, 1, False), 1: (False, 2, False), 2: (False, 0, False), 3: (False, 1, False), 4: (False, 2, False), 5: (False, 0, True), 6: (True, 0, False)}


def test_counters_refuse_bad_parameters(spark):
    from pyspark.errors import PySparkException

    for most, window in ((0, 60.0), (5, 0.5), (-1, -1.0)):
        with pytest.raises(ValueError):
            folds.rate_limit(most, window)
    keys = spark.createDataFrame([("ip:10.0.0.1/a_b-c",), ("x" * 200,)], "key string")
    assert keys.select(folds.limited_key(F.col("key")).alias("k")).collect() == keys.collect()
    for bad in ("", "x" * 201, "Upper", "a b", None):
        with pytest.raises(PySparkException, match="rate-limit key"):
            spark.createDataFrame([(bad,)], "key string").select(folds.limited_key(F.col("key"))).collect()
