"""Labels, verdict ladders, sinks and merges on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import labels as T
from quillstone.operators import merge, queueing, verdicts
from quillstone.sources import readers, sinks


def one(spark, expression, *values):
    return spark.range(1).select(expression(*[F.lit(v) for v in values]).alias("v")).first().v


@pytest.mark.parametrize(
    "name,cased",
    [("mary o'brien", "Mary O'Brien"), ("MCDONALD macgregor", "McDonald MacGregor"), ("ludwig VAN beethoven", "Ludwig van Beethoven"), ("van gogh", "Van Gogh"), ("anne-marie smith-jones", "Anne-Marie Smith-Jones"), ("  jo   de-la cruz ", "Jo de-la Cruz"), ("o'", "O'"), ("mc", "Mc"), ("", ""), (None, "")],
)
def test_smart_case(spark, name, cased):
    assert one(spark, T.smart_case, name) == cased


def test_full_name(spark):
    assert one(spark, T.full_name, "anna", None) == "Anna" and one(spark, T.full_name, "anna", "di marco") == "Anna Di Marco"


@pytest.mark.parametrize("n,size", [(None, "—"), (0, "—"), (1023, "1023 B"), (1536, "2 KB"), (1048575, "1024 KB"), (1048576, "1.0 MB"), (1625293, "1.6 MB")])
def test_file_size(spark, n, size):
    assert spark.range(1).select(T.file_size(F.lit(n).cast("long")).alias("v")).first().v == size


def test_sizes_and_lists(spark):
    assert [one(spark, T.whole_square_metres, x) for x in (179.82, 0.4, 0.5, -1.0)] == [180, None, 1, None]
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "p array<string>")
    assert [r.v for r in rows.select(T.english_list(F.col("p")).alias("v")).collect()] == ["", "a", "a and b", "a, b and c"]


def test_text_identity(spark):
    assert one(spark, T.lots_named, "Lot 12, LOT #7 and allot 9, lot 123456") == ["12", "7"]
    names = lambda page, label: one(spark, T.names_label, page, label)
    assert names("Donnybrook\nLot 537 — Kirramingly Avenue", "Lot 537 Kirramingly Avenue, Donnybrook") and not names("lot 5 of 5", "5") and not names("lot 53", "lot 537")
    strip = lambda a, n: one(spark, lambda x, y: T.without_designation(x, "Lot", y), a, n)
    assert strip("Lot 1731 Hornsea Street", "1731") == "Hornsea Street" and strip("Lot 5 Smith Street", "1731") == "Lot 5 Smith Street"
    assert strip("Lot 17", "17") == "Lot 17" and strip("lot. 1.5, Rose St", "1.5") == "Rose St" and strip("Lot 175 Rose St", "17") == "Lot 175 Rose St"
    line = lambda given, unit, lot, place: one(spark, lambda a, b, c, d: T.address_line(a, b, c, d), given, unit, lot, place)
    assert line("", "3", "9", "Rose Estate") == "Unit 3 Rose Estate" and line(None, " ", "lot 9", "Lara") == "lot 9 Lara" and line("1 High St", None, None, "Lara") is None and line(None, "3", None, " ") is None


def test_csv_round_trip(spark):
    cells = [["a,b", 'say "x"', "two\nlines"], ["", "plain", "c"]]
    text = spark.createDataFrame([(cells,)], "m array<array<string>>").select(sinks.csv_matrix(F.col("m")).alias("t"))
    assert text.select(readers.cells(F.col("t"), F.lit(",")).alias("c")).first().c == cells


def test_write_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "x")], "n int, s string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()) == [("1", 'a "b", c'), ("2", "x")]


def test_link_of_another_case_refuses_all(spark):
    cases = spark.createDataFrame([(c, c, "t", "p", "active") for c in (1, 2, 3)], "case_id int, agreement int, tenant string, partner string, partner_status string")
    links = spark.createDataFrame([(1, "p", 1, "t", "reliance", "active"), (1, "p", 9, "t", "reliance", "active"), (2, "p", 2, "t", "reliance", "active"), (3, "q", 3, "t", "reliance", "active")], "agreement int, partner string, link_case int, link_tenant string, route string, link_state string")
    assert {r.case_id: r.verdict for r in verdicts.link_verdict(cases, links).collect()} == {1: "partner_link_wrong_case", 2: "ok", 3: "partner_link_missing"}


def test_upsert_takes_the_first_of_several(spark):
    base = spark.createDataFrame([(1, 7, "a", 3)], "id long, parent long, note string, row_version int")
    rows = [(10, 1, None, None, 3, {"note": None}), (11, 1, None, None, 3, {"note": "x"}), (12, None, 5, 8, None, {"note": "n", "row_version": "99"}), (13, None, 6, None, None, {})]
    commands = spark.createDataFrame(rows, "command long, id long, new_id long, parent long, expected_version int, payload map<string,string>")
    new, outcomes = merge.guarded_upsert(base, commands, ["note"], "parent")
    assert {r.command: r.outcome for r in outcomes.collect()} == {10: "PATCHED", 11: "SUPERSEDED", 12: "INSERTED", 13: "PARENT_REQUIRED"}
    assert sorted(tuple(r) for r in new.collect()) == [(1, 7, None, 4), (5, 8, "n", 1)]


def test_import_then_publish(spark):
    """What an import holds back is what publication applies."""
    schema = "org int, id long, price double, upload int, lifecycle string, pending_upload int, patch_price double"
    items = spark.createDataFrame([(1, 1, 5.0, 1, "active", None, None), (1, 2, 5.0, 1, "active", None, None), (1, 3, 5.0, 1, "archived", None, None), (2, 4, 5.0, 1, "archived", None, None)], schema)
    rows = spark.createDataFrame([(1, 1, None, 6.0), (1, 3, None, 7.0), (1, None, 5, 8.0), (2, 4, None, None), (2, None, 6, 9.0)], "org int, id long, new_id long, price double")
    staged = merge.staged_import(items, rows, 2, ["price"])
    assert {r.id: (r.price, r.lifecycle) for r in staged.collect()} == {1: (5.0, "active"), 2: (5.0, "active"), 3: (7.0, "staged"), 4: (5.0, "active"), 5: (8.0, "staged"), 6: (9.0, "active")}
    live = merge.publish(staged, 2, [1], ["price"])
    assert {r.id: (r.price, r.lifecycle) for r in live.collect()} == {1: (6.0, "active"), 2: (5.0, "archived"), 3: (7.0, "active"), 4: (5.0, "active"), 5: (8.0, "active"), 6: (9.0, "active")}


def test_prices_close_in_order(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    prices = spark.createDataFrame([(1, 5.0, "fixed", at(1), None, True), (2, 6.0, "fixed", at(1), None, True)], "unit int, price double, basis string, effective_from timestamp, effective_to timestamp, is_current boolean")
    commands = spark.createDataFrame([(1, 1, 7.0, "from", at(3)), (2, 1, 8.0, "fixed", at(4)), (3, 1, None, "fixed", at(5)), (4, 9, 1.0, "fixed", at(5)), (5, 2, 1.0, "guess", at(5))], "command int, unit int, price double, basis string, at timestamp")
    new, outcomes = merge.change_prices(prices, prices.select("unit"), commands, ["fixed", "from"])
    assert {r.command: r.outcome for r in outcomes.collect()} == {1: "SET", 2: "SET", 3: "INVALID_PRICE", 4: "UNIT_NOT_FOUND", 5: "INVALID_PRICE_BASIS"}
    assert sorted((r.unit, r.price, r.effective_to, r.is_current) for r in new.collect() if r.effective_to) == [(1, 5.0, at(3), False), (1, 7.0, at(4), False)]
    assert sorted((r.unit, r.price) for r in new.where("is_current").collect()) == [(1, 8.0), (2, 6.0)]


def test_settle_keeps_silent_jobs(spark):
    at = datetime.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(i, "read", 4, at, at, None, None) for i in range(4)], "id int, stage string, attempts int, claim_until timestamp, next_attempt_at timestamp, last_result string, last_error string")
    results = spark.createDataFrame([(0, "draw", False, 0, "ok", None), (1, "read", False, 60, "more", "e" * 900), (2, None, True, -5, None, None)], "id int, next_stage string, reset boolean, retry_after int, result string, error string")
    found = {r.id: r for r in queueing.settle(jobs, results, F.lit(at)).collect()}
    assert {i: (r.stage, r.attempts, r.claim_until) for i, r in found.items()} == {0: ("draw", 0, None), 1: ("read", 4, None), 2: ("read", 0, None), 3: ("read", 4, at)}
    assert found[1].next_attempt_at == at + datetime.timedelta(seconds=60) and len(found[1].last_error) == 500 and found[2].next_attempt_at == at


def test_restricted_view_keys(spark):
    from quillstone.functions import privacy

    view = '{"risk_rating": {"Screening": 1}, "steps": [{"ok": 1}, {"peps": 0, "pep_hit": 1}], "API_KEY": "x", "prepared": 2}'
    found = privacy.restricted_paths(spark.createDataFrame([(1, view), (2, "not json")], "n int, x string"), "n", "x")
    assert {r.n: r.paths for r in found.collect()} == {1: ["risk_rating", "risk_rating.Screening", "steps[1].pep_hit", "API_KEY"], 2: []}


def test_grants_after_commands(spark):
    from quillstone.operators import access

    connections = spark.createDataFrame([(1, "active"), (2, "revoked")], "connection int, state string")
    grants = spark.createDataFrame([(1, "a"), (2, "a")], "connection int, scope string")
    commands = spark.createDataFrame([(1, 1, "grant", "b"), (2, 1, "revoke", "a"), (3, 2, "revoke", "a"), (4, 1, "revoke", "b"), (5, 1, "grant", "b")], "command int, connection int, operation string, scope string")
    new, outcomes = access.scope_commands(connections, grants, commands, spark.createDataFrame([("a",), ("b",)], "scope string"))
    assert {r.command: r.outcome for r in outcomes.collect()} == {1: "SUPERSEDED", 2: "REVOKED", 3: "CONNECTION_NOT_ACTIVE", 4: "SUPERSEDED", 5: "GRANTED"}
    assert sorted(tuple(r) for r in new.collect()) == [(1, "b"), (2, "a")]


@pytest.mark.parametrize(
    "parts,given,formatted,line,precision",
    [
        (("23", "15", "Smith", "Street", "Lara", "VIC", "3212"), None, None, "23/15 Smith Street, Lara VIC 3212", "address"),
        (("23", None, "Smith", "Street", None, None, None), None, None, "Smith Street", "street"),
        ((None, None, None, None, "Lara", "VIC", "3212"), "30 Callistemon Approach, Lara", None, "30 Callistemon Approach, Lara, Lara VIC 3212", "address"),
        ((None, None, None, None, "Lara", "VIC", "3212"), "Lara VIC 3212 Australia", "12 High St, Lara", "12 High St, Lara, Lara VIC 3212", "street"),
        ((None, None, None, None, "Lara", None, None), " ", None, "Lara", "locality"),
        ((None,) * 7, None, None, None, "none"),
    ],
)
def test_composed_address(spark, parts, given, formatted, line, precision):
    a = "struct<unit:string,number:string,name:string,type:string,suburb:string,state:string,postcode:string>"
    df = spark.createDataFrame([(parts, given, formatted)], f"a {a}, g string, f string")
    found = df.select(T.composed_address(F.col("a"), F.col("g"), F.col("f")).alias("c")).first().c
    assert (found.precision, found.line) == (precision, line)


@pytest.mark.parametrize("name", ["coerce_rooms", "parse_addresses"])
def test_small_files_are_dealt_over_all_cores(spark, name):
    from conftest import DATA

    from quillstone.queries import QUERIES

    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_exploded_sides_are_not_sent_whole(spark, capsys):
    from conftest import DATA

    from quillstone.queries import QUERIES

    QUERIES["governed_activity"](spark, DATA).explain()
    assert capsys.readouterr().out.count("SortMergeJoin") == 3


def test_equal_versions_of_a_batch(spark, tmp_path):
    from quillstone.sources.versioned import VersionedTable

    for n, order in enumerate(([(1, 5, "a"), (1, 5, "b")], [(1, 5, "b"), (1, 5, "a")])):
        held = VersionedTable(spark, f"file://{tmp_path}/{n}", "k LONG, v LONG, x STRING", ["k"], "v")
        held.apply(spark.createDataFrame(order, "k long, v long, x string").coalesce(1), "s", 0)
        assert [tuple(r) for r in held.snapshot().collect()] == [(1, 5, "b")]
