"""Tallies, summaries, windows over history, and nested aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import rounded2
from quillstone.operators import relate as J
from quillstone.operators import stats as S
from quillstone.plans.joins import _ACCESS, accessible_customers
from quillstone.plans.reads import _RANK, PRIORITIES
from quillstone.registry import Tables, query

AS_OF = "2000-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-15 00:00:00"


def at(moment: str):
    """A timestamp without zone, as the tables hold them."""
    return F.expr(f"TIMESTAMP_NTZ '{moment}'")


@query(
    f"SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent "
    f"FROM orders WHERE o_custkey IN {_ACCESS} GROUP BY o_orderstatus"
)
def stats_by_status(t: Tables) -> DataFrame:
    rows = J.within(t.orders.withColumnRenamed("o_custkey", "c_custkey"), accessible_customers(t), "c_custkey")
    return S.tally(rows, "o_orderstatus", large=F.col("o_totalprice") > 200000, urgent=F.col("o_orderpriority") == "1-URGENT")


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS total, CAST(CASE WHEN l_returnflag IS NULL AND l_linestatus IS NULL THEN 3 WHEN l_linestatus IS NULL THEN 1 ELSE 2 END AS BIGINT) AS which "
    "FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"
)
def stats_multi_key(t: Tables) -> DataFrame:
    return S.tallies(t.lineitem, "l_returnflag", "l_linestatus")


@query(
    "SELECT l_linestatus, count(*) AS total, count(*) FILTER (WHERE l_discount > 0) AS discounted, count(*) FILTER (WHERE nullif(l_tax, 0) IS NULL) AS untaxed FROM lineitem GROUP BY l_linestatus"
)
def stats_flags(t: Tables) -> DataFrame:
    return S.tally(t.lineitem, "l_linestatus", discounted=F.col("l_discount") > 0, untaxed=F.nullif(F.col("l_tax"), F.lit(0.0)).isNull())


@query(
    "SELECT o_orderpriority, floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 * 100 + 0.5) / 100 AS mean_price FROM orders GROUP BY o_orderpriority"
)
def stats_average(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(S.mean_cents(F.col("o_totalprice")).alias("mean_price"))


@query(f"SELECT l_returnflag, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '{AS_OF}' AND l_linestatus = 'O') AS overdue, count(*) AS total FROM lineitem GROUP BY l_returnflag")
def stats_overdue(t: Tables) -> DataFrame:
    return S.tally(t.lineitem, "l_returnflag", overdue=(F.col("l_shipdate") < at(AS_OF)) & (F.col("l_linestatus") == "O")).select("l_returnflag", "overdue", "total")


@query(
    f"SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error' AND ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY) AS errors_day, "
    f"count(*) FILTER (WHERE event_type = 'signup') AS signups, max(ts) AS latest FROM events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}'"
)
def scan_health(t: Tables) -> DataFrame:
    e = t.events.where(F.col("ts") <= at(EVENTS_AS_OF))
    bad = F.col("event_type") == "error"
    day = F.col("ts") > at(EVENTS_AS_OF) - F.expr("INTERVAL 1 DAY")
    return e.agg(F.count_if(bad).alias("errors"), F.count_if(bad & day).alias("errors_day"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.max("ts").alias("latest"))


@query(
    f"SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}') AS last_day, "
    "count(*) FILTER (WHERE value > 100) AS heavy FROM events GROUP BY event_type"
)
def ops_health(t: Tables) -> DataFrame:
    day = (F.col("ts") > at(EVENTS_AS_OF) - F.expr("INTERVAL 1 DAY")) & (F.col("ts") <= at(EVENTS_AS_OF))
    return S.tally(t.events, "event_type", last_day=day, heavy=F.col("value") > 100)


# An order is an import: its open lines are staged rows, of which returned ones wait for source work, and its filled lines
# of even parts are rows of before that wait for their patch only.
@query(
    "SELECT l_orderkey, count(*) AS staged, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS outstanding, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') = 0 AS ready "
    "FROM lineitem WHERE l_linestatus = 'O' OR l_partkey % 2 = 0 GROUP BY l_orderkey"
)
def publication_readiness(t: Tables) -> DataFrame:
    return S.readiness(t.lineitem, "l_orderkey", F.col("l_linestatus") == "O", F.col("l_partkey") % 2 == 0, F.col("l_returnflag") == "R")


@query(
    "SELECT o_orderstatus, count(*) AS mandatory, count(*) FILTER (WHERE l_returnflag = 'R') AS done, floor(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS ratio "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"
)
def completion_ratio(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_returnflag").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    held = S.tally(lines, "o_orderstatus", done=F.col("l_returnflag") == "R")
    return held.select("o_orderstatus", F.col("total").alias("mandatory"), "done", rounded2(F.col("done").cast("double") / F.col("total")).alias("ratio"))


@query(
    f"SELECT (SELECT count(*) FROM orders WHERE o_custkey IN {_ACCESS}) AS orders, (SELECT count(*) FROM orders WHERE o_custkey IN {_ACCESS} AND o_orderstatus = 'O') AS open_orders, "
    f"(SELECT count(*) FROM {_ACCESS} a) AS customers, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM documents) AS documents, "
    "(SELECT count(*) FROM labels WHERE quality = 0) AS rejected, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS indebted"
)
def workspace_summary(t: Tables) -> DataFrame:
    mine = J.within(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), accessible_customers(t), "c_custkey")
    return S.one_row(
        [
            (mine, {"orders": None, "open_orders": F.col("o_orderstatus") == "O"}),
            (accessible_customers(t), {"customers": None}),
            (t.events.where("event_type = 'error'"), {"errors": None}),
            (t.documents, {"documents": None}),
            (t.labels.where("quality = 0"), {"rejected": None}),
            (t.part, {"parts": None}),
            (t.supplier.where("s_acctbal < 0"), {"indebted": None}),
        ]
    )


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def distinct_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query(
    "SELECT o_orderkey, CASE WHEN bool_or(l_returnflag = 'R') IS NULL THEN 'not_performed' WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_and(l_linestatus = 'F') THEN 'passed' ELSE 'pending' END AS status "
    "FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
)
def status_fold_any_all(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return S.fold_status(t.orders, lines, "o_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS ready, count(*) FILTER (WHERE status = 'not_performed') AS already_current, count(*) FILTER (WHERE status = 'failed') AS blocked FROM "
    "(SELECT o_orderkey, CASE WHEN bool_or(l_returnflag = 'R') IS NULL THEN 'not_performed' WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_and(l_linestatus = 'F') THEN 'passed' ELSE 'pending' END AS status "
    "FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) x"
)
def batch_outcome_counts(t: Tables) -> DataFrame:
    s = F.col("status")
    return status_fold_any_all(t).agg(F.count("*").alias("total"), F.count_if(s == "passed").alias("ready"), F.count_if(s == "not_performed").alias("already_current"), F.count_if(s == "failed").alias("blocked"))


@query(
    "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1"
)
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return rows.select("o_custkey", "m.o_orderkey", "m.o_orderdate")


@query(
    f"SELECT o_custkey, o_totalprice FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}') x WHERE rn = 1"
)
def latest_effective(t: Tables) -> DataFrame:
    held = t.orders.where(F.col("o_orderdate") <= at(AS_OF))
    return held.groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("o_totalprice"))


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, "
    "l_extendedprice DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_discount, l_tax) AS rn FROM lineitem) x WHERE rn = 1"
)
def best_child_per_parent(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = [rank, F.col("l_extendedprice").desc_nulls_last(), *map(F.col, "l_linenumber l_partkey l_suppkey l_quantity l_shipdate l_discount l_tax".split())]
    return J.latest(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate AS effective_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS effective_to, "
    "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current FROM orders"
)
def scd2_intervals(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").alias("effective_from"), F.lead("o_orderdate").over(w).alias("effective_to"), F.lead("o_orderkey").over(w).isNull().alias("is_current")
    )


@query(
    f"SELECT o_custkey, CAST(coalesce(min(CASE WHEN o_orderstatus = 'P' THEN CASE o_orderpriority {_RANK} ELSE 0 END END), max(CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority {_RANK} ELSE 0 END END)) AS BIGINT) AS place FROM orders GROUP BY o_custkey"
)
def rail_position(t: Tables) -> DataFrame:
    from quillstone.operators.reads import vocabulary_rank

    rank = vocabulary_rank(F.col("o_orderpriority"), PRIORITIES)
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(F.coalesce(F.min(F.when(status == "P", rank)), F.max(F.when(status == "F", rank))).alias("place"))


@query(
    "SELECT s.stage_order, s.stage, coalesce(h.n, 0) AS n, coalesce(h.items, '') AS items FROM (VALUES (1, 'O'), (2, 'P'), (3, 'F'), (4, 'Z')) s(stage_order, stage) LEFT JOIN "
    "(SELECT o_orderstatus, max(c) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM (SELECT o_orderstatus, o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) AS c, "
    "row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) x WHERE rn <= 5 GROUP BY o_orderstatus) h ON s.stage = h.o_orderstatus"
)
def pipeline_columns(t: Tables) -> DataFrame:
    stages = t.spark.sql("SELECT * FROM VALUES (1, 'O'), (2, 'P'), (3, 'F'), (4, 'Z') AS v(stage_order, stage)")
    # The first five of each stage are a feature of the board: ranked in place, so no stage is gathered whole.
    ranked = t.orders.select("o_orderstatus", "o_orderkey").withColumn("rn", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey"))).where("rn <= 5")
    items = ranked.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("items"))
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("n"))
    both = stages.join(counts, "stage", "left").join(items, "stage", "left")
    return both.select("stage_order", "stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.lit("")).alias("items"))


@query(
    "SELECT c.conv_id, count(*) FILTER (WHERE c.turn > coalesce(w.mark, -1)) AS unread, count(*) AS total FROM conversations c LEFT JOIN "
    "(SELECT conv_id, max(turn) AS mark FROM conversations WHERE role = 'user' GROUP BY conv_id) w ON c.conv_id = w.conv_id GROUP BY c.conv_id"
)
def unread_counts(t: Tables) -> DataFrame:
    mark = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("mark"))
    held = t.conversations.select("conv_id", "turn").join(mark, "conv_id", "left")
    return held.groupBy("conv_id").agg(F.count_if(F.col("turn") > F.coalesce("mark", F.lit(-1))).alias("unread"), F.count("*").alias("total"))


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def string_agg_sorted(t: Tables) -> DataFrame:
    held = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return held.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


@query("SELECT c_mktsegment, string_agg(k, ',' ORDER BY k) AS nations FROM (SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS k FROM customer) x GROUP BY c_mktsegment")
def array_agg_distinct(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("nations"))


@query(
    "SELECT r_name, '[' || string_agg('{\"n_nationkey\":' || CAST(n_nationkey AS VARCHAR) || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS nations "
    "FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name"
)
def json_agg(t: Tables) -> DataFrame:
    held = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return held.groupBy("r_name").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("nations"))
