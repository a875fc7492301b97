"""Scans, filters, searches, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import blank_to_null, live
from quillstone.operators import reads as R
from quillstone.registry import Tables, query
from quillstone.sources.tables import TABLES

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def scan_projection(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES))
def scan_complete(t: Tables) -> DataFrame:
    frames = [getattr(t, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("SELECT event_type AS source, event_id // 100 AS page, event_id AS id FROM events")
def paged_scan(t: Tables) -> DataFrame:
    """The events in pages of a hundred, each of which states how many its source has; a page that went missing fails the job."""
    stated = t.events.groupBy("event_type").agg(F.count("*").alias("stated"))
    pages = t.events.groupBy("event_type", F.floor(F.col("event_id") / 100).cast("long").alias("page")).agg(F.collect_list("event_id").alias("rows"))
    return R.paged_rows(pages.join(stated, "event_type"), "event_type", "page", "rows", "stated").select(F.col("event_type").alias("source"), "page", F.col("row").alias("id"))


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' "
    "AND o_totalprice >= 50000 AND o_totalprice < 150000"
)
def filter_eq_range(t: Tables) -> DataFrame:
    filters = [
        {"column": "o_orderstatus", "op": "eq", "value": "F"},
        {"column": "o_orderpriority", "op": "neq", "value": "5-LOW"},
        {"column": "o_totalprice", "op": "gte", "value": 50000.0},
        {"column": "o_totalprice", "op": "lt", "value": 150000.0},
    ]
    return R.compose(t.orders, filters).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def filter_null(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").where(F.col("quality").isNull()).select("doc_id", "lang")


@query(
    "SELECT event_id, user_id, event_type, prior FROM (SELECT event_id, user_id, event_type, "
    "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events) x WHERE event_type IS DISTINCT FROM prior"
)
def null_safe_change(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("prior"))
    return e.where(~F.col("event_type").eqNullSafe(F.col("prior")))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'")
def optional_filter(t: Tables) -> DataFrame:
    return R.optional(t.events.select("event_id", "user_id", "event_type"), event_type="error", user_id=None)


@query(
    "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%'"
)
def search_ilike_any(t: Tables) -> DataFrame:
    return R.search_any(t.part, "an,", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query(
    "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01 00:00:00' "
    "AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '2000-01-01 00:00:00'"
)
def validity_window(t: Tables) -> DataFrame:
    as_of = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    return t.orders.where(live(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), as_of)).select("o_orderkey")


@query(
    "SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE regexp_matches(c_name, '[02468]$') "
    "UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE NOT regexp_matches(s_name, '[0-4]$')"
)
def regex_predicate(t: Tables) -> DataFrame:
    c = t.customer.where(F.col("c_name").rlike("[02468]$")).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return c.union(t.supplier.where(~F.col("s_name").rlike("[0-4]$")).select(F.lit("supplier"), "s_suppkey"))


@query(
    "SELECT doc_id, md5(stated) AS stated_md5, length(stated) AS n_stated, nullif(lang, 'en') AS other_lang FROM (SELECT doc_id, lang, coalesce(nullif(trim(replace(text, chr(10), ' ')), ''), lang) AS stated FROM documents) d"
)
def coalesce_nullif(t: Tables) -> DataFrame:
    stated = F.coalesce(blank_to_null(F.replace("text", F.lit("\n"), F.lit(" "))), "lang")
    d = t.documents.select("doc_id", "lang", stated.alias("stated"))
    return d.select("doc_id", F.md5("stated").alias("stated_md5"), F.length("stated").cast("long").alias("n_stated"), F.nullif(F.col("lang"), F.lit("en")).alias("other_lang"))


@query(
    "SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) AS quality, "
    "CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS stated_quality, l.quality IS NOT NULL AS overlaid "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def overlay_values(t: Tables) -> DataFrame:
    derived = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    d = t.documents.select("doc_id", derived.alias("stated_quality")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", "stated_quality").alias("quality"), "stated_quality", F.col("quality").isNotNull().alias("overlaid"))


@query(
    "SELECT o_orderkey, o_totalprice, total, CAST(greatest(1, ceil(total / 25.0)) AS BIGINT) AS total_pages FROM "
    "(SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50) p, (SELECT count(*) AS total FROM orders) c"
)
def page_with_total(t: Tables) -> DataFrame:
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), order, 3)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 200 ORDER BY o_orderkey LIMIT 40")
def page_keyset(t: Tables) -> DataFrame:
    return R.keyset(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 200, 40)


_RANK = " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(PRIORITIES, 1))


@query(
    f"SELECT o_orderkey, CAST(CASE o_orderpriority {_RANK} ELSE 0 END AS BIGINT) AS rank FROM orders "
    f"WHERE lower(concat_ws(' ', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)) LIKE '%7 f%' "
    f"ORDER BY CASE o_orderpriority {_RANK} ELSE 0 END, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100"
)
def search_haystack_ranked(t: Tables) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    found = t.orders.where(F.contains(hay, F.lit("7 f"))).withColumn("rank", R.vocabulary_rank(F.col("o_orderpriority"), PRIORITIES))
    return found.orderBy("rank", F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(R.clamp_limit(None)).select("o_orderkey", "rank")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND lower(p_type) LIKE '%standard%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#1', 'Brand#2', 'Brand#3')")
def compose_saved_filters(t: Tables) -> DataFrame:
    stored = [
        {"column": "p_size", "op": "gte", "value": 10},
        {"column": "p_size", "op": "lte", "value": 20},
        {"column": "p_type", "op": "contains", "value": "STANDARD"},
        {"column": "p_brand", "op": "in", "value": ["Brand#11", "Brand#12", "Brand#13", "Brand#1", "Brand#2", "Brand#3"]},
    ]
    return R.compose(t.part, stored).select("p_partkey", "p_size")


@query("SELECT p_name, p_partkey FROM part")
def visible_columns(t: Tables) -> DataFrame:
    return R.visible(t.part, [("p_name", True), ("p_size", False), ("p_partkey", True), ("gone", True)])


@query("SELECT event_id, ts, user_id FROM events WHERE event_type IN ('error', 'purchase') AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC NULLS LAST, event_id LIMIT 200")
def topk_activity(t: Tables) -> DataFrame:
    seen = t.events.where(F.col("event_type").isin("error", "purchase") & (F.col("ts") <= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")))
    return seen.orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(R.clamp_limit(900)).select("event_id", "ts", "user_id")


@query(
    "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x ORDER BY quality ASC NULLS LAST, doc_id"
)
def sort_nulls_last(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.orderBy(F.col("quality").asc_nulls_last(), "doc_id")


@query(f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority {_RANK} ELSE 0 END, o_orderkey")
def sort_by_vocabulary(t: Tables) -> DataFrame:
    return t.orders.orderBy(R.vocabulary_rank(F.col("o_orderpriority"), PRIORITIES), "o_orderkey").select("o_orderkey", "o_orderpriority")
