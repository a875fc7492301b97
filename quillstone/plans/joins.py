"""Joins: access sets, enrichment, nesting, orphans, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import relate as J
from quillstone.registry import Tables, query

_ACCESS = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 12)"


def accessible_customers(t: Tables) -> DataFrame:
    """The access set of the read queries: customers of one segment in some nations."""
    return t.customer.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") < 12)).select("c_custkey")


@query(
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE c_acctbal > 0 AND r_name <> 'ASIA' AND n_nationkey > 2"
)
def active_membership(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    n = t.nation.where("n_nationkey > 2")
    r = t.region.where("r_name <> 'ASIA'")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN {_ACCESS}")
def semi_join_access(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return J.within(rows, accessible_customers(t), "c_custkey").withColumnRenamed("c_custkey", "o_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 62 AND o_custkey IN {_ACCESS}")
def semi_join_narrow(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.within(rows, accessible_customers(t), "c_custkey", 62).withColumnRenamed("c_custkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(t: Tables) -> DataFrame:
    closed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(closed, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def not_exists_anti(t: Tables) -> DataFrame:
    closed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(closed, "c_custkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans_anti(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(
    "SELECT o_orderkey, o_orderstatus, current_price FROM orders LEFT JOIN "
    "(SELECT l_orderkey, max(l_extendedprice) AS current_price FROM lineitem GROUP BY l_orderkey) p ON o_orderkey = l_orderkey"
)
def left_enrich_current(t: Tables) -> DataFrame:
    price = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("current_price"))
    return t.orders.select("o_orderkey", "o_orderstatus").join(price, "o_orderkey", "left")


@query(
    "SELECT l_returnflag, cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n_lines FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
    "LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2, 3"
)
def left_enrich_two_roles(t: Tables) -> DataFrame:
    lines = (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    counted = lines.groupBy("l_returnflag", "c_nationkey", "s_nationkey").agg(F.count("*").alias("n_lines"))
    both = J.named(J.named(counted, t.nation, "c_nationkey", "n_nationkey", "n_name", "customer_nation"), t.nation, "s_nationkey", "n_nationkey", "n_name", "supplier_nation")
    return both.groupBy("l_returnflag", "customer_nation", "supplier_nation").agg(F.sum("n_lines").alias("n_lines"))


@query(
    "SELECT l_orderkey, l_partkey, o_orderstatus, c_name, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey "
    "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 45"
)
def left_enrich_chain(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    chain = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return chain.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_partkey", "o_orderstatus", "c_name", "n_name")


@query(
    "SELECT o_orderkey, coalesce(children, '') AS children, coalesce(n_children, 0) AS n_children FROM orders LEFT JOIN "
    "(SELECT l_orderkey, count(*) AS n_children, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS children "
    "FROM lineitem GROUP BY l_orderkey) c ON o_orderkey = l_orderkey"
)
def nest_children(t: Tables) -> DataFrame:
    kids = J.nested(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber", "l_partkey"], "kids")
    both = t.orders.select("o_orderkey").join(kids, "o_orderkey", "left")
    text = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["l_linenumber"].cast("string"), k["l_partkey"].cast("string"))), ",")
    return both.select("o_orderkey", F.coalesce(text, F.lit("")).alias("children"), F.coalesce(F.size("kids"), F.lit(0)).cast("long").alias("n_children"))


@query(
    "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey "
    "AND (n.o_orderdate > o.o_orderdate OR (n.o_orderdate = o.o_orderdate AND n.o_orderkey > o.o_orderkey)))"
)
def superseded_self_join(t: Tables) -> DataFrame:
    return J.superseded(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "SELECT s.status, p.priority, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) "
    "CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) p(priority) "
    "LEFT JOIN orders ON o_orderstatus = s.status AND o_orderpriority = p.priority GROUP BY 1, 2"
)
def cross_join_values(t: Tables) -> DataFrame:
    s = t.spark.sql("SELECT * FROM VALUES ('F'), ('O'), ('P'), ('X') AS v(status)")
    p = t.spark.sql("SELECT * FROM VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW') AS v(priority)")
    counted = t.orders.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    # Two literal frames of a fixed few rows.
    return s.crossJoin(p).join(counted, ["status", "priority"], "left").select("status", "priority", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "SELECT p_partkey, CAST(i AS BIGINT) AS place, string_split(p_name, ' ')[i] AS word FROM part, "
    "(VALUES (1), (2), (3), (4), (5)) v(i) WHERE i <= len(string_split(p_name, ' '))"
)
def lateral_posexplode(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word")).select("p_partkey", (F.col("at") + 1).cast("long").alias("place"), "word")


@query(
    "SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS line FROM orders UNION ALL "
    "SELECT 'customer', c_name FROM customer UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'region', r_name FROM region"
)
def union_all_tagged(t: Tables) -> DataFrame:
    parts = [
        t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("line")),
        t.customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("line")),
        t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("line")),
        t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("line")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 1000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_distinct_ids(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal < 1000").select(F.col("c_nationkey").alias("nationkey"))
    return c.union(t.supplier.where("s_acctbal > 5000").select("s_nationkey")).distinct()


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def set_difference(t: Tables) -> DataFrame:
    held = t.supplier.where("s_acctbal > 3000").select(F.col("s_nationkey").alias("nationkey"))
    return t.nation.select(F.col("n_nationkey").alias("nationkey")).join(held, "nationkey", "left_anti")


@query(
    "SELECT doc_id, first_doc, copies, doc_id <> first_doc AS refused FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, "
    "count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) x"
)
def dedupe_content_hash(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return hashed.join(first, "hash").select("doc_id", "first_doc", "copies", (F.col("doc_id") != F.col("first_doc")).alias("refused"))
