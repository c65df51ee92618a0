"""Pages of the packages' summary: customers stand for packages, their orders for revisions, the lines for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.operators import packages as P
from planlark.plans.registry import query
from planlark.sources.io import table

LABELS = {"BUILDING": ["Kitchen", "Kitchens"], "MACHINERY": ["Vanity", "Vanities"]}

SUMMARY = """
    p AS (SELECT c_custkey AS package, CASE WHEN c_custkey % 9 = 0 THEN '  ' WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END END AS vendor, c_mktsegment AS product FROM customer),
    r AS (SELECT o_custkey AS package, o_orderkey AS revision, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number, o_orderdate AS created_at FROM orders),
    n AS (SELECT * FROM r QUALIFY number = max(number) OVER (PARTITION BY package)),
    e AS (SELECT l_orderkey AS revision, arg_max(l_shipdate, (l_linenumber, l_partkey, l_shipdate)) AS state_at FROM lineitem WHERE l_tax > 0.03 GROUP BY 1),
    k AS (SELECT user_id AS package, max(ts) AS checked_at FROM events WHERE event_type = 'purchase' GROUP BY 1),
    f AS (SELECT l_orderkey AS revision, l_linenumber AS finding, max(CASE WHEN l_returnflag = 'A' THEN 'PASS' WHEN l_returnflag = 'N' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'FAIL' ELSE 'NOT_FOUND' END WHEN l_suppkey % 3 = 0 THEN 'NO_APPLICABLE_RULE' ELSE 'REVIEW_REQUIRED' END) AS outcome,
        bool_or(l_discount > 0.05 AND l_returnflag <> 'A') AS blocking FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2),
    g AS (SELECT revision, count(*) FILTER (WHERE outcome = 'PASS') AS pass, count(*) FILTER (WHERE outcome = 'FAIL') AS fail, count(*) FILTER (WHERE outcome = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE outcome = 'NOT_FOUND') AS not_found,
        count(*) FILTER (WHERE outcome = 'NO_APPLICABLE_RULE') AS no_rule, count(*) FILTER (WHERE blocking) AS blocking FROM f GROUP BY 1),
    s AS (SELECT p.package, n.revision, n.number, p.vendor, p.product, greatest(coalesce(e.state_at, n.created_at), k.checked_at) AS updated_at, CASE WHEN trim(coalesce(p.vendor, '')) = '' THEN 1 ELSE 0 END AS unnamed, lower(trim(coalesce(p.vendor, ''))) AS vendor_key,
            coalesce(pass, 0) AS pass, coalesce(fail, 0) AS fail, coalesce(review, 0) AS review, coalesce(not_found, 0) AS not_found, coalesce(no_rule, 0) AS no_rule, coalesce(blocking, 0) AS blocking, o.o_orderstatus = 'F' AS approved, o.o_orderpriority LIKE '1-%' AS signed_ready
        FROM p JOIN n ON n.package = p.package JOIN orders o ON o.o_orderkey = n.revision LEFT JOIN e ON e.revision = n.revision LEFT JOIN k ON k.package = p.package LEFT JOIN g ON g.revision = n.revision)"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, e = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "events"))
    key = F.col("c_custkey")
    vendor = F.when(key % 9 == 0, "  ").when(key % 11 != 0, F.when(key % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    outcome = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "N", F.when(F.col("l_suppkey") % 2 == 0, "FAIL").otherwise("NOT_FOUND")).when(F.col("l_suppkey") % 3 == 0, "NO_APPLICABLE_RULE").otherwise("REVIEW_REQUIRED")
    revision = F.col("l_orderkey").alias("revision")
    return P.summaries(
        c.select(key.alias("package"), vendor.alias("vendor"), F.col("c_mktsegment").alias("product")),
        o.select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("revision"), F.row_number().over(w).alias("number"), F.col("o_orderdate").alias("created_at")),
        l.filter("l_tax > 0.03").select(revision, F.col("l_linenumber").alias("sequence"), F.struct("l_partkey", "l_shipdate").alias("id"), F.col("l_shipdate").alias("at")),
        e.filter("event_type = 'purchase'").select(F.col("user_id").alias("package"), F.col("ts").alias("at")),
        l.select(F.col("l_linenumber").alias("finding"), revision, outcome.alias("outcome"), (F.col("l_quantity") <= 10).alias("superseded"), ((F.col("l_discount") > 0.05) & (F.col("l_returnflag") != "A")).alias("blocking")),
        o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("revision")),
        o.filter(F.col("o_orderpriority").startswith("1-")).select(F.col("o_orderkey").alias("revision")),
    )


@query(f"WITH {SUMMARY} SELECT * FROM s")
def package_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package at its current revision, its outcomes counted and its newest change."""
    return summary(spark, sf_dir)


def second_page(spark: SparkSession, sf_dir: str, sort: str, size: int, text: str | None = None) -> DataFrame:
    rows = summary(spark, sf_dir)
    first = P.page(rows, sort, size, None, text, LABELS).collect()
    if len(first) <= size:
        return rows.limit(0)
    return P.page(rows, sort, size, P.cursor_of(first[size - 1], sort, text), text, LABELS)


@query(f"WITH {SUMMARY} SELECT * FROM s ORDER BY updated_at DESC, package DESC LIMIT 21 OFFSET 20")
def packages_by_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, newest changes first, by the first one's cursor (the limit is the feature)."""
    return second_page(spark, sf_dir, "updated", 20)


@query(f"WITH {SUMMARY} SELECT * FROM s WHERE contains(lower(coalesce(vendor, '')), '1') ORDER BY unnamed, vendor_key, package LIMIT 16 OFFSET 15")
def packages_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of vendors whose name holds a text, without case, unnamed last."""
    return second_page(spark, sf_dir, "vendor", 15, " 1 ")


@query(f"WITH {SUMMARY} SELECT * FROM s WHERE contains(lower(coalesce(vendor, '')), 'ani') OR product = 'MACHINERY' ORDER BY blocking DESC, updated_at DESC, package DESC LIMIT 6 OFFSET 5")
def packages_by_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: the second page of a product found by its label, most open findings first."""
    return second_page(spark, sf_dir, "needs_decision", 5, "ANI")
