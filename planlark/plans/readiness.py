"""Sign-off readiness of orders, their lines as results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.operators import readiness as A
from planlark.plans.registry import query
from planlark.sources.io import table


@query("""
    WITH l AS (SELECT l_orderkey AS package, l_orderkey * 2 + l_linenumber % 2 AS chk, l_partkey AS page, l_suppkey, l_linenumber, l_shipdate,
            CASE l_partkey % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'PASS' END AS outcome, l_suppkey % 3 = 0 AS unread, l_partkey % 41 = 0 AS corrected, l_suppkey % 5 < 3 AS addressed FROM lineitem),
    c AS (SELECT package, chk, max(l_shipdate) AS t FROM l WHERE NOT (chk % 2 = 1 AND package % 3 = 0) GROUP BY package, chk),
    r AS (SELECT c.package, count(*) FILTER (WHERE o) AS n_open0, count(*) FILTER (WHERE o AND outcome = 'NOT_FOUND' AND unread AND NOT corrected) AS n_waiting, count(*) FILTER (WHERE o AND corrected) AS n_rerun
        FROM (SELECT *, (coalesce(outcome IN ('FAIL', 'NOT_FOUND'), false) OR corrected) AND NOT addressed AS o FROM l) x JOIN c ON c.chk = x.chk GROUP BY c.package),
    k AS (SELECT package, max(t) AS t FROM c GROUP BY package),
    i AS (SELECT l.package, CAST(p.p_retailprice * 100 AS BIGINT) % 2500 AS d FROM l JOIN part p ON p.p_partkey = l.page WHERE p.p_partkey % 6 = 1
        UNION ALL SELECT l.package, (p.p_size * 37 + p.p_partkey) % 2400 FROM l JOIN part p ON p.p_partkey = l.page WHERE p.p_size % 5 = 2
        UNION ALL SELECT o.o_orderkey, c.c_custkey * 7 % 2300 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey <> 3
        UNION ALL SELECT o.o_orderkey, o.o_orderkey % 2200 FROM orders o WHERE o.o_orderstatus = 'F'),
    z AS (SELECT package, max(d) AS d FROM i GROUP BY package),
    u AS (SELECT DISTINCT package FROM l WHERE l_suppkey % 29 = 0 AND l_linenumber = 1),
    e AS (SELECT o.o_orderkey AS package, CASE WHEN r.package IS NULL THEN 'no_results' WHEN r.n_rerun > 0 THEN 'corrected_wait_for_checks' WHEN u.package IS NOT NULL THEN 'pages_unchecked'
            WHEN TIMESTAMP '1995-01-01' + to_days(CAST(z.d AS INTEGER)) > k.t THEN 'inputs_changed' WHEN o.o_orderkey % 7 = 0 THEN 'not_awaiting_review' END AS reason,
            coalesce(r.n_open0 - r.n_waiting, 0) AS n_open, coalesce(r.n_waiting, 0) AS n_waiting, coalesce(r.n_rerun, 0) AS n_rerun
        FROM orders o LEFT JOIN r ON r.package = o.o_orderkey LEFT JOIN k ON k.package = o.o_orderkey LEFT JOIN u ON u.package = o.o_orderkey LEFT JOIN z ON z.package = o.o_orderkey)
    SELECT package, reason IS NULL AS ready, reason, CAST(n_open AS BIGINT) AS n_open, CAST(n_waiting AS BIGINT) AS n_waiting, CAST(n_rerun AS BIGINT) AS n_rerun FROM e""")
def approval_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages, their lines as results of two checks, and inputs by order, customer, part and view."""
    lines, orders, part, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer"))
    check = F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2
    checks = lines.groupBy(F.col("l_orderkey").alias("package"), check.alias("check")).agg(F.max("l_shipdate").alias("at"))
    checks = checks.withColumn("superseded", (F.col("check") % 2 == 1) & (F.col("package") % 3 == 0))
    outcome = F.when(F.col("l_partkey") % 4 == 0, "FAIL").when(F.col("l_partkey") % 4 == 1, "NOT_FOUND").when(F.col("l_partkey") % 4 == 2, "PASS")
    reason = F.when(F.col("l_suppkey") % 3 == 0, "Waiting for a width").otherwise("Width waiting")
    results = lines.select(check.alias("check"), outcome.alias("outcome"), reason.alias("reason"), (F.col("l_partkey") % 41 == 0).alias("corrected"), (F.col("l_suppkey") % 5 < 3).alias("addressed"))
    on = lambda df, key, days, where: df.filter(where).select(key.alias("key"), (F.lit("1995-01-01").cast("timestamp") + F.make_interval(days=days.cast("int"))).alias("at"))
    view = F.col("p_partkey") * 10 + F.col("p_size") % 3
    branches = [
        A.branch(on(part, F.col("p_partkey"), (F.col("p_retailprice") * 100).cast("decimal(18,0)") % 2500, F.col("p_partkey") % 6 == 1), "page", "key", "at"),
        A.branch(on(part, view, (F.col("p_size") * 37 + F.col("p_partkey")) % 2400, F.lit(True)), "view", "key", "at"),
        A.branch(on(customer, F.col("c_custkey"), F.col("c_custkey") * 7 % 2300, F.col("c_nationkey") != 3), "project", "key", "at"),
        A.branch(on(orders, F.col("o_orderkey"), F.col("o_orderkey") % 2200, F.col("o_orderstatus") == "F"), "package", "key", "at"),
    ]
    views = part.filter("p_size % 5 = 2").select(view.alias("view"), F.col("p_partkey").alias("page"))
    pages = lines.select(F.col("l_partkey").alias("page"), F.col("l_orderkey").alias("package")).distinct()
    packages = orders.select(F.col("o_orderkey").alias("package"), F.col("o_custkey").alias("project"), F.when(F.col("o_orderkey") % 7 != 0, A.AWAITING).alias("state"))
    unchecked = lines.filter("l_suppkey % 29 = 0 AND l_linenumber = 1").select(F.col("l_orderkey").alias("package"), F.col("l_partkey").alias("page"))
    return A.readiness(packages, checks, results, unchecked, A.last_inputs(branches, packages, pages, views))
