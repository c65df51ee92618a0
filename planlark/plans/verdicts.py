"""Rule checks over the test tables: typed operations, precedence, applicability, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.operators import rules as B
from planlark.operators import verdict as V
from planlark.plans.registry import query
from planlark.plans.reports import cents
from planlark.sources.io import table

VERDICT = "CASE WHEN {} THEN 'PASS' ELSE 'FAIL' END"


@query("""
    WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS lines FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CAST(lines AS BIGINT) AS lines, CASE WHEN lines IS NULL THEN 'NOT_FOUND' WHEN abs(CAST(round(o_totalprice * 100) AS BIGINT) - lines) <= 2000000 THEN 'PASS' ELSE 'FAIL' END AS outcome
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def order_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's total against the sum of its lines; no line is NOT_FOUND before any verdict."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    no = F.lit(False)
    result = V.within_tolerance(F.col("lines"), cents("o_totalprice"), F.lit(2_000_000))
    outcome = B.engine_outcome(F.lit(None).cast("string"), no, no, no, F.col("lines").isNull(), no, result, F.lit(V.NOT_FOUND), F.lit(V.REVIEW_REQUIRED))
    return o.select("o_orderkey", "lines", outcome.alias("outcome"))


@query(f"""
    WITH g AS (SELECT l_partkey, max(abs(CAST(l_quantity AS BIGINT) - 25)) AS worst, max(CAST(l_linenumber AS BIGINT)) - min(CAST(l_linenumber AS BIGINT)) AS spread, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_partkey, CAST(worst AS BIGINT) AS worst, {VERDICT.format("worst <= 23")} AS all_within, CASE WHEN n < 2 THEN 'NOT_FOUND' WHEN spread <= 5 THEN 'PASS' ELSE 'FAIL' END AS aligned FROM g""")
def all_prices_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes decide, so partial aggregates are enough and no list is collected."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.abs(q - 25)).alias("worst"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.count("*").alias("n"))
    ends = F.when(F.col("n") < 2, F.array("lo")).otherwise(F.array("lo", "hi"))
    return g.select("l_partkey", "worst", V.verdict(F.col("worst") <= 23).alias("all_within"), V.alignment(ends, F.lit(5)).alias("aligned"))


@query(f"""
    SELECT l_orderkey, count(*) AS lines, {VERDICT.format("count(*) = max(l_linenumber)")} AS outcome,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey""")
def line_count_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List operands in an explicit order, then list operations on the array."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"))))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered.alias("ops"))
    values = F.transform("ops", lambda s: s["q"])
    highest = F.array_max(F.transform("ops", lambda s: s["l_linenumber"]))
    return g.select("l_orderkey", V.count(values).alias("lines"), V.count_equals(values, highest.cast("long")).alias("outcome"), V.total(values).alias("total"))


@query(f"""
    SELECT p_partkey, {VERDICT.format("p_size >= 10")} AS at_least, {VERDICT.format("p_size <= 40")} AS at_most, {VERDICT.format("p_size BETWEEN 5 AND 45")} AS inside,
        {VERDICT.format("p_type IN ('SMALL', 'LARGE')")} AS kind, {VERDICT.format("contains(p_name, 'ring')")} AS named, {VERDICT.format("p_size * 2 = 22")} AS doubled, p_size - 10 AS off FROM part""")
def retail_between_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 V4 V5 V6 V7 V8 V9 V10."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        V.minimum(s, F.lit(10)).alias("at_least"),
        V.maximum(s, F.lit(40)).alias("at_most"),
        V.between(s, F.lit(5), F.lit(45)).alias("inside"),
        V.one_of(F.col("p_type"), F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("kind"),
        V.contains(F.col("p_name"), F.lit("ring")).alias("named"),
        V.equals(V.scale(s, F.lit(2)), F.lit(22)).alias("doubled"),
        V.difference_between(s, F.lit(10)).alias("off"),
    )


@query("""
    WITH a AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS v FROM part WHERE p_partkey % 10 <> 3),
    b AS (SELECT p.p_brand, p.p_partkey, CAST(max(l.l_quantity) AS BIGINT) AS v FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE p.p_partkey % 10 <> 4 GROUP BY 1, 2),
    j AS (SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, abs(a.v - b.v) AS gap FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_partkey = b.p_partkey)
    SELECT p_brand, count(*) AS pairs, CAST(max(gap) AS BIGINT) AS worst, CASE max(CASE WHEN gap IS NULL THEN 1 WHEN gap <= 48 THEN 0 ELSE 2 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'NOT_FOUND' ELSE 'PASS' END AS outcome FROM j GROUP BY p_brand""")
def pairwise_part_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of either side; FAIL beats NOT_FOUND beats PASS."""
    p = table(spark, sf_dir, "part")
    left = p.filter("p_partkey % 10 <> 3").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("v"))
    most = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").cast("long").alias("v"))
    right = p.filter("p_partkey % 10 <> 4").join(most, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey", "v")
    return V.pairwise(left, right, "p_brand", "p_partkey", "v", F.lit(48))


@query("""
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN n IS NULL THEN 'FAIL' ELSE 'PASS' END AS present, c_acctbal > 5000 AS exercised,
        CASE WHEN NOT c_acctbal > 5000 THEN 'PASS' WHEN n IS NULL THEN 'NOT_FOUND' ELSE 'PASS' END AS outcome FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def required_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 V11."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    r = V.conditional_required(F.col("c_acctbal") > 5000, F.col("n"))
    return c.select("c_custkey", V.exists(F.col("n")).alias("present"), r["requirement_exercised"].alias("exercised"), r["outcome"].alias("outcome"))


@query("""
    WITH v AS (SELECT l_orderkey, l_linenumber % 3 AS list, CAST(l_quantity AS BIGINT) - CASE WHEN l_orderkey % 11 = 0 AND l_quantity < 10 THEN 9 ELSE 0 END AS q FROM lineitem),
    g AS (SELECT l_orderkey, sum(q) FILTER (WHERE list = 0) + CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE NULL END AS x, sum(q) FILTER (WHERE list = 0) AS p0, sum(q) FILTER (WHERE list = 1) AS c, sum(q) FILTER (WHERE list = 2) AS f, bool_or(q <= 0) AS bad FROM v GROUP BY l_orderkey),
    s AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN c + f ELSE p0 END AS p, c, f, bad FROM g)
    SELECT l_orderkey, CASE WHEN bad THEN 'REVIEW_REQUIRED' WHEN p IS NULL THEN CASE WHEN c IS NULL OR f IS NULL THEN 'NOT_FOUND' END WHEN c IS NULL AND f IS NULL THEN NULL
        WHEN c IS NULL OR f IS NULL THEN 'REVIEW_REQUIRED' WHEN c + f <> p THEN 'REVIEW_REQUIRED' END AS abstains,
        CAST(CASE WHEN bad THEN NULL WHEN p IS NULL THEN c + f WHEN c IS NULL AND f IS NULL THEN p WHEN c IS NULL OR f IS NULL OR c + f <> p THEN NULL ELSE p END AS BIGINT) AS total FROM s""")
def row_total_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines dealt into pieces, cabinets and fillers; every fifth order's pieces restate the others."""
    q = F.col("l_quantity").cast("long") - F.when((F.col("l_orderkey") % 11 == 0) & (F.col("l_quantity") < 10), 9).otherwise(0)
    of = lambda k: F.collect_list(F.when(F.col("l_linenumber") % 3 == k, q))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of(0).alias("p"), of(1).alias("c"), of(2).alias("f"))
    given = lambda c: F.when(F.size(c) > 0, F.col(c))
    restated = F.when((F.size("c") > 0) & (F.size("f") > 0), F.concat("c", "f"))
    bad = F.exists("p", lambda x: x <= 0)
    pieces = F.when((F.col("l_orderkey") % 5 == 0) & ~bad, restated).otherwise(given("p"))
    t = V.row_total(pieces, given("c"), given("f"))
    return g.select("l_orderkey", t["outcome"].alias("abstains"), t["value"].alias("total"))


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 16 AS d, (l_partkey % 9 - 4) * 16 AS site, (l_suppkey % 4) AS off FROM lineitem),
    t AS (SELECT *, 2 * d + site AS expected, d + site // 2 + off AS a, d + site // 2 AS z FROM b)
    SELECT l_orderkey, l_linenumber, CASE WHEN expected < 2 * 160 OR expected > 2 * 640 THEN 'REVIEW_REQUIRED' WHEN a BETWEEN 160 AND 640 AND z BETWEEN 160 AND 640 AND a + z = expected AND 2 * a = expected AND 2 * z = expected THEN 'PASS' ELSE 'FAIL' END AS outcome,
        CASE WHEN expected < 320 THEN 320 - expected WHEN expected > 1280 THEN expected - 1280 ELSE abs(a + z - expected) END AS delta FROM t""")
def filler_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V20 in whole sixteenths: two equal fillers take up what the site differs by."""
    d, site, off = F.col("l_quantity").cast("long") * 16, (F.col("l_partkey") % 9 - 4) * 16, F.col("l_suppkey") % 4
    half = (site / 2).cast("long")
    v = V.filler_distribution(F.lit(1000) + site, F.lit(1000).cast("long"), F.array(d, d), F.array(d + half + off, d + half), F.lit(160), F.lit(640), F.lit(False))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v["outcome"].alias("outcome"), v["delta"].alias("delta"))


@query("""
    WITH b AS (SELECT p_partkey, p_partkey % 13 - 6 AS x, 32 + p_size % 5 AS f, 300 + p_size AS c, p_partkey % 3 AS k, p_partkey % 2 AS miss FROM part),
    s AS (SELECT *, x * 16 AS diff, greatest(16 * 2, least(48 * 2, 2 * f + x * 16)) AS moved FROM b),
    r AS (SELECT *, diff - (moved - 2 * f) AS rest, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS free FROM s),
    w AS (SELECT *, CASE WHEN moved <> 2 * f AND moved % 2 <> 0 THEN 'share_does_not_divide' WHEN rest <> 0 AND free = 0 THEN 'cannot_resolve' WHEN rest <> 0 AND rest % free <> 0 THEN 'share_does_not_divide'
        WHEN rest <> 0 AND (c + rest // free < 290 OR c + rest // free > 360) THEN 'cannot_resolve' WHEN diff = 0 THEN 'no_change_required' WHEN rest = 0 THEN 'fillers_absorb' ELSE 'cabinets_absorb_remainder' END AS condition FROM r)
    SELECT p_partkey, condition, CASE WHEN condition IN ('no_change_required', 'fillers_absorb', 'cabinets_absorb_remainder') THEN CASE WHEN miss = 0 THEN 'PASS' ELSE 'FAIL' END ELSE 'REVIEW_REQUIRED' END AS outcome FROM w""")
def equal_share_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V21 in whole sixteenths: three cabinets between two fillers; odd parts miss the expected run by one."""
    n = lambda x: F.lit(x).cast("long")
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    diff, f, c = (key % 13 - 6) * 16, n(32) + size % 5, n(300) + size
    kinds = F.when(key % 3 == 0, F.array(*[F.lit("drawer")] * 3)).when(key % 3 == 1, F.array(F.lit("drawer"), F.lit("equipment"), F.lit("drawer"))).otherwise(F.array(*[F.lit("equipment")] * 3))
    free = F.when(key % 3 == 0, n(3)).when(key % 3 == 1, n(2)).otherwise(n(0))
    moved = F.greatest(n(32), F.least(n(96), 2 * f + diff))
    share = F.coalesce(F.floor(F.try_divide(diff - (moved - 2 * f), free)).cast("long"), n(0))
    wanted = lambda at: F.when(kinds[at] != "equipment", c + share).otherwise(c)
    each = F.floor(moved / 2).cast("long")
    bound = F.struct(n(290).alias("low"), n(360).alias("high"))
    bounds = F.create_map(*[x for k in ("single_door", "double_door", "drawer") for x in (F.lit(k), bound)])
    v = V.cabinet_run(n(1000) + diff, n(1000), F.array(f, f), F.array(each + key % 2, each), F.array(c, c, c), F.array(wanted(0), wanted(1), wanted(2)), kinds, bounds, n(16), n(48))
    return table(spark, sf_dir, "part").select("p_partkey", v["condition"].alias("condition"), v["outcome"].alias("outcome"))


SNAPSHOTS = [("R-S", "1.9.0", "SMALL", "Brand#2"), ("R-S", "1.10.0", "SMALL", "Brand#3"), ("R-SG", "2.0.0", "SMALL", None), ("R-L", "1.0.0", "LARGE", "Brand#1"), ("R-M", "0.9.1", "MEDIUM", None)]


@query("""
    SELECT p_partkey, CASE WHEN p_type = 'MEDIUM' THEN 'R-M' WHEN p_partkey % 17 = 0 THEN NULL WHEN p_type = 'SMALL' AND p_brand = 'Brand#3' THEN 'R-S' WHEN p_type = 'SMALL' THEN 'R-SG' WHEN p_type = 'LARGE' AND p_brand = 'Brand#1' THEN 'R-L' END AS applies,
        CASE WHEN p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM') THEN 'NO_APPLICABLE_RULE' WHEN p_type = 'MEDIUM' THEN NULL WHEN p_partkey % 17 = 0 THEN 'REVIEW_REQUIRED' WHEN p_type = 'LARGE' AND p_brand <> 'Brand#1' THEN 'NO_APPLICABLE_RULE' END AS abstains
    FROM part""")
def variant_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 E4 over every part: an unknown brand takes a type's only global rule, and needs review where the type has variants."""
    snaps = spark.createDataFrame(SNAPSHOTS, "rule_id string, version string, product_type string, variant string")
    cases = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("product_type"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("brand"))
    return B.applicability(cases, snaps, "brand").select("p_partkey", "applies", "abstains")


@query("""
    SELECT c.c_mktsegment AS project, p.name, CASE WHEN p.name = 'gap' AND c.c_mktsegment = 'BUILDING' THEN 4 WHEN p.name = 'depth' AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 25 ELSE p.v END AS value,
        CASE WHEN p.name = 'gap' AND c.c_mktsegment = 'BUILDING' THEN 'RUN' WHEN p.name = 'depth' AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'PROJECT' ELSE 'GLOBAL' END AS layer,
        CASE WHEN p.name = 'gap' AND c.c_mktsegment = 'BUILDING' THEN 'GLOBAL=2' WHEN p.name = 'depth' AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'GLOBAL=24' ELSE '' END AS shadowed
    FROM (SELECT DISTINCT c_mktsegment FROM customer) c CROSS JOIN (VALUES ('gap', 2), ('depth', 24)) p(name, v)""")
def parameter_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: GLOBAL under PROJECT under RUN, and what each value shadows."""
    projects = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project")).distinct()
    everywhere = projects.select("project", F.inline(F.array(*[F.struct(F.lit("GLOBAL").alias("layer"), F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("gap", 2), ("depth", 24))])))
    own = projects.filter(F.col("project").isin("BUILDING", "MACHINERY")).select("project", F.lit("PROJECT").alias("layer"), F.lit("depth").alias("name"), F.lit(25).alias("value"))
    run = projects.filter("project = 'BUILDING'").select("project", F.lit("RUN").alias("layer"), F.lit("gap").alias("name"), F.lit(4).alias("value"))
    return B.layered(everywhere.unionByName(own).unionByName(run), ["project"])


@query("""
    SELECT l_partkey, CASE WHEN min(o) = max(o) THEN min(o) ELSE 'REVIEW_REQUIRED' END AS outcome, count(*) AS variants FROM
        (SELECT l_partkey, CASE WHEN l_quantity >= 10 THEN 'PASS' ELSE 'FAIL' END AS o FROM lineitem WHERE l_returnflag <> 'N') GROUP BY l_partkey""")
def every_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisive only where all variants agree."""
    o = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select("l_partkey", V.minimum(F.col("l_quantity"), F.lit(10)).alias("outcome"))
    return B.every_variant(o, ["l_partkey"])


@query("""
    WITH i AS (SELECT p_partkey, p_brand || ' ' || p_size AS input, CASE WHEN p_size % 2 = 0 THEN 'LIST' ELSE 'SCALAR' END AS cardinality FROM part UNION ALL SELECT p_partkey, p_name, 'SCALAR' FROM part)
    SELECT input, cardinality, string_agg('R' || p_partkey, ',' ORDER BY 'R' || p_partkey) AS rules FROM i GROUP BY input, cardinality""")
def required_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules take which input; each part is a rule of two inputs."""
    kind = F.when(F.col("p_size") % 2 == 0, "LIST").otherwise("SCALAR")
    inputs = F.create_map(F.concat_ws(" ", "p_brand", "p_size"), kind, F.col("p_name"), F.lit("SCALAR"))
    return B.required_inputs(table(spark, sf_dir, "part").select(F.concat(F.lit("R"), F.col("p_partkey")).alias("rule_id"), inputs.alias("inputs")))


@query("""
    SELECT s_nationkey, bool_and(s_acctbal > 0) AS publishable FROM supplier GROUP BY s_nationkey""")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unconfirmed tolerance or unset parameter blocks."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") > 0).alias("confirmed"), F.col("s_suppkey").alias("value"))
    return B.publishable(s, ["s_nationkey"])
